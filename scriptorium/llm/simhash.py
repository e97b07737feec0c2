"""Near-duplicates by SimHash fingerprints, found with BK-trees.

Of ``radius + 1`` blocks of bits, two fingerprints within the radius agree in one at least, and so in any part of it. Distinct
fingerprints are dealt to shards once per block, by as few of its bits as bring a shard to some thousand: a bound on memory that loses no
link. A shard that is larger all the same is dealt again, by the whole block and then by the bits that are left, until its size is
bounded by their number. A shard is a BK-tree: children keyed by their distance to the parent. It is built in the task
that holds the shard, meets the shard's fingerprints, and only edges whose distance
can lead into the radius are followed. A shard's links go on as stars, never as all pairs of a group.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, per_batch, text_list
from scriptorium.llm.components import component_roots

BITS = 64
SEED = 42
#: Fingerprints that a shard is meant to have, and those of one that is not dealt again.
MEANT, SHARD = 2048, 8192
#: Pairs of a query and a tree node that a task follows at a time.
FRONTIER = 1_000_000

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype("float64")


def fingerprint_of(text: str, width: int) -> int:
    """Unsigned fingerprint of one text; without words zero."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), "<u8")
    places = hashes.view("u1").reshape(-1, 8) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str = "text", width: int = 3) -> DataFrame:
    """``(key, fp bigint, digest)``: the fingerprint's bits as a signed number, and the digest of the text."""

    def work(batch):
        made = np.array([fingerprint_of(t, width) for t in text_list(batch.column(1))], "<u8").view("<i8")
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64()), batch.column(2)], ["key", "fp", "digest"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), text_digest(docs[text]).alias("digest"))
    return rows.mapInArrow(per_batch(work), f"key {kind}, fp bigint, digest string").withColumnRenamed("key", key)


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """Places and widths of ``parts`` blocks of ``bits`` bits."""
    bounds = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def _block(value: Column, place: int, width: int) -> Column:
    return F.shiftrightunsigned(value, place).bitwiseAND(F.lit((1 << width) - 1))


def _packed(value: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of the blocks, one after the other."""
    out, at = F.lit(0).cast("bigint"), 0
    for place, width in blocks:
        out = out.bitwiseOR(F.shiftleft(_block(value, place, width), at))
        at += width
    return out


def _dealt(rows: DataFrame, bits: int, parts: int, agree: int) -> tuple[DataFrame, int]:
    """Rows ``(key, rest, fp)`` by each choice of ``agree`` of ``parts`` blocks of ``rest``; and the most bits that are left."""
    blocks, copies, left = _cuts(bits, parts), [], 0
    for number, chosen in enumerate(combinations(range(parts), agree)):
        others = [blocks[i] for i in range(parts) if i not in chosen]
        left = max(left, sum(width for _, width in others))
        key = F.xxhash64(F.col("key"), F.lit(number), _packed(F.col("rest"), [blocks[i] for i in chosen]))
        copies.append(F.struct(key.alias("key"), _packed(F.col("rest"), others).alias("rest"), "fp"))
    return rows.select(F.explode(F.array(*copies)).alias("c")).select("c.*"), left


def build_trees(shard: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once: of each value its root, its parent (-1: none) and its distance to it. ``shard`` is sorted."""
    n = len(value)
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(starts, np.diff(np.r_[starts, n]))
    parent, edge = np.full(n, -1), np.zeros(n, "i8")
    waiting = np.setdiff1d(np.arange(n), starts, assume_unique=True)
    under = root[waiting]
    while len(waiting):
        distance = np.bitwise_count(value[waiting] ^ value[under]).astype("i8")
        order = np.lexsort((waiting, distance, under))
        waiting, under, distance = waiting[order], under[order], distance[order]
        first = np.r_[True, (under[1:] != under[:-1]) | (distance[1:] != distance[:-1])]
        parent[waiting[first]], edge[waiting[first]] = under[first], distance[first]
        child = waiting[first][np.cumsum(first) - 1]
        waiting, under = waiting[~first], child[~first]
    return root, parent, edge


def search_trees(root: np.ndarray, parent: np.ndarray, edge: np.ndarray, value: np.ndarray, radius: int, visits: Counter | None = None):
    """Yields arrays of pairs (query, found) within the radius, each value as a query to its shard's tree. ``visits`` counts the nodes that are met."""
    child = np.flatnonzero(parent >= 0)
    code = parent[child] * 128 + edge[child]
    order = np.argsort(code, kind="stable")
    child, code = child[order], code[order]
    stack = [(q := np.arange(len(value)), root[q])]
    while stack:
        query, node = stack.pop()
        if len(query) > FRONTIER:
            half = len(query) // 2
            stack += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        if visits is not None:
            visits["nodes"] += len(node)
        distance = np.bitwise_count(value[query] ^ value[node]).astype("i8")
        hit = (distance <= radius) & (query != node)
        if hit.any():
            yield query[hit], node[hit]
        low = np.searchsorted(code, node * 128 + np.maximum(distance - radius, 0))
        count = np.searchsorted(code, node * 128 + distance + radius, "right") - low
        more = np.flatnonzero(count)
        if len(more):
            # Children in pieces, so that a frontier never grows beyond a multiple of its bound.
            for part in np.array_split(more, 1 + int(count[more].sum()) // FRONTIER):
                times = count[part]
                place = np.repeat(low[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
                stack.append((np.repeat(query[part], times), child[place]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each pair; a label is the smallest member's."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def shard_links(shard: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest-numbered value of its set) of the shards, which are sorted and hold distinct values."""
    repeated = np.r_[False, shard[1:] == shard[:-1]]
    inside = repeated | np.r_[repeated[1:], False]
    shard, value = shard[inside], value[inside]
    label = np.arange(len(value))
    if len(value):
        for a, b in search_trees(*build_trees(shard, value), value, radius):
            label = _merge(label, a, b)
    moved = label != np.arange(len(value))
    return value[moved], value[label[moved]]


def _links_of_sorted(radius: int):
    """For mapInArrow over rows sorted by shard: complete shards in blocks, the last one carried on."""

    def made(shard, value):
        a, b = shard_links(shard, value.view("<u8"), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["a", "b"])

    def run(batches):
        shard, value = np.empty(0, "i8"), np.empty(0, "i8")
        for batch in batches:
            shard = np.r_[shard, batch.column(0).to_numpy()]
            value = np.r_[value, batch.column(1).to_numpy()]
            if len(shard) >= 50_000 and shard[0] != shard[-1]:
                done = int(np.searchsorted(shard, shard[-1]))
                yield made(shard[:done], value[:done])
                shard, value = shard[done:], value[done:]
        if len(shard):
            yield made(shard, value)

    return run


def _by_prefix(distinct: DataFrame, radius: int) -> tuple[DataFrame, int]:
    """Rows ``(key, whole, rest, fp)`` once per block: the key from a few of its bits, from all of them, and the other blocks' bits; and the most bits that are left."""
    blocks = _cuts(BITS, radius + 1)
    few = max(0, (max(distinct.count(), 1) - 1).bit_length() - (MEANT.bit_length() - 1))
    copies = []
    for number, (place, width) in enumerate(blocks):
        key, whole = (F.xxhash64(F.lit(number), _block(F.col("fp"), place, bits)) for bits in (min(few, width), width))
        rest = _packed(F.col("fp"), blocks[:number] + blocks[number + 1 :])
        copies.append(F.struct(key.alias("key"), whole.alias("whole"), rest.alias("rest"), "fp"))
    return distinct.select(F.explode(F.array(*copies)).alias("c")).select("c.*"), BITS - min(width for _, width in blocks)


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of ``distinct (fp)`` within the radius."""
    dealt, left = _by_prefix(distinct.select("fp"), radius)
    ready = []
    for again in range(4):
        dealt = checkpointed(dealt)
        hot = checkpointed(dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD).select("key"))
        ready.append(dealt.join(hot, "key", "left_anti").select("key", "fp"))
        if hot.isEmpty():
            break
        dealt = dealt.join(hot, "key", "left_semi")
        if again == 0:
            dealt = dealt.select(F.xxhash64("key", "whole").alias("key"), "rest", "fp")
        else:
            dealt, left = _dealt(dealt, left, radius + 1, 1)
    else:
        # A shard now holds at most 2 ** left distinct fingerprints.
        ready.append(dealt.select("key", "fp"))
    shards = reduce(DataFrame.unionByName, ready)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links_of_sorted(radius), "a bigint, b bigint")


def _rooted(marked: DataFrame, key: str, radius: int) -> DataFrame:
    """``(fp, root, first, winner)`` of each distinct fingerprint: its component, the smallest key with it, and the row that goes before all others with it."""
    # Null keys go behind all others.
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "digest")
    distinct = checkpointed(marked.groupBy("fp").agg(F.min(key).alias("first"), F.min(order).alias("winner")))
    roots = component_roots(fingerprint_links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", "first", "winner", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str, text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """``(key, fp, component_id)`` of every row: documents are linked at ``radius`` or fewer differing bits.

    ``component_id`` is the smallest key that can be reached. A null text is empty; texts without words have
    fingerprint zero and are linked like any other. Repeated rows stay; null keys are never the smallest unless all are null. No
    rows give no rows; other columns are not read. Only fingerprints move, and equal ones as one.
    """
    marked = checkpointed(fingerprints(docs, key, text, width))
    rooted = _rooted(marked, key, radius)
    # One row per distinct fingerprint; the copies come in by the last join, which splits hot fingerprints.
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(members, "fp").select(key, "fp", "component_id")


def survivors(docs: DataFrame, key: str, text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` of each component: the one with the smallest key, of equal keys the one with the smallest digest of its text.

    Null keys go behind all others. Components are of rows, so unlike rows that share a key are kept side by side; of rows with equal key and text any one
    stays. A row is found again by its key and its text's digest, and texts move once.
    """
    marked = checkpointed(fingerprints(docs, key, text, width))
    winners = _rooted(marked, key, radius).groupBy("root").agg(F.min("winner").alias("w")).select(F.col("w.key").alias("_key"), F.col("w.digest").alias("_digest"))
    dealt = docs.withColumn("_text_digest", text_digest(docs[text]))
    same = (F.col("_text_digest") == F.col("_digest")) & F.col(key).eqNullSafe(F.col("_key"))
    return dealt.join(winners, same, "left_semi").dropDuplicates([key, "_text_digest"]).drop("_text_digest")
