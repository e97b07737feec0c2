"""A Merkle manifest of a dataset: an append log of tree nodes in postorder, with proofs and their verification.

Rows are leaves; the leaves of a tree stand in a fixed order, and every ``FAN`` consecutive nodes become one node of the next
level until one remains. Nodes are logged in the order in which they are completed, so the place of a node follows in
closed form from the sizes of the subtrees before it (``address``) and nobody has to know the other nodes to write or to find one.

Aligned builders write the log in pages: a page holds a subtree of ``PAGE`` leaves, whose nodes stand together in the log. Pages
of one tree are built by different tasks; their tops are the leaves of the next tier, so a tree of any
size, and a source that holds most rows, is spread over all tasks. Proofs go the other way: a page hands each of its leaves
the siblings on the way up, which it finds by their addresses, and what it was handed itself. The trees' roots, in the order of
the trees, are the leaves of one more tree, built and read in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed

FAN = 16
PAGE_LEVELS = 2
PAGE = FAN**PAGE_LEVELS
#: Bytes of a digest: hex digits.
HEX = 64


def digest_of(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def address(level: int, index: int, leaves: int, fan: int = FAN) -> int:
    """The place of a node in the postorder log of a tree: all that is complete up to its last leaf, then the levels that this leaf completes."""
    last = min((index + 1) * fan**level, leaves) - 1
    place, rest = last, last // fan
    while rest:
        place, rest = place + rest, rest // fan
    return place + level


def levels_of(leaves: int, fan: int = FAN) -> int:
    """Levels above the leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fan), levels + 1
    return levels


def append_log(leaves: list[bytes], fan: int = FAN) -> list[bytes]:
    """The nodes of the tree over ``leaves`` in the order of their completion."""
    log, open_runs = [], [[]]

    def close(level: int) -> None:
        node = digest_of(b"".join(open_runs[level]))
        log.append(node)
        open_runs[level] = []
        if level + 1 == len(open_runs):
            open_runs.append([])
        open_runs[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        level = 0
        while len(open_runs[level]) == fan:
            close(level)
            level += 1
    for level in range(levels_of(len(leaves), fan)):
        if open_runs[level]:
            close(level)
    return log


def _runs(log: bytes, leaves: int) -> list[list[bytes]]:
    """By level, the digests of each run of siblings of a page, one after the other, found by their addresses."""
    found, count = [], leaves
    for level in range(levels_of(leaves)):
        places = [address(level, i, leaves) * HEX for i in range(count)]
        nodes = [log[p : p + HEX] for p in places]
        found.append([b"".join(nodes[i : i + FAN]) for i in range(0, count, FAN)])
        count = -(-count // FAN)
    return found


def _siblings(runs: list[list[bytes]], index: int) -> bytes:
    """The siblings of a leaf of a page and of the nodes above it, level by level, left to right."""
    out = []
    for level in runs:
        run, place = level[index // FAN], index % FAN * HEX
        out += [run[:place], run[place + HEX :]]
        index //= FAN
    return b"".join(out)


def fold(digest: bytes, siblings: bytes, *ways: tuple[int, int]) -> bytes:
    """The root that a leaf and its siblings lead to; ``ways`` are (index, number of leaves) of each tree from the leaf's to the last."""
    at = 0
    for index, leaves in ways:
        while leaves > 1:
            start = index - index % FAN
            others = (min(FAN, leaves - start) - 1) * HEX
            run, place = siblings[at : at + others], (index - start) * HEX
            digest = digest_of(run[:place] + digest + run[place:])
            at, index, leaves = at + others, index // FAN, -(-leaves // FAN)
    return digest


def canonical(*columns: Column) -> Column:
    """The values one after the other: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [column.cast("string") for column in columns]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts])


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.encode(canonical(*columns), "utf-8"), 256)


def _new_runs(values: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it; the first one does."""
    codes = values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.r_[True, codes[1:] != codes[:-1]]


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index``: the place of a row among those of its tree, in the given order. Nulls come first.

    Rows are dealt to ranges, so a tree may lie in many of them. A range needs to know only how many rows its first tree has in
    earlier ranges: one number a range, the only thing that the tasks are told.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    spans = dealt.groupBy("_part", tree).agg(F.count("*").alias("n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row a range: only its first tree can have begun before it.
    begun = spans.select("_part", F.sum("n").over(before).alias("n")).filter("n > 0").collect()
    offsets = {row["_part"]: row["n"] for row in begun}
    names = [name for name in dealt.columns if name != "_part"]

    def number(batches):
        last, at = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column(tree)
            if last is None:
                at = offsets.get(batch.column("_part")[0].as_py(), 0)
            new = _new_runs(trees)
            new[0] = last is not None and not last.equals(trees[0])
            starts = np.flatnonzero(new)
            index = np.arange(batch.num_rows) + at
            if len(starts):
                run = np.cumsum(new)
                index = np.where(run > 0, np.arange(batch.num_rows) - starts[np.maximum(run - 1, 0)], index)
            last, at = trees[-1], int(index[-1]) + 1
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(index, pa.int64())], [*names, "index"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "_part")
    return dealt.mapInArrow(number, f"{kinds}, index bigint")


def _paged(leaves: DataFrame, payload: list[str]) -> DataFrame:
    """Pages ``(tree, page, n, top, lifted, log, payload as lists)`` of leaves ``(tree, index, digest, payload)``.

    ``top`` is the node that remains of the page's leaves; ``lifted`` is the page's node at the height of a full page.
    """
    spark = leaves.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    lists = ", ".join(f"{name} array<{kinds[name]}>" for name in payload)
    schema = f"tree {kinds['tree']}, page bigint, n int, top string, lifted string, log binary{', ' * bool(payload)}{lists}"

    def pages(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        digests = [d.encode() for d in table.column("digest").to_pylist()]
        logs, tops, lifted = [], [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            log = append_log(digests[a:b])
            top = high = log[-1]
            for _ in range(PAGE_LEVELS - levels_of(b - a)):
                high = digest_of(high)
            logs.append(b"".join(log))
            tops.append(top.decode())
            lifted.append(high.decode())
        firsts = pa.array(bounds[:-1])
        lasting = table.slice(0, bounds[-1]).combine_chunks()
        columns = {
            "tree": lasting.column("tree").take(firsts).combine_chunks(),
            "page": lasting.column("page").take(firsts).combine_chunks(),
            "n": pa.array(np.diff(bounds), pa.int32()),
            "top": pa.array(tops, pa.string()),
            "lifted": pa.array(lifted, pa.string()),
            "log": pa.array(logs, pa.binary()),
        }
        for name in payload:
            columns[name] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), lasting.column(name).combine_chunks())
        return pa.RecordBatch.from_pydict(columns)

    def build(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table]).combine_chunks()
            new = _new_runs(waiting.column("tree").combine_chunks()) | _new_runs(waiting.column("page").combine_chunks())
            bounds = np.flatnonzero(new).tolist()
            if len(bounds) > 1:
                yield pages(waiting, bounds)
                waiting = waiting.slice(bounds[-1])
        if waiting is not None:
            yield pages(waiting, [0, waiting.num_rows])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.withColumn("page", F.expr(f"index div {PAGE}"))
    return rows.repartition(parts, "tree", "page").sortWithinPartitions("tree", "page", "index").mapInArrow(build, schema)


def build_tiers(leaves: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The pages of all tiers, and ``(tree, tier, top)``: what remains of each tree and the tier of its last page.

    A tree of more than one page goes on to the next tier, so there are as many rounds as the largest tree has tiers.
    """
    tiers, tops, rows = [], [], leaves
    while True:
        pages = checkpointed(_paged(rows, payload if not tiers else []))
        large = pages.filter("page = 1").select(F.col("tree").alias("_large"))
        goes_on = F.col("tree").eqNullSafe(F.col("_large"))
        tops.append(pages.filter("page = 0").join(large, goes_on, "left_anti").select("tree", F.lit(len(tiers)).alias("tier"), "top"))
        tiers.append(pages)
        if large.isEmpty():
            return tiers, checkpointed(reduce(DataFrame.unionByName, tops))
        rows = pages.join(large, goes_on, "left_semi").select("tree", F.col("page").alias("index"), F.col("lifted").alias("digest"))


def _handed_down(pages: DataFrame) -> DataFrame:
    """For each leaf of the pages ``(tree, page, ..., proof, info)`` its own ``(tree, index, proof, info)``."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def hand(batches):
        for batch in batches:
            trees, numbers, proofs = [], [], []
            sizes, page = batch.column("n").to_pylist(), batch.column("page").to_pylist()
            for i, (log, above) in enumerate(zip(batch.column("log").to_pylist(), batch.column("proof").to_pylist(), strict=True)):
                runs = _runs(log, sizes[i])
                trees += [i] * sizes[i]
                numbers += range(page[i] * PAGE, page[i] * PAGE + sizes[i])
                proofs += [_siblings(runs, k) + above for k in range(sizes[i])]
            place = pa.array(trees, pa.int32())
            columns = [batch.column("tree").take(place), pa.array(numbers, pa.int64()), pa.array(proofs, pa.binary()), batch.column("info").take(place)]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "index", "proof", "info"])

    return pages.mapInArrow(hand, f"tree {kinds['tree']}, index bigint, proof binary, info {kinds['info']}")


def descend(tiers: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """The pages of the lowest tier with ``proof``, the siblings above the page, and ``info``.

    ``seeds (tree, tier, proof, info)`` start at the last page of each tree. Every page meets exactly one row, so a large tree is no hot key.
    """
    handed = None
    for tier in reversed(range(len(tiers))):
        mine = seeds.filter(F.col("tier") == tier).select("tree", F.lit(0).cast("bigint").alias("page"), "proof", "info")
        if handed is not None:
            mine = mine.unionByName(handed.withColumnRenamed("index", "page"))
        mine = mine.select(F.col("tree").alias("_tree"), F.col("page").alias("_page"), "proof", "info")
        pages = tiers[tier].join(mine, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("page") == F.col("_page"))).drop("_tree", "_page")
        if tier == 0:
            return pages
        handed = _handed_down(pages)


@dataclass
class Manifest:
    """The pages of the trees by tier, the pages of the tree over their roots, and ``trees (tree, tier, subroot, leaves, rank)``."""

    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    trees: DataFrame
    n_trees: int
    root: str | None

    def log(self) -> DataFrame:
        """``(tree, level, index, position, digest)``: all nodes of all trees but the topmost, with their places in the tree's postorder log."""
        counts = self.trees.select(F.col("tree").alias("_tree"), "leaves")
        out = []
        for tier, pages in enumerate(self.tiers):
            kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
            sized = pages.select("tree", "page", "n", "log").join(counts, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
            out.append(sized.mapInArrow(_log_rows(tier), f"tree {kinds['tree']}, level int, index bigint, position bigint, digest string"))
        return reduce(DataFrame.unionByName, out)

    def proofs(self, key: str = "key", altered: str = "altered") -> DataFrame:
        """``(key, leaf, subroot, root, siblings, folded_root, verified)`` of every leaf.

        ``siblings`` are the digests on the way to the root. ``folded_root`` is where they lead from ``altered``, or from the leaf where that is null.
        """
        return self._pages_with_proofs().mapInArrow(_prove(altered, whole=True), self._schema(key, "siblings string"))

    def proof_digests(self, key: str = "key", altered: str = "altered") -> DataFrame:
        """As ``proofs``, with ``proof_sha256`` in place of the siblings."""
        return self._pages_with_proofs().mapInArrow(_prove(altered, whole=False), self._schema(key, "proof_sha256 string"))

    def _schema(self, key: str, proof: str) -> str:
        kind = self.tiers[0].schema["key"].dataType.elementType.simpleString()
        return f"`{key}` {kind}, leaf string, subroot string, root string, {proof}, folded_root string, verified boolean"

    def _pages_with_proofs(self) -> DataFrame:
        top = descend(self.top_tiers, self._top_seed())
        above = _handed_down(top).select(F.col("index").alias("rank"), "proof")
        info = F.struct("leaves", "rank", F.lit(self.n_trees).cast("bigint").alias("n_trees"), "subroot", F.lit(self.root).cast("string").alias("root"))
        seeds = self.trees.join(above, "rank").select("tree", "tier", "proof", info.alias("info"))
        return descend(self.tiers, seeds)

    def _top_seed(self) -> DataFrame:
        spark = self.trees.sparkSession
        none = F.struct(F.lit(0).alias("_"))
        return spark.range(1).select(F.lit(0).alias("tree"), F.lit(len(self.top_tiers) - 1).alias("tier"), F.lit(b"").alias("proof"), none.alias("info"))


def _log_rows(tier: int):
    def rows(batches):
        for batch in batches:
            out = {"tree": [], "level": [], "index": [], "position": [], "digest": []}
            pages = batch.to_pydict()
            for tree, page, n, log, leaves in zip(*(pages[c] for c in ("tree", "page", "n", "log", "leaves")), strict=True):
                count, nodes = n, []
                for inner in range(levels_of(n) + 1):
                    # A page's leaves are the lifted tops below, which are logged there unless they had to be lifted.
                    nodes += [(inner, i) for i in range(count)] if inner or not tier else []
                    count = -(-count // FAN)
                height = PAGE_LEVELS if leaves > PAGE ** (tier + 1) else levels_of(n)
                lifted = log[-HEX:]
                for inner, i in nodes:
                    at = address(inner, i, n) * HEX
                    level, index = tier * PAGE_LEVELS + inner, page * FAN ** (PAGE_LEVELS - inner) + i
                    for name, value in zip(out, (tree, level, index, address(level, index, leaves), log[at : at + HEX].decode()), strict=True):
                        out[name].append(value)
                for inner in range(levels_of(n) + 1, height + 1):
                    lifted = digest_of(lifted)
                    level, index = tier * PAGE_LEVELS + inner, page * FAN ** (PAGE_LEVELS - inner)
                    for name, value in zip(out, (tree, level, index, address(level, index, leaves), lifted.decode()), strict=True):
                        out[name].append(value)
            kinds = {"level": pa.int32(), "index": pa.int64(), "position": pa.int64(), "digest": pa.string(), "tree": batch.schema.field("tree").type}
            yield pa.RecordBatch.from_pydict({name: pa.array(values, kinds[name]) for name, values in out.items()})

    return rows


def _prove(altered: str, whole: bool):
    def prove(batches):
        for batch in batches:
            columns = batch.to_pydict()
            place, out = [], {name: [] for name in ("leaf", "subroot", "root", "proof", "folded_root", "verified")}
            for i, (log, n, page, above, info) in enumerate(zip(*(columns[c] for c in ("log", "n", "page", "proof", "info")), strict=True)):
                runs, later = _runs(log, n), columns[altered][i]
                place.append(n)
                for k in range(n):
                    at = address(0, k, n) * HEX
                    leaf, siblings = log[at : at + HEX], _siblings(runs, k) + above
                    start = leaf if later[k] is None else later[k].encode()
                    folded = fold(start, siblings, (page * PAGE + k, info["leaves"]), (info["rank"], info["n_trees"])).decode()
                    values = (leaf.decode(), info["subroot"], info["root"], siblings.decode() if whole else sha256(siblings).hexdigest(), folded, folded == info["root"])
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
            keys = batch.column("key").flatten()
            kinds = [pa.string()] * 5 + [pa.bool_()]
            arrays = [keys, *[pa.array(values, kind) for values, kind in zip(out.values(), kinds, strict=True)]]
            names = ["key", "leaf", "subroot", "root", "siblings" if whole else "proof_sha256", "folded_root", "verified"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return prove


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves (tree, key, digest, altered)``.

    ``tree`` names the tree of a leaf and may be null; within a tree leaves stand in the order of their key, null first, and equal keys in
    the order of their digests. Trees stand in the order of their names, null first, UTF-8 bytewise. ``altered`` is the digest of
    the row as it is found later, null where that is not asked. Repeated rows are leaves of their own. No leaves give no trees and no root.
    """
    placed = ranked(checkpointed(leaves.select("tree", "key", "digest", "altered")), "tree", ["key", "digest"])
    tiers, tops = build_tiers(placed, ["key", "altered"])
    counts = tiers[0].groupBy(F.col("tree").alias("_tree")).agg(F.sum("n").cast("bigint").alias("leaves"))
    named = tops.join(counts, F.col("tree").eqNullSafe(F.col("_tree"))).select(F.lit(0).alias("all"), "tree", "tier", F.col("top").alias("subroot"), "leaves")
    trees = checkpointed(ranked(checkpointed(named), "all", ["tree"]).withColumnRenamed("index", "rank").drop("all"))
    top_tiers, root = build_tiers(trees.select(F.lit(0).alias("tree"), F.col("rank").alias("index"), F.col("subroot").alias("digest")), [])
    first = root.first()
    return Manifest(tiers, top_tiers, trees, trees.count(), first["top"] if first else None)
