"""Fingerprints by a randomised edit embedding.

A walk over a text has one random bit per step and character, the same bits for all texts. At each step it
emits the character it stands on and moves on if the bit is set. Where two texts agree, their walks fall into step
again after an edit, so a small edit distance becomes a small Hamming distance. How soon they do is chance, so there are
``WALKS`` independent walks, and the nearest counts. The fingerprint samples the embeddings: at
fixed random steps, one random bit of the character emitted. Steps are sampled at levels, one per doubling of
the length; a text has the level of its length and the next, so texts of similar length share one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, per_batch, text_list

#: Independent walks, and bits sampled per walk and level.
WALKS, SAMPLES = 2, 256
#: The level of the shortest texts: 2 ** LOWEST characters.
LOWEST = 5
SEED = 7_919
#: Kinds of characters that walks tell apart, and the kind that stands for the end.
KINDS = 128
PAST = KINDS - 1
#: Steps after which the walks' bits repeat, and steps between looks for walks that have ended.
PERIOD = 1 << 16
ROUND = 128
#: Characters and texts embedded at a time.
CHARACTERS, TEXTS = 2_000_000, 512
#: Bands of a walk for texts of one level, and as many for texts of this level and the one below; bits per band.
BANDS, BAND_BITS = 12, 16


@lru_cache(1)
def _walk_bits() -> np.ndarray:
    """The bits of all walks, one walk's behind the other's."""
    bits = np.random.default_rng(SEED).integers(0, 2, (PERIOD, WALKS, KINDS), "u1")
    bits[:, :, PAST] = 0
    return bits.reshape(PERIOD, WALKS * KINDS)


@lru_cache(64)
def _samples(level: int) -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps of a level in order, and the bit that each kind of character gives there."""
    random = np.random.default_rng([SEED, level])
    steps = np.sort(random.integers(0, int(2.1 * 2**level), SAMPLES))
    return steps, random.integers(0, 2, (SAMPLES, KINDS), "u1")


def _kinds(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < PAST, points, (points * np.uint32(2_654_435_761) >> np.uint32(8)) % PAST).astype("u1")


def _level(n: int) -> int:
    return max(LOWEST, (max(n, 1) - 1).bit_length())


def _walks(texts: list[np.ndarray]) -> list[tuple[int, list[tuple[int, bytes]]]]:
    """Of each text its level, and at it and the next, walk by walk, the samples before the end and the bits."""
    sizes, count = np.array([len(t) for t in texts]), len(texts)
    levels = [_level(n) for n in sizes.tolist()]
    chars = np.concatenate([np.r_[t, np.uint8(PAST)] for t in texts])
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    bits = _walk_bits()
    wanted = {level + up for level in set(levels) for up in (0, 1)}
    # For each step the samples of all levels that look at it.
    seen = {level: np.full((WALKS * count, SAMPLES), PAST, "u1") for level in wanted}
    looks: dict[int, list[tuple[int, int]]] = {}
    for level in wanted:
        for place, step in enumerate(_samples(level)[0].tolist()):
            looks.setdefault(step, []).append((level, place))
    # All walks of all texts go side by side.
    alive, at, step = np.arange(WALKS * count), np.tile(starts, WALKS), 0
    own = np.repeat(np.arange(WALKS) * KINDS, count)
    while len(alive):
        for step in range(step, step + ROUND):
            now = chars[at]
            for level, place in looks.get(step, ()):
                seen[level][alive, place] = now
            at += bits[(step + (step >> 16) * 4_099) % PERIOD][now + own]
        step += 1
        going = chars[at] != PAST
        if not going.all():
            alive, at, own = alive[going], at[going], own[going]
    out = []
    for i, level in enumerate(levels):
        rows = []
        for each in (level, level + 1):
            for got in seen[each][i::count]:
                rows.append((int((got != PAST).sum()), np.packbits(_samples(each)[1][np.arange(SAMPLES), got]).tobytes()))
        out.append((level, rows))
    return out


def fingerprints_of(texts: list[str]) -> list[str]:
    """``level:samples:bits:...`` of each text, for each walk at its level and then at the next; equal texts have equal fingerprints."""
    kinds = [_kinds(t) for t in texts]
    out, part, size = [""] * len(texts), [], 0

    def flush() -> None:
        for i, (level, rows) in zip(part, _walks([kinds[i] for i in part]), strict=True):
            out[i] = f"{level}:" + ":".join(f"{n}:{bits.hex()}" for n, bits in rows)

    for i in sorted(range(len(texts)), key=lambda i: len(kinds[i])):
        if part and (len(part) >= TEXTS or size + len(kinds[i]) > CHARACTERS):
            flush()
            part, size = [], 0
        part.append(i)
        size += len(kinds[i])
    if part:
        flush()
    return out


def likeness_of(a: str, b: str) -> float:
    """The estimated share of equal steps of the embeddings, from 0 to 1, of the walk that shows most; 0 for texts whose lengths differ too much to share a level."""
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    p, q = int(x[0]), int(y[0])
    top = max(p, q)
    if top - min(p, q) > 1:
        return 0.0
    best = 0.0
    for walk in range(WALKS):
        i, j = (1 + 2 * (WALKS * (top - level) + walk) for level in (p, q))
        n = max(int(x[i]), int(y[j]))
        if n:
            differ = int.from_bytes(bytes.fromhex(x[i + 1]), "big") ^ int.from_bytes(bytes.fromhex(y[j + 1]), "big")
            best = max(best, 1 - 2 * (differ >> (SAMPLES - n)).bit_count() / n)
    return best


@lru_cache(1)
def _band_places() -> np.ndarray:
    """The sampled bits of each band: among those before the end of all texts of a level, and of those of the level below too."""
    random = np.random.default_rng(SEED + 1)
    return np.stack([[random.choice(int(SAMPLES * share), BAND_BITS, replace=False) for _ in range(WALKS * BANDS)] for share in (0.45, 0.22)])


def bands_of(fingerprint: str) -> list[int]:
    """Keys of the bands of every walk: at the own level for texts of either length, and at the next level for longer ones."""
    parts = fingerprint.split(":")
    level, keys = int(parts[0]), []
    for up, longer in ((0, 0), (0, 1), (1, 1)):
        for walk in range(WALKS):
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(parts[2 + 2 * (WALKS * up + walk)]), "u1"))
            own = slice(walk * BANDS, (walk + 1) * BANDS)
            values = bits[_band_places()[longer][own]] @ (1 << np.arange(BAND_BITS))
            keys += [int(v) | (band + walk * BANDS + longer * WALKS * BANDS) << 24 | (level + up) << 32 for band, v in enumerate(values)]
    return keys


def fingerprint(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, fingerprint)`` of every whole text; a null text is empty. One row per row of ``docs``."""

    def work(batch):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(text_list(batch.column(1))))], ["key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(per_batch(work), f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def compare(x, y):
        import pandas as pd

        return pd.Series([likeness_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return compare(a, b)


def in_ranges(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, text, _last boolean)`` dealt to tasks by ranges of the key and sorted in each, null first; equal keys by the digest of their text.

    Behind the rows of a task comes the first row of the next range that has rows, or the first of all, with
    ``_last``: so each row's successor is in its task. Texts move once. Ranges come from the keys alone; what the tasks are told
    of them is the first key of each, one entry a range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256).alias("digest"))
    ranged = rows.select("key", "digest").repartitionByRange(parts, "key", "digest").withColumn("_part", F.spark_partition_id())
    found = ranged.groupBy("_part").agg(F.min(F.struct("key", "digest")).alias("first")).collect()
    sent = spark.sparkContext.broadcast(sorted((row["first"]["key"] is not None, row["first"]["key"], row["first"]["digest"]) for row in found))

    def deal(batches):
        firsts = sent.value
        place = {first: i for i, first in enumerate(firsts)}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [(k is not None, k, d) for k, d in zip(batch.column("key").to_pylist(), batch.column("digest").to_pylist(), strict=True)]
            to = [bisect_right(firsts, name) - 1 for name in names]
            # The first row of a range goes to the range before it too, behind that range's rows.
            copied = [i for i, name in enumerate(names) if name in place]
            to += [(place[names[i]] - 1) % len(firsts) for i in copied]
            taken = pa.array([*range(len(names)), *copied])
            last = pa.array([False] * len(names) + [True] * len(copied))
            columns = [batch.column(c).take(taken) for c in ("key", "text", "digest")]
            yield pa.RecordBatch.from_arrays([*columns, last, pa.array(to, pa.int32())], ["key", "text", "digest", "_last", "_to"])

    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"key {kind}, text string, digest string, _last boolean, _to int")
    return dealt.repartitionById(max(1, len(found)), F.col("_to")).sortWithinPartitions("_last", "key", "digest").select("key", "text", "_last")


def edited_by_next(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each text, edited with the next one's beginning, and the fingerprints and likenesses of all three.

    ``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``. Edited: the
    last quarter of the characters (rounded down) replaced by the first as many, or all, of the next text, in
    ascending order of the key; the first follows the last. Equal keys follow each other by the digest of their text. A single row is its own next.
    Null texts are empty; null keys come first.
    """

    def run(batches):
        kind = pa.null()
        held: list[tuple] = []  # the row whose next is to come: key, text, fingerprint

        def finish(rows):
            edited = []
            for (_, now, _), (_, after, _) in zip(rows, rows[1:], strict=False):
                cut = len(now) // 4
                edited.append(now[: len(now) - cut] + after[:cut])
            prints = fingerprints_of(edited)
            out = {
                "key": pa.array([r[0] for r in rows[:-1]], kind),
                "n_chars": pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                "fingerprint": pa.array([r[2] for r in rows[:-1]]),
                "edited_fingerprint": pa.array(prints),
                "near_edited": pa.array([likeness_of(r[2], p) for r, p in zip(rows, prints, strict=False)], pa.float64()),
                "near_next": pa.array([likeness_of(r[2], s[2]) for r, s in zip(rows, rows[1:], strict=False)], pa.float64()),
            }
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            kind = batch.schema.field("key").type
            # The first copy of the next range's first row ends the rows; it has no row of its own.
            ends = batch.column(2).to_pylist()
            batch = batch.slice(0, ends.index(True) + 1) if True in ends else batch
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = text_list(part.column(1))
                rows = held + list(zip(part.column(0).to_pylist(), texts, fingerprints_of(texts), strict=True))
                held = rows[-1:]
                if len(rows) > 1:
                    yield finish(rows)
            if True in ends:
                return

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def similar_to(prints: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """``(key, similar_to)``: the smallest key among candidates with a likeness of ``least`` or more, for rows that have one.

    Equal fingerprints are one. Candidates of a fingerprint are, band by band, the smallest key with the same band; so a band of
    any size gives each of its members one candidate, and never pairs. Each is verified by all sampled bits.
    """
    classes = checkpointed(prints.groupBy("fingerprint").agg(F.min(key).alias("first")))

    def banded(batches):
        for batch in batches:
            if batch.num_rows:
                keys = [bands_of(p) for p in batch.column(1).to_pylist()]
                rows = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array([b for k in keys for b in k], pa.int64()), batch.column(0).take(pa.array(rows))], ["band", "first"])

    kind = prints.schema[key].dataType.simpleString()
    bands = classes.select("first", "fingerprint").mapInArrow(banded, f"band bigint, first {kind}")
    heads = bands.groupBy("band").agg(F.min("first").alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head")
    candidates = bands.join(heads, "band").filter("head < first").select("first", "head").distinct()
    named = candidates.join(classes.select("first", F.col("fingerprint").alias("p")), "first")
    named = named.join(classes.select(F.col("first").alias("head"), F.col("fingerprint").alias("q")), "head")
    found = named.filter(likeness(F.col("p"), F.col("q")) >= least).groupBy("first").agg(F.min("head").alias("head"))
    known = classes.join(found, "first", "left").select("fingerprint", F.coalesce("head", "first").alias("similar_to"))
    return prints.select(key, "fingerprint").join(known, "fingerprint").filter(F.col(key) > F.col("similar_to")).select(key, "similar_to")
