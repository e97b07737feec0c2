"""Best-fit packing by exact-complement hashing.

A plan is made from the number of pieces of each length alone, which is bounded by the length of a sequence.
Lengths are taken from the longest down. The gap that one leaves is looked up in indexes of the sums of one,
two and three lengths; a combination that fills it exactly is used as often as the pieces last. What no
combination completes is packed by best fit: the longest rest first, into the open sequence with the smallest gap
that takes it. Steps act on counts, so the plan's size depends on the number of lengths, not of pieces. Pieces
then get their number within their length, and with it their place in the plan.
"""

from __future__ import annotations

from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import LONG, checkpointed, resource, text_list

VOCABULARY = "byte_bpe_50k.json"
LENGTH = 2048
#: Id that ends every document.
END_ID = 0
#: Pieces of text whose ids are remembered, and as many from before.
REMEMBERED = 500_000
#: Pieces of text that the library reads at once, and that make one text if they are letters.
AT_ONCE, JOINED = 20_000, 500
#: Pieces of one length that a group numbers on average; a length has as many groups as it needs.
GROUP_ROWS = 500_000


class TextTokenizer:
    """Ids of texts by the library of the tokenizer file, as 32-bit little-endian bytes.

    A blank between two characters that are no white space always starts a token, and special strings hold no
    blank, so a text is cut there; only pieces that are not remembered go through the library, many at a time. Pieces of letters go as one
    text: the bytes of its tokens, one after the other, are the text's, so their lengths tell where a piece's ids end.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._sizes: np.ndarray | None = None
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._cut = re.compile(r"(?<=\S) (?=\S)").split
        self._rare_space = re.compile(r"[^\S\x00-\x7f]").search

    def _pieces(self, text: str) -> list[str]:
        plain = "  " not in text and text[:1] != " " and text[-1:] != " "
        plain = plain and not any(c in text and (f"{c} " in text or f" {c}" in text) for c in "\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
        plain = plain and (text.isascii() or self._rare_space(text) is None)
        if plain and "\0" not in text:
            return text.replace(" ", "\0 ").split("\0")
        pieces = text.split(" ") if plain else self._cut(text)
        return [pieces[0], *[" " + piece for piece in pieces[1:]]]

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self._known) > REMEMBERED:
            self._old, self._known = self._known, {}
        known = self._known
        cut = [self._pieces(text) for text in texts]
        missing = set(chain.from_iterable(cut)).difference(known)
        self._learn(missing)
        made = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in missing:
            if len(piece) > LONG:
                known.pop(piece, None)
                known.pop(piece[:-1], None)
        return made

    def _together(self, pieces: list[str]) -> list[bytes] | None:
        """The ids of pieces that each are a blank and letters; None if a token goes over the end of one."""
        if self._sizes is None:
            self._sizes = self._token_sizes()
        joined = ["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.array(encoding.ids, "<u4") for encoding in self._library.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.cumsum([len(piece.encode("utf-8", "replace")) for piece in pieces])
        reached = np.cumsum(self._sizes[ids])
        cuts = np.searchsorted(reached, ends)
        if not len(ids) or reached[-1] != ends[-1] or not np.array_equal(reached[cuts], ends):
            return None
        data, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _token_sizes(self) -> np.ndarray:
        """Bytes of each token: in a byte-level vocabulary a character stands for a byte."""
        tokens = self._library.get_vocab(with_added_tokens=False)
        sizes = np.zeros(max(self._library.get_vocab(with_added_tokens=True).values(), default=-1) + 1, "i8")
        for token, number in tokens.items():
            sizes[number] = len(token)
        return sizes

    def _learn(self, missing: set[str]) -> None:
        known, old, marked, ask = self._known, self._old, [], {}
        for piece in missing:
            # A comma or full stop after a letter is a token of its own; what stands before it may be known.
            body = piece[:-1] if piece[-1:] in ",." and piece[-2:-1].isalpha() else piece
            if body is not piece:
                marked.append(piece)
            if body not in known:
                if body in old:
                    known[body] = old[body]
                else:
                    ask[body] = None
        if marked:
            ask.update((mark, None) for mark in ",." if mark not in known)
        words, others = [], []
        for piece in ask:
            (words if piece[:1] == " " and piece[1:].isalpha() else others).append(piece)
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE]
            ids = self._together(part)
            if ids is None:
                others += part
            else:
                known.update(zip(part, ids, strict=True))
        for i in range(0, len(others), AT_ONCE):
            part = others[i : i + AT_ONCE]
            for piece, encoding in zip(part, self._library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = array("I", encoding.ids).tobytes()
        for piece in marked:
            known[piece] = known[piece[:-1]] + known[piece[-1]]


@lru_cache(2)
def _tokenizer(path: str) -> TextTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextTokenizer(path)


def pieces_of(docs: DataFrame, key: str, text: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``(key, piece, start, length, ids binary)``: the pieces of every document's ids, each ended by ``end_id``.

    Only documents longer than ``length`` are cut; then all pieces but the first have just ``length`` ids. A null
    text is empty and has the end id alone. Ids are unsigned 32-bit little-endian numbers.
    """
    path = resource(path, VOCABULARY)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), text_list(batch.column(1))
            for a in range(0, len(texts), 250):
                rows, piece, start, ids = [], [], [], []
                for row, data in enumerate(_tokenizer(path).ids(texts[a : a + 250]), a):
                    data += end
                    at, number = 0, 0
                    size = (len(data) // 4 - 1) % length + 1  # of the first piece
                    while at * 4 < len(data):
                        rows.append(row)
                        piece.append(number)
                        start.append(at)
                        ids.append(data[at * 4 : (at + size) * 4])
                        at, number, size = at + size, number + 1, length
                columns = [keys.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a sequence, number of such sequences)``, for so many pieces of each length."""
    left = Counter({size: n for size, n in counts.items() if n > 0})
    done: Counter = Counter()
    open_: dict[tuple[int, ...], int] = {}

    def use(lengths: tuple[int, ...]) -> int:
        need = Counter(lengths)
        times = min(left[size] // n for size, n in need.items())
        for size, n in need.items():
            left[size] -= times * n
            if not left[size]:
                del left[size]
        return times

    for size in sorted(left, reverse=True):
        while left[size]:
            lengths = _complement(capacity - size, size, left)
            if lengths is None:
                break
            times = use((size, *lengths))
            done[size, *lengths] += times
    # Best fit for the rest: the longest first, into the smallest gap that takes it, many sequences at a time.
    gaps: dict[int, Counter] = {}
    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            gap = min((g for g in gaps if g >= size), default=None)
            if gap is None:
                each = capacity // size
                full, rest = divmod(n, each)
                for times, many in ((full, each), (1, rest)):
                    if times and many:
                        gaps.setdefault(capacity - size * many, Counter())[(size,) * many] += times
                n = 0
                break
            lengths, times = next(iter(gaps[gap].items()))
            each = min(gap // size, n)
            taken = min(times, n // each)
            n -= taken * each
            gaps[gap][lengths] -= taken
            if not gaps[gap][lengths]:
                del gaps[gap][lengths]
            if not gaps[gap]:
                del gaps[gap]
            gaps.setdefault(gap - size * each, Counter())[lengths + (size,) * each] += taken
    for group in gaps.values():
        for lengths, times in group.items():
            open_[lengths] = open_.get(lengths, 0) + times
    return [*done.items(), *open_.items()]


def _complement(gap: int, size: int, left: Counter) -> tuple[int, ...] | None:
    """One, two or three lengths that are left and fill the gap exactly, besides one piece of ``size``; the longest first."""
    have = left.copy()
    have[size] -= 1
    if gap == 0:
        return ()
    if have[gap] > 0:
        return (gap,)
    usable = np.zeros(gap + 1, "i8")
    for s, n in have.items():
        if n > 0 and s <= gap:
            usable[s] = n
    sizes = np.flatnonzero(usable)[::-1]
    pair = _pair(gap, usable, sizes)
    if pair is not None:
        return pair
    for first in sizes:
        usable[first] -= 1
        pair = _pair(gap - int(first), usable, sizes[sizes <= first])
        usable[first] += 1
        if pair is not None:
            return (int(first), *pair)
    return None


def _pair(gap: int, usable: np.ndarray, sizes: np.ndarray) -> tuple[int, int] | None:
    """Two lengths with the sum ``gap``, the longer one as long as possible, by looking up what each one lacks."""
    sizes = sizes[sizes < gap]
    other = gap - sizes
    good = (sizes >= other) & (usable[other] > 0) & (usable[sizes] > 0) & ((sizes != other) | (usable[sizes] > 1))
    at = np.flatnonzero(good)
    return (int(sizes[at[0]]), int(other[at[0]])) if len(at) else None


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Of each run of one length in a pattern: length, its first number, how many, first sequence, sequences' share, first offset."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for size, many in sorted(Counter(lengths).items(), reverse=True):
            rows.append((size, used[size], used[size] + times * many, sequence, many, offset))
            used[size] += times * many
            offset += size * many
        sequence += times
    return rows


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = LENGTH) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    ``order``: columns that name a piece; equal rows may change places. Lengths are from 1 to ``capacity``. At most
    ``capacity`` counts reach the driver, and the plan that comes back is bounded by them. Pieces of one length
    are numbered within groups by a hash of ``order``, which are then put one after the other. The number of groups follows the number of
    pieces of that length, so a hot length is spread over as many tasks as it needs. No pieces give no rows. ``pieces`` is read three times.
    """
    spark = pieces.sparkSession
    counts = {row[0]: row[1] for row in pieces.groupBy(length).agg(F.count("*").alias("n")).collect()}
    groups = spark.createDataFrame([(size, -(-n // GROUP_ROWS)) for size, n in counts.items()], f"{length} {pieces.schema[length].dataType.simpleString()}, _groups bigint")
    # At most ``capacity`` rows.
    spread = pieces.join(F.broadcast(groups), length).withColumn("_group", F.pmod(F.xxhash64(*order), F.col("_groups")).cast("int")).drop("_groups")
    totals = checkpointed(spread.groupBy(F.col(length).alias("_length"), "_group").agg(F.count("*").alias("_n")))
    slots = spark.createDataFrame(_slots(plan(counts, capacity)), "_size bigint, _from bigint, _to bigint, _sequence bigint, _many bigint, _offset bigint")
    before = Window.partitionBy("_length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_length").alias("_size"), F.col("_group").alias("_part"), "_start")
    inside = Window.partitionBy(length, "_group").orderBy(*order)
    numbered = spread.withColumn("_row", F.row_number().over(inside).cast("bigint") - 1)
    # At most ``capacity`` rows and one for each GROUP_ROWS pieces.
    numbered = numbered.join(F.broadcast(starts), (F.col(length) == F.col("_size")) & (F.col("_group") == F.col("_part"))).select(
        *pieces.columns, (F.col("_row") + F.col("_start")).alias("_number")
    )
    places = slots.groupBy("_size").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_sequence", "_many", "_offset"))).alias("_slots"))
    return (
        numbered.join(F.broadcast(places), F.col(length) == F.col("_size"))
        .withColumn("_slot", F.get(F.filter("_slots", lambda s: (s["_from"] <= F.col("_number")) & (F.col("_number") < s["_to"])), F.lit(0)))
        .withColumn("_in", F.col("_number") - F.col("_slot._from"))
        .withColumn("sequence_id", F.col("_slot._sequence") + ((F.col("_in") - F.col("_in") % F.col("_slot._many")) / F.col("_slot._many")).cast("bigint"))
        .withColumn("offset", F.col("_slot._offset") + (F.col("_in") % F.col("_slot._many")) * F.col(length))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def packed_documents(docs: DataFrame, key: str, text: str = "text", path: str | None = None, capacity: int = LENGTH) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of every document.

    Null texts are empty; repeated rows are pieces of their own; no rows give no rows; other columns are not
    read. Each text is tokenized once; what is kept of a piece is its length and the checksum of its ids.
    """
    pieces = pieces_of(docs, key, text, path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(checkpointed(pieces), [key, "piece", "start"], "length", capacity)
