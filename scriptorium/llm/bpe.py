"""Byte-level BPE by a tree of joins.

Tokens of a byte string are the fixed point of greedy merging. Two encoded neighbours are joined by encoding
a window around their boundary anew. The window grows until its first and last token are compatible with
the tokens outside. Two tokens are compatible if their bytes, encoded alone, give just these two. A
sequence whose neighbours are all compatible is the encoding of its bytes: the first merge across a boundary
would also happen in the pair alone. So a join is an associative product, and any tree of joins gives the
same tokens.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import Memo, per_batch, resource, text_list

RANKS = "byte_bpe_50k.tiktoken"
#: Byte strings of at most so many bytes are leaves of the tree.
LEAF = 4
#: Encodings of byte strings of at most so many bytes are remembered.
SHORT = 16
#: Sequences of at most so many tokens are decoded as one leaf.
DECODE_LEAF = 4096


class TreeEncoder:
    """Encodes one match of the splitting pattern. ``ranks``: token bytes to id, merged in order of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._short = Memo(self.greedy, 60_000)
        self._fits = Memo(lambda pair: self._window(pair[0] + pair[1]) == list(pair), 60_000)

    def _window(self, data: bytes) -> list[bytes]:
        return self._short[data] if len(data) <= SHORT else self.greedy(data)

    def greedy(self, data: bytes) -> list[bytes]:
        """Merge the adjacent pair of lowest rank, leftmost first, until no pair is a token."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 48:
            return self._greedy_heap(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _greedy_heap(self, parts: list[bytes]) -> list[bytes]:
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(both + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, both + parts[after[i]]))
            if before[i] >= 0 and (r := rank(parts[before[i]] + both)) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]] + both))
        return [p for p in parts if p is not None]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of two encodings one after the other."""
        if not left or not right:
            return left or right
        if self._fits[(left[-1], right[0])]:
            return left + right
        i, j = 1, 1  # tokens of either side inside the window
        while True:
            inner = self._window(b"".join(left[-i:]) + b"".join(right[:j]))
            good_left = i >= len(left) or self._fits[(left[-i - 1], inner[0])]
            good_right = j >= len(right) or self._fits[(inner[-1], right[j])]
            if good_left and good_right:
                return left[: len(left) - i] + inner + right[j:]
            i = i if good_left else min(len(left), 2 * i)
            j = j if good_right else min(len(right), 2 * j)

    def parts(self, data: bytes) -> list[bytes]:
        if data in self.ranks:
            return [data]
        return self._tree(data)

    def _tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self._short[data]
        middle = len(data) // 2
        return self.join(self._tree(data[:middle]), self._tree(data[middle:]))

    def encode(self, data: bytes) -> list[int]:
        return [self.ranks[part] for part in self.parts(data)]


class TextEncoder:
    """Encodes texts: each match of the pattern by itself, as 32-bit little-endian ids.

    A single blank between two characters that are no white space always starts a match, so a text is cut
    there first; the pieces repeat a lot and are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tree = TreeEncoder(ranks)
        self._id = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self._matches = regex.compile(pattern).findall
        self._matched = Memo(self._match, 50_000)
        self._pieces = Memo(self._piece, 250_000)
        self._cut = re.compile(r"(?<=\S) (?=\S)").split
        self._rare_space = re.compile(r"[^\S\x00-\x7f]").search

    def _match(self, match: str) -> bytes:
        return b"".join(map(self._id.__getitem__, self.tree.parts(match.encode("utf-8", "replace"))))

    def _piece(self, piece: str) -> bytes:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):  # letters are one match
            return self._match(piece)
        return b"".join(map(self._matched.__getitem__, self._matches(piece)))

    def _beside_space(self, text: str) -> bool:
        """Whether a blank may stand at an end or beside other white space."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return True
        for c in "\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f":
            if c in text and (f"{c} " in text or f" {c}" in text):
                return True
        return not text.isascii() and self._rare_space(text) is not None

    def ids(self, text: str) -> bytes:
        spaced = self._beside_space(text)
        if not spaced and "\0" not in text:
            return b"".join(map(self._pieces.__getitem__, text.replace(" ", "\0 ").split("\0")))
        pieces = self._cut(text) if spaced else text.split(" ")
        rest = [" " + piece for piece in pieces[1:]]
        return self._pieces[pieces[0]] + b"".join(map(self._pieces.__getitem__, rest))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def _encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(read_ranks(path), pattern)


@lru_cache(2)
def _vocabulary(path: str) -> pa.Array:
    ranks = read_ranks(path)
    known = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        known[rank] = token
    return pa.array(known, pa.binary())


def decode_tree(ids: np.ndarray, vocabulary: pa.Array) -> bytes:
    """The bytes of the tokens, concatenated up a tree of halves."""
    if len(ids) <= DECODE_LEAF:
        if not len(ids):
            return b""
        # A column's bytes lie one after the other.
        _, ends, data = vocabulary.take(pa.array(ids, pa.int32())).buffers()
        return data[: np.frombuffer(ends, "<i4")[len(ids)]].to_pybytes()
    middle = len(ids) // 2
    return decode_tree(ids[:middle], vocabulary) + decode_tree(ids[middle:], vocabulary)


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _ids_array(data: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(d) // 4 for d in data])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32()))


def encode(docs: DataFrame, key: str, text: str = "text", path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """``(key, ids array<int>)``: the tokens of every whole text; with ``decoded`` also their bytes, decoded from the ids.

    ``path``: a file of ranks, one base64 token and its rank per line. A null text is empty and has no tokens.
    A row of any key, null or repeated, gives one row; other columns are not read. No shuffle; a task holds one
    batch of rows. Decoding in the same pass saves moving the ids to a second Python worker.
    """
    path, pattern = resource(path, RANKS), pattern or _default_pattern()

    def work(batch):
        encoder = _encoder(path, pattern)
        data = [encoder.ids(t) for t in text_list(batch.column(1))]
        columns = {"key": batch.column(0), "ids": _ids_array(data)}
        if decoded:
            vocabulary = _vocabulary(path)
            columns["decoded"] = pa.array([decode_tree(np.frombuffer(d, "<i4"), vocabulary) for d in data], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(per_batch(work), f"key {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("key", key)


def decode(tokens: DataFrame, key: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``(key, ids, decoded binary)``: the bytes of the tokens. Null ids decode to no bytes."""
    path = resource(path, RANKS)

    def work(batch):
        vocabulary = _vocabulary(path)
        data = [decode_tree(np.array(row or [], "i4"), vocabulary) for row in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["key", "ids", "decoded"])

    kind = tokens.schema[key].dataType.simpleString()
    rows = tokens.select(tokens[key].alias("key"), tokens[ids].alias("ids"))
    return rows.mapInArrow(per_batch(work), f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)
