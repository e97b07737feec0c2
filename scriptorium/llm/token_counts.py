"""Token counts by a finite-state transducer compiled from a word-end BPE vocabulary.

The transducer reads the bytes of one word. A state holds what any later byte can depend on: the ends of
earlier encodings from which a token of the vocabulary may still reach beyond the bytes read. For each such
place it has the last token there and the number of tokens up to it, relative to now. Its transitions are
annotated with the change of the number of tokens. States are finite in number, since tokens are; they are
determined when first reached and then kept, so later words only follow transitions.

A transition is exact for this reason: a sequence of tokens is the encoding of its bytes if each two
neighbours, encoded alone, stay as they are. So the last token of a longer prefix is the one token that ends
there and is compatible with the encoding of the prefix before it.

A chunk of text is a map from the state in which it is entered to the state in which it is left and a count.
White space resets the state, so that map is given by the bytes before the first white space (still to be
read from the entering state), the count of the complete words, and the bytes after the last white space. Such
maps compose associatively; the chunks of a text are composed by a prefix scan, or as a tree where only the whole count is wanted.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import Memo, per_batch, resource, text_list

VOCABULARY = "word_bpe_49k.json"
#: Characters of a chunk.
CHUNK = 16_384
#: States kept at once; beyond that the transducer is determined anew.
STATES = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Transducer:
    """Counts the tokens of a word. ``merges``: pairs by rank; ``end``: what marks the last symbol of a word."""

    def __init__(self, vocabulary: Sequence[str], merges: Sequence[tuple[str, str]], end: str):
        self._rank = {tuple(pair): i for i, pair in enumerate(merges)}
        self._known, self._end, self._letters = set(vocabulary), end, byte_alphabet()
        self._prefixes = set()
        for token in vocabulary:
            body = token.removesuffix(end)
            self._prefixes.update(body[:i] for i in range(len(body)))
        self._alone = Memo(lambda token: self.merged(self._symbols(token)) == [token], 200_000)
        self._fits = Memo(lambda pair: self.merged(self._symbols(pair[0]) + self._symbols(pair[1])) == list(pair), 200_000)
        self._reset()

    def _reset(self) -> None:
        self._numbers: dict = {}
        self._states: list = []
        self._steps: list[dict[int, tuple[int, int]]] = []
        self._ends: list[dict[int, int]] = []
        self._state("", ((0, None, 0),))

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self._end) and len(token) > len(self._end):
            body = token[: -len(self._end)]
            return [*body[:-1], body[-1] + self._end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the adjacent pair of lowest rank, leftmost first, until there is none."""
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self._rank.get((parts[i], parts[i + 1]))) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _state(self, suffix: str, places: tuple) -> int:
        """The number of a state. ``places``: bytes since, last token there (none: start of the word), tokens up to it."""
        number = self._numbers.setdefault((suffix, places), len(self._states))
        if number == len(self._states):
            self._states.append((suffix, places))
            self._steps.append({})
            self._ends.append({})
        return number

    def _last(self, suffix: str, places: tuple, mark: str) -> tuple[str, int]:
        """The token that ends now, and the number of tokens with it."""
        for back, before, count in places:
            token = suffix[len(suffix) - back - 1 :] + mark
            if token in self._known and (self._alone[token] if before is None else self._fits[before, token]):
                return token, count + 1
        raise ValueError(f"the vocabulary has no token for {suffix[-1]!r}")

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        suffix, places = self._states[number]
        suffix += self._letters[byte]
        token, delta = self._last(suffix, places, "")
        kept = [(0, token, 0)]
        for back, before, count in places:
            if suffix[len(suffix) - back - 1 :] in self._prefixes:
                kept.append((back + 1, before, count - delta))
        step = self._steps[number][byte] = self._state(suffix[len(suffix) - kept[-1][0] :], tuple(kept)), delta
        return step

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state map of a chunk inside a word: where it leads from a state, and the tokens it adds."""
        steps, total = self._steps, 0
        for byte in data:
            step = steps[state].get(byte) or self._step(state, byte)
            state = step[0]
            total += step[1]
        return state, total

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        if len(self._states) > STATES:
            self._reset()
        state, total = self.run(0, word[:-1])
        last = self._ends[state].get(word[-1])
        if last is None:
            suffix, places = self._states[state]
            last = self._ends[state][word[-1]] = self._last(suffix + self._letters[word[-1]], places, self._end)[1]
        return total + last


class ChunkMap(NamedTuple):
    """What a chunk does: ``head`` ends the open word; then ``count`` tokens; then ``tail`` opens a word. A chunk without white space is all head, and has no count."""

    head: str
    count: int | None
    tail: str


class TextCounter:
    """Counts the tokens of texts as the vocabulary's own library does, special strings included."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._transducer = Transducer(list(model["vocab"]), pairs, model["end_of_word_suffix"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._matches = regex.compile(split["pattern"]["Regex"]).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self._hints = {s[:2] for s in special}
        self._separators = re.compile("[\x1c-\x1f]").search
        self._spaces = re.compile("[ \t\n\r\x0b\x0c]+")
        self._words = Memo(self._word, 400_000)

    def _word(self, word: str) -> int:
        """The tokens of text without ASCII white space."""
        if any(hint in word for hint in self._hints):
            return sum(1 if i % 2 else self._plain(part) for i, part in enumerate(self._special.split(word)))
        return self._plain(word)

    def _plain(self, word: str) -> int:
        # Lower-casing goes letter by letter: a sigma is never final.
        low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        if low.isascii() and low.isalpha():
            return self._transducer.count(low.encode())
        return sum(self._transducer.count(match.encode("utf-8", "replace")) for match in self._matches(low))

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = self._spaces.search(chunk)
        if first is None:
            return ChunkMap(chunk, None, "")
        tail = self._spaces.split(chunk[max(chunk.rfind(c) for c in " \t\n\r\x0b\x0c") :])[-1]
        inner = chunk[first.end() : len(chunk) - len(tail)]
        words = self._spaces.split(inner) if self._separators(inner) else inner.split()
        return ChunkMap(chunk[: first.start()], sum(map(self._words.__getitem__, words)), tail)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.count is None and b.count is None:
            return ChunkMap(a.head + b.head, None, "")
        if a.count is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.count is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self._words[a.tail + b.head] + b.count, b.tail)

    def _maps(self, text: str, chunk: int) -> list[ChunkMap]:
        return [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]

    def _ended(self, m: ChunkMap) -> int:
        """The tokens of a chunk that nothing comes before or after."""
        return self._words[m.head] + (m.count or 0) + self._words[m.tail]

    def prefix_counts(self, text: str, chunk: int = CHUNK) -> list[int]:
        """The tokens up to the end of each chunk, words cut there counted as they stand."""
        return [self._ended(m) for m in prefix_scan(self._maps(text, chunk), self.compose)]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """The last of the scan's products alone: neighbours are composed until one map is left, so no more than the text is held."""
        maps = self._maps(text, chunk)
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return self._ended(maps[0]) if maps else 0


def prefix_scan(items: list, compose: Callable) -> list:
    """All prefix products, in a logarithmic number of rounds of independent products."""
    if len(items) < 2:
        return items
    halves = prefix_scan([compose(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)], compose)
    out = [items[0]]
    for i in range(1, len(items)):
        out.append(halves[i // 2] if i % 2 else compose(halves[i // 2 - 1], items[i]))
    return out


@lru_cache(2)
def _counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_tokens(docs: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """``(key, n_bytes, n_tokens)`` of every whole text.

    ``path``: a tokenizer file with a word-end BPE. A null text is empty: no bytes and no tokens. A row of any
    key, null or repeated, gives one row; other columns are not read. No shuffle; a task holds one batch of rows.
    """
    path = resource(path, VOCABULARY)

    def work(batch):
        counter = _counter(path)
        texts = text_list(batch.column(1))
        sizes = pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([counter.count(t) for t in texts], pa.int64())], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(per_batch(work), f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key)
