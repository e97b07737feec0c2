import random
import time
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import splitting
from scriptorium.functions.splitting import first_lines
from scriptorium.functions.text import strip
from scriptorium.operators import chunking
from scriptorium.operators.ordering import dense_ordinal, running_offset


def cut(value, text, **options):
    return value(chunking.paragraph_chunks(F.col("t"), **options), t=text)


def test_paragraphs_are_stripped_of_unicode_whitespace(value):
    text = "\t a  \n\n\n\n  \n\nb\x85"
    assert value(chunking.paragraphs(F.col("t")), t=text) == ["a", "b"]
    assert value(strip(F.col("t")), t="\x1c x y　") == "x y"


def test_short_paragraphs_carry_the_last_one(value):
    a, b, c = "a" * 300, "b" * 200, "c" * 10
    assert cut(value, "\n\n".join([a, b, c])) == [a + "\n\n" + b, b + "\n\n" + c]
    assert cut(value, "\n\n".join([a, b, c]), overlap=0) == [a + "\n\n" + b, c]


def test_a_chunk_may_reach_twice_the_size_after_a_carry(value):
    a, b, c = "a" * 400, "b" * 400, "c" * 300
    assert cut(value, "\n\n".join([a, b, c])) == [a, a + "\n\n" + b, b + "\n\n" + c]


def test_pending_paragraphs_come_after_a_later_long_one(value):
    long_one = " ".join(["word"] * 150)
    out = cut(value, "first\n\n" + long_one + "\n\nlast")
    assert out[-1] == "first\n\nlast"
    assert " ".join(out[:-1]) == long_one
    assert len(out[0]) <= 499 and all(len(piece) <= 500 for piece in out[:-1])


@pytest.mark.parametrize("letters, pieces", [(499, 1), (500, 2), (600, 2)])
def test_a_first_word_that_cannot_fit_leaves_an_empty_piece(value, letters, pieces):
    word = "w" * letters
    assert value(chunking.pack_words(F.col("t")), t=word) == [""] * (pieces - 1) + [word]


def test_later_pieces_hold_one_character_more(value):
    words = ["x" * 99] * 10
    out = value(chunking.pack_words(F.col("t")), t=" ".join(words))
    assert [len(piece) for piece in out] == [499, 499]


def test_no_text_no_chunks(value):
    assert cut(value, "") == [] and cut(value, " \n\n\t") == []


def test_line_spans(value):
    text = "one\ntwo\nthree\ntwo"
    assert tuple(value(chunking.line_span(F.col("t"), F.lit("two\nthree")), t=text)) == (2, 3)
    assert tuple(value(chunking.line_span(F.col("t"), F.lit("two")), t=text)) == (2, 2)
    assert tuple(value(chunking.line_span(F.col("t"), F.lit("four")), t=text)) == (0, 0)
    assert tuple(value(chunking.line_span(F.col("t"), F.lit("")), t=text)) == (1, 1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\né", max_size=80), st.lists(st.text(alphabet="ab\n", max_size=12), max_size=4), st.integers(0, 80), st.integers(1, 30))
def test_first_lines_against_search(text, others, start, size):
    chunks = [*others, text[start : start + size], text]
    places = [text.find(chunk) for chunk in chunks]
    lines = [0 if place < 0 else text.count("\n", 0, place) + 1 for place in places]
    expected = [{"start_line": n, "end_line": n + c.count("\n") if n else 0} for n, c in zip(lines, chunks)]
    assert first_lines(text, chunks) == expected


def test_a_long_document_is_located_in_linear_time(spark):
    text = "\n\n".join(f"{i} " + " ".join(["word"] * 50) for i in range(12_000)) + "\n\n0 " + " ".join(["word"] * 50)
    started = time.time()
    rows = chunking.chunk_rows(spark.createDataFrame([("a", text)], "path string, text string")).orderBy("chunk_index").collect()
    assert time.time() - started < 60 and len(rows) > 5000 and len(text) > 3_000_000
    for row in rows[::500]:
        place = text.find(row.chunk)
        assert row.start_line == (0 if place < 0 else text.count("\n", 0, place) + 1)
    assert rows[0].start_line == 1


def test_index_table(spark):
    documents = spark.createDataFrame([("b/z.md", "x\n\ny"), ("a.md", "k" * 600)], "path string, text string")
    rows = chunking.chunk_index_table(documents).orderBy("id").collect()
    assert [(r.id, r.filename, r.chunk_index, r.total_chunks, r.start_line, r.end_line) for r in rows] == [
        ("doc_0_chunk_0", "a.md", 0, 2, 1, 1),
        ("doc_0_chunk_1", "a.md", 1, 2, 1, 1),
        ("doc_1_chunk_0", "z.md", 0, 1, 1, 3),
    ]


def test_sources_by_position(spark):
    documents = spark.createDataFrame([("a", "x" * 400 + "\n\n" + "y" * 400), ("b", "z")], "path string, text string")
    chunks = chunking.global_positions(documents)
    sources = spark.createDataFrame([(0, "Archivo: a"), (1, "Archivo: b")], "position bigint, source string")
    found = chunking.attach_source(chunks, sources).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.source, r.path) for r in found] == [
        ("0", "Archivo: a", "a"),
        ("1", "Archivo: b", "a"),
        ("2", "Fragmento Markdown 2", "b"),
    ]


def test_positions_over_many_ranges(spark):
    rng = random.Random(5)
    keys = list({f"{rng.choice('abñ日')}{rng.random()}" for _ in range(9000)})
    weights = {key: rng.randrange(4) for key in keys}
    frame = spark.createDataFrame([(k, weights[k]) for k in keys], "k string, w bigint").repartition(7)
    ordinal = {r.k: r.ordinal for r in dense_ordinal(frame, "k").collect()}
    offset = {r.k: r.o for r in running_offset(frame, "k", "w", "o").collect()}
    total = 0
    for place, key in enumerate(sorted(keys)):
        assert ordinal[key] == place and offset[key] == total
        total += weights[key]


SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of the text; each keeps the separator in front of it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [piece for piece in (head, *(separator + piece for piece in rest)) if piece]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size`` and let each result start with a tail of the one before."""
    packed: list[str] = []
    window: deque[str] = deque()
    width = 0
    for piece in pieces:
        if window and width + len(piece) > size:
            packed.append("".join(window))
            while window and (width > overlap or width + len(piece) > size):
                width -= len(window.popleft())
        window.append(piece)
        width += len(piece)
    packed.append("".join(window))
    return [text for text in map(str.strip, packed) if text]


def split_recursively(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that makes them fit."""
    if not text:
        return []
    level = next((i for i, mark in enumerate(separators) if mark == "" or mark in text), len(separators) - 1)
    finer = separators[level + 1 :]
    chunks: list[str] = []
    fitting: list[str] = []
    for piece in _cut(text, separators[level]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        if fitting:
            chunks += _pack(fitting, size, overlap)
            fitting = []
        chunks += split_recursively(piece, size, overlap, finer) if finer else [piece]
    if fitting:
        chunks += _pack(fitting, size, overlap)
    return chunks


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_recursive_splitting_properties(text, size, overlap):
    chunks = split_recursively(text, size, overlap)
    assert all(0 < len(chunk) <= size and chunk in text for chunk in chunks)
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_recursive_splitting_overlaps():
    text = " ".join(f"w{i:02d}" for i in range(30))
    chunks = split_recursively(text, 40, 8)
    for left, right in zip(chunks, chunks[1:]):
        shared = max(n for n in range(len(right) + 1) if left.endswith(right[:n]))
        assert 0 < shared <= 8


@pytest.mark.parametrize("size, overlap", [(10, 3), (7, 0), (12, 9)])
def test_recursive_chunks_against_the_plain_rule(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", " ", "\n\n", "a", "x" * 95, "é" * 40 + " b", "ab " * 30, "\n\n\n" * 9, "a\n\n" + "b" * 30 + "\n\nc"]
    texts += ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    frame = spark.createDataFrame([*enumerate(texts), (-1, None)], "path int, text string").repartition(3)
    found = {r.path: r.chunks for r in frame.select("path", chunking.recursive_chunks(F.col("text"), size, overlap).alias("chunks")).collect()}
    assert found == {-1: [], **{i: split_recursively(t, size, overlap) for i, t in enumerate(texts)}}


def test_a_long_text_is_split_in_linear_time(spark):
    text = "x" * 3_000_000 + " " + "word " * 100_000
    started = time.time()
    chunks = spark.createDataFrame([("a", text)], "path string, text string").select(chunking.recursive_chunks(F.col("text"))).first()[0]
    assert time.time() - started < 60 and chunks == split_recursively(text, 500, 50)


def test_first_lines_of_short_and_long_texts_agree(monkeypatch):
    text = "\n".join(f"line {i % 7} of {i}" for i in range(200))
    chunks = ["", "of 12", "line 3 of 3\nline 4", "line 1", text, text + "x", "not there", "of 12"]
    found = []
    for short in (10**6, -1):
        monkeypatch.setattr(splitting, "SHORT", short)
        found.append(first_lines(text, chunks))
    assert found[0] == found[1] and found[0][1]["start_line"] == 13
