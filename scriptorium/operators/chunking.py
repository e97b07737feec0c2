"""Cutting texts into chunks, with line positions and index metadata."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.constants import CHUNK_OVERLAP, CHUNK_SIZE, SOURCE_FALLBACK
from scriptorium.functions.splitting import first_lines
from scriptorium.functions.text import basename, let, positions, strip, words
from scriptorium.operators.ordering import dense_ordinal, running_offset
from scriptorium.session import checkpoint_folder

_SPANS = "array<struct<first:int,last:int,trigger:int>>"
_PIECES = "array<struct<place:int,piece:int,text:string>>"
_END = 2147483647


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: cut at empty lines, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda paragraph: paragraph != "")


def _span(first: Column, last: Column, trigger: Column) -> Column:
    return F.struct(
        first.cast("int").alias("first"), last.cast("int").alias("last"), trigger.cast("int").alias("trigger")
    )


def _open_state() -> Column:
    return F.struct(
        F.array().cast(_SPANS).alias("spans"), F.lit(1).alias("first"), F.lit(0).alias("filled")
    )


def _state(spans: Column, first: Column, filled: Column) -> Column:
    return F.struct(spans.alias("spans"), first.cast("int").alias("first"), filled.cast("int").alias("filled"))


def _text_of(items: Column, span: Column, separator: str) -> Column:
    return F.array_join(F.slice(items, span["first"], span["last"] - span["first"] + 1), separator)


def pack_words(paragraph: Column, chunk_size: int = CHUNK_SIZE) -> Column:
    """Greedy packing of the words of a long paragraph.

    Only word lengths go through the fold, which yields index spans; the text of each span is built once.
    A first word that cannot fit closes an empty span.
    """

    def fold(items: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            size = F.length(F.element_at(items, i))
            fits = state["filled"] + size + 1 <= chunk_size
            return F.when(fits, _state(state["spans"], state["first"], state["filled"] + size + 1)).otherwise(
                _state(F.array_append(state["spans"], _span(state["first"], i - 1, i)), i, size)
            )

        def finish(state: Column) -> Column:
            return F.array_append(state["spans"], _span(state["first"], F.size(items), F.size(items)))

        spans = F.aggregate(positions(1, F.size(items)), _open_state(), step, finish)
        return F.transform(spans, lambda span: _text_of(items, span, " "))

    return let(words(paragraph), fold)


def _pack_short(short: Column, chunk_size: int, carry: bool) -> Column:
    """Spans over the short paragraphs; ``trigger`` is the paragraph whose arrival closed the span."""

    def step(state: Column, i: Column) -> Column:
        size = F.length(F.element_at(short, i)["text"])
        overflow = state["filled"] + size > chunk_size
        closed = F.array_append(state["spans"], _span(state["first"], i - 1, i))
        carried = F.length(F.element_at(short, F.greatest(i - 1, F.lit(1)))["text"])
        reopened = _state(closed, i - 1, carried + size) if carry else _state(closed, i, size)
        return F.when(overflow, reopened).otherwise(
            _state(state["spans"], state["first"], state["filled"] + size)
        )

    def finish(state: Column) -> Column:
        count = F.size(short)
        return F.when(count > 0, F.array_append(state["spans"], _span(state["first"], count, F.lit(_END)))).otherwise(
            state["spans"]
        )

    return F.aggregate(positions(1, F.size(short)), _open_state(), step, finish)


def paragraph_chunks(text: Column, chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of about ``chunk_size`` characters along paragraph borders: ``ARRAY<STRING>``.

    Long paragraphs never touch the group of pending short ones, so both are packed independently and
    their chunks are merged by the place at which each was completed. A pending group therefore follows
    the long paragraphs it was waiting through. ``overlap`` above 0 repeats the last paragraph of a chunk
    at the start of the next one.
    """

    def build(numbered: Column) -> Column:
        long_ones = F.filter(numbered, lambda item: F.length(item["text"]) > chunk_size)
        short_ones = F.filter(numbered, lambda item: F.length(item["text"]) <= chunk_size)
        long_pieces = F.flatten(
            F.transform(
                long_ones,
                lambda item: F.transform(
                    pack_words(item["text"], chunk_size),
                    lambda piece, k: F.struct(
                        item["place"].alias("place"), k.alias("piece"), piece.alias("text")
                    ),
                ),
            )
        ).cast(_PIECES)

        def short_pieces(short: Column) -> Column:
            texts = F.transform(short, lambda item: item["text"])
            return let(
                texts,
                lambda bodies: F.transform(
                    _pack_short(short, chunk_size, overlap > 0),
                    lambda span: F.struct(
                        F.when(span["trigger"] == _END, F.lit(_END))
                        .otherwise(F.element_at(short, F.least(span["trigger"], F.size(short)))["place"])
                        .alias("place"),
                        F.lit(0).alias("piece"),
                        _text_of(bodies, span, "\n\n").alias("text"),
                    ),
                ),
            ).cast(_PIECES)

        merged = F.sort_array(F.concat(long_pieces, let(short_ones, short_pieces)))
        return F.transform(merged, lambda piece: piece["text"])

    numbered = F.transform(
        paragraphs(text), lambda paragraph, i: F.struct(i.alias("place"), paragraph.alias("text"))
    )
    return let(numbered, build)


def line_spans(texts: Column, chunks: Column) -> Column:
    """Of each chunk the first and last line of its first occurrence, counted from 1; ``(0, 0)`` without one.

    All chunks of a text are searched at once, in time linear in the text.
    """

    @F.pandas_udf("array<struct<start_line:int,end_line:int>>")
    def locate(texts: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else first_lines(t or "", list(c)) for t, c in zip(texts, chunks, strict=True)], dtype=object)

    return locate(texts, chunks)


def line_span(text: Column, chunk: Column) -> Column:
    """First and last line of the first occurrence of one chunk."""
    return F.get(line_spans(text, F.array(chunk)), F.lit(0))


def chunk_rows(
    documents: DataFrame,
    key: str = "path",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    keep: bool = False,
) -> DataFrame:
    """One row per chunk, with ``keep`` also the document's other columns: ``(key, chunk_index, total_chunks, chunk, start_line, end_line)``.

    Row-local: the positions are found before the explode, so a text is never copied per chunk.
    """
    others = [name for name in documents.columns if name not in (key, "text")] if keep else []
    cut = documents.select(key, *others, "text", paragraph_chunks(F.col("text"), chunk_size, overlap).alias("_chunks"))
    located = cut.select(key, *others, "_chunks", line_spans(F.col("text"), F.col("_chunks")).alias("_lines"))
    zipped = F.arrays_zip(F.col("_chunks").alias("chunk"), F.col("_lines").alias("lines"))
    exploded = located.select(key, *others, F.size("_chunks").alias("total_chunks"), F.posexplode(zipped).alias("chunk_index", "_item"))
    return exploded.select(
        key,
        *others,
        "chunk_index",
        "total_chunks",
        F.col("_item.chunk").alias("chunk"),
        F.col("_item.lines.start_line").alias("start_line"),
        F.col("_item.lines.end_line").alias("end_line"),
    )


def chunk_index_table(
    documents: DataFrame,
    key: str = "path",
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """The index: chunks with id, path, file name, positions and totals.

    The document number is the rank of its path. It is computed on the paths alone and joined to the
    documents before they are cut, so that chunks, which overlap, are never shuffled.
    """
    numbers = dense_ordinal(documents, key)
    numbered = documents.select(key, "text").join(numbers, key)
    chunks = chunk_rows(numbered, key, chunk_size, overlap, keep=True)
    return chunks.select(
        F.concat(F.lit("doc_"), F.col("ordinal"), F.lit("_chunk_"), F.col("chunk_index")).alias("id"),
        F.col(key).alias("path"),
        basename(F.col(key).cast("string")).alias("filename"),
        "chunk_index",
        "total_chunks",
        "start_line",
        "end_line",
        "chunk",
    )


def numbered_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Chunk rows with ``position``: their running number over the whole corpus, in document and chunk order.

    The texts are cut once: the chunks are written, and only their numbers per document are ranked.
    """
    checkpoint_folder(chunks.sparkSession)
    written = chunks.checkpoint()
    counts = written.groupBy(key).agg(F.count("*").alias("_count"))
    offsets = running_offset(counts, key, "_count", "_offset").select(key, "_offset")
    return written.join(offsets, key).withColumn("position", F.col("_offset") + F.col("chunk_index")).drop("_offset")


def global_positions(documents: DataFrame, key: str = "path") -> DataFrame:
    """Chunks with their running number over the whole corpus."""
    cut = documents.select(key, F.posexplode(paragraph_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return numbered_chunks(cut, key).select("position", key, "chunk_index", "chunk")


def attach_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Give each chunk the source listed at its own position, and a numbered fallback beyond the list.

    ``chunks`` has ``position``; ``sources`` has ``position`` and ``source``.
    """
    return chunks.join(sources.select("position", "source"), "position", "left").select(
        F.col("position").cast("string").alias("chunk_id"),
        F.coalesce("source", F.concat(F.lit(SOURCE_FALLBACK), F.col("position"))).alias("source"),
        *[name for name in chunks.columns if name != "position"],
    )


#: From the coarsest to the finest; what none of them makes fit is cut by characters.
SEPARATORS = ("\n\n", "\n", " ")


def _window(spans: Column, first: Column, lengths: Column, filled: Column) -> Column:
    return F.struct(spans.alias("spans"), first.cast("int").alias("first"), lengths.alias("lengths"), filled.cast("int").alias("filled"))


def _refined(text: Column, separator: str, size: int, overlap: int) -> Column:
    """Pieces of one span, cut at the separator: ``ARRAY<STRUCT<text, done>>``.

    A piece keeps the separator in front of it. Pieces shorter than ``size`` are packed, and a result starts with the tail of the one before; a
    longer piece is left for the next separator. The fold carries lengths and yields spans of pieces; texts are built once.
    """
    none = F.array().cast("array<int>")

    def fold(parts: Column) -> Column:
        def closed(state: Column, i: Column) -> Column:
            """The spans with the open window, which ends before piece ``i``."""
            span = F.struct(state["first"].alias("first"), (i - 1).alias("last"), F.lit(False).alias("whole"))
            return F.when(F.size(state["lengths"]) > 0, F.array_append(state["spans"], span)).otherwise(state["spans"])

        def overflow(state: Column, i: Column, length: Column) -> Column:
            """The window without the pieces that must go for the next one to fit behind a tail of ``overlap``."""
            start = F.struct(F.lit(0).alias("gone"), state["filled"].alias("filled"))
            drop = F.aggregate(
                state["lengths"],
                start,
                lambda s, n: F.when(
                    (s["filled"] > overlap) | (s["filled"] + length > size),
                    F.struct((s["gone"] + 1).alias("gone"), (s["filled"] - n).alias("filled")),
                ).otherwise(s),
            )
            return let(
                drop,
                lambda d: _window(
                    closed(state, i),
                    state["first"] + d["gone"],
                    F.array_append(F.slice(state["lengths"], d["gone"] + 1, F.size(state["lengths"])), length),
                    d["filled"] + length,
                ),
            )

        def step(state: Column, i: Column) -> Column:
            def with_length(length: Column) -> Column:
                span = F.struct(i.alias("first"), i.alias("last"), F.lit(True).alias("whole"))
                return (
                    F.when(length == 0, _window(state["spans"], i + 1, none, F.lit(0)))
                    .when(length >= size, _window(F.array_append(closed(state, i), span), i + 1, none, F.lit(0)))
                    .when((F.size(state["lengths"]) > 0) & (state["filled"] + length > size), overflow(state, i, length))
                    .otherwise(_window(state["spans"], state["first"], F.array_append(state["lengths"], length), state["filled"] + length))
                )

            return let(F.length(F.element_at(parts, i)) + F.when(i > 1, len(separator)).otherwise(0), with_length)

        start = _window(F.array().cast("array<struct<first:int,last:int,whole:boolean>>"), F.lit(1), none, F.lit(0))
        spans = F.aggregate(positions(1, F.size(parts)), start, step, lambda state: closed(state, F.size(parts) + 1))

        def piece(span: Column) -> Column:
            packed = strip(F.array_join(F.slice(parts, span["first"], span["last"] - span["first"] + 1), separator))
            long = F.concat(F.when(span["first"] > 1, separator).otherwise(""), F.element_at(parts, span["first"]))
            return F.struct(F.when(span["whole"], long).otherwise(packed).alias("text"), (~span["whole"]).alias("done"))

        return F.transform(spans, piece)

    return let(F.split(text, separator), fold)


def _by_characters(text: Column, size: int, overlap: int) -> Column:
    """Overlapping runs of ``size`` characters; the text is cut once, at the places where runs begin."""
    step = size - overlap
    each = -(-size // step)

    def runs(parts: Column) -> Column:
        count = F.when(F.length(text) > size, 1 + F.ceil((F.length(text) - size) / step)).otherwise(1).cast("int")
        return F.transform(F.sequence(F.lit(1), count), lambda i: strip(F.left(F.array_join(F.slice(parts, i, F.lit(each)), ""), F.lit(size))))

    found = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), runs)
    return F.transform(found, lambda run: F.struct(run.alias("text"), F.lit(True).alias("done")))


def recursive_chunks(text: Column, chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of at most ``chunk_size`` characters, cut at the coarsest separator that makes them fit: ``ARRAY<STRING>``.

    A text is a list of spans that each separator refines in turn: spans that fit are done, the others are cut again in their place. ``overlap`` must
    be smaller than ``chunk_size``. Empty and null texts have no chunks.
    """

    def refine(spans: Column, cut: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(spans, lambda span: F.when(span["done"], F.array(span)).otherwise(cut(span["text"]))))

    spans = F.array(F.struct(text.alias("text"), F.lit(False).alias("done")))
    for separator in SEPARATORS:
        spans = refine(spans, lambda piece, separator=separator: _refined(piece, separator, chunk_size, overlap))
    spans = refine(spans, lambda piece: _by_characters(piece, chunk_size, overlap))
    texts = F.filter(F.transform(spans, lambda span: span["text"]), lambda chunk: chunk != "")
    return F.when(F.coalesce(text, F.lit("")) != "", texts).otherwise(F.array().cast("array<string>"))


def recursive_rows(documents: DataFrame, key: str = "path", chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(key, chunk_index, chunk)`` by recursive splitting, with the documents' other columns but the text."""
    others = [name for name in documents.columns if name != "text"]
    return documents.select(*others, F.posexplode(recursive_chunks(F.col("text"), chunk_size, overlap)).alias("chunk_index", "chunk"))
