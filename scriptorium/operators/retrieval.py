"""Embedding, exact nearest-neighbour search over a batch of questions, and search reports.

The search is a join of blocks. Some vectors of the corpus are pivots; every vector belongs to the cell of its nearest pivot, and a cell
is known by its pivot and its radius. Cells are cut into blocks of bounded size, one row each, and questions are packed into
block rows in the same way. In a first round each question meets the nearest cells that hold ``k`` vectors; the distance of its
``k``-th best bounds what is left, and in a second round it meets only the cells that can hold something nearer by the triangle
inequality. Questions and corpus are rows throughout; only pivots and the cells' sizes, whose number is a parameter, are known to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.constants import DISTANCE_CUTOFF, TOP_K
from scriptorium.functions.vectors import hash_vector
from scriptorium.session import broadcast_if_small, checkpoint_folder, written

Embedder = Callable[[Column], Column]

#: Cells of the corpus. Any number gives the same result.
PIVOTS = 64
#: Vectors of a block; blocks of a cell that share a join key.
BLOCK_ROWS = 512
BLOCKS_PER_KEY = 64
# Results that are broadcast to the chunks they name; more are joined by a shuffle.
BROADCAST_RESULTS = 500_000
DECIMALS = 6
#: Distances are compared when rounded, so a bound must be beaten by more than a rounding.
MARGIN = 2 * 10.0**-DECIMALS
#: The cell of the zero vectors under the cosine, at distance 1 of everything.
NOWHERE = -1


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embedder:
    """An embedder from a Python model: ``load`` runs once per task, the model once per Arrow batch."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(encode(texts.tolist()), dtype=np.float32)), index=texts.index)

    return embed


def embed_texts(rows: DataFrame, text: str, embedder: Embedder = hash_vector) -> DataFrame:
    """Add ``embedding``; chunks and questions use the same function."""
    return rows.withColumn("embedding", embedder(F.col(text)))


def usable_vector(embedding: Column, width: int) -> Column:
    """Whether a vector is there, has ``width`` numbers, and none of them is null."""
    return F.coalesce((F.size(embedding) == width) & ~F.exists(embedding, lambda x: x.isNull()), F.lit(False))


def rejected_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """The rows that a search over vectors of ``width`` numbers leaves out, with a ``reason``."""
    reason = F.when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != width, "wrong width").otherwise("null in vector")
    return vectors.filter(~usable_vector(F.col("embedding"), width)).withColumn("reason", reason)


def usual_width(vectors: DataFrame) -> int:
    """The most frequent width of the vectors without nulls; of equally frequent ones the smallest. 1 if there are none."""
    whole = vectors.filter(F.coalesce(~F.exists("embedding", lambda x: x.isNull()), F.lit(False)) & (F.size("embedding") > 0))
    first = whole.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return first["width"] if first else 1


def _matrix(lists: pa.Array, width: int, metric: str) -> np.ndarray:
    """The vectors as rows; scaled to unit length for the cosine, zero vectors left."""
    matrix = lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, width)
    if metric == "cosine":
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    return matrix


def _distances(questions: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        found = 1.0 - questions @ vectors.T
    else:
        found = np.stack([((vectors - question) ** 2).sum(axis=1) for question in questions])
    return np.round(found, DECIMALS) + 0.0


def _to_pivots(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances to the pivots; rounding is within ``MARGIN`` of their size."""
    squares = (matrix**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * matrix @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _in_cells(vectors: DataFrame, pivots: np.ndarray, width: int, metric: str) -> DataFrame:
    """``(cell, id, vector, reach)``: the nearest pivot of every vector and its distance."""

    def assign(batches):
        for batch in batches:
            # Filtered here and not by an expression, above which an embedding function would run a second time.
            batch = batch.filter(_usable(batch.column("vector"), width))
            if not batch.num_rows:
                continue
            lists = batch.column("vector")
            matrix = _matrix(lists, width, metric)
            away = _to_pivots(matrix, pivots)
            cell = away.argmin(axis=1)
            reach = away[np.arange(len(cell)), cell]
            if metric == "cosine":
                cell[~matrix.any(axis=1)] = NOWHERE
            arrays = [pa.array(cell, pa.int32()), batch.column("id"), lists, pa.array(reach)]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "id", "vector", "reach"])

    return vectors.mapInArrow(assign, f"cell int, id {_kind(vectors, 'id')}, vector array<double>, reach double")


def _usable(lists: pa.Array, width: int) -> pa.Array:
    """``usable_vector`` on an array of vectors."""
    holes = np.zeros(len(lists), bool)
    parents = pc.list_parent_indices(lists).to_numpy()
    holes[parents[pc.is_null(lists.flatten()).to_numpy(zero_copy_only=False)]] = True
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    return pa.array((sizes == width) & ~holes)


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _blocks(rows: DataFrame, block: Column, *keys: str) -> DataFrame:
    """Rows ``(keys, id, vector, ...)`` packed into one row per block."""
    others = [name for name in rows.columns if name not in keys]
    packed = rows.withColumn("_block", block).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*others)).alias("rows"))
    return packed.select(*keys, *[F.col(f"rows.{name}").alias(name) for name in others])


def _least(away: np.ndarray, matrix: np.ndarray, pivots: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """Of each question and cell, a distance that no vector of the cell is below; ``away`` are the distances of the pivots."""
    # The pivot distances may be off by rounding, in proportion to what was subtracted.
    slack = 1e-6 * (1 + np.linalg.norm(matrix, axis=1, keepdims=True) + np.linalg.norm(pivots, axis=1)[None, :])
    gap = np.maximum(away - radius[None, :] - slack, 0)
    return gap**2 / 2 if metric == "cosine" else gap**2


def _visits(asked: DataFrame, cells: dict[int, tuple[int, float]], pivots: np.ndarray, width: int, metric: str, k: int, later: bool, probes: int = 0) -> DataFrame:
    """``(cell, sub, query_id, vector, bound)``: the cells that each question goes to.

    First the nearest ones that hold ``k`` vectors, ``probes`` at least; ``later``, all others that can hold something within ``bound``. A cell of many
    blocks has several join keys (``sub``).
    """
    known = sorted(c for c in cells if c != NOWHERE)
    count = np.array([cells[c][0] for c in known], "i8")
    radius = np.array([cells[c][1] for c in known])
    names = np.array([*known, *([NOWHERE] if NOWHERE in cells else [])])
    keys = {c: -(-cells[c][0] // (BLOCK_ROWS * BLOCKS_PER_KEY)) for c in names.tolist()}

    def go(batches):
        for batch in batches:
            matrix = _matrix(batch.column("vector"), width, metric)
            away = _to_pivots(matrix, pivots[known])
            least = _least(away, matrix, pivots[known], radius, metric)
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            first = np.zeros(least.shape, bool)
            np.put_along_axis(first, order, (before < k) | (np.arange(len(known)) < probes), axis=1)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            chosen = (~first & (least <= bound[:, None] + MARGIN)) if later else first
            if NOWHERE in cells:
                # Zero vectors are at distance 1 of every question: the last cell of all.
                zero = (bound >= 1 - MARGIN) if later else np.zeros(len(matrix), bool)
                chosen = np.c_[chosen, zero]
            question, cell = np.nonzero(chosen)
            subs = np.array([keys[c] for c in names[cell].tolist()], "i8")
            question, cell = np.repeat(question, subs), np.repeat(names[cell], subs)
            sub = np.arange(len(question)) - np.repeat(np.cumsum(subs) - subs, subs)
            place = pa.array(question, pa.int64())
            arrays = [pa.array(cell, pa.int32()), pa.array(sub, pa.int32()), *[batch.column(c).take(place) for c in ("query_id", "vector", "bound")]]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "sub", "query_id", "vector", "bound"])

    return asked.mapInArrow(go, f"cell int, sub int, query_id {_kind(asked, 'query_id')}, vector array<double>, bound double")


def _met(visits: DataFrame, corpus_blocks: DataFrame, spread: int, width: int, metric: str, k: int) -> DataFrame:
    """``(query_id, id, distance)``: of each pair of blocks the ``k`` nearest of every question that are within its bound.

    ``spread`` is the number of blocks of all questions; a key holds as many or fewer.
    """
    asked = _blocks(visits, F.pmod(F.xxhash64("query_id"), F.lit(spread)), "cell", "sub")
    pairs = corpus_blocks.join(asked.withColumnRenamed("vector", "asked"), ["cell", "sub"]).select("id", "vector", "query_id", "asked", "bound")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, names = (batch.column(c).slice(i, 1).flatten() for c in ("id", "query_id"))
                bound = batch.column("bound").slice(i, 1).flatten().to_numpy()
                vectors, questions = (_matrix(batch.column(c).slice(i, 1).flatten(), width, metric) for c in ("vector", "asked"))
                order = np.empty(len(ids), "i8")
                order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
                distances = _distances(questions, vectors, metric)
                rows, places = [], []
                for row, one in enumerate(distances):
                    near = np.flatnonzero(one <= min(bound[row] + MARGIN, np.partition(one, k - 1)[k - 1] if len(one) > k else np.inf))
                    near = near[np.lexsort((order[near], one[near]))[:k]]
                    rows.append(np.full(len(near), row))
                    places.append(near)
                row, place = np.concatenate(rows), np.concatenate(places)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), ids.take(pa.array(place)), pa.array(distances[row, place])], ["query_id", "id", "distance"])

    kinds = f"query_id {visits.schema['query_id'].dataType.simpleString()}, id {corpus_blocks.schema['id'].dataType.elementType.simpleString()}, distance double"
    return pairs.mapInArrow(search, kinds)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_distance = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest(
    vectors: DataFrame,
    questions: DataFrame,
    k: int = TOP_K,
    metric: str = "cosine",
    id_column: str = "id",
    width: int | None = None,
    pivots: int = PIVOTS,
    probes: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest vectors of every question: ``(query_id, rank, id, distance)``.

    ``vectors`` has ``id_column`` and ``embedding``, ``questions`` has ``query_id`` and ``embedding``; ids are unique on both sides.
    Vectors of another width than ``width``, and those with nulls, are left out on both sides
    (``rejected_vectors`` names them). By default it is the most frequent width of ``vectors``. ``metric`` is ``cosine`` or ``l2`` (squared). Distances are
    rounded to 6 decimals, ties go by id. Under the cosine a zero vector is at distance 1 of everything.

    With ``probes`` the search is approximate: a question meets that many nearest cells (more, if they hold fewer than ``k`` vectors) and no others, so its
    cost is bounded whatever the data. The tests measure the recall.
    """
    checkpoint_folder(vectors.sparkSession)
    width = usual_width(vectors) if width is None else width
    corpus = vectors.select(F.col(id_column).alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = questions.select("query_id", F.col("embedding").cast("array<double>").alias("vector")).checkpoint()
    asked = asked.filter(usable_vector(F.col("vector"), width)).withColumn("bound", F.lit(float("inf")))
    empty = asked.select("query_id", F.lit(0).alias("rank")).join(corpus.select("id").limit(0), F.lit(False)).select("query_id", "rank", "id", F.lit(0.0).alias("distance"))
    # A bounded number of vectors in one row; any will do.
    sample = corpus.filter(usable_vector(F.col("vector"), width)).limit(pivots).agg(F.collect_list("vector").alias("vectors")).first()["vectors"]
    if not sample:
        return empty
    points = _matrix(pa.array(sample), width, metric)
    in_cells = written(_in_cells(corpus, points, width, metric))
    found = None
    if metric == "cosine":
        # Everything is at distance 1 of a zero question, so the smallest ids are its nearest.
        nothing = ~F.exists("vector", lambda x: x != 0)
        smallest = in_cells.select("id").orderBy("id").limit(k).agg(F.sort_array(F.collect_list("id"))).scalar()
        found = asked.filter(nothing).select("query_id", F.explode(smallest).alias("id"), F.lit(1.0).alias("distance"))
        asked = asked.filter(~nothing)
    sizes = in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach"))
    # One entry a pivot.
    cells = {row["cell"]: (row["n"], row["reach"]) for row in sizes.agg(F.collect_list(F.struct("cell", "n", "reach")).alias("cells")).first()["cells"]}
    counts = F.create_map(*[F.lit(x) for c, (n, _) in cells.items() for x in (c, -(-n // BLOCK_ROWS))])
    block = F.pmod(F.xxhash64("id"), counts[F.col("cell")])
    numbered = in_cells.select("cell", F.floor(block / BLOCKS_PER_KEY).cast("int").alias("sub"), "id", "vector")
    blocks = written(_blocks(numbered, block, "cell", "sub"))
    spread = -(-asked.count() // BLOCK_ROWS) or 1
    first = _ranked(_met(_visits(asked, cells, points, width, metric, k, False, probes or 0), blocks, spread, width, metric, k), k)
    if probes is not None:
        return first if found is None else _ranked(first.drop("rank").unionByName(found), k)
    first = first.checkpoint()
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(float("inf")).alias("bound"))
    left = asked.drop("bound").join(bounds, "query_id", "left").fillna(float("inf"), "bound")
    second = _met(_visits(left, cells, points, width, metric, k, True), blocks, spread, width, metric, k)
    both = first.select("query_id", "id", "distance").unionByName(second)
    return _ranked(both if found is None else both.unionByName(found), k)


def within_cutoff(results: DataFrame, cutoff: float = DISTANCE_CUTOFF) -> DataFrame:
    """Results nearer than the cut-off; ranks stay those of the full list."""
    return results.filter(F.col("distance") < cutoff)


def with_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """The results with the columns of the chunks they name.

    Results are few and chunks are many: the search runs once and its rows go to the chunks, so that the
    index is read in place and not shuffled.
    """
    checkpoint_folder(results.sparkSession)
    return chunks.join(broadcast_if_small(results.checkpoint(), BROADCAST_RESULTS), "id")


def search_report(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Display rows of the results: number, file, lines, place of the chunk, relevance, text."""
    # Distances have 6 decimals, so the share is a whole number of millionths and rounds exactly.
    millionths = F.round((1 - F.col("distance")) * 1_000_000)
    return with_chunks(results, chunks).select(
        "query_id",
        F.col("rank").alias("result_no"),
        "filename",
        "path",
        F.concat(F.col("start_line"), F.lit(" - "), F.col("end_line")).alias("lines"),
        F.concat(F.col("chunk_index") + 1, F.lit(" de "), F.col("total_chunks")).alias("chunk_of"),
        F.format_string("%.2f%%", F.round(millionths / 100) / 100).alias("relevance"),
        "chunk",
    )
