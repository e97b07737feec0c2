"""A quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel. They are rounded to a fixed grid, so that the sums of the normal equations
are whole numbers and do not depend on how rows are spread over tasks. Each task sums its rows; the sums
of the tasks are added row of the matrix by row. Scores of rows that took no part in the fit are binned, and
a monotone curve through the bins (pool adjacent violators) turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed, per_batch, text_list

FEATURES = 192
RIDGE = 1e-4
SEED = 20_241
#: Feature values are multiples of 1 / GRID.
GRID = 1024
#: One labelled row in so many calibrates; the others fit.
CALIBRATE = 4
#: Raw scores from -0.5 to 1.5 fall into so many bins.
BINS = 2000
#: Share of the raw score in the result, which keeps rows of one calibrated level apart.
TIE = 0.001
THRESHOLD = 0.7

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bars", "exclamations", "stops", "other_marks", "non_ascii",
    "lines", "repeated_lines", "repeated_next", "distinct", "entropy", "short_words",
)


def _class_table() -> np.ndarray:
    """Of each byte, which counts it goes into."""
    table = np.zeros((256, 9))
    table[ord("A") : ord("Z") + 1, 0] = 1
    table[ord("0") : ord("9") + 1, 1] = 1
    for place, chars in ((2, b"#*$%&<>"), (3, b"|"), (4, b"!"), (5, b".,;:?"), (8, b" \t\n\x0b\x0c\r")):
        table[list(chars), place] = 1
    table[128:, 7] = 1
    known = table.sum(axis=1) > 0
    letters = np.zeros(256, bool)
    letters[ord("a") : ord("z") + 1] = True
    table[~known & ~letters, 6] = 1
    return table


_CLASSES = _class_table()


def statistics_of(text: str) -> list[float]:
    """The statistics of a whole text; all zero for one without words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    upper, digit, symbol, bar, mark, stop, other, wide, space = counts @ _CLASSES
    n, size = len(words), float(len(data) - space)
    lines = [line for line in data.split(b"\n") if line.strip()]
    share = counts[counts > 0] / len(data)
    return [
        np.log(n), size / n, upper / size, digit / size, symbol / n, bar / n, mark / n, stop / n, other / n, wide / size,
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(map(eq, words, words[1:])) / n,
        np.log(1 + len(set(words))) / np.log(1 + n), float(-(share * np.log(share)).sum()), sum(len(w) < 4 for w in words) / n,
    ]


def statistics(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, stats array<double>)`` of every whole text; a null text is empty. One row per row of ``docs``."""

    def work(batch):
        made = [statistics_of(t) for t in text_list(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["key", "stats"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(per_batch(work), f"key {kind}, stats array<double>").withColumnRenamed("key", key)


@dataclass
class Model:
    """Scores statistics; a model without ``weights`` gives every row ``level``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray
    levels: np.ndarray
    level: float = 0.5

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant, as whole multiples of the grid."""
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        random = np.random.default_rng(SEED)
        # Half of the features have a wide kernel, half a narrow one.
        width = np.repeat([0.15, 0.5], [FEATURES // 2, FEATURES - FEATURES // 2])
        directions = random.standard_normal((x.shape[1], FEATURES)) * width
        z = np.cos(x @ directions + random.uniform(0, 2 * np.pi, FEATURES))
        return np.rint(np.c_[z, np.ones(len(z))] * GRID)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.level)
        raw = self.raw(stats)
        return (1 - TIE) * np.interp(raw, self.steps, self.levels) + TIE * np.clip((raw + 0.5) / 2, 0, 1)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and levels of the blocks, with ``good`` of ``n`` rows at each ``x`` in order."""
    blocks: list[list[float]] = []
    for place, g, m in zip(x, good, n, strict=True):
        blocks.append([place * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    made = np.array(blocks)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


def fit(labelled: DataFrame, stats: str = "stats", label: str = "label") -> Model:
    """A model from rows of statistics and labels 0 or 1 (means between them are allowed). ``labelled`` is read three times.

    What reaches the driver is bounded by the number of statistics, features and bins. Rows without a label
    are left out; with no rows to fit, or rows of one class only, every score is the mean label, or one half.
    """
    rows = labelled.select(F.col(stats).alias("stats"), F.col(label).cast("double").alias("label")).filter("stats IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64("stats"), F.lit(CALIBRATE)) == 0)
    one = [f(F.get("stats", F.lit(i))) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    summary = rows.agg(F.count("*"), F.avg("label"), *one).first()
    moments = np.array([0.0 if v is None else float(f"{v:.9g}") for v in summary[2:]])
    scale = np.where(moments[1::2] > 1e-9, moments[1::2], 1.0)
    model = Model(moments[::2], scale, None, np.zeros(0), np.zeros(0), 0.5 if summary[1] is None else summary[1])
    if not 0 < model.level < 1:
        return model

    size = FEATURES + 2

    def sums(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = np.c_[model.features(np.array(batch.column(0).to_pylist())), np.rint(batch.column(1).to_numpy() * GRID)]
                total += x.T @ x  # whole numbers below 2 ** 53, so exact
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([row.tobytes() for row in total.astype("<i8")], pa.binary())], ["i", "row"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(row, "<i8") for row in group.column("row").to_pylist())
        return pa.table({"i": group.column("i")[:1], "row": pa.array([total.tobytes()], pa.binary())})

    schema = "i int, row binary"
    added = rows.filter(~F.col("calibrates")).select("stats", "label").mapInArrow(sums, schema).groupBy("i").applyInArrow(add, schema)
    found = sorted(added.collect(), key=lambda r: r["i"])
    if not found:
        return model
    moment = np.stack([np.frombuffer(row["row"], "<i8") for row in found]).astype("float64") / GRID**2
    gram, right = moment[:-1, :-1], moment[:-1, -1]
    count = max(gram[-1, -1], 1.0)
    model.weights = np.linalg.solve(gram / count + RIDGE * np.eye(size - 1), right / count) / GRID

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column(0).to_pylist()))
                place = np.clip(np.rint((raw + 0.5) / 2 * BINS), 0, BINS).astype("i4")
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], ["bin", "label"])

    bins = rows.filter("calibrates").select("stats", "label").mapInArrow(binned, "bin int, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).collect()
    table = np.array(sorted([tuple(map(float, row)) for row in bins])) if bins else np.array([[0.0, 0.0, 1.0], [BINS, 1.0, 1.0]])
    model.steps, model.levels = isotonic(table[:, 0] / BINS * 2 - 0.5, table[:, 1], table[:, 2])
    return model


def labelled_statistics(stats: DataFrame, labels: DataFrame, key: str, label: str, keep: Column) -> DataFrame:
    """Statistics with the mean label of their key, where ``keep`` (over the key) holds."""
    means = labels.select(F.col(key), F.col(label).cast("double").alias("label")).filter(keep).groupBy(key).agg(F.avg("label").alias("label"))
    return stats.join(means.filter("label IS NOT NULL"), key).select("stats", "label")


def score_statistics(stats: DataFrame, model: Model, key: str) -> DataFrame:
    """``(key, score)`` of every row of statistics."""

    def work(batch):
        scores = model.score(np.array(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "score"])

    kind = stats.schema[key].dataType.simpleString()
    return stats.select(F.col(key).alias("key"), "stats").mapInArrow(per_batch(work), f"key {kind}, score double").withColumnRenamed("key", key)


def score_column(text: Column, model: Model) -> Column:
    """The score of a text column; a null text is empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics_of(t or "") for t in texts])) if len(texts) else [], dtype="float64")

    return score(text)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: the checksum of its key."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "quality") -> DataFrame:
    """``(key, held_out, score, predicted)`` of every row of ``docs``.

    Learns from the labels of keys that are not held out; only statistics of the whole text go into a score. Null and empty
    texts have statistics of zero; rows with a null key are scored, not learnt from; repeated rows stay; no
    rows give no rows. Other columns are not read. Texts are read once and never shuffled.
    """
    stats = checkpointed(statistics(docs, key, text))
    model = fit(checkpointed(labelled_statistics(stats, labels, key, label, ~held_out(F.col(key)))))
    return score_statistics(stats, model, key).select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, key: str, text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns. Texts are read twice and never shuffled."""
    stats = statistics(docs, key, text)
    model = fit(checkpointed(labelled_statistics(stats, labels, key, label, ~held_out(F.col(key)))))
    return docs.filter(score_column(F.col(text), model) >= THRESHOLD)
