"""What the operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scriptorium.session import checkpoint_folder

#: Rows of an Arrow batch; a row can be a whole document, so a batch is bounded in bytes too.
ARROW_ROWS = 2000
ARROW_BYTES = "32m"

#: ASCII white space, which ends a word everywhere in this package.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings under which Python tasks hold bounded batches and find this package where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, written once to the session's shared checkpoint folder."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


#: Arguments longer than this are not remembered.
LONG = 256


class Memo(dict):
    """Results of a function by its argument, in two generations of at most ``limit`` entries each; long arguments are computed anew."""

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
            if len(key) > LONG:
                return value
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


def text_list(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """A text column as a list; null is the empty text."""
    return [text or "" for text in column.to_pylist()]


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that treats each batch by itself."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if made is not None and made.num_rows:
                    yield made

    return run


def resource(path: str | None, name: str) -> str:
    """A tokenizer file: the given path, or the file of that name in the installed package of public tokenizers."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
