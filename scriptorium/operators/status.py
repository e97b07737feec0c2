"""Failure isolation: a bad item is reported, the others go on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.constants import FOLDER_EMPTY, FOLDER_MISSING


def isolated(convert: Callable[[str], str]):
    """A vectorised function from a Python converter; an exception becomes the ``error`` of its own row."""

    def attempt(item: str) -> tuple[str | None, str | None]:
        try:
            return convert(item), None
        except Exception as problem:  # noqa: BLE001 - any failure of one item is that item's result
            return None, f"{type(problem).__name__}: {problem}"

    @F.pandas_udf("value string, error string")
    def run(items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([attempt(item) for item in items], columns=["value", "error"])

    return run


def ingest_status(items: DataFrame, name: Column, value: Column, error: Column) -> DataFrame:
    """``(name, status, line)``: one result line per item; an item with an ``error`` is rejected."""
    done = F.concat(F.lit("Successfully converted '"), name, F.lit("' to: "), value.cast("string"))
    failed = F.concat(F.lit("Error converting '"), name, F.lit("': "), error)
    return items.select(
        name.alias("name"),
        F.when(error.isNull(), "ok").otherwise("rejected").alias("status"),
        F.when(error.isNull(), done).otherwise(failed).alias("line"),
    )


def folder_lines(lines: DataFrame, folder: str, exists: bool) -> DataFrame:
    """``(name, line)``: the result lines of a folder; one line without a name where the folder is missing or holds nothing to convert."""
    spark = lines.sparkSession
    text = (FOLDER_EMPTY if exists else FOLDER_MISSING).format(folder)
    alone = spark.range(1).select(F.lit(None).cast("string").alias("name"), F.lit(text).alias("line"), F.lit(1).alias("_one"))
    # The line stays only where there is no other.
    other = lines.limit(1).select(F.lit(1).alias("_one"))
    return lines.select("name", "line").unionByName(alone.join(other, "_one", "left_anti").select("name", "line"))


def split_by_status(items: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """The accepted and the rejected rows."""
    return items.filter(error.isNull()), items.filter(error.isNotNull())
