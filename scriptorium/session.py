"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_SETTINGS = {
    # AQE splits the partitions of hot join keys; forced, so that it also splits them when a later
    # aggregation could have reused the join's partitioning.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Small results are cut by hand-sized tasks too: what follows a shuffle here is often heavy per row.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows can be whole documents, so Arrow batches are bounded in bytes as well as in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.session.timeZone": "UTC",
    # Rows can be whole lists, and Parquet's writer would hold a hundred of them before it looks at their size.
    "parquet.block.size.row.check.min": "10",
    "parquet.page.size.row.check.min": "10",
}


# To be given when a session is created; they cannot be changed later.
STATIC_SETTINGS = {
    # Long expressions are built from many small columns; recording the call site of each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a running session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session takes a temporary
    folder; on a cluster it is an error, since executors would not share such a folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None and not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scriptorium-"))
        current = context.getCheckpointDir()
    return named or current


def written(rows: DataFrame) -> DataFrame:
    """The rows, written once as a table in the shared folder. Smaller than a checkpoint, and columns that are not read later cost nothing."""
    return rows.sparkSession.read.parquet(written_to(rows))


def written_to(rows: DataFrame, *by: str) -> str:
    """The path of the rows, written once as a table in the shared folder; in one folder for each value of ``by``."""
    path = f"{checkpoint_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(path)
    return path


def read_in_task(path: str, filters: list[tuple] | None = None) -> pa.Table:
    """A table of ``written_to`` as a task reads it, without the driver; with ``filters``, what is left by them."""
    from pyarrow import fs, parquet

    local = re.sub("^file:/*", "/", path)
    system, root = fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)
    files = sorted(file.path for file in system.get_file_info(fs.FileSelector(root)) if file.path.endswith(".parquet"))
    return pa.concat_tables([parquet.read_table(file, filesystem=system, partitioning=None, filters=filters) for file in files])


def broadcast_if_small(rows: DataFrame, limit: int) -> DataFrame:
    """Mark a table for broadcast if it has at most ``limit`` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(rows) if rows.count() <= limit else rows
