"""Incremental indexing: documents are cut as they arrive, and appended to the index or put in place of what it held of them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.chunking import chunk_rows
from scriptorium.session import checkpoint_folder

#: Parts of an index that is kept up to date; a batch rewrites those that its documents fall into.
BUCKETS = 64


def document_stream(
    spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of documents as they land in the folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_chunks(documents: DataFrame, index: str, checkpoint: str, key: str = "path") -> StreamingQuery:
    """Index everything that is there and stop; the checkpoint makes the next run continue after it.

    Cutting is row-local, so the stream keeps no state.
    """
    return (
        chunk_rows(documents, key)
        .writeStream.format("parquet")
        .option("path", index)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _generations(spark: SparkSession, index: str) -> DataFrame | None:
    """All rows that were ever written, with the bucket and the generation they belong to; none before the first batch."""
    try:
        return spark.read.parquet(index)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _current(rows: DataFrame) -> DataFrame:
    """The rows of the last generation of each bucket. One row a bucket is broadcast."""
    last = rows.groupBy("bucket").agg(F.max("generation").alias("generation"))
    return rows.join(F.broadcast(last), ["bucket", "generation"])


def _rows_of(documents: DataFrame, key: str) -> DataFrame:
    """Chunk rows of documents with their version, and a row without a chunk (``chunk_index`` -1) that holds the version of each."""
    chunks = chunk_rows(documents, key, keep=True)
    none = {"chunk_index": F.lit(-1), "total_chunks": F.lit(0), "chunk": F.lit(None).cast("string"), "start_line": F.lit(0), "end_line": F.lit(0)}
    marks = documents.drop("text").withColumns(none)
    return chunks.unionByName(marks)


def upsert_chunks(batch: DataFrame, index: str, generation: int, key: str = "path", version: str = "version", buckets: int = BUCKETS) -> None:
    """Put the documents ``(key, version, text)`` of a batch in place of what the index holds of them.

    Of a document the largest version counts; older ones that come late change nothing, and an equal one is taken again. A document without a text (null or
    empty) takes its chunks away and is remembered. The index lies in buckets by a hash of the key. Only buckets with a new
    document are read: their other documents' rows are kept by an anti join, and the bucket is written as a new generation, one file that appears as a whole.
    Nothing is overwritten, so a reader or a batch that is tried again always finds complete buckets.
    """
    spark = batch.sparkSession
    checkpoint_folder(spark)
    newest = batch.groupBy(key).agg(F.max_by(F.struct(version, "text"), F.struct(version, "text")).alias("_new")).select(key, f"_new.{version}", "_new.text")
    newest = newest.withColumn("bucket", _bucket(key, buckets)).checkpoint()
    held = _generations(spark, index)
    rows = None
    if held is not None:
        # At most as many numbers as there are buckets; they prune the partitions that are read.
        touched = [row["bucket"] for row in newest.select("bucket").distinct().collect()]
        current = _current(held.filter(F.col("generation") < generation)).filter(F.col("bucket").isin(touched)).drop("generation")
        known = current.filter("chunk_index = -1").select(F.col(key).alias("_key"), F.col(version).alias("_version"))
        newest = newest.join(known, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_version").isNull() | (F.col(version) >= F.col("_version"))).drop("_key", "_version").checkpoint()
        changed = newest.select(F.col(key).alias("_key"))
        rows = current.join(changed, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    fresh = _rows_of(newest, key)
    rows = fresh if rows is None else rows.select(fresh.columns).unionByName(fresh)
    written = rows.repartition(buckets, "bucket").withColumn("generation", F.lit(generation))
    # Dynamic: only this generation's partitions are replaced, where a batch is tried again.
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "bucket").parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The chunk rows of the last version of every document."""
    rows = _current(spark.read.parquet(index))
    return rows.filter("chunk_index >= 0").drop("bucket", "generation")


def keep_index(documents: DataFrame, index: str, checkpoint: str, key: str = "path", version: str = "version", buckets: int = BUCKETS) -> StreamingQuery:
    """Take in everything that is there and stop; the checkpoint makes the next run continue after it.

    A batch that is tried again has its old number, and writes the same generation again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        upsert_chunks(batch.select(key, version, "text"), index, number, key, version, buckets)

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
