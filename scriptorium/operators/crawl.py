"""Following links from start pages over captured link rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.urls import in_scope, is_pdf
from scriptorium.session import checkpoint_folder


def unvisited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """The distinct candidate URLs that were not visited; URLs are compared as whole strings."""
    return candidates.select("url").distinct().join(visited.select("url"), "url", "left_anti")


class _Bucketed:
    """A table in the shared folder, laid out by the hash of one column like the rows of a shuffle on it."""

    def __init__(self, spark: SparkSession, column: str):
        self.spark, self.column = spark, column
        self.name = f"crawl_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_folder(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, self.column).sortBy(self.column)
        writer.option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the name out of the catalogue; the files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def crawl_closure(links: DataFrame, start_urls: list[str] | DataFrame, scope: str = "", max_depth: int | None = None) -> DataFrame:
    """All URLs reachable from the start URLs inside the scope: ``(url, depth, route)``.

    ``links`` holds ``(src, dst)``; the start URLs are a list or rows ``(url)``. One round per depth. The link rows are laid out by their source once and the visited URLs by themselves, in the same
    buckets: a round joins its frontier to the links and removes the visited ones without moving either, and shuffles only the
    targets it has found, made distinct before. Rounds are written to the shared folder, so the plan stays short and a lost
    executor costs a round at most. PDF addresses are reached but not followed. Out-of-scope links and repeats are dropped once, before the rounds.
    """
    spark = links.sparkSession
    edges, visited = _Bucketed(spark, "src"), _Bucketed(spark, "url")
    kept = links.filter(in_scope(F.col("dst"), scope) & ~is_pdf(F.col("src"))).select("src", "dst").distinct()
    edges.append(kept.repartition(edges.buckets, "src"))
    starts = start_urls if isinstance(start_urls, DataFrame) else spark.createDataFrame([(url,) for url in start_urls], "url string")
    visited.append(starts.select("url").distinct().filter(in_scope(F.col("url"), scope)).withColumn("depth", F.lit(0)).repartition(visited.buckets, "url"))
    depth = 0
    while max_depth is None or depth < max_depth:
        frontier = visited.rows().filter(F.col("depth") == depth)
        if frontier.isEmpty():
            break
        depth += 1
        reached = edges.rows().join(frontier.select(F.col("url").alias("src")), "src", "left_semi")
        found = unvisited(reached.select(F.col("dst").alias("url")), visited.rows())
        visited.append(found.withColumn("depth", F.lit(depth)))
    whole = visited.rows().checkpoint()
    edges.forget()
    visited.forget()
    return whole.select("url", "depth", F.when(is_pdf(F.col("url")), "pdf").otherwise("page").alias("route"))
