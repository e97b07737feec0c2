"""Connected components of links between distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import checkpointed


def component_roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links (a, b)`` that is not the smallest of its component.

    Stars are pulled to smaller nodes in turns (large star, small star) until nothing changes, which takes a
    number of rounds logarithmic in the longest chain. A node of any number of links is only ever reduced to the
    smallest of its neighbours; the join that gives that back splits hot nodes. No links give no rows.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpointed(small.select("e.u", "e.v").filter("u <> v").distinct())
