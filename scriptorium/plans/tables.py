"""Input tables of the registered queries, and the corpora derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.markup import page_hrefs
from scriptorium.operators.pages import page_edges
from scriptorium.session import configure


# What the query adds to every second page: code with ends of other elements, a title, references, other quotes, nested tags.
ODD_HTML = (
    '<head><script>var a = "</style>"; leak()</script><title>TITLE</title></head><style>b { } </script></style>'
    "<p>&agrave; la ca&ntilde;a, it&#8217;s &#x27;so&#x27; &amp;lt;</p><a href='x.md'>one</a> <a class=c href=\"y.md\"><b>two</b></a> <a href=z.md>three</a>"
)


def load(spark: SparkSession, sf_dir: str, name: str, *spread_by: str) -> DataFrame:
    """A table. One that is read in fewer tasks than there are cores may be spread over them by its key."""
    configure(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_by and table.rdd.getNumPartitions() < cores:
        table = table.repartition(cores, *spread_by)
    return table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id")


def documents_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sentences as paragraphs."""
    return documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))


def first_word(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, "^[A-Za-z]+", 0))


def documents_acr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose last words define an acronym, in a form that depends on the language."""
    name = first_word(F.col("text"))
    form1 = F.concat("text", F.lit(" "), name, F.lit(" ("), "source", F.lit(")"))
    form2 = F.concat("text", F.lit(" ("), name, F.lit(")"))
    text = F.when(F.col("lang") == "en", form1).when(F.col("lang") == "fr", form2).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a corpus of Markdown files; each names its role as an acronym with a definition."""
    name = F.upper("role")
    form1 = F.concat("text", F.lit(" "), name, F.lit(" (conv "), "conv_id", F.lit(")"))
    form2 = F.concat("text", F.lit(" ("), name, F.lit(")"))
    return load(spark, sf_dir, "conversations", "conv_id", "turn").select(
        F.concat(F.lit("conv_"), "conv_id", F.lit("/turn_"), "turn", F.lit(".md")).alias("path"),
        F.when(F.col("role") == "user", form1).otherwise(form2).alias("text"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages", "page_id")


SITE = "https://site.example.org"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured pages as one site: a page lies where its third (or first) link points, so links lead to pages. Some addresses end in a fragment."""
    captured = pages(spark, sf_dir).withColumn("_hrefs", page_hrefs(F.col("html")))
    own = F.coalesce(F.get("_hrefs", F.lit(2)), F.get("_hrefs", F.lit(0)), F.lit("/"))
    fragment = F.when(F.col("url").contains("#"), "#top").otherwise("")
    return captured.select("page_id", F.concat(F.lit(SITE), own, fragment).alias("url"), "html", F.regexp_extract("url", "^[a-z]+://[^/]*", 0).alias("host"))


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between the addresses of the site."""
    return page_edges(site_pages(spark, sf_dir), SITE).select("src", "dst")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cell boxes: one table per order."""
    return load(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(
        F.col("l_orderkey").alias("table_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box_id"),
        (F.col("l_linenumber") - 1).alias("place"),
        (F.col("l_partkey") % 1000).cast("int").alias("x"),
        (F.col("l_suppkey") % 50).cast("int").alias("y"),
        (F.col("l_quantity") * 10).cast("int").alias("w"),
        F.round(F.col("l_discount") * 2000).cast("int").alias("h"),
    )


def cell_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes with a text, which is blank in some; a few have lost their place."""
    lost = F.col("box_id") % 89 == 0
    text = F.when(F.col("x") % 11 == 0, " \t").otherwise(F.concat(F.lit(" "), "w", F.lit(" x "), "h", F.lit("\n")))
    return boxes(spark, sf_dir).select("table_id", "box_id", "x", F.when(~lost, F.col("y")).alias("y"), "w", "h", text.alias("text"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per order, also of orders without line items."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as ragged tables: lines as rows, sentences as cells."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, r"\. "))
    return load(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", "role", "text", rows.alias("rows"))


def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scanned documents: a turn is a page; the answers hold a table."""
    table = F.struct(F.lit(1).alias("id"), F.col("rows").alias("data"))
    none = F.array().cast("array<struct<id:int,data:array<array<string>>>>")
    return ragged(spark, sf_dir).select(
        F.concat(F.lit("conv_"), "conv_id", F.lit(".scan.pdf")).alias("doc"),
        (F.col("turn") + 1).cast("int").alias("page_num"),
        F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"),
        F.when(F.col("role") == "assistant", F.array(table)).otherwise(none).alias("tables"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
