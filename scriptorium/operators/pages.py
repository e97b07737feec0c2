"""Operators on captured pages ``(page_id, url, html)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.markup import html_to_markdown, page_hrefs, rewrite_hrefs
from scriptorium.functions.text import basename
from scriptorium.functions.urls import canonical, in_scope, is_pdf, is_remote, pdf_file_name, resolve, storage_path, url_path


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per anchor with a target, in page order: ``(page_id, url, position, href)``."""
    return pages.select("page_id", "url", F.posexplode(page_hrefs(F.col("html"))).alias("position", "href"))


def resolve_links(links: DataFrame) -> DataFrame:
    """Add ``target``, the absolute URL of each link."""
    return links.withColumn("target", resolve(F.col("url"), F.col("href")))


def page_edges(pages: DataFrame, scope: str = "") -> DataFrame:
    """``(src, dst, page_id, n_links)``: the links of captured pages, by the addresses of both ends.

    Links are resolved against their page, kept inside the scope, and counted per pair of addresses before anything moves. An address is
    canonical without its fragment. ``page_id`` is the captured page at ``dst`` (the last one of an address), null where none was captured.
    """
    links = resolve_links(extract_links(pages)).filter(in_scope(F.col("target"), scope))
    ends = links.groupBy(canonical(F.col("url")).alias("src"), canonical(F.col("target")).alias("dst")).agg(F.count("*").alias("n_links"))
    captured = pages.groupBy(canonical(F.col("url")).alias("dst")).agg(F.max("page_id").alias("page_id"))
    return ends.join(captured, "dst", "left").select("src", "dst", "page_id", "n_links")


def url_parts(urls: DataFrame) -> DataFrame:
    """Path and base name of each ``url``."""
    path = url_path(F.col("url"))
    return urls.select("*", path.alias("path"), basename(path).alias("name"))


def storage_paths(urls: DataFrame) -> DataFrame:
    return urls.withColumn("storage_path", storage_path(F.col("url")))


def crawl_scope(urls: DataFrame, start_url: str) -> DataFrame:
    return urls.filter(in_scope(F.col("url"), start_url))


def route_by_type(urls: DataFrame) -> DataFrame:
    """Add the route (``pdf`` or ``page``), where the source lies, and the file name of a PDF."""
    url = F.col("url")
    return urls.select(
        "*",
        F.when(is_pdf(url), "pdf").otherwise("page").alias("route"),
        F.when(is_remote(url), "remote").otherwise("local").alias("place"),
        F.when(is_pdf(url), pdf_file_name(url)).alias("pdf_name"),
    )


def rewrite_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", rewrite_hrefs(F.col("url"), F.col("html")).alias("html"))


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_to_markdown(F.col("html")).alias("markdown"))


def page_store(pages: DataFrame, start_url: str = "") -> DataFrame:
    """The stored form of every page in scope; of pages with one storage path the last one stays.

    The winners are found on ids and paths alone, by a hash aggregation that combines before the shuffle,
    so a path shared by very many pages costs nothing and no page text is grouped.
    """
    kept = crawl_scope(pages, start_url)
    winners = kept.groupBy(storage_path(F.col("url")).alias("storage_path")).agg(F.max("page_id").alias("page_id"))
    stored = kept.join(winners, "page_id").withColumn("html", rewrite_hrefs(F.col("url"), F.col("html")))
    return stored.select(
        "storage_path",
        "page_id",
        "url",
        F.concat("storage_path", F.lit(".html")).alias("html_file"),
        F.concat("storage_path", F.lit(".md")).alias("markdown_file"),
        "html",
        html_to_markdown(F.col("html")).alias("markdown"),
    )
