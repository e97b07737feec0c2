from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from scriptorium.functions import urls

BASES = ["http://a/b/c/d;p?q", "http://h", "http://h/x/", "https://h/x/y#f", "http://h?z=1"]
REFERENCES = (
    "g ./g g/ /g //g ?y g?y #s g#s . ./ .. ../ ../g ../.. ../../g ../../../g /./g /../g mailto:a@b http://z/q?x#y "
    "g//h /g//h javascript:void(0) g;x=1 a/../b/. //g/../x HTTP://z/Q"
).split() + [""]


def test_resolve_agrees_with_the_standard_library(spark):
    cases = [(base, reference) for base in BASES for reference in REFERENCES]
    frame = spark.createDataFrame(cases, "b string, r string")
    found = frame.select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    assert [(x.b, x.r, x.u) for x in found] == [(b, r, urljoin(b, r)) for b, r in cases]


def test_path_agrees_with_the_standard_library(spark):
    cases = ["http://h/a/b;x?y#z", "mailto:a@b;c", "//h/p", "/a/b", "a", "http://h", "HTTPS://h/A.PDF?x", "x:y/z"]
    found = spark.createDataFrame([(c,) for c in cases], "u string").select(urls.url_path(F.col("u"))).collect()
    assert [row[0] for row in found] == [urlparse(c).path for c in cases]


def test_storage_path(spark):
    cases = {
        "http://h": "index",
        "http://h/": "index",
        "http://h/a//b/": "a/b",
        "http://h/a.html?x=1#y": "a.html",
        "/p/q": "p/q",
    }
    frame = spark.createDataFrame([(c,) for c in cases], "u string")
    assert [r[0] for r in frame.select(urls.storage_path(F.col("u"))).collect()] == list(cases.values())


def test_pdf_routing(spark):
    cases = [("http://h/a.PDF", True, "a.PDF"), ("http://h/a.pdf?y", False, "a.pdf"), ("http://h/a", False, "a.pdf")]
    frame = spark.createDataFrame([(c[0],) for c in cases], "u string")
    found = frame.select(urls.is_pdf(F.col("u")), urls.pdf_file_name(F.col("u")), urls.is_remote(F.col("u"))).collect()
    assert [(r[0], r[1]) for r in found] == [(c[1], c[2]) for c in cases]
    assert all(r[2] for r in found)
