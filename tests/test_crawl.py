from scriptorium.operators import crawl, pages


def closure(spark, edges, starts, **options):
    links = spark.createDataFrame(edges, "src string, dst string")
    return {r.url: (r.depth, r.route) for r in crawl.crawl_closure(links, starts, **options).collect()}


def test_closure_follows_cycles_once_and_keeps_the_scope(spark):
    edges = [("s/a", "s/b"), ("s/b", "s/a"), ("s/b", "s/c"), ("s/b", "o/x"), ("o/x", "s/z"), ("s/c", "s/c#t"), ("s/q", "s/r")]
    assert closure(spark, edges, ["s/a"], scope="s/") == {
        "s/a": (0, "page"), "s/b": (1, "page"), "s/c": (2, "page"), "s/c#t": (3, "page"),
    }


def test_pdfs_are_reached_but_not_followed(spark):
    edges = [("a", "x.PDF"), ("x.PDF", "b")]
    assert closure(spark, edges, ["a"]) == {"a": (0, "page"), "x.PDF": (1, "pdf")}


def test_depth_limit_and_start_out_of_scope(spark):
    edges = [("a", "b"), ("b", "c")]
    assert set(closure(spark, edges, ["a"], max_depth=1)) == {"a", "b"}
    assert closure(spark, edges, ["a"], scope="http") == {}


def test_page_store_keeps_the_last_page_of_a_path(spark):
    rows = [(1, "http://h/a?x=1", '<a href="/q">l</a>'), (2, "http://h/a/", "<p>two</p>"), (3, "http://o/a", "no"), (4, "http://h/", "root")]
    captured = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    stored = {r.storage_path: r for r in pages.page_store(captured, "http://h/").collect()}
    assert set(stored) == {"a", "index"}
    assert stored["a"].page_id == 2 and stored["a"].markdown == "two\n" and stored["a"].markdown_file == "a.md"


def test_starts_as_rows_and_a_long_chain(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(12)] + [("p3", "p0"), ("p12", "p5")]
    links = spark.createDataFrame(edges, "src string, dst string")
    starts = spark.createDataFrame([("p0",), ("p6",), ("p6",)], "url string")
    found = {r.url: r.depth for r in crawl.crawl_closure(links, starts).collect()}
    assert found == {f"p{i}": i if i < 6 else i - 6 for i in range(13)}


def test_edges_lead_to_captured_pages(spark):
    rows = [
        (1, "http://h/a#top", '<a href="b">x</a><a href="/b#s">y</a><a href="http://o/z">z</a><a href="#f">self</a>'),
        (2, "http://h/b", '<a href="a">a</a>'), (3, "http://h/b#again", '<a href="/c">c</a>'), (4, "http://h/d", "none"),
    ]
    captured = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = sorted(map(tuple, pages.page_edges(captured, "http://h/").collect()))
    assert found == [("http://h/a", "http://h/a", 1, 1), ("http://h/a", "http://h/b", 3, 2), ("http://h/b", "http://h/a", 1, 1), ("http://h/b", "http://h/c", None, 1)]
    assert ("http://h/a", "http://o/z", None, 1) in set(map(tuple, pages.page_edges(captured).collect()))
