import json
import os

from pyspark.sql import functions as F

from scriptorium.operators import dictionary, graph, status
from scriptorium.operators.status import ingest_status, isolated, split_by_status
from scriptorium.sources import corpus, sinks
from scriptorium.plans.queries import QUERIES
from scriptorium.streaming.index import append_chunks, document_stream, read_index, upsert_chunks


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.md").write_text("uno\n\nñ", encoding="utf-8")
    (tmp_path / "sub dir" / "b+c.md").write_text("dos", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    rows = {r.path: (r.text, r.source) for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": ("uno\n\nñ", "Archivo: a.md"), "sub dir/b+c.md": ("dos", "Archivo: sub dir/b+c.md")}


def test_corpus_scan_of_a_relative_folder(spark, tmp_path, monkeypatch):
    # The JVM keeps its own working folder, so the relative path starts there.
    here = spark._jvm.java.io.File(".").getCanonicalPath()
    (tmp_path / "site" / "site").mkdir(parents=True)
    (tmp_path / "site" / "site" / "a.md").write_text("uno", encoding="utf-8")
    relative = os.path.relpath(tmp_path / "site", here)
    for folder in (relative, f"./{relative}", f"file://{tmp_path}/site/", f"{tmp_path}/site/../site"):
        assert [r.path for r in corpus.scan_corpus(spark, folder).collect()] == ["site/a.md"]


def test_missing_sources_are_empty(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert corpus.scan_corpus(spark, missing).columns == ["path", "text", "source"]
    for scan in (corpus.scan_corpus, corpus.scan_pdfs, corpus.scan_pages, corpus.scan_dictionary, corpus.scan_relations):
        assert scan(spark, missing).count() == 0


def test_pdf_listing_is_flat_and_ignores_case(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("x.PDF", "y.pdf", "z.txt", "deep/w.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    found = corpus.scan_pdfs(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in found) == ["x.PDF", "y.pdf"] and found[0].content == b"%PDF"


def test_dictionary_file(spark, tmp_path):
    entry = {"archivos": ["a.md"], "conexiones": [], "centralidad": 0.5}
    data = {
        "acronimos": {"ABX": {"definicion": None, **entry}},
        "terminos": {"año": {"ocurrencias": 3, "archivos": ["a.md", "b.md"], "conexiones": ["ABX", "ABX"]}},
        "relaciones": [{"origen": "ABX", "destino": "año", "archivo": "a.md", "distancia": 4}],
    }
    path = tmp_path / "d.json"
    path.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
    rows = corpus.scan_dictionary(spark, str(path))
    texts = {r.id: (r.text, r.metadata.centrality) for r in dictionary.enriched_texts(rows).collect()}
    assert texts == {
        "ABX": ("ACRÓNIMO: ABX\nAPARECE EN: a.md", 0.5),
        "año": ("TÉRMINO: año\nOCURRENCIAS: 3\nAPARECE EN: a.md, b.md\nRELACIONADO CON: ABX, ABX", 0.0),
    }
    assert [tuple(r) for r in corpus.scan_relations(spark, str(path)).collect()] == [("ABX", "año", "a.md", 4)]


def test_index_is_replaced_and_appended(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"))
    sinks.replace_index(rows, path)
    sinks.append_index(rows, path)
    assert spark.read.parquet(path).count() == 6
    sinks.replace_index(rows, path)
    assert spark.read.parquet(path).count() == 3


def test_json_keeps_other_alphabets(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([("ñ", None)], "a string, b string"), str(tmp_path / "j"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("*.json"))
    assert text.strip() == '{"a":"ñ","b":null}'


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("A&B", "acronimo", None, None), ("t", "termino", None, 2)], "id string, kind string, definition string, occurrences bigint")
    edges = spark.createDataFrame([("A&B", "acronimo", "t", "termino", 5)], "src string, src_kind string, dst string, dst_kind string, weight bigint")
    sinks.write_graph(nodes, edges, str(tmp_path))
    read = spark.read.text(str(tmp_path / "graphml"))
    section = lambda name: [r.value for r in read.filter(F.col("section") == name).collect()]
    whole = "\n".join(section("head") + section("node") + section("edge") + section("tail"))
    import xml.etree.ElementTree as ET

    space = "{http://graphml.graphdrawing.org/xmlns}"
    root = ET.fromstring(whole.encode())
    assert {n.get("id") for n in root.iter(f"{space}node")} == {"A&B", "t"}
    assert [d.text for d in root.iter(f"{space}data")].count("5") == 1
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 1
    assert graph.graphml_frame()[0] in whole


def test_page_and_document_tables(spark, tmp_path):
    sinks.write_pages(spark.createDataFrame([("a", "h")], "storage_path string, html string"), str(tmp_path / "p"))
    sinks.write_documents(spark.createDataFrame([("a.md", 0, "m")], "file string, part int, markdown string"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert spark.read.parquet(str(tmp_path / "d")).first().markdown == "m"


def test_one_bad_item_does_not_stop_the_others(spark):
    def convert(text: str) -> str:
        return str(10 // int(text))

    items = spark.createDataFrame([("5",), ("0",), ("x",)], "name string").withColumn("r", isolated(convert)("name"))
    lines = [r.line for r in ingest_status(items, F.col("name"), F.col("r.value"), F.col("r.error")).collect()]
    assert lines[0] == "Successfully converted '5' to: 2"
    assert lines[1].startswith("Error converting '0': ZeroDivisionError") and "ValueError" in lines[2]
    good, bad = split_by_status(items, F.col("r.error"))
    assert (good.count(), bad.count()) == (1, 2)


def test_stream_continues_where_it_stopped(spark, tmp_path):
    docs, out, log = (str(tmp_path / name) for name in ("docs", "out", "log"))
    schema = "path string, text string"
    for round_no, texts in enumerate([["uno\n\ndos"], ["w" * 600, "tres"]]):
        rows = [(f"{round_no}-{i}", text) for i, text in enumerate(texts)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(docs)
        append_chunks(document_stream(spark, docs, schema), out, log).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert sorted((r.path, r.chunk_index) for r in found) == [("0-0", 0), ("1-0", 0), ("1-0", 1), ("1-1", 0)]


def test_stream_index_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"uno\n\ndos {i}") for i in range(6)], "doc_id bigint, text string").repartition(3)
    rows.write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    rows.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    for name in ("folder", "file"):
        assert sorted(r.doc_id for r in QUERIES["stream_chunk_index"](spark, str(tmp_path / name)).collect()) == list(range(6))


def test_an_index_is_appended_from_chunks_that_were_cut_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"uno\n\ndos {i}") for i in range(6)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plans, append = [], sinks.append_index
    monkeypatch.setattr(sinks, "append_index", lambda rows, path: (plans.append(rows._jdf.queryExecution().toString()), append(rows, path)))
    assert QUERIES["index_written"](spark, str(tmp_path)).count() == 6 and "locate" not in plans[0]


def test_upserts_replace_documents(spark, tmp_path):
    """Versions that replace, come late, empty a document, repeat, and batches that are tried again."""
    index = str(tmp_path / "index")

    def batch(*rows):
        return spark.createDataFrame(list(rows), "path string, version int, text string")

    def held():
        return {(r.path, r.version, r.chunk) for r in read_index(spark, index).collect()}

    upsert_chunks(batch(("a", 1, "one"), ("b", 1, "bee"), ("c", 1, "see"), (None, 1, "none")), index, 0, buckets=3)
    assert held() == {("a", 1, "one"), ("b", 1, "bee"), ("c", 1, "see"), (None, 1, "none")}
    second = batch(("a", 3, "three"), ("a", 2, "two"), ("b", 0, "late"), ("c", 2, None), ("d", 1, "x\n\ny"))
    for _ in range(2):
        upsert_chunks(second, index, 1, buckets=3)
        assert held() == {("a", 3, "three"), ("b", 1, "bee"), ("d", 1, "x\n\ny"), (None, 1, "none")}
    upsert_chunks(batch(("c", 1, "late"), ("a", 3, "again"), ("d", 2, "")), index, 2, buckets=3)
    assert held() == {("a", 3, "again"), ("b", 1, "bee"), (None, 1, "none")}
    upsert_chunks(batch(("c", 3, "back")).limit(0), index, 3, buckets=3)
    upsert_chunks(batch(("c", 3, "back")), index, 4, buckets=3)
    assert held() == {("a", 3, "again"), ("b", 1, "bee"), ("c", 3, "back"), (None, 1, "none")}
    assert read_index(spark, index).columns == ["path", "version", "chunk_index", "total_chunks", "chunk", "start_line", "end_line"]


def test_files_are_written_and_found(spark, tmp_path):
    rows = [("a/ü b.md", "text\nñ"), ("c.md", ""), ("c.txt", "no"), (None, "x"), ("d.md", None)]
    written = sinks.write_files(spark.createDataFrame(rows, "name string, body string"), f"file://{tmp_path}/w", "name", "body")
    assert sorted(map(tuple, written.collect())) == [("a/ü b.md", 7), ("c.md", 0), ("c.txt", 2)]
    assert sorted((r.path, r.text) for r in corpus.scan_corpus(spark, str(tmp_path / "w")).collect()) == [("a/ü b.md", "text\nñ")]
    lines = spark.createDataFrame([("n", "line")], "name string, line string")
    assert [tuple(r) for r in status.folder_lines(lines, "f", True).collect()] == [("n", "line")]
    assert [r.line for r in status.folder_lines(lines.limit(0), "f", True).collect()] == ["No PDF files found in 'f'"]
    assert [r.line for r in status.folder_lines(lines.limit(0), "f", False).collect()] == ["Error: Input folder 'f' does not exist"]
    assert corpus.folder_exists(spark, str(tmp_path)) and not corpus.folder_exists(spark, str(tmp_path / "nowhere"))


def test_an_empty_markdown_folder_is_found_empty(spark, tmp_path):
    assert corpus.scan_corpus(spark, str(tmp_path / "nowhere")).collect() == []


def test_a_dictionary_is_read_once(spark, tmp_path):
    """Its two sections were two scans of one file, of which the relations are most."""
    (tmp_path / "d.json").write_text('{"acronimos": {"AB": {"definicion": "a b", "archivos": ["x"]}, "C": null}}\n{"terminos": {"t": {"ocurrencias": 3, "conexiones": ["AB"]}}}\n{"relaciones": []}\n')
    found = corpus.scan_dictionary(spark, str(tmp_path), lines=True)
    assert sorted(tuple(row) for row in found.collect()) == [("acronimo", "AB", 0, "a b", None, ["x"], None, None), ("acronimo", "C", 0, None, None, None, None, None), ("termino", "t", 0, None, 3, None, ["AB"], None)]
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
