import random

from pyspark.sql import functions as F

from scriptorium.operators import documents as docs


def test_rows_are_anchored_at_their_first_box(spark):
    boxes = spark.createDataFrame(
        [(1, i, x, y) for i, (x, y) in enumerate([(5, 0), (3, 8), (9, 16), (1, 24), (7, 40), (2, 40)])],
        "table_id bigint, box_id bigint, x int, y int",
    )
    found = docs.reading_order(boxes).orderBy("row_no", "col_no").collect()
    assert [(r.row_no, r.col_no, r.y, r.x) for r in found] == [
        (0, 0, 8, 3), (0, 1, 0, 5), (1, 0, 24, 1), (1, 1, 16, 9), (2, 0, 40, 2), (2, 1, 40, 7),
    ]


def test_reading_order_of_a_hot_table(spark):
    boxes = spark.range(3000).select(
        F.lit(1).alias("table_id"), F.col("id").alias("box_id"), F.lit(4).alias("x"), (F.col("id") % 30).cast("int").alias("y")
    )
    found = docs.reading_order(boxes).groupBy("row_no").agg(F.count("*").alias("n"), F.max("col_no").alias("m")).orderBy("row_no")
    assert [(r.row_no, r.n, r.m) for r in found.collect()] == [(0, 1100, 1099), (1, 1100, 1099), (2, 800, 799)]


def test_regions_keep_the_id_of_their_place(spark):
    boxes = spark.createDataFrame(
        [(1, 0, 1, 2, 100, 200), (1, 1, 1, 2, 101, 101)], "table_id int, place int, x int, y int, w int, h int"
    )
    found = docs.region_filter(boxes).collect()
    assert [(r.id, tuple(r.region)) for r in found] == [(2, (1, 2, 102, 103))]


def test_lines_become_paragraphs(value):
    text = "\n a\nb \n \n\nc\n"
    assert value(docs.line_paragraphs(F.col("t")), t=text) == ["a b", "c"]
    assert value(docs.line_paragraphs(F.col("t")), t="") == []


def test_ragged_tables(spark):
    rows = spark.createDataFrame([(1, [["a"], ["b", "c"]]), (2, [])], "k int, rows array<array<string>>")
    found = {r.k: r.markdown for r in docs.ragged_to_markdown(rows, "k").collect()}
    assert found[1] == "| Columna 1 | Columna 2 |\n| --- | --- |\n| a |  |\n| b | c |"
    assert found[2] == "*No se pudo extraer el contenido de la tabla*"


def test_cells(spark):
    rows = spark.createDataFrame([(1, [[" x ", "\t"], []]), (2, []), (3, [[]])], "k int, rows array<array<string>>")
    found = {r.k: r.c for r in rows.select("k", docs.fill_cells(F.col("rows")).alias("c")).collect()}
    assert found == {1: [["x", " "]], 2: [["[Table content could not be extracted properly]"]], 3: [["[Table detected but content extraction failed]"]]}


def test_document_is_the_concatenation_of_its_parts(spark):
    schema = "doc string, page_num int, text string, tables array<struct<id:int,data:array<array<string>>>>"
    pages = [("f.x.pdf", n, f"line\n{n}", [(3, [["v"]])] if n == 2 else []) for n in (3, 1, 2)]
    frame = spark.createDataFrame(pages, schema)
    whole = docs.document_markdown(frame).collect()
    assert [(r.base_name, r.part, r.file) for r in whole] == [("f.x", 0, "f.x.md")]
    assert whole[0].markdown == (
        "## Página 1\n\nline 1\n\n\n\n---\n\n"
        "## Página 2\n\nline 2\n\n\n\n### Tablas detectadas en esta página:\n\n\n**Tabla 3:**\n\n\n"
        "| Columna 1 |\n\n| --- |\n\n| v |\n\n\n---\n\n"
        "## Página 3\n\nline 3\n\n\n\n---\n"
    )
    parts = docs.document_markdown(frame, pages_per_part=2).orderBy("part").collect()
    assert len(parts) == 2 and "".join(p.markdown for p in parts) == whole[0].markdown


def brute_markdown(boxes, tolerance=10):
    """The table of one region by the plain rule: sorted by height, a new row beyond the tolerance of its first box, each row by x."""
    if not boxes or any(b[1] is None or b[2] is None for b in boxes):
        rows = [["[Table content could not be extracted properly]"]]
    else:
        rows, anchor = [], None
        for box in sorted(boxes, key=lambda b: b[2]):
            if anchor is None or box[2] - anchor > tolerance:
                rows.append([])
                anchor = box[2]
            rows[-1].append(box)
        rows = [[(b[3] or "").strip() or " " for b in sorted(row, key=lambda b: (b[1], b[0], b[2]))] for row in rows]
    width = max(map(len, rows))
    lines = [[f"Columna {i + 1}" for i in range(width)], ["---"] * width, *[row + [""] * (width - len(row)) for row in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def test_boxes_become_tables(spark):
    rng = random.Random(3)
    tables = {t: [(b, rng.randrange(60), rng.randrange(200), rng.choice([" a ", "b\n", "", "\t", None])) for b in range(rng.randrange(1, 40))] for t in range(30)}
    tables[100] = [(b, b % 7, b // 7 * 30, f"c{b}") for b in range(7 * 300)]
    tables[101], tables[102], tables[103] = [], [(1, 5, None, "lost"), (2, 5, 5, "x")], [(1, None, 3, "lost")]
    boxes = spark.createDataFrame([(t, *b) for t, rows in tables.items() for b in rows] + [(999, 1, 1, 1, "no region")], "table_id int, box_id int, x int, y int, text string")
    regions = spark.createDataFrame([(t,) for t in [*tables, 5]], "table_id int")
    for rows_per_part in (1000, 64):
        found = {}
        for row in docs.boxes_to_markdown(regions, boxes, rows_per_part=rows_per_part).orderBy("table_id", "part").collect():
            found[row.table_id] = found.get(row.table_id, "") + row.markdown
        assert found == {t: brute_markdown(rows) for t, rows in tables.items()}
