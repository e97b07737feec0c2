"""Recognised pages, boxes and tables assembled into Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.constants import (
    CELLS_MISSING,
    COLUMN_NAME,
    MIN_REGION_SIDE,
    PAGE_HEADING,
    ROW_TOLERANCE,
    ROWS_FAILED,
    TABLE_EMPTY,
    TABLE_TITLE,
    TABLES_HEADING,
)
from scriptorium.functions.text import let, positions, strip

# Pages of one document that are assembled into one string; longer documents come in numbered parts.
PAGES_PER_PART = 512
# Rows of one table that are assembled into one string.
ROWS_PER_PART = 512


def line_paragraphs(text: Column) -> Column:
    """Paragraphs of recognised text: stripped lines, joined by blanks between empty lines."""
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    blocks = F.filter(F.split(lines, "\n\n+"), lambda block: block != "")
    joined = F.transform(blocks, lambda block: F.replace(F.btrim(block, F.lit("\n")), F.lit("\n"), F.lit(" ")))
    return F.filter(joined, lambda block: block != "")


def _width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _head(width: Column) -> Column:
    names = F.transform(positions(1, width), lambda i: F.concat(F.lit(COLUMN_NAME), i))
    return F.array(_line(names), _line(F.array_repeat(F.lit("---"), width)))


def table_lines(rows: Column) -> Column:
    """Markdown lines of a ragged table: numbered headings, a rule, rows padded to the widest."""

    def lines(width: Column) -> Column:
        padded = F.transform(rows, lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))))
        return F.concat(_head(width), F.transform(padded, _line))

    return F.when(F.size(rows) > 0, let(_width(rows), lines)).otherwise(F.array(F.lit(TABLE_EMPTY)))


def _cell(text: Column) -> Column:
    """Stripped text, a single space for a blank or missing one."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda c: F.when(c == "", " ").otherwise(c))


def fill_cells(rows: Column) -> Column:
    """Stripped cells, a blank one as a single space, empty rows dropped.

    Without any row there is nothing to sort and the table says so; another message stands where rows are left without cells.
    """
    filled = F.transform(F.filter(rows, lambda row: F.size(row) > 0), lambda row: F.transform(row, _cell))
    return let(
        filled,
        lambda kept: F.when(F.size(kept) > 0, kept)
        .when(F.size(rows) > 0, F.array(F.array(F.lit(CELLS_MISSING))))
        .otherwise(F.array(F.array(F.lit(ROWS_FAILED)))),
    )


def ragged_to_markdown(tables: DataFrame, *keys: str) -> DataFrame:
    """One Markdown table per row of ``tables`` (column ``rows``: ``ARRAY<ARRAY<STRING>>``)."""
    return tables.select(*keys, F.array_join(table_lines(F.col("rows")), "\n").alias("markdown"))


def page_markdown(page_num: Column, text: Column, tables: Column) -> Column:
    """Markdown of one page: heading, paragraphs, detected tables, rule. Parts are joined by newlines."""
    paragraphs = F.flatten(F.transform(line_paragraphs(text), lambda body: F.array(body, F.lit("\n"))))

    def table_parts(table: Column) -> Column:
        title = F.concat(F.lit("\n" + TABLE_TITLE), table["id"], F.lit(":**\n\n"))
        lines = F.transform(table_lines(table["data"]), lambda line: F.concat(line, F.lit("\n")))
        return F.concat(F.array(title), lines)

    found = F.flatten(F.transform(tables, table_parts))
    section = F.when(F.size(tables) > 0, F.concat(F.array(F.lit(TABLES_HEADING)), found)).otherwise(
        F.array().cast("array<string>")
    )
    heading = F.array(F.concat(F.lit(PAGE_HEADING), page_num, F.lit("\n")))
    return F.array_join(F.concat(heading, paragraphs, section, F.array(F.lit("\n---\n"))), "\n")


def document_markdown(pages: DataFrame, pages_per_part: int = PAGES_PER_PART) -> DataFrame:
    """``(base_name, part, file, markdown)`` from pages ``(doc, page_num, text, tables)``.

    A document is the concatenation of its parts in order; one of up to ``pages_per_part`` pages has a
    single part, so no group grows beyond that whatever the length of a document.
    """
    rendered = pages.select(
        "doc",
        F.floor((F.col("page_num") - 1) / pages_per_part).cast("int").alias("part"),
        "page_num",
        page_markdown(F.col("page_num"), F.col("text"), F.col("tables")).alias("_page"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("page_num", "_page")))
    body = F.array_join(F.transform(ordered, lambda page: page["_page"]), "\n")
    name = F.regexp_replace(F.col("doc"), r"(.)\.[^.]*$", "$1")
    # A later part continues the text before it, so it starts with the separator.
    return rendered.groupBy("doc", "part").agg(body.alias("_body")).select(
        name.alias("base_name"),
        "part",
        F.concat(name, F.lit(".md")).alias("file"),
        F.when(F.col("part") > 0, F.concat(F.lit("\n"), F.col("_body"))).otherwise(F.col("_body")).alias("markdown"),
    )


def reading_order(boxes: DataFrame, tolerance: int = ROW_TOLERANCE) -> DataFrame:
    """Boxes ``(table_id, box_id, x, y, ...)`` with ``row_no`` and ``col_no`` in reading order, from 0.

    A box opens a new row when it lies more than ``tolerance`` below the first box of the current row.
    Rows depend on the distinct heights only. Those are combined before the shuffle, cut wherever the gap
    alone already opens a row, and folded per cut: a table of very many boxes costs no more than its
    height. Columns are numbered inside the rows.
    """
    heights = boxes.select("table_id", "y").distinct()
    by_height = Window.partitionBy("table_id").orderBy("y")
    gap = F.col("y") - F.lag("y").over(by_height)
    bands = heights.withColumn("_cut", F.when(gap <= tolerance, 0).otherwise(1)).withColumn(
        "_band", F.sum("_cut").over(by_height.rowsBetween(Window.unboundedPreceding, 0))
    )

    def anchor(state: Column, y: Column) -> Column:
        same = y - state["anchor"] <= tolerance
        first = F.when(same, state["anchor"]).otherwise(y)
        return F.struct(
            first.alias("anchor"),
            F.array_append(state["rows"], F.struct(y.alias("y"), first.alias("anchor"))).alias("rows"),
        )

    start = F.struct(
        F.element_at("_ys", 1).alias("anchor"), F.array().cast("array<struct<y:int,anchor:int>>").alias("rows")
    )
    anchors = (
        bands.groupBy("table_id", "_band")
        .agg(F.sort_array(F.collect_list("y")).alias("_ys"))
        .select("table_id", F.explode(F.aggregate("_ys", start, anchor)["rows"]).alias("_row"))
        .select("table_id", "_row.y", "_row.anchor")
        .withColumn("row_no", F.dense_rank().over(Window.partitionBy("table_id").orderBy("anchor")) - 1)
        .drop("anchor")
    )
    # Boxes meet their height, not their table: a table of very many boxes is spread over its heights.
    placed = boxes.join(anchors, ["table_id", "y"])
    ties = [name for name in boxes.columns if name not in ("table_id", "x")]
    in_row = Window.partitionBy("table_id", "row_no").orderBy("x", *ties)
    return placed.select(
        *boxes.columns,
        F.col("row_no").cast("int").alias("row_no"),
        (F.row_number().over(in_row) - 1).cast("bigint").alias("col_no"),
    )


def boxes_to_markdown(regions: DataFrame, boxes: DataFrame, tolerance: int = ROW_TOLERANCE, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(table_id, part, markdown)``: the Markdown table of every region ``(table_id)`` from its cell boxes ``(table_id, x, y, text, ...)``.

    Cells stand in reading order; blank ones are a single space, short rows are padded to the widest. Rows come together in two levels: the cells of a
    row, then ``rows_per_part`` rows of a part; the text of a table is the concatenation of its parts. A region without
    boxes, or with one that has no place, cannot be sorted and holds the message that says so. Regions may repeat; boxes of unknown regions are left out.
    """
    known = regions.select("table_id").distinct()
    unplaced = boxes.filter(F.col("x").isNull() | F.col("y").isNull()).select("table_id").distinct()
    placed = reading_order(boxes.join(unplaced, "table_id", "left_anti").join(known, "table_id", "left_semi"), tolerance)
    cells = F.transform(F.sort_array(F.collect_list(F.struct("col_no", _cell(F.col("text")).alias("cell")))), lambda c: c["cell"])
    rows = placed.groupBy("table_id", "row_no").agg(cells.alias("cells"))
    widths = placed.groupBy("table_id").agg((F.max("col_no") + 1).cast("int").alias("width"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    lines = rows.join(widths, "table_id").select(
        "table_id", "width", F.floor(F.col("row_no") / rows_per_part).cast("int").alias("part"), F.struct("row_no", _line(padded).alias("line")).alias("_line")
    )
    parts = lines.groupBy("table_id", "part", "width").agg(F.sort_array(F.collect_list("_line")).alias("_lines"))
    body = F.array_join(F.transform("_lines", lambda row: row["line"]), "\n")
    head = F.array_join(_head(F.col("width")), "\n")
    # A later part continues the text before it, so it starts with the separator.
    made = parts.select("table_id", "part", F.concat(F.when(F.col("part") == 0, head).otherwise(""), F.lit("\n"), body).alias("markdown"))
    failed = F.array_join(table_lines(F.array(F.array(F.lit(ROWS_FAILED)))), "\n")
    unsorted = known.join(widths, "table_id", "left_anti").select("table_id", F.lit(0).alias("part"), failed.alias("markdown"))
    return made.unionByName(unsorted)


def region_filter(boxes: DataFrame, minimum: int = MIN_REGION_SIDE) -> DataFrame:
    """Regions larger than ``minimum`` both ways; the id is the place before the filter, so ids have gaps.

    ``boxes`` carries the detection order in ``place``, counted from 0.
    """
    return boxes.filter((F.col("w") > minimum) & (F.col("h") > minimum)).select(
        "table_id",
        (F.col("place") + 1).cast("int").alias("id"),
        F.struct(
            F.col("x").alias("x0"),
            F.col("y").alias("y0"),
            (F.col("x") + F.col("w")).alias("x1"),
            (F.col("y") + F.col("h")).alias("y1"),
        ).alias("region"),
    )
