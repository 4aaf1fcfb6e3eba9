"""Page layout: words with boxes to lines, paragraphs and blocks.

Words: doc_id, page, text, x0, x1, top, bottom, and the page's height, width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

PAGE = ["doc_id", "page"]


def crop(words: DataFrame, header: float = 0.06, footer: float = 0.94) -> DataFrame:
    """Without the words in the top and bottom bands of the page."""
    return words.where((F.col("top") >= header * F.col("height")) & (F.col("bottom") <= footer * F.col("height")))


def columns(words: DataFrame, least: int = 80, share: float = 0.22) -> DataFrame:
    """Per page 1 or 2 columns: two if there are enough words and both halves
    hold a fair share of them."""
    left = F.count_if(F.col("x1") <= F.col("width") / 2)
    right = F.count_if(F.col("x0") >= F.col("width") / 2)
    g = words.groupBy(*PAGE).agg(F.count("*").alias("n"), left.alias("left"), right.alias("right"))
    two = (F.col("n") >= least) & (F.col("left") >= share * F.col("n")) & (F.col("right") >= share * F.col("n"))
    return g.withColumn("columns", F.when(two, 2).otherwise(1))


def lines(words: DataFrame) -> DataFrame:
    """Words of a page (and column) at the same rounded top, left to right."""
    c = words.join(columns(words).select(*PAGE, "columns"), PAGE)
    c = c.withColumn("column", F.when((F.col("columns") == 2) & (F.col("x0") >= F.col("width") / 2), 1).otherwise(0))
    g = c.groupBy(*PAGE, "column", F.round("top").alias("line")).agg(
        F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("ws"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom")
    )
    return g.select(*PAGE, "column", "line", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), "x0", "x1", "top", "bottom")


def paragraphs(rows: DataFrame, gap: float = 8.0) -> DataFrame:
    """Lines join into paragraphs until a vertical gap above the limit."""
    w = Window.partitionBy(*PAGE, "column").orderBy("top", "x0")
    new = F.when(F.col("top") - F.lag("bottom").over(w) > gap, 1).otherwise(0)
    r = rows.withColumn("__new", new).withColumn("par", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = r.groupBy(*PAGE, "column", "par").agg(
        F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("ls"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom")
    )
    return g.select(*PAGE, "column", "par", F.array_join(F.transform("ls", lambda x: x["text"]), " ").alias("text"), F.struct("x0", "top", "x1", "bottom").alias("bbox"))


def empty_table(rows):
    """No cell of a table's rows has any text."""
    return ~F.exists(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def blocks(pars: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Paragraphs and non-empty tables (doc_id, page, rows, bbox) as blocks in
    reading order, ids counted per page and type."""
    p = pars.select(*PAGE, "column", F.lit("paragraph").alias("block_type"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), "bbox")
    if tables is not None:
        t = tables.where(~empty_table(F.col("rows"))).select(*PAGE, F.lit(0).alias("column"), F.lit("table").alias("block_type"), T.table_tsv("rows").alias("text"), "rows", "bbox")
        p = p.unionByName(t)
    order = ["column", F.col("bbox.top").asc_nulls_last(), F.col("bbox.x0").asc_nulls_last(), "text"]
    n = F.row_number().over(Window.partitionBy(*PAGE, "block_type").orderBy(*order))
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))
    return p.select("*", F.format_string("p%d_%s_%d", "page", "block_type", n).alias("block_id"), seq.alias("seq"))


def flat_text(bs: DataFrame) -> DataFrame:
    g = bs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "seq", "text"))).alias("b"))
    return g.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def attach_captions(bs: DataFrame) -> DataFrame:
    """Caption blocks with the table they belong to: the table they name, else
    the nearest one before on the page, else in the section."""
    table = F.when(F.col("block_type") == "table", F.col("block_id"))
    page = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    section = Window.partitionBy("doc_id", "section").orderBy("page", "seq").rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.col("table_id"), F.last(table, ignorenulls=True).over(page), F.last(table, ignorenulls=True).over(section))
    return bs.withColumn("caption_of", near).where("block_type = 'caption'")


def cells_to_markdown(cells: DataFrame) -> DataFrame:
    """cells: table_id, row, col, text. One Markdown grid per table."""
    r = cells.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    r = r.select("table_id", "row", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |")).alias("line"), F.size("c").alias("n"))
    g = r.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"), F.max_by("n", -F.col("row")).alias("n"))
    lines_ = F.transform("r", lambda x: x["line"])
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n")))
    return g.select("table_id", F.array_join(F.concat(F.slice(lines_, 1, 1), F.array(rule), F.slice(lines_, 2, 1_000_000)), "\n").alias("markdown"))
