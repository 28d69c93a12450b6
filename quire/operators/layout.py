"""Page layout over span and block tables: probe, font levels, headings, code,
overlaps, contents pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_blank, is_toc_page, is_toc_title

LEAST_CHARS, MOST_COLUMNS, LEVELS, CODE_SHARE = 40, 3, 6, 0.9
#: Rows and columns of a table, and points of an image's sides, at least.
LEAST_CELLS, LEAST_SIDE = 2, 24


def probe(spans: DataFrame) -> DataFrame:
    """``spans``: doc_id, page, block, x0, n (characters). chars_per_page, most
    columns of a page (block starts rounded to 20), scanned, escalate."""
    column = F.bround(F.col("x0") / 20) * 20
    pages = spans.groupBy("doc_id", "page").agg(F.sum("n").alias("chars"), F.greatest(F.count_distinct(F.when(F.col("n") > 0, column)), F.lit(1)).alias("columns"))
    docs = pages.groupBy("doc_id").agg((F.sum("chars") / F.count(F.lit(1))).alias("chars_per_page"), F.max("columns").alias("columns"))
    scanned = F.col("chars_per_page") < LEAST_CHARS
    return docs.withColumns({"scanned": scanned, "escalate": scanned | (F.col("columns") > MOST_COLUMNS)})


def font_levels(spans: DataFrame) -> DataFrame:
    """``spans``: doc_id, ord, size, n. Larger sizes than the body's (that of
    most characters, ties to the first met) rank as levels from 1, at most 6."""
    sizes = spans.withColumn("size", F.bround("size", 1)).groupBy("doc_id", "size").agg(F.sum("n").alias("w"), F.min("ord").alias("first"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("w", (-F.col("first")).alias("f"))).alias("body"))
    larger = sizes.join(body, "doc_id").filter("size > body")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("size").desc()))
    return larger.select("doc_id", "size", F.least(rank, F.lit(LEVELS)).alias("level"))


def code_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of two lines or more with 90 % of their characters in a
    monospaced font. ``spans``: doc_id, page, block, line, n, mono."""
    g = spans.groupBy("doc_id", "page", "block").agg(F.count_distinct("line").alias("lines"), F.sum("n").alias("n"), F.sum(F.when(F.col("mono"), F.col("n")).otherwise(0)).alias("mono_n"))
    return g.filter((F.col("lines") >= 2) & (F.col("mono_n") >= CODE_SHARE * F.col("n")))


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose box meets no table's box on the page: an anti join on the
    page with the overlap as its condition. Both: doc_id, page, x0, y0, x1, y1."""
    t = tables.select("doc_id", "page", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    b, k = blocks.alias("b"), t.alias("t")
    meet = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & (F.col("x0") < F.col("tx1")) & (F.col("tx0") < F.col("x1")) & (F.col("y0") < F.col("ty1")) & (F.col("ty0") < F.col("y1"))
    return b.join(k, meet, "left_anti")


def heading_levels(blocks: DataFrame, bookmarks: DataFrame, levels: DataFrame) -> DataFrame:
    """A block's level: that of the first bookmark of its page that begins as
    the block does, or the other way round; else its font size's.
    ``blocks``: doc_id, page, block, text, size; ``bookmarks``: doc_id, page,
    ord, title, level; ``levels``: as ``font_levels``."""
    marks = bookmarks.select("doc_id", "page", "ord", "title", F.col("level").alias("mark_level"))
    hits = blocks.select("doc_id", "page", "block", "text").join(marks, ["doc_id", "page"]).filter((F.col("title") != "") & (F.startswith("text", "title") | F.startswith("title", "text")))
    first = hits.groupBy("doc_id", "page", "block").agg(F.min_by("mark_level", "ord").alias("mark_level"))
    return blocks.join(first, ["doc_id", "page", "block"], "left").join(levels, ["doc_id", "size"], "left").withColumn("level", F.coalesce("mark_level", "level")).drop("mark_level")


def contents_pages(pages: DataFrame) -> DataFrame:
    """Adds ``in_toc``: a titled page and the leader-like pages behind it.
    ``pages``: doc_id, page, titled, leader."""
    w = Window.partitionBy("doc_id").orderBy("page")
    runs = pages.withColumn("_run", F.sum((~F.col("titled") & ~F.col("leader")).cast("int")).over(w))
    inside = F.sum(F.col("titled").cast("int")).over(Window.partitionBy("doc_id", "_run").orderBy("page"))
    return runs.withColumn("in_toc", (F.col("titled") | F.col("leader")) & (inside > 0)).drop("_run")


def block_texts(spans: DataFrame) -> DataFrame:
    """One row per block: its spans' texts in order, joined by spaces, and the
    size of most of its characters, ties to the first. ``spans``: doc_id, page,
    block, ord, size, text."""
    keys = ["doc_id", "page", "block"]
    texts = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.trim("text").alias("t")))).alias("l"))
    sizes = spans.groupBy(*keys, F.bround("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("w"), F.min("ord").alias("first"))
    main = sizes.groupBy(*keys).agg(F.max_by("size", F.struct("w", (-F.col("first")).alias("f"))).alias("size"))
    joined = F.array_join(F.filter(F.transform("l", lambda x: x["t"]), lambda t: t != ""), " ")
    return texts.select(*keys, joined.alias("text")).join(main, keys)


def reading_order(items: DataFrame) -> DataFrame:
    """Adds ``pos``: items of a page from top to bottom and left to right, ties
    in the order they were found (``found``)."""
    return items.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "found")) - 1)


def page_items(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """One ordered stream of items a page: doc_id, page, pos, kind (table, image
    or prose), found (the item's number among those of its kind), x0, y0.

    ``blocks``, ``tables`` and ``images``: doc_id, page, found, x0, y0, x1, y1;
    tables also rows and cols. Tables of less than two rows or columns are none,
    and images with a side of less than 24 points are ornaments; prose whose box
    meets a table's is that table's text. At one place tables come first, then
    images, then prose."""
    grids = tables.filter((F.col("rows") >= LEAST_CELLS) & (F.col("cols") >= LEAST_CELLS))
    seen = images.filter((F.col("x1") - F.col("x0") >= LEAST_SIDE) & (F.col("y1") - F.col("y0") >= LEAST_SIDE))
    prose = outside_tables(blocks, grids)
    parts = [rows.select("doc_id", "page", "x0", "y0", "found", F.lit(kind).alias("kind"), F.lit(rank).alias("_rank")) for rank, (kind, rows) in enumerate((("table", grids), ("image", seen), ("prose", prose)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "_rank", "found")) - 1
    return every.select("doc_id", "page", place.alias("pos"), "kind", "found", "x0", "y0")


def leader_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page, titled, leader of each page, as ``contents_pages`` takes
    them. ``lines``: doc_id, page, pos, text. A page is titled if its first line
    that isn't blank names a table of contents, and leader-like by the share of
    its lines that are entries."""
    listed = lines.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("lines"))
    first = F.try_element_at(F.filter("lines", lambda x: ~is_blank(x)), F.lit(1))
    return listed.select("doc_id", "page", F.coalesce(is_toc_title(first), F.lit(False)).alias("titled"), is_toc_page(F.col("lines")).alias("leader"))
