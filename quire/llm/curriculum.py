"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over the training time t in [0, 1]: a line
``w(t) = w * (1 + a * (2t - 1))``, whose mean is the source's weight w. Its
integral, normalised, is ``G(t) = t + a * (t * t - t)``. A source's documents,
in the order of the md5 of their ids, form a stream that repeats until the
source's target is met. The word that comes after ``y * target`` words of the
stream is due when ``G(t) = y``, so a document's training position is the
inverse of G at its cumulative offset. Documents are range-sorted by position.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share
all words; a target stops at ``max_epochs`` times its source's size and the
excess is shared by weight again, until none is above. That fixed point is
water-filling: sorted by cap/weight, the capped sources are a prefix.

Offsets are prefix sums over a source, and one source may hold a third of all
rows, so no window runs over a source's rows. The md5 order cuts a source into
256 x 256 cells; sums go up (cell, then slice, then source) by partial
aggregation, prefixes come down again, and only the rows of one cell are ever
ordered together. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, word_count

#: Weights by rank of the source, repeating; and the slopes of their schedules.
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: k, source, source_size, one row a source. Adds target and slope.

    The windows here see one row for each source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": _pick(weights, F.col("rank")), "slope": _pick(slopes, F.col("rank")), "cap": F.col("source_size") * max_epochs})
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    upto = ranked.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()),
            "capped_before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weight_from": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = upto.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    free = level.withColumn("open", F.col("cap") >= F.col("weight") * F.col("level"))
    water = free.withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(Window.partitionBy()).getField("level"))
    return water.select(
        "k",
        "source_size",
        "slope",
        F.when(F.col("open"), F.least(F.col("weight") * F.col("water"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def due(share: Column, slope: Column) -> Column:
    """The inverse of G: when the given share of a source's words is due."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, **mix) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words the
    mix takes, repeats counted; the last document of a source's stream may be
    taken in part), offset (words before it in the stream), slope, and ``row``
    (all input columns) with ``carry``.

    Null text and text without words have size 0 and nothing is taken of them.
    A null source is a source. Null ids come first. Rows that repeat an id are
    rows of their own, in the order of their sizes. An empty table gives an
    empty result. Very long texts are counted whole. Names cannot clash: input
    columns live in ``row``.
    """
    # Rows without an id are spread by their texts.
    h = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.col(text_col)), F.lit("")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
        h.alias("h"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("k"),
        F.substring(h, 1, 2).alias("a"),
        F.substring(h, 3, 2).alias("b"),
    )
    if not carry:
        rows = materialize(rows, "mix-sizes")
    cells = materialize(rows.groupBy("k", "a", "b").agg(F.first("source").alias("source"), F.sum("size").alias("n")), "mix-cells")

    slices = cells.groupBy("k", "a").agg(F.first("source").alias("source"), F.sum("n").alias("n"))
    before_a = F.sum("n").over(Window.partitionBy("k").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("k", "a", F.coalesce(before_a, F.lit(0)).alias("before_a"))
    sizes = cells.groupBy("k").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    slices = slices.join(source_targets(sizes, **mix), "k")

    before_b = F.sum("n").over(Window.partitionBy("k", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("k", "a", "b", F.coalesce(before_b, F.lit(0)).alias("before_b")).join(slices, ["k", "a"])

    inside = Window.partitionBy("k", "a", "b").orderBy("h", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["k", "a", "b"])
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    offset = F.col("before_a") + F.col("before_b") + F.col("before")
    rest = goal - whole * F.col("source_size") - offset
    return placed.select(
        *(["row"] if carry else []),
        "id",
        "h",
        "size",
        "source_size",
        "target",
        "slope",
        offset.alias("offset"),
        (whole * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """One row per document with its first training position (null where
    nothing is taken), range-sorted by it.

    Null texts and texts without words have size 0 and no position; null sources
    are a source, the last one; rows with null ids are ordered by their texts;
    rows that repeat have a row and a place each; an empty table gives an empty
    result; other columns, whatever their names, are not read."""
    placed = place(docs, id_col, text_col, source_col, **mix)
    at = F.when(F.col("taken") > 0, due(F.col("offset") / F.col("target"), F.col("slope")))
    return (
        placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", at.alias("position"), "h")
        .orderBy(F.col("position").asc_nulls_last(), "h")
        .drop("h")
    )


def training_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mix) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with
    the columns they came with.

    Documents stay whole here: the one that a source's target cuts comes once
    more if at least half of it is taken, so a source is off by half a document
    at most. A document without words takes no part in a mix of words; it comes
    once, at its source's offset. Nulls, repeats and empty tables are as in
    ``mixture``; all columns are carried, whatever their names."""
    placed = place(docs, id_col, text_col, source_col, carry=True, **mix)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5)).cast("int")
    each = placed.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.least((F.col("copy") * F.col("source_size") + F.col("offset")) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
    return (
        each.withColumn("position", due(share, F.col("slope")))
        .orderBy("position", "h", "copy")
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    )
