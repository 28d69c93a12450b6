"""Exact duplicates by content sort.

The texts themselves are sorted: Spark samples splitters, range-partitions rows
by text, sorts each range externally (it spills), and equal texts stand side by
side. Splitters are kept short: they hold the first ``HEAD`` characters and a
64-bit hash that orders texts with equal heads, so what Spark samples to the
driver does not depend on how long texts are. A window over the sorted run compares each full text with its neighbour
and opens a new group where they differ; the row with the largest id of a group
stays. Only DataFrame functions run.

A text that holds a large share of all rows would fall into one range. Such
texts are found first from counts of a 64-bit hash (combined on the map side).
A text is hot when it has more than 1/(4 x shuffle partitions) of the rows, so
there are at most 4 x shuffle partitions of them at any input size; that list
is the only thing broadcast. Rows of a hot text get a salt behind the text in
the sort key, so that their run spreads over many ranges, and the largest id
and the count of the whole run come from a partial aggregation over the full
texts, one row a text and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import shuffle_partitions

#: Characters of a text in the splitters.
HEAD = 32


def sort_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, carry: bool = True) -> DataFrame:
    """One row per input row: ``row`` (struct of the input columns but the
    text), ``key`` (normalised text), ``text_null``, ``keep_id``, ``group_size``,
    ``rank`` (1: the row that stays) and ``sha``.

    ``key`` normalises the text; the default changes nothing. Null text counts
    as empty. Null ids come last, so they stay only in groups without any id.
    Rows that repeat an id and a text have ranks of their own: one of them
    stays. An empty table gives an empty result. Input columns live in ``row``,
    so their names cannot clash with ours. ``carry`` False keeps only the id.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col) if key is None else key, F.lit(""))
    others = [c for c in docs.columns if c != text_col] if carry else [id_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(id_col).alias("id"),
        text.alias("key"),
        F.col(text_col).isNull().alias("text_null"),
    )

    least = docs.count() // (4 * parts) + 1
    hashed = rows.select("id", "key", F.xxhash64("key").alias("h"))
    counts = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    hot = (
        hashed.join(F.broadcast(counts), "h")
        .groupBy("key")
        .agg(F.max("id").alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
        .select(F.sha2("key", 256).alias("sha"), "hot_keep", "hot_size")
    )

    runs = (
        rows.withColumn("sha", F.sha2("key", 256))
        .join(F.broadcast(hot), "sha", "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.floor(F.col("hot_size") / least) + 1), F.lit(0)))
        .withColumns({"head": F.substring("key", 1, HEAD), "h": F.xxhash64("key")})
        .repartitionByRange(parts, "head", "h", "salt")
    )
    run = Window.partitionBy("head", "h", "salt", "key")
    order = run.orderBy(F.col("id").desc_nulls_last())
    first = F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return runs.select(
        "row",
        "id",
        "key",
        "text_null",
        "sha",
        F.row_number().over(order).alias("run_rank"),
        first.alias("run_keep"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        "hot_keep",
        "hot_size",
    ).select(
        "row",
        "id",
        "key",
        "text_null",
        "sha",
        F.when(F.col("hot_size").isNull(), F.col("run_keep")).otherwise(F.col("hot_keep")).alias("keep_id"),
        F.coalesce("hot_size", "run_size").alias("group_size"),
        # In a hot text's runs only the first row that has the largest id stays.
        F.when(F.col("hot_size").isNull() | F.col("id").eqNullSafe(F.col("hot_keep")), F.col("run_rank")).otherwise(F.lit(2)).alias("rank"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    return sort_groups(docs, id_col, text_col, key, carry=False).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("rank") == 1).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns and types they came with. Null
    texts and empty ones are one group, of which the row that stays keeps its
    own; null ids lose to any id; of rows that repeat one stays; an empty table
    gives an empty result; columns may have any names."""
    kept = sort_groups(docs, id_col, text_col).filter(F.col("rank") == 1)
    text = F.when(~F.col("text_null"), F.col("key"))
    return kept.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
