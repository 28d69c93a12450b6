"""Places of rows in a total order, without one task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions


def ranked(rows: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """Adds ``at`` (place in the row's group, from 0) and ``n`` (rows of the
    group). A null is a group like any other.

    Rows are range-partitioned by group and order, so a group of any size lies
    over as many ranges as it fills, and each range numbers its own rows; the
    rows that earlier ranges hold of the group come from one count for each
    group and range. Rows that are equal in group and order are told apart by
    where they were read, so that they too may lie in several ranges."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(shuffle_partitions(rows.sparkSession), *group, *order, "_tie")
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), label)
    counts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_range").alias("_of"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order, "_tie"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group], F.col("_range") == F.col("_of"))
    return dealt.withColumn("_own", own).join(counts, same).select(*rows.columns, (F.col("_before") + F.col("_own") - 1).cast("long").alias("at"), F.col("n").cast("long").alias("n"))
