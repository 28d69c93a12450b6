"""Connected components of a link table, by contraction.

Each round maps every vertex to the smallest of itself and its neighbours and
contracts the links; labels follow. Rounds grow with the logarithm of a
component's diameter. All steps are joins and aggregations of the link table;
each round is written, so that a lost executor repeats one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: a, b. v, comp for every vertex with a link to another one;
    comp is the smallest vertex of the component."""
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("m")))
        hop = materialize(ends.groupBy("v").agg(F.min("m").alias("m")).select("v", F.least("v", "m").alias("m")), "hop")
        if labels is None:
            labels = hop.select("v", F.col("m").alias("comp"))
        else:
            step = hop.select(F.col("v").alias("comp"), "m")
            labels = materialize(labels.join(step, "comp", "left").select("v", F.coalesce("m", "comp").alias("comp")), "labels")
        to_a, to_b = hop.select(F.col("v").alias("a"), F.col("m").alias("ma")), hop.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
        edges = materialize(moved.distinct(), "links")
    return labels
