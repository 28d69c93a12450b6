"""Queries that run as streams over several micro-batches, with batch SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.storage import scratch
from quire.plans.common import table
from quire.plans.store import ORACLES as STORED
from quire.plans.store import TRANSITIONS
from quire.streaming import progress, runs, stateful

#: Files, and so micro-batches, that a stream's rows are dealt to.
ARRIVALS = 3


def arriving(rows: DataFrame, part: Column, label: str) -> DataFrame:
    """A stream of the rows in ``ARRIVALS`` files, one a micro-batch, which
    arrive in the order of ``part`` (0, 1, ...)."""
    spark = rows.sparkSession
    folder = scratch(spark, label)
    for k in range(ARRIVALS):
        rows.filter(part == k).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def q91_stage_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stage machine as a stream; what is illegal goes to a side output."""
    events = table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    first, last = events.agg(F.min("us"), F.max("us")).first()
    part = F.least(F.floor((F.col("us") - first) * ARRIVALS / max(last - first, 1)), F.lit(ARRIVALS - 1))
    checked = stateful.check_stages(arriving(events, part, "events"), "user_id", ["us", "event_id"], "event_type", TRANSITIONS)
    out = progress.run_to_table(checked, "stages", mode="append")
    return out.filter("not legal").select("user_id", "event_id", "from_stage", "event_type")


def q92_event_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as frames of their conversation's connection, cut every 100 bytes."""
    turn = F.concat(F.lit(": turn\ndata: "), F.to_json(F.struct("turn", "text")), F.lit("\n\n"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("connection")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("frame")))).alias("l"))
    whole = c.select("connection", F.array_join(F.transform("l", lambda x: x["frame"]), "").cast("binary").alias("whole"))
    size = F.length("whole")
    chunks = whole.select("connection", "whole", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 100))).alias("seq")).select("connection", "seq", F.substring("whole", (F.col("seq") * 100 + 1).cast("int"), F.lit(100)).alias("chunk"), F.floor(F.col("seq") * 100 * ARRIVALS / size).cast("int").alias("part"))
    events = stateful.parse_frames(arriving(chunks, F.col("part"), "chunks").drop("part"))
    got = progress.run_to_table(events, "frames", mode="append").withColumn("e", F.from_json("payload", "turn long, text string"))
    return got.select(F.col("connection").cast("long").alias("conv_id"), "n", "e.turn", F.md5(F.col("e.text").cast("binary")).alias("text_md5"))


def q94_result_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as segments of a customer's book; results and usage are committed
    epoch by epoch."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", "o_totalprice")

    def work(batch: DataFrame) -> DataFrame:
        used = F.floor("o_totalprice").cast("long")
        failed = F.when(F.col("o_orderstatus") == "P", "refused")
        return batch.select("doc_id", "id", F.col("o_orderstatus").alias("new_target"), used.alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"), (used / 1e6).alias("cost_usd"), F.array().cast("array<string>").alias("flags"), failed.alias("error"))

    sink = runs.ResultSink(scratch(spark, "results"), work)
    stream = arriving(orders, F.pmod(F.xxhash64("id"), F.lit(ARRIVALS)), "orders")
    runs.run_until_paused(stream, sink, scratch(spark, "results-state"))
    tried = sink.results(spark).groupBy("doc_id").agg(F.count(F.lit(1)).alias("tried"), F.count("error").alias("failed"))
    used = sink.usage(spark).groupBy("doc_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("calls"))
    return tried.join(used, "doc_id")


QUERIES = {f.__name__: f for f in (q91_stage_stream, q92_event_frames, q94_result_sink)}
ORACLES = {
    "q91_stage_stream": STORED["q54_stage_violations"],
    "q92_event_frames": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, turn, md5(text) AS text_md5 FROM conversations",
    "q94_result_sink": "SELECT o_custkey AS doc_id, count(*) AS tried, count(*) FILTER (o_orderstatus = 'P') AS failed, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS prompt_tokens, count(*) AS calls FROM orders GROUP BY o_custkey",
}
