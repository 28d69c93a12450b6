"""Progress events as streams: latest state, idle projects, stage rollups.

Events carry no event-time contract, so there are no watermarks: the latest
event of a key wins by (time, id), and idleness is by processing time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.storage import scratch


def event_stream(spark: SparkSession, folder: str, name: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder, by a pattern of their names, as a stream."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def latest(events: DataFrame, key: str, order: Column, value: Column) -> DataFrame:
    """The latest event of each key; the same in batch and in a stream."""
    return events.groupBy(key).agg(F.max_by(value, order).alias("last"), F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there (availableNow) and return its last
    result. Each micro-batch writes a version; the last one is read back."""
    spark = stream.sparkSession
    out, state = scratch(spark, label), scratch(spark, f"{label}-state")
    versions: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={number}")
        versions.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not versions:
        return spark.createDataFrame([], stream.schema)
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{out}/v={versions[-1]}") if mode == "complete" else read.parquet(*[f"{out}/v={v}" for v in versions])


def idle_projects(events: DataFrame, key: str, timeout_ms: int = 60_000) -> DataFrame:
    """A stream of keys that sent nothing for ``timeout_ms`` of processing time."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({key: [str(name[0])], "events": [n]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(timeout_ms)

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, events long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def paused(control: DataFrame, key: str) -> DataFrame:
    """Keys whose last control row asks for a pause (checked between batches)."""
    return control.groupBy(key).agg(F.max_by("paused", "ts").alias("paused")).filter("paused").select(key)
