"""Runs as streams: results committed epoch by epoch, pauses, subscribers.

``foreachBatch`` may be given an epoch a second time, after a crash between its
work and the stream's own commit. What is written here is keyed by epoch and is
the same after a repeat; readers see an epoch once its marker is there, so the
tables of an epoch appear together or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import store

SEGMENT_FIELDS = ("doc_id", "id", "new_target", "prompt_tokens", "completion_tokens", "cost_usd", "flags", "error")
USAGE_FIELDS = ("doc_id", "id", "prompt_tokens", "completion_tokens", "cost_usd")


class EpochTables:
    """Named Parquet tables in a shared folder, each written by epoch."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _path(self, name: str, epoch: int) -> str:
        return f"{self.folder}/{name}/epoch={epoch}"

    def written(self, spark: SparkSession, name: str, epoch: int) -> bool:
        """Whether the table of that epoch was written to its end."""
        done = spark._jvm.org.apache.hadoop.fs.Path(self._path(name, epoch) + "/_SUCCESS")
        return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)

    def write(self, name: str, epoch: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path(name, epoch))
        return rows.sparkSession.read.schema(rows.schema).parquet(self._path(name, epoch))

    def remove(self, spark: SparkSession, name: str, epoch: int) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(self._path(name, epoch))
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def commit(self, spark: SparkSession, epoch: int) -> None:
        self.write("commits", epoch, spark.range(1).select(F.current_timestamp().alias("at")))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows of the committed epochs, with ``epoch``."""
        commits = spark.read.parquet(f"{self.folder}/commits").select("epoch")
        return spark.read.parquet(f"{self.folder}/{name}").join(commits, "epoch", "left_semi")


class ResultSink:
    """Translations and what they used, of each micro-batch of segments.

    ``work(segments) -> results`` (``SEGMENT_FIELDS``) runs once an epoch: its
    rows are staged first, and a repeated epoch takes those that are staged to
    their end instead of asking the model again."""

    def __init__(self, folder: str, work: Callable[[DataFrame], DataFrame]):
        self.tables, self.work = EpochTables(folder), work

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark, tables = batch.sparkSession, self.tables
        if tables.written(spark, "commits", epoch):
            return
        if tables.written(spark, "staged", epoch):
            rows = spark.read.parquet(tables._path("staged", epoch))
        else:
            rows = tables.write("staged", epoch, self.work(batch))
        tables.write("segments", epoch, rows.select(*SEGMENT_FIELDS))
        tables.write("usage", epoch, store.usage_rows(rows.select(*USAGE_FIELDS)))
        tables.commit(spark, epoch)

    def results(self, spark: SparkSession) -> DataFrame:
        """The last committed result of each segment."""
        rows = self.tables.read(spark, "segments")
        last = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.col("epoch").desc())) == 1
        return rows.withColumn("_last", last).filter("_last").drop("_last", "epoch")

    def usage(self, spark: SparkSession) -> DataFrame:
        return self.tables.read(spark, "usage")

    def segments(self, segments: DataFrame) -> DataFrame:
        """The segments with everything that was committed for them."""
        return store.record_translations(segments, self.results(segments.sparkSession))


class Paused(Exception):
    """Raised before a micro-batch's work, so that its epoch stays undone."""


def run_until_paused(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, should_pause: Callable[[], bool] | None = None) -> bool:
    """Run a stream over what is there. ``should_pause`` is asked before each
    micro-batch (e.g. ``pause_requested`` over a control table); where it says
    so, the stream stops before it touches that batch. Batches that began are
    finished. True: all was done; False: it was paused, and running it again
    with the same checkpoint goes on with the batch that was not begun."""
    stopped: list[int] = []

    def step(batch: DataFrame, epoch: int) -> None:
        if should_pause is not None and should_pause():
            stopped.append(epoch)
            raise Paused
        sink(batch, epoch)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped:
            raise
    return not stopped


def pause_requested(spark: SparkSession, folder: str, run: str) -> bool:
    """Whether the last control row of a run (run, paused, ts in Parquet files
    of a folder) asks for a pause; read anew at every call."""
    rows = spark.read.schema("run string, paused boolean, ts timestamp").parquet(folder).filter(F.col("run") == run)
    return bool(rows.agg(F.max_by("paused", "ts")).first()[0])


class Hub:
    """One source, read once, given to any number of subscribers.

    Each subscriber has an offset of its own, the last epoch that it took; one
    that fails keeps it, is told what it missed at the next micro-batch, and
    keeps no other back. A subscriber that comes later sees only later epochs.
    Epochs are kept as tables until every subscriber has taken them."""

    def __init__(self, folder: str):
        self.tables = EpochTables(folder)
        self.sinks: dict[str, Callable[[DataFrame, int], None]] = {}
        self.taken: dict[str, int] = {}
        self.last = -1
        self.removed = -1

    def subscribe(self, name: str, sink: Callable[[DataFrame, int], None], taken: int | None = None) -> None:
        """``taken``: the offset that an earlier life of the subscriber reached."""
        self.sinks[name], self.taken[name] = sink, self.last if taken is None else taken

    def unsubscribe(self, name: str) -> None:
        del self.sinks[name], self.taken[name]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if not self.tables.written(spark, "events", epoch):
            self.tables.write("events", epoch, batch)
        self.last = max(self.last, epoch)
        for name in list(self.sinks):
            self._deliver(spark, name)
        for old in range(self.removed + 1, min(self.taken.values(), default=self.last) + 1):
            self.tables.remove(spark, "events", old)
            self.removed = old

    def _deliver(self, spark: SparkSession, name: str) -> None:
        for epoch in range(self.taken[name] + 1, self.last + 1):
            try:
                self.sinks[name](spark.read.parquet(self.tables._path("events", epoch)), epoch)
            except Exception:  # a subscriber's failure is its own
                return
            self.taken[name] = epoch


