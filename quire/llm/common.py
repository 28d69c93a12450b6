"""What several corpus operators need: tables, scratch space, folds."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: ASCII white space, as the word definitions of the corpus queries have it.
ASCII_WORD = r"[^\x20\x09-\x0D]+"
#: Most labels of a sample, and characters of text in all.
MOST_LABELS, SAMPLE_TOTAL = 10_000, 24_000_000
#: Most bytes of an Arrow batch of rows.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    that is unset a temporary folder takes its place in local mode; on a cluster
    it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it again. It
    stays there until ``discard`` or whoever clears that folder removes it.

    A lost executor costs nothing that was written, and later jobs do not run
    the work before it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    gc.collect()  # shuffles of steps that nothing refers to any more are removed
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES``: what a Python worker and the
    buffers before it hold must not grow with the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name, "64m")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes(setting: str) -> int:
    digits = setting.rstrip("bB").lower()
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits.rstrip("kmgt")) << unit


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0's
    place of the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ASCII_WORD)).cast("long")


def bounded_sample(marks: DataFrame, texts: DataFrame, per_label: int, max_chars: int) -> list[tuple]:
    """(label, text) pairs to fit a classifier on: of each label about
    ``per_label`` rows, spread over all rows by a hash of the id, and no more
    than ``max_chars`` characters of text (a longer text is passed over), all
    labels together no more than ``SAMPLE_TOTAL``. Over ``MOST_LABELS`` labels
    are an error.

    ``marks``: id, label. ``texts``: id, text. Null and empty texts are left
    out, and of rows that repeat an id and a text all but one, before anything
    leaves the tasks; of a label the first ``2 * per_label`` texts are looked
    at, and only their ids, lengths and hashes, then the chosen texts, reach the
    driver."""
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels")
    if not counts:
        return []
    max_chars = min(max_chars, SAMPLE_TOTAL // len(counts))
    spark, label_type = marks.sparkSession, marks.schema["label"].dataType
    shares = spark.createDataFrame([(label, min(1.0, per_label / n)) for label, n in counts.items()], StructType([StructField("label", label_type), StructField("share", DoubleType())]))
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.join(F.broadcast(shares), "label").withColumn("spread", spread).filter("spread < share").drop("share")
    sized = texts.join(F.broadcast(chosen), "id").select("id", "label", "spread", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    each = sized.filter((F.col("n") > 0) & (F.col("n") <= max_chars)).distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("spread", "id", "n", "h"))
    seen = each.withColumn("place", place).filter(F.col("place") <= 2 * per_label).orderBy("spread", "id", "n", "h").collect()
    left = dict.fromkeys(counts, max_chars)
    ids = []
    for r in seen:
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            ids.append((r["id"], r["label"], r["h"]))
    if not ids:
        return []
    wanted = spark.createDataFrame(ids, each.select("id", "label", "h").schema)
    found = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "h"]).dropDuplicates(["id", "h", "label"]).select("id", "label", "text").collect()
    return [(r["label"], r["text"]) for r in sorted(found, key=lambda r: (r["id"], r["text"]))]
