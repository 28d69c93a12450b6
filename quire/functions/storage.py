"""Scratch space that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a temporary
    folder takes its place in local mode; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Scratch tables that were written and not removed.
_WRITTEN: list[str] = []


def saved(df: DataFrame, label: str) -> DataFrame:
    """Written to scratch space and read again: what follows uses the table
    several times without running the work before it again. It stays until
    ``clear_scratch`` or whoever clears that folder removes it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Remove the tables of ``saved`` but for the first ``keep``: for a program
    that has written its results and goes on. Returns how many there were."""
    gone = _WRITTEN[keep:]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _WRITTEN[keep:]
    return len(gone)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """What is saved within goes at its end: results must be written by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        clear_scratch(spark, before)
