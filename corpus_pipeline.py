"""From raw documents to packed training sequences.

Five stages, each on all that its predecessor kept: documents scored toxic go;
of equal texts one stays; of near duplicates (five-word shingles, similarity of
0.8 or more) one stays; sources are mixed to their target weights along the
curriculum; and the stream is packed into windows of 2048 tokens. All but the
last return the columns of ``documents``, with whatever others came along: they
are carried through, and their names may be those that operators use themselves.
An empty table goes through every stage as an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import materialize, table
from quire.llm.curriculum import training_stream
from quire.llm.exact_dedup import drop_exact_duplicates
from quire.llm.jaccard_join import drop_near_duplicates
from quire.llm.packing import pack_documents
from quire.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learned from ``labels``. Null and empty
    texts and ids are clean; repeated rows are scored alike; very long texts are
    scored whole; without usable labels, or of an empty table, nothing goes."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id. Null counts as empty text; a
    null id stays only where its group has no other; of repeated rows one stays;
    very long texts are compared whole; an empty table gives an empty one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the one
    with the smallest id. Null, empty and wordless texts stay; a text of fewer
    words is one shingle; very long texts are compared whole; rows that repeat
    an id and a text stay or go together; an empty table gives an empty one."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's target
    takes it. A null source is a source; documents without words come once; rows
    that repeat are documents of their own; very long texts are counted whole
    and taken whole; an empty table gives an empty one."""
    return training_stream(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token stream in windows of 2048. Null and empty texts are
    the end id alone; repeated and null ids are documents of their own; very
    long texts are cut over as many windows as they fill; an empty table gives
    no piece. Other columns are not read."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Training a classifier and packing tokens have no SQL; tests/llm compares the
#: stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
