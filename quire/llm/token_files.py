"""Token-id output: one wavelet-matrix file per shard.

Documents are range-partitioned by id (sampled splitters), so shard s holds
smaller ids than shard s+1. A task encodes its shard in id order and cuts it
into blocks of about ``BLOCK_IDS`` ids, each a wavelet matrix (bit planes and
their rank tables) with the ids and lengths of its documents, so memory is
bounded whatever a shard holds. Spark's writer commits one compressed file a
shard to the shared folder: a lost task is run again and leaves nothing
half-written, and any store that Spark writes to will do.

From the files alone, ``tokens_at`` reads ids at positions, ``count_tokens``
counts occurrences and ``find_tokens`` lists them; none decodes a block."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch_path, shuffle_partitions, small_batches
from quire.llm.tokens import END_ID, default_vocabulary, encode_documents
from quire.llm.wavelet import WaveletMatrix

#: Ids after which a block ends; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Most different tokens of one lookup (a vocabulary has fewer).
MOST_TOKENS = 1 << 20
FILE_SCHEMA = "shard int, block int, block_start long, n_docs int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, planes array<binary>, ranks array<binary>"
ARROW_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("block_start", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None) -> None:
    """Write the ids of every whole text, in ascending id order, to ``path``.

    Null and empty texts are the end id alone. Null ids come first; rows that
    repeat an id are ordered by a hash of their text. A very long text has a
    block of its own. An empty table writes no block. Ids must be numbers, or
    texts of whole numbers. Only the id and text columns are read."""
    vocabulary = vocabulary or default_vocabulary()
    shards = shards or shuffle_partitions(docs.sparkSession)

    def encode_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            planes, ranks = WaveletMatrix.build(ids).to_parts()
            row = {"shard": shard, "block": block, "block_start": start, "n_docs": len(parts), "n_ids": len(ids), "doc_ids": doc_ids, "lengths": [len(p) for p in parts], "planes": planes, "ranks": ranks}
            return pa.RecordBatch.from_pylist([row], schema=ARROW_SCHEMA)

        for batch in batches:
            names, texts = batch.column("id").to_pylist(), batch.column("text")
            for name, ids in zip(names, encode_documents(vocabulary, texts, end_id), strict=True):
                doc_ids.append(name)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush()
                    block, start, held, doc_ids, parts = block + 1, start + held, 0, [], []
        if parts:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    ordered.mapInArrow(encode_shard, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The files' blocks, with ``begin``: ids in all before each. A shard's
    begin comes from one row a shard, as many as there were range partitions."""
    small_batches(spark)
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    return blocks.join(F.broadcast(starts), "shard").withColumn("begin", F.col("shard_start") + F.col("block_start"))


def _matrix(row) -> WaveletMatrix:
    return WaveletMatrix.from_parts(list(row.planes), list(row.ranks), int(row.n_ids))


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files: id, start (ids of all documents
    before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = _matrix(row).decode().astype("<u4")
                lengths = np.asarray(row.lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64"), "start": row.begin + begins, "n_tokens": lengths, "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]})

    decoded = _blocks(spark, path).select("begin", "n_ids", "doc_ids", "lengths", "planes", "ranks").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return decoded.withColumnRenamed("doc_id", id_col)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position, token for each different ``position`` (counted over all
    shards); positions outside the corpus and nulls have no row.

    Blocks and positions meet on cells of ``BLOCK_IDS`` positions; only blocks
    that hold a wanted position are read through."""
    blocks = _blocks(spark, path).withColumn("end", F.col("begin") + F.col("n_ids"))
    cell = lambda c: F.floor(c / BLOCK_IDS)
    places = blocks.select("begin", "end", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end") - 1))).alias("cell"))
    wanted = positions.select("position").distinct().withColumn("cell", cell(F.col("position")))
    hits = wanted.join(places, "cell").filter((F.col("position") >= F.col("begin")) & (F.col("position") < F.col("end")))
    # One list a block and slice of 2^16 positions of it.
    lists = hits.groupBy("begin", F.floor((F.col("position") - F.col("begin")) / (1 << 16)).alias("part")).agg(F.collect_list("position").alias("positions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at = np.asarray(row.positions, np.int64)
                yield pd.DataFrame({"position": at, "token": _matrix(row).access(at - row.begin)})

    return lists.join(blocks, "begin").select("begin", "n_ids", "planes", "ranks", "positions").mapInPandas(read, "position long, token long")


def _wanted(tokens: list[int]) -> np.ndarray:
    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"at most {MOST_TOKENS} tokens a lookup")
    return np.unique(np.array([t for t in tokens if t >= 0], np.int64))


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each different token in the whole corpus, 0 too."""
    wanted = _wanted(tokens)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(wanted), np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                total += _matrix(row).count(wanted)
        yield pd.DataFrame({"token": wanted, "n": total})

    none = spark.createDataFrame(pd.DataFrame({"token": wanted, "n": np.zeros(len(wanted), np.int64)}), "token long, n long")
    found = _blocks(spark, path).select("n_ids", "planes", "ranks").mapInPandas(count, "token long, n long")
    return found.unionByName(none).groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: list[int], id_col: str = "doc_id") -> DataFrame:
    """token, position (over all shards), id of its document and the place in
    it, one row per occurrence."""
    wanted = _wanted(tokens)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                matrix, ends = _matrix(row), np.cumsum(np.asarray(row.lengths, np.int64))
                names = pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], dtype="Int64")
                for token in wanted[matrix.count(wanted) > 0].tolist():
                    at = matrix.positions(token)
                    doc = np.searchsorted(ends, at, side="right")
                    yield pd.DataFrame({"token": token, "position": row.begin + at, "doc_id": names[doc], "place": at - np.r_[0, ends][doc]})

    return _blocks(spark, path).select("begin", "n_ids", "doc_ids", "lengths", "planes", "ranks").mapInPandas(find, "token long, position long, doc_id long, place long").withColumnRenamed("doc_id", id_col)


def token_index(docs: DataFrame, **options) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, **options)
    return read_token_files(docs.sparkSession, path, options.get("id_col", "doc_id"))
