"""Importance resampling towards a target distribution.

Features are hashed into buckets; what the target (``benchmark``) holds of a
bucket against what the documents hold is the bucket's gain, and a document
weighs the mean gain of its features. Gumbel noise from the id makes the highest
scores a draw without replacement in proportion to the weights.

Buckets are counted in one pass, a task adding its rows up in one array, and the
gains go to the tasks as an array, for a second pass over the texts. Scores are
persisted. The cutoff comes from exact counts over that small table: bisection
first on the score, then, among rows with the cutoff's score, on the id, then
among rows equal in both on where they are stored. The rows above it are
range-partitioned for their ranks; nothing is sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, small_batches
from quire.llm.ranks import ranked

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
PERCENT, LEAST_WORDS = 10, 20
#: Most buckets: an array of so many numbers goes to every task.
MOST_BUCKETS = 1 << 22
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20
#: Values that one count job tries.
PIVOTS = 15
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Letters and digits of ASCII, lower-cased, and all other bytes of words;
#: separators are blanks.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size (but for a single
    word that is longer)."""
    start, rest = 0, b""
    while start < len(text):
        piece = rest + text[start : start + PART].translate(_LOWER)
        start += PART
        cut = len(piece) if start >= len(text) else piece.rfind(b" ") + 1
        rest = piece[cut:]
        yield piece[:cut].split()


def buckets_of(text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[np.ndarray]:
    """Buckets of all features, in arrays of bounded size."""
    before: list[bytes] = []
    for words in word_parts(text):
        every, k = before + words, len(before)
        for n in range(1, longest + 1):
            first = max(k - n + 1, 0)
            grams = words if n == 1 else [b" ".join(every[i : i + n]) for i in range(first, len(every) - n + 1)]
            yield np.fromiter(map(crc32, grams), np.uint32, len(grams)) % buckets
        before = every[-(longest - 1) :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket. A task sends one row a bucket; ``buckets`` sums
    reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found in buckets_of(text.as_py(), buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    rows = texts.select(F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text is not null")
    sums = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in sums:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's share / corpus's share)) of each bucket, with one
    more feature in each."""
    s, t = float(corpus.sum()) + len(corpus), float(target.sum()) + len(corpus)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight (mean gain, rounded down) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, weights = [], [], []
            for text in batch.column(1):
                n_words = n = total = 0
                for k, found in enumerate(buckets_of(text.as_py() or b"", len(gain), longest)):
                    n_words += len(found) if k % longest == 0 else 0
                    n += len(found)
                    total += int(gain[found].sum())
                words.append(n_words)
                sizes.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (words, sizes, weights)]], names=["id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for u from the first 32 bits of sha256(seed:id)."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def least_with(rows: DataFrame, value: Column, count: int, low: int, high: int) -> tuple[int, int]:
    """The least v of [low, high] so that ``count`` rows or more have a value of
    v or less, and how many have less than v. Each job counts exactly at
    ``PIVOTS`` places; null values are in no count."""
    while low < high:
        step = -(-(high - low) // (PIVOTS + 1))
        tried = list(range(low + step - 1, high, step))
        held = rows.agg(*[F.count(F.when(value <= p, True)) for p in tried]).first()
        for p, n in zip(tried, held, strict=True):
            if n >= count:
                high = p
                break
            low = p + 1
    return low, rows.filter(value < low).count()


def draw(scored: DataFrame, count: int) -> Column | None:
    """The condition that holds for exactly the ``count`` first rows by score
    (highest first), id (smallest first, nulls last) and ``tie``."""
    if count < 1:
        return None
    score, key, tie = -F.col("score"), F.coalesce("id", F.lit(_LONG[1])), F.col("tie")
    chosen, left = None, count
    for column in (score, key, tie):
        ends = scored.agg(F.min(column), F.max(column)).first()
        cut, before = least_with(scored, column, left, ends[0], ends[1])
        above = column < cut if chosen is None else chosen[1] & (column < cut)
        at = column == cut if chosen is None else chosen[1] & (column == cut)
        chosen = (above if chosen is None else chosen[0] | above, at)
        left -= before
        scored = scored.filter(column == cut)
        if scored.count() == left:
            break
    return chosen[0] | chosen[1]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per document: its id, n_features, weight, score, and rank (1 is
    the highest score) of the documents that are drawn: ``percent`` of those
    with at least ``least_words`` words, rounded down.

    Null and empty texts have no features and weigh 0. Ids are integers; a null
    id counts as an empty one for the noise and comes last among ties. Rows that
    repeat an id are documents of their own with the same noise; rows equal in
    score and id go in the order in which they are stored. Very long texts are
    read whole, a part at a time. An empty target leaves gains that are still
    defined; an empty table gives an empty result. Other columns are not read."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    weighed = weigh(docs, gain, longest, id_col, text_col)
    scored = weighed.select("id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"), F.monotonically_increasing_id().alias("tie"))
    scored = materialize(scored, "importance-scores")
    able = scored.filter(F.col("n_words") >= least_words)
    first = draw(able, percent * able.count() // 100)
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if first is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & first
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")]
    ranks = ranked(scored.filter(drawn), [], order, "importance-drawn").select(*out, (F.col("at") + 1).alias("rank"))
    return ranks.unionByName(scored.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
