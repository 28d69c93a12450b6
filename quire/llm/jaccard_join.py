"""Exact n-gram Jaccard join with a token-group matrix.

A document is the set of its word shingles; two documents link when
``100 * |a & b| >= percent * |a | b|``. The result is connected components, so
links are found between groups and never listed within one.

1. Equal sets are one set (signature of 128 bits, combined on the map side).
2. Groups of similar sets: sets that share a min-hash band meet in chunks, each
   of which also holds a few of the band's sets that are the same for all its
   chunks. Within a chunk sets that look alike are compared, and those that link
   are one group. The links are exact; what this step misses, the next one finds.
3. Token-group matrix: a linking pair shares ``SHARED`` tokens among the rarest
   few of either set (prefix filter, in an order by corpus frequency), so the
   matrix holds each group's union of these tokens. Tokens that only one group
   holds are dropped. Sets query the groups of larger components; size and
   position bound the overlap from above, and a group qualifies if its union
   holds ``SHARED`` of the query's tokens (sets of fewer need all they must share).
4. A group that qualifies is opened: the query's overlap with the union of all
   the group's tokens must reach what the smallest member needs, and then the
   members are compared in full until one links.

Large groups are split into parts of ``PART`` sets, and the queries of one part
into chunks of ``CHUNK``, so no task holds more than a few hundred texts; every
qualifying pair is compared, whatever the size of a group.

What is sent to every task is bounded: the ``HEAVY`` most frequent tokens with
their ranks (blocks of the corpus count the tokens that repeat in them; all
other tokens are rare and in the order of their hashes - any order gives the
same result), and 2^17 flags that keep documents without a candidate from being
shuffled.

Sets go by 64-bit numbers while candidates are sought; should two sets share
one, both are compared. Links name sets by their signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, materialize, small_batches
from quire.llm.components import connected_components

WORDS, PERCENT = 5, 80
BANDS, PART, CHUNK = 4, 64, 256
SHARED, LEADERS, SKETCH, ALIKE = 4, 8, 16, 6
HEAVY, COUNT_BLOCK, REPEATS, FLAG_BITS = 1 << 19, 1_500_000, 3, 17
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BAND_KEYS = np.random.default_rng(7).integers(1, 2**63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words; a
    shorter text is one shingle, a text without words has none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
    k = min(words, n)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s = (s ^ h[j : n - k + 1 + j]) * _PLACES[j % 64] + (s >> np.uint64(31))
    return np.unique(mix(s))


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """``docs``: id, text. id, n, key (null without shingles) and bands; and
    rows with the tokens that repeat in a block of documents (heavy, counts)."""

    long, longs = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([("id", long), ("n", pa.int32()), ("key", pa.binary()), ("bands", longs), ("heavy", longs), ("counts", longs)])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        held = 0

        def repeated() -> pa.RecordBatch:
            token, c = np.unique(np.concatenate(block), return_counts=True)
            token, c = token[c >= REPEATS].view(np.int64), c[c >= REPEATS]
            return pa.RecordBatch.from_pydict({"id": [None], "n": [-1], "key": [None], "bands": [[]], "heavy": [token], "counts": [c]}, schema)

        for batch in batches:
            n, key, bands = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                key.append(signature(s) if len(s) else None)
                if not len(s):
                    bands.append([])
                    continue
                low = np.array([mix(s * k).min() for k in _BAND_KEYS], np.uint64)
                bands.append(mix(low[::2] * _MIX1 + low[1::2]).view(np.int64))
                block.append(s)
                held += len(s)
                if held >= COUNT_BLOCK:
                    yield repeated()
                    block, held = [], 0
            nothing = [None] * len(n)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": n, "key": key, "bands": bands, "heavy": nothing, "counts": nothing}, schema)
        if block:
            yield repeated()

    return docs.mapInArrow(build, "id long, n int, key binary, bands array<bigint>, heavy array<bigint>, counts array<bigint>")


def heavy_tokens(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the tokens that repeat (sorted) and their counts."""
    each = table.filter("heavy is not null").select(F.explode(F.arrays_zip("heavy", "counts")).alias("z"))
    counts = materialize(each.groupBy(F.col("z.heavy").alias("token")).agg(F.sum("z.counts").alias("c")), "heavy")
    least, room = 1, HEAVY
    for c, n in sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().collect()), reverse=True):
        room -= n
        if room < 0:
            least = c + 1
            break
    found = counts.filter(F.col("c") >= least).toArrow()
    token, c = found.column("token").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(token)
    return token[order], c[order]


def rarity(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    token, c = heavy
    if not len(token):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, c[at], 0)


def band_links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links q, s between sets that share a band, enough to join most that link.

    Bands with the same sets have the same leaders and are compared once."""
    banded = sets.select("sid", F.posexplode("bands").alias("band", "value"))
    lead = [F.min(F.when(F.pmod(F.xxhash64("sid"), F.lit(LEADERS)) == j, F.col("sid"))) for j in range(LEADERS)]
    buckets = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c"), F.array_compact(F.array(*lead)).alias("leaders")).filter("c > 1")
    buckets = materialize(buckets.select("band", "value", "leaders", F.xxhash64("leaders", "c").alias("g"), F.ceil(F.col("c") / CHUNK).cast("int").alias("chunks")), "bands")
    dealt = banded.join(buckets.select("band", "value", "g", "chunks"), ["band", "value"]).select("g", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int").alias("chunk"), "sid")
    once = buckets.filter("chunks > 1").dropDuplicates(["g"])
    leaders = once.select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "leaders").select("g", "chunk", F.explode("leaders").alias("sid"))
    roles = dealt.unionByName(leaders).distinct().withColumn("asks", F.lit(0))
    rows = with_texts(docs, sets, roles)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, sketches, root = None, [], np.zeros((0, SKETCH), np.uint64), []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for pdf in batches:
            out = []
            for g, chunk, _, key, text in pdf.itertuples(index=False, name=None):
                if at != (g, chunk):
                    at, held, sketches, root = (g, chunk), [], np.zeros((0, SKETCH), np.uint64), []
                s = shingles(text, words)
                if signature(s) != bytes(key):
                    continue
                sketch = np.resize(s[:SKETCH], SKETCH) if len(s) else np.zeros(SKETCH, np.uint64)
                me = len(held)
                root.append(me)
                alike = np.isin(sketches, sketch).sum(1) >= ALIKE
                for i in np.flatnonzero(alike)[::-1].tolist():
                    if top(i) != top(me) and linked(s, held[i][1], percent):
                        out.append((key, held[i][0]))
                        root[top(i)] = top(me)
                held.append((key, s))
                sketches = np.vstack((sketches, sketch))
            if out:
                yield pd.DataFrame(out, columns=["q", "s"])

    return rows.mapInPandas(link, "q binary, s binary")


def with_texts(docs: DataFrame, sets: DataFrame, roles: DataFrame) -> DataFrame:
    """``roles``: g, chunk, asks, sid. g, chunk, asks, key, text, with a chunk's
    rows together and those that do not ask first.

    The text of a set is fetched by the id that stands for it; documents that
    share an id with another are told by their signature."""
    roles = materialize(roles.join(sets.select("sid", "key", "id"), "sid").drop("sid"), "roles")
    flag = F.pmod(F.xxhash64("id"), F.lit(1 << FLAG_BITS))
    flags = roles.select(flag.alias("flag")).distinct()
    texts = docs.withColumn("flag", flag).join(F.broadcast(flags), "flag", "left_semi").select("id", "text")
    rows = roles.join(texts, "id").select("g", "chunk", "asks", "key", "text")
    return rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "asks")


def verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """``pairs``: q, g (sets that query groups, by their numbers). ``members``:
    sid, g. Links q, s, by signature: for each pair the first member that q
    links with, if any."""
    sizes = pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    asks = pairs.join(sizes, "g").select("g", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("asks"), F.col("q").alias("sid"))
    holds = members.join(sizes, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("asks"), "sid")
    rows = with_texts(docs, sets, asks.unionByName(holds))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, union = None, [], None
        for pdf in batches:
            out = []
            for g, chunk, asks_, key, text in pdf.itertuples(index=False, name=None):
                if at != (g, chunk):
                    at, held, union = (g, chunk), [], None
                s = shingles(text, words)
                if signature(s) != bytes(key):
                    continue
                if not asks_:
                    held.append((key, s))
                    continue
                near = [(k, m) for k, m in held if 100 * min(len(m), len(s)) >= percent * max(len(m), len(s))]
                if not near:
                    continue
                if len(held) > 1:  # overlap with the group's union bounds that with each member
                    if union is None:
                        union = np.unique(np.concatenate([m for _, m in held]))
                    least = min(len(m) for _, m in near)
                    if (100 + percent) * np.isin(s, union, assume_unique=True).sum() < percent * (len(s) + least):
                        continue
                hit = next((k for k, m in near if linked(s, m, percent)), None)
                if hit is not None:
                    out.append((key, hit))
            if out:
                yield pd.DataFrame(out, columns=["q", "s"])

    return rows.mapInPandas(compare, "q binary, s binary")


def prefixes(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """``docs``: id, text. key, tokens: the rarest tokens of each set, as
    many as hold ``SHARED`` that a linking pair has in common, rarest first."""

    schema = pa.schema([("key", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, tokens = [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                if not len(s):
                    continue
                key.append(signature(s))
                least = -(-percent * len(s) // 100)
                few = len(s) - least + min(SHARED, least)
                often = rarity(s, heavy)
                tokens.append(s[np.argsort(often, kind="stable")][:few].view(np.int64))  # s is sorted
            yield pa.RecordBatch.from_pydict({"key": key, "tokens": tokens}, schema)

    return docs.select("text").mapInArrow(cut, "key binary, tokens array<bigint>")


def group_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (id, n, key) and sets (key, first_id, comp_id,
    comp_key): the smallest id that holds the set, the smallest id of the
    set's component, and the set that stands for the component."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = materialize(set_table(docs, words), "sets")
    each = table.filter("heavy is null").select("id", "n", "key")
    full = table.filter("key is not null")
    sets = full.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = materialize(sets.withColumn("sid", F.xxhash64("key")), "distinct-sets")

    stars = materialize(band_links(docs, sets, words, percent), "band-links")
    first = connected_components(stars.select(F.col("q").alias("a"), F.col("s").alias("b")))
    placed = sets.select("key", "sid", "n").join(first.select(F.col("v").alias("key"), "comp"), "key", "left")
    placed = placed.select("sid", "n", F.xxhash64(F.coalesce("comp", "key")).alias("comp"))
    placed = materialize(placed.join(placed.groupBy("comp").agg(F.count(F.lit(1)).alias("held")), "comp"), "groups")

    # The token-group matrix, over tokens that more than one group holds.
    heads = prefixes(docs, heavy_tokens(table), words, percent).select(F.xxhash64("key").alias("sid"), "tokens").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    heads = materialize(heads.join(placed.select("sid", "comp"), "sid"), "heads")
    shared = heads.select("comp", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shared = materialize(shared.filter("lo <> hi").select("token"), "shared-tokens")
    cells = heads.select("sid", F.posexplode("tokens").alias("pos", "token")).join(shared, "token")
    cells = materialize(cells.join(placed, "sid"), "shared-cells")
    discard(heads, shared)
    part = F.xxhash64("comp", F.pmod(F.xxhash64("sid"), F.ceil(F.col("held") / PART)))
    parts = materialize(placed.select("sid", part.alias("g")), "parts")
    matrix = cells.join(parts, "sid").groupBy("token", "g", "comp", "held").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("at"))
    # The largest component that holds a token has no one to ask about it.
    largest = cells.groupBy("token").agg(F.max(F.struct("held", "comp")).alias("largest"))
    asks = cells.join(largest, "token").filter(F.struct("held", "comp") != F.col("largest")).select("token", "sid", "n", "pos", F.struct("held", "comp").alias("own"))
    must = lambda n: F.ceil(n * percent / 100)
    bound = F.least(F.col("n") - F.col("pos"), F.col("most") - F.col("at")) + (SHARED - 1)
    pairs = (
        asks.join(matrix, "token")
        .filter(F.col("own") < F.struct("held", "comp"))
        .filter((F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent))
        .filter(bound * (100 + percent) >= (F.col("n") + F.greatest(F.col("least"), must(F.col("n")))) * percent)
        .groupBy(F.col("sid").alias("q"), "g")
        .agg(F.count(F.lit(1)).alias("both"), F.first("n").alias("n"), F.min("least").alias("least"))
        .filter(F.col("both") >= F.least(F.lit(SHARED), must(F.col("n")), must(F.col("least"))))
        .select("q", "g")
    )
    pairs = materialize(pairs, "pairs")
    discard(cells)
    members = parts.join(pairs.select("g").distinct(), "g")
    late = materialize(verify(docs, sets, pairs, members, words, percent), "late-links")

    links = stars.unionByName(late).select(F.col("q").alias("a"), F.col("s").alias("b"))
    comp = connected_components(links).select(F.col("v").alias("key"), "comp")
    whole = sets.select("key", "id").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    best = whole.groupBy("comp").agg(F.min(F.struct("id", "key")).alias("best"))
    out = whole.join(best, "comp").select("key", F.col("id").alias("first_id"), F.col("best.id").alias("comp_id"), F.col("best.key").alias("comp_key"))
    return each, materialize(out, "set-components")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id
    reachable by links, itself included).

    Null texts and texts without words have no shingle and link with nothing.
    Very long texts are compared whole. Rows that repeat an id are compared each;
    a null id never is the smallest unless a component has no other. Ids are
    integers: others are cast to long, and what is no number is an error where
    ANSI mode is on, else a null id. An empty table gives an empty result; other
    columns are not read."""
    each, sets = group_sets(docs, id_col, text_col, words, percent)
    n = F.col("n").cast("long").alias("n_shingles")
    linked = each.filter("key is not null").join(sets.select("key", "comp_id"), "key").select(F.col("id").alias(id_col), n, F.col("comp_id").alias("component_id"))
    # Texts without words meet no set, and any number of them no join.
    return linked.unionByName(each.filter("key is null").select(F.col("id").alias(id_col), n, F.col("id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id, with its
    own columns. Documents without words stay. Rows that repeat both an id and
    a set stay or go together; drop exact duplicates first."""
    _, sets = group_sets(docs, id_col, text_col, words, percent)

    @F.pandas_udf("binary")
    def key_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            keys = []
            for t in text:
                s = shingles(t, words)
                keys.append(signature(s) if len(s) else None)
            yield pd.Series(keys, dtype=object)

    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    # Documents without words have a key of their own each, so that they spread.
    keyed = plain.withColumn("key", key_of(text)).withColumn("at", F.coalesce("key", F.concat(F.lit("~"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).cast("binary")))
    kept = sets.filter("key = comp_key").select(F.col("key").alias("at"), F.col("first_id").alias("id"), F.lit(True).alias("stays"))
    stay = keyed.join(kept, "at", "left").filter(F.col("key").isNull() | (F.col("stays") & F.col(ident).cast("long").eqNullSafe(F.col("id"))))
    return stay.select(*[f"c{k}" for k in range(len(names))]).toDF(*names)
