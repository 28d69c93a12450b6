"""Glossary: mining candidate terms, merging, subsumption, first occurrences,
decisions and upserts. The key of a collection (a book, a source) is generic."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.functions.storage import saved
from quire.functions.text import trim_all

#: Words that start no term, and words that no n-gram may hold.
DETERMINERS = ("The", "A", "An", "This", "That", "These", "Those", "Our", "Your", "Their", "Its")
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "at", "from", "as", "is", "are", "was", "were", "it", "its", "this", "that",
    "these", "those", "his", "her", "their", "our", "your", "we", "they", "be", "being", "been", "have", "has", "had", "which", "not", "but", "then", "when",
)
#: Fixed patterns. With (?U) every letter is a word character, so one with an
#: accent is no border of a word.
PHRASE = r"(?U)\b(?:[A-Z][a-z]+\s+)+[A-Z][a-z]+\b"
ACRONYM = r"(?U)(?<![A-Z])(?:[A-Z]{2,}(?:/[A-Z]+)+|[A-Z](?:\.[A-Z])+\.?|[A-Z]{2,})\b"
IDENTIFIER = r"(?U)\b(?:[a-z]+[A-Z][a-zA-Z]*|[a-z]+(?:_[a-z]+)+|[A-Za-z_]\w*\.[\w.]+)\b"
WORD = r"[A-Za-z][A-Za-z0-9'’-]*"
WORDS, _STOPS = re.compile(WORD), frozenset(STOPWORDS)
MIN_LENGTH, MIN_COUNT, MOST = 3, 2, 400
#: Characters of a suffix that are sorted.
HEAD = 64


#: Characters of terms in one automaton, which takes about 100 bytes for each,
#: and of texts that are dealt to one group.
TERM_CHARS, TEXT_CHARS = 1 << 20, 8 << 20
#: Different windows that a task counts before it hands them on, about 120 bytes each.
HELD = 1 << 18
#: Most collections whose sizes are broadcast.
MOST_KEYS = 100_000


class TermFinder:
    """An automaton over rows of terms (an Arrow table with ``low_term``)."""

    def __init__(self, rows: pa.Table):
        places: dict[str, list[int]] = {}
        for k, term in enumerate(rows["low_term"].to_pylist()):
            places.setdefault(term, []).append(k)
        self.rows, self.automaton = rows, ahocorasick.Automaton()
        for term, at in places.items():
            self.automaton.add_word(term, at)
        self.automaton.make_automaton()

    def find(self, text: str, most: int | None) -> list[int]:
        """Rows of the terms that a text holds; the first ``most`` of them."""
        if not len(self.automaton):
            return []
        found = sorted({k for _, at in self.automaton.iter(text) for k in at})
        return found[:most]

    def hits(self, texts: pa.Table, columns: list[str], carry: list[str], most: int | None) -> pa.Table:
        """``columns`` of the texts and ``carry`` of the terms that they hold."""
        which, found = [], []
        for k, text in enumerate(texts["low"].to_pylist()):
            rows = self.find(text, most) if text else []
            which += [k] * len(rows)
            found += rows
        left, right = texts.select(columns).take(pa.array(which, pa.int64())), self.rows.select(carry).take(pa.array(found, pa.int64()))
        return pa.table([*left.columns, *right.columns], names=[*columns, *carry])


def substring_hits(texts: DataFrame, terms: DataFrame, ids: list[str], on: list[str], carry: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """ids, on, low_term and the terms' ``carry`` for each text that contains a
    term of the same ``on``. ``texts``: ids, on, low; ``terms``: on, low_term,
    carry. With ``most``, rows beyond a text's first ``most`` terms by count
    (then term; both in ``carry``) may be missing.

    Each text is read once by an automaton of the terms. Terms of at most
    ``TERM_CHARS`` characters in all go to every task, and texts stay where they
    are. More are cut into chunks of that size within their collection, and its
    texts into salted groups of about ``TEXT_CHARS``, so that a task holds one
    chunk and one group however large a collection is."""
    columns, carried = [*ids, *[c for c in on if c not in ids]], ["low_term", *carry]
    terms = saved(terms.select(*on, *carried).filter("low_term <> ''").distinct(), "terms")
    found = StructType([*[texts.schema[c] for c in columns], *[terms.schema[c] for c in carried]])
    order = [("count", "descending"), ("term", "ascending")]

    def finder(rows: pa.Table) -> TermFinder:
        return TermFinder(rows.sort_by(order) if most else rows)

    if (terms.agg(F.sum(F.length("low_term"))).first()[0] or 0) <= TERM_CHARS:
        every = terms.toArrow()
        keys = list(zip(*[every[c].to_pylist() for c in on], strict=True)) if on else [()] * every.num_rows
        at: dict[tuple, list[int]] = {}
        for k, key in enumerate(keys):
            if None not in key:  # a null meets nothing
                at.setdefault(key, []).append(k)
        given = texts.sparkSession.sparkContext.broadcast({key: every.take(pa.array(rows)) for key, rows in at.items()})

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built: dict[tuple, TermFinder] = {}
            for batch in batches:
                table = pa.Table.from_batches([batch])
                here: dict[tuple, list[int]] = {}
                for k, key in enumerate(zip(*[batch[c].to_pylist() for c in on], strict=True) if on else [()] * len(batch)):
                    here.setdefault(key, []).append(k)
                for key, rows in here.items():
                    if key not in built and key in given.value:
                        built[key] = finder(given.value[key])
                    if key in built:
                        yield from built[key].hits(table.take(pa.array(rows)), columns, carried, most).to_batches()

        return texts.select(*columns, "low").mapInArrow(scan, found)

    keys = on or ["_on"]
    if not on:
        texts, terms = texts.withColumn("_on", F.lit(0)), terms.withColumn("_on", F.lit(0))
    groups = texts.groupBy(*keys).agg(F.ceil(F.sum(F.length("low")) / TEXT_CHARS).alias("_salts")).join(terms.groupBy(*keys).agg(F.ceil(F.sum(F.length("low_term")) / TERM_CHARS).alias("_chunks")), keys)
    groups = saved(groups, "term-groups")
    if groups.count() <= MOST_KEYS:
        groups = F.broadcast(groups)
    dealt = ["_chunk", "_salt"]
    salted = texts.join(groups, keys).withColumn("_salt", F.pmod(F.xxhash64(*ids), F.col("_salts"))).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    cut = terms.join(groups, keys).withColumn("_chunk", F.pmod(F.xxhash64("low_term"), F.col("_chunks"))).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))

    def meet(some: pa.Table, chunk: pa.Table) -> pa.Table:
        return finder(chunk).hits(some, columns, carried, most)

    left = salted.select(*dict.fromkeys([*columns, *keys]), "low", *dealt).groupBy(*keys, *dealt)
    return left.cogroup(cut.select(*keys, *carried, *dealt).groupBy(*keys, *dealt)).applyInArrow(meet, found)


def _count(df: DataFrame, key: str, terms: Column) -> DataFrame:
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))


def phrase_terms(text: Column) -> Column:
    """Runs of capitalised words, leading determiners dropped, two words at least."""
    found = F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(x, rf"^(?:(?:{'|'.join(DETERMINERS)})\s+)+", ""))
    return F.filter(F.transform(bare, lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: x.contains(" "))


def acronym_terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ACRONYM), F.lit(0)), lambda x: F.regexp_replace(x, r"\.+$", ""))


def identifier_terms(text: Column) -> Column:
    """camelCase, snake_case and dotted names."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def capitalized_phrases(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _count(df, key, phrase_terms(F.col(text)))


def acronyms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _count(df, key, acronym_terms(F.col(text)))


def code_identifiers(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``kinds``: of nodes (column ``kind``) that are looked at; all without."""
    return _count(df if kinds is None else df.filter(F.col("kind").isin(*kinds)), key, identifier_terms(F.col(text)))


def windows(text: str) -> list[str]:
    """For each word of a text that another follows, these and up to two words
    more; none of them a stop word."""
    found, run = [], []
    for word in [*WORDS.findall(text), STOPWORDS[0]]:
        if word not in _STOPS and word.lower() not in _STOPS:
            run.append(word)
            continue
        for at in range(len(run) - 1):
            found.append(" ".join(run[at : at + 4]))
        run = []
    return found


def _repeated(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.RecordBatch]:
    """Of sorted windows, the first 2, 3 and 4 words that stand ``least`` times:
    windows that begin alike follow each other, so three counts are held."""
    heads, counts, now, kind = [None] * 3, [0] * 3, None, None
    out: list[tuple] = []

    def close(length: int) -> None:
        for j in range(length, 3):
            if heads[j] is not None and counts[j] >= least and len(heads[j]) > MIN_LENGTH:
                out.append((now, heads[j], counts[j]))
            heads[j], counts[j] = None, 0

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.int64()), strict=True)], names=[key, "term", "n"])

    for batch in batches:
        kind = batch.schema.field(key).type
        for k, window, n in zip(batch[key].to_pylist(), batch["window"].to_pylist(), batch["n"].to_pylist(), strict=True):
            if k != now:
                close(0)
                now = k
            words = window.split(" ")
            head = words[0]
            for j, word in enumerate(words[1:]):
                head = f"{head} {word}"
                if head != heads[j]:
                    close(j)
                    heads[j] = head
                counts[j] += n
        yield rows()
    if kind is not None:
        close(0)
        yield rows()


def _gram_counts(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, term, n: n-grams that stand ``least`` times in a collection.

    Each place of a text is one row of up to four words, and not one for each
    n-gram that begins there. Rows of a collection that share their first two
    words meet in one partition; sorted there, they are counted as they pass."""
    kind = df.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[object, Counter] = {}
            for at, (k, found) in enumerate(zip(batch[key].to_pylist(), batch["text"].to_pylist(), strict=True), 1):
                held.setdefault(k, Counter()).update(windows(found or ""))
                if at == len(batch) or sum(map(len, held.values())) > HELD:
                    for name, counter in held.items():
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(counter), batch.schema.field(key).type), pa.array(counter.keys(), pa.string()), pa.array(counter.values(), pa.int32())], names=[key, "window", "n"])
                    held = {}

    schema = lambda fields: StructType([StructField(key, kind), *StructType.fromDDL(fields)])
    places = df.select(key, F.col(text).alias("text")).mapInArrow(cut, schema("window string, n int"))
    dealt = places.repartition(key, F.substring_index("window", " ", 2)).sortWithinPartitions(key, "window")
    return dealt.mapInArrow(lambda batches: _repeated(batches, key, least), schema("term string, n long"))


def ngrams(df: DataFrame, key: str, text: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """Adjacent words, 2 to 4, without stop words, that repeat."""
    return _gram_counts(df, key, text, least).withColumnRenamed("n", "count")


def mine(df: DataFrame, key: str, text: str = "text", least: int = MIN_COUNT) -> DataFrame:
    """One row per term of any heuristic: key, term, count, reason. The largest
    count decides; ties go to the earlier heuristic. One aggregation adds up the
    counts of all heuristics; n-grams come to it counted."""
    reasons = F.array(*map(F.lit, ("capitalized_phrase", "acronym", "code_span", "rare_ngram")))

    def found(terms: Column, rank: int) -> Column:
        return F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(rank).alias("rank")))

    every = F.concat(*[found(terms(F.col(text)), k) for k, terms in enumerate((phrase_terms, acronym_terms, identifier_terms))])
    told = df.select(key, F.explode(every).alias("t")).select(key, "t.term", "t.rank", F.lit(1).cast("long").alias("n")).filter(F.length("term") >= MIN_LENGTH)
    counts = told.unionByName(_gram_counts(df, key, text, least).withColumn("rank", F.lit(3)))
    sums = counts.groupBy(key, "term").agg(*[F.sum(F.when(F.col("rank") == k, F.col("n"))).alias(f"n{k}") for k in range(4)])
    # Four times the count and what the rank leaves: one number to compare.
    best = F.greatest(*[F.col(f"n{k}") * 4 + (3 - k) for k in range(4)]).alias("best")
    return sums.select(key, "term", best).select(key, "term", F.expr("best div 4").alias("count"), F.element_at(reasons, (4 - F.col("best") % 4).cast("int")).alias("reason"))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range of heads: the whole ones that the head behind begins
    with (gone), and what the neighbouring ranges need, the first head and the
    last if it is a whole one. Only whole heads and those behind them are read."""
    part, first, last = TaskContext.get().partitionId(), None, None

    def rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.string(), kind, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=["range", "role", "key", "head"])

    for batch in batches:
        if not len(batch):
            continue
        keys, heads, whole = batch.columns
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False)[:-1])
        here, behind = pa.array(at), pa.array(at + 1)
        pairs = zip(keys.take(here).to_pylist(), heads.take(here).to_pylist(), keys.take(behind).to_pylist(), heads.take(behind).to_pylist(), strict=True)
        top = (keys[0].as_py(), heads[0].as_py())
        first = first or top
        ahead = [] if last is None else [(*last, *top)]
        yield rows([(part, "gone", k, h) for k, h, next_k, next_h in [*ahead, *pairs] if k == next_k and next_h.startswith(h)], keys.type)
        last = (keys[-1].as_py(), heads[-1].as_py()) if whole[-1].as_py() else None
    if first is not None:
        yield rows([(part, "first", *first)] + ([(part, "last", *last)] if last else []), keys.type)


def drop_subsumed(terms: DataFrame, key: str) -> DataFrame:
    """Drop terms that are part of a longer term of the same collection.

    A term is part of a longer one when it begins one of its suffixes. Of a
    suffix only the first ``HEAD`` characters are kept, so a term of n characters
    costs n times HEAD at most. Heads are range-partitioned and sorted once;
    those that begin with a term follow it at once, so one look at the next head
    decides; the last head of a range meets the first of the range behind it.
    Many terms with one prefix fill several ranges, and so do equal heads, as a
    hash of their origin is the last part of the order. Terms that are longer
    than a head are rare: they meet the places of the same head in longer terms,
    and are compared there in full."""
    terms = saved(terms, "terms")
    spots = terms.filter(F.length("term") >= MIN_LENGTH).select(key, "term", F.explode(F.sequence(F.lit(1), F.length("term") - (MIN_LENGTH - 1))).alias("at"))
    heads = spots.select(F.col(key).alias("key"), F.expr(f"substring(term, at, {HEAD})").alias("head"), ((F.col("at") == 1) & (F.length("term") <= HEAD)).alias("whole"), F.xxhash64("term", "at").alias("tie"))
    order = ["key", "head", F.col("whole").desc(), "tie"]
    ranges = heads.repartitionByRange(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kind = terms.schema[key].dataType.simpleString()
    looked = saved(ranges.select("key", "head", "whole").mapInArrow(_followed, f"range int, role string, key {kind}, head string"), "followed")
    # At most two rows a range; a range without rows is passed over.
    ends = looked.filter("role <> 'gone'").withColumn("next", F.lead(F.struct("role", "key", "head")).over(Window.orderBy("range", F.col("role") == "last")))
    edge = ends.filter((F.col("role") == "last") & F.col("next.key").eqNullSafe(F.col("key")) & F.startswith("next.head", "head"))
    gone = looked.filter("role = 'gone'").unionByName(edge.drop("next")).select(F.col("key").alias(key), F.col("head").alias("term"))

    long = terms.filter(F.length("term") > HEAD).select(key, "term", F.substring("term", 1, HEAD).alias("head"))
    inside = spots.filter(F.length("term") > HEAD).select(key, F.col("term").alias("longer"), F.expr(f"substring(term, at, {HEAD})").alias("head")).distinct()
    held = long.join(inside, [key, "head"]).filter((F.length("longer") > F.length("term")) & F.contains("longer", "term")).select(key, "term")
    return terms.join(gone.unionByName(held).distinct(), [key, "term"], "left_anti")


def first_occurrences(terms: DataFrame, nodes: DataFrame, key: str, radius: int = 44) -> DataFrame:
    """The first node (by ``order``) that holds each term in any case, with the
    text around it; terms without one are dropped. ``nodes``: key, order, node, text."""
    terms = saved(terms, "terms").withColumn("low_term", F.lower("term"))
    low = nodes.withColumn("low", F.lower("text"))
    hits = substring_hits(low.select(key, "order", "low"), terms, [key, "order"], [key])
    first = hits.groupBy(key, "low_term").agg(F.min("order").alias("order")).join(nodes.select(key, "order", "node", "text"), [key, "order"])
    place = F.instr(F.lower("text"), F.col("low_term"))
    begin = F.greatest(place - radius, F.lit(1))
    around = F.substring("text", begin, place + F.length("low_term") + radius - begin)
    sample = F.replace(F.coalesce(F.nullif(trim_all(around), F.lit("")), F.col("text")), F.lit("\n"), F.lit(" "))
    seen = first.select(key, "low_term", F.col("node").alias("first_seen_node"), sample.alias("sample"))
    return terms.join(seen, [key, "low_term"]).drop("low_term")


def top_terms(terms: DataFrame, key: str, least: int = MIN_COUNT, most: int = MOST) -> DataFrame:
    """The most frequent terms of each collection, ties by the term."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("count").desc(), "term"))
    return terms.filter(F.col("count") >= least).withColumn("rank", rank).filter(F.col("rank") <= most)


def decide(candidates: DataFrame, decisions: DataFrame, default_policy: str = "translate") -> DataFrame:
    """Terms that were kept. ``candidates``: key, index, source, ...;
    ``decisions``: key, index, seq, kept, target, policy, part_of_speech,
    explanation. The last decision of an index wins; a term without a target
    gets the default policy."""
    last = decisions.groupBy("key", "index").agg(F.max_by(F.struct("kept", "target", "policy", "part_of_speech", "explanation"), "seq").alias("d"))
    has_target = F.coalesce(F.col("d.target"), F.lit("")) != ""
    return candidates.join(last, ["key", "index"]).filter("d.kept").select(*candidates.columns, "d.target", F.when(has_target, F.col("d.policy")).otherwise(F.lit(default_policy)).alias("policy"), "d.part_of_speech", "d.explanation")


def upsert_terms(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The glossary after an upsert, with what was done to each row. New terms
    are added; locked ones are left alone; others take the fields that the new
    row states (null: keep), and always its frequency and first node."""
    fields = ("target", "policy", "explanation", "part_of_speech", "origin")
    facts = ("frequency", "first_seen_node")
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in (*fields, *facts)], F.lit(True).alias("offered"))
    both = stored.withColumn("known", F.lit(True)).join(n, list(keys), "full_outer")
    locked = F.coalesce("locked", F.lit(False))
    action = F.when(F.col("known").isNull(), "added").when(F.col("offered").isNull(), "unchanged").when(locked, "skipped").otherwise("updated")
    out = both.withColumn("action", action)
    take = F.col("action").isin("added", "updated")
    return out.select(
        *keys,
        *[F.when(take, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) for c in fields],
        *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in facts],
        locked.alias("locked"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "action",
    )
