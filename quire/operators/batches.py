"""Batches for a text model: packing, context, glossary lines, placeholders,
replies, and shares of what a batch used."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import excerpt
from quire.operators.glossary import substring_hits

MAX_CHARS, MAX_SEGMENTS, GLOSSARY_LINES, EXCERPT = 5000, 24, 40, 240
#: The marks around a protected term and around a block's number,
#: and the pattern of such a mark in a reply.
OPEN, CLOSE = "≧", "≨"
BLOCK_OPEN, BLOCK_CLOSE = "⟦", "⟧"
MARKER = r"^[ \t>*-]*(?:⟦|\[\[)#(\d+)(?:⟧|\]\])[ \t]*"


def greedy_batches(items: Column, size: str, max_size: int = MAX_CHARS, max_items: int = MAX_SEGMENTS) -> Column:
    """The batch number of each item of an ordered array: a new batch starts
    where the next item would pass a limit; a too large one is alone."""

    def add(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["size"] + x[size] > max_size) | (s["n"] >= max_items))
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.array_append(s["out"], batch).alias("out"), batch.alias("batch"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x[size]).otherwise(s["size"] + x[size]).alias("size"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("size"))
    return F.aggregate(items, start, add)["out"]


def pack_batches(segments: DataFrame, key: str = "doc_id", order: str = "ordinal", text: str = "source_text", **limits: int) -> DataFrame:
    """Adds ``batch``. A document's segments are packed in order; only their
    sizes are gathered in one row."""
    sized = segments.select(key, order, F.length(text).alias("size"))
    listed = sized.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "size"))).alias("items"))
    packed = listed.withColumn("batch", greedy_batches(F.col("items"), "size", **limits)).select(key, F.explode(F.arrays_zip("items", "batch")).alias("z"))
    return segments.join(packed.select(key, F.col(f"z.items.{order}").alias(order), F.col("z.batch").alias("batch")), [key, order])


def batch_glossary(batches: DataFrame, terms: DataFrame, key: str, most: int = GLOSSARY_LINES) -> DataFrame:
    """The terms that occur in each batch, the most frequent first. ``batches``:
    key, batch keys, hay; ``terms``: key, term, count. Terms are substrings of
    any length, in any case."""
    ids = [c for c in batches.columns if c != "hay"]
    wanted = terms.withColumn("low_term", F.lower("term"))
    hits = substring_hits(batches.select(*ids, F.lower("hay").alias("low")), wanted, ids, [key], ("term", "count"), most)
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy(F.col("count").desc(), "term"))
    return hits.select(*ids, "term", "count").withColumn("rank", rank).filter(F.col("rank") <= most)


def apportion(batches: DataFrame, keys: list[str], order: str, size: str, totals: list[str]) -> DataFrame:
    """Each segment's share of its batch's totals by size, rounded down; the
    last one takes what is left. Adds ``<total>_share``."""
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.greatest(F.col(size), F.lit(1))
    out = batches.withColumns({"_w": weight, "_all": F.sum(weight).over(whole), "_last": F.col(order) == F.max(order).over(whole)})
    for t in totals:
        out = out.withColumn("_s", F.floor(F.col(t) * F.col("_w") / F.col("_all")).cast("long"))
        out = out.withColumn(f"{t}_share", F.when(F.col("_last"), F.col(t) - F.coalesce(F.sum("_s").over(before), F.lit(0))).otherwise(F.col("_s"))).drop("_s")
    return out.drop("_w", "_all", "_last")


def rolling_context(segments: DataFrame, key: str, order: str, done: Column, source: str, target: str, most: int = 2, limit: int = EXCERPT) -> DataFrame:
    """Adds ``context``: excerpts of the nearest earlier finished segments,
    oldest first."""
    pair = F.when(done, F.concat(excerpt(F.col(source), limit), F.lit(" → "), excerpt(F.col(target), limit)))
    # Finished segments are numbered; each looks back over as many of them.
    w = Window.partitionBy(key).orderBy(order)
    out = segments.withColumn("_p", pair)
    out = out.withColumn("_n", F.count("_p").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    places = Window.partitionBy(key).orderBy("_n").rangeBetween(-most, 0)
    # Rows with _n in [n - most, n]: those before the segment are the finished
    # ones numbered n - most to n - 1.
    near = F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_n", "_p"))).over(places)
    chosen = F.array_sort(F.filter(near, lambda x: (x["_n"] < F.col("_n")) & (x["_n"] >= F.col("_n") - most)))
    return out.withColumn("context", F.array_join(F.transform(chosen, lambda x: x["_p"]), "\n")).drop("_p", "_n")


def section_lines(batches: DataFrame, keys: list[str], order: str, path: str) -> DataFrame:
    """Adds ``section``: a node's heading path where it differs from that of
    the segment before it in the batch; null elsewhere and where it is empty."""
    before = F.lag(path).over(Window.partitionBy(*keys).orderBy(order))
    return batches.withColumn("section", F.when((F.col(path) != "") & ~F.col(path).eqNullSafe(before), F.col(path)))


def protect(text: str, terms: list[str], start: int = 0) -> tuple[str, dict[str, str]]:
    """Terms become numbered tokens, longest first, one token for each term."""
    tokens: dict[str, str] = {}
    wanted = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not wanted:
        return text, {}

    def token(m: re.Match) -> str:
        return tokens.setdefault(m.group(0), f"{OPEN}{start + len(tokens)}{CLOSE}")

    return re.sub("|".join(map(re.escape, wanted)), token, text), {v: k for k, v in tokens.items()}


def protect_spans(text: Column | str, terms: Column | str) -> Column:
    """struct(protected, tokens: token -> term)."""

    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = [protect(t or "", [] if x is None else list(x)) for t, x in zip(texts, lists, strict=True)]
        return pd.DataFrame(out, columns=["protected", "tokens"])

    return F.pandas_udf(run, "protected string, tokens map<string,string>")(text, terms)


def restore_spans(text: Column, tokens: Column) -> Column:
    return F.aggregate(F.map_entries(tokens), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def parse_reply(text: str, count: int) -> list[tuple[int, str]]:
    """(number, body) of each block of a model's reply that has a body; the
    first of repeated numbers counts, numbers out of range do not."""
    marks = list(re.finditer(MARKER, text or "", re.MULTILINE))
    ends = [m.start() for m in marks[1:]] + [len(text or "")]
    found: dict[int, str] = {}
    for m, end in zip(marks, ends, strict=True):
        body, number = text[m.end() : end].strip(), int(m.group(1))
        if body and 1 <= number <= count:
            found.setdefault(number, body)
    return sorted(found.items())


def parse_replies(replies: DataFrame, keys: list[str]) -> DataFrame:
    """``replies``: keys, reply, count. keys, idx, body of each block."""

    def split(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([[{"idx": i, "body": b} for i, b in parse_reply(x, c)] for x, c in zip(texts, counts, strict=True)])

    blocks = F.pandas_udf(split, "array<struct<idx:int,body:string>>")
    return replies.select(*keys, F.explode(blocks("reply", "count")).alias("b")).select(*keys, "b.idx", "b.body")


def missing_blocks(asked: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    return asked.join(parsed, [*keys, "idx"], "left_anti")


def translate_batches(batches: DataFrame, model, keys: list[str]) -> DataFrame:
    """Run a model over batches of segments. ``batches``: keys, items (array of
    struct id, source). ``model(list of texts) -> list of texts or None``; an
    exception, nothing or a list of another length halves the group, a missing
    text is asked for again, and one that fails alone is ``failed``. keys, id,
    target_text, status, and requests: the batch's on its first row, so that
    they add up."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batches.schema if f.name in keys)

    def group(items: list, out: dict, calls: list) -> None:
        if not items:
            return
        calls[0] += 1
        try:
            got = dict(zip([x["id"] for x in items], model([x["source"] for x in items]), strict=True))
        except Exception:  # the model seam: any failure is retried in halves
            got = {}
        out |= {i: t for i, t in got.items() if t}
        left = [x for x in items if x["id"] not in out]
        if len(left) == len(items):
            if len(items) > 1:
                half = len(items) // 2
                group(items[:half], out, calls)
                group(items[half:], out, calls)
        else:
            group(left, out, calls)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for row in pdf.to_dict("records"):
                out, calls = {}, [0]
                group(list(row["items"]), out, calls)
                rows += [{**{k: row[k] for k in keys}, "id": x["id"], "target_text": out.get(x["id"]), "status": "translated" if x["id"] in out else "failed", "requests": 0 if n else calls[0]} for n, x in enumerate(row["items"])]
            yield pd.DataFrame(rows, columns=[*keys, "id", "target_text", "status", "requests"])

    return batches.select(*keys, "items").mapInPandas(run, f"{schema}, id string, target_text string, status string, requests int")
