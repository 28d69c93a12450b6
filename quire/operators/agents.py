"""Steps that a text model decides: adjudicating terms, choosing a style,
translating books. A model is a callable that runs inside tasks; a failed call
is a row with an error, not a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.storage import saved
from quire.functions.text import cost, needs_model
from quire.operators import batches, glossary, prompts, qa, requests, store

#: Characters of a batch of candidates, and what each adds to its texts.
CANDIDATE_CHARS, CANDIDATE_EXTRA = 6000, 40
FALLBACK_PRESET = "general"
MOST_PRESETS = 1000
DECISIONS = "array<struct<index:int,kept:boolean,target:string,policy:string,part_of_speech:string,explanation:string>>"


def with_retries(model: Callable, attempts: int = 5, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The model, asked again after an exception: waits double each time, and
    the last exception is raised."""

    def asked(*args):
        for k in range(attempts):
            try:
                return model(*args)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(delay * 2**k)

    return asked


def ask(rows: DataFrame, keys: list[str], model: Callable[[str], dict], answer: str) -> DataFrame:
    """keys, the columns of ``answer`` (a schema, from the model's dict), error."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    names = [*keys, *[part.split()[0] for part in answer.split("; ")], "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                known = {k: row[k] for k in keys}
                try:
                    out.append(known | model(row["prompt"]) | {"error": None})
                except Exception as e:  # the model seam: a failure is a result
                    out.append(known | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    return rows.select(*keys, "prompt").mapInPandas(run, f"{kinds}, {answer.replace('; ', ', ')}, error string")


def number_candidates(candidates: DataFrame, key: str, most: int = glossary.MOST) -> DataFrame:
    """Adds ``index`` (from 0, the most frequent first) and ``batch`` to a
    collection's candidates, ``most`` of them: as many as a glossary holds.
    ``candidates``: key, term, count, sample."""
    order = Window.partitionBy(key).orderBy(F.col("count").desc(), "term")
    numbered = candidates.withColumn("index", F.row_number().over(order) - 1).filter(F.col("index") < most)
    size = F.length("term") + F.length(F.coalesce("sample", F.lit(""))) + CANDIDATE_EXTRA
    listed = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", size.alias("size")))).alias("items"))
    packed = listed.select(key, F.explode(F.arrays_zip("items", batches.greedy_batches(F.col("items"), "size", CANDIDATE_CHARS, most).alias("batch"))).alias("z"))
    return numbered.join(packed.select(key, F.col("z.items.index").alias("index"), F.col("z.batch").alias("batch")), [key, "index"])


def adjudicate(candidates: DataFrame, model: Callable[[str], dict], key: str, default_policy: str = "translate") -> tuple[DataFrame, DataFrame]:
    """Terms that the model keeps (key, index, term, count, target, policy, ...),
    and what that took (key, requests, prompt_tokens, completion_tokens, failed).

    ``model(prompt)``: decisions (dicts of index, kept, target, policy,
    part_of_speech, explanation), prompt_tokens, completion_tokens. Indexes run
    through all batches of a collection; of repeated ones the last counts."""
    numbered = saved(number_candidates(candidates, key), "candidates")
    numbered = numbered.withColumnRenamed(key, "key")
    asked = prompts.candidate_prompts(numbered.select("key", "batch", "index", F.col("term").alias("source"), "sample"), ["key"], "batch")
    replies = saved(ask(asked, ["key", "batch"], model, f"decisions {DECISIONS}; prompt_tokens long; completion_tokens long"), "verdicts")
    each = replies.select("key", "batch", F.posexplode("decisions").alias("place", "d")).select("key", F.struct("batch", "place").alias("seq"), "d.*")
    kept = glossary.decide(numbered, each, default_policy).withColumnRenamed("key", key)
    totals = replies.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.count("error").alias("failed"))
    return kept, totals


def preset_catalogue(presets: DataFrame) -> str:
    """One line for each preset, by id. Presets are a small table, as all of them
    go into a prompt: more than ``MOST_PRESETS`` are an error."""
    lines = presets.select("id", "name", "description").orderBy("id").limit(MOST_PRESETS + 1).collect()
    if len(lines) > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets in one prompt")
    return "\n".join(f"* {r.id}: {r.name}. {r.description}" for r in lines)


def analyze(samples: DataFrame, presets: DataFrame, model: Callable[[str], dict], key: str) -> DataFrame:
    """Each book's tone, register and preset: key, source_lang, tone, register,
    preset_id, error. A preset that does not exist becomes ``general``.
    ``samples``: key, sample and, if known, source_lang."""
    hint = F.when(F.col("source_lang").isNotNull(), F.concat(F.lit("\n\nThe source language may be "), F.col("source_lang"), F.lit("."))) if "source_lang" in samples.columns else F.lit(None).cast("string")
    prompt = F.concat(F.lit("Choose one of these presets:\n" + preset_catalogue(presets) + "\n\nSample:\n"), F.coalesce("sample", F.lit("")), F.coalesce(hint, F.lit("")))
    replies = ask(samples.withColumn("prompt", prompt), [key], model, "source_lang string; tone string; register string; suggested_preset string")
    known = presets.select(F.col("id").alias("suggested_preset"), F.col("id").alias("preset_id"))
    return replies.join(known, "suggested_preset", "left").select(key, "source_lang", "tone", "register", F.coalesce("preset_id", F.lit(FALLBACK_PRESET)).alias("preset_id"), "error")


def segment_glossary(segments: DataFrame, terms: DataFrame, keys: list[str], on: str) -> DataFrame:
    """All terms that each segment's source holds: keys, term. ``segments``:
    keys, on, source_text; ``terms``: on, term."""
    wanted = terms.select(on, "term", F.lower("term").alias("low_term")).distinct()
    ids = list(dict.fromkeys([*keys, on]))
    return glossary.substring_hits(segments.select(*ids, F.lower("source_text").alias("low")), wanted, ids, [on], ("term",)).select(*ids, "term")


def protected_terms(terms: DataFrame) -> DataFrame:
    """Enabled terms whose source form must survive."""
    return terms.filter(F.col("enabled") & F.col("policy").isin("keep", "translate_paren"))


def only(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the given ids alone."""
    return rows.join(ids.select(*keys).distinct(), keys, "left_semi")


def retranslate(segments: DataFrame, ids: DataFrame) -> DataFrame:
    """The given segments (doc_id, id) wait for the model again, with their
    target, error and flags cleared; locked ones stay."""
    go = F.coalesce("_go", F.lit(False)) & ~F.coalesce("locked", F.lit(False))
    both = segments.join(ids.select("doc_id", "id", F.lit(True).alias("_go")).distinct(), ["doc_id", "id"], "left")
    cleared = {c: F.when(~go, F.col(c)) for c in ("target_text", "error") if c in segments.columns}
    return both.withColumns({"status": F.when(go, "pending").otherwise(F.col("status"))} | cleared).select(*segments.columns)


class Run(NamedTuple):
    """What a run leaves: segments; usage (one row per segment or request that
    used anything); stats (one row per document)."""

    segments: DataFrame
    usage: DataFrame
    stats: DataFrame


def batch_requests(segments: DataFrame, waiting: DataFrame, terms: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """key, batch, items, terms: the segments that wait, packed in order, each
    with the section and the finished segments before it, and the batch's terms
    (all of them: a request renders the most frequent of those it holds)."""
    path = F.array_join("heading_path", " › ") if "heading_path" in segments.columns else F.lit("")
    finished = F.col("status").isin("translated", "approved", "flagged") & (F.coalesce("target_text", F.lit("")) != "")
    context = batches.rolling_context(segments, key, "ordinal", finished, "source_text", "target_text").select(key, "id", "context", path.alias("path"))
    packed = batches.pack_batches(waiting, key).join(context, [key, "id"])
    item = F.struct("ordinal", "id", F.col("source_text").alias("source"), "path", "context")
    listed = packed.groupBy(key, "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    if terms is None:
        return listed.withColumn("terms", F.lit(None).cast("array<struct<count:bigint,term:string,target:string,policy:string>>"))
    wanted = terms.filter("enabled").select(F.lower("term").alias("low_term"), "term", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.col("target_form").alias("target"), "policy")
    hay = listed.select(key, "batch", F.lower(F.array_join(F.transform("items", lambda x: x["source"]), "\n")).alias("low"))
    hits = glossary.substring_hits(hay, wanted, [key, "batch"], [], ("term", "count", "target", "policy"))
    held = hits.groupBy(key, "batch").agg(F.collect_list(F.struct("count", "term", "target", "policy")).alias("terms"))
    return listed.join(held, [key, "batch"], "left")


def _asked(segments: DataFrame, model: Callable[[str], dict], terms: DataFrame | None, ids: DataFrame | None, prices: tuple[float, float], language: str, key: str, attempts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The segments that wait, what the model was asked (blocks and requests,
    with their cost), and a result per block, checked."""
    keys = [key, "id"]
    waiting = store.pending(segments)
    waiting = waiting if ids is None else only(waiting, ids, keys)
    batched = batch_requests(segments, waiting.filter(needs_model(F.col("source_text"))), terms, key)
    answer = with_retries(model, attempts) if attempts > 1 else model
    rows = saved(requests.run_requests(batched, answer, [key, "batch"], language), "translated")
    rows = rows.withColumn("cost_usd", cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.lit(prices[0]), F.lit(prices[1])))
    done = rows.filter("id is not null")
    pairs = done.filter("target_text is not null").join(segments.select(key, "id", F.col("source_text").alias("source")), keys).withColumnRenamed("target_text", "target")
    checked = qa.run_qa(pairs, misses=None if terms is None else qa.glossary_misses(pairs, terms, keys), keys=keys).select(*keys, "flags")
    flags = F.coalesce("flags", F.array().cast("array<string>")).alias("flags")
    results = done.join(checked, keys, "left").select(*keys, F.col("target_text").alias("new_target"), "prompt_tokens", "completion_tokens", "cost_usd", flags, "error")
    return waiting, rows, results


def run_results(segments: DataFrame, model: Callable[[str], dict], terms: DataFrame | None = None, prices: tuple[float, float] = (0.0, 0.0), language: str = "the target language", attempts: int = 1) -> DataFrame:
    """What a run over the segments that wait gives for each of them: doc_id,
    id, new_target, prompt_tokens, completion_tokens, cost_usd, flags, error; a
    text that needs no model stands for itself. The work of
    ``streaming.runs.ResultSink`` for a stream of segments."""
    waiting, _, results = _asked(segments, model, terms, None, prices, language, "doc_id", attempts)
    nothing = F.lit(0).cast("long")
    trivial = waiting.filter(~needs_model(F.col("source_text"))).select("doc_id", "id", F.col("source_text").alias("new_target"), nothing.alias("prompt_tokens"), nothing.alias("completion_tokens"), F.lit(0.0).alias("cost_usd"), F.array().cast("array<string>").alias("flags"), F.lit(None).cast("string").alias("error"))
    return results.unionByName(trivial)


def translate_run(
    segments: DataFrame, model: Callable[[str], dict], terms: DataFrame | None = None, ids: DataFrame | None = None, prices: tuple[float, float] = (0.0, 0.0), language: str = "the target language", key: str = "doc_id", attempts: int = 1
) -> Run:
    """One run over the segments that wait (of them, those in ``ids``: doc_id,
    id). Texts that need no model are ``skipped`` and stand for themselves; the
    others go out in batches (``requests.run_requests``), are checked and
    recorded, with their share of tokens and its cost at ``prices`` (dollars a
    million tokens in and out). A request that fails is sent again, ``attempts``
    times in all, before its group is halved. Running it again takes up what
    failed.

    ``segments``: doc_id, id, ordinal, source_text, target_text, status,
    attempts, cost_usd, error, locked and, if known, heading_path,
    prompt_tokens, completion_tokens. ``terms``: term, target_form, policy,
    enabled, count. ``model(prompt)``: a dict of text and tokens."""
    keys = [key, "id"]
    waiting, rows, results = _asked(segments, model, terms, ids, prices, language, key, attempts)
    recorded = store.record_translations(segments, results)
    trivial = waiting.filter(~needs_model(F.col("source_text"))).select(*keys, F.lit(True).alias("_trivial")).distinct()
    settled = recorded.join(trivial, keys, "left")
    settled = settled.withColumns({"target_text": F.when(F.col("_trivial"), F.col("source_text")).otherwise(F.col("target_text")), "status": F.when(F.col("_trivial"), "skipped").otherwise(F.col("status")), "error": F.when(F.col("_trivial").isNull(), F.col("error"))}).drop("_trivial")
    one = F.when(F.col("id").isNull(), 1).otherwise(0).alias("requests")
    counted = rows.select(key, "status", one, "prompt_tokens", "completion_tokens", "cost_usd")
    skipped = waiting.filter(~needs_model(F.col("source_text"))).select(key, F.lit("skipped").alias("status"), F.lit(0).alias("requests"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.lit(0.0).alias("cost_usd"))
    usage = store.usage_rows(rows.select(key, "id", "prompt_tokens", "completion_tokens", "cost_usd"))
    return Run(settled.select(*segments.columns), usage, store.run_stats(counted.unionByName(skipped), key))


def translate_book(segments: DataFrame, model: Callable[[str], dict], terms: DataFrame | None = None, key: str = "doc_id", **options) -> DataFrame:
    """The segments after ``translate_run``."""
    return translate_run(segments, model, terms, key=key, **options).segments
