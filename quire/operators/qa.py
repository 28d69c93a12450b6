"""Deterministic checks of translated segments, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators.batches import CLOSE, OPEN
from quire.operators.glossary import substring_hits

MIN_LENGTH, MIN_RATIO, MAX_RATIO = 12, 0.25, 4.0
#: Rules and their severities, in the order of the flags.
SEVERITY = {"empty-output": "error", "unresolved-placeholder": "error", "length-ratio": "warning", "altered-number": "warning", "glossary-inconsistency": "warning"}
NUMBER = r"\p{Nd}[\p{Nd}.,:/-]*\p{Nd}|\p{Nd}+"


def empty_output(source: Column, target: Column) -> Column:
    return ~is_blank(source) & is_blank(target)


def placeholders_left(target: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(target, F.lit("")), F.lit(rf"{OPEN}[0-9]+{CLOSE}"), F.lit(0)))


def length_ratio(source: Column, target: Column) -> Column:
    """The ratio, rounded, where it is out of range; else null."""
    ratio = F.length(target) / F.length(source)
    return F.when((F.length(source) >= MIN_LENGTH) & ~ratio.between(MIN_RATIO, MAX_RATIO), F.bround(ratio, 3))


def missing_numbers(source: Column, target: Column) -> Column:
    """Numbers of the source, sorted, that the target does not contain."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, r"^[.,:/-]+|[.,:/-]+$", "")))
    lost = F.array_sort(F.filter(numbers, lambda n: (n != "") & ~F.contains(target, n)))
    return F.when(F.length(source) >= MIN_LENGTH, lost).otherwise(F.array().cast("array<string>"))


def glossary_misses(pairs: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, target_form: terms of policy "translate" that the source holds
    (any case, parts of words too) and whose target form the translation lacks.
    ``pairs``: keys, source, target; ``terms``: term, target_form, policy, enabled."""
    wanted = terms.filter((F.col("policy") == "translate") & F.col("enabled") & (F.coalesce("target_form", F.lit("")) != "") & (F.col("term") != ""))
    wanted = wanted.select("term", "target_form", F.lower("term").alias("low_term"))
    hits = substring_hits(pairs.select(*keys, F.lower("source").alias("low")), wanted, keys, [], ("term", "target_form"))
    both = hits.join(pairs.select(*keys, F.lower("target").alias("low_target")), keys)
    return both.filter(~F.coalesce(F.col("low_target"), F.lit("")).contains(F.lower("target_form"))).select(*keys, "term", "target_form").distinct()


def run_qa(pairs: DataFrame, source: str = "source", target: str = "target", misses: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Adds ``flags`` (rules that fired, in order) and ``status``; an empty
    output skips the other rules. ``misses``: of glossary_misses by the same
    ``keys``; without them the glossary rule is not run."""
    s, t = F.col(source), F.col(target)
    if misses is None:
        marked = pairs.withColumn("_missed", F.lit(False))
    else:
        marked = pairs.join(misses.select(*keys).distinct().withColumn("_missed", F.lit(True)), keys, "left")
    others = F.array_compact(
        F.array(
            F.when(placeholders_left(t) > 0, "unresolved-placeholder"),
            F.when(length_ratio(s, t).isNotNull(), "length-ratio"),
            F.when(F.size(missing_numbers(s, t)) > 0, "altered-number"),
            F.when(F.col("_missed"), "glossary-inconsistency"),
        )
    )
    flags = F.when(empty_output(s, t), F.array(F.lit("empty-output"))).otherwise(others)
    return marked.withColumn("flags", flags).drop("_missed").withColumn("status", F.when(F.size("flags") > 0, "flagged").otherwise("translated"))


def findings(pairs: DataFrame, keys: list[str], misses: DataFrame | None = None) -> DataFrame:
    """One row per finding: keys, rule, severity, message, detail (a string).
    ``pairs``: keys, source, target; ``misses``: of glossary_misses. An empty
    output is the only finding of its pair."""
    s, t = F.col("source"), F.col("target")
    empty, left, ratio, lost = empty_output(s, t), placeholders_left(t), length_ratio(s, t), missing_numbers(s, t)

    def finding(rule: str, message: Column, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), message.alias("message"), detail.cast("string").alias("detail"))

    others = F.array_compact(
        F.array(
            F.when(left > 0, finding("unresolved-placeholder", F.concat(left.cast("string"), F.lit(" placeholders are left in the translation.")), F.array_join(F.regexp_extract_all(t, F.lit(rf"{OPEN}[0-9]+{CLOSE}"), F.lit(0)), " "))),
            F.when(ratio.isNotNull(), finding("length-ratio", F.lit("The translation is much shorter or longer than the source."), ratio)),
            F.when(F.size(lost) > 0, finding("altered-number", F.concat(F.size(lost).cast("string"), F.lit(" numbers of the source are not in the translation.")), F.array_join(lost, " "))),
        )
    )
    first = F.array(finding("empty-output", F.lit("The translation is empty."), F.lit("")))
    found = pairs.select(*keys, F.explode(F.when(empty, first).otherwise(others)).alias("f")).select(*keys, "f.*")
    if misses is None:
        return found
    full = misses.join(pairs.filter(~empty).select(*keys), keys, "left_semi")
    terms = full.select(*keys, finding("glossary-inconsistency", F.concat(F.lit("The term "), F.col("term"), F.lit(" should be rendered as "), F.col("target_form"), F.lit(".")), F.col("term")).alias("f")).select(*keys, "f.*")
    return found.unionByName(terms)
