"""Prompts for a text model, assembled as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.batches import BLOCK_CLOSE, BLOCK_OPEN, section_lines


GLOSSARY_TITLE = "Glossary (use these forms):"
CONTEXT_TITLE = "Recently translated (keep terms and voice):"


def task_text(count: str, language: str) -> str:
    return f"Translate the {count} numbered blocks below into {language}. Repeat each block's mark {BLOCK_OPEN}#N{BLOCK_CLOSE} on a line of its own and put its translation on the lines behind it; leave placeholders as they are."


def batch_bodies(segments: DataFrame, keys: list[str], order: str, text: str, path: str) -> DataFrame:
    """One row per batch: keys, body, count. Blocks are numbered from 1; a line
    names the section where it changes."""
    numbered = section_lines(segments, keys, order, path).withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    mark = F.concat(F.lit(f"{BLOCK_OPEN}#"), F.col("idx").cast("string"), F.lit(f"{BLOCK_CLOSE}\n"), F.col(text))
    block = F.concat_ws("\n\n", F.concat(F.lit("Section: "), F.col("section")), mark)
    listed = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("l"))
    return listed.select(*keys, F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("body"), F.size("l").alias("count"))


def glossary_lines(terms: DataFrame, keys: list[str]) -> DataFrame:
    """One row per batch: keys, glossary. ``terms``: keys, rank, term, target."""
    line = F.concat(F.lit("- "), F.col("term"), F.lit(" → "), F.coalesce("target", F.lit("")))
    listed = terms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))).alias("l"))
    return listed.select(*keys, F.concat(F.lit(GLOSSARY_TITLE + "\n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("glossary"))


def batch_prompts(bodies: DataFrame, glossary: DataFrame, keys: list[str], language: Column) -> DataFrame:
    """The glossary, the task and the numbered blocks, with blank lines between."""
    before, between, behind = task_text("\0", "\1").replace("\1", "\0").split("\0")
    task = F.concat(F.lit(before), F.col("count").cast("string"), F.lit(between), language, F.lit(behind))
    return bodies.join(glossary, keys, "left").select(*keys, F.concat_ws("\n\n", "glossary", task, "body").alias("prompt"))


def candidate_prompts(candidates: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """One row per batch of candidate terms: ``candidates``: keys, batch, index,
    source, sample."""
    line = F.concat(F.col("index").cast("string"), F.lit(". "), F.col("source"), F.coalesce(F.concat(F.lit(" — "), F.nullif("sample", F.lit(""))), F.lit("")))
    listed = candidates.groupBy(*keys, batch).agg(F.array_sort(F.collect_list(F.struct("index", line.alias("t")))).alias("l"))
    return listed.select(*keys, batch, F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("prompt"))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def last_lines(text: Column, most: int = 4) -> Column:
    """The last lines that are not blank, as an error is reported."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    return F.array_join(F.reverse(F.slice(F.reverse(lines), 1, most)), "\n")
