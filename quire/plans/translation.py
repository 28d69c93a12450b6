"""Queries over conversation pairs and batches: context, shares, checks, model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import batches as B
from quire.operators import prompts, qa
from quire.plans.common import PAIRS, documents, table
from quire.plans.glossary import _PACKED, _line_segments


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn behind them. Every tenth conversation
    has an empty answer or a left-over placeholder, so that rules fire."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("source"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"))
    kept = both.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    target = F.when(F.col("conv_id") % 10 == 0, F.lit("  ")).when(F.col("conv_id") % 10 == 1, F.concat("answer", F.lit(f" {B.OPEN}3{B.CLOSE}"))).otherwise(F.col("answer"))
    return kept.select("conv_id", "turn", "source", target.alias("target"))


def q16_usage_apportion(spark: SparkSession, sf: str) -> DataFrame:
    packed = B.pack_batches(_line_segments(spark, sf)).withColumn("size", F.length("source_text"))
    used = packed.withColumn("tokens", F.sum("size").over(Window.partitionBy("doc_id", "batch")) * 7 + 3)
    return B.apportion(used, ["doc_id", "batch"], "ordinal", "size", ["tokens"]).select("doc_id", "batch", "ordinal", "tokens_share")


def q17_rolling_context(spark: SparkSession, sf: str) -> DataFrame:
    done = F.col("turn") % 3 != 1
    c = table(spark, sf, "conversations").withColumn("answer", F.concat(F.lit("~"), F.col("text")))
    return B.rolling_context(c, "conv_id", "turn", done, "text", "answer", limit=30).select("conv_id", "turn", "context")


def q18_section_lines(spark: SparkSession, sf: str) -> DataFrame:
    packed = B.pack_batches(_line_segments(spark, sf)).withColumn("path", F.when(F.length("source_text") % 5 == 0, F.lit("")).otherwise(F.col("source_text")))
    return B.section_lines(packed, ["doc_id", "batch"], "ordinal", "path").select("doc_id", "ordinal", "section")


def q19_protect_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Every text comes back unchanged from protecting its upper-case words."""
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z]{2,}"), F.lit(0)))
    p = documents(spark, sf).select("doc_id", "text", B.protect_spans("text", terms).alias("p"))
    back = B.restore_spans(F.col("p.protected"), F.col("p.tokens"))
    bare = F.regexp_replace("p.protected", f"{B.OPEN}[0-9]+{B.CLOSE}", B.OPEN)
    return p.select("doc_id", F.md5(back.cast("binary")).alias("restored"), F.md5(bare.cast("binary")).alias("protected"), F.size("p.tokens").alias("tokens"))


def q20_parse_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies are a conversation's turns behind numbered marks, every fifth lost."""
    c = table(spark, sf, "conversations").withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    block = F.concat(F.lit(B.BLOCK_OPEN + "#"), F.col("idx").cast("string"), F.lit(B.BLOCK_CLOSE + "\n"), F.col("text"))
    reply = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") % 5 != 0, F.struct("idx", block.alias("b"))))), lambda x: x["b"]), "\n\n").alias("reply"), F.count(F.lit(1)).cast("int").alias("count"))
    parsed = B.parse_replies(reply, ["conv_id"])
    lost = B.missing_blocks(c.select("conv_id", F.col("idx").cast("int").alias("idx")), parsed, ["conv_id"]).groupBy("conv_id").agg(F.count(F.lit(1)).alias("lost"))
    found = parsed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("found"), F.sum(F.length("body")).alias("n"))
    return found.join(lost, "conv_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))


def q21_empty_output(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).filter(qa.empty_output(F.col("source"), F.col("target"))).select("conv_id", "turn")


def q22_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("conv_id", "turn", qa.placeholders_left(F.col("target")).alias("n")).filter("n > 0")


def q23_length_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("conv_id", "turn", qa.length_ratio(F.col("source"), F.col("target")).alias("ratio")).filter("ratio is not null")


def q24_altered_numbers(spark: SparkSession, sf: str) -> DataFrame:
    lost = qa.missing_numbers(F.col("text"), F.translate("text", "3", ""))
    return documents(spark, sf).select("doc_id", F.array_join(lost, " ").alias("missing")).filter("missing <> ''")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of 8 letters or more that 5 turns hold at least; the form to use
    is the word without its last letter doubled."""
    words = table(spark, sf, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))).alias("term"))
    many = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return many.select("term", F.concat("term", F.lit("s")).alias("target_form"), F.lit("translate").alias("policy"), F.lit(True).alias("enabled"))


def q25_glossary_misses(spark: SparkSession, sf: str) -> DataFrame:
    return qa.glossary_misses(pairs(spark, sf), _terms(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", "term")


def q26_run_qa(spark: SparkSession, sf: str) -> DataFrame:
    both, keys = pairs(spark, sf), ["conv_id", "turn"]
    return qa.run_qa(both, misses=qa.glossary_misses(both, _terms(spark, sf), keys), keys=keys).select("conv_id", "turn", F.array_join("flags", ",").alias("flags"), "status")


def q67_qa_findings(spark: SparkSession, sf: str) -> DataFrame:
    both, keys = pairs(spark, sf), ["conv_id", "turn"]
    return qa.findings(both, keys, qa.glossary_misses(both, _terms(spark, sf), keys)).select(*keys, "rule", "severity", "detail")


def q64_batch_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt of each batch of lines; the section is the line itself."""
    packed = B.pack_batches(_line_segments(spark, sf)).withColumn("path", F.when(F.length("source_text") % 5 == 0, F.lit("")).otherwise(F.col("source_text")))
    keys = ["doc_id", "batch"]
    terms = packed.filter("length(source_text) % 9 = 0").groupBy(*keys).agg(F.max("ordinal").alias("rank")).select(*keys, "rank", F.lit("term").alias("term"), F.lit("form").alias("target"))
    out = prompts.batch_prompts(prompts.batch_bodies(packed, keys, "ordinal", "source_text", "path"), prompts.glossary_lines(terms, keys), keys, F.lit("fa"))
    return out.select(*keys, F.length("prompt").alias("n"), F.md5(F.regexp_replace("prompt", "(?s)Translate the .*? as they are[.]", "TASK").cast("binary")).alias("prompt_md5"))


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("string").alias("id"), F.col("text").alias("source"), "turn")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "source"))).alias("items"))


def echo(texts: list[str]) -> list[str | None]:
    return ["[fa] " + t for t in texts]


def poisoned(texts: list[str]) -> list[str | None]:
    if any("?" in t for t in texts):
        raise ValueError("refused")
    return echo(texts)


def q56_translate_echo(spark: SparkSession, sf: str) -> DataFrame:
    return B.translate_batches(_batched(spark, sf), echo, ["conv_id"]).select("conv_id", F.col("id").cast("long").alias("turn"), "target_text", "status", "requests")


def q57_translate_poison(spark: SparkSession, sf: str) -> DataFrame:
    return B.translate_batches(_batched(spark, sf), poisoned, ["conv_id"]).select("conv_id", F.col("id").cast("long").alias("turn"), "target_text", "status")


QUERIES = {f.__name__: f for f in (q16_usage_apportion, q17_rolling_context, q18_section_lines, q19_protect_restore, q20_parse_replies, q21_empty_output, q22_placeholders, q23_length_ratio, q24_altered_numbers, q25_glossary_misses, q26_run_qa, q67_qa_findings, q64_batch_prompts, q56_translate_echo, q57_translate_poison)}

_SQL_PAIRS = f"""{PAIRS}, p AS (SELECT conv_id, turn, source, CASE WHEN conv_id % 10 = 0 THEN '  ' WHEN conv_id % 10 = 1 THEN target || ' {B.OPEN}3{B.CLOSE}' ELSE target END AS target FROM pairs WHERE role = 'user' AND next_role = 'assistant')"""
_LEFT = f"len(regexp_extract_all(target, '{B.OPEN}[0-9]+{B.CLOSE}'))"
_OUT = "length(source) >= 12 AND NOT length(target) / length(source) BETWEEN 0.25 AND 4.0"
_LOST = "CASE WHEN length({s}) >= 12 THEN list_sort(list_filter(list_distinct(list_transform(regexp_extract_all({s}, '\\p{{Nd}}[\\p{{Nd}}.,:/-]*\\p{{Nd}}|\\p{{Nd}}+'), lambda n: regexp_replace(n, '^[.,:/-]+|[.,:/-]+$', '', 'g'))), lambda n: n <> '' AND NOT contains({t}, n))) ELSE [] END"

_EMPTY = "regexp_matches(source, '\\S') AND NOT regexp_matches(target, '\\S')"
_MISSES = """t AS (SELECT term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS term FROM conversations) GROUP BY term HAVING count(*) >= 5),
    misses AS (SELECT DISTINCT conv_id, turn, term FROM p JOIN t ON contains(lower(source), term) WHERE NOT contains(lower(target), term || 's'))"""

_EXCERPT = "CASE WHEN length({f}) <= 30 THEN {f} ELSE rtrim(substr({f}, 1, 30)) || '…' END"
_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

#: Characters of the task besides the number of blocks.
_TASK = len(f"Translate the  numbered blocks below into fa. Repeat each block's mark {B.BLOCK_OPEN}#N{B.BLOCK_CLOSE} on a line of its own and put its translation on the lines behind it; leave placeholders as they are.")

ORACLES = {
    "q16_usage_apportion": f"""WITH {_PACKED}, u AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id, batch) * 7 + 3 AS tokens, greatest(length(line), 1) AS w FROM packed),
        v AS (SELECT *, CAST(floor(tokens * w / sum(w) OVER (PARTITION BY doc_id, batch)) AS BIGINT) AS share, ordinal = max(ordinal) OVER (PARTITION BY doc_id, batch) AS is_last FROM u)
        SELECT doc_id, batch, ordinal, CAST(CASE WHEN is_last THEN tokens - coalesce(sum(share) OVER (PARTITION BY doc_id, batch ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END AS BIGINT) AS tokens_share FROM v""",
    "q17_rolling_context": f"""WITH f AS (SELECT conv_id, turn, {_FLAT.format("text")} AS a, {_FLAT.format("'~' || text")} AS b FROM conversations),
        e AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN {_EXCERPT.format(f="a")} || ' → ' || {_EXCERPT.format(f="b")} END AS x FROM f),
        l AS (SELECT conv_id, turn, list_filter(coalesce(list(x) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), lambda y: y IS NOT NULL) AS past FROM e)
        SELECT conv_id, turn, array_to_string(past[greatest(len(past) - 1, 1):len(past)], chr(10)) AS context FROM l""",
    "q18_section_lines": f"""WITH {_PACKED}, h AS (SELECT *, CASE WHEN length(line) % 5 = 0 THEN '' ELSE line END AS path FROM packed)
        SELECT doc_id, ordinal, CASE WHEN path <> '' AND path IS DISTINCT FROM lag(path) OVER (PARTITION BY doc_id, batch ORDER BY ordinal) THEN path END AS section FROM h""",
    "q64_batch_prompts": f"""WITH {_PACKED}, h AS (SELECT *, CASE WHEN length(line) % 5 = 0 THEN '' ELSE line END AS path FROM packed),
        s AS (SELECT *, CASE WHEN path <> '' AND path IS DISTINCT FROM lag(path) OVER w THEN 'Section: ' || path || chr(10) || chr(10) ELSE '' END || '{B.BLOCK_OPEN}#' || row_number() OVER w || '{B.BLOCK_CLOSE}' || chr(10) || line AS block
              FROM h WINDOW w AS (PARTITION BY doc_id, batch ORDER BY ordinal)),
        p AS (SELECT doc_id, batch, CASE WHEN bool_or(length(line) % 9 = 0) THEN 'Glossary (use these forms):' || chr(10) || '- term → form' || chr(10) || chr(10) ELSE '' END AS g, string_agg(block, chr(10) || chr(10) ORDER BY ordinal) AS body, count(*) AS n FROM s GROUP BY ALL)
        SELECT doc_id, batch, CAST(length(g) + length(body) + 2 + length(n::VARCHAR) + {{_TASK}} AS INT) AS n, md5(g || 'TASK' || chr(10) || chr(10) || body) AS prompt_md5 FROM p""".replace("{_TASK}", str(_TASK)),
    "q19_protect_restore": f"SELECT doc_id, md5(text) AS restored, md5(regexp_replace(text, '[A-Z]{{2,}}', '{B.OPEN}', 'g')) AS protected, CAST(len(list_distinct(regexp_extract_all(text, '[A-Z]{{2,}}'))) AS INT) AS tokens FROM documents",
    "q20_parse_replies": r"""WITH c AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM conversations)
        SELECT conv_id, count(*) FILTER (idx % 5 <> 0) AS found, CAST(sum(length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''))) FILTER (idx % 5 <> 0) AS BIGINT) AS n, count(*) FILTER (idx % 5 = 0) AS lost FROM c GROUP BY conv_id""",
    "q21_empty_output": f"WITH {_SQL_PAIRS} SELECT conv_id, turn FROM p WHERE regexp_matches(source, '\\S') AND NOT regexp_matches(target, '\\S')",
    "q22_placeholders": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, CAST({_LEFT} AS INT) AS n FROM p WHERE {_LEFT} > 0",
    "q23_length_ratio": f"WITH {_SQL_PAIRS} SELECT conv_id, turn, round_even(length(target) / length(source), 3) AS ratio FROM p WHERE {_OUT}",
    "q24_altered_numbers": f"SELECT doc_id, array_to_string(m, ' ') AS missing FROM (SELECT doc_id, {_LOST.format(s='text', t='replace(text, chr(51), chr(0)[1:0])')} AS m FROM documents) WHERE len(m) > 0",
    "q25_glossary_misses": f"WITH {_SQL_PAIRS}, {_MISSES} SELECT conv_id, turn, term FROM misses",
    "q26_run_qa": f"""WITH {_SQL_PAIRS}, {_MISSES}, f AS (SELECT conv_id, turn, CASE WHEN {_EMPTY} THEN ['empty-output'] ELSE list_filter([
            CASE WHEN {_LEFT} > 0 THEN 'unresolved-placeholder' END, CASE WHEN {_OUT} THEN 'length-ratio' END, CASE WHEN len({_LOST.format(s="source", t="target")}) > 0 THEN 'altered-number' END,
            CASE WHEN (conv_id, turn) IN (SELECT (conv_id, turn) FROM misses) THEN 'glossary-inconsistency' END], lambda x: x IS NOT NULL) END AS flags FROM p)
        SELECT conv_id, turn, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) > 0 THEN 'flagged' ELSE 'translated' END AS status FROM f""",
    "q67_qa_findings": f"""WITH {_SQL_PAIRS}, {_MISSES}, full_ AS (SELECT * FROM p WHERE NOT ({_EMPTY}))
        SELECT conv_id, turn, 'empty-output' AS rule, 'error' AS severity, '' AS detail FROM p WHERE {_EMPTY}
        UNION ALL SELECT conv_id, turn, 'unresolved-placeholder', 'error', array_to_string(regexp_extract_all(target, '{B.OPEN}[0-9]+{B.CLOSE}'), ' ') FROM full_ WHERE {_LEFT} > 0
        UNION ALL SELECT conv_id, turn, 'length-ratio', 'warning', CAST(round_even(length(target) / length(source), 3) AS VARCHAR) FROM full_ WHERE {_OUT}
        UNION ALL SELECT conv_id, turn, 'altered-number', 'warning', array_to_string({_LOST.format(s="source", t="target")}, ' ') FROM full_ WHERE len({_LOST.format(s="source", t="target")}) > 0
        UNION ALL SELECT conv_id, turn, 'glossary-inconsistency', 'warning', term FROM misses SEMI JOIN full_ USING (conv_id, turn)""",
    "q56_translate_echo": "SELECT conv_id, turn, '[fa] ' || text AS target_text, 'translated' AS status, CAST(CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END AS INT) AS requests FROM conversations",
    "q57_translate_poison": "SELECT conv_id, turn, CASE WHEN NOT contains(text, '?') THEN '[fa] ' || text END AS target_text, CASE WHEN contains(text, '?') THEN 'failed' ELSE 'translated' END AS status FROM conversations",
}
