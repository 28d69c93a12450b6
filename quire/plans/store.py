"""Queries over keyed tables, presets, tables, page layout and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import layout, tables
from quire.operators import store as K
from quire.plans.common import documents, table
from quire.sources import presets
from quire.streaming import progress

TRANSITIONS = [("view", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("signup", "view"), ("purchase", "view"), ("error", "view"), ("view", "signup")]


def q30_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.status_counts(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderstatus", "o_orderpriority")


def q31_usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = K.usage_rollup(table(spark, sf, "events"), "event_type", F.col("value"), F.length("props").cast("long"))
    return out.withColumn("cost", F.round("cost", 4))


def q32_project_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("flagged"), F.count(F.lit(1)).alias("total"))
    return o.withColumn("percent", K.percent(F.col("done"), F.col("total")))


def q33_segment_page(spark: SparkSession, sf: str) -> DataFrame:
    """Page 3 of 60 rows, as a reader asks for it."""
    return K.page(table(spark, sf, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 60, 2).select("o_orderkey", "o_totalprice")


def q35_project_style(spark: SparkSession, sf: str) -> DataFrame:
    """The style of each document: its preset with the delta of its language."""
    base = presets.builtin_presets(spark)
    over = documents(spark, sf).select("lang").distinct().select(F.lit("general").alias("id"), F.col("lang"), F.when(F.col("lang") == "de", "formal").alias("register"), F.lit(None).cast("string").alias("policy"), F.concat(F.lit("Source: "), F.col("lang")).alias("prompt_extra"), F.create_map(F.lit("leading"), F.when(F.col("lang") == "fr", "1.5").otherwise("2.0")).alias("typography"))
    general = base.filter("id = 'general'").crossJoin(F.broadcast(over.select("lang"))).withColumn("id", F.concat_ws(":", "id", "lang")).drop("lang")
    styled = presets.apply_delta(general, over.withColumn("id", F.concat_ws(":", "id", "lang")))
    d = documents(spark, sf).withColumn("id", F.concat(F.lit("general:"), F.col("lang")))
    return d.join(styled, "id").groupBy("lang", "language_register", "system_prompt", F.element_at("typography", "leading").alias("leading"), "builtin").agg(F.count(F.lit(1)).alias("n"))


def q40_table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each order as a grid, written as pipe rows and read again."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.concat_ws("|", "l_returnflag", "l_linestatus"), F.col("l_partkey").cast("string"))
    grid = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("c")))).alias("r"))
    md = grid.select("l_orderkey", F.transform("r", lambda x: x["c"]).alias("rows")).withColumn("md", tables.to_markdown(F.col("rows")))
    back = tables.onto_template(tables.from_markdown(F.col("md")), F.col("rows"))
    return md.select("l_orderkey", F.md5(F.col("md").cast("binary")).alias("md"), (back == F.col("rows")).alias("same"))


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as spans: the supplier is the document, the order the page."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    return l.select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), F.col("l_partkey").alias("line"), (F.col("l_quantity") * 9.7).alias("x0"), (F.col("l_quantity") / 4).alias("size"), F.col("l_orderkey").alias("ord"), (F.col("l_linenumber") * 7).cast("long").alias("n"), (F.col("l_returnflag") == "N").alias("mono"), F.col("l_quantity").alias("y0"), F.col("l_discount").alias("w"))


def q41_font_levels(spark: SparkSession, sf: str) -> DataFrame:
    return layout.font_levels(_spans(spark, sf)).withColumn("level", F.col("level").cast("int"))


def q42_code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    s = _spans(spark, sf).withColumn("page", F.col("page") % 10)
    return layout.code_blocks(s).select("doc_id", "page", "block", "lines", "n", "mono_n")


def q43_bbox_anti(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _spans(spark, sf).select("doc_id", "page", "block", "x0", "y0", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 5).alias("y1"), "mono").withColumn("page", F.col("page") % 50)
    return layout.outside_tables(boxes.filter("not mono"), boxes.filter("mono")).select("doc_id", "page", "block", "x0", "y0")


def q61_layout_probe(spark: SparkSession, sf: str) -> DataFrame:
    return layout.probe(_spans(spark, sf)).withColumn("chars_per_page", F.round("chars_per_page", 6))


def q52_latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the events, run to its end; the oracle is a batch."""
    events = progress.event_stream(spark, sf, "events.parquet")
    return progress.run_to_table(progress.latest(events, "user_id", F.struct("ts", "event_id"), F.col("event_type")), "latest-progress")


def q53_idle_gaps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("user_id", "event_id", (gap / 1e6).alias("gap_s")).filter("gap_s > 21600")


def q54_stage_violations(spark: SparkSession, sf: str) -> DataFrame:
    bad = K.stage_violations(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", TRANSITIONS)
    return bad.select("user_id", "event_id", "from_stage", "event_type")


def q55_resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are open and not locked are pending; those with a returned
    line count as recorded already."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("translated").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("locked"))
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return K.pending(o).join(done, "o_orderkey", "left_anti").select("o_orderkey", "status")


def q62_record_translations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as segments, their lines as results that came in."""
    o = table(spark, sf, "orders").select(F.lit(0).alias("doc_id"), F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("target_text"), F.lit(0).alias("attempts"), F.lit(0.0).alias("cost_usd"), F.lit("old").alias("error"), (F.col("o_orderpriority") == "1-URGENT").alias("locked"))
    r = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("l_returnflag"), F.sum("l_tax").alias("l_tax"), F.max("l_linestatus").alias("l_linestatus"))
    r = r.select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("new_target"), F.col("l_tax").alias("cost_usd"), F.when(F.col("l_returnflag") == "A", F.array(F.lit("length-ratio"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(F.col("l_linestatus") == "O", F.lit("refused")).alias("error"))
    out = K.record_translations(o, r)
    return out.groupBy("status", "error", "attempts").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"))


QUERIES = {f.__name__: f for f in (q30_status_counts, q31_usage_rollup, q32_project_summary, q33_segment_page, q35_project_style, q40_table_roundtrip, q41_font_levels, q42_code_blocks, q43_bbox_anti, q61_layout_probe, q52_latest_progress, q53_idle_gaps, q54_stage_violations, q55_resume_pending, q62_record_translations)}

_SPANS = """spans AS (SELECT l_suppkey AS doc_id, l_orderkey AS page, l_linenumber AS block, l_partkey AS line, l_quantity * 9.7::DOUBLE AS x0, l_quantity / 4 AS size,
    l_orderkey AS ord, CAST(l_linenumber * 7 AS BIGINT) AS n, l_returnflag = 'N' AS mono, l_quantity AS y0 FROM lineitem)"""

ORACLES = {
    "q30_status_counts": "SELECT o_orderpriority, CASE WHEN grouping(o_orderstatus) = 1 THEN 'total' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))",
    "q31_usage_rollup": "SELECT event_type, round(coalesce(sum(value), 0), 4) AS cost, CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY event_type",
    "q32_project_summary": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS flagged, count(*) AS total, CAST(floor(100 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS INT) AS percent FROM orders GROUP BY o_custkey",
    "q33_segment_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60 OFFSET 120",
    "q35_project_style": """SELECT lang, CASE WHEN lang = 'de' THEN 'formal' ELSE 'neutral' END AS language_register, 'Keep a neutral register and the sense of the text.' || chr(10) || chr(10) || 'Source: ' || lang AS system_prompt,
        CASE WHEN lang = 'fr' THEN '1.5' ELSE '2.0' END AS leading, false AS builtin, count(*) AS n FROM documents GROUP BY lang""",
    "q40_table_roundtrip": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, '| ' || l_linenumber || ' | ' || l_returnflag || '\\|' || l_linestatus || ' | ' || l_partkey || ' |' AS row FROM lineitem)
        SELECT l_orderkey, md5(string_agg(CASE WHEN k = 1 THEN row || chr(10) || '| --- | --- | --- |' ELSE row END, chr(10) ORDER BY k)) AS md, true AS same FROM r GROUP BY l_orderkey""",
    "q41_font_levels": f"""WITH {_SPANS}, s AS (SELECT doc_id, round_even(size, 1) AS size, sum(n) AS w, min(ord) AS f FROM spans GROUP BY doc_id, round_even(size, 1)),
        b AS (SELECT doc_id, max_by(size, [w, -f]) AS body FROM s GROUP BY doc_id)
        SELECT s.doc_id, size, CAST(least(row_number() OVER (PARTITION BY s.doc_id ORDER BY size DESC), 6) AS INT) AS level FROM s JOIN b ON s.doc_id = b.doc_id AND size > body""",
    "q42_code_blocks": f"""WITH {_SPANS} SELECT doc_id, page % 10 AS page, block, count(DISTINCT line) AS lines, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN mono THEN n ELSE 0 END) AS BIGINT) AS mono_n
        FROM spans GROUP BY ALL HAVING count(DISTINCT line) >= 2 AND sum(CASE WHEN mono THEN n ELSE 0 END) >= 0.9 * sum(n)""",
    "q43_bbox_anti": f"""WITH {_SPANS}, b AS (SELECT doc_id, page % 50 AS page, block, x0, y0, x0 + 60 AS x1, y0 + 5 AS y1, mono FROM spans)
        SELECT doc_id, page, block, x0, y0 FROM b WHERE NOT mono AND NOT EXISTS (SELECT 1 FROM b t WHERE t.mono AND t.doc_id = b.doc_id AND t.page = b.page AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1)""",
    "q61_layout_probe": f"""WITH {_SPANS}, p AS (SELECT doc_id, page, sum(n) AS chars, greatest(count(DISTINCT CASE WHEN n > 0 THEN round_even(x0 / 20, 0) * 20 END), 1) AS columns FROM spans GROUP BY ALL),
        d AS (SELECT doc_id, sum(chars) / count(*) AS cpp, max(columns) AS columns FROM p GROUP BY doc_id)
        SELECT doc_id, round(cpp, 6) AS chars_per_page, columns, cpp < 40 AS scanned, cpp < 40 OR columns > 3 AS escalate FROM d""",
    "q52_latest_progress": "SELECT user_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS last, count(*) AS n FROM events GROUP BY user_id",
    "q53_idle_gaps": "SELECT * FROM (SELECT user_id, event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap_s FROM events) WHERE gap_s > 21600",
    "q54_stage_violations": f"""WITH e AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage, event_type FROM events)
        SELECT user_id, event_id, from_stage, event_type FROM e WHERE from_stage IS NOT NULL AND (from_stage, event_type) NOT IN ({", ".join(map(str, TRANSITIONS))})""",
    "q55_resume_pending": "SELECT o_orderkey, 'pending' AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "q62_record_translations": """WITH r AS (SELECT l_orderkey AS id, min(l_returnflag) AS f, sum(l_tax) AS tax, max(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey),
        j AS (SELECT o_orderpriority = '1-URGENT' AS locked, r.id IS NOT NULL AND o_orderpriority <> '1-URGENT' AS take, r.s = 'O' AS bad, f, tax FROM orders LEFT JOIN r ON o_orderkey = r.id)
        SELECT CASE WHEN take AND bad THEN 'failed' WHEN take AND f = 'A' THEN 'flagged' WHEN take THEN 'translated' ELSE 'pending' END AS status, CASE WHEN take AND bad THEN 'refused' WHEN NOT take THEN 'old' END AS error,
               CAST(CASE WHEN take THEN 1 ELSE 0 END AS INT) AS attempts, count(*) AS n, round(sum(CASE WHEN take AND NOT bad THEN tax ELSE 0 END), 4) AS cost FROM j GROUP BY ALL""",
}
