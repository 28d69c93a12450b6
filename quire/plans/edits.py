"""Queries over edits of trees and stores, and over what a model decides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import agents, glossary, segments, store, tree
from quire.plans.common import LINES, NODES, PATHS, documents, table
from quire.plans.glossary import _ACRONYMS
from quire.sources.presets import builtin_presets

#: A limit that no text exceeds: every line is one segment.
WHOLE = 2**31 - 1


def _siblings(spark: SparkSession, sf: str) -> DataFrame:
    """A document's lines as children of one place."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("child_idx", "text"))
    return lines.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("child_idx").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "child_idx", "text")


def _chosen(nodes: DataFrame) -> DataFrame:
    return nodes.filter("child_idx % 6 = 3").select("doc_id", "node_id")


def q69_shift_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = _siblings(spark, sf)
    return tree.shift_nodes(n, _chosen(n).withColumn("dir", F.lit(-1))).select("doc_id", "node_id", "child_idx")


def q70_indent_outdent(spark: SparkSession, sf: str) -> DataFrame:
    """Indented, and of these every second one back out again."""
    n = _siblings(spark, sf)
    inside = tree.indent_nodes(n, _chosen(n))
    back = n.filter("child_idx % 12 = 3").select("doc_id", "node_id")
    return tree.outdent_nodes(inside, back).select("doc_id", "node_id", "parent_id", "child_idx")


def q71_merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = _siblings(spark, sf)
    return tree.merge_with_next(n, _chosen(n)).select("doc_id", "node_id", "child_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q72_split_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = _siblings(spark, sf)
    out = tree.split_node(n, _chosen(n).withColumn("split_at", F.lit(7)))
    return out.select("doc_id", "child_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q73_possible_edits(spark: SparkSession, sf: str) -> DataFrame:
    can = tree.siblings_of(_siblings(spark, sf))
    return can.groupBy("doc_id").agg(*[F.count_if(c).alias(c) for c in ("can_move_up", "can_move_down", "can_indent", "can_outdent", "can_merge")])


def verdict(prompt: str) -> dict:
    """Keeps the terms of even numbers; those of numbers divisible by 4 have a target."""
    shown = re.findall(r"(?m)^(\d+)\. (\S+)", prompt)
    decisions = [{"index": int(i), "kept": int(i) % 2 == 0, "target": f"<{t}>" if int(i) % 4 == 0 else None, "policy": "keep", "part_of_speech": None, "explanation": None} for i, t in shown]
    return {"decisions": decisions, "prompt_tokens": len(shown), "completion_tokens": 1}


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return glossary.acronyms(documents(spark, sf), "source").withColumn("sample", F.lit(None).cast("string"))


def q74_adjudicate(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = agents.adjudicate(_candidates(spark, sf), verdict, "source")
    return kept.select("source", "index", "term", "target", "policy")


def q75_adjudication_totals(spark: SparkSession, sf: str) -> DataFrame:
    return agents.adjudicate(_candidates(spark, sf), verdict, "source")[1].select("source", "prompt_tokens", "failed")


def analyst(prompt: str) -> dict:
    sample = prompt.split("Sample:\n", 1)[1]
    return {"source_lang": "en", "tone": "calm", "register": "neutral", "suggested_preset": ("literary-fiction", "no-such-preset", "technical-manual")[len(sample) % 3]}


def q76_analyze(spark: SparkSession, sf: str) -> DataFrame:
    samples = documents(spark, sf).select("doc_id", F.col("text").alias("sample"))
    return agents.analyze(samples, builtin_presets(spark), analyst, "doc_id").select("doc_id", "preset_id", "error")


def echo(prompt: str) -> dict:
    """Gives every numbered block back with a mark before it, and numbers of
    tokens that follow the number of blocks."""
    parts = re.split(r"(?m)^⟦#([0-9]+)⟧\n", prompt.rsplit("leave placeholders as they are.", 1)[1])[1:]
    blocks = list(zip(parts[::2], parts[1::2], strict=True))
    text = "\n\n".join(f"⟦#{n}⟧\n[fa] {body.rstrip()}" for n, body in blocks)
    return {"text": text, "prompt_tokens": 1000 * len(blocks), "completion_tokens": 7 * len(blocks) + 1}


def _book(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as books, turns as segments; the second of each is locked."""
    empty = {"target_text": F.lit(None).cast("string"), "status": F.lit("pending"), "attempts": F.lit(0), "cost_usd": F.lit(0.0), "error": F.lit("old"), "prompt_tokens": F.lit(0).cast("long"), "completion_tokens": F.lit(0).cast("long")}
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("id"), F.col("turn").alias("ordinal"), F.col("text").alias("source_text"), (F.col("turn") == 2).alias("locked"))
    return c.withColumns(empty)


def _book_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Words of 8 letters or more that 5 turns hold at least; those of an even
    length must stay as they are."""
    words = table(spark, sf, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0)))).alias("term"))
    many = words.groupBy("term").agg(F.count(F.lit(1)).alias("count")).filter("count >= 5")
    return many.select("term", F.col("term").alias("target_form"), F.when(F.length("term") % 2 == 0, "keep").otherwise("translate").alias("policy"), F.lit(True).alias("enabled"), "count")


def q77_translate_book(spark: SparkSession, sf: str) -> DataFrame:
    """Through rendered requests with glossary, context and placeholders."""
    done = agents.translate_book(_book(spark, sf), echo, _book_terms(spark, sf), prices=(2.0, 6.0))
    return done.select("doc_id", "ordinal", "status", "target_text", "attempts", "prompt_tokens", "completion_tokens", F.round("cost_usd", 9).alias("cost_usd"))


def q85_translation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What the same run did, for each book, and the usage that it leaves."""
    run = agents.translate_run(_book(spark, sf), echo, _book_terms(spark, sf), prices=(2.0, 6.0))
    used = run.usage.groupBy("doc_id").agg(F.count(F.lit(1)).alias("usage_rows"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("usage_tokens"))
    return run.stats.join(used, "doc_id", "left").select("doc_id", "queued", "done", "skipped", "failed", "requests", "tokens", F.round("cost_usd", 9).alias("cost_usd"), F.coalesce("usage_rows", F.lit(0)).alias("usage_rows"), F.coalesce("usage_tokens", F.lit(0)).alias("usage_tokens"))


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    """A document's lines as a tree: a line's parent is the line whose number
    lacks its lowest bit, so the reading order is that of the lines."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    name = lambda n: F.concat_ws(":", F.col("doc_id").cast("string"), n.cast("string"))
    above = F.col("line_no").bitwiseAND(F.col("line_no") - 1)
    size = F.length("text")
    return lines.select("doc_id", "line_no", name(F.col("line_no")).alias("node_id"), F.when(F.col("line_no") > 0, name(above)).alias("parent_id"), F.col("line_no").alias("child_idx"), "text", F.when(size % 5 == 0, "heading").otherwise("paragraph").alias("kind"), F.when(size % 5 == 0, 1 + size % 3).alias("level"))


def _bare(spark: SparkSession, sf: str) -> DataFrame:
    """That tree without its texts, which no edit of places needs."""
    return _nested(spark, sf).select("doc_id", "line_no", "node_id", "parent_id", "child_idx")


def _edited(spark: SparkSession, sf: str) -> DataFrame:
    """The bare tree after lines were moved in and out and parts of it deleted."""
    n = _bare(spark, sf)
    chosen = lambda rule: n.filter(rule).select("doc_id", "node_id")
    moved = tree.outdent_nodes(tree.indent_nodes(n, chosen("line_no % 6 = 4")), chosen("line_no % 10 = 7"))
    return tree.renumber(tree.delete_subtrees(tree.renumber(moved), chosen("line_no % 16 = 12")))


def q86_edit_nested_trees(spark: SparkSession, sf: str) -> DataFrame:
    return _edited(spark, sf).select("doc_id", "node_id", "parent_id", "child_idx", "pos", "depth", F.size("ancestors").alias("above"), F.get("ancestors", F.lit(0)).alias("top"))


def q87_resegment_edits(spark: SparkSession, sf: str) -> DataFrame:
    """The segments after the edits and after every tenth line was rewritten:
    those that are kept keep their work and take their new place and headings."""
    lines = _nested(spark, sf).select("doc_id", "node_id", "text", "kind", "level")
    before = segments.build_segments(tree.heading_paths(tree.renumber(_bare(spark, sf)).join(lines, ["doc_id", "node_id"]), levels=3), limit=WHOLE)
    stored = before.select("doc_id", "id", "node_id", "ordinal", "source_text", "heading_path", F.lit("translated").alias("status"), F.concat(F.lit("[fa] "), "source_text").alias("target_text"))
    text = F.when(F.col("line_no") % 10 == 3, F.concat(F.lit("Edited. "), F.col("text"))).otherwise(F.col("text"))
    after = tree.heading_paths(_edited(spark, sf).join(lines, ["doc_id", "node_id"]).withColumn("text", text), levels=3)
    out = segments.resegment(after.drop("parts"), stored, limit=WHOLE)
    return out.select("doc_id", "node_id", "ordinal", "status", F.array_join("heading_path", " › ").alias("heading_path"), F.md5(F.coalesce("target_text", F.lit("")).cast("binary")).alias("target_md5"))


def q78_segment_glossary(spark: SparkSession, sf: str) -> DataFrame:
    lines = documents(spark, sf).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "source_text"))
    terms = glossary.acronyms(documents(spark, sf), "source").filter("count >= 2")
    return agents.segment_glossary(lines, terms, ["doc_id", "pos"], "source").groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))


def q79_update_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as terms; those of the first size are edited by hand."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("target"), F.col("p_brand").alias("policy"), (F.col("p_size") > 40).alias("locked"), "p_size")
    edits = p.filter("p_size <= 10").select("id", F.array(F.lit("target")).alias("sent"), F.lit(None).cast("string").alias("target"), F.lit("x").alias("policy"))
    return store.update_terms(p, edits, ["id"], ["target", "policy"]).select("id", "target", "policy", "locked")


def q80_create_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as projects; customers ask for new ones under their number
    modulo 2000."""
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("name"))
    new = table(spark, sf, "customer").select((F.col("c_custkey") % 2000).cast("long").alias("project_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return store.create_projects(old.withColumn("project_id", F.col("project_id").cast("long")), new).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


def q81_contents_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with leaders and a page number, of three scripts, behind those of
    even length."""
    lines = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    page = F.element_at(F.array(F.lit(" .... 12"), F.lit(" .... ۱۲"), F.lit(" .... ١٢")), (F.length("line") % 3 + 1).cast("int"))
    shown = F.when(F.length("line") % 2 == 0, F.concat("line", page)).otherwise(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_toc_line(shown)).alias("entries"), F.count_if(T.is_toc_title(F.col("line"))).alias("titles"))


def q82_allowed_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as projects whose stage their status names."""
    stage = F.when(F.col("o_orderstatus") == "O", "review").when(F.col("o_orderstatus") == "F", "failed").otherwise("created")
    checked = store.may_start(table(spark, sf, "orders").select("o_orderkey", stage.alias("stage")), "translate")
    return checked.groupBy("stage", "allowed", "next_stage").agg(F.count(F.lit(1)).alias("n"))


def q83_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as segments of a supplier's run."""
    status = F.when(F.col("l_returnflag") == "A", "translated").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped")
    s = table(spark, sf, "lineitem").select("l_suppkey", status.alias("status"), F.col("l_linenumber").alias("requests"), F.col("l_quantity").cast("long").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), F.col("l_tax").alias("cost_usd"))
    return store.run_stats(s, "l_suppkey").withColumn("cost_usd", F.round("cost_usd", 4))


def q84_costs(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.cost(F.col("l_quantity") * 1000, F.col("l_partkey"), F.lit(2.5), F.lit(10.0)), 9).alias("usd"))  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.round(F.sum("usd"), 6).alias("usd"))


QUERIES = {f.__name__: f for f in (q69_shift_nodes, q70_indent_outdent, q71_merge_nodes, q72_split_nodes, q73_possible_edits, q74_adjudicate, q75_adjudication_totals, q76_analyze, q77_translate_book, q85_translation_stats, q86_edit_nested_trees, q87_resegment_edits, q78_segment_glossary, q79_update_terms, q80_create_projects, q81_contents_lines, q82_allowed_stages, q83_run_stats, q84_costs)}

_NODES = f"""{LINES}, n AS (SELECT doc_id, pos, line, doc_id || ':' || pos AS node_id, count(*) OVER (PARTITION BY doc_id) AS total FROM lines)"""
_RANKED = f"""c AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY count DESC, term) - 1 AS INT) AS index FROM ({_ACRONYMS}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY count DESC, term) <= 400)"""

#: Batches of the turns that go to the model, and each turn's share of tokens.
_RUN = """w AS (SELECT conv_id, list(turn ORDER BY turn) AS t, list_transform(list({'b': [0::BIGINT], 'n': 1::BIGINT, 'size': length(text)} ORDER BY turn), lambda x: x) AS x
        FROM conversations WHERE turn <> 2 AND regexp_matches(text, '[\\p{L}\\p{Nl}\\p{No}]') GROUP BY conv_id),
    k AS (SELECT conv_id, t, list_reduce(x, lambda a, y: CASE WHEN a.size + y.size > 5000 OR a.n >= 24 THEN {'b': list_append(a.b, a.b[len(a.b)] + 1), 'n': 1::BIGINT, 'size': y.size}
        ELSE {'b': list_append(a.b, a.b[len(a.b)]), 'n': a.n + 1, 'size': a.size + y.size} END).b AS b FROM w),
    z AS (SELECT conv_id, unnest(t) AS turn, unnest(b) AS batch FROM k),
    y AS (SELECT z.*, length(text) AS n, sum(length(text)) OVER m AS total, count(*) OVER m AS blocks, turn = max(turn) OVER m AS is_last FROM z JOIN conversations USING (conv_id, turn) WINDOW m AS (PARTITION BY conv_id, batch)),
    v AS (SELECT *, 1000 * blocks AS p, 7 * blocks + 1 AS c FROM y),
    f AS (SELECT *, p * n // total AS ps, c * n // total AS cs FROM v),
    r AS (SELECT conv_id, turn, batch, CAST(CASE WHEN is_last THEN p - coalesce(sum(ps) OVER before, 0) ELSE ps END AS BIGINT) AS prompt_tokens, CAST(CASE WHEN is_last THEN c - coalesce(sum(cs) OVER before, 0) ELSE cs END AS BIGINT) AS completion_tokens
        FROM f WINDOW before AS (PARTITION BY conv_id, batch ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
#: The tree of the lines, moved in and out, walked from its tops, and pruned.
_EDITED = f"""{LINES}, t0 AS (SELECT doc_id, line, pos AS line_no, CASE WHEN pos > 0 THEN pos & (pos - 1) END AS parent FROM lines),
    t1 AS (SELECT *, row_number() OVER s AS child_idx, lag(line_no) OVER s AS before FROM t0 WINDOW s AS (PARTITION BY doc_id, parent ORDER BY line_no)),
    t2 AS (SELECT * REPLACE (CASE WHEN line_no % 6 = 4 AND before IS NOT NULL THEN before ELSE parent END AS parent), line_no % 6 = 4 AND before IS NOT NULL AS late FROM t1),
    t3 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id, parent ORDER BY late, child_idx) AS child_idx) FROM t2),
    t4 AS (SELECT x.* REPLACE (CASE WHEN u.line_no IS NOT NULL AND x.line_no % 10 = 7 THEN u.parent ELSE x.parent END AS parent), CASE WHEN u.line_no IS NOT NULL AND x.line_no % 10 = 7 THEN u.child_idx + 0.5 ELSE x.child_idx END AS spot
        FROM t3 x LEFT JOIN t3 u ON x.doc_id = u.doc_id AND x.parent = u.line_no),
    t5 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id, parent ORDER BY spot, child_idx) AS child_idx) FROM t4),
    walk AS (SELECT doc_id, line_no, [child_idx] AS path, line_no % 16 = 12 AS gone, line_no AS top FROM t5 WHERE parent IS NULL
        UNION ALL SELECT t5.doc_id, t5.line_no, list_append(path, child_idx), gone OR t5.line_no % 16 = 12, top FROM walk JOIN t5 ON walk.doc_id = t5.doc_id AND t5.parent = walk.line_no),
    edited AS (SELECT doc_id, line_no, line, parent, path, top, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INT) AS pos, row_number() OVER (PARTITION BY doc_id, parent ORDER BY path) - 1 AS child_idx FROM walk JOIN t5 USING (doc_id, line_no) WHERE NOT gone)"""

ORACLES = {
    "q69_shift_nodes": f"WITH {_NODES} SELECT doc_id, node_id, CAST(CASE WHEN pos % 6 = 3 THEN pos - 1 WHEN pos % 6 = 2 AND pos + 1 < total THEN pos + 1 ELSE pos END AS INT) AS child_idx FROM n",
    "q70_indent_outdent": f"""WITH {_NODES}, p AS (SELECT doc_id, node_id, pos, CASE WHEN pos % 12 = 9 THEN doc_id || ':' || (pos - 1) END AS parent_id FROM n)
        SELECT doc_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY pos) - 1 AS INT) AS child_idx FROM p""",
    "q71_merge_nodes": f"""WITH {_NODES}, m AS (SELECT doc_id, node_id, pos, CASE WHEN pos % 6 = 3 AND pos + 1 < total THEN trim(line || CASE WHEN line <> '' AND lead(line) OVER w <> '' THEN ' ' ELSE '' END || lead(line) OVER w, '') ELSE line END AS t FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        SELECT doc_id, node_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS child_idx, md5(CASE WHEN pos % 6 = 3 AND t = '' THEN NULL ELSE t END) AS text_md5 FROM m WHERE pos % 6 <> 4""",
    "q72_split_nodes": f"""WITH {_NODES}, h AS (SELECT doc_id, pos, unnest(CASE WHEN pos % 6 = 3 AND regexp_replace(substr(line, 8), '^\\s+', '') <> '' THEN [regexp_replace(substr(line, 1, 7), '\\s+$', ''), regexp_replace(substr(line, 8), '^\\s+', '')] ELSE [line] END) AS t,
            unnest(CASE WHEN pos % 6 = 3 AND regexp_replace(substr(line, 8), '^\\s+', '') <> '' THEN [0, 1] ELSE [0] END) AS half FROM n)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, half) - 1 AS INT) AS child_idx, md5(t) AS text_md5 FROM h""",
    "q73_possible_edits": f"WITH {_NODES} SELECT doc_id, count(*) - 1 AS can_move_up, count(*) - 1 AS can_move_down, count(*) - 1 AS can_indent, 0 AS can_outdent, count(*) - 1 AS can_merge FROM n GROUP BY doc_id",
    "q74_adjudicate": f"WITH {_RANKED} SELECT source, index, term, CASE WHEN index % 4 = 0 THEN '<' || term || '>' END AS target, CASE WHEN index % 4 = 0 THEN 'keep' ELSE 'translate' END AS policy FROM c WHERE index % 2 = 0",
    "q75_adjudication_totals": f"WITH {_RANKED} SELECT source, count(*) AS prompt_tokens, 0 AS failed FROM c GROUP BY source",
    "q76_analyze": "SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 'literary-fiction' WHEN 1 THEN 'general' ELSE 'technical-manual' END AS preset_id, CAST(NULL AS VARCHAR) AS error FROM documents",
    "q77_translate_book": f"""WITH {_RUN} SELECT c.conv_id AS doc_id, c.turn AS ordinal, CASE WHEN c.turn = 2 THEN 'pending' WHEN r.turn IS NULL THEN 'skipped' ELSE 'translated' END AS status,
        CASE WHEN c.turn = 2 THEN NULL WHEN r.turn IS NULL THEN c.text ELSE '[fa] ' || regexp_replace(c.text, '\\s+$', '') END AS target_text, CAST(CASE WHEN r.turn IS NULL THEN 0 ELSE 1 END AS INT) AS attempts,
        coalesce(prompt_tokens, 0) AS prompt_tokens, coalesce(completion_tokens, 0) AS completion_tokens, round(coalesce(prompt_tokens, 0) / 1e6 * 2.0 + coalesce(completion_tokens, 0) / 1e6 * 6.0, 9) AS cost_usd
        FROM conversations c LEFT JOIN r USING (conv_id, turn)""",
    "q85_translation_stats": f"""WITH {_RUN}, b AS (SELECT conv_id, batch, 1000 * count(*) AS p, 7 * count(*) + 1 AS c FROM r GROUP BY ALL),
        s AS (SELECT conv_id, count(*) AS requests, CAST(sum(p + c) AS BIGINT) AS tokens, round(sum(p) / 1e6 * 2.0 + sum(c) / 1e6 * 6.0, 9) AS cost_usd FROM b GROUP BY conv_id),
        q AS (SELECT c.conv_id, count(*) AS queued, count(r.turn) AS done, count(*) - count(r.turn) AS skipped FROM conversations c LEFT JOIN r USING (conv_id, turn) WHERE c.turn <> 2 GROUP BY c.conv_id)
        SELECT q.conv_id AS doc_id, queued, done, skipped, 0 AS failed, coalesce(requests, 0) AS requests, coalesce(tokens, 0) AS tokens, coalesce(cost_usd, 0.0) AS cost_usd, done AS usage_rows, coalesce(tokens, 0) AS usage_tokens FROM q LEFT JOIN s USING (conv_id)""",
    "q86_edit_nested_trees": f"""WITH RECURSIVE {_EDITED} SELECT doc_id, doc_id || ':' || line_no AS node_id, doc_id || ':' || parent AS parent_id, CAST(child_idx AS INT) AS child_idx, pos, len(path) - 1 AS depth, len(path) - 1 AS above,
        CASE WHEN len(path) > 1 THEN doc_id || ':' || top END AS top FROM edited""",
    "q87_resegment_edits": f"""WITH RECURSIVE {_EDITED}, nodes AS (SELECT doc_id, pos, line_no, line AS was, CASE WHEN line_no % 10 = 3 THEN 'Edited. ' || line ELSE line END AS text, CASE WHEN length(line) % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN length(line) % 5 = 0 THEN 1 + length(line) % 3 END AS level FROM edited){PATHS[len(NODES):]}
        SELECT doc_id, doc_id || ':' || line_no AS node_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal, CASE WHEN text = was THEN 'translated' ELSE 'pending' END AS status, array_to_string(heading_path, ' › ') AS heading_path,
               md5(CASE WHEN text = was THEN '[fa] ' || text ELSE '' END) AS target_md5 FROM paths WHERE regexp_matches(text, '\\S')""",
    "q78_segment_glossary": f"WITH {LINES}, t AS (SELECT * FROM ({_ACRONYMS}) WHERE count >= 2) SELECT l.source, term, count(*) AS n FROM lines l JOIN t ON l.source = t.source AND contains(lower(line), lower(term)) GROUP BY ALL",
    "q79_update_terms": "SELECT p_partkey AS id, CASE WHEN p_size > 10 THEN p_name END AS target, p_brand AS policy, p_size > 40 OR p_size <= 10 AS locked FROM part",
    "q80_create_projects": """WITH n AS (SELECT c_name, row_number() OVER (PARTITION BY c_custkey % 2000 ORDER BY c_custkey) = 1 AND c_custkey % 2000 NOT IN (SELECT s_suppkey FROM supplier) AS fresh FROM customer)
        SELECT CASE WHEN fresh THEN 'created' ELSE 'refused' END AS outcome, count(*) AS n, min(c_name) AS first_name FROM n GROUP BY ALL
        UNION ALL SELECT 'kept', count(*), min(s_name) FROM supplier""",
    "q81_contents_lines": f"""WITH {LINES}, s AS (SELECT doc_id, line, CASE WHEN length(line) % 2 = 0 THEN line || [' .... 12', ' .... ۱۲', ' .... ١٢'][length(line) % 3 + 1] ELSE line END AS shown FROM lines)
        SELECT doc_id, count(*) FILTER (regexp_matches(shown, '^.{{1,120}}?[ \\t.․·]{{2,}}\\p{{Nd}}{{1,4}}\\s*$')) AS entries, count(*) FILTER (lower(trim(line)) IN ('contents', 'table of contents', 'toc')) AS titles FROM s GROUP BY doc_id""",
    "q82_allowed_stages": """SELECT CASE o_orderstatus WHEN 'O' THEN 'review' WHEN 'F' THEN 'failed' ELSE 'created' END AS stage, o_orderstatus IN ('O', 'F') AS allowed, CASE WHEN o_orderstatus IN ('O', 'F') THEN 'review' END AS next_stage, count(*) AS n FROM orders GROUP BY ALL""",
    "q83_run_stats": """SELECT l_suppkey, count(*) AS queued, count(*) FILTER (l_returnflag = 'A') AS done, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS skipped, count(*) FILTER (l_returnflag = 'R') AS failed,
        CAST(sum(l_linenumber) AS BIGINT) AS requests, CAST(sum(CAST(floor(l_quantity) AS BIGINT) + 1) AS BIGINT) AS tokens, round(sum(l_tax), 4) AS cost_usd FROM lineitem GROUP BY l_suppkey""",
    "q84_costs": "SELECT l_orderkey, round(sum(round(l_quantity * 1000 / 1e6 * 2.5 + l_partkey / 1e6 * 10.0, 9)), 6) AS usd FROM lineitem GROUP BY l_orderkey",
}
