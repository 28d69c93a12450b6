"""Queries over node tables: paths, ids, segments, samples, chapters, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout, tree
from quire.operators import segments as S
from quire.plans.common import LINES, NODES, PATHS, SENTENCES, documents, nodes, table


def q01_heading_path_segments(spark: SparkSession, sf: str) -> DataFrame:
    built = S.build_segments(tree.heading_paths(nodes(spark, sf), levels=3))
    return built.select("doc_id", "ordinal", "node_id", F.col("id").alias("segment_id"), "kind", F.array_join("heading_path", " › ").alias("heading_path"))


def q02_node_ids(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).groupBy("node_id").agg(F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def q03_paragraph_islands(spark: SparkSession, sf: str) -> DataFrame:
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ends = (F.length("line") % 4 == 0).cast("int")
    island = F.sum(ends).over(Window.partitionBy("doc_id").orderBy("pos"))
    kept = lines.withColumn("island", island).filter(F.length("line") % 4 != 0)
    joined = kept.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return joined.select("doc_id", "island", T.clean_inline(F.array_join(F.transform("l", lambda x: x["line"]), " ")).alias("paragraph"))


def q04_sentence_pack(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    return d.select("doc_id", F.posexplode(S.pack_sentences(F.col("text"), 400)).alias("part", "chunk"))


def q05_build_segments(spark: SparkSession, sf: str) -> DataFrame:
    built = S.build_segments(tree.heading_paths(nodes(spark, sf), levels=3), limit=300)
    return built.select("doc_id", "ordinal", "part", F.col("parts").cast("int").alias("parts"), F.length("source_text").alias("n"), F.col("id").alias("segment_id"))


def q06_needs_model(spark: SparkSession, sf: str) -> DataFrame:
    lines = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.needs_model(F.col("line"))).alias("for_model"), F.count_if(~T.needs_model(F.col("line"))).alias("trivial"))


def q27_reconcile_segments(spark: SparkSession, sf: str) -> DataFrame:
    segs = S.build_segments(tree.heading_paths(nodes(spark, sf), levels=3)).select("doc_id", "id", "ordinal")
    n = F.length("line")
    edited = documents(spark, sf).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Edited. "), F.col("text"))).otherwise(F.col("text")))
    new = S.build_segments(tree.heading_paths(tree.line_nodes(edited, n % 5 == 0, 1 + n % 3), levels=3))
    return S.reconcile(new, segs).groupBy("doc_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "kept", "removed")])


def q28_apply_translations(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf)
    segs = S.build_segments(tree.heading_paths(n, levels=3), limit=300)
    done = segs.select("doc_id", "id", F.when(F.col("ordinal") % 3 != 0, F.concat(F.lit("[fa] "), F.col("source_text"))).alias("target_text"))
    out = S.apply_translations(n, segs, done)
    return out.select("doc_id", "pos", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q34_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return tree.stratified_sample(nodes(spark, sf), max_chars=600)


def q39_toc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages are runs of 5 lines; a page is titled if its first line is short,
    leader-like if most of its lines end without a full stop."""
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pages = lines.groupBy("doc_id", F.floor(F.col("pos") / 5).alias("page")).agg(F.min_by(F.length("line"), "pos").alias("first_n"), (F.count_if(~F.col("line").endswith(".")) / F.count(F.lit(1))).alias("leader_share"))
    out = layout.contents_pages(pages.withColumns({"titled": F.col("first_n") < 60, "leader": F.col("leader_share") >= 0.2}))
    return out.select("doc_id", F.col("page").cast("int").alias("page"), "in_toc")


def q44_chapters(spark: SparkSession, sf: str) -> DataFrame:
    out = tree.chapters(nodes(spark, sf), F.lit("Book"))
    return out.groupBy("doc_id", "chapter_no", "chapter_title").agg(F.count(F.lit(1)).alias("n_nodes"))


def q65_titles(spark: SparkSession, sf: str) -> DataFrame:
    return tree.titles(nodes(spark, sf))


def q66_nodes_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Of nodes that repeat an id the last; ids are those of a line's kind and
    text, so that repeated lines meet."""
    n = nodes(spark, sf).withColumn("node_id", T.node_id(F.col("kind"), F.col("text"), F.lit(0)))
    return tree.by_id(n).select("doc_id", "node_id", "pos", "kind")


def q48_digits(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", *[F.md5(T.localize_digits(F.col("text"), s).cast("binary")).alias(s) for s in ("persian", "arabic")])


def q49_direction(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("FA_IR")).when(F.col("doc_id") % 3 == 1, F.col("lang")).otherwise(F.lit("he-IL")))
    return documents(spark, sf).groupBy("lang", T.direction(tag).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def q50_slugs(spark: SparkSession, sf: str) -> DataFrame:
    title = F.split("text", "\n").getItem(0)
    named = documents(spark, sf).select("doc_id", F.coalesce(F.nullif(T.slug(title), F.lit("")), F.lit("book")).alias("stem"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("doc_id"))
    return named.withColumn("n", n).select("doc_id", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("n").cast("string"))).alias("slug"))


def q51_asset_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    blobs = documents(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return blobs.groupBy(T.asset_id(F.col("content")).alias("asset_id")).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"), F.first(F.length("content")).alias("n_bytes"))


def q60_safe_filenames(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit(" . "), F.col("url"), F.lit(".PDF"))
    return table(spark, sf, "pages").select("page_id", T.safe_filename(name, F.lit("book")).alias("filename"), T.file_format(F.concat("url", F.lit(".html"))).alias("format"))


QUERIES = {f.__name__: f for f in (q01_heading_path_segments, q02_node_ids, q03_paragraph_islands, q04_sentence_pack, q05_build_segments, q06_needs_model, q27_reconcile_segments, q28_apply_translations, q34_stratified_sample, q39_toc_pages, q44_chapters, q65_titles, q66_nodes_by_id, q48_digits, q49_direction, q50_slugs, q51_asset_dedupe, q60_safe_filenames)}


def _packed(source: str, text: str, limit: int) -> str:
    """SQL: rows of ``source`` with ``chunks``."""
    return f"""SELECT *, CASE WHEN length({text}) <= {limit} THEN [{text}] ELSE list_reduce(list_transform({SENTENCES.format(text)}, lambda s: [s]),
        lambda done, x: CASE WHEN length(done[len(done)]) + 1 + length(x[1]) <= {limit}
            THEN list_append(done[1:len(done) - 1], done[len(done)] || ' ' || x[1]) ELSE list_append(done, x[1]) END) END AS chunks FROM {source}"""


_SEGMENTS = """packed AS ({packed}),
units AS (SELECT doc_id, pos, node_id, kind, text, heading_path, unnest(chunks) AS source_text, CAST(unnest(range(len(chunks))) AS INT) AS part, len(chunks) AS parts FROM packed),
segs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) - 1 AS ordinal,
                'seg-' || substr(sha256(node_id || chr(0) || source_text || chr(0) || part), 1, 16) AS id FROM units)"""
_SEG_4000 = _SEGMENTS.format(packed=_packed("paths", "text", 4000))
_SEG_300 = _SEGMENTS.format(packed=_packed("paths", "text", 300))
_EDITED = NODES.replace("FROM documents)", "FROM (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'Edited. ' || text ELSE text END AS text) FROM documents))", 1)

ORACLES = {
    "q01_heading_path_segments": f"WITH {PATHS}, {_SEG_4000} SELECT doc_id, ordinal, node_id, id AS segment_id, kind, array_to_string(heading_path, ' › ') AS heading_path FROM segs",
    "q02_node_ids": f"WITH {NODES} SELECT node_id, max(pos) AS last_pos, count(*) AS n FROM nodes GROUP BY node_id",
    "q03_paragraph_islands": f"""WITH {LINES}, i AS (SELECT *, sum(CASE WHEN length(line) % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM lines)
        SELECT doc_id, CAST(island AS BIGINT) AS island, regexp_replace(regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY pos), '[ \\t]+', ' ', 'g'), '^\\s+', ''), '\\s+$', '') AS paragraph
        FROM i WHERE length(line) % 4 <> 0 GROUP BY doc_id, island""",
    "q04_sentence_pack": f"WITH p AS ({_packed('documents', 'text', 400)}) SELECT doc_id, CAST(unnest(range(len(chunks))) AS INT) AS part, unnest(chunks) AS chunk FROM p",
    "q05_build_segments": f"WITH {PATHS}, {_SEG_300} SELECT doc_id, ordinal, part, CAST(parts AS INT) AS parts, length(source_text) AS n, id AS segment_id FROM segs",
    "q06_needs_model": f"WITH {LINES} SELECT doc_id, count(*) FILTER (regexp_matches(line, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) AS for_model, count(*) FILTER (NOT regexp_matches(line, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]')) AS trivial FROM lines GROUP BY doc_id",
    "q27_reconcile_segments": f"""WITH old AS (WITH {PATHS}, {_SEG_4000} SELECT doc_id, id FROM segs), new AS (WITH {PATHS.replace(NODES, _EDITED)}, {_SEG_4000} SELECT doc_id, id FROM segs)
        SELECT doc_id, count(*) FILTER (old.id IS NULL) AS added, count(*) FILTER (old.id IS NOT NULL AND new.id IS NOT NULL) AS kept, count(*) FILTER (new.id IS NULL) AS removed
        FROM old FULL JOIN new USING (doc_id, id) GROUP BY doc_id""",
    "q28_apply_translations": f"""WITH {PATHS}, {_SEG_300},
        m AS (SELECT doc_id, pos, string_agg(CASE WHEN ordinal % 3 <> 0 THEN '[fa] ' || source_text ELSE source_text END, ' ' ORDER BY part) AS merged, bool_or(ordinal % 3 <> 0) AS any_done FROM segs GROUP BY doc_id, pos)
        SELECT n.doc_id, n.pos, md5(CASE WHEN any_done THEN merged ELSE text END) AS text_md5 FROM nodes n LEFT JOIN m USING (doc_id, pos)""",
    "q34_stratified_sample": f"""WITH {NODES}, b AS (SELECT doc_id, list(text ORDER BY pos) AS t FROM nodes WHERE (kind = 'heading' AND level = 1) OR kind = 'paragraph' GROUP BY doc_id),
        o AS (SELECT doc_id, t, list_concat([1, len(t)], CASE WHEN len(t) > 2 THEN [(len(t) - 1) // 2 + 1] ELSE [] END, range(1, len(t) + 1)) AS r FROM b),
        v AS (SELECT doc_id, list_transform(list_filter(range(1, len(r) + 1), lambda i: list_position(r, r[i]) = i), lambda i: {{'parts': [t[r[i]]], 'used': length(t[r[i]]), 'is_full': false}}) AS x FROM o),
        s AS (SELECT doc_id, list_reduce(x, lambda a, y: CASE
                WHEN a.is_full THEN a
                WHEN length(y.parts[1]) <= 600 - a.used - (CASE WHEN len(a.parts) > 0 THEN 2 ELSE 0 END)
                    THEN {{'parts': list_concat(a.parts, y.parts), 'used': a.used + (CASE WHEN len(a.parts) > 0 THEN 2 ELSE 0 END) + y.used, 'is_full': false}}
                WHEN 600 - a.used - (CASE WHEN len(a.parts) > 0 THEN 2 ELSE 0 END) > 3
                    THEN {{'parts': list_append(a.parts, substr(y.parts[1], 1, 600 - a.used - (CASE WHEN len(a.parts) > 0 THEN 2 ELSE 0 END) - 3) || '…'), 'used': a.used, 'is_full': true}}
                ELSE {{'parts': a.parts, 'used': a.used, 'is_full': true}} END,
                {{'parts': []::VARCHAR[], 'used': 0::BIGINT, 'is_full': false}}) AS a FROM v)
        SELECT doc_id, array_to_string(a.parts, chr(10) || chr(10)) AS sample FROM s""",
    "q39_toc_pages": f"""WITH {LINES}, p AS (SELECT doc_id, pos // 5 AS page, arg_min(length(line), pos) AS first_n, count(*) FILTER (NOT ends_with(line, '.')) / count(*) AS leader_share FROM lines GROUP BY ALL),
        f AS (SELECT *, first_n < 60 AS titled, leader_share >= 0.2 AS leader FROM p),
        r AS (SELECT *, sum(CASE WHEN NOT titled AND NOT leader THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM f)
        SELECT doc_id, CAST(page AS INT) AS page, (titled OR leader) AND sum(CASE WHEN titled THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY page) > 0 AS in_toc FROM r""",
    "q44_chapters": f"""WITH {NODES}, c AS (SELECT *, CAST(sum(CASE WHEN kind = 'heading' AND level = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS chapter_no,
            coalesce(last_value(CASE WHEN kind = 'heading' AND level = 1 THEN text END IGNORE NULLS) OVER w, 'Book') AS chapter_title
            FROM nodes WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc_id, chapter_no, chapter_title, count(*) AS n_nodes FROM c GROUP BY ALL""",
    "q65_titles": f"WITH {NODES} SELECT doc_id, arg_min(text, pos) AS title FROM nodes WHERE kind = 'heading' AND level = 1 GROUP BY doc_id",
    "q66_nodes_by_id": f"WITH {NODES}, i AS (SELECT * REPLACE (kind || '-' || substr(sha256(kind || chr(0) || text || chr(0) || '0'), 1, 12) AS node_id) FROM nodes) SELECT doc_id, node_id, max(pos) AS pos, arg_max(kind, pos) AS kind FROM i GROUP BY doc_id, node_id",
    "q48_digits": "SELECT doc_id, md5(translate(text, '0123456789', '۰۱۲۳۴۵۶۷۸۹')) AS persian, md5(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩')) AS arabic FROM documents",
    "q49_direction": "SELECT lang, CASE WHEN doc_id % 3 = 1 THEN 'ltr' ELSE 'rtl' END AS direction, count(*) AS n FROM documents GROUP BY ALL",
    "q50_slugs": r"""WITH n AS (SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g'), '[/\\:*?"<>|\x00\s]', '-', 'g'), '-+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 1, 80), ''), 'book') AS stem FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS n FROM n)
        SELECT doc_id, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS slug FROM r""",
    "q51_asset_dedupe": "SELECT 'asset-' || substr(sha256(coalesce(text, '')), 1, 16) AS asset_id, count(*) AS refs, min(doc_id) AS first_doc, CAST(min(strlen(coalesce(text, ''))) AS INT) AS n_bytes FROM documents GROUP BY sha256(coalesce(text, ''))",
    "q60_safe_filenames": r"""SELECT page_id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(' . ' || url || '.PDF'), '[/\\:*?"<>|\x00]', '', 'g'), '^[ .]+|[ .]+$', '', 'g'), '(?i)\.(pdf|epub)$', '')), 1, 120), ''), 'book') AS filename, 'html' AS format FROM pages""",
}
