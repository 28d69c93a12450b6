"""Queries over pages, images and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout, segments
from quire.plans.common import LINES, documents
from quire.plans.store import _SPANS, _spans
from quire.sources import readers


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def q88_contents_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of eight lines; two of three lines are entries, some a title."""
    entry = F.concat(F.md5(F.col("line").cast("binary")), F.lit(" .... "), (F.col("pos") % 1000).cast("string"))
    text = F.when(F.col("pos") % 40 == 0, F.lit(" Contents: ")).when(F.length("line") % 3 != 0, entry).otherwise(F.col("line"))
    pages = layout.leader_pages(_lines(spark, sf).select("doc_id", F.floor(F.col("pos") / 8).cast("int").alias("page"), "pos", text.alias("text")))
    return layout.contents_pages(pages)


def q89_page_items(spark: SparkSession, sf: str) -> DataFrame:
    """Spans as boxes: monospaced ones are tables, even ones of the rest images."""
    s = _spans(spark, sf).select("doc_id", (F.col("page") % 50).alias("page"), "block", F.col("line").alias("found"), "x0", "y0", "n", "mono")
    grids = s.filter("mono").select("*", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 5).alias("y1"), F.col("block").alias("rows"), (F.col("block") % 3 + 1).alias("cols"))
    images = s.filter("not mono and block % 2 = 0").select("*", (F.col("x0") + F.col("n")).alias("x1"), (F.col("y0") + F.col("n")).alias("y1"))
    prose = s.filter("not mono and block % 2 = 1").select("*", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 5).alias("y1"))
    return layout.page_items(prose, grids, images).select("doc_id", "page", F.col("pos").cast("int").alias("pos"), "kind", "found", "x0", "y0")


#: Fixed values of q90: sources by a line's number, files of every document, and
#: the file that each source names.
SOURCES = ("img/p{k}.png", "../img/p{k}.png", "./a/../img/p1.png?x=1#y", "http://x/p1.png", "other%20dir/p2.png", None)
FILES = ("book/ch/img/p0.png", "book/ch/img/p1.png", "book/img/p0.png", "book/img/p2.png", "other dir/p2.png", "book/ch/other dir/p2.png", "zzz/./p3.png")
NAMED = {
    "img/p0.png": "book/ch/img/p0.png", "img/p1.png": "book/ch/img/p1.png", "img/p2.png": "book/img/p2.png", "img/p3.png": "zzz/./p3.png",
    "../img/p0.png": "book/img/p0.png", "../img/p1.png": "book/ch/img/p1.png", "../img/p2.png": "book/img/p2.png", "../img/p3.png": "zzz/./p3.png",
    "./a/../img/p1.png?x=1#y": "book/ch/img/p1.png", "other%20dir/p2.png": "book/ch/other dir/p2.png",
}


def _illustrated(spark: SparkSession, sf: str) -> DataFrame:
    """A figure of two images for each line."""
    place = F.col("pos") % 6
    src = F.lit(None).cast("string")
    for k, pattern in enumerate(SOURCES[:-1]):
        src = F.when(place == k, F.replace(F.lit(pattern), F.lit("{k}"), (F.col("pos") % 4).cast("string"))).otherwise(src)
    image = lambda s, caption: F.struct(s.alias("src"), F.col("line").alias("alt"), caption.alias("caption"))
    images = F.array(image(src, F.concat(F.lit("Fig. "), F.col("line"))), image(F.lit("img/p0.png"), F.lit(None).cast("string")))
    figure = F.col("pos") % 4 == 1
    n = _lines(spark, sf).select("doc_id", "pos", F.concat_ws(":", F.lit("n"), "pos").alias("node_id"), F.when(figure, "figure").otherwise("paragraph").alias("kind"), F.when(~figure, F.col("line")).alias("text"), images.alias("images"))
    return n.withColumns({"images": F.when(figure, F.col("images")), "base": F.lit("book/ch/c.xhtml"), "heading_path": F.array().cast("array<string>")})


def q90_image_files(spark: SparkSession, sf: str) -> DataFrame:
    n = _illustrated(spark, sf)
    files = documents(spark, sf).select("doc_id", F.explode(F.array(*map(F.lit, FILES))).alias("path"))
    found = readers.resolve_images(n, files)
    shown = readers.with_assets(n.filter("images is not null"), found).select("doc_id", "node_id", F.size("images").alias("shown"))
    return found.join(shown, ["doc_id", "node_id"]).select("doc_id", "node_id", "image", "src", "path", "shown")


def q93_image_units(spark: SparkSession, sf: str) -> DataFrame:
    """Captions and alternative texts translated as units and put back."""
    n = _illustrated(spark, sf)
    s = segments.build_segments(n, limit=10_000_000)
    done = s.select("doc_id", "id", F.when(F.col("ordinal") % 3 != 0, F.concat(F.lit("[fa] "), F.col("source_text"))).alias("target_text"))
    out = segments.apply_translations(n, s, done)
    told = F.array_join(F.transform("images", lambda i: F.concat_ws("|", F.coalesce(i["caption"], F.lit("-")), i["alt"])), "|")
    return out.select("doc_id", "node_id", F.md5(F.coalesce("text", F.lit("-")).cast("binary")).alias("text_md5"), F.md5(F.coalesce(told, F.lit("-")).cast("binary")).alias("images_md5"))


QUERIES = {f.__name__: f for f in (q88_contents_pages, q89_page_items, q90_image_files, q93_image_units)}

_FIGURES = f"""{LINES}, n AS (SELECT doc_id, pos, 'n:' || pos AS node_id, line, pos % 4 = 1 AS figure FROM lines)"""
_SRC = "CASE pos % 6 " + " ".join(f"WHEN {k} THEN replace('{s}', '{{k}}', (pos % 4)::VARCHAR)" for k, s in enumerate(SOURCES[:-1])) + " END"
_PATH = "CASE src " + " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in NAMED.items()) + " END"

ORACLES = {
    "q88_contents_pages": f"""WITH {LINES}, t AS (SELECT doc_id, pos // 8 AS page, pos, CASE WHEN pos % 40 = 0 THEN ' Contents: ' WHEN length(line) % 3 <> 0 THEN 'x .... 1' ELSE line END AS text FROM lines),
        p AS (SELECT doc_id, CAST(page AS INT) AS page, coalesce(arg_min(text, pos) FILTER (regexp_matches(text, '\\S')) = ' Contents: ', false) AS titled,
                     count(*) FILTER (regexp_matches(text, '\\S')) >= 3 AND count(*) FILTER (regexp_matches(regexp_replace(text, '\\s+$', ''), '^\\s*.{{1,120}}?[ \\t.․·]{{2,}}\\p{{Nd}}{{1,4}}\\s*$')) >= 0.6 * count(*) FILTER (regexp_matches(text, '\\S')) AS leader FROM t GROUP BY ALL),
        r AS (SELECT *, sum(CASE WHEN NOT titled AND NOT leader THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM p)
        SELECT doc_id, page, titled, leader, (titled OR leader) AND sum(CASE WHEN titled THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY page) > 0 AS in_toc FROM r""",
    "q89_page_items": f"""WITH {_SPANS}, b AS (SELECT doc_id, page % 50 AS page, block, line AS found, x0, y0, n, mono FROM spans),
        g AS (SELECT * FROM b WHERE mono AND block >= 2 AND block % 3 >= 1),
        i AS (SELECT doc_id, page, x0, y0, found, 'table' AS kind, 0 AS k FROM g UNION ALL SELECT doc_id, page, x0, y0, found, 'image', 1 FROM b WHERE NOT mono AND block % 2 = 0 AND n >= 24
              UNION ALL SELECT doc_id, page, x0, y0, found, 'prose', 2 FROM b WHERE NOT mono AND block % 2 = 1 AND NOT EXISTS (SELECT 1 FROM g t WHERE t.doc_id = b.doc_id AND t.page = b.page AND b.x0 < t.x0 + 60 AND t.x0 < b.x0 + 60 AND b.y0 < t.y0 + 5 AND t.y0 < b.y0 + 5))
        SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, k, found) - 1 AS INT) AS pos, kind, found, x0, y0 FROM i""",
    "q90_image_files": f"""WITH {_FIGURES}, i AS (SELECT doc_id, pos, node_id, 0 AS image, {_SRC} AS src FROM n WHERE figure UNION ALL SELECT doc_id, pos, node_id, 1, 'img/p0.png' FROM n WHERE figure)
        SELECT doc_id, node_id, image, src, {_PATH} AS path, CAST(count({_PATH}) OVER (PARTITION BY doc_id, pos) AS INT) AS shown FROM i""",
    "q93_image_units": f"""WITH {_FIGURES}, u AS (SELECT doc_id, pos, unnest(CASE WHEN figure THEN [1, 2, 3] ELSE [0] END) AS slot, unnest(CASE WHEN figure THEN ['Fig. ' || line, line, line] ELSE [line] END) AS t FROM n),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, slot) - 1 AS ordinal FROM u WHERE regexp_matches(t, '\\S')),
        f AS (SELECT u.doc_id, u.pos, u.slot, CASE WHEN ordinal % 3 <> 0 THEN '[fa] ' || u.t ELSE u.t END AS t FROM u LEFT JOIN o USING (doc_id, pos, slot)),
        w AS (SELECT doc_id, pos, max(t) FILTER (slot = 0) AS text, max(t) FILTER (slot = 1) AS c, max(t) FILTER (slot = 2) AS a, max(t) FILTER (slot = 3) AS b FROM f GROUP BY doc_id, pos)
        SELECT n.doc_id, node_id, md5(coalesce(text, '-')) AS text_md5, md5(CASE WHEN figure THEN c || '|' || a || '|-|' || b ELSE '-' END) AS images_md5 FROM n JOIN w USING (doc_id, pos)""",
}
