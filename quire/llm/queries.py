"""The registered queries of the corpus operators, and their SQL where it exists.

Each query applies its operator, with its default (production) parameters, to
the whole table and returns the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import language
from quire.llm.brown import language_model_scores
from quire.llm.common import fold, table
from quire.llm.curriculum import mixture
from quire.llm.exact_dedup import exact_groups
from quire.llm.hnsw import nearest
from quire.llm.importance import resample
from quire.llm.jaccard_join import near_duplicate_groups
from quire.llm.license_scan import scan_licenses
from quire.llm.merkle import manifest
from quire.llm.packing import pack_documents
from quire.llm.token_files import token_index
from quire.llm.toxicity import score_documents, train
from quire.llm.url_filter import RULES, SOFT_LIMIT, SOFT_TERMS, STRICT_TERMS, judge_urls


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_brown_lm": op3_brown_lm,
    "op4_pack": op4_pack,
    "op5_license_scan": op5_license_scan,
    "op6_mix": op6_mix,
    "op7_nearest": op7_nearest,
    "op8_language": op8_language,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
    "op11_importance": op11_importance,
    "op12_url_filter": op12_url_filter,
    "op13_merkle": op13_merkle,
}

#: crc32's table by its rule, and the crc32 of a text's bytes by that table.
_CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _hex(digits: str, at: str) -> str:
    return f"(instr('0123456789abcdef', substr({digits}, {at}, 1)) - 1)"


def _crc32(text: str) -> str:
    codes = f"list_transform(range(0, strlen({text})), lambda i: {_hex(f'lower(hex({text}))', '2 * i + 1')} * 16 + {_hex(f'lower(hex({text}))', '2 * i + 2')})"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"


def _merkle_levels(name: str, levels: int = 6) -> str:
    """Levels of the trees in {name}0 (g, r, n, h): nodes, and each one's siblings."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT g, r // 16 AS r, n, CASE WHEN n > {16**k} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, n, r // 16)")
        run = f"PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT g, r, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS t FROM {name}{k})")
    return ",\n".join(out)


def _merkle_climb(name: str, levels: int = 6) -> tuple[str, str, str]:
    """Joins of a leaf x to its siblings of every level, the siblings in order,
    and the digest that ``start`` leads to."""
    joins = " ".join(f"JOIN {name}s{k} AS {name}x{k} ON {name}x{k}.g = x.{name}g AND {name}x{k}.r = x.{name}r // {16**k}" for k in range(levels))
    siblings = " || ".join(f"{name}x{k}.l || {name}x{k}.t" for k in range(levels))
    folded = "{start}"
    for k in range(levels):
        folded = f"CASE WHEN x.{name}n > {16**k} THEN sha256({name}x{k}.l || {folded} || {name}x{k}.t) ELSE {folded} END"
    return joins, siblings, folded


def _merkle_sql() -> str:
    def written(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    leaf, lower = "sha256(" + " || ".join(written(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")", f"translate(text, '{_UPPER}', '{_LOWER}')"
    joins, siblings, _ = _merkle_climb("a")
    top_joins, top_siblings, _ = _merkle_climb("b")
    steps = [(name, k) for name in "ab" for k in range(6)]
    fold = "".join(f", f{i + 1} AS (SELECT * EXCLUDE (f), CASE WHEN {n}n > {16**k} THEN sha256({n}l{k} || f || {n}t{k}) ELSE f END AS f FROM f{i})" for i, (n, k) in enumerate(steps))
    return f"""WITH t AS ({_CRC_TABLE}),
        d AS (SELECT doc_id, source, {leaf.format(text="text")} AS leaf,
                     CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf.format(text=lower)} ELSE {leaf.format(text="text")} END AS tampered FROM documents, t),
        x AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS ag, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ar, count(*) OVER (PARTITION BY source) AS an FROM d),
        a0 AS (SELECT ag AS g, ar AS r, an AS n, leaf AS h FROM x),
        {_merkle_levels("a")},
        b0 AS (SELECT 0 AS g, g AS r, count(*) OVER () AS n, h FROM a6),
        {_merkle_levels("b")},
        f0 AS (SELECT x.doc_id, x.leaf, x.tampered AS f, x.an, x.bn, a6.h AS subroot, b6.h AS root, sha256({siblings} || {top_siblings}) AS proof_sha256,
                      {", ".join(f"{n}x{k}.l AS {n}l{k}, {n}x{k}.t AS {n}t{k}" for n, k in steps)}
               FROM (SELECT *, 0 AS bg, ag AS br, (SELECT max(n) FROM b0) AS bn FROM x) AS x {joins} {top_joins} JOIN a6 ON a6.g = x.ag CROSS JOIN b6){fold}
        SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"""


def _url_sql() -> str:
    terms = ", ".join(f"('{t}', {str(t in STRICT_TERMS).lower()})" for t in sorted({*STRICT_TERMS, *SOFT_TERMS}))
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    return f"""WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
        rules(action, h, start) AS (VALUES {rules}), terms(term, strict) AS (VALUES {terms}),
        fit AS (SELECT rid, arg_max(h || start, len(h || start)) AS rule, arg_max(action, len(h || start)) AS action FROM p JOIN rules ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, start) GROUP BY rid),
        hits AS (SELECT rid, count(*) FILTER (strict) AS strict_terms, count(*) FILTER (NOT strict) AS soft_terms FROM p JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY rid)
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(strict_terms, 0) >= 1 OR coalesce(soft_terms, 0) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
               coalesce(strict_terms, 0) AS strict_terms, coalesce(soft_terms, 0) AS soft_terms
        FROM p LEFT JOIN fit USING (rid) LEFT JOIN hits USING (rid)"""


def _importance_sql() -> str:
    def words(key: str, source: str) -> str:
        return f"SELECT '{source}' AS side, {key} AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM_WORD}')) AS w FROM {source}"

    head = " + ".join(f"CAST({_hex('h', str(k))} AS BIGINT) * {16 ** (8 - k)}" for k in range(1, 9))
    return f"""WITH t AS ({_CRC_TABLE}), words AS ({words("doc_id", "documents")} UNION ALL {words("item_id", "benchmark")}),
        known AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), t),
        held AS (SELECT bucket, CAST(count(*) FILTER (side = 'documents') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 'benchmark') AS DOUBLE) AS t FROM words JOIN known USING (w) GROUP BY bucket),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM held),
        w AS (SELECT id AS doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM words JOIN known USING (w) JOIN gain USING (bucket) WHERE side = 'documents' GROUP BY id),
        d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('2024:' || doc_id) AS h FROM documents LEFT JOIN w USING (doc_id)),
        e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((({head}) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM r"""


ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_mix": r"""
        WITH d AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
        w AS (SELECT *, CAST(rank % 3 + 1 AS DOUBLE) AS weight, [-0.5, 0.0, 0.5][CAST(rank % 3 + 1 AS INT)]::DOUBLE AS slope, source_size * 3 AS cap FROM r),
        f AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
                     CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped_before,
                     sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM w),
        l AS (SELECT *, (total - capped_before) / weight_from AS level FROM f),
        o AS (SELECT *, cap >= weight * level AS is_open FROM l),
        t AS (SELECT source, source_size, slope,
                     CASE WHEN is_open THEN least(weight * (SELECT arg_min(level, [cap / weight, rank]) FROM o WHERE is_open), CAST(cap AS DOUBLE))
                          ELSE CAST(cap AS DOUBLE) END AS target FROM o),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
                     CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p),
        k AS (SELECT *, whole * size + greatest(0, least(goal - whole * source_size - off, size)) AS taken FROM q)
        SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
               CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN off / target
                    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (off / target)) - (1 - slope)) / (2 * slope) END END AS position
        FROM k""",
    "op11_importance": _importance_sql(),
    "op12_url_filter": _url_sql(),
    "op13_merkle": _merkle_sql(),
}
