"""Importance resampling, URL filters and the Merkle manifest against
brute-force versions, on small odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hnsw, importance, merkle, ranks, toxicity, url_filter
from quire.llm.common import bounded_sample
from tests.llm.test_corpus_ops import ODD, SCHEMA


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.createDataFrame(ODD, SCHEMA)
    clash = {c: F.lit("clash") for c in ("tree", "leaf", "node", "at", "n", "id", "tie", "score", "weight", "rank", "path", "n_chars", "_tie", "_range")}
    return base.withColumns(clash)


def test_ranked_numbers_groups_of_any_size(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 7 > 0, F.concat(F.lit("g"), (F.col("id") % 5).cast("string")))).alias("g"), (F.col("id") % 11).alias("v"), F.col("id").alias("own"))
    got = defaultdict(list)
    for r in ranks.ranked(rows, ["g"], [F.col("v").desc()], "t").collect():
        got[r.g].append((r.at, r.v, r.n))
    assert sum(map(len, got.values())) == 2000 and None in got
    for group in got.values():
        group.sort()
        assert [a for a, _, _ in group] == list(range(len(group)))
        assert [v for _, v, _ in group] == sorted((v for _, v, _ in group), reverse=True)
        assert {n for _, _, n in group} == {len(group)}
    same = spark.range(900).select(F.lit(1).alias("v"))
    assert sorted(r.at for r in ranks.ranked(same, [], [F.col("v")], "t").collect()) == list(range(900))


# Importance resampling


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_scores(docs, target, buckets, longest, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        n, f = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = total // len(f) if f else 0
        out.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize(("percent", "least", "longest"), [(10, 20, 1), (50, 1, 1), (100, 0, 2), (40, 3, 3), (0, 0, 1)])
def test_resample_equals_brute_force(spark, percent, least, longest):
    rng = np.random.default_rng(5)
    vocabulary = ["Alpha", "beta", "γάμμα", "x9", "THE", "end", "中文", "naïve"]
    docs = [(int(i), " ,\n"[i % 3].join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(160)]
    docs += [(900, "beta " * 30), (900, "beta " * 30), (901, None), (None, "x9 " * 25), (902, "!!!")]
    target = ["alpha beta alpha", None, "γάμμα end"]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), percent, least, 64, longest, 7)
    want = brute_scores(docs, target, 64, longest, 7)
    able = sorted((r for r in want if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    rows = got.collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == Counter((r[0], *r[2:]) for r in want)
    ranks_got = sorted((r.rank, r.doc_id, r.score) for r in rows if r["rank"] is not None)
    assert ranks_got == [(k, r[0], r[4]) for k, r in enumerate(drawn, 1)]


def test_draw_among_rows_that_tie(spark):
    """All scores equal, then all ids too: exactly the count is drawn."""
    for key in ("id", "5L", "null"):
        rows = spark.range(500).selectExpr("7L as score", f"cast({key} as long) as id", "id as tie")
        for count in (1, 250, 499, 500):
            got = rows.filter(importance.draw(rows, count)).collect()
            assert len(got) == count
            if key == "id":
                assert {r.id for r in got} == set(range(count))
    assert importance.draw(spark.range(1).selectExpr("1L as score", "id", "id as tie"), 0) is None


def test_resample_on_odd_rows_and_empty_tables(spark, odd):
    got = importance.resample(odd, odd, 50, 1).collect()
    want = brute_scores([r[:2] for r in ODD], [r[1] for r in ODD], importance.BUCKETS, 1, importance.SEED)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((r[0], *r[2:]) for r in want)
    able = sum(r[1] >= 1 for r in want)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, able // 2 + 1))
    assert importance.resample(odd.filter("false"), odd).count() == 0
    assert importance.resample(odd, odd.filter("false")).count() == len(ODD)


def test_words_of_long_texts_come_in_parts(monkeypatch):
    text = "Ab, çd 9e\x00f " * 50 + "tail" * 20
    whole = [w for part in importance.word_parts(text.encode()) for w in part]
    for size in (1, 7, 64):
        monkeypatch.setattr(importance, "PART", size)
        assert [w for part in importance.word_parts(text.encode()) for w in part] == whole
        found = Counter(np.concatenate(list(importance.buckets_of(text.encode(), 50, 2))).tolist())
        assert found == Counter(zlib.crc32(b" ".join(whole[i : i + n])) % 50 for n in (1, 2) for i in range(len(whole) - n + 1))


# URL filters


def brute_url(url, rules, strict, soft, limit):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = ascii_lower(re.match(r"[^/?#]*", rest, re.S).group(0))
        path = re.match(r"[^?#]*", rest[len(host) :], re.S).group(0)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = ascii_lower(url or "")
    hit = {t for t in {*strict, *soft} if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)}
    s = len(hit & set(strict))
    own = "block" if s or len(hit) - s >= limit else "allow"
    best = max(fits, default=(0, 0, False, None, own))
    return (host, path, best[3], best[4], s, len(hit) - s)


URLS = [
    None, "", "no scheme.com/en/", "http://Example.COM/en/1", "https://www.example.com/en/a?b=/#c", "http://a.www.example.com/en/", "http://example.com",
    "http://example.com/", "http://badexample.com/en/x", "http://x.net/es/1", "http://net/es/", "http://x.net/en/porn", "http://x.net/sporn", "http://x.org/free-bets/9",
    "http://x.org/FREE/free", "ftp://casino-win.org", "http://x.org/a?q=xxx", "http://x.org/#viagra_1", "http://x.org:80/es/", "a://b://c.net/fr/", "http://é.net/fr/ß?casino&win", "http://x.org/" + "w/" * 60_000 + "porn",
]


def test_urls_equal_brute_force(spark):
    rows = [(k, u) for k, u in enumerate([*URLS, "http://x.net/es/1"])] + [(None, "http://x.com/"), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' as host", "1 as id", "true as verdict", "null as html")
    got = [tuple(r) for r in url_filter.judge_urls(pages).collect()]
    want = [(i, *brute_url(u, url_filter.RULES, url_filter.STRICT_TERMS, url_filter.SOFT_TERMS, 2)) for i, u in rows]
    assert Counter(got) == Counter(want)
    assert url_filter.judge_urls(pages.filter("false")).count() == 0


def test_url_terms_and_rules_given(spark):
    rules = (("block", "b.com", "/"), ("allow", "com", "/ab"), ("allow", "b.com", "/"), ("block", "", "/any"))
    urls = ["http://b.com/abc", "http://b.com/", "http://c.com/abd", "http:///any/x", "http://q.org/he-she-hers", "http://q.org/usher", "http://q.org/she.he"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = [tuple(r)[1:] for r in url_filter.judge_urls(pages, rules=rules, strict=("HERS",), soft=("he", "she", "", "hers"), soft_limit=2).orderBy("page_id").collect()]
    assert [(r[2], r[3]) for r in got] == [("b.com/", "block"), ("b.com/", "block"), ("com/ab", "allow"), ("/any", "block"), (None, "block"), (None, "allow"), (None, "block")]
    assert [r[4:] for r in got[4:]] == [(1, 2), (0, 0), (0, 2)]
    assert url_filter.judge_urls(pages, rules=(), strict=(), soft=()).filter("verdict = 'block'").count() == 0
    with pytest.raises(ValueError, match="characters"):
        url_filter.judge_urls(pages, soft=("a" * (url_filter.MOST_CHARS + 1),))


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(nodes):
        """The top, and each node's (left, right) of every level."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for i, place in enumerate(at):
                run = place // 16 * 16
                steps[i].append(("".join(level[run:place]), "".join(level[place + 1 : run + 16])))
                at[i] = place // 16
            level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        return level[0], steps

    groups = defaultdict(list)
    for r in rows:
        changed = r[:4] + (None if r[4] is None else ascii_lower(r[4]),)
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[1]].append((r[0], leaf(r), leaf(changed) if hit else leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(climb([x[1] for x in groups[g]]))
    if not trees:
        return []
    root, upper = climb([t[0] for t in trees])
    out = []
    for g, (subroot, steps), above in zip(order, trees, upper, strict=True):
        for (i, own, forged), path in zip(groups[g], steps, strict=True):
            folded = forged
            for left, right in path + above:
                folded = sha(left + folded + right)
            out.append((i, own, subroot, root, sha("".join(a + b for a, b in path + above)), folded, folded == root))
    return out


def as_manifest(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16, 17, 1, 15], [257, 3], [40, 600]])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(k * 1000 + i, [None, "a", "Z", "é"][k], "en", i, f"Text {i} of {k}") for k, n in enumerate(sizes) for i in range(n)]
    assert Counter(map(tuple, merkle.manifest(as_manifest(spark, rows)).collect())) == Counter(brute_manifest(rows))


def test_manifest_over_several_tiers(spark, monkeypatch):
    """Blocks of 16 leaves, many sources: both trees have several tiers."""
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, "hot" if i % 2 else f"s{i % 34:02}", None, None, f"T{i}") for i in range(900)]
    assert Counter(map(tuple, merkle.manifest(as_manifest(spark, rows)).collect())) == Counter(brute_manifest(rows))


def test_manifest_of_odd_rows(spark, odd):
    docs = odd.withColumn("n_chars", F.col("key"))
    got = merkle.manifest(docs).collect()
    want = brute_manifest([(i, s, lang, k, t) for i, t, lang, s, k in ODD])
    assert Counter(map(tuple, got)) == Counter(want) and len(got) == len(ODD)
    assert merkle.manifest(docs.filter("false")).count() == 0
    same = as_manifest(spark, [(1, "a", "en", 1, "Same")] * 40)
    assert Counter(map(tuple, merkle.manifest(same).collect())) == Counter(brute_manifest([(1, "a", "en", 1, "Same")] * 40))


# Nearest neighbours: what the index promises at its full size


@pytest.mark.parametrize(("dim", "clusters"), [(64, 0), (128, 0), (384, 0), (128, 64)])
def test_recall_of_a_full_shard(dim, clusters):
    r = np.random.default_rng(dim)
    v = r.standard_normal((hnsw.SHARD, dim))
    if clusters:
        v = r.standard_normal((clusters, dim))[r.integers(0, clusters, len(v))] + 0.3 * v
    u = hnsw.unit(v)
    found = hnsw.Graph.build(u).search(u[:164], 20, hnsw.beam_of(dim))
    best = np.argsort(-(u[:164] @ u.T), 1)[:, :6]
    hits = sum(len(set(a[:6].tolist()) & set(b.tolist())) for a, b in zip(found, best, strict=True))
    assert hits >= 0.94 * 6 * 164


def test_nearest_of_huge_and_tiny_vectors(spark, monkeypatch):
    """Squares that overflow or vanish, over several shards and lengths."""
    monkeypatch.setattr(hnsw, "SHARD", 8)
    monkeypatch.setattr(hnsw, "BLOCK", 3)
    r = np.random.default_rng(3)
    rows = [(i, (r.standard_normal(3) * 10.0 ** r.choice([-300, -200, 0, 200, 300])).tolist()) for i in range(60)] + [(100 + i, [float(i + 1), 1e200]) for i in range(5)]
    rows += [(200, [5e-324, 0.0, 0.0]), (201, [1.7e308, 0.0, 0.0])]
    got = defaultdict(list)
    for x in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    known = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    assert set(got) == {i for i in known if i % 5 == 0}
    for q, found in got.items():
        score = {i: float(known[q] @ v / np.linalg.norm(known[q]) / np.linalg.norm(v)) for i, v in known.items() if i != q and len(v) == len(known[q])}
        want = sorted(score, key=lambda i: (-round(score[i], 11), i))[:5]
        assert [round(s, 9) for _, s in found] == [round(score[i], 9) for i in want]
        assert all(abs(s - score[i]) < 1e-12 for i, s in found)


# Toxicity, and the samples that classifiers are fitted on


def brute_toxicity(text, weights, bias):
    """Noisy-or over sentences, each the logistic of its different words' weights."""
    clean, worst = 1.0, None
    for sentence in re.split(r"[.!?\n\r]+", text.lower()):
        words = {w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", sentence.encode()) if w}
        if words:
            p = 1 / (1 + math.exp(-max(-30, min(30, bias + sum(weights.get(w, 0.0) for w in words)))))
            clean *= 1 - min(p, 1 - 1e-12)
            worst = p if worst is None else max(worst, p)
    return 1 - clean, worst


def test_toxicity_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    names = [b"bad", b"awful", b"fine", "b\u00f6se".encode(), "\u574f".encode(), b"x9", b"ok", b"idiot"]
    weights = {w: float(rng.normal() * 4) for w in names}
    model = toxicity.NoisyOrModel({b"|": -1} | {w: k for k, w in enumerate(names, 1)}, np.r_[0.0, [weights[w] for w in names]], -2.0)
    said = [w.decode() for w in names] + ["other", "unknown", "B\u00d6SE", "Bad"]
    texts = ["", "...", "!?\n\r", "bad bad bad", "Bad. bad! BAD?", "bad, awful; \u574f.", "a\x00bad\x1fawful", "b\u00f6se\u2026 \u574f", ". bad", "bad .", "idiot" * 3, "x9x9 x9", "bad " * 250_000 + ". fine"]
    texts += ["".join(rng.choice([*said, " ", ". ", "\n", "? ", ", "]) + rng.choice([" ", ""]) for _ in range(rng.integers(1, 60))) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None)]
    for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        score, worst = brute_toxicity(rows[min(r.doc_id, len(texts))][1] or "", weights, -2.0)
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(score >= 0.5)
        assert (r.worst_sentence is None) == (worst is None)


def test_samples_hold_each_text_once(spark):
    """An id that repeats, with one text or many, stays within the bounds."""
    texts = spark.range(6000).selectExpr("id % 3 as id", "case when id % 3 = 0 then 'same' else concat('text ', id) end as text").unionByName(spark.createDataFrame([(3, None), (4, ""), (5, "long" * 300)], "id long, text string"))
    marks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "a"), (4, "a"), (5, "c")], "id long, label string")
    got = bounded_sample(marks, texts, 40, 1000)
    count = Counter(label for label, _ in got)
    assert [t for label, t in got if label == "a"] == ["same"] and count["c"] == 0
    assert 1 < count["b"] <= 80 and sum(len(t) for label, t in got if label == "b") <= 1000
    assert len(set(got)) == len(got)
    assert bounded_sample(marks.filter("false"), texts, 40, 1000) == []
    with pytest.raises(ValueError, match="labels"):
        bounded_sample(spark.range(10_001).selectExpr("id", "id as label"), texts, 1, 10)
