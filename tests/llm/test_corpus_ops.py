"""Corpus operators on small odd tables and against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import brown, components, curriculum, exact_dedup, hnsw, jaccard_join, language, license_scan, packing, token_files, toxicity, wavelet
from quire.llm.common import fold
from quire.llm.tokens import default_vocabulary, encode_documents

#: Null and empty texts, null source and lang, ties, a repeated row, a long
#: text, odd characters; and columns whose names operators use themselves.
ODD = [
    (1, "The cat sat on the mat. It was good.", "en", "a", 1),
    (2, "The cat sat on the mat. It was good.", "en", "a", 2),
    (3, None, None, None, 3),
    (4, "", "en", "b", 4),
    (5, "  \n\t ", "de", "b", 5),
    (6, "Released under the MIT License.\nder die das und", "de", None, 6),
    (7, "word " * 30_000, "en", "a", 7),
    (7, "word " * 30_000, "en", "a", 7),
    (8, "naïve Ünder… \x00 \x1c <|endoftext|> ½ 中文。", "fr", "c", 8),
    (None, "no id here", "en", "c", 9),
    (10, "The cat sat on the mat. It was good!", "en", "a", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, key long"


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.createDataFrame(ODD, SCHEMA)
    return base.withColumns({"row": F.lit("r"), "size": F.lit(0), "sha": F.lit(None).cast("string"), "kept": F.lit(True), "id": F.lit(0)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def words(text):
    return (text or "").encode().lower().split()


def test_exact_groups(odd, none):
    got = exact_dedup.exact_groups(odd).collect()
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[t or ""].append(i)
    assert len(got) == len(ODD)
    for r in got:
        text = next(t or "" for i, t, *_ in ODD if i == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.group_size == len(groups[text])
        assert r.keep_id == max((i for i in groups[text] if i is not None), default=None)
    kept = Counter(r.doc_id for r in got if r.kept)
    assert kept == Counter({2: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 1, 10: 1})
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 900).cast("string"))).alias("text"))
    got = {r.doc_id: r for r in exact_dedup.exact_groups(rows).collect()}
    assert sum(r.kept for r in got.values()) == len({r.text_sha256 for r in got.values()})
    assert (got[0].keep_id, got[0].group_size, got[2997].kept) == (2997, 1000, True)


def test_drop_exact_duplicates_keeps_columns(odd, none):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    assert Counter(r.doc_id for r in out.collect()) == Counter([2, 4, 5, 6, 7, 8, None, 10])
    assert exact_dedup.drop_exact_duplicates(none).count() == 0


def brute_mix(rows):
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * size[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}, size
        for s in over:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
        open_ -= over
        if not open_:
            return target, size


def test_mixture(odd, none):
    target, size = brute_mix(ODD)
    got = curriculum.place(odd, carry=True).select("row.source", "row.doc_id", "size", "source_size", "target", "taken").collect()
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.5
    assert curriculum.mixture(none).count() == 0
    again = curriculum.mixture(odd).orderBy("doc_id", "size").collect()
    assert again == curriculum.mixture(odd).orderBy("doc_id", "size").collect()


def test_training_stream(odd, none):
    out = curriculum.training_stream(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} >= {3, 4, 5}
    assert curriculum.training_stream(none).count() == 0


def test_due_inverts_the_schedule(spark):
    rows = spark.createDataFrame([(t / 10, a) for t in range(11) for a in (-0.5, 0.0, 0.5)], "t double, a double")
    share = F.col("t") + F.col("a") * (F.col("t") * F.col("t") - F.col("t"))
    for r in rows.select("t", curriculum.due(share, F.col("a")).alias("x")).collect():
        assert r.x == pytest.approx(r.t, abs=1e-9)


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_encoder_equals_the_tokenizer():
    texts = [t for _, t, *_ in ODD] + ["It's A.B.,c 5. ²., İ. x" + "y" * 80 + ", <|STARTOFTEXT|> <|startoftext|>.", "é. á,b"]
    assert [x.tolist() for x in encode_documents(default_vocabulary(), texts)] == whole_ids(texts)


def test_wavelet_matrix():
    v = np.random.default_rng(0).integers(0, 900, 3000)
    built = wavelet.WaveletMatrix.build(v)
    m = wavelet.WaveletMatrix.from_parts(*built.to_parts(), len(v))
    assert (m.decode() == v).all() and (m.access(np.arange(3000)) == v).all()
    i = np.array([0, 1, 63, 64, 511, 512, 513, 1024, 2999, 3000])
    for x in (int(v[0]), int(v[2999]), 899, 901, 1 << 40):
        assert (m.rank(x, i) == [(v[:k] == x).sum() for k in i]).all() and m.count(x) == (v == x).sum()
        assert (m.positions(x) == np.flatnonzero(v == x)).all()
    assert (m.count(np.arange(900)) == np.bincount(v, minlength=900)).all()
    for bad in (lambda: m.select(901, 0), lambda: m.select(int(v[0]), 3000), lambda: m.access(3000)):
        with pytest.raises(IndexError):
            bad()
    empty = wavelet.WaveletMatrix.from_parts(*wavelet.WaveletMatrix.build(np.zeros(0, int)).to_parts(), 0)
    assert len(empty.decode()) == 0 and empty.count(5) == 0 and len(empty.access([])) == 0


def test_token_lookups_from_the_files(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rows = [(i, t) for i, t, *_ in ODD if i not in (7, None)] + [(100 + k, f"word number {k} of the cat " * (k % 9)) for k in range(80)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), shards=3)
    ids = whole_ids([t for _, t in sorted(rows)])
    flat, owner = np.concatenate(ids), np.repeat([i for i, _ in sorted(rows)], [len(x) for x in ids])
    place = np.concatenate([np.arange(len(x)) for x in ids])
    asked = spark.createDataFrame([(p,) for p in [*range(0, len(flat), 3), 0, len(flat) - 1, len(flat), -1, None]], "position long")
    got = {r.position: r.token for r in token_files.tokens_at(spark, str(tmp_path / "t"), asked).collect()}
    assert got == {p: flat[p] for p in {*range(0, len(flat), 3), len(flat) - 1}}
    some = [1, int(flat[0]), int(flat[-2]), 48000]
    counts = {r.token: r.n for r in token_files.count_tokens(spark, str(tmp_path / "t"), some).collect()}
    assert counts == {t: int((flat == t).sum()) for t in some}
    found = sorted(tuple(r) for r in token_files.find_tokens(spark, str(tmp_path / "t"), some).select("token", "position", "doc_id", "place").collect())
    assert found == sorted((int(flat[p]), int(p), int(owner[p]), int(place[p])) for p in np.flatnonzero(np.isin(flat, some)))
    token_files.write_token_files(none, str(tmp_path / "e"))
    assert token_files.find_tokens(spark, str(tmp_path / "e"), some).count() == 0
    assert {r.n for r in token_files.count_tokens(spark, str(tmp_path / "e"), some).collect()} == {0}


def test_token_files_round_trip(odd, none):
    got = token_files.token_index(odd).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = whole_ids([t for _, t, *_ in rows])
    at = 0
    for r, (i, *_), x in zip(got, rows, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(x))
        assert r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes())
        at += len(x)
    assert token_files.token_index(none).count() == 0


def check_pieces(got, rows):
    ids = defaultdict(list)
    for (i, t, *_), x in zip(rows, whole_ids([t for _, t, *_ in rows]), strict=True):
        ids[i].append(x)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, each in ids.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, each))
        for r in by_doc[i]:
            x = next(x for x in each if len(x) == r.doc_tokens)
            assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
        assert at == pieces[0].sequence_tokens and pieces[0].padding == 0


def test_packing(odd, none):
    check_pieces(packing.pack_documents(odd).collect(), ODD)
    assert packing.pack_documents(none).count() == 0


def test_solved_counts_fit_the_histogram():
    a, h = packing.combination_matrix(16, 3), np.random.default_rng(1).integers(0, 60, 16).astype(float)
    x = packing.solve_counts(a, h)
    assert (x >= 0).all() and (x > 0).sum() <= 16
    w = a.T @ (h - a @ x)  # the conditions of an optimum
    assert w.max() < 1e-6 and np.abs(w[x > 0]).max() < 1e-6
    exact = packing.solve_counts(a, a @ np.r_[5.0, np.zeros(a.shape[1] - 2), 3.0])
    assert a @ exact == pytest.approx(a @ np.r_[5.0, np.zeros(a.shape[1] - 2), 3.0])


def test_most_of_the_corpus_is_placed_by_the_solved_counts(spark):
    """The share of remainders' tokens in windows of solved combinations."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lengths = np.array([len(x) for x in encode_documents(default_vocabulary(), texts)])
    share = Counter()
    for pieces, placed in packing.pack(lengths):
        share[placed] += sum(n for *_, n in pieces)
    assert share[packing.SOLVED] > 0.7 * (share[packing.SOLVED] + share[packing.GREEDY])


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 1], [700] * 50, [1500] * 30, [2047] * 9 + [1] * 9, list(range(1, 2048))])
def test_pack_loses_no_token(lengths):
    seen = defaultdict(list)
    for pieces, _ in packing.pack(np.array(lengths, int)):
        total = sum(n for *_, n in pieces)
        assert total == 2048 or total & (total - 1) == 0
        for d, start, n in pieces:
            seen[d] += range(start, start + n)
    assert all(sorted(seen[d]) == list(range(n)) for d, n in enumerate(lengths))


def brute_blocks(text, templates, threshold, slack):
    """(label, start) of every matching block, block by block."""
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    out = {}
    for label, passage in templates.items():
        t = license_scan.license_words(passage)
        tokens, size = set(zip(t, t[1:], strict=False)), len(t) + math.ceil(slack * len(t))
        if tokens.isdisjoint(zip(w, w[1:], strict=False)):
            continue
        for start in range(max(len(w) - size, 0) + 1):
            part = w[start : start + size]
            share = len(tokens & set(zip(part, part[1:], strict=False))) / len(tokens)
            if math.ceil(threshold * len(tokens) - 1e-9) <= round(share * len(tokens)):
                out[label, start] = share
    return w, out


def license_texts():
    r = np.random.default_rng(5)
    said = [w for t in license_scan.TEMPLATES.values() for w in t.split()]
    rows = [(i, t) for i, t, *_ in ODD]
    for k in range(60):
        text = [said[j] for j in r.integers(0, len(said), r.integers(0, 60))]
        for _ in range(k % 3):
            t = list(license_scan.TEMPLATES.values())[r.integers(len(license_scan.TEMPLATES))].split()
            text[len(text) // 2 : len(text) // 2] = [w if r.random() < 0.97 else "inserted words" for w in t if r.random() < 0.98]
        rows.append((1000 + k, " ".join(text)))
    return rows


def test_license_scan_equals_brute_force(spark, odd, none):
    rows = license_texts()
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = 0
    for (i, text), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, dict(rows).get(r.doc_id)))), strict=True):
        w, blocks = brute_blocks(text, license_scan.TEMPLATES, license_scan.THRESHOLD, license_scan.SLACK)
        places = [(k, label) for k in range(len(w)) for p, label in license_scan.PHRASES.items() if w[k : k + len(p.split())] == p.encode().split()]
        base, own = {x for _, x in places}, {x for x, _ in blocks}
        at = [k for k, _ in places]
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) == (i, len(w), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | own)))
        assert r.score == (1.0 if base else max(blocks.values(), default=0.0))
        found += len(own)
    assert found > 20
    assert license_scan.scan_licenses(none).count() == 0 and license_scan.scan_licenses(odd).count() == len(ODD)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_license_join_finds_every_block(threshold):
    scanner = license_scan.Scanner(license_scan.order_templates({"the": 5, "license": 2}, license_scan.TEMPLATES, threshold), license_scan.PHRASES)
    for _, text in license_texts():
        w, blocks = brute_blocks(text, license_scan.TEMPLATES, threshold, license_scan.SLACK)
        if len(w) < 5000:
            runs = scanner.blocks(w)
            assert {(label, s) for a, b, label, _ in runs for s in range(a, b + 1)} == set(blocks)
            assert all(share == max(blocks[label, s] for s in range(a, b + 1)) for a, b, label, share in runs)


def test_license_blocks(spark, odd, none):
    scanner = license_scan.license_scanner(odd)
    long = "x y " * 20_000 + license_scan.TEMPLATES["isc-text"] + " z" * 50
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(None, long), (77, "released under the stars the mit people hold a license")], "doc_id long, text string"))
    got = sorted((tuple(r) for r in license_scan.license_blocks(docs, scanner).drop("block").collect()), key=str)
    assert [(i, label) for i, _, _, label, _ in got] == [(6, "mit-notice"), (None, "isc-text")]
    assert got[1][4] == 1.0 and got[1][1] <= 40_000 < got[1][2]
    assert license_scan.license_blocks(docs.withColumn("doc_id", F.lit("a")), scanner).count() == 2
    assert license_scan.license_blocks(none, scanner).count() == 0


def test_toxicity(spark, odd, none):
    r = np.random.default_rng(1)
    names = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(700):
        said = [" ".join(names[k] for k in r.integers(0, 60, 8)) for _ in range(5)]
        toxic = i % 3 == 0
        if toxic:
            said[2] += " vile"
        rows.append((i, ". ".join(said)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {x.doc_id: x for x in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i].score >= 0.5) == (i % 3 == 0) == bool(got[i].predicted) for i in held)
    assert all(got[i].worst_sentence == 2 for i in held if i % 3 == 0)
    found = toxicity.offending_sentences(docs, model).collect()
    assert {x.sentence for x in found} == {2} and all("vile" in x.words for x in found)
    scored = {x.doc_id: x.score for x in toxicity.score_documents(odd, model).collect()}
    assert scored[3] == scored[4] == 0.0 and all(0 <= s <= 1 for s in scored.values())
    assert toxicity.score_documents(none, model).count() == 0
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {x.doc_id % 3 for x in kept.collect()} == {1, 2}
    assert toxicity.keep_clean(odd, marks).count() == len(ODD)
    assert toxicity.keep_clean(none, marks.filter("false")).columns == odd.columns


def test_rare_insults_get_a_weight_and_copies_do_not():
    r = np.random.default_rng(7)
    said = [" ".join(f"w{k}" for k in r.integers(0, 300, 12)) for _ in range(4000)]
    rows = [(0, t) for t in said[:2000]] + [(1, t + " vile") for t in said[2000:3600]] + [(1, t + " foul") for t in said[3600:3630]] + [(1, said[3630] + " chance")] * 60
    model = toxicity.fit(rows)
    assert set(model.words) >= {b"vile", b"foul"} and b"chance" not in model.words
    assert [toxicity.noisy_or(p) >= 0.5 for p in model.scores([said[10] + " foul", said[10], said[20] + " vile"])] == [True, False, True]


def test_noisy_or_gradient_finds_the_sentence():
    assert toxicity.noisy_or(np.array([0.5, 0.5])) == pytest.approx(0.75)
    assert toxicity.noisy_or(np.zeros(0)) == 0


def test_language(spark, odd, none):
    en, de = "the cat that was with this and there", "der die und nicht mit auch über schön"
    rows = [(i, " ".join(np.random.default_rng(i).choice((en if i % 2 else de).split(), 20)), "en" if i % 2 else "de") for i in range(90)] + [(900, None, "en"), (901, "12 !", "de"), (902, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(90))
    assert got[900].lang_pred == got[901].lang_pred == "und"
    labels = language.label_positions(model, "Und nicht 1, " * 90 + "the cat that was " * 90)
    assert len(labels) == 90 * (13 + 17) and Counter(labels[:1100]).most_common(1)[0][0] == "de" and Counter(labels[-1400:]).most_common(1)[0][0] == "en"
    assert {r.lang_pred for r in language.identify(odd, model).filter("doc_id in (3, 4, 5)").collect()} == {"und"}
    assert language.identify(none, language.train(none)).count() == 0


def test_gru_gradients():
    m = language.ByteGRU.fresh(["a", "b"], 3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    data, n, label = np.frombuffer(b"hello worldabc1x", np.uint8), np.array([11, 4, 1]), np.array([0, 1, 1])
    x = language.lay_out(data, np.array([0, 11, 15]), n)
    _, g = m.gradients(x, n, label)
    for k, v in m.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-4
        up = m.gradients(x, n, label)[0]
        v[at] = old - 1e-4
        assert (up - m.gradients(x, n, label)[0]) / 2e-4 == pytest.approx(g[k][at], rel=1e-3)
        v[at] = old


def slow_scores(m, data):
    """Log-probabilities of each position, step by step."""
    def states(x, d):
        h, out = np.zeros(m.p["uf"].shape[1]), []
        for b in x:
            a, g = m.p["e" + d][:, b] + m.p["b" + d][:, 0], m.p["u" + d] @ h
            H = len(h)
            r, z = (np.clip((a[k : k + H] + g[k : k + H]) / 4 + 0.5, 0, 1) for k in (0, H))
            h = h + z * (np.tanh(a[2 * H :] + r * g[2 * H :]) - h)
            out.append(h)
        return out

    both = [np.r_[f, b] for f, b in zip(states(data, "f"), states(data[::-1], "b")[::-1], strict=True)]
    return [language.log_softmax(m.p["v"] @ h + m.p["c"][:, 0]) for h in both]


def test_the_state_runs_through_the_text(monkeypatch):
    m = language.ByteGRU.fresh(["a", "b", "c"], 4)
    texts = ["Hello, wörld 12!", "", "x", "中文 und so weiter", "a b c d " * 30]
    sums, counts = language.document_scores(m, texts)
    for t, s, n in zip(texts, sums, counts, strict=True):
        data = language.text_bytes(t)
        tells = [k for k, b in enumerate(data) if b >= 128 or chr(b).isalpha()]
        want = slow_scores(m, data)
        assert n == len(tells) and s == pytest.approx(sum((want[k] for k in tells), np.zeros(3)), abs=1e-3)
    # Windows: every position once, cut between characters, read with what stands around.
    data = language.text_bytes("ab中" * 400)
    lo, begin, end = language.windows(data)
    assert begin[0] == 0 and end[-1] == len(data) and (begin[1:] == end[:-1]).all() and len(begin) > 3
    assert all(data[b] & 0xC0 != 0x80 for b in begin) and (begin - lo)[1:].tolist() == [language.CONTEXT] * (len(lo) - 1)
    got = language.document_scores(m, ["ab中" * 400])[0][0]
    want = np.zeros(3)
    for a, b, e in zip(lo, begin, end, strict=True):
        part = slow_scores(m, data[a : min(e + language.CONTEXT, len(data))])
        want += sum(part[k] for k in range(b - a, e - a))
    assert got == pytest.approx(want, rel=1e-4)


def brute_lm(rows, learn):
    c = Counter()
    for i, t in rows:
        if learn(i):
            c.update(words(t))
            c["END"] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        x = [*words(t), "END"]
        out[i] = (len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
    return out


def test_language_model(spark, odd, none, monkeypatch):
    monkeypatch.setattr(brown, "DICTIONARY", 40)
    monkeypatch.setattr(brown, "CLUSTERED", 20)
    monkeypatch.setattr(brown, "CLASSES", 4)
    r = np.random.default_rng(3)
    rows = [(i, " ".join(x for k in r.integers(0, 60, 15) for x in (f"a{k}", f"b{k % 7}"))) for i in range(120)] + [(500, None), (501, "Unseen words"), (502, "")]
    got = {x.doc_id: x for x in brown.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lm(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    for i, (n, known, total, base) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert brown.language_model_scores(odd).count() == len(ODD)
    assert brown.language_model_scores(none).count() == 0


def brute_classes(rows, model, cls):
    """Class bigrams and scores of all texts, from every word's class and count."""
    x = model.lexicon
    count, g = Counter(w for _, t in rows for w in words(t)), np.zeros((x.size, x.size))
    out = {}
    for i, t in rows:
        before, s = x.end, 0.0
        for w in [*words(t), None]:
            c = x.end if w is None else cls.get(w, x.rare)
            n = len(rows) if w is None else count[w]
            g[before, c] += 1
            emit = (n + 1) / model.rare_total if c == x.rare else n / model.into[c]
            s += math.log10(model.weight * model.follow[before, c] * emit + (1 - model.weight) * (n + 1) / model.total)
            before = c
        out[i] = s
    return g, out


@pytest.mark.parametrize("dictionary", [60, 5000])
def test_words_outside_the_exchange_get_classes(spark, monkeypatch, dictionary):
    for name, value in (("CLUSTERED", 20), ("CLASSES", 2), ("DICTIONARY", dictionary)):
        monkeypatch.setattr(brown, name, value)
    r = np.random.default_rng(4)
    rows = []  # ten frequent words of either kind, a hundred less frequent ones
    for i in range(400):
        said = []
        for _ in range(20):
            for kind in "ab":
                said.append(f"{kind}{r.integers(0, 10)}" if r.random() < 0.6 else f"{kind}{r.integers(10, 110)}")
        rows.append((i, " ".join([*said, f"once{i}"])))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    model, every = brown.fit(texts.select("text"))
    assert model.lexicon.late == (dictionary == 60)
    known = {x.word.encode(): x.cls for x in every.collect()} | {w: int(model.lexicon.cls[k]) for w, k in model.lexicon.words.items()}
    kinds = {k: {c for w, c in known.items() if w[:1] == k and w[1:].isdigit()} for k in (b"a", b"b")}
    assert all(len(c) == 1 for c in kinds.values()) and kinds[b"a"] != kinds[b"b"]
    assert {known[b"once%d" % i] for i in range(400)} == {model.lexicon.rare}
    known.pop(b"\n", None)
    g, want = brute_classes(rows, model, known)
    assert (g.sum(0) == model.into).all()
    got = {x.doc_id: x.score for x in brown.score_documents(texts, model, every).collect()}
    assert all(got[i] == pytest.approx(s) for i, s in want.items())
    assert sum(model.emit[k] for w, k in model.lexicon.words.items() if known.get(w) == known[b"a1"]) <= 1 + 1e-9


def test_rows_of_a_step_follow_the_texts_when_the_dictionary_is_outgrown(spark, monkeypatch):
    """Five times the texts in five times the tasks; nearly all words with
    enough counts are in the dictionary before, half of them afterwards."""
    for name, value in (("CLUSTERED", 5), ("CLASSES", 2), ("DICTIONARY", 100)):
        monkeypatch.setattr(brown, name, value)
    r = np.random.default_rng(9)
    said = [x for x in r.zipf(2, 1_100_000).tolist() if x < 10**9][:1_000_000]
    made, kind = defaultdict(list), type(spark.range(1))
    run = kind.mapInArrow

    def counted(df, func, schema, *more):
        out = run(df, func, schema, *more)
        made[schema].append(out.count())
        return out

    monkeypatch.setattr(kind, "mapInArrow", counted)
    seen = []
    for parts in (4, 20):
        made.clear()
        texts = spark.createDataFrame([(" ".join(f"w{x}" for x in said[k : k + 100]),) for k in range(0, parts * 50_000, 100)], "text string")
        model, _ = brown.fit(texts.repartition(parts))
        seen.append(dict(made))
        c = Counter(said[: parts * 50_000])
        assert sum(n >= brown.ENOUGH for n in c.values()) > 100 and model.lexicon.late
    few, many = seen
    assert set(few) == set(many)
    grown = {k: (few[k], many[k]) for k in few if any(y > max(1000, 12 * x) for x, y in zip(few[k], many[k], strict=True))}
    assert not grown


def test_counts_handed_on_often_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(brown, "HELD", 20)
    test_words_outside_the_exchange_get_classes(spark, monkeypatch, 60)


def test_cells_are_summed_before_they_are_handed_on(monkeypatch):
    monkeypatch.setattr(brown, "HELD_CELLS", 40)
    r, cells, want, got, full = np.random.default_rng(1), brown.Cells(5), Counter(), Counter(), []
    for kinds in [20] * 10 + [100] * 10:  # 20 cells find room, 100 don't
        key = r.integers(0, kinds, 50)
        want.update(key.tolist())
        cells.add(key // 5, key % 5)
        full.append(cells.full())
        for word, cell, n in cells.handed() if full[-1] or len(full) == 20 else ():
            for w, c, m in zip(word.tolist(), cell.to_pylist(), n.to_pylist(), strict=True):
                got.update({w * 5 + k: x for k, x in zip(c, m, strict=True)})
    assert got == want and not any(full[:10]) and any(full[10:])


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_counts_of_a_word_meet_across_batches(rows):
    told = [(w, [c, c + 1], [1, k]) for k, (w, c) in enumerate([("a", 0), ("a", 1), ("a", 1), ("b", 2), ("c", 0), ("c", 5), ("d", 1)])]
    want = Counter()
    for w, cells, ns in told:
        for c, n in zip(cells, ns, strict=True):
            want[w, c] += n
    batches = [pa.RecordBatch.from_pylist([dict(zip(("word", "cells", "ns"), r, strict=True)) for r in told[k : k + 4]]) for k in (0, 4)]
    got = [(names[i].as_py(), int(c), int(n)) for names, word, cell, count in brown.by_word(iter(batches), 10, rows) for i, c, n in zip(word.tolist(), cell, count, strict=True)]
    assert {(w, c): n for w, c, n in got} == dict(want) and len(got) == len(want)
    assert list(brown.by_word(iter([]), 10)) == []


def test_best_class_equals_the_exchange():
    r = np.random.default_rng(2)
    seq = np.concatenate([[r.integers(0, 5), r.integers(5, 10), 10 if r.random() < 0.1 else r.integers(0, 10)] for _ in range(900)])
    cls = np.array([0] * 5 + [1] * 5 + [2])
    g = np.zeros((4, 4))
    np.add.at(g, (cls[seq[:-1]], cls[seq[1:]]), 1)
    at = np.flatnonzero(seq[:-1] == 10)
    sides = Counter(8 if seq[i + 1] == 10 else int(cls[seq[i + 1]]) for i in at) + Counter(4 + int(cls[seq[i - 1]]) for i in at if seq[i - 1] != 10)
    cell, n = np.array(sorted(sides)), np.array([sides[c] for c in sorted(sides)], float)

    def likelihood(k):
        new = np.where(np.arange(11) == 10, k, cls)
        h = np.zeros((4, 4))
        np.add.at(h, (new[seq[:-1]], new[seq[1:]]), 1)
        return brown.xlogx(h).sum() - brown.xlogx(h.sum(0)).sum() - brown.xlogx(h.sum(1)).sum()

    got = brown.best_classes(g, 2, 2, np.zeros(len(cell), int), cell, n)
    assert got.tolist() == [max((0, 1), key=likelihood)]


def test_exchange_finds_alternating_classes():
    r = np.random.default_rng(0)
    seq = np.concatenate([[r.integers(0, 5), r.integers(5, 10)] for _ in range(2000)])
    pairs, n = np.unique(seq[:-1] * 12 + seq[1:], return_counts=True)
    cls = brown.exchange(pairs // 12, pairs % 12, n.astype(float), 10, 2, 2)
    assert len(set(cls[:5])) == len(set(cls[5:10])) == 1 and cls[0] != cls[5]


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, len(s), least.get(c)) for (i, s), c in zip(sets, comp, strict=True)), key=str)


def near_rows():
    r = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = [f"w{k}" for k in r.integers(0, 400, 60 + 9 * g)]
        for _ in range(12):
            w = list(base)
            for _ in range(r.integers(0, 9)):
                w[r.integers(0, len(w))] = f"e{r.integers(0, 50)}"
            rows.append((len(rows), " ".join(w)))
    common = " ".join(f"c{k}" for k in range(40))
    rows += [(len(rows) + k, f"{common} " + " ".join(f"u{k}x{j}" for j in range(k))) for k in range(20)]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "PART", 4)
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    rows = near_rows()
    got = jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=k, percent=percent)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute_components(rows, k, percent)


def test_jaccard_join_without_bands_finds_all(spark, monkeypatch):
    """The matrix alone must find what the bands would have."""
    monkeypatch.setattr(jaccard_join, "_BAND_KEYS", jaccard_join._BAND_KEYS[:0])
    rows = near_rows()[:60]
    got = jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows, 3, 80)


def test_jaccard_join_on_odd_rows(odd, none):
    got = jaccard_join.near_duplicate_groups(odd, words=3, percent=90)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components([(i, t) for i, t, *_ in ODD], 3, 90)
    assert jaccard_join.near_duplicate_groups(none).count() == 0
    kept = jaccard_join.drop_near_duplicates(exact_dedup.drop_exact_duplicates(odd), words=3, percent=80)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 4, 5, 6, 7, 8, None, 10])
    assert jaccard_join.drop_near_duplicates(none).columns == odd.columns


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (5, 5)], "a int, b int")
    got = {r.v: r.comp for r in components.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}


def test_nearest(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(1500, 16))
    v[700:760] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] * 16), (2030, [None] * 16), (2040, []), (2050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "rank": F.lit(3)})
    got = defaultdict(list)
    for x in hnsw.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    n = np.linalg.norm(v, axis=1)
    hits = 0
    for q in range(0, 1500, 10):
        s = v @ v[q] / (n * n[q])
        want = [i for i in sorted(range(1500), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        assert [k for k, *_ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[i]) < 1e-12 for _, i, score in got[q])
        hits += len(set(want).intersection(i for _, i, _ in got[q]))
    assert hits >= 0.9 * 5 * 150
    assert [i for _, i, _ in got[0]] == [700, 701, 702, 703, 704]
    assert not set(got) & {2000, 2010, 2020, 2030, 2040, 2050}
    assert hnsw.nearest(df.filter("false"), every=10).count() == 0


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 900)
    r = np.random.default_rng(8)
    v = r.normal(size=(4000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for x in hnsw.nearest(df, every=50).collect():
        got[x.query_id].add(x.vec_id)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q].intersection(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 80


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_probabilities_of_the_model_add_up(spark, monkeypatch):
    """Over all words seen, after each class; what is left is for unseen words."""
    for name, value in (("CLUSTERED", 20), ("CLASSES", 3), ("DICTIONARY", 40)):
        monkeypatch.setattr(brown, name, value)
    r = np.random.default_rng(6)
    rows = [(" ".join(f"w{int(k)}" for k in r.zipf(1.3, 30) if k < 500),) for _ in range(300)]
    model, every = brown.fit(spark.createDataFrame(rows, "text string"))
    assert model.lexicon.late
    x = model.lexicon
    table = {w.word.encode(): (w.c, x.cls[x.words[w.word.encode()]] if w.word.encode() in x.words else w.cls) for w in every.collect()}
    assert {c for _, c in table.values()} == set(range(5))
    assert x.may([w for w, (c, _) in table.items() if c >= brown.ENOUGH and w not in x.words]).all()
    for before in range(x.size):
        total = 0.0
        for c, k in table.values():
            emit = (c + 1) / model.rare_total if k == x.rare else c / model.into[k]
            total += 10 ** model.mix(np.array([before]), np.array([k]), np.array([emit]), np.array([c + 1.0]))[0]
        unseen = 10 ** model.mix(np.array([before]), np.array([x.rare]), np.array([1 / model.rare_total]), np.array([1.0]))[0]
        assert total + unseen == pytest.approx(1.0)
