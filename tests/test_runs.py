"""Requests to a model, trees after edits, terms in texts, and streams of runs."""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import storage
from quire.operators import agents, glossary, requests, segments, store, tree
from quire.streaming import runs, stateful

# Requests


def blocks_of(prompt):
    parts = re.split(r"(?m)^⟦#(\d+)⟧\n", prompt)[1:]
    return [(int(n), b.split("\n\nSection: ")[0].strip()) for n, b in zip(parts[::2], parts[1::2], strict=True)]


def reply_to(prompt, change=lambda n, b: f"⟦#{n}⟧ [fa] {b}"):
    blocks = blocks_of(prompt)
    return {"text": "\n".join(x for x in (change(n, b) for n, b in blocks) if x), "prompt_tokens": 100 * len(blocks), "completion_tokens": 7}


def items_of(*sources, **more):
    return [{"ordinal": k, "id": f"s{k}", "source": s, "path": "", "context": ""} | more for k, s in enumerate(sources)]


TERMS = [{"count": 3, "term": "TCP/IP", "target": None, "policy": "keep"}, {"count": 9, "term": "net", "target": "Netz", "policy": "translate"}, {"count": 1, "term": "UDP", "target": None, "policy": "translate_paren"}]


def test_placeholders_run_through_a_request():
    items = items_of("TCP/IP and TCP/IP and UDP", "udp nets", "UDP")
    items[1]["path"] = items[2]["path"] = "A › B"
    prompt, maps = requests.render_request(items, TERMS, ["a → b"], "Persian")
    assert maps == [{"≧0≨": "TCP/IP", "≧1≨": "UDP"}, {}, {"≧2≨": "UDP"}]
    head, body = prompt.split("leave placeholders as they are.\n\n")
    assert head.startswith("Glossary (use these forms):\n- net → Netz\n- TCP/IP → \n- UDP → \n\nRecently translated (keep terms and voice):\na → b\n\nTranslate the 3 numbered blocks below into Persian.")
    assert body == "⟦#1⟧\n≧0≨ and ≧0≨ and ≧1≨\n\nSection: A › B\n\n⟦#2⟧\nudp nets\n\n⟦#3⟧\n≧2≨"


def test_terms_are_those_that_the_group_holds():
    many = [{"count": k, "term": f"w{k:02}", "target": "t", "policy": "translate"} for k in range(60)]
    text = " ".join(t["term"] for t in many)
    assert [t["term"] for t in requests.terms_in([text.upper()], many)] == [f"w{k:02}" for k in range(59, 19, -1)]
    assert requests.terms_in(["w05 only"], many)[0]["term"] == "w05"


def test_replies_are_restored_and_shared():
    done, log = requests.work_off(items_of("TCP/IP here", "four", "UDP"), TERMS, lambda p: reply_to(p, lambda n, b: f"[[#{n}]]\n{b.replace('≧', '≧ ')}"), "fa")
    assert [done[f"s{k}"]["target_text"] for k in range(3)] == ["TCP/IP here", "four", "UDP"]
    assert [done[f"s{k}"]["prompt_tokens"] for k in range(3)] == [183, 66, 51]
    assert sum(d["completion_tokens"] for d in done.values()) == 7
    assert log == [{"blocks": 3, "answered": 3, "prompt_tokens": 0, "completion_tokens": 0, "error": None}]
    assert requests.restored("≧7≨ and ≧0≨", {"≧0≨": "x"}) == "≧7≨ and x"


def test_only_dropped_blocks_are_asked_again():
    asked = []

    def model(prompt):
        asked.append([b for _, b in blocks_of(prompt)])
        return reply_to(prompt, lambda n, b: None if len(asked) == 1 and b in ("two", "four") else f"⟦#{n}⟧ {b}!")

    done, log = requests.work_off(items_of("one", "two", "three", "four"), [], model, "fa")
    assert asked == [["one", "two", "three", "four"], ["two", "four"]]
    assert [done[f"s{k}"]["target_text"] for k in range(4)] == ["one!", "two!", "three!", "four!"]
    assert sum(d["prompt_tokens"] for d in done.values()) == 600
    assert [(r["blocks"], r["answered"]) for r in log] == [(4, 2), (2, 2)]


@pytest.mark.parametrize("bad", [None, {}, {"text": None}, "text", {"text": "no marks", "prompt_tokens": 5}, ValueError("refused")])
def test_a_poisoned_block_fails_alone(bad):
    def model(prompt):
        if any("poison" in b for _, b in blocks_of(prompt)):
            if isinstance(bad, Exception):
                raise bad
            return bad
        return reply_to(prompt)

    done, log = requests.work_off(items_of("a", "b", "poison", "d", "e"), [], model, "fa")
    assert [done[f"s{k}"]["target_text"] for k in range(5)] == ["[fa] a", "[fa] b", None, "[fa] d", "[fa] e"]
    assert done["s2"]["error"]
    assert [r["blocks"] for r in log] == [5, 2, 3, 1, 2]
    spent = sum(r["prompt_tokens"] for r in log)
    assert spent == (15 if isinstance(bad, dict) and bad.get("prompt_tokens") else 0)


def test_halves_have_the_context_of_what_came_before():
    seen = []

    def model(prompt):
        seen.append((len(blocks_of(prompt)), re.findall(r"(?m)^(.* → .*)$", prompt)))
        if len(blocks_of(prompt)) > 1:
            raise ValueError
        return reply_to(prompt)

    requests.work_off(items_of("a", "b", "c", "d", context="x → y\nu → v"), [], model, "fa")
    assert seen == [(4, ["x → y", "u → v"]), (2, ["x → y", "u → v"]), (1, ["x → y", "u → v"]), (1, ["u → v", "a → [fa] a"]), (2, ["a → [fa] a", "b → [fa] b"]), (1, ["a → [fa] a", "b → [fa] b"]), (1, ["b → [fa] b", "c → [fa] c"])]


SEGMENT = "doc_id long, id string, ordinal int, source_text string, target_text string, status string, attempts int, cost_usd double, error string, locked boolean, heading_path array<string>, prompt_tokens long, completion_tokens long"


def book(spark, *rows):
    full = [(1, f"s{k}", k, *r) for k, r in enumerate(rows)]
    return spark.createDataFrame([(*r[:4], r[5] if len(r) > 5 else None, r[4] if len(r) > 4 else "pending", 0, 0.0, None, False, ["Part"], 0, 0) for r in full], SEGMENT)


def test_translate_run_records_checks_and_counts(spark):
    s = book(spark, ("Opening line", "translated", "Erste Zeile"), ("TCP/IP is a net",), ("* * *",), ("poison",), ("A second net here",))
    terms = spark.createDataFrame([("TCP/IP", None, "keep", True, 4), ("net", "Netz", "translate", True, 2), ("net", "x", "keep", False, 2)], "term string, target_form string, policy string, enabled boolean, count long")
    prompts = []

    def model(prompt):
        if "poison" in prompt:
            raise ValueError("refused")
        assert "Opening line → Erste Zeile" in prompt and "Section: Part" in prompt
        return reply_to(prompt)

    run = agents.translate_run(s, model, terms, prices=(10.0, 0.0))
    got = {r.id: r for r in run.segments.collect()}
    assert [got[f"s{k}"].status for k in range(5)] == ["translated", "flagged", "skipped", "failed", "flagged"]
    assert got["s1"].target_text == "[fa] TCP/IP is a net" and got["s2"].target_text == "* * *" and got["s3"].error == "ValueError: refused"
    assert (got["s1"].prompt_tokens, got["s1"].completion_tokens, got["s1"].cost_usd) == (100, 7, pytest.approx(0.001))
    stats = run.stats.first()
    assert (stats.queued, stats.done, stats.skipped, stats.failed, stats.requests, stats.tokens) == (4, 2, 1, 1, 5, 214)
    assert stats.cost_usd == pytest.approx(0.002)
    assert run.usage.agg(F.sum("prompt_tokens")).first()[0] == 200
    assert prompts == []
    one = agents.translate_run(s, reply_to, ids=s.filter("id = 's4'").select("doc_id", "id")).segments
    assert {r.id: r.status for r in one.collect()} == {"s0": "translated", "s1": "pending", "s2": "pending", "s3": "pending", "s4": "translated"}


# Trees


def test_renumber_is_a_depth_first_walk(spark):
    r = random.Random(4)
    rows, want = [], {}
    for d in range(6):
        names = [f"n{k:03}" for k in range(60)]
        r.shuffle(names)
        parents = {n: (None if k == 0 or r.random() < 0.05 else names[k - 1] if d % 2 else names[r.randrange(k)]) for k, n in enumerate(names)}
        places = {n: r.randrange(5) for n in names}

        def walk(above, line, d=d, parents=parents, places=places):
            for k, n in enumerate(sorted((n for n in parents if parents[n] == above), key=lambda n: (places[n], n))):
                want[d, n] = (len(want) - base, len(line), line, k)
                walk(n, [*line, n])

        base = len(want)
        walk(None, [])
        rows += [(d, n, parents[n], places[n], f"t{n}", 99) for n in names]
    nodes = spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, child_idx int, text string, pos int")
    got = {(x.doc_id, x.node_id): (x.pos, x.depth, x.ancestors, x.child_idx) for x in tree.renumber(nodes).collect()}
    assert got == want


@pytest.mark.parametrize("most", [0, 3, 100])
def test_renumber_is_the_same_by_walk_and_by_doubling(spark, monkeypatch, most):
    monkeypatch.setattr(tree, "MOST_NODES", most)
    rows = [(d, f"n{k}", None if k == 0 else f"n{k & (k - 1)}" if k % 4 else "gone", -k, float(k)) for d in range(4) for k in range(2 * d + 1)]
    nodes = spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, child_idx int, x double")
    got = {(r.doc_id, r.node_id): (r.pos, r.depth, r.child_idx, r.ancestors, r.x) for r in tree.renumber(nodes).collect()}
    assert len(got) == len(rows) and [got[3, f"n{k}"] for k in (0, 2, 3, 1, 6, 5, 4)] == [(0, 0, 0, [], 0.0), (1, 1, 0, ["n0"], 2.0), (2, 2, 0, ["n0", "n2"], 3.0), (3, 1, 1, ["n0"], 1.0), (5, 1, 0, ["n4"], 6.0), (6, 1, 1, ["n4"], 5.0), (4, 0, 0, [], 4.0)]


def test_a_walk_leaves_few_bytes(spark):
    """A renumbering saves the nodes once, and no rounds of paths beside them."""
    before = len(storage._WRITTEN)
    rows = [(1, f"n{k}", f"n{k - 1}" if k else None, 0) for k in range(40)]
    assert tree.renumber(spark.createDataFrame(rows, "doc_id int, node_id string, parent_id string, child_idx int")).count() == 40
    assert len(storage._WRITTEN) - before <= 2


def test_renumber_of_odd_trees(spark):
    kinds = "doc_id int, node_id string, parent_id string, child_idx int"
    lost = spark.createDataFrame([(1, "a", None, 0), (1, "b", "gone", 0), (1, "c", "b", 0), (2, "a", "a2", 1)], kinds)
    assert {(r.doc_id, r.node_id): (r.pos, r.depth) for r in tree.renumber(lost).collect()} == {(1, "a"): (0, 0), (1, "b"): (1, 0), (1, "c"): (2, 1), (2, "a"): (0, 0)}
    assert tree.renumber(lost.filter("false")).count() == 0


def test_resegment_keeps_work(spark):
    def nodes(*texts):
        rows = [(1, k, f"n{t[:1]}", "paragraph", t, ["H"] if k else []) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id int, pos int, node_id string, kind string, text string, heading_path array<string>")

    stored = segments.build_segments(nodes("a one", "b two", "c three")).select("doc_id", "id", "node_id", "ordinal", "source_text", "heading_path", F.lit("translated").alias("status"), F.upper("source_text").alias("target_text"))
    other = stored.withColumn("doc_id", F.lit(2))
    got = segments.resegment(nodes("c three", "a one", "b new"), stored.unionByName(other)).collect()
    assert {(r.ordinal, r.source_text, r.status, r.target_text, tuple(r.heading_path)) for r in got if r.doc_id == 1} == {(0, "c three", "translated", "C THREE", ()), (1, "a one", "translated", "A ONE", ("H",)), (2, "b new", "pending", None, ("H",))}
    assert sum(r.doc_id == 2 and r.status == "translated" for r in got) == 3


def test_captions_and_alternative_texts_are_segments(spark):
    image = "array<struct<src:string,alt:string,caption:string>>"
    rows = [(1, 0, "p", "paragraph", "Text", None), (1, 1, "f", "figure", "Fig. 1", [("a.png", "an alt", "Fig. 1"), ("b.png", " ", "Fig. 2")]), (1, 2, "e", "equation", "x=1", [("c.png", "formula", None)])]
    n = spark.createDataFrame(rows, f"doc_id int, pos int, node_id string, kind string, text string, images {image}").withColumn("heading_path", F.array().cast("array<string>"))
    s = segments.build_segments(n)
    assert [(r.node_id, r.kind, r.source_text) for r in s.orderBy("ordinal").collect()] == [("p", "paragraph", "Text"), ("f", "figure", "Fig. 1"), ("f:alt:0", "figure", "an alt"), ("f:caption:1", "figure", "Fig. 2"), ("e:alt:0", "figure", "formula")]
    done = s.select("doc_id", "id", F.concat(F.lit("~"), "source_text").alias("target_text")).filter("target_text <> '~Fig. 2'")
    out = {r.node_id: r for r in segments.apply_translations(n, s, done).collect()}
    assert out["f"].text == "~Fig. 1" and [tuple(i) for i in out["f"].images] == [("a.png", "~an alt", "~Fig. 1"), ("b.png", " ", "Fig. 2")]
    assert out["e"].text == "x=1" and tuple(out["e"].images[0]) == ("c.png", "~formula", None)
    assert out["p"].text == "~Text" and out["p"].images is None


# Terms in texts


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_terms_meet_texts_by_automata(spark, monkeypatch, limit):
    """Broadcast below the limit, dealt in chunks and salted groups beyond."""
    monkeypatch.setattr(glossary, "TERM_CHARS", limit)
    monkeypatch.setattr(glossary, "TEXT_CHARS", 200)
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abc é") for _ in range(n))
    texts = [(k, r.choice(["p", "q", "r"]), word(r.randrange(0, 60))) for k in range(120)] + [(900, "p", None), (901, None, "abc")]
    terms = [(r.choice(["p", "q", "s"]), word(r.randrange(1, 6)), k) for k in range(60)] + [("p", "", 1), (None, "abc", 1)]
    t, w = spark.createDataFrame(texts, "i int, k string, low string"), spark.createDataFrame(terms, "k string, low_term string, v int")
    got = Counter((x.i, x.k, x.low_term, x.v) for x in glossary.substring_hits(t, w, ["i"], ["k"], ("v",)).collect())
    assert got == Counter({(i, k, s, v): 1 for i, k, x in texts for j, s, v in terms if k is not None and k == j and s and x and s in x})
    free = Counter((x.i, x.low_term) for x in glossary.substring_hits(t, w, ["i"], []).collect())
    assert free == Counter({(i, s): 1 for i, _, x in texts for s in {s for _, s, _ in terms} if s and x and s in x})


def test_subsumption_of_long_terms_and_of_one_prefix(spark):
    r = random.Random(5)
    long = "".join(r.choice("ab") for _ in range(100_000))
    terms = {long, long[500:700], long[40_000:40_064], long[7:90] + "x", "y" * 70, "y" * 69, "y" * 65, "y" * 64} | {f"prefix {k}" for k in range(400)} | {f"prefix {k} more" for k in range(0, 400, 3)} | {"of", "a of b of", " of"}
    df = spark.createDataFrame([("k", t) for t in terms], "k string, term string")
    every = "\x00".join(terms)
    want = {t for t in terms if len(t) < 3 or not any(len(u) > len(t) and t in u for u in terms)} if every else set()
    assert {x.term for x in glossary.drop_subsumed(df, "k").collect()} == want


# Streams


def stream_of(spark, folder, rows, schema, files):
    """Rows dealt in order to files that arrive one after the other."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = rows[k * size : (k + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def worked(batch):
    return batch.select("doc_id", "id", F.concat(F.lit("~"), "source_text").alias("new_target"), F.lit(10).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"), F.lit(0.5).alias("cost_usd"), F.array().cast("array<string>").alias("flags"), F.lit(None).cast("string").alias("error"))


@pytest.mark.parametrize("broken", ["segments", "usage", "commits"])
def test_segments_and_usage_are_committed_together(spark, tmp_path, broken):
    """A crash before one of an epoch's tables is written; then a rerun."""
    rows = [(1, f"s{k}", f"text {k}") for k in range(6)]
    stream = stream_of(spark, tmp_path / "in", rows, "doc_id int, id string, source_text string", 3)
    asked = []

    def work(batch):
        asked.append(batch.count())
        return worked(batch)

    sink = runs.ResultSink(str(tmp_path / "out"), work)
    write, crashed = sink.tables.write, []

    def failing(name, epoch, table):
        if name == broken and epoch == 1 and not crashed:
            crashed.append(name)
            raise OSError("gone")
        return write(name, epoch, table)

    sink.tables.write = failing
    with pytest.raises(Exception, match="gone"):
        runs.run_until_paused(stream, sink, str(tmp_path / "check"))
    assert sink.results(spark).count() == sink.usage(spark).count() == 2
    assert runs.run_until_paused(stream, sink, str(tmp_path / "check"))
    assert sorted(r.new_target for r in sink.results(spark).collect()) == [f"~text {k}" for k in range(6)]
    assert sink.usage(spark).agg(F.sum("prompt_tokens"), F.sum("cost_usd"), F.count("id")).first() == (60, 3.0, 6)
    assert asked == [2, 2, 2]
    for epoch in range(3):
        sink(spark.createDataFrame(rows, "doc_id int, id string, source_text string"), epoch)
    assert sink.usage(spark).count() == 6
    state = spark.createDataFrame([(1, "s0", "pending", None, 0, 0.0, None, False), (1, "x", "pending", None, 0, 0.0, None, False)], "doc_id int, id string, status string, target_text string, attempts int, cost_usd double, error string, locked boolean")
    assert {r.id: (r.status, r.target_text, r.attempts) for r in sink.segments(state).collect()} == {"s0": ("translated", "~text 0", 1), "x": ("pending", None, 0)}


def test_a_run_stops_early_when_paused(spark, tmp_path):
    rows = [(1, f"s{k}", f"text {k}") for k in range(4)]
    stream = stream_of(spark, tmp_path / "in", rows, "doc_id int, id string, source_text string", 4)
    control = str(tmp_path / "control")

    def say(paused, second):
        spark.sql(f"SELECT 'r' AS run, {paused} AS paused, timestamp_seconds({second}) AS ts").write.mode("append").parquet(control)

    say("false", 1)
    done = []

    def work(batch):
        done.append([r.id for r in batch.collect()])
        if len(done) == 2:
            say("true", 2)  # while a batch is in progress: it is finished
        return worked(batch)

    sink = runs.ResultSink(str(tmp_path / "out"), work)
    go = lambda: runs.run_until_paused(stream, sink, str(tmp_path / "check"), lambda: runs.pause_requested(spark, control, "r"))
    assert not go() and len(done) == 2 and sink.results(spark).count() == 2
    assert not go() and len(done) == 2
    say("false", 3)
    assert go() and sorted(i for batch in done for i in batch) == [f"s{k}" for k in range(4)]
    assert sink.results(spark).count() == sink.usage(spark).count() == 4
    assert not runs.pause_requested(spark, control, "another")


def test_stage_machine_equals_the_batch(spark, tmp_path):
    r = random.Random(6)
    stages = ["created", "structure_review", "analyzing", "review", "failed"]
    allowed = [("created", "structure_review"), ("structure_review", "analyzing"), ("analyzing", "review"), ("analyzing", "failed"), ("failed", "analyzing")]
    rows = [(r.randrange(8), k, r.choice(stages)) for k in range(200)]
    schema = "project long, seq long, stage string"
    stream = stream_of(spark, tmp_path / "in", rows, schema, 5)
    checked = stateful.check_stages(stream, "project", ["seq"], "stage", allowed)
    out = str(tmp_path / "out")
    checked.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 200
    want = store.stage_violations(spark.createDataFrame(rows, schema), "project", ["seq"], "stage", allowed)
    side = got.filter("not legal").select("project", "seq", "from_stage", "stage")
    assert sorted(map(tuple, side.collect())) == sorted(map(tuple, want.select("project", "seq", "from_stage", "stage").collect())) != []


FRAMES = [b'data: {"stage": "a"}\n\n', 'event: x\ndata: {"text":\ndata: "é 中"}\n\n'.encode(), b": comment\n\n", b"data: not json\n\n", b"data:[1, 2]\n\n", b"\n\n", b'id: 7\ndata: "end"\n\n', b'data: {"cut": ']
EVENTS = [{"stage": "a"}, {"text": "é 中"}, [1, 2], "end"]


def test_frames_do_not_depend_on_the_cuts():
    whole = b"".join(FRAMES)
    r = random.Random(7)
    for _ in range(300):
        cuts = sorted(r.sample(range(len(whole)), r.randrange(0, 30)))
        rest, events = b"", []
        for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True):
            found, rest = stateful.frames_of(rest + whole[a:b])
            events += [json.loads(f) for f in found]
        assert events == EVENTS and rest == b'data: {"cut": '


def test_frames_are_carried_over_micro_batches(spark, tmp_path):
    whole = b"".join(FRAMES)
    rows = [(c, seq, whole[a : a + step]) for c, step in (("x", 7), ("y", 31)) for seq, a in enumerate(range(0, len(whole), step))]
    random.Random(8).shuffle(rows)
    rows.sort(key=lambda row: row[1] // 3)
    stream = stream_of(spark, tmp_path / "in", sorted(rows, key=lambda row: row[1]), "connection string, seq long, chunk binary", 4)
    got = []
    stateful.parse_frames(stream).writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    for c in "xy":
        mine = sorted((r.n, r.payload) for r in got if r.connection == c)
        assert [n for n, _ in mine] == [0, 1, 2, 3] and [json.loads(p) for _, p in mine] == EVENTS


def test_subscribers_have_offsets_of_their_own(spark, tmp_path):
    stream = stream_of(spark, tmp_path / "in", [(k,) for k in range(4)], "v long", 4)
    seen, failures = {"a": [], "b": [], "late": []}, [1]
    hub = runs.Hub(str(tmp_path / "hub"))

    def b(batch, epoch):
        if epoch == 1 and failures:
            failures.pop()
            raise ValueError("down")
        seen["b"] += [r.v for r in batch.collect()]

    def a(batch, epoch):
        seen["a"] += [r.v for r in batch.collect()]
        if epoch == 2:
            hub.subscribe("late", lambda rows, _: seen["late"].extend(r.v for r in rows.collect()))

    hub.subscribe("a", a)
    hub.subscribe("b", b)
    assert runs.run_until_paused(stream, hub, str(tmp_path / "check"))
    assert [sorted(seen[k]) for k in ("a", "b", "late")] == [[0, 1, 2, 3], [0, 1, 2, 3], [3]]
    assert hub.removed == 3 and not list((tmp_path / "hub" / "events").glob("epoch=*"))
    hub.unsubscribe("late")
    assert set(hub.taken) == {"a", "b"}


def test_a_translation_runs_as_a_stream(spark, tmp_path):
    """Requests, retries, checks and commits together, over two micro-batches."""
    rows = [tuple(r) for r in book(spark, ("Opening line",), ("* * *",), ("poison here",), ("A second line",)).collect()]
    stream = stream_of(spark, tmp_path / "in", rows, SEGMENT, 2)
    tries = tmp_path / "tries"

    def model(prompt):
        if "poison" in prompt:
            raise ValueError("refused")
        if not tries.exists():
            tries.write_text("busy once")
            raise OSError("busy")
        return reply_to(prompt)

    terms = spark.createDataFrame([("line", "Zeile", "translate", True, 2)], "term string, target_form string, policy string, enabled boolean, count long")
    sink = runs.ResultSink(str(tmp_path / "out"), lambda batch: agents.run_results(batch, agents.with_retries(model, 2, sleep=lambda _: None), terms, (10.0, 0.0)))
    assert runs.run_until_paused(stream, sink, str(tmp_path / "check"))
    got = {r.id: r for r in sink.segments(spark.createDataFrame(rows, SEGMENT)).collect()}
    assert [got[f"s{k}"].status for k in range(4)] == ["flagged", "translated", "failed", "flagged"]
    assert got["s0"].target_text == "[fa] Opening line" and got["s1"].target_text == "* * *" and got["s2"].error == "ValueError: refused"
    assert sink.usage(spark).agg(F.sum("prompt_tokens"), F.count("id")).first() == (200, 2)
