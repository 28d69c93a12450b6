"""Small cases of the document operators, with the answers written out."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import batches as B
from quire.operators import glossary as G
from quire.operators import agents, layout, prompts, qa, render, store, tables, tree
from quire.operators import segments as S
from quire.sources import blocks, presets, readers
from quire.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_heading_paths_equal_a_stack(spark):
    r = random.Random(1)
    rows, want = [], {}
    for d in range(20):
        stack = []
        for pos in range(30):
            level = r.choice([None, 1, 2, 3])
            text = f"t{pos}"
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
            want[d, pos] = [t for _, t in stack]
            if level:
                stack.append((level, text))
            rows.append((d, pos, "heading" if level else "paragraph", level, text))
    nodes = spark.createDataFrame(rows, "doc_id int, pos int, kind string, level int, text string")
    got = {(x.doc_id, x.pos): x.heading_path for x in tree.heading_paths(nodes).collect()}
    assert got == want


def test_pack_sentences(spark):
    assert one(spark, S.pack_sentences(F.lit("One. Two.\nThree."), 100)) == ["One. Two.\nThree."]
    assert one(spark, S.pack_sentences(F.lit("One a. Two b. Three is long here."), 14)) == ["One a. Two b.", "Three is long here."]


@pytest.mark.parametrize(("sizes", "limits", "want"), [([100, 100, 100, 9000, 5, 5], (250, 3), [0, 0, 1, 2, 3, 3]), ([1] * 10, (5000, 2), [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]), ([9000] * 3, (5000, 24), [0, 1, 2])])
def test_greedy_batches(spark, sizes, limits, want):
    items = F.array(*[F.struct(F.lit(s).alias("size")) for s in sizes])
    assert one(spark, B.greedy_batches(items, "size", *limits)) == want


def test_protect_and_restore():
    text, tokens = B.protect("TCP/IP and TCP, TCP/IP", ["TCP", "TCP/IP"], 5)
    assert text == "≧5≨ and ≧6≨, ≧5≨"
    assert tokens == {"≧5≨": "TCP/IP", "≧6≨": "TCP"}


def test_parse_reply():
    reply = "⟦#1⟧ one\n> [[#2]]\ntwo\n⟦#2⟧ again\n⟦#9⟧ out\n⟦#3⟧  "
    assert B.parse_reply(reply, 3) == [(1, "one"), (2, "two")]


def test_translation_halves_and_fails_alone(spark):
    items = [("a", "ok"), ("b", "bad"), ("c", "fine")]
    df = spark.createDataFrame([(1, items)], "k int, items array<struct<id:string,source:string>>")

    def model(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    got = {r.id: (r.target_text, r.status) for r in B.translate_batches(df, model, ["k"]).collect()}
    assert got == {"a": ("OK", "translated"), "b": (None, "failed"), "c": ("FINE", "translated")}


def test_reconcile_counts_one_edit(spark):
    a = spark.createDataFrame([("d", f"s{k}", k) for k in range(4)], "doc_id string, id string, ordinal int")
    b = spark.createDataFrame([("d", i, k) for k, i in enumerate(["s0", "x", "s2", "s3"])], "doc_id string, id string, ordinal int")
    assert {r.change: r["count"] for r in S.reconcile(b, a).groupBy("change").count().collect()} == {"added": 1, "kept": 3, "removed": 1}


def test_upsert_respects_locks_and_nulls(spark):
    stored = spark.createDataFrame([("d", "A", "x", "keep", None, None, "llm", 1, "n1", True, True), ("d", "B", "y", "translate", "why", None, "llm", 1, "n1", False, False)], "doc_id string, source string, target string, policy string, explanation string, part_of_speech string, origin string, frequency int, first_seen_node string, locked boolean, enabled boolean")
    new = spark.createDataFrame([("d", "A", "z", "translate", None, None, "mined", 9, "n9"), ("d", "B", None, None, None, None, "mined", 9, "n9"), ("d", "C", None, None, None, None, "mined", 2, "n2")], "doc_id string, source string, target string, policy string, explanation string, part_of_speech string, origin string, frequency int, first_seen_node string")
    got = {r.source: r for r in G.upsert_terms(stored, new).collect()}
    assert [got[k].action for k in "ABC"] == ["skipped", "updated", "added"]
    assert (got["A"].target, got["A"].frequency) == ("x", 1)
    assert (got["B"].target, got["B"].explanation, got["B"].frequency, got["B"].enabled) == ("y", "why", 9, False)


def test_mining_and_subsumption(spark):
    text = "The Transmission Control Protocol uses TCP/IP. Transmission Control Protocol has frame_size. Control Protocol."
    df = spark.createDataFrame([("b", text)], "k string, text string")
    found = {r.term: r.reason for r in G.drop_subsumed(G.mine(df, "k"), "k").collect()}
    assert found["Transmission Control Protocol"] == "capitalized_phrase"
    assert found["TCP/IP"] == "acronym"
    assert found["frame_size"] == "code_span"
    assert "Control Protocol" not in found


def test_ngrams_are_counted_by_their_windows(spark, monkeypatch):
    monkeypatch.setattr(G, "HELD", 3)
    texts = [("a", "big cat sat, big cat sat. Big cat ran to big cat sat down"), ("a", "big cat's x1 y big cat-flap the big"), ("b", "big cat"), (None, "no one no one"), ("b", None)]
    got = {(r.k, r.term): r["count"] for r in G.ngrams(spark.createDataFrame(texts, "k string, text string"), "k").collect()}
    want = Counter()
    for k, text in texts:
        words = re.findall(G.WORD, text or "")
        want.update((k, " ".join(words[i : i + n])) for n in (2, 3, 4) for i in range(len(words) - n + 1) if not {w.lower() for w in words[i : i + n]} & set(G.STOPWORDS))
    assert got == {x: n for x, n in want.items() if n >= 2} and got[None, "no one"] == 2
    # One row for each place of a text, not one for each n-gram.
    assert len(G.windows("one two three four five the six")) == 4


def test_books_of_a_batch_need_no_frame_each(spark):
    rows = [(f"d{k}", n, f"t{n}", f"<p>{k} {n}</p>") for k in range(70) for n in (2, 10, 1)]
    books = render.epub_books(spark.createDataFrame(rows, "doc_id string, chapter_no int, title string, body string"), "en", "")
    assert "FlatMapGroups" not in books._jdf.queryExecution().toString()
    got = {r.doc_id: [b["text"] for b in blocks.epub_blocks(bytes(r.epub))] for r in books.collect()}
    assert got == {f"d{k}": [f"{k} 1", f"{k} 2", f"{k} 10"] for k in range(70)}


def test_qa_rules(spark):
    rows = [(1, "A long enough source 12.5", "  "), (2, "A long enough source 12.5", "short ≧3≨"), (3, "A long enough source 12.5", "A long enough target 12.5")]
    got = {r.i: (r.flags, r.status) for r in qa.run_qa(spark.createDataFrame(rows, "i int, source string, target string")).collect()}
    assert got == {1: (["empty-output"], "flagged"), 2: (["unresolved-placeholder", "altered-number"], "flagged"), 3: ([], "translated")}


def test_glossary_terms_are_substrings(spark):
    said = ["Two Computers a中文b", "no term", "comp uter", "x-ß+ c++"]
    pairs = [(i, s, t) for i, s in enumerate(said) for t in ["nothing"]] + [(9, said[0], "RECHNER zh")]
    terms = [("computer", "Rechner"), ("中文", "zh"), ("+", "plus"), ("c++", "cpp"), ("uter", None), ("puters", "q")]
    p = spark.createDataFrame(pairs, "i int, source string, target string")
    t = spark.createDataFrame([(a, b, "translate", True) for a, b in terms] + [("no", "n", "keep", True), ("no", "n2", "translate", False)], "term string, target_form string, policy string, enabled boolean")
    misses = qa.glossary_misses(p, t, ["i"])
    want = {(i, a) for i, s, x in pairs for a, b in terms if b and a in s.lower() and b.lower() not in x.lower()}
    assert {(r.i, r.term) for r in misses.collect()} == want and len(want) == 6
    got = {r.i: (r.flags, r.status) for r in qa.run_qa(p, misses=misses, keys=["i"]).collect()}
    assert {i for i, (f, s) in got.items() if f[-1:] == ["glossary-inconsistency"] and s == "flagged"} == {i for i, _ in want}


def test_tables_round_trip_bars(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit("")), F.array(F.lit("c"), F.lit("d\ne")))
    md = one(spark, tables.to_markdown(rows))
    assert md == "| a\\|b |  |\n| --- | --- |\n| c | d e |"
    assert one(spark, tables.from_markdown(F.lit(md))) == [["a|b", ""], ["c", "d e"]]
    assert one(spark, tables.onto_template(tables.from_markdown(F.lit("| x |")), rows)) == [["x", ""], ["c", "d\ne"]]


def test_tables_of_a_page_are_translated(spark):
    page = "<p>before</p><table><caption>Cap</caption><tr><th colspan=2>Head</th></tr><tr><td></td><td></td></tr><tr><td>a|b</td><td>two</td></tr></table><table><tr><td>x</td></tr></table><p>after</p>"
    nodes = readers.parse_nodes(spark.createDataFrame([("d", page)], "doc_id string, content string"), "html")
    segs = S.build_segments(tree.heading_paths(nodes))
    got = [r.source_text for r in segs.orderBy("ordinal").collect()]
    assert got == ["before", "| Head |  |\n| --- | --- |\n|  |  |\n| a\\|b | two |", "Cap", "| x |\n| --- |", "after"]
    done = segs.select("doc_id", "id", F.upper("source_text").alias("target_text"))
    out = S.apply_translations(nodes, segs, done)
    assert out.columns == nodes.columns
    rows = out.orderBy("pos").collect()
    assert [r.text for r in rows] == ["BEFORE", "CAP", None, "AFTER"]
    assert [[c.text for c in r] for r in rows[1].cells] == [["HEAD", ""], ["", ""], ["A|B", "TWO"]] and rows[2].cells[0][0].text == "X"
    assert (rows[1].cells[0][0].colspan, rows[1].cells[0][0].is_header) == (2, True)


def test_text_functions(spark):
    assert one(spark, T.slug(F.lit(" a/b:  c?. "))) == "a-b-c"
    assert one(spark, T.safe_filename(F.lit(" my/book.PDF"), F.lit("x"))) == "mybook"
    assert one(spark, T.safe_filename(F.lit(" . "), F.lit("x"))) == "x"
    assert one(spark, T.direction(F.lit("FA_IR"))) == "rtl"
    assert one(spark, T.direction(F.lit(None).cast("string"))) == "ltr"
    assert one(spark, T.localize_digits(F.lit("a1"), "persian")) == "a۱"
    assert one(spark, T.file_format(F.lit("/x/A.HTM"))) == "html"
    assert one(spark, T.is_toc_title(F.lit(" Contents: ")))
    assert one(spark, T.cost(F.lit(1000), F.lit(500), F.lit(2.0), F.lit(6.0))) == pytest.approx(0.005)


def test_layout(spark):
    pages = spark.createDataFrame([("d", k, t, l) for k, (t, l) in enumerate([(False, True), (True, False), (False, True), (False, False), (False, True)])], "doc_id string, page int, titled boolean, leader boolean")
    assert [r.in_toc for r in layout.contents_pages(pages).orderBy("page").collect()] == [False, True, True, False, False]
    blocks_ = spark.createDataFrame([("d", 1, 1, "Chapter One", 12.0), ("d", 1, 2, "text", 18.0)], "doc_id string, page int, block int, text string, size double")
    marks = spark.createDataFrame([("d", 1, 0, "Chapter One: Start", 2)], "doc_id string, page int, ord int, title string, level int")
    sizes = spark.createDataFrame([("d", 18.0, 1)], "doc_id string, size double, level int")
    assert {r.block: r.level for r in layout.heading_levels(blocks_, marks, sizes).collect()} == {1: 2, 2: 1}


def test_txt_blocks():
    text = "THE TITLE\n\nSome words\nmore words.\n\n    x = 1\n    y = 2\n\n> said\n> so\n\n- a\n- b\n"
    got = [(b["kind"], b.get("text") or b.get("items")) for b in blocks.txt_blocks(text)]
    assert got == [("heading", "THE TITLE"), ("paragraph", "Some words more words."), ("code", "x = 1\ny = 2"), ("quote", "said so"), ("list", ["a", "b"])]


def test_markdown_blocks():
    text = "# T\n\npara\n\n| a | b\\|c |\n|---|---|\n| 1 |\n\n```py\nx\n```\n1. one\n2. two\n> q"
    got = list(blocks.markdown_blocks(text))
    assert [b["kind"] for b in got] == ["heading", "paragraph", "table", "code", "list", "quote"]
    assert [[c["text"] for c in r] for r in got[2]["cells"]] == [["a", "b|c"], ["1", ""]]
    assert got[2]["cells"][0][0]["is_header"] and got[3]["attrs"] == {"language": "py"} and got[4]["attrs"] == {"ordered": "true"}


def test_html_blocks():
    page = "<html><head><title>T</title></head><body><!-- no --><nav>x<p>menu</p></nav><h1>A <b>b</b></h1><p>one<p>two<pre><code class='c'>k\n</code></pre><ul><li>i<li>j</ul><table><tr><th colspan=2>h</th></tr><tr><td>1</td></tr></table><script>z</script></body></html>"
    got = [(b["kind"], b.get("text") or b.get("items")) for b in blocks.html_blocks(page)]
    assert got == [("paragraph", "x"), ("paragraph", "menu"), ("heading", "A b"), ("paragraph", "one"), ("paragraph", "two"), ("code", "k"), ("list", ["i", "j"]), ("table", None)]
    assert blocks.html_title(page) == "T"


def test_equal_items_have_their_own_ids():
    rows = list(blocks.node_rows("d", iter([{"kind": "list", "name": "", "items": ["x", "x"]}])))
    assert len({r["node_id"] for r in rows}) == 3


def test_epub_round_trip(spark, tmp_path):
    book = render.epub_file("Book", "fa", [("One", "<h1>One</h1><p>a &amp; b</p>"), ("Two", "<p>c</p>")], render.style_sheet({}, "fa"), "id")
    (tmp_path / "b.epub").write_bytes(book)
    (tmp_path / "n.txt").write_text("NOTE\n\nwords here")
    got = {(r.doc_id, r.kind, r.text) for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {("b", "heading", "One"), ("b", "paragraph", "a & b"), ("b", "paragraph", "c"), ("n", "heading", "NOTE"), ("n", "paragraph", "words here")}


def test_inline_markup():
    assert render.inline_xhtml("a *b* **c<** `d*e*` [f](g?x=1&y)") == 'a <em>b</em> <strong>c&lt;</strong> <code>d*e*</code> <a href="g?x=1&amp;y">f</a>'
    assert render.inline_typst("a *b* **c** $5 [f](u)") == 'a _b_ *c* \\$5 #link("u")[f]'


def test_rendered_list(spark):
    rows = list(blocks.node_rows("d", blocks.markdown_blocks("- a\n- b *c*")))
    nodes = spark.createDataFrame([(r["doc_id"], r["node_id"], r["parent_id"], r["pos"], r["kind"], r["level"], r["text"], r["attrs"]) for r in rows], "doc_id string, node_id string, parent_id string, pos int, kind string, level int, text string, attrs map<string,string>")
    assert [r.block for r in render.xhtml_blocks(nodes).collect()] == ["<ul><li>a</li><li>b <em>c</em></li></ul>"]
    assert [r.block for r in render.typst_blocks(nodes).collect()] == ["- a\n- b _c_"]


def test_presets(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("id: general\nname: Mine\ntypography: {leading: 2}\n")
    both = {r.id: r for r in presets.resolve(presets.builtin_presets(spark), presets.user_presets(spark, str(tmp_path))).collect()}
    assert len(both) == 7 and both["general"].name == "Mine" and not both["general"].builtin


def test_write_tree_replaces_what_it_names(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = "doc_id string, variant string, node_id string"
    store.write_tree(spark.createDataFrame([("a", "source", "1"), ("b", "source", "2")], cols), path)
    store.write_tree(spark.createDataFrame([("a", "source", "3"), ("a", "fa", "4")], cols), path)
    assert sorted((r.doc_id, r.variant, str(r.node_id)) for r in spark.read.parquet(path).collect()) == [("a", "fa", "4"), ("a", "source", "3"), ("b", "source", "2")]


def test_registry_and_runs(spark):
    items = spark.createDataFrame([("p", '{"name": "A", "stage": "created", "updated_at": "2024-01-01T02:00:00+02:00"}'), ("q", "{broken")], "project_id string, json string")
    got = {r.project_id: (r.name, r.error, str(r.updated_at)) for r in store.registry(items).collect()}
    assert got["p"] == ("A", None, "2024-01-01 00:00:00") and got["q"][1] == "cannot be read"
    runs = spark.createDataFrame([("r1", "p", "done", "2024-01-01")], "id string, project_id string, status string, t string").selectExpr("id", "project_id", "status", "cast(t as timestamp) as started_at", "cast(null as timestamp) as finished_at", "cast(null as string) as error")
    new = spark.createDataFrame([("r1", "p", "2024-01-02"), ("r2", "p", "2024-01-03")], "id string, project_id string, t string").selectExpr("id", "project_id", "cast(t as timestamp) as at")
    out = store.latest_first(store.start_runs(runs, new), "started_at", "id").collect()
    assert [(r.id, r.status) for r in out] == [("r2", "running"), ("r1", "done")]


def test_update_meta_writes_sent_fields(spark):
    p = spark.createDataFrame([("a", "created", "x"), ("b", "created", "x")], "project_id string, stage string, preset string").selectExpr("*", "timestamp '2024-01-01' as updated_at")
    u = spark.createDataFrame([("a", ["stage", "preset"], "review", None)], "project_id string, sent array<string>, stage string, preset string").selectExpr("*", "timestamp '2024-02-01' as at")
    got = {r.project_id: (r.stage, r.preset, r.updated_at.month) for r in store.update_meta(p, u, ["stage", "preset"]).collect()}
    assert got == {"a": ("review", None, 2), "b": ("created", "x", 1)}


def test_model_steps(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("busy")
        return x

    waits = []
    assert agents.with_retries(flaky, sleep=waits.append)(7) == 7 and waits == [1.0, 2.0]
    c = spark.createDataFrame([("b", "T%02d" % k, 99 - k, None) for k in range(3)] + [("x", "boom", 1, "s")], "book string, term string, count int, sample string")

    def model(prompt):
        if "boom" in prompt:
            raise ValueError("refused")
        return {"decisions": [{"index": 1, "kept": False, "target": None, "policy": None, "part_of_speech": None, "explanation": None}, {"index": 1, "kept": True, "target": "t", "policy": "keep", "part_of_speech": None, "explanation": None}, {"index": 9, "kept": True, "target": "t", "policy": "keep", "part_of_speech": None, "explanation": None}], "prompt_tokens": 5, "completion_tokens": 2}

    kept, totals = agents.adjudicate(c, model, "book")
    assert [(r.book, r.term, r.target, r.policy) for r in kept.collect()] == [("b", "T01", "t", "keep")]
    assert {r.book: (r.requests, r.prompt_tokens, r.failed) for r in totals.collect()} == {"b": (1, 5, 0), "x": (1, 0, 1)}
    s = spark.createDataFrame([("d", "i", "x", "translated", "e", False), ("d", "j", "y", "flagged", "e", True)], "doc_id string, id string, target_text string, status string, error string, locked boolean")
    again = {r.id: (r.status, r.target_text) for r in agents.retranslate(s, s.select("doc_id", "id")).collect()}
    assert again == {"i": ("pending", None), "j": ("flagged", "y")}
    terms = spark.createDataFrame([("a", "keep", True), ("b", "translate", True), ("c", "translate_paren", True), ("d", "keep", False)], "term string, policy string, enabled boolean")
    assert {r.term for r in agents.protected_terms(terms).collect()} == {"a", "c"}
    assert agents.only(s, s.filter("id = 'i'"), ["doc_id", "id"]).count() == 1


def test_typography():
    css = render.style_sheet({"body_size_pt": "12", "justify": "false", "heading_font": "H", "digit_style": "persian", "font_files": ["a.ttf"]}, "fa")
    assert "direction: rtl" in css and "12pt/1.75" in css and "text-align: start" in css and "list-style-type: persian" in css and 'url("../fonts/a.ttf")' in css and "h1 { font-size: 24pt" in css
    typ = render.typst_preamble({"page_size": "TRADE", "running_heads": True, "paragraph_indent_em": 1.5, "digit_style": "persian"}, "fa-IR")
    assert "width: 152.4mm" in typ and 'lang: "fa", dir: rtl' in typ and "header: context" in typ and "first-line-indent: 1.5em" in typ and "binding: right" in typ and 'numbering: "۱"' in typ


def test_tree_edits(spark):
    rows = [("d", "a", None, 0, "A", ["a"]), ("d", "b", None, 1, "B", ["b"]), ("d", "c", "b", 0, "C", ["b", "c"]), ("d", "e", None, 2, "E", ["e"])]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, child_idx int, text string, ancestors array<string>")
    pick = lambda *ids: spark.createDataFrame([("d", i) for i in ids], "doc_id string, node_id string")
    assert {r.node_id for r in tree.delete_subtrees(nodes, pick("b")).collect()} == {"a", "e"}
    merged = {r.node_id: r for r in tree.merge_with_next(nodes, pick("a")).collect()}
    assert merged["a"].text == "A B" and merged["c"].parent_id == "a" and "b" not in merged
    moved = {r.node_id: r.child_idx for r in tree.move_children(nodes, spark.createDataFrame([("d", "e", None, -0.5)], "doc_id string, node_id string, new_parent_id string, new_idx double")).collect()}
    assert moved == {"e": 0, "a": 1, "b": 2, "c": 0}
    cut = {r.node_id: r.text for r in tree.split_node(nodes.withColumn("text", F.lit("one two")), pick("a").withColumn("split_at", F.lit(4))).collect()}
    assert cut["a"] == "one" and [t for i, t in cut.items() if i.startswith("a-")] == ["two"]


def test_idle_projects_stream(spark, tmp_path):
    spark.createDataFrame([("p", 1), ("p", 2)], "project string, n int").write.parquet(str(tmp_path / "e"))
    stream = progress.event_stream(spark, str(tmp_path / "e"))
    out = progress.idle_projects(stream, "project", 1000)
    q = out.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            q.awaitTermination(1)
            if spark.table("idle").count():
                break
        assert [tuple(r) for r in spark.table("idle").collect()] == [("p", 2)]
    finally:
        q.stop()


def test_visible_nodes(spark):
    nodes = spark.createDataFrame([("d", "a", []), ("d", "b", ["a"]), ("d", "c", ["a", "b"]), ("d", "e", [])], "doc_id string, node_id string, ancestors array<string>")
    shut = spark.createDataFrame([("d", "b")], "doc_id string, node_id string")
    assert {r.node_id for r in tree.visible(nodes, shut).collect()} == {"a", "b", "e"}


def test_block_texts_and_order(spark):
    spans = spark.createDataFrame([("d", 1, 1, 0, 11.04, " One "), ("d", 1, 1, 1, 18.0, "two three")], "doc_id string, page int, block int, ord int, size double, text string")
    assert [tuple(r)[3:] for r in layout.block_texts(spans).collect()] == [("One two three", 18.0)]
    items = spark.createDataFrame([("d", 1, 5.0, 0.0, 0), ("d", 1, 1.0, 9.0, 1), ("d", 1, 1.0, 9.0, 2)], "doc_id string, page int, y0 double, x0 double, found int")
    assert {r.found: r.pos for r in layout.reading_order(items).collect()} == {1: 0, 2: 1, 0: 2}


def test_figures_and_tables(spark):
    fig = render.figure_xhtml(F.array(F.lit("a.png")), F.array(F.lit('x"')), F.lit("cap"), F.lit(0.5))
    assert one(spark, fig) == '<figure><img src="../assets/a.png" alt="x&quot;" style="width:50.0%"/><figcaption>cap</figcaption></figure>'
    cell = lambda t, h, c: F.struct(F.lit(t).alias("text"), F.lit(h).alias("is_header"), F.lit(c).alias("colspan"), F.lit(1).alias("rowspan"))
    cells = F.array(F.array(cell("h", True, 2)), F.array(cell("a", False, 1), cell("b", False, 1)))
    assert one(spark, render.table_typst(cells, F.lit(2), F.lit(None).cast("string"))) == "#table(columns: 2, table.cell(colspan: 2)[*h*], [a], [b])"
    assert one(spark, render.table_xhtml(cells, F.lit("c"))) == '<table><caption>c</caption><tr><th colspan="2">h</th></tr><tr><td>a</td><td>b</td></tr></table>'


def test_runs_and_stages(spark):
    runs = spark.createDataFrame([("a", "running", None, None), ("b", "failed", "t0", "x")], "id string, status string, finished_at string, error string")
    ended = spark.createDataFrame([("a", "succeeded", "t1", None), ("b", "succeeded", "t1", None)], "id string, new_status string, at string, new_error string")
    assert {r.id: (r.status, r.finished_at) for r in store.finish_runs(runs, ended).collect()} == {"a": ("succeeded", "t1"), "b": ("failed", "t0")}
    p = spark.createDataFrame([("p", "paused"), ("q", "created")], "id string, stage string")
    assert {r.id: r.next_stage for r in store.may_start(p, "translate").collect()} == {"p": "review", "q": None}


def test_prompts(spark):
    rows = [("d", 0, 0, "one", "A"), ("d", 0, 1, "two", "A"), ("d", 0, 2, "three", "")]
    segs = spark.createDataFrame(rows, "doc_id string, batch int, ordinal int, text string, path string")
    body = prompts.batch_bodies(segs, ["doc_id", "batch"], "ordinal", "text", "path").first()
    assert (body.body, body["count"]) == ("Section: A\n\n⟦#1⟧\none\n\n⟦#2⟧\ntwo\n\n⟦#3⟧\nthree", 3)
    assert one(spark, prompts.last_lines(F.lit("a\n\nb\nc\nd\ne\n"))) == "b\nc\nd\ne"


def test_short_and_foreign_terms_meet_batches(spark):
    hays = spark.createDataFrame([("b", 1, "The IO port; internet"), ("b", 2, "سلام دنیا"), ("c", 3, "io")], "k string, batch int, hay string")
    terms = spark.createDataFrame([("b", "IO", 5), ("b", "net", 4), ("b", "دنی", 3), ("b", "zzz", 9), ("c", "i", 1)], "k string, term string, count int")
    got = {(r.batch, r.term, r.rank) for r in B.batch_glossary(hays, terms, "k").collect()}
    assert got == {(1, "IO", 1), (1, "net", 2), (2, "دنی", 1), (3, "i", 1)}
    assert {(r.batch, r.term) for r in B.batch_glossary(hays, terms, "k", most=1).collect()} == {(1, "IO"), (2, "دنی"), (3, "i")}


def test_subsumption_equals_brute_force(spark):
    r = random.Random(3)
    terms = {("".join(r.choice("ab ") for _ in range(r.randrange(3, 9)))) for _ in range(200)} | {"éa b", "x éa bc"}
    df = spark.createDataFrame([(k, t, 2, "x") for k in "pq" for t in terms if k == "p" or len(t) % 2], "k string, term string, count int, reason string")
    rows = [(x.k, x.term) for x in df.collect()]
    want = {(k, t) for k, t in rows if not any(k == j and t in u and len(u) > len(t) for j, u in rows)}
    assert {(x.k, x.term) for x in G.drop_subsumed(df, "k").collect()} == want


def test_mining_sees_the_true_text(spark):
    df = spark.createDataFrame([("b", "größe.wert fooBar fooBaré Écoles Foo Bar. Foo Baré X.Y.Z TCP/IP ABé")], "k string, text string")
    assert {x.term for x in G.code_identifiers(df, "k").collect()} == {"größe.wert", "fooBar", "X.Y.Z"}
    assert {x.term for x in G.capitalized_phrases(df, "k").collect()} == {"Foo Bar"}
    assert {x.term for x in G.acronyms(df, "k").collect()} == {"X.Y.Z", "TCP/IP"}


def test_context_of_three_segments(spark):
    rows = [(1, k, f"s{k}", None if k in (1, 3) else f"t{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "d int, o int, s string, t string")
    got = [r.context for r in B.rolling_context(df, "d", "o", F.col("t").isNotNull(), "s", "t", most=3).orderBy("o").collect()]
    assert got == ["", "s0 → t0", "s0 → t0", "s0 → t0\ns2 → t2", "s0 → t0\ns2 → t2", "s0 → t0\ns2 → t2\ns4 → t4"]


def test_findings(spark):
    p = spark.createDataFrame([(1, "A long enough source 12.5", " "), (2, "The net and 34 more", "≧3≨")], "i int, source string, target string")
    t = spark.createDataFrame([("net", "Netz", "translate", True)], "term string, target_form string, policy string, enabled boolean")
    got = {(r.i, r.rule, r.severity, r.detail) for r in qa.findings(p, ["i"], qa.glossary_misses(p, t, ["i"])).collect()}
    assert got == {(1, "empty-output", "error", ""), (2, "unresolved-placeholder", "error", "≧3≨"), (2, "length-ratio", "warning", "0.158"), (2, "altered-number", "warning", "34"), (2, "glossary-inconsistency", "warning", "net")}


def test_directions_and_contents_lines(spark):
    got = spark.createDataFrame([("dv",), ("iw",), ("fa_IR",), ("en",), (None,)], "l string").select(T.direction(F.col("l")).alias("d")).collect()
    assert [r.d for r in got] == ["rtl", "ltr", "rtl", "ltr", "ltr"]
    lines = spark.createDataFrame([("Chapter 1 ..... 12",), ("Chapter 1 12",), ("Intro\t\t3 ",), (None,)], "l string").select(T.is_toc_line(F.col("l")).alias("t")).collect()
    assert [r.t for r in lines] == [True, False, True, False]


def test_what_cannot_be_read_is_an_error_node(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"bad \xff byte\r\nsecond line")
    (tmp_path / "b.epub").write_bytes(b"no zip")
    (tmp_path / "c.xyz").write_bytes(b"?")
    (tmp_path / "d.html").write_text("<div>" * 3000 + "deep")
    got = {r.doc_id: (r.kind, r.text) for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a"] == ("paragraph", "bad \ufffd byte second line")
    assert {k: v[0] for k, v in got.items() if k != "a"} == {"b": "error", "c": "error", "d": "paragraph"} and got["d"][1] == "deep"
    assert got["c"][1] == "unsupported file: c.xyz"


def tree_rows(spark):
    rows = [("d", "a", None, 0, "A"), ("d", "b", None, 1, "B"), ("d", "c", None, 2, "C"), ("d", "b1", "b", 0, "b one"), ("d", "b2", "b", 1, "b two")]
    return spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, child_idx int, text string")


def shape(nodes):
    out = {}
    for r in sorted(nodes.collect(), key=lambda r: r.child_idx):
        out.setdefault(r.parent_id, []).append(r.node_id)
    return out


def test_indents_moves_and_splits(spark):
    n = tree_rows(spark)
    pick = lambda *ids: spark.createDataFrame([("d", i) for i in ids], "doc_id string, node_id string")
    assert shape(tree.indent_nodes(n, pick("c"))) == {None: ["a", "b"], "b": ["b1", "b2", "c"]}
    assert shape(tree.indent_nodes(n, pick("a"))) == shape(n)
    assert shape(tree.outdent_nodes(n, pick("b1"))) == {None: ["a", "b", "b1", "c"], "b": ["b2"]}
    assert shape(tree.outdent_nodes(n, pick("a"))) == shape(n)
    moves = lambda *m: spark.createDataFrame([("d", i, k) for i, k in m], "doc_id string, node_id string, dir int")
    assert shape(tree.shift_nodes(n, moves(("c", -1), ("b1", 1)))) == {None: ["a", "c", "b"], "b": ["b2", "b1"]}
    assert shape(tree.shift_nodes(n, moves(("a", -1), ("c", 1)))) == shape(n)
    can = {r.node_id: (r.can_move_up, r.can_move_down, r.can_indent, r.can_outdent, r.can_merge) for r in tree.siblings_of(n).collect()}
    assert can["a"] == (False, True, False, False, True) and can["b2"] == (True, False, True, True, False)
    patched = tree.update_nodes(n, spark.createDataFrame([("d", "a", "new")], "doc_id string, node_id string, text string"))
    assert {r.node_id: r.text for r in patched.collect()} == {"a": "new", "b": "B", "c": "C", "b1": "b one", "b2": "b two"}
    once = tree.split_node(n, spark.createDataFrame([("d", "b1", 2), ("d", "b2", 5)], "doc_id string, node_id string, split_at int"))
    twice = tree.split_node(once, spark.createDataFrame([("d", "b2", 1)], "doc_id string, node_id string, split_at int"))
    rows = sorted((r for r in twice.collect() if r.parent_id == "b"), key=lambda r: r.child_idx)
    assert [r.text for r in rows] == ["b", "one", "b", "two"] and len({r.node_id for r in rows}) == 4


def test_merge_takes_the_images_along(spark):
    rows = [("d", "a", None, 0, "A", ["x"]), ("d", "b", None, 1, "B", ["y", "z"]), ("d", "c", None, 2, None, None)]
    n = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, child_idx int, text string, images array<string>")
    got = {r.node_id: (r.text, r.images) for r in tree.merge_with_next(n, spark.createDataFrame([("d", "a")], "doc_id string, node_id string")).collect()}
    assert got == {"a": ("A B", ["x", "y", "z"]), "c": (None, None)}


def test_paths_and_image_files(spark):
    paths = ["a/./b//c", "a/../b", "../x", "a/../../x/.", "\\win\\..\\f", "", "..", "a/.."]
    assert [one(spark, T.normal_path(F.lit(p))) for p in paths] == ["a/b/c", "b", "../x", "../x", "f", "", "..", ""]
    image = "array<struct<src:string,alt:string,caption:string>>"
    srcs = ["pics/a.png", "../pics/a.png", "a.png", "data:image/png;base64,x", "none.png", "HTTPS://x/a.png", None, "b+c%20d.png", "b%zz.png"]
    n = spark.createDataFrame([("d", "n", "t/book.md", [(s, "x", None) for s in srcs]), ("e", "n", None, [("pics/a.png", None, None)])], f"doc_id string, node_id string, base string, images {image}")
    files = spark.createDataFrame([("d", p) for p in ("t/pics/a.png", "pics/a.png", "other/a.png", "t/b+c d.png", "q/b%zz.png")], "doc_id string, path string")
    found = readers.resolve_images(n, files)
    got = {(r.doc_id, r.image): r.path for r in found.collect()}
    assert [got["d", k] for k in range(len(srcs))] == ["t/pics/a.png", "pics/a.png", "other/a.png", None, None, None, None, "t/b+c d.png", "q/b%zz.png"]
    assert got["e", 0] is None and len(got) == len(srcs) + 1
    shown = {r.doc_id: r.images for r in readers.with_assets(n, found).collect()}
    assert [i.src for i in shown["d"]] == ["t/pics/a.png", "pics/a.png", "other/a.png", "t/b+c d.png", "q/b%zz.png"] and shown["e"] == []


def test_contents_pages_by_ratio(spark):
    page = lambda *lines: one(spark, T.is_toc_page(F.array(*map(F.lit, lines))))
    assert page("One ... 1", "", "Two     2", "Three\t\t۱۲", "prose") and not page("One ... 1", "Two ... 2", " ")
    assert not page("One ... 1", "Two ... 2", "prose", "prose", "prose")


def test_page_items(spark):
    box = "doc_id int, page int, found int, x0 double, y0 double, x1 double, y1 double"
    t = spark.createDataFrame([(1, 1, 0, 0.0, 50.0, 100.0, 80.0, 2, 2), (1, 1, 1, 0.0, 0.0, 100.0, 9.0, 1, 5)], box + ", rows int, cols int")
    i = spark.createDataFrame([(1, 1, 0, 0.0, 90.0, 24.0, 114.0), (1, 1, 1, 0.0, 0.0, 90.0, 23.0)], box)
    b = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 9.0), (1, 1, 1, 5.0, 60.0, 9.0, 70.0), (1, 1, 2, 0.0, 90.0, 9.0, 99.0)], box)
    assert [(r.kind, r.found) for r in layout.page_items(b, t, i).orderBy("pos").collect()] == [("prose", 0), ("table", 0), ("image", 0), ("prose", 2)]


def test_replies_of_a_wrong_shape_are_halved(spark):
    df = spark.createDataFrame([(1, [("a", "x"), ("b", "y"), ("c", "z")])], "k int, items array<struct<id:string,source:string>>")
    for bad in (None, [], ["only one"], 7):
        rows = B.translate_batches(df, lambda texts, bad=bad: [t + "!" for t in texts] if len(texts) == 1 else bad, ["k"]).collect()
        assert {r.id: r.target_text for r in rows} == {"a": "x!", "b": "y!", "c": "z!"} and sum(r.requests for r in rows) == 5


def test_scratch_tables_are_removed(spark):
    import os

    from quire.functions import storage

    with storage.scratch_tables(spark):
        kept = storage.saved(spark.range(3), "t")
        assert kept.count() == 3
        path = storage._WRITTEN[-1]
    assert not os.path.exists(path) and path not in storage._WRITTEN


def test_catalogues_and_kinds(spark):
    many = spark.range(agents.MOST_PRESETS + 1).selectExpr("cast(id as string) as id", "'n' as name", "'d' as description")
    with pytest.raises(ValueError, match="presets"):
        agents.preset_catalogue(many)
    assert agents.preset_catalogue(many.limit(1)).startswith("* ")
    df = spark.createDataFrame([("k", "code", "fooBar"), ("k", "quote", "barFoo")], "k string, kind string, text string")
    assert {r.term for r in G.code_identifiers(df, "k", kinds=("code", "paragraph", "heading")).collect()} == {"fooBar"}
    assert one(spark, prompts.data_url(F.lit("ab").cast("binary"), F.lit("image/png"))) == "data:image/png;base64,YWI="


def test_text_outside_blocks_is_kept():
    page = "<body>top <div>Bare <b>bold</b><p>para</p> tail<br>end</div><a href=x>link <img src=i.png></a><section><span>s</span></section> </body>"
    got = [(b["kind"], b.get("text")) for b in blocks.html_blocks(page)]
    assert got == [("paragraph", "top"), ("paragraph", "Bare bold"), ("paragraph", "para"), ("paragraph", "tail end"), ("paragraph", "link"), ("figure", None), ("paragraph", "s")]
    deep = "<div>" * 5000 + "<p>in</p>out" + "</div>" * 5000
    assert [b["text"] for b in blocks.html_blocks(deep)] == ["in", "out"]


def test_fences_end_at_their_own_mark():
    md = "~~~ python title=x\na\n```\nb\n~~~\n\n````\n```\nc\n````\n\n```inline``` text\n\n```js\nopen"
    got = [(b["kind"], b["text"], b.get("attrs", {}).get("language")) for b in blocks.markdown_blocks(md)]
    assert got == [("code", "a\n```\nb", "python"), ("code", "```\nc", None), ("paragraph", "```inline``` text", None), ("code", "open", "js")]


def test_epub_with_a_missing_chapter_and_quoted_names():
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="ch%201.xhtml"/><item id="b" href="gone.xhtml"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>')
        z.writestr("o/ch 1.xhtml", "<html><body><p>one</p></body></html>")
        z.writestr("o/c.xhtml", "<html><body><p>three</p></body></html>")
    assert [b["text"] for b in blocks.epub_blocks(data.getvalue())] == ["one", "three"]
