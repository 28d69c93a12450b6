"""Queries against their SQL on tables that hold what the test data rarely does."""

from __future__ import annotations

import duckdb
import pytest

from quire.plans.catalogue import ORACLES, QUERIES
from tests.test_entry import rows_of

DOCUMENTS = "doc_id long, text string, source string"


@pytest.fixture
def equals_sql(spark, tmp_path):
    def check(name, table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).fetchdf()
        assert rows_of(got) == rows_of(want)
        return got

    return check


def test_references_without_semicolon(equals_sql):
    pages = [(1, "<body><h1>A &amp; B &amp;&amp</h1><ul><li>c &quo</li><li>d &lt;&am</li></ul></body>"), (2, "<h2>x &amp y &#x27;</h2>")]
    assert len(equals_sql("q36_html_nodes", "pages", pages, "page_id long, html string")) == 2


def test_long_lines_are_one_segment(equals_sql):
    lines = ["Short. Line.", "Some words. " * 500, "x", "More of it. " * 400, "", "y", "End. " * 1000]
    got = equals_sql("q87_resegment_edits", "documents", [(1, "\n".join(lines), "a"), (7, lines[1], "b")], DOCUMENTS)
    assert set(got["status"]) == {"translated", "pending"}


def test_books_of_blank_lines_and_marks(equals_sql):
    texts = ["", " \n\t", None, "***", "a\n`\n* *\n\n**", "\u00a0\nb c\u3000", "[](u)\n[ ](x)\n[a](b) c", "**a**\n<b> & `c`"]
    got = equals_sql("q63_epub_books", "documents", [(k, t, "a") for k, t in enumerate(texts)], DOCUMENTS)
    assert dict(zip(got["doc_id"], got["n"], strict=True)) == {0: 0, 1: 0, 3: 1, 4: 4, 5: 2, 6: 3, 7: 2}
