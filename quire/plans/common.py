"""Tables and shared pieces of SQL for the registered queries.

The documents of the test tables have no markup, so structure is put on lines
by a rule that both engines compute: a line whose length is divisible by 5 is a
heading of level 1 + length mod 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.tree import line_nodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer file splits than there are cores is dealt
    out anew, so that small tables in one file use all of them."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("line")
    return line_nodes(documents(spark, sf_dir), n % 5 == 0, 1 + n % 3)


LINES = """lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS pos FROM documents)"""
NODES = f"""{LINES},
nodes AS (
    SELECT *, kind || '-' || substr(sha256(kind || chr(0) || text || chr(0) || pos), 1, 12) AS node_id FROM (
        SELECT doc_id, pos, CASE WHEN length(line) % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
               CASE WHEN length(line) % 5 = 0 THEN 1 + length(line) % 3 END AS level, line AS text
        FROM lines WHERE regexp_matches(line, '\\S')))"""
PATHS = f"""{NODES},
above AS (
    SELECT *, {", ".join(f"last_value(CASE WHEN kind = 'heading' AND level = {k} THEN {{'pos': pos, 'text': text}} END IGNORE NULLS) OVER before AS h{k}" for k in (1, 2, 3))}
    FROM nodes WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
paths AS (
    SELECT *, list_filter([
        CASE WHEN kind <> 'heading' OR 1 < level THEN h1.text END,
        CASE WHEN (kind <> 'heading' OR 2 < level) AND NOT coalesce(h1.pos > h2.pos, false) THEN h2.text END,
        CASE WHEN (kind <> 'heading' OR 3 < level) AND NOT coalesce(h1.pos > h3.pos, false) AND NOT coalesce(h2.pos > h3.pos, false) THEN h3.text END
    ], lambda x: x IS NOT NULL) AS heading_path FROM above)"""
#: Sentence ends become chr(31), as DuckDB's expressions cannot look behind.
SENTENCES = "string_split(regexp_replace(regexp_replace({}, '([.!?۔؟…])\\s+', '\\1' || chr(31), 'g'), chr(31) || '$', ''), chr(31))"
PAIRS = """pairs AS (
    SELECT conv_id, turn, text AS source, lead(text) OVER w AS target, lead(role) OVER w AS next_role, role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
