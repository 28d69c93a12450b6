"""Keyed tables: merges of results, rollups, pages, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.storage import saved

#: Folders of a table of trees.
BUCKETS = 256
#: From which stages an action may start, and where it leads.
TRANSITIONS = [
    ("ingest", ("created", "failed"), "structure_review"),
    ("approve_structure", ("structure_review",), "analyzing"),
    ("analyze", ("structure_review", "analyzing", "failed"), "style_review"),
    ("approve_style", ("style_review",), "translating"),
    ("translate", ("translating", "paused", "review", "failed"), "review"),
    ("pause", ("translating",), "paused"),
    ("export", ("review", "done", "failed"), "done"),
]


def record_translations(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments after results came in. ``results``: doc_id, id, new_target,
    prompt_tokens, completion_tokens, cost_usd, flags (array) and error (null:
    it went well). Locked segments are left alone, by failures too; flags make
    a segment flagged; attempts count up and an error is cleared. Tokens are
    written where segments have such columns."""
    used = [c for c in ("prompt_tokens", "completion_tokens") if c in segments.columns and c in results.columns]
    r = results.select("doc_id", "id", "new_target", "flags", F.col("error").alias("new_error"), F.col("cost_usd").alias("new_cost"), *[F.col(c).alias(f"new_{c}") for c in used], F.lit(True).alias("tried"))
    both = segments.join(r, ["doc_id", "id"], "left")
    take = F.coalesce("tried", F.lit(False)) & ~F.coalesce("locked", F.lit(False))
    ok = take & F.col("new_error").isNull()
    status = F.when(take & F.col("new_error").isNotNull(), "failed").when(ok & (F.size("flags") > 0), "flagged").when(ok, "translated").otherwise(F.col("status"))
    return both.withColumns(
        {
            "status": status,
            "target_text": F.when(ok, F.col("new_target")).otherwise(F.col("target_text")),
            "attempts": F.col("attempts") + take.cast("int"),
            "cost_usd": F.when(ok, F.col("new_cost")).otherwise(F.col("cost_usd")),
            "error": F.when(take, F.col("new_error")).otherwise(F.col("error")),
        }
        | {c: F.when(ok, F.col(f"new_{c}")).otherwise(F.col(c)) for c in used}
    ).drop(*[f"new_{c}" for c in used], "new_target", "flags", "new_error", "new_cost", "tried")


def usage_rows(results: DataFrame) -> DataFrame:
    """What is appended to the usage facts: results that used anything."""
    return results.filter("prompt_tokens > 0 or completion_tokens > 0 or cost_usd > 0")


def update_fields(rows: DataFrame, updates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Only fields named in ``sent`` (array of names) are written; a sent null is."""
    u = updates.select(*keys, "sent", *[F.col(f).alias(f"_{f}") for f in fields])
    both = rows.join(u, keys, "left")
    out = both.withColumns({f: F.when(F.array_contains("sent", f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields})
    return out.drop("sent", *[f"_{f}" for f in fields])


def pending(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.coalesce("locked", F.lit(False)) & F.col("status").isin("pending", "failed"))


def status_counts(rows: DataFrame, status: str, key: str | None = None) -> DataFrame:
    """Counts by status, and a row "total", in one aggregation."""
    keys = [key] if key else []
    sets = [[*keys, status], keys]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, status]])
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.grouping(status).alias("_g")).withColumn(status, F.when(F.col("_g") == 1, "total").otherwise(F.col(status))).drop("_g")


def usage_rollup(events: DataFrame, key: str, cost: Column, tokens: Column) -> DataFrame:
    return events.groupBy(key).agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("calls"))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of the ordered rows: a top-k, not a full sort."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 100).otherwise(F.floor(100 * done / total).cast("int"))


def stage_violations(events: DataFrame, key: str, order: list[str], stage: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Events whose stage may not follow the one before it."""
    before = events.withColumn("from_stage", F.lag(stage).over(Window.partitionBy(key).orderBy(*order)))
    pairs = events.sparkSession.createDataFrame(allowed, "from_stage string, to_stage string")
    checked = before.filter(F.col("from_stage").isNotNull())
    return checked.join(F.broadcast(pairs.withColumnRenamed("to_stage", stage)), ["from_stage", stage], "left_anti")


def write_tree(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write node tables; the documents and variants that the rows name are
    replaced, others stay. Documents lie in ``buckets`` folders by a hash of
    their id, however many there are; only the folders of those that are written
    are read and replaced. ``buckets`` must be the same at every write."""
    spark = nodes.sparkSession
    new = saved(nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")), "tree")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(*touched))
        named = new.select("doc_id", "variant").distinct()
        new = saved(old.join(named, ["doc_id", "variant"], "left_anti").select(*new.columns).unionByName(new), "tree")
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def run_stats(segments: DataFrame, key: str) -> DataFrame:
    """What a run did, in one aggregation. ``segments``: status, requests,
    prompt_tokens, completion_tokens, cost_usd; a row without a status is no
    segment, but what it used counts."""
    status = F.col("status")
    return segments.groupBy(key).agg(
        F.count(status).alias("queued"),
        F.count_if(status.isin("translated", "flagged")).alias("done"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "failed").alias("failed"),
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"),
        F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
    )


def finish_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """``runs``: id, status, finished_at, error; ``ended``: id, new_status,
    at, new_error. Runs that have ended already stay as they are."""
    both = runs.join(ended, "id", "left")
    take = F.col("new_status").isNotNull() & F.col("finished_at").isNull()
    return both.withColumns({"status": F.when(take, F.col("new_status")).otherwise(F.col("status")), "finished_at": F.when(take, F.col("at")).otherwise(F.col("finished_at")), "error": F.when(take, F.col("new_error")).otherwise(F.col("error"))}).drop("new_status", "at", "new_error")


def may_start(projects: DataFrame, action: str) -> DataFrame:
    """Adds ``allowed`` and the stage that the action leads to."""
    _, sources, to = next(t for t in TRANSITIONS if t[0] == action)
    return projects.withColumns({"allowed": F.col("stage").isin(*sources), "next_stage": F.when(F.col("stage").isin(*sources), to)})


def start_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """``runs`` with a running row for each of ``new`` (id, key, stage, at);
    ids that are there already are not started again."""
    fresh = new.join(runs.select("id"), "id", "left_anti").withColumns({"status": F.lit("running"), "started_at": F.col("at"), "finished_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    return runs.unionByName(fresh.select(*runs.columns))


def latest_first(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """Runs by start, or projects by update: the latest first, ties by id."""
    return rows.orderBy(F.col(at).desc_nulls_last(), tie)


def update_meta(projects: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """Write the fields that an update names in ``sent``, and its time ``at`` as
    updated_at. ``updates``: project_id, sent, at and the fields."""
    out = update_fields(projects, updates.drop("at"), ["project_id"], fields)
    times = updates.select("project_id", F.col("at").alias("_at"))
    return out.join(times, "project_id", "left").withColumn("updated_at", F.coalesce("_at", "updated_at")).select(*projects.columns)


def update_terms(terms: DataFrame, updates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Edits by hand: as ``update_fields``, and every edited term is locked."""
    edited = updates.select(*keys, F.lit(True).alias("_edited")).distinct()
    out = update_fields(terms, updates, keys, fields).join(edited, keys, "left")
    return out.withColumn("locked", F.coalesce("_edited", "locked")).select(*terms.columns)


def create_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Adds ``outcome`` to the projects and the new ones: a new one whose id is
    taken, here or by an earlier one of ``new`` (by ``seq``), is refused."""
    first = F.row_number().over(Window.partitionBy("project_id").orderBy("seq")) == 1
    taken = projects.select("project_id", F.lit(True).alias("_taken")).distinct()
    told = new.withColumn("_first", first).join(taken, "project_id", "left")
    outcome = F.when(F.coalesce("_taken", F.lit(False)) | ~F.col("_first"), "refused").otherwise("created")
    return projects.withColumn("outcome", F.lit("kept")).unionByName(told.withColumn("outcome", outcome).select(*projects.columns, "outcome"))


def delete_projects(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Any keyed table without the rows of projects that are gone."""
    return rows.join(gone.select("project_id").distinct(), "project_id", "left_anti")


def registry(items: DataFrame) -> DataFrame:
    """Projects read from their stored JSON (project_id, json); a corrupt one is
    a row with an error."""
    fields = "name string, stage string, source_lang string, target_lang string, updated_at timestamp"
    read = items.withColumn("p", F.from_json("json", fields + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull() | F.col("p.name").isNull()
    return read.select("project_id", "p.name", "p.stage", "p.source_lang", "p.target_lang", F.to_utc_timestamp("p.updated_at", F.current_timezone()).alias("updated_at"), F.when(bad, "cannot be read").alias("error"))
