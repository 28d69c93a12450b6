"""Node tables: heading paths, chapters, samples, edits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions.storage import saved
from quire.functions.text import is_blank, node_id

MAX_LEVEL = 6
#: Rounds of doubling that see any tree of up to 2 ** ROUNDS levels.
ROUNDS = 24
#: Nodes of a document that one task numbers at once.
MOST_NODES = 1 << 17


def line_nodes(docs: DataFrame, heading: Column, level: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line that is not blank is a top-level node: doc_id, pos, kind,
    level, text, node_id. ``heading`` and ``level`` see the column ``line``."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    nodes = lines.filter(~is_blank(F.col("line"))).select("doc_id", "pos", F.when(heading, "heading").otherwise("paragraph").alias("kind"), F.when(heading, level).alias("level"), F.col("line").alias("text"))
    return nodes.withColumn("node_id", node_id(F.col("kind"), F.col("text"), F.col("pos")))


def heading_paths(nodes: DataFrame, levels: int = MAX_LEVEL, key: str = "doc_id") -> DataFrame:
    """Adds ``heading_path``: the headings above each node, outermost first; a
    heading is not in its own path and closes those of its level and below."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    is_heading, own = F.col("kind") == "heading", F.coalesce("level", F.lit(1))
    seen = [F.last(F.when(is_heading & (own == k), F.struct("pos", "text")), ignorenulls=True).over(before) for k in range(1, levels + 1)]
    out = nodes.withColumns({f"_h{k}": c for k, c in enumerate(seen, 1)})
    path = []
    for k in range(1, levels + 1):
        here = F.col(f"_h{k}")
        later = [F.col(f"_h{j}.pos") > here["pos"] for j in range(1, k)]
        closed = F.coalesce(*[F.when(x, True) for x in later], F.lit(False)) if later else F.lit(False)
        path.append(F.when(~closed & (~is_heading | (F.lit(k) < own)), here["text"]))
    return out.withColumn("heading_path", F.array_compact(F.array(*path))).drop(*[f"_h{k}" for k in range(1, levels + 1)])


def chapters(nodes: DataFrame, title: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Adds ``chapter_no`` and ``chapter_title``: a chapter starts at each
    level-1 heading; what comes before the first is a chapter of the book's title."""
    opens = (F.col("kind") == "heading") & (F.coalesce("level", F.lit(1)) == 1)
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = nodes.withColumn("chapter_no", F.sum(opens.cast("int")).over(upto))
    own = F.last(F.when(opens, F.coalesce("text", F.lit("Untitled"))), ignorenulls=True).over(upto)
    return numbered.withColumn("chapter_title", F.coalesce(own, title if title is not None else F.lit(None), F.lit("Untitled")))


def stratified_sample(nodes: DataFrame, max_chars: int = 12_000, key: str = "doc_id") -> DataFrame:
    """One row per document: text blocks visited first, last, middle, then from
    the start, as long as they fit the budget with a blank line between them.

    The first block that does not fit is cut to what is left, if over 3
    characters are; nothing comes after it."""
    blocks = nodes.filter(((F.col("kind") == "heading") & (F.coalesce("level", F.lit(1)) == 1)) | ((F.col("kind") == "paragraph") & ~is_blank(F.col("text"))))
    n = F.size("blocks")
    order = F.array_distinct(F.concat(F.array(F.lit(0), n - 1), F.when(n > 2, F.array(F.floor((n - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>")), F.sequence(F.lit(0), n - 1)))
    listed = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))).alias("blocks"))
    visited = listed.select(key, F.transform(order, lambda i: F.element_at("blocks", (i + 1).cast("int"))["text"]).alias("texts"))

    def take(state: Column, text: Column) -> Column:
        gap = F.when(F.size(state["parts"]) > 0, 2).otherwise(0)
        room = F.lit(max_chars) - state["used"] - gap
        fits = F.length(text) <= room
        return F.when(state["full"], state).otherwise(
            F.struct(
                F.when(fits, F.array_append(state["parts"], text)).when(room > 3, F.array_append(state["parts"], F.concat(F.substring(text, F.lit(1), (room - 3).cast("int")), F.lit("…")))).otherwise(state["parts"]).alias("parts"),
                F.when(fits, state["used"] + gap + F.length(text)).otherwise(state["used"]).alias("used"),
                (~fits).alias("full"),
            )
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    return visited.select(key, F.array_join(F.aggregate("texts", start, take)["parts"], "\n\n").alias("sample"))


def move_children(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits to a tree: ``nodes`` doc_id, node_id, parent_id, child_idx;
    ``edits`` doc_id, node_id, new_parent_id, new_idx (a place between children
    may be a fraction). Children are numbered anew."""
    edited = nodes.join(edits, ["doc_id", "node_id"], "left").withColumns({"parent_id": F.when(F.col("new_idx").isNull(), F.col("parent_id")).otherwise(F.col("new_parent_id")), "at": F.coalesce("new_idx", F.col("child_idx").cast("double"))})
    order = Window.partitionBy("doc_id", "parent_id").orderBy("at", "node_id")
    return edited.withColumn("child_idx", F.row_number().over(order) - 1).drop("new_parent_id", "new_idx", "at")


def _walk(rows: pa.Table, kept: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole documents, sorted by parent and place, in reading order."""
    docs, ids, above = (rows[c].to_pylist() for c in ("doc_id", "node_id", "parent_id"))
    known = {(d, n): k for k, (d, n) in enumerate(zip(docs, ids, strict=True))}
    below: dict[int, list[int]] = {}
    tops, place = [], [0] * len(ids)
    for k, (d, parent) in enumerate(zip(docs, above, strict=True)):
        if k and docs[k - 1] == d and above[k - 1] == parent:
            place[k] = place[k - 1] + 1
        up = None if parent is None else known.get((d, parent))
        (tops if up is None else below.setdefault(up, [])).append(k)
    seen, pos, document = 0, 0, object()
    order, columns, held = [], ([], [], [], []), 0

    def out() -> pa.RecordBatch:
        columns_ = [rows[c].combine_chunks() for c in kept]
        taken = [c.take(pa.array(order, pa.int64())) for c in columns_]
        fresh = dict(zip(("child_idx", "pos", "depth", "ancestors"), columns, strict=True))
        arrays = [pa.array(fresh[f.name], f.type) if f.name in fresh else taken[kept.index(f.name)].cast(f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for top in tops:
        if docs[top] != document:
            document, pos = docs[top], 0
        stack: list[tuple[int, list[str]]] = [(top, [])]
        while stack:
            k, line = stack.pop()
            order.append(k)
            for values, value in zip(columns, (place[k], pos, len(line), line), strict=True):
                values.append(value)
            pos, seen, held = pos + 1, seen + 1, held + 1 + len(line)
            if k in below:
                inner = [*line, ids[k]]
                stack += [(c, inner) for c in reversed(below[k])]
            if held > 200_000:
                yield out()
                order, columns, held = [], ([], [], [], []), 0
    if seen < len(ids):
        raise ValueError("parents that lead in a circle")
    if order:
        yield out()


def renumber(nodes: DataFrame) -> DataFrame:
    """Nodes in reading order again, after any edits of ``parent_id`` and
    ``child_idx``: adds or replaces ``pos`` (preorder place in the document, from
    0), ``depth`` (0 at the top), ``ancestors`` (ids above, outermost first) and
    ``child_idx`` (0, 1, 2, ... among siblings; ties by id). A node whose parent
    isn't there is a top-level one, behind those of the top by its own place; a
    circle of parents is an error.

    Documents are sorted by parent and place and walked as they pass, each from
    its tops, by one shuffle. Those of more than ``MOST_NODES`` nodes, which a
    task would hold at once, are numbered by pointer doubling instead."""
    placed = saved(nodes.drop("pos", "depth", "ancestors"), "placed")
    sizes = placed.groupBy("doc_id").count().filter(F.col("count") > MOST_NODES).select("doc_id")
    kept = ["doc_id", "node_id", *[c for c in placed.columns if c not in ("doc_id", "node_id")]]
    schema = StructType([*[placed.schema[c] for c in kept if c != "child_idx"], *StructType.fromDDL("child_idx int, pos int, depth int, ancestors array<string>")])
    large = saved(sizes, "large")
    if large.isEmpty():
        return _walked(placed, schema)
    small = _walked(placed.join(large, "doc_id", "left_anti"), schema)
    return small.unionByName(_doubled(placed.join(large, "doc_id", "left_semi")))


def _walked(placed: DataFrame, schema: StructType) -> DataFrame:
    arrow, kept = to_arrow_schema(schema), [f.name for f in schema if f.name in placed.columns and f.name != "child_idx"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of documents that may go on
        for batch in batches:
            docs = batch["doc_id"]
            if not len(batch):
                continue
            ends = pc.fill_null(pc.not_equal(docs.slice(1), docs.slice(0, len(docs) - 1)), True).to_pylist() if len(batch) > 1 else []
            last = max((k + 1 for k, end in enumerate(ends) if end), default=0)
            if last or (held and held[-1]["doc_id"][-1] != docs[0]):
                yield from _walk(pa.Table.from_batches([*held, batch.slice(0, last)]), kept, arrow)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from _walk(pa.Table.from_batches(held), kept, arrow)

    return placed.repartition("doc_id").sortWithinPartitions("doc_id", "parent_id", "child_idx", "node_id").mapInArrow(walk, schema)


def _doubled(nodes: DataFrame) -> DataFrame:
    """As ``renumber``, whatever a document's number of nodes: each node's path
    (the child places from its top to itself) is put together by pointer
    doubling. Every round joins a node with the one its pointer has reached and
    takes over that one's pointer and path, so a tree of d levels needs log2(d)
    rounds. Nodes that have reached the top leave the rounds. Paths in order are
    the preorder, as a path comes before those it begins; one window a document
    numbers them."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("child_idx", "node_id")
    placed = saved(nodes.withColumn("child_idx", (F.row_number().over(siblings) - 1).cast("int")), "placed")
    exists = placed.select("doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("_known"))
    # Lost parents sort behind the true top and among themselves by their id.
    start = placed.join(exists, ["doc_id", "parent_id"], "left").select(
        "doc_id",
        "node_id",
        F.when(F.col("_known"), F.col("parent_id")).alias("up"),
        F.array(F.struct(F.when(F.col("_known").isNull(), F.col("parent_id")).alias("lost"), F.col("child_idx").alias("place"))).alias("path"),
        F.when(F.col("_known"), F.array("parent_id")).otherwise(F.array().cast("array<string>")).alias("ancestors"),
    )
    live, done = saved(start, "paths"), []
    for _ in range(ROUNDS):
        done.append(live.filter("up is null"))
        climbing = live.filter("up is not null")
        if climbing.isEmpty():
            break
        reached = live.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("ancestors").alias("_ancestors"))
        for finished in done[:-1]:
            reached = reached.unionByName(finished.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("ancestors").alias("_ancestors")))
        joined = climbing.join(reached, ["doc_id", "up"])
        live = saved(joined.select("doc_id", "node_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.concat("_ancestors", "ancestors").alias("ancestors")), "paths")
    else:
        raise ValueError("parents that lead in a circle")
    paths = done[0]
    for part in done[1:]:
        paths = paths.unionByName(part)
    order = Window.partitionBy("doc_id").orderBy("path")
    found = paths.select("doc_id", "node_id", (F.row_number().over(order) - 1).cast("int").alias("pos"), (F.size("path") - 1).alias("depth"), "ancestors")
    kept = [c for c in placed.columns if c not in ("pos", "depth", "ancestors")]
    return placed.select(*kept).join(found, ["doc_id", "node_id"])


def delete_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Drop nodes and all below them: ``nodes`` has ``ancestors`` (ids above;
    the own id may be among them); ``roots`` doc_id, node_id."""
    line = F.array_distinct(F.concat("ancestors", F.array("node_id")))
    gone = nodes.select("doc_id", "node_id", F.explode(line).alias("root")).join(roots.select("doc_id", F.col("node_id").alias("root")), ["doc_id", "root"], "left_semi")
    return nodes.join(gone.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")


def merge_with_next(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Join each target node's text with its next sibling's; the sibling's
    children become the target's, behind its own, and so do its ``images``
    (where nodes have such a column); its table is lost."""
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("child_idx")
    marked = nodes.withColumns({"next_id": F.lead("node_id").over(siblings), "next_text": F.lead("text").over(siblings)}).join(targets.withColumn("merge", F.lit(True)), ["doc_id", "node_id"], "left")
    merged = marked.filter("merge and next_id is not null").select("doc_id", F.col("next_id").alias("gone"), F.col("node_id").alias("into"))
    text = F.when(F.col("merge") & F.col("next_id").isNotNull(), F.nullif(F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif("next_text", F.lit(""))), F.lit(""))).otherwise(F.col("text"))
    if "images" in nodes.columns:
        none = F.array().cast(nodes.schema["images"].dataType)
        both = F.concat(F.coalesce("images", none), F.coalesce("next_images", none))
        marked = marked.withColumn("next_images", F.lead("images").over(siblings))
        marked = marked.withColumn("images", F.when(F.col("merge") & F.col("next_id").isNotNull(), both).otherwise(F.col("images"))).drop("next_images")
    kept = marked.withColumn("text", text).join(merged.select("doc_id", F.col("gone").alias("node_id")), ["doc_id", "node_id"], "left_anti")
    moved = kept.join(merged.select("doc_id", F.col("gone").alias("parent_id"), "into"), ["doc_id", "parent_id"], "left")
    order = Window.partitionBy("doc_id", "parent_id").orderBy("was_moved", "child_idx")
    return moved.withColumns({"was_moved": F.col("into").isNotNull(), "parent_id": F.coalesce("into", "parent_id")}).withColumn("child_idx", F.row_number().over(order) - 1).drop("next_id", "next_text", "merge", "into", "was_moved")


def split_node(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cut nodes' texts in two: ``cuts`` doc_id, node_id, split_at. The second
    half is a sibling right behind, without children, trimmed at the cut; its id
    comes of the node's, the cut and its text, so it differs at each split. A
    cut that leaves nothing behind it changes nothing."""
    with_cut = nodes.join(cuts, ["doc_id", "node_id"], "left")
    cut = F.col("split_at")
    behind = F.regexp_replace(F.substring("text", cut + 1, F.length("text")), r"^\s+", "")
    halves = F.when(cut.isNull() | (F.coalesce(behind, F.lit("")) == ""), F.array(F.col("text"))).otherwise(F.array(F.regexp_replace(F.substring("text", F.lit(1), cut), r"\s+$", ""), behind))
    parts = with_cut.select(*[c for c in nodes.columns if c != "text"], "split_at", F.posexplode(halves).alias("half", "text"))
    parts = parts.withColumn("node_id", F.when(F.col("half") == 0, F.col("node_id")).otherwise(F.concat("node_id", F.lit("-"), F.substring(F.sha2(F.concat_ws("\0", "node_id", F.col("split_at").cast("string"), "text"), 256), 1, 8))))
    order = Window.partitionBy("doc_id", "parent_id").orderBy("child_idx", "half")
    return parts.withColumn("child_idx", F.row_number().over(order) - 1).drop("half").select(*nodes.columns)


def titles(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document that has one: the text of its first level-1 heading."""
    first = nodes.filter((F.col("kind") == "heading") & (F.coalesce("level", F.lit(1)) == 1))
    return first.groupBy(key).agg(F.min_by("text", "pos").alias("title"))


def by_id(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per node id: of repeated ids the last in reading order."""
    last = nodes.groupBy(key, "node_id").agg(F.max_by(F.struct(*[c for c in nodes.columns if c not in (key, "node_id")]), "pos").alias("n"))
    return last.select(key, "node_id", "n.*")


def visible(nodes: DataFrame, collapsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes without those below a collapsed one. ``nodes``: ancestors (ids of
    the nodes above, own id not included); ``collapsed``: key, node_id."""
    above = nodes.select(key, "node_id", F.explode("ancestors").alias("above")).join(collapsed.select(key, F.col("node_id").alias("above")), [key, "above"], "left_semi")
    return nodes.join(above.select(key, "node_id").distinct(), [key, "node_id"], "left_anti")


def siblings_of(nodes: DataFrame) -> DataFrame:
    """Adds what can be done to each node: can_move_up, can_move_down,
    can_indent (there is a sibling before it), can_outdent (it has a parent) and
    can_merge (there is one behind it)."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("child_idx")
    before, behind = F.lag("node_id").over(w).isNotNull(), F.lead("node_id").over(w).isNotNull()
    return nodes.withColumns({"can_move_up": before, "can_move_down": behind, "can_indent": before, "can_outdent": F.col("parent_id").isNotNull(), "can_merge": behind})


def update_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """``patches``: doc_id, node_id and any of the nodes' columns; what a patch
    states (null: keep) takes the place of the node's own."""
    fields = [c for c in patches.columns if c not in ("doc_id", "node_id")]
    p = patches.select("doc_id", "node_id", *[F.col(c).alias(f"_{c}") for c in fields])
    return nodes.join(p, ["doc_id", "node_id"], "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in nodes.columns])


def shift_nodes(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """Swap each moved node with its neighbour: ``moves``: doc_id, node_id, dir
    (-1 before, 1 behind). At an end of its siblings a node stays."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("child_idx")
    marked = nodes.join(moves.select("doc_id", "node_id", "dir"), ["doc_id", "node_id"], "left")
    before, behind = F.lag("dir").over(w) == 1, F.lead("dir").over(w) == -1
    first, last = F.row_number().over(w) == 1, F.lead("node_id").over(w).isNull()
    step = F.when((F.col("dir") == -1) & ~first, -1.5).when((F.col("dir") == 1) & ~last, 1.5).otherwise(0.0)
    at = F.row_number().over(w) + F.when(F.coalesce(before | behind, F.lit(False)), 0.0).otherwise(step)
    order = Window.partitionBy("doc_id", "parent_id").orderBy("_at")
    return marked.withColumn("_at", at).withColumn("child_idx", F.row_number().over(order) - 1).select(*nodes.columns)


def indent_nodes(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target (doc_id, node_id) becomes the last child of the sibling
    before it; the first sibling stays."""
    w = Window.partitionBy("doc_id", "parent_id").orderBy("child_idx")
    marked = nodes.withColumn("_before", F.lag("node_id").over(w)).join(targets.select("doc_id", "node_id", F.lit(True).alias("_go")), ["doc_id", "node_id"], "left")
    go = F.col("_go") & F.col("_before").isNotNull()
    moved = marked.withColumns({"parent_id": F.when(go, F.col("_before")).otherwise(F.col("parent_id")), "_late": F.coalesce(go, F.lit(False))})
    order = Window.partitionBy("doc_id", "parent_id").orderBy("_late", "child_idx")
    return moved.withColumn("child_idx", F.row_number().over(order) - 1).select(*nodes.columns)


def outdent_nodes(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target (doc_id, node_id) becomes a sibling of its parent, right
    behind it; a node without a parent stays."""
    above = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_upper"), F.col("child_idx").alias("_place"))
    marked = nodes.join(above, ["doc_id", "parent_id"], "left").join(targets.select("doc_id", "node_id", F.lit(True).alias("_go")), ["doc_id", "node_id"], "left")
    go = F.coalesce(F.col("_go"), F.lit(False)) & F.col("parent_id").isNotNull()
    moved = marked.withColumns({"_at": F.when(go, F.col("_place") + 0.5).otherwise(F.col("child_idx").cast("double")), "parent_id": F.when(go, F.col("_upper")).otherwise(F.col("parent_id"))})
    order = Window.partitionBy("doc_id", "parent_id").orderBy("_at", "child_idx")
    return moved.withColumn("child_idx", F.row_number().over(order) - 1).select(*nodes.columns)
