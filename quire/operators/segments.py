"""Segments: sentence packing, building, reconciling, applying translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import MAX_SEGMENT_CHARS, PROTECTED_KINDS, is_blank, segment_id, sentences
from quire.operators import tables

#: Behind the node id of a table, for its caption.
CAPTION = ":caption"
#: Columns of nodes that hold units besides the text.
SLOTTED = {"cells", "images"}


def pack_sentences(text: Column, limit: int = MAX_SEGMENT_CHARS) -> Column:
    """Chunks of whole sentences, joined by one space, of at most ``limit``
    characters; a longer sentence is a chunk of its own. A text within the
    limit is one chunk, unchanged."""

    def add(done: Column, sentence: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(last, F.lit(" "), sentence)
        return (
            F.when(F.size(done) == 0, F.array(sentence))
            .when(F.length(joined) <= limit, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined))
            .otherwise(F.array_append(done, sentence))
        )

    packed = F.aggregate(sentences(text), F.array().cast("array<string>"), add)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def _slots(nodes: DataFrame) -> Column:
    """A node's units in order, as structs of unit (its id) and text: pipe rows
    of a table's ``cells``, the text, then caption and alternative text of each
    image. A caption that is the node's own text is not a unit twice."""
    slots = [F.array(F.struct(F.col("node_id").alias("unit"), F.col("text").alias("text")))]
    if "cells" in nodes.columns:
        grid = (F.col("kind") == "table") & F.exists(F.flatten("cells"), lambda c: ~is_blank(c["text"]))
        rows = tables.to_markdown(F.transform("cells", lambda row: F.transform(row, lambda c: c["text"])))
        both = F.array(F.struct(F.col("node_id").alias("unit"), rows.alias("text")), F.struct(F.concat("node_id", F.lit(CAPTION)).alias("unit"), F.col("text").alias("text")))
        slots = [F.when(grid, both).otherwise(slots[0])]
    if "images" in nodes.columns:
        images = F.coalesce("images", F.array().cast(nodes.schema["images"].dataType))

        def units(image: Column, k: Column) -> Column:
            own = F.when(~image["caption"].eqNullSafe(F.col("text")), image["caption"])
            return F.array(F.struct(image_unit("caption", k).alias("unit"), own.alias("text")), F.struct(image_unit("alt", k).alias("unit"), image["alt"].alias("text")))

        slots.append(F.flatten(F.transform(images, units)))
    return F.concat(*slots)


def image_unit(field: str, place: Column) -> Column:
    """The id of an image's caption or alternative text: the node's, the field
    and the place among the node's images."""
    return F.concat(F.col("node_id"), F.lit(f":{field}:"), place.cast("string"))


def build_segments(nodes: DataFrame, limit: int = MAX_SEGMENT_CHARS) -> DataFrame:
    """``nodes``: doc_id, pos, node_id, kind, text, heading_path. One row per
    translation unit: protected kinds and blank texts have none; long texts
    have several parts; ``ordinal`` counts through the document. A table with
    ``cells`` is a unit of pipe rows, and its text, the caption, one behind it.
    Captions and alternative texts of ``images`` are units of kind figure behind
    their node's text, of a protected kind's images too."""
    protected = F.col("kind").isin(*PROTECTED_KINDS)
    if not SLOTTED & set(nodes.columns):
        units = nodes.filter(~protected & ~is_blank(F.col("text"))).withColumn("_slot", F.lit(0))
        return _numbered(units, limit)
    slots = nodes.withColumn("_owner", F.col("node_id")).select("doc_id", "pos", "kind", "heading_path", "_owner", F.posexplode(_slots(nodes)).alias("_slot", "_unit"))
    own = F.col("_unit.unit").isin(F.col("_owner"), F.concat("_owner", F.lit(CAPTION)))
    units = slots.filter(~(own & protected) & ~is_blank(F.col("_unit.text"))).select("doc_id", "pos", "_slot", F.col("_unit.unit").alias("node_id"), F.when(own, F.col("kind")).otherwise("figure").alias("kind"), "heading_path", F.col("_unit.text").alias("text"))
    return _numbered(units, limit)


def _numbered(units: DataFrame, limit: int) -> DataFrame:
    """Units cut into parts and numbered through their document."""
    parts = units.select("doc_id", "pos", "_slot", "node_id", "kind", "heading_path", F.posexplode(pack_sentences(F.col("text"), limit)).alias("part", "source_text"))
    order = Window.partitionBy("doc_id").orderBy("pos", "_slot", "part")
    return parts.withColumns(
        {
            "ordinal": F.row_number().over(order) - 1,
            "parts": F.count(F.lit(1)).over(Window.partitionBy("doc_id", "node_id", "pos")),
            "id": segment_id(F.col("node_id"), F.col("source_text"), F.col("part")),
        }
    ).drop("_slot")


def reconcile(desired: DataFrame, stored: DataFrame) -> DataFrame:
    """Full outer join on (doc_id, id): each segment added, kept or removed. Ids
    are content addresses, so kept segments keep their work."""
    d = desired.select("doc_id", "id", F.col("ordinal").alias("new_ordinal"))
    s = stored.select("doc_id", "id", F.col("ordinal").alias("old_ordinal"))
    both = d.join(s, ["doc_id", "id"], "full_outer")
    change = F.when(F.col("old_ordinal").isNull(), "added").when(F.col("new_ordinal").isNull(), "removed").otherwise("kept")
    return both.withColumn("change", change)


def resegment(nodes: DataFrame, stored: DataFrame, limit: int = MAX_SEGMENT_CHARS) -> DataFrame:
    """The stored segments after their tree was edited and written again, cut at
    the ``limit`` that they were built with.

    ``nodes``: the edited tree, numbered (``tree.renumber``), with heading
    paths; ``stored``: segments as rows of doc_id, id, ordinal, status and
    whatever they have come to. A kept segment keeps all of that and takes the
    place, kind and heading path that it has now; a new one is pending, its
    other columns null; segments whose text is gone are dropped. Documents that
    ``nodes`` doesn't hold stay as they are."""
    fresh = build_segments(nodes, limit)
    placed = [c for c in ("node_id", "pos", "kind", "heading_path", "part", "parts", "ordinal", "source_text") if c in stored.columns]
    new = fresh.select("doc_id", "id", *[F.col(c).cast(stored.schema[c].dataType).alias(f"_{c}") for c in placed], F.lit(True).alias("_there")).dropDuplicates(["doc_id", "id"])
    old = stored.withColumn("_known", F.lit(True))
    both = new.join(old, ["doc_id", "id"], "full_outer")
    edited = nodes.select("doc_id", F.lit(True).alias("_edited")).distinct()
    both = both.join(edited, "doc_id", "left").filter(F.col("_there") | F.col("_edited").isNull())
    values = {c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in placed}
    values["status"] = F.when(F.col("_known"), F.col("status")).otherwise("pending")
    return both.withColumns(values).select(*stored.columns)


def apply_translations(nodes: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Nodes with translated text: the parts of a node in order, each translated
    or else as it was; a node without any translation is unchanged.
    Pipe rows of a table go back to its cells by row and column, captions and
    alternative texts to their images by place.
    ``translations``: doc_id, id, target_text."""
    done = translations.filter(F.coalesce("target_text", F.lit("")) != "")
    parts = segments.join(done, ["doc_id", "id"], "left")
    merged = parts.groupBy("doc_id", "pos", "node_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("target_text", "source_text").alias("text")))), lambda x: x["text"]), " ").alias("merged"),
        F.max(F.col("target_text").isNotNull()).alias("any"),
    )
    if not SLOTTED & set(nodes.columns):
        own = merged.filter("any").drop("any")
        return nodes.join(own, ["doc_id", "pos", "node_id"], "left").withColumn("text", F.coalesce("merged", "text")).select(*nodes.columns)
    # Units of a node meet it at its place, by one join for all its slots.
    units = merged.filter("any").groupBy("doc_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "merged"))).alias("_units"))
    # The text as it was has a name of its own: a column list that replaces
    # ``text`` would give lambdas of the same list the new one.
    done = nodes.join(units, ["doc_id", "pos"], "left").withColumn("_text", F.col("text"))

    def put(unit: Column, value: Column) -> Column:
        return F.coalesce(F.element_at("_units", unit), value)

    own, values = F.col("node_id"), {}
    values["text"] = put(own, F.col("_text"))
    if "cells" in nodes.columns:
        grid = F.coalesce((F.col("kind") == "table") & F.exists(F.flatten("cells"), lambda c: ~is_blank(c["text"])), F.lit(False))
        values["text"] = F.when(grid, put(F.concat(own, F.lit(CAPTION)), F.col("_text"))).otherwise(values["text"])
        texts = tables.onto_template(tables.from_markdown(F.element_at("_units", own)), F.transform("cells", lambda row: F.transform(row, lambda c: c["text"])))
        cells = F.zip_with("cells", texts, lambda row, new: F.zip_with(row, new, lambda c, x: c.withField("text", x)))
        values["cells"] = F.when(grid & F.element_at("_units", own).isNotNull(), cells).otherwise(F.col("cells"))
    if "images" in nodes.columns:

        def translated(image: Column, k: Column) -> Column:
            caption = F.when(image["caption"].eqNullSafe(F.col("_text")), values["text"]).otherwise(put(image_unit("caption", k), image["caption"]))
            return image.withField("caption", caption).withField("alt", put(image_unit("alt", k), image["alt"]))

        values["images"] = F.transform("images", translated)
    return done.withColumns(values).select(*nodes.columns)
