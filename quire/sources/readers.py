"""Readers: files or text columns to node tables, by format."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import asset_id, decoded, file_format, node_id, normal_path
from quire.sources.blocks import NODE_SCHEMA, PARSERS, node_rows

#: The kind of the node that stands for what can't be read.
ERROR = "error"
COLUMNS = [part.split()[0] for part in NODE_SCHEMA.split(", ")]


def parse_nodes(docs: DataFrame, fmt: str) -> DataFrame:
    """``docs``: doc_id (string), content (string; binary for EPUB). A document
    that its parser can't read is one node of kind ``error``."""
    parser = PARSERS[fmt]

    def parsed(doc_id: str, content: str | bytes) -> list[dict]:
        try:
            return list(node_rows(doc_id, parser(content)))
        except Exception as e:  # whatever is wrong with one file must not end the job
            return list(node_rows(doc_id, iter([{"kind": ERROR, "text": f"{type(e).__name__}: {e}"}])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 64):
                part = pdf.iloc[k : k + 64]
                rows = [r for d, c in zip(part["doc_id"], part["content"], strict=True) if c is not None for r in parsed(d, bytes(c) if fmt == "epub" else c)]
                yield pd.DataFrame(rows, columns=COLUMNS).astype({"level": "Int32"})

    return docs.select("doc_id", "content").mapInPandas(run, NODE_SCHEMA)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, doc_id (stem), format, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", stem.alias("doc_id"), file_format(F.col("path")).alias("format"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of all files. A file without an importer is one node of kind
    ``error``, and so is one that its importer can't read."""
    files = inventory(spark, path)
    others = files.filter(~F.coalesce(F.col("format").isin(*PARSERS), F.lit(False)))
    message = F.concat(F.lit("unsupported file: "), F.element_at(F.split("path", "/"), -1))
    failed = others.select("doc_id", message.alias("text"), F.lit(ERROR).alias("kind"), node_id(F.lit(ERROR), message, F.lit(0)).alias("node_id"), *[F.lit(0).alias(c) for c in ("pos", "depth", "child_idx")])
    out = failed.select(*[F.col(c) if c in failed.columns else F.lit(None).alias(c) for c in COLUMNS]).to(StructType.fromDDL(NODE_SCHEMA))
    for fmt in PARSERS:
        own = files.filter(F.col("format") == fmt)
        text = F.col("content") if fmt == "epub" else decoded(F.col("content"))
        nodes = parse_nodes(own.select("doc_id", text.alias("content")), fmt)
        out = out.unionByName(nodes)
    return out


def stage_assets(blobs: DataFrame) -> DataFrame:
    """One row per different content and type: asset_id, mime, sha256, content."""
    hashed = blobs.select("mime", "content", F.sha2("content", 256).alias("sha256"), asset_id(F.col("content")).alias("asset_id"))
    return hashed.dropDuplicates(["sha256", "mime"])


def resolve_images(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """One row per image of a node: doc_id, node_id, image (its place), src,
    path: the file that it names, null where there is none.

    ``nodes``: doc_id, node_id, images and, if known, base (the path of the file
    that they come from); ``files``: doc_id, path. Sources are decoded, cut at
    ``?`` and ``#`` and taken from the base's folder; remote and inline ones are
    looked up nowhere. Files of the image's own name meet it by an equi join;
    the one at just that path wins, then the one that shares most path parts
    from the end, then the first by path."""
    base = F.regexp_extract(F.coalesce("base", F.lit("")), r"^(.*/)?[^/]*$", 1) if "base" in nodes.columns else F.lit("")
    images = nodes.select("doc_id", "node_id", base.alias("folder"), F.posexplode("images").alias("image", "i")).select("doc_id", "node_id", "image", "folder", F.col("i.src").alias("src"))
    remote = F.coalesce("src", F.lit("")).rlike("(?i)^(https?:|data:|//|$)")
    bare = F.regexp_replace(F.coalesce("src", F.lit("")), "[?#].*$", "")
    plain = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    target = normal_path(F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat("folder", plain)))
    asked = images.withColumn("target", F.when(~remote, target)).withColumn("name", F.nullif(F.element_at(F.split("target", "/"), -1), F.lit("")))
    named = files.select("doc_id", "path", normal_path(F.col("path")).alias("place")).distinct().withColumn("name", F.element_at(F.split("place", "/"), -1))
    ends = F.zip_with(F.reverse(F.split("target", "/")), F.reverse(F.split("place", "/")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.aggregate(ends, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct(F.when(s["on"] & same, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & same).alias("on")))["n"]
    met = asked.join(named, ["doc_id", "name"]).withColumns({"far": F.when(F.col("target") == F.col("place"), 0).otherwise(1), "shared": shared})
    best = met.groupBy("doc_id", "node_id", "image").agg(F.min(F.struct("far", (-F.col("shared")).alias("_"), "path")).alias("best"))
    return asked.select("doc_id", "node_id", "image", "src").join(best.select("doc_id", "node_id", "image", "best.path"), ["doc_id", "node_id", "image"], "left")


def with_assets(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Nodes whose images are those that were resolved, ``src`` being the file's
    path; the others are dropped, as a renderer has nothing to show for them."""
    found = resolved.filter("path is not null").groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("image", "path"))).alias("_paths"))
    places = F.transform("images", lambda i, k: F.struct(i.alias("i"), F.element_at("_paths", k).alias("path")))
    kept = F.transform(F.filter(places, lambda x: x["path"].isNotNull()), lambda x: x["i"].withField("src", x["path"]))
    return nodes.join(found, ["doc_id", "node_id"], "left").withColumn("images", kept).select(*nodes.columns)
