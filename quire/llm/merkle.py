"""Merkle manifest of a dataset: leaves of rows, a tree for each group, one root.

A leaf's place in its group is written in digits of base ``FANOUT``. Within
blocks of ``FANOUT ** DIGITS`` leaves the digits are grouped away one after the
other, lowest first: each step puts up to ``FANOUT`` child structs into their
parent's struct beside its digest, so a block ends as one nested row. Blocks are
the leaves of the next tier, until a group is one block. Then paths go down
again: a block's row, with the siblings above it, is exploded level by level,
each child taking the digests to its left and right along, until leaves come out
with their proofs.

No step joins on the way up or down: the rows of one partitioning by group and
block are grouped again and again, and a block meets the path above it in a
union that is grouped by block. A row holds one block at most, whatever the size
of a group, so a group with a third of all rows is as many rows as it has blocks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, materialize
from quire.llm.ranks import ranked

FANOUT, DIGITS = 16, 3
BLOCK = FANOUT**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every TAMPERED-th document, by crc32 of its id, gets its text changed.
TAMPERED = 5
STEP = "struct<left:string,right:string>"


def written(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """tree (the group), id, leaf, and forged: the leaf after tampering, where
    that is another one."""
    lowered = F.translate(F.col(f"`{text_col}`"), string.ascii_uppercase, string.ascii_lowercase)
    hit = F.col(f"`{id_col}`").isNotNull() & (fold(F.col(f"`{id_col}`"), TAMPERED) == 0) & F.col(f"`{text_col}`").rlike("[A-Z]")
    own = digest([written(F.col(f"`{f}`")) for f in fields])
    other = digest([written(lowered if f == text_col else F.col(f"`{f}`")) for f in fields])
    return docs.select(F.col(f"`{group_col}`").alias("tree"), F.col(f"`{id_col}`").alias("id"), own.alias("leaf"), F.when(hit, other).alias("forged"))


def nest(rows: DataFrame) -> DataFrame:
    """``rows``: tree, n (nodes of the tree), at, node (struct of hash and item).
    tree, n, block, node: each block's nodes nested DIGITS deep.

    A level of one node is its tree's top: it passes upwards as it is."""
    keys = ["tree", "n", "block"]
    digits = [F.pmod(F.floor(F.col("at") / FANOUT**k), F.lit(FANOUT)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    rows = rows.select("tree", "n", F.floor(F.col("at") / BLOCK).alias("block"), *digits, "node").repartition("tree", "block")
    for k in range(DIGITS):
        higher = [f"d{j}" for j in range(DIGITS - 1, k, -1)]
        sorted_kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "node")))
        rows = rows.groupBy(*keys, *higher).agg(F.transform(sorted_kids, lambda x: x["node"]).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        top = F.when(F.col("n") > FANOUT**k, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["hash"])
        rows = rows.select(*keys, *higher, F.struct(top.alias("hash"), "kids").alias("node"))
    return rows


def tiers(rows: DataFrame, label: str) -> list[DataFrame]:
    """The blocks of every tier, lowest first; the last has one block a tree.
    ``rows`` as for ``nest``. There are log(n) / log(BLOCK) tiers."""
    most = rows.agg(F.max("n")).first()[0] or 0
    out = []
    while True:
        out.append(materialize(nest(rows), label))
        if most <= BLOCK:
            return out
        most = -(-most // BLOCK)
        above = F.ceil(F.col("n") / BLOCK)
        rows = out[-1].select("tree", above.alias("n"), F.col("block").alias("at"), F.struct(F.col("node.hash").alias("hash"), F.lit(None).cast("int").alias("item")).alias("node"))


def unfold(blocks: DataFrame, known: list[str]) -> DataFrame:
    """``blocks``: tree, n, block, node, path, and the columns ``known``. One row
    per lowest node: tree, at, hash, item, path (its own level first), known."""
    rows = blocks.withColumn("at", F.col("block"))
    for k in reversed(range(DIGITS)):
        kids = F.col("node.kids")

        def side(start: Column | int, size: Column | int) -> Column:
            return F.array_join(F.transform(F.slice(kids, start, size), lambda x: x["hash"]), "")

        child = F.transform(kids, lambda kid, i: F.struct(kid.alias("node"), i.alias("d"), F.struct(side(1, i).alias("left"), side(i + 2, FANOUT).alias("right")).alias("step")))
        rows = rows.select("tree", "n", "at", "path", *known, F.explode(child).alias("c"))
        path = F.when(F.col("n") > FANOUT**k, F.concat(F.array("c.step"), "path")).otherwise(F.col("path"))
        rows = rows.select("tree", "n", (F.col("at") * FANOUT + F.col("c.d")).alias("at"), path.alias("path"), *known, F.col("c.node").alias("node"))
    return rows.select("tree", "at", "path", *known, "node.hash", "node.item")


def meet(blocks: DataFrame, above: DataFrame, known: list[str]) -> DataFrame:
    """Blocks with the path above each. ``above``: tree, block, path, known."""
    lower, upper = F.struct("n", "node"), F.struct("path", *known)
    low = blocks.select("tree", "block", lower.alias("low"))
    up = above.select("tree", "block", upper.alias("up"))
    both = low.withColumn("up", F.lit(None).cast(up.schema["up"].dataType)).unionByName(up.withColumn("low", F.lit(None).cast(low.schema["low"].dataType)))
    met = both.groupBy("tree", "block").agg(F.first("low", True).alias("low"), F.first("up", True).alias("up"))
    return met.select("tree", "block", "low.*", "up.*")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: its id, leaf, subroot (of its group), root,
    proof_sha256, folded_root and verified.

    A leaf is the digest of the fields, each ``-`` if null, else its length in
    bytes and itself; an empty text is ``0:``. Within a group leaves go by id,
    null ids first and ties by leaf; of rows that are equal in all fields each
    has a leaf and a proof of its own. A null group is a group, the first one;
    groups go by the bytes of their names. proof_sha256 is the digest of all
    siblings from the leaf's level to the root, left to right. folded_root is
    what the leaf, tampered with or not, and the original siblings lead to.
    Very long texts are hashed whole, in one row. An empty table gives an empty
    result. Columns other than the fields, of any name, are not read."""
    level = materialize(leaves(docs, fields, id_col, group_col, text_col), "merkle-leaves")
    placed = ranked(level, ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf")], "merkle-order")
    node = F.struct(F.col("leaf").alias("hash"), F.struct("id", "forged").alias("item"))
    low = tiers(placed.select("tree", "n", "at", node.alias("node")), "merkle-blocks")

    subroots = low[-1].select(F.col("tree").alias("group"), F.col("node.hash").alias("hash"))
    placed = ranked(subroots, [], [F.col("group").asc_nulls_first()], "merkle-groups")
    node = F.struct("hash", F.struct("group").alias("item"))
    high = tiers(placed.select(F.lit(0).alias("tree"), "n", "at", node.alias("node")), "merkle-groups")

    no_steps = F.array().cast(f"array<{STEP}>")
    paths = unfold(high[-1].select("tree", "n", "block", "node", no_steps.alias("path"), F.col("node.hash").alias("root")), ["root"])
    for blocks in reversed(high[:-1]):
        paths = unfold(meet(blocks, paths.withColumnRenamed("at", "block"), ["root"]), ["root"])
    paths = paths.select(F.col("item.group").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("hash").alias("subroot"), "root")
    for blocks in reversed(low):
        known = ["subroot", "root"]
        paths = unfold(meet(blocks, paths.withColumnRenamed("at", "block"), known), known)

    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    start = F.coalesce("item.forged", "hash")
    folded = F.aggregate("path", start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))
    out = paths.select(F.col("item.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
