"""Approximate nearest neighbours: one navigable small-world graph per shard.

Equal vectors are one node that keeps the ids which an answer can hold (the
smallest k + 1 of them, as ties go to smaller ids and a query may be one of
them). Nodes are dealt to shards of about ``SHARD`` nodes by a hash of the
vector; each shard is a hierarchical graph over unit vectors, built and kept as
flat neighbour arrays, and written as rows of a table. A query walks the graph
of every shard and the shards' best are merged; scores are cosines of the
original vectors in double precision.

Insertion and search run in numpy over a batch of vectors in step: each step
opens the best unopened nodes of every beam at once. A shard goes to one task,
once, and its queries stream past it in blocks of ``BLOCK``, so a task holds one
shard and one block, and what travels is each query once for every shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions, small_batches

SHARD, BLOCK = 8192, 1024
LINKS, BEAM_BUILD, BEAM, OPENED = 16, 64, 96, 4
#: Salts that keep copies of one vector apart until each part is cut to k + 1.
SALTS = 16


@dataclass
class Graph:
    """Level 0 has 2 * LINKS neighbours a node, the levels above LINKS; unused
    places hold -1. ``levels``: for each level its nodes and their neighbours."""

    vectors: np.ndarray  # unit length, float32
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0) -> "Graph":
        n = len(vectors)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        height[:1] = max(height.max(initial=0), 0)
        levels = []
        for level in range(height.max(initial=0), -1, -1):
            nodes = np.flatnonzero(height >= level)
            most = 2 * LINKS if level == 0 else LINKS
            links = np.full((len(nodes), most), -1, np.int32)
            graph = cls(vectors, [*levels, (nodes, links)])
            # In random order, the inserted part doubles until batches are full.
            order = np.random.default_rng(seed + level + 1).permutation(len(nodes))
            done = 0
            while done < len(nodes):
                batch = order[done : done + min(512, max(64, done))]
                graph._insert(batch, order[:done], most)
                done += len(batch)
            levels = graph.levels
        return cls(vectors, levels)

    def _insert(self, batch: np.ndarray, before: np.ndarray, most: int) -> None:
        nodes, links = self.levels[-1]
        v = self.vectors[nodes]
        found = [np.argsort(-(s := v[batch] @ v[batch].T - 4 * np.eye(len(batch), dtype=np.float32)), 1)[:, :most]]
        close = batch[found[0]].astype(np.int32)
        scores = np.take_along_axis(s, found[0], 1)
        if len(before):
            start = self._descend(v[batch], len(self.levels) - 1, before)
            c, sc = self._beam(v[batch], len(self.levels) - 1, start, BEAM_BUILD)
            close, scores = np.concatenate((close, c), 1), np.concatenate((scores, sc), 1)
        close = np.where(scores > -2, close, -1)
        best = np.argsort(-scores, 1, kind="stable")
        close, scores = np.take_along_axis(close, best, 1), np.take_along_axis(scores, best, 1)
        for node, c, sc in zip(batch.tolist(), close, scores, strict=True):
            keep = self._diverse(v, c[c >= 0], sc[c >= 0], most // 2 if most > LINKS else most)
            links[node, : len(keep)] = keep
            for other in keep.tolist():
                row = links[other]
                if node in row:
                    continue
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    every = np.append(row, node)
                    s = v[every] @ v[other]
                    o = np.argsort(-s, kind="stable")
                    keep2 = self._diverse(v, every[o], s[o], most)
                    row[:] = -1
                    row[: len(keep2)] = keep2

    @staticmethod
    def _diverse(v: np.ndarray, near: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Of neighbours, nearest first: those nearer to the node than to any
        one kept, filled up with the nearest of the rest."""
        if len(near) <= most:
            return near
        near, scores = near[: 3 * most], scores[: 3 * most]
        each = v[near] @ v[near].T
        keep: list[int] = []
        for i in range(len(near)):
            if len(keep) == most:
                break
            if not keep or each[i, keep].max() < scores[i]:
                keep.append(i)
        if len(keep) < most:
            have = set(keep)
            keep += [i for i in range(len(near)) if i not in have][: most - len(keep)]
        return near[keep]

    def _descend(self, q: np.ndarray, level: int, known: np.ndarray | None = None) -> np.ndarray:
        """Where each query enters a level (places in that level's nodes)."""
        here = None
        for k in range(level):
            nodes, _ = self.levels[k]
            at = np.zeros(len(q), np.int64) if here is None else np.searchsorted(nodes, here)
            c, _ = self._beam(q, k, at[:, None], 1)
            here = nodes[c[:, 0]]
        if here is None:
            return np.full((len(q), 1), known[0] if known is not None else 0)
        at = np.searchsorted(self.levels[level][0], here)[:, None]
        if known is not None:  # the entry may not be linked yet: enter at a known node too
            at = np.concatenate((at, np.full((len(q), 1), known[0])), 1)
        return at

    def _beam(self, q: np.ndarray, level: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes (places) found nearest to each query, and their scores."""
        nodes, links = self.levels[level]
        v = self.vectors[nodes]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(nodes)), bool)
        if start.shape[1] > 1:
            start = np.sort(start, 1)
        place = np.full((len(q), beam + 0), -1, np.int64)
        score = np.full((len(q), beam), -4.0, np.float32)
        opened = np.ones((len(q), beam), bool)
        k = min(start.shape[1], beam)
        place[:, :k] = start[:, :k]
        score[:, :k] = np.einsum("qd,qkd->qk", q, v[start[:, :k]])
        opened[:, :k] = False
        if k > 1:
            twice = np.zeros((len(q), k), bool)
            twice[:, 1:] = start[:, 1:k] == start[:, : k - 1]
            score[:, :k][twice], opened[:, :k][twice] = -4.0, True
        seen[rows, start[:, :k]] = True
        wide = min(OPENED, beam)
        while True:
            todo = np.where(opened, -5.0, score)
            pick = np.argpartition(-todo, wide - 1, 1)[:, :wide] if wide < beam else np.argsort(-todo, 1)
            ready = np.take_along_axis(todo, pick, 1) > -4.0
            live = np.flatnonzero(ready.any(1))
            if not len(live):
                return place, score
            opened[rows, pick] = True
            at = np.where(ready[live], np.take_along_axis(place[live], pick[live], 1), 0)
            out = np.where(ready[live][:, :, None], links[at], -1).reshape(len(live), -1)
            out = np.sort(out, 1)
            new = out >= 0
            new[:, 1:] &= out[:, 1:] != out[:, :-1]
            new &= ~seen[live[:, None], np.where(new, out, 0)]
            r, c = np.nonzero(new)
            if not len(r):
                continue
            got = out[r, c]
            seen[live[r], got] = True
            s = np.full(out.shape, -4.0, np.float32)
            s[r, c] = np.einsum("id,id->i", q[live[r]], v[got])
            every = np.concatenate((score[live], s), 1)
            best = np.argpartition(-every, beam - 1, 1)[:, :beam]
            place[live] = np.take_along_axis(np.concatenate((place[live], out), 1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate((opened[live], s <= -4.0), 1), best, 1)
            score[live] = np.take_along_axis(every, best, 1)

    def search(self, q: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
        """The k nodes found nearest to each query (-1: fewer found)."""
        last = len(self.levels) - 1
        place, score = self._beam(q, last, self._descend(q, last), max(beam, k))
        best = np.argsort(-score, 1, kind="stable")[:, :k]
        return np.where(np.take_along_axis(score, best, 1) > -4.0, np.take_along_axis(place, best, 1), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>), dim, of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .filter(finite & F.exists("v", lambda x: x != 0))
        .select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), F.size("v").alias("dim"))
    )


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component into
    [0.5, 1), so that squares neither overflow nor vanish; cosines stay."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def beam_of(dim: int) -> int:
    """Nodes that a search keeps: more in more dimensions, where neighbours are
    harder to tell apart."""
    return max(BEAM, 3 * dim // 2)


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """One row per shard: dim, shard, ids (of each node), vectors, levels."""
    h = F.xxhash64("v")
    keyed = rows.select("id", "v", "dim", h.alias("h"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    for keys in (["h", "v", "salt"], ["h", "v"]):
        keyed = keyed.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= k + 1)
    # At most k + 1 ids a vector are left.
    nodes = materialize(keyed.groupBy("h", "v").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("shards"))
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod("h", "shards").cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")
        v = np.stack(pdf["v"].to_numpy())
        graph = Graph.build(unit(v))
        flat = [x for nodes, links in graph.levels for x in (nodes.astype(np.int32).tobytes(), links.tobytes())]
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "shard": pdf["shard"].iloc[:1].to_numpy(), "ids": [pdf["ids"].tolist()], "vectors": [v.tobytes()], "levels": [flat]})

    # A number of partitions that is given stays: shards are few bytes and much work.
    dealt = placed.select("dim", "shard", "h", "v", "ids").repartition(shuffle_partitions(rows.sparkSession), "dim", "shard")
    index = dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids array<array<bigint>>, vectors binary, levels array<binary>")
    return materialize(index, "vector-index")


def unpack(dim: int, vectors: bytes, flat: list[bytes]) -> tuple[np.ndarray, Graph]:
    v, levels = np.frombuffer(vectors, np.float64).reshape(-1, dim), []
    for k in range(0, len(flat), 2):
        nodes = np.frombuffer(flat[k], np.int32).astype(np.int64)
        levels.append((nodes, np.frombuffer(flat[k + 1], np.int32).reshape(len(nodes), -1)))
    return scaled(v), Graph(unit(v), levels)


def nearest(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; candidates all
    rows but the query's own. query_id, rank (from 1), the id and the score of
    the k nearest found, ties to the smaller id.

    Ids are integers: others are cast to long, and what is no number is an error
    where ANSI mode is on, else takes no part. Vectors that are null, empty, zero
    or hold null or non-finite components take no part; huge and tiny components
    are scaled before they are squared. Vectors of another length than the
    query's are no candidates. Rows that repeat an id take part each, but for a
    query of the same id. An empty table gives an empty result; other columns
    are not read."""
    rows = usable(vectors, id_col, vec_col)
    index = build_index(rows, k)
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asks = rows.filter(F.col("id") % every == 0)
    sent = asks.join(shards, "dim").select("dim", F.explode(F.sequence(F.lit(0), "last")).alias("shard"), "id", "v")
    graphs = index.withColumns({"id": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>"), "asks": F.lit(False)})
    queries = sent.withColumns({c: F.lit(None).cast(index.schema[c].dataType) for c in ("ids", "vectors", "levels")} | {"asks": F.lit(True)})
    # A shard's graph comes first in its partition; its queries stream past it.
    parts = shuffle_partitions(vectors.sparkSession)
    dealt = graphs.unionByName(queries).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "asks").select("dim", "ids", "vectors", "levels", "id", "v", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = graph = ids = None

        def answers(part: pa.RecordBatch) -> pa.RecordBatch:
            names, flat = part["id"].to_pylist(), part["v"].flatten().to_numpy()
            q, out = flat.reshape(len(names), -1), []
            found = graph.search(unit(q), min(4 * k, len(v)), beam_of(q.shape[1]))
            for name, x, near in zip(names, scaled(q), found, strict=True):
                near = near[near >= 0]
                scores = (v[near] @ x) / (norm[near] * np.linalg.norm(x))
                each = sorted((-s, i) for s, p in zip(scores.tolist(), near.tolist(), strict=True) for i in ids[p] if i != name)
                out += [(name, i, -s) for s, i in each[:k]]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

        for batch in batches:
            asked = batch["asks"].to_numpy(zero_copy_only=False)
            for start, end in _runs(asked):
                if asked[start]:
                    for at in range(start, end, BLOCK):
                        yield answers(batch.slice(at, min(BLOCK, end - at)))
                else:  # of graphs in a row the last one is asked
                    row = end - 1
                    ids = batch["ids"][row].as_py()
                    v, graph = unpack(batch["dim"][row].as_py(), batch["vectors"][row].as_py(), batch["levels"][row].as_py())
                    norm = np.linalg.norm(v, axis=1)

    small_batches(vectors.sparkSession)
    found = dealt.mapInArrow(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal flags start and end."""
    cuts = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
    yield from zip(cuts, cuts[1:]) if len(flags) else ()
