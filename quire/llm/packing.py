"""Packing documents into windows by non-negative least squares.

A document longer than a window fills whole windows first; what is left over,
1 to window-1 tokens, is a remainder. Remainders are counted in ``BUCKETS``
buckets of equal width. The shallow combinations, multisets of at most
``PARTS`` buckets whose middles fill a window, are the columns of a matrix A of
small whole numbers, and the histogram h of the remainders is the right-hand
side: min |A x - h|, x >= 0, by the active-set method, says how often each
combination is used. At most as many counts as there are buckets are above 0,
so they are large; they are rounded and carried out on the remainders as long
as these last. A window that comes out a little too full hands the tail of its
last remainder on, and one a little too empty takes such tails; what is still
left is packed greedily, the largest piece that fits first, and a piece is cut
only where none fits the gap. The last, unfilled window of a chunk is cut at
powers of two, which need no padding.

A task packs its partition in chunks of about ``CHUNK_IDS`` ids: nothing is
shuffled, memory is bounded, and partitions do not wait for each other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches
from quire.llm.tokens import END_ID, default_vocabulary, encode_documents

WINDOW = 2048
CHUNK_IDS = 1 << 21
#: Buckets of remainder lengths, and most parts of a combination.
BUCKETS, PARTS = 64, 4
#: ``placed``: whole windows of one document, by the solved counts, greedily.
WHOLE, SOLVED, GREEDY = "whole", "solved", "greedy"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long, placed string"


@lru_cache(maxsize=4)
def combinations(buckets: int, parts: int) -> np.ndarray:
    """Rows of ``parts`` bucket numbers from 1, falling, 0 behind the last. Bucket
    b holds lengths in (b-1, b] of the window's ``buckets`` shares, so k parts
    with middles that fill it have numbers that sum to ``buckets + k / 2``, for
    odd k to one of the two whole numbers beside it."""
    found: list[list[int]] = []

    def extend(row: list[int], left: int, most: int, room: int) -> None:
        if not room:
            if not left:
                found.append(row + [0] * (parts - len(row)))
            return
        for b in range(min(most, left - (room - 1)), -(-left // room) - 1, -1):
            extend([*row, b], left - b, b, room - 1)

    for k in range(1, parts + 1):
        for total in sorted({buckets + k // 2, buckets + (k + 1) // 2}):
            extend([], total, buckets, k)
    return np.array(found, np.int64).reshape(-1, parts)


@lru_cache(maxsize=4)
def combination_matrix(buckets: int, parts: int) -> np.ndarray:
    """Buckets x combinations: how often each combination has each bucket."""
    combos = combinations(buckets, parts)
    a = np.zeros((buckets + 1, len(combos)))
    for k in range(parts):
        np.add.at(a, (combos[:, k], np.arange(len(combos))), 1.0)
    return a[1:]


def solve_counts(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Non-negative least squares, min |a x - h|, by the active-set method: the
    column that would lower the error most joins the positive ones, whose
    unconstrained solution is taken as far as none of them turns negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(6 * len(h)):
        w = a.T @ (h - a @ x)
        w[active] = -np.inf
        best = int(w.argmax()) if len(w) else 0
        if not len(w) or w[best] <= least:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], h, rcond=None)[0]
            low = s <= 1e-12
            if not low.any():
                x[at] = s
                break
            now = x[at]
            share = now[low] / np.maximum(now[low] - s[low], 1e-300)
            x[at] = now + share.min() * (s - now)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0.0
            if not active.any():
                break
    return x


class _Pool:
    """Pieces by length, for the largest that fits a gap."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.stock: dict[int, list[tuple[int, int]]] = {}

    def put(self, d: int, start: int, n: int) -> None:
        if not self.stock.get(n):
            self.sizes.insert(bisect_right(self.sizes, n), n)
        self.stock.setdefault(n, []).append((d, start))

    def take(self, gap: int) -> tuple[int, int, int]:
        """The largest piece of at most ``gap``, else the smallest, cut."""
        k = max(bisect_right(self.sizes, gap) - 1, 0)
        n = self.sizes[k]
        d, start = self.stock[n].pop()
        if not self.stock[n]:
            self.sizes.pop(k)
        use = min(n, gap)
        if use < n:
            self.put(d, start + use, n - use)
        return d, start, use


Sequence = tuple[list[tuple[int, int, int]], str]


def pack(lengths: np.ndarray, window: int = WINDOW, buckets: int = BUCKETS, parts: int = PARTS) -> list[Sequence]:
    """Sequences of pieces (document, start, length), and how each was placed;
    each token lies in one piece."""
    sequences: list[Sequence] = []
    buckets = min(buckets, window)
    stock: list[list[tuple[int, int, int]]] = [[] for _ in range(buckets + 1)]
    for d, n in enumerate(lengths.tolist()):
        whole = n // window
        sequences += [([(d, k * window, window)], WHOLE) for k in range(whole)]
        if rest := n - whole * window:
            stock[-(-rest * buckets // window)].append((rest, d, whole * window))
    for held in stock:
        held.sort(key=lambda r: r[0])  # stable: ties stay in the order of the documents

    combos = combinations(buckets, parts)
    counts = solve_counts(combination_matrix(buckets, parts), np.array([len(held) for held in stock[1:]], float))
    pool, short = _Pool(), []
    for k in np.argsort(-counts, kind="stable").tolist():
        chosen = [b for b in combos[k].tolist() if b]
        for _ in range(int(counts[k] + 0.5)):  # rounded, as long as the lengths last
            if any(len(stock[b]) < chosen.count(b) for b in chosen):
                break
            now, gap = [], window
            for b in chosen:
                n, d, start = stock[b].pop()
                use = min(n, gap)
                if use:
                    now.append((d, start, use))
                if use < n:
                    pool.put(d, start + use, n - use)
                gap -= use
            if gap:
                short.append((now, gap))
            else:
                sequences.append((now, SOLVED))
    for held in stock:
        for n, d, start in held:
            pool.put(d, start, n)

    short.sort(key=lambda s: -s[1])
    while short:
        now, gap = short.pop()  # the smallest gaps first
        while gap and pool.sizes:
            now.append(pool.take(gap))
            gap -= now[-1][2]
        if gap:  # nothing is left: the fewest full windows come of what is not full
            for d, start, n in now:
                pool.put(d, start, n)
            if not short:
                break
        else:
            sequences.append((now, SOLVED))

    now, gap = [], window
    while pool.sizes:
        now.append(pool.take(gap))
        gap -= now[-1][2]
        if not gap:
            sequences.append((now, GREEDY))
            now, gap = [], window
    return sequences + [(cut, GREEDY) for cut in cut_at_powers(now)]


def cut_at_powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """An unfilled window as sequences whose lengths are powers of two."""
    out, left = [], sum(p[2] for p in pieces)
    queue = pieces[::-1]
    while left:
        room, now = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            d, start, n = queue.pop()
            use = min(n, room)
            now.append((d, start, use))
            room -= use
            if use < n:
                queue.append((d, start + use, n - use))
        out.append(now)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece (``PIECES``). Null and empty texts are the end id
    alone. Rows with null or repeated ids are packed as documents of their own.
    An empty table gives no piece. Very long texts are cut at every window. Ids
    must be numbers, or texts of whole numbers. Only the id and text columns are
    read."""
    vocabulary = vocabulary or default_vocabulary()

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        names: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            sequences = pack(np.array([len(p) for p in parts]), window)
            flat = np.array([(s, *p) for s, (seq, _) in enumerate(sequences) for p in seq], dtype=np.int64)
            s, d, start, n = flat.T
            ends = np.cumsum(n)
            opens = np.r_[True, s[1:] != s[:-1]]
            offset = ends - n - np.maximum.accumulate(np.where(opens, ends - n, 0))
            total = np.bincount(s, weights=n).astype(np.int64)[s]
            crc = [zlib.crc32(parts[i][a : a + m].tobytes()) for i, a, m in zip(d.tolist(), start.tolist(), n.tolist(), strict=True)]
            out = {"doc_id": pa.array([names[i] for i in d.tolist()], pa.int64()), "start": start, "length": n, "ids_crc32": crc, "doc_tokens": np.array([len(p) for p in parts])[d], "sequence_id": first + s, "offset": offset, "sequence_tokens": total, "padding": np.where(total & (total - 1), window - total, 0)}
            out["placed"] = pa.array([sequences[k][1] for k in s.tolist()], pa.string())
            first += len(sequences)
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) if not isinstance(v, pa.Array) else v for k, v in out.items()})

        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for name, tokens in zip(ids, encode_documents(vocabulary, texts, end_id), strict=True):
                names.append(name)
                parts.append(tokens)
                held += len(tokens)
                if held >= CHUNK_IDS:
                    yield flush()
                    names, parts, held = [], [], 0
        if parts:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(pack_partition, PIECES)
