"""Language-model scores by a Brown class-based n-gram model.

A word's probability is a mixture of a class bigram, ``p(c | c') * p(w | c)``,
and a unigram with one count added to each word. Exchange clustering assigns
the ``CLUSTERED`` most frequent words to ``CLASSES`` classes: each word in turn
moves to the class that raises the likelihood of the class bigrams most. The other
words of the dictionary with ``ENOUGH`` counts then join the class that gains
most from the word's own neighbours, and with their classes known so do the
words outside the dictionary. Words below that, unseen ones too, form one more
class, and the end of a text is a class of its own. The weight of the mixture
comes from leave-one-out EM over the class bigrams of the final classes.

Counts cover the whole training corpus: word counts, bigram counts of the
clustered words and the other words' neighbours by class are summed by tasks,
then shuffled; only the bigrams of the clustered words (at most
(CLUSTERED + 2)^2 numbers) and of the classes reach the driver. The most
frequent words (``DICTIONARY`` at most, none over ``LONGEST`` bytes) go to every
task with their classes. One step hands on the neighbours of all words with
``ENOUGH`` counts: of those in the dictionary by class, of the others by the
dictionary's numbers, so that they need not be counted again once the dictionary
has its classes. These give a rarer word its class, and with that class the
bigrams it stands in. Its count and class, and with it the probability of the
word behind, wait for a join with the table of all words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import compress, groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, fold, materialize, small_batches

CLUSTERED, CLASSES, ROUNDS = 1000, 48, 3
#: Counts from which a word outside the exchange gets a class.
ENOUGH = 10
DICTIONARY, LONGEST = 150_000, 64
#: Added to a class's followers in the proportions of the classes.
SMOOTH = 2.0
#: The end of a text, as a word; words hold no white space.
END = "\n"
END_KEY = END.encode()
#: Bits that tell which words outside the dictionary may have ``ENOUGH`` counts.
FLAG_BITS = 26
#: Words that a task counts before it hands them on.
HELD = 250_000
#: Neighbour counts of words that a task holds before it hands them on.
HELD_CELLS = 1_500_000


def lm_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or b"").lower().split()


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a few rows, with their texts in UTF-8."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield part, part.column("text").cast(pa.binary()).to_pylist()


def running_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts with an end behind each, and where the ends are."""
    said: list[bytes] = []
    ends = []
    for text in texts:
        said += lm_words(text)
        ends.append(len(said))
        said.append(END_KEY)
    return said, np.array(ends, np.int64)


def strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def lists(values: np.ndarray | pa.Array, lengths: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    offsets = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
    return pa.ListArray.from_arrays(offsets, values if isinstance(values, pa.Array) else pa.array(values, kind))


def count_words(texts: DataFrame) -> DataFrame:
    """``texts``: text. word, c: in all texts, with the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([strings(list(seen)), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for _, part in blocks(batches):
            for text in part:
                seen.update(lm_words(text))
            seen[END_KEY] += len(part)
            if len(seen) > HELD:
                yield told()
                seen.clear()
        if seen:
            yield told()

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def sum_pairs(parts: DataFrame, size: int) -> np.ndarray:
    """``parts``: cells, ns, of size * size cells. Their sums."""
    each = parts.select(F.explode(F.arrays_zip("cells", "ns")).alias("z")).groupBy("z.cells").agg(F.sum("z.ns").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[each.column(0).to_numpy()] = each.column(1).to_numpy()
    return out.reshape(size, size)


def count_pairs(texts: DataFrame, number: dict[bytes, int], rare: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of word numbers: (first, second, count). A text follows an end."""
    size, number = max(rare, end) + 1, number | {END_KEY: end}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for _, part in blocks(batches):
            said, _ = running_words(part)
            x = np.fromiter(map(number.get, said, repeat(rare)), np.int64, len(said))
            total += np.bincount(np.r_[end, x[:-1]] * size + x, minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(total[pairs])], ["pair", "n"])

    found = texts.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = (found.column(k).to_numpy() for k in ("pair", "n"))
    return pair // size, pair % size, n


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: int, classes: int, fixed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each of ``words + fixed`` words. The first ``words`` move
    between ``classes`` classes; each of the others has a class of its own."""
    cls = np.r_[np.arange(words) % max(classes, 1), classes + np.arange(fixed)]
    size = classes + fixed
    g = np.zeros((size, size))
    np.add.at(g, (cls[a], cls[b]), n)
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    at_a, at_b = np.searchsorted(a[by_a], np.arange(len(cls) + 1)), np.searchsorted(b[by_b], np.arange(len(cls) + 1))
    here = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in range(words):
            k, o, i = cls[w], by_a[at_a[w] : at_a[w + 1]], by_b[at_b[w] : at_b[w + 1]]
            own = n[o][b[o] == w].sum()
            o, i = o[b[o] != w], i[a[i] != w]
            out = np.bincount(cls[b[o]], weights=n[o], minlength=size)
            into = np.bincount(cls[a[i]], weights=n[i], minlength=size)
            g[k] -= out
            g[:, k] -= into
            g[k, k] -= own
            # What each class would gain from the word.
            gain = (xlogx(g[:classes] + out) - xlogx(g[:classes])).sum(1) + (xlogx(g[:, :classes] + into[:, None]) - xlogx(g[:, :classes])).sum(0)
            cell = g[here, here]
            gain += xlogx(cell + out[:classes] + into[:classes] + own) - xlogx(cell + out[:classes]) - xlogx(cell + into[:classes]) + xlogx(cell)
            # Wherever the word goes, its neighbours' classes regain it on their side.
            rows, cols = (g.sum(1) + into)[:classes], (g.sum(0) + out)[:classes]
            gain -= xlogx(rows + out.sum() + own) - xlogx(rows) + xlogx(cols + into.sum() + own) - xlogx(cols)
            to = int(gain.argmax())
            cls[w] = to
            moved += to != k
            g[to] += out
            g[:, to] += into
            g[to, to] += own
        if not moved:
            break
    return cls


@dataclass
class Lexicon:
    words: dict[bytes, int]  # the dictionary, by number; the end is one
    cls: np.ndarray  # class of each word of the dictionary
    rare: int  # class of all words without a class of their own
    end: int  # class of the end
    size: int  # number of classes
    late: bool  # words outside the dictionary may have a class
    flags: np.ndarray  # a bit of each that may, by its hash; false ones do no harm

    def may(self, words: list[bytes]) -> np.ndarray:
        """Which words outside the dictionary may have a class of their own."""
        mask = (1 << FLAG_BITS) - 1
        h = np.fromiter((xxhash.xxh64_intdigest(w, 42) & mask for w in words), np.int64, len(words))
        return (self.flags[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def read(self, texts: list[bytes | None], flagged: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of all words (-1 outside the dictionary) with an end behind
        each text, where the ends are, and the words outside the dictionary.
        ``flagged``: words that are certainly rare have -2 and are left out."""
        said, ends = running_words(texts)
        x = np.fromiter(map(self.words.get, said, repeat(-1)), np.int64, len(said))
        x[ends] = self.words.get(END_KEY, 0)
        at = np.flatnonzero(x < 0)
        rest = [said[i] for i in at.tolist()]
        if flagged and rest:
            new = list(set(rest))
            told = dict(zip(new, self.may(new).tolist(), strict=True))
            keep = list(map(told.__getitem__, rest))
            x[at[~np.array(keep)]] = -2
            rest = list(compress(rest, keep))
        return x, ends, rest

    def classes(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its class and the class before; -1 where a word is
        outside the dictionary. An end opens each text."""
        c = np.where(x >= 0, self.cls[x], np.where(x == -2, self.rare, -1))
        c[ends] = self.end
        return c, np.r_[self.end, c[:-1]]


def split_lists(values: list | np.ndarray, lengths: np.ndarray) -> list:
    ends = np.cumsum(lengths)
    return [values[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


class Cells:
    """Counts of cells by word, summed within a task; ``handed`` gives a row a
    word (its number, its cells, their counts) and starts anew."""

    def __init__(self, width: int) -> None:
        self.width, self.parts, self.held, self.counted = width, [], 0, 0

    def add(self, word: np.ndarray, cell: np.ndarray) -> None:
        found, n = np.unique(word * self.width + cell, return_counts=True)
        self.parts.append((found, n))
        self.held += len(found)
        self.counted += len(word)

    def merge(self) -> None:
        keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([p[1] for p in self.parts]), minlength=len(keys))
        self.parts, self.held = [(keys, counts.astype(np.int64))], len(keys)

    def full(self) -> bool:
        """Whether it is time to hand on: summing what is held must make room
        for a quarter at least, or it would be done too often."""
        often = self.held > HELD_CELLS
        if often:
            self.merge()
        return often and self.held > HELD_CELLS * 3 // 4 or self.counted > 1 << 30  # counts are 32 bits

    def handed(self, rows: int = 20_000) -> Iterator[tuple[np.ndarray, pa.ListArray, pa.ListArray]]:
        if not self.held:
            return
        self.merge()
        keys, counts = self.parts[0]
        word, cell = keys // self.width, keys % self.width
        bounds = np.r_[np.flatnonzero(np.r_[True, np.diff(word) > 0]), len(word)]
        self.parts, self.held, self.counted = [], 0, 0
        for k in range(0, len(bounds) - 1, rows):
            b = bounds[k : k + rows + 1]
            lengths, here = np.diff(b), slice(b[0], b[-1])
            yield word[b[:-1]], lists(cell[here], lengths), lists(counts[here].astype(np.int32), lengths)


def flag_words(words: DataFrame) -> np.ndarray:
    """2^FLAG_BITS bits, one of each word's hash set: 8 MB at any input size.
    More words only set more bits, so fewer words can be told to be rare."""
    h = F.xxhash64("word").bitwiseAND(F.lit((1 << FLAG_BITS) - 1))
    found = words.select(F.shiftright(h, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FLAG_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def count_sides(texts: DataFrame, lexicon: Lexicon, wanted: np.ndarray) -> DataFrame:
    """Neighbours of the words that get a class after the exchange, in three
    kinds of rows. A word has a row for each time a task hands its counts on.

    * ``word`` >= 0, cells, ns: a ``wanted`` word of the dictionary, by its
      number. Cell ``c`` counts class c behind the word, ``size + c`` class c
      before it, and ``2 * size`` the word behind itself;
    * ``word`` -1, name, cells, ns: a word outside the dictionary that may have a
      class. Cell ``k`` counts the dictionary's word k behind it and ``wide + k``
      before it (``wide``: of neighbour_codes, which says what else k may be);
    * ``word`` -2, name, cells, ns: such words one behind the other, with a space
      between them. Cell 0 counts the places.

    Further columns would cost more than all else on the way to Python."""
    size, late, short = lexicon.size, lexicon.late, len(lexicon.words)
    wide = short + 3

    def some(word: np.ndarray, name: pa.Array, cells: pa.ListArray, ns: pa.ListArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), name, cells, ns], ["word", "name", "cells", "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, chained = Cells(max(2 * size + 1, 2 * wide)), 0
        seen: dict[bytes, int] = {}  # words outside the dictionary, numbered behind its words
        chains: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            others = list(seen)
            for word, cell, n in cells.handed():
                k = int(np.searchsorted(word, short))
                if k:
                    yield some(word[:k], pa.nulls(k, pa.string()), cell[:k], n[:k])
                if k < len(word):
                    yield some(np.full(len(word) - k, -1), strings([others[i - short] for i in word[k:].tolist()]), cell[k:], n[k:])
            if chains:
                k = np.ones(len(chains), np.int64)
                yield some(-2 * k, strings(list(chains)), lists(0 * k, k), lists(np.array(list(chains.values())), k))
            seen.clear()
            chains.clear()

        for _, part in blocks(batches):
            x, ends, rest = lexicon.read(part, flagged=late)
            c, before = lexicon.classes(x, ends)
            c, before = np.where(c < 0, lexicon.rare, c), np.where(before < 0, lexicon.rare, before)
            i = np.flatnonzero((x >= 0) & wanted[x])  # never an end, so a word stands behind each
            behind = np.where(x[i + 1] == x[i], 2 * size, c[i + 1])
            j = i[np.r_[-1, x[:-1]][i] != x[i]]
            cells.add(np.r_[x[i], x[j]], np.r_[behind, size + before[j]])
            if late and rest:
                at, number = np.flatnonzero(x == -1), np.where(x >= 0, x, short)
                prior = np.r_[x[ends[0]], number[:-1]]
                word = np.array([seen.setdefault(w, len(seen)) for w in rest])
                follows = np.r_[False, np.diff(at) == 1]  # another such word
                again = follows & np.r_[False, word[1:] == word[:-1]]
                followed, twice = np.r_[follows[1:], False], np.r_[again[1:], False]
                first = np.where(follows, np.where(again, short + 1, short + 2), prior[at])
                then = np.where(followed, np.where(twice, short + 1, short + 2), number[at + 1])
                cells.add(short + np.r_[word, word], np.r_[then, wide + first])
                run = np.flatnonzero(follows | followed)
                if len(run):
                    lengths = np.diff(np.r_[np.flatnonzero(~follows[run]), len(run)])
                    chains.update(map(b" ".join, split_lists([rest[k] for k in run.tolist()], lengths)))
                    chained += len(run)
            if cells.full() or len(seen) + chained > HELD:
                yield from told()
                chained = 0
        yield from told()

    return texts.mapInArrow(count, "word int, name string, cells array<int>, ns array<int>")


def neighbour_codes(of: np.ndarray, rare: int, size: int) -> np.ndarray:
    """What stands beside a word outside the dictionary, by number: a class of
    the dictionary's word of that number, the rare one behind these; then
    ``size`` is the word itself and ``size + 1`` another such word."""
    return np.r_[of, rare, size, size + 1].astype(np.int32)


def best_classes(g: np.ndarray, classes: int, rare: int, word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class that each word gains most in, as in the exchange. ``g``: class
    bigrams in which the words are still rare. ``word``: numbers from 0, in
    order, each with an entry at least; ``cell``: as in ``count_sides``."""
    size, words = len(g), int(word[-1]) + 1 if len(word) else 0
    if not words:
        return np.zeros(0, np.int64)
    sums = np.bincount(word * (2 * size + 1) + cell, weights=n, minlength=words * (2 * size + 1)).reshape(words, -1)
    out, into, own = sums[:, :size], sums[:, size:-1], sums[:, -1:]
    cell, behind = np.where(cell == 2 * size, -1, cell), cell < size
    at = np.where(behind, cell, cell - size)
    was = np.where(behind[:, None], g[:classes, at % size].T, g[at % size, :classes])
    # The word itself leaves the rare class.
    was = was - np.where((at == rare)[:, None], np.where(behind[:, None], into[word, :classes], out[word, :classes]), 0)
    part = np.where((cell >= 0)[:, None], xlogx(was + n[:, None]) - xlogx(was), 0)
    gain = np.add.reduceat(part, np.flatnonzero(np.r_[True, np.diff(word) > 0]), axis=0)
    here, o, i = g.diagonal()[:classes], out[:, :classes], into[:, :classes]
    gain += xlogx(here + o + i + own) - xlogx(here + o) - xlogx(here + i) + xlogx(here)
    rows, cols = g.sum(1)[:classes], g.sum(0)[:classes]
    gain -= xlogx(rows + out.sum(1, keepdims=True) + own) - xlogx(rows) + xlogx(cols + into.sum(1, keepdims=True) + own) - xlogx(cols)
    return gain.argmax(1)


def words_together(sides: DataFrame) -> DataFrame:
    """Rows of a word one behind the other in a partition: chains first, then
    words outside the dictionary, then its own. However often a word was handed
    on, ``by_word`` holds each of its cells once."""
    return sides.repartition("word", "name").sortWithinPartitions("word", "name")


def by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of ``words_together``: (-2, chains), (-1, words outside the
    dictionary), (0, its own words)."""
    for batch in batches:
        kind = np.clip(batch.column("word").to_numpy(), -2, 0)
        bounds = [*np.flatnonzero(np.diff(kind, prepend=-9)).tolist(), len(kind)]
        for k, e in zip(bounds, bounds[1:], strict=False):
            yield int(kind[k]), batch.slice(k, e - k)


def by_word(batches: Iterator[pa.RecordBatch], width: int, rows: int = 2000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows sorted by word: some words, each with all its counts, as
    (words, place of the word, cell, count), each cell of a word once."""
    names, word, cell, n = None, *(np.zeros(0, np.int64) for _ in range(3))
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            part = whole.slice(k, rows)
            said = part.column("word") if names is None else pa.concat_arrays([names, part.column("word")])
            opens = np.r_[True, np.array(pc.not_equal(said[1:], said[:-1]), bool)]
            held = 0 if names is None else 1  # the last word so far, which may go on
            at = np.repeat((np.cumsum(opens) - 1)[held:], np.array(part.column("cells").value_lengths()))
            more = (np.array(part.column(c).flatten(), np.int64) for c in ("cells", "ns"))
            word, cell, n = np.r_[word, at], *(np.r_[x, y] for x, y in zip((cell, n), more, strict=True))
            key, of = np.unique(word * width + cell, return_inverse=True)
            word, cell, n = key // width, key % width, np.bincount(of, weights=n, minlength=len(key)).astype(np.int64)
            names = said.filter(pa.array(opens))
            done = word < len(names) - 1
            if len(names) > 1:
                yield names[:-1], word[done], cell[done], n[done]
            names, cell, n = names[-1:], cell[~done], n[~done]
            word = np.zeros(len(cell), np.int64)
    if names is not None:
        yield names, word, cell, n


def assign_classes(sides: DataFrame, lexicon: Lexicon, g: np.ndarray, classes: int) -> DataFrame:
    """word, cls of the words of the dictionary in ``sides``, of count_sides;
    of those outside it with ``ENOUGH`` counts word -1, name, cells, ns, each
    summed; of chains word -2, name, ns, summed too."""
    size, rare, wide, enough = lexicon.size, lexicon.rare, len(lexicon.words) + 3, ENOUGH
    names = ["word", "name", "cls", "cells", "ns"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def some(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, kind)) for k, kind in zip(names, kinds, strict=True)], names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, group in groupby(by_kind(batches), itemgetter(0)):
            parts = (part for _, part in group)
            named = (pa.RecordBatch.from_arrays([part.column(k) for k in ("name", "cells", "ns")], ["word", "cells", "ns"]) for part in parts)
            if kind == -2:
                for said, _, _, n in by_word(named, 1):
                    k = np.ones(len(said), np.int64)
                    yield some(len(said), word=pa.array(-2 * k, pa.int32()), name=said, ns=lists(n, k, pa.int64()))
            elif kind == -1:
                for said, word, cell, n in by_word(named, 2 * wide):
                    keep = np.bincount(word, weights=n * (cell < wide), minlength=len(said)) >= enough
                    cell, n, lengths = cell[keep[word]], n[keep[word]], np.bincount(word, minlength=len(said))[keep]
                    yield some(len(lengths), word=pa.array(np.full(len(lengths), -1), pa.int32()), name=said.filter(pa.array(keep)), cells=lists(cell, lengths), ns=lists(n, lengths, pa.int64()))
            else:
                for said, word, cell, n in by_word(parts, 2 * size + 1):
                    yield some(len(said), word=said, cls=pa.array(best_classes(g, classes, rare, word, cell, n), pa.int32()))

    return words_together(sides).mapInArrow(assign, "word int, name string, cls int, cells array<int>, ns array<long>")


def count_classes(texts: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Class bigrams with all words outside the dictionary in the rare class."""
    size = lexicon.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for _, part in blocks(batches):
            x, ends, _ = lexicon.read(part)
            c, before = lexicon.classes(x, ends)
            known, prior = np.where(c < 0, lexicon.rare, c), np.where(before < 0, lexicon.rare, before)
            total += np.bincount(prior * size + known, minlength=size * size)
        pair = np.flatnonzero(total)
        n = np.array([len(pair)])
        yield pa.RecordBatch.from_arrays([lists(pair, n), lists(total[pair], n, pa.int64())], ["cells", "ns"])

    return sum_pairs(texts.mapInArrow(count, "cells array<int>, ns array<long>"), size)


def assign_open(sides: DataFrame, lexicon: Lexicon, g: np.ndarray, classes: int) -> DataFrame:
    """word, cls of the words outside the dictionary; rows without a word say in
    cells, ns how the class bigrams ``g``, in which they are rare, change.
    Bigrams within chains are left as they are. ``sides``: such words' rows of
    assign_classes; ``lexicon``: with the classes of the dictionary."""
    size, rare, wide = lexicon.size, lexicon.rare, len(lexicon.words) + 3
    codes = neighbour_codes(lexicon.cls, rare, size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(size * size)
        kinds = pa.list_(pa.int32()), pa.list_(pa.int64())
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                part = whole.slice(k, 2000)
                word = np.repeat(np.arange(part.num_rows), np.array(part.column("cells").value_lengths()))
                cell, n = (np.array(part.column(c).flatten(), np.int64) for c in ("cells", "ns"))
                behind, at = cell < wide, codes[cell % wide].astype(np.int64)
                first = behind | (at != size)  # a word behind itself counts once
                side = np.where(at > size, rare, at)
                side = np.where(behind, np.where(at == size, 2 * size, side), size + side)
                key, to = np.unique((word * (2 * size + 1) + side)[first], return_inverse=True)
                cls = best_classes(g, classes, rare, key // (2 * size + 1), key % (2 * size + 1), np.bincount(to, weights=n[first], minlength=len(key)))
                known = at < size
                own, behind, at, n = cls[word][known], behind[known], at[known], n[known]
                change += np.bincount(np.where(behind, own * size + at, at * size + own), weights=n, minlength=size * size)
                change -= np.bincount(np.where(behind, rare * size + at, at * size + rare), weights=n, minlength=size * size)
                yield pa.RecordBatch.from_arrays([part.column("name"), pa.array(cls, pa.int32()), pa.nulls(len(cls), kinds[0]), pa.nulls(len(cls), kinds[1])], ["word", "cls", "cells", "ns"])
        pair = np.flatnonzero(change)
        n = np.array([len(pair)])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), lists(pair, n), lists(change[pair].astype(np.int64), n, pa.int64())], ["word", "cls", "cells", "ns"])

    return sides.select("name", "cells", "ns").mapInArrow(assign, "word string, cls int, cells array<int>, ns array<long>")


def look_up(parts: DataFrame, every: DataFrame) -> DataFrame:
    """Adds ``found``: (word, c, cls) of the words in ``rest`` that ``every``
    word's table holds; null without any. ``parts``: row, rest."""
    each = parts.select("row", F.explode(F.array_distinct("rest")).alias("word"))
    found = each.join(every, "word").groupBy("row").agg(F.collect_list(F.struct("word", "c", "cls")).alias("found"))
    return parts.join(found, "row", "left")


def met(batch: pa.RecordBatch, rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of ``look_up``: the sizes of ``rest``, and of each word its
    count (0 if it was never seen) and class."""
    rest, found = batch.column("rest"), batch.column("found")
    sizes = np.array(rest.value_lengths().fill_null(0), np.int64)
    flat = found.flatten()
    names, told = flat.field("word").to_pylist(), np.array(found.value_lengths().fill_null(0), np.int64)
    at = []
    for said, known, first in zip(split_lists(rest.flatten().to_pylist(), sizes), split_lists(names, told), (np.cumsum(told) - told).tolist(), strict=True):
        place = {w: first + k for k, w in enumerate(known)}
        at += [place.get(w, -1) for w in said]
    at = np.array(at, np.int64)
    c, cls = (np.r_[np.array(flat.field(k), np.int64), none] for k, none in (("c", 0), ("cls", rare)))
    return sizes, c[at], cls[at]


def count_chains(chains: DataFrame, placed: DataFrame, rare: int, size: int) -> np.ndarray:
    """How class bigrams within chains change. ``chains``: name, ns, of
    assign_classes; ``placed``: word, cls."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(size * size, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                sizes, _, cls = met(part, rare)
                n = np.repeat(np.array(part.column("n"), np.int64), sizes)
                inside = np.ones(len(cls), bool)
                inside[np.cumsum(sizes) - 1] = False
                i = np.flatnonzero(inside)
                change += np.bincount(cls[i] * size + cls[i + 1], weights=n[i], minlength=size * size).astype(np.int64)
                change[rare * size + rare] -= n[i].sum()
        pair = np.flatnonzero(change)
        n = np.array([len(pair)])
        yield pa.RecordBatch.from_arrays([lists(pair, n), lists(change[pair], n, pa.int64())], ["cells", "ns"])

    chains = chains.select(F.col("name").alias("row"), F.split("name", " ").alias("rest"), F.element_at("ns", 1).alias("n"))
    found = look_up(chains, placed.withColumn("c", F.lit(0).cast("long")))
    return sum_pairs(found.mapInArrow(resolve, "cells array<int>, ns array<long>"), size)


@dataclass
class Late:
    """The words outside the dictionary of some rows, one behind the other."""

    row: np.ndarray  # its place among the rows
    c: np.ndarray  # its count, 0 if it was never seen
    cls: np.ndarray
    before: np.ndarray  # class of the word before
    after: np.ndarray  # what stands behind; -1 another such word

    @staticmethod
    def of(batch: pa.RecordBatch, rare: int) -> Late:
        """``batch``: of look_up, with ``before`` (-1: another such word) and ``after``."""
        sizes, c, cls = met(batch, rare)
        before, after = (np.array(batch.column(k).flatten(), np.int64) for k in ("before", "after"))
        return Late(np.repeat(np.arange(batch.num_rows), sizes), c, cls, np.where(before >= 0, before, np.r_[rare, cls[:-1]] if len(cls) else cls), after)


@dataclass
class BrownModel:
    lexicon: Lexicon
    plus: np.ndarray  # count + 1 of each word of the dictionary
    emit: np.ndarray  # p(word | class) of each
    follow: np.ndarray  # p(class | class before)
    weight: float  # of the class bigram
    into: np.ndarray  # counts of each class
    rare_total: float
    total: float  # N + V + 1
    tokens: int  # N

    def mix(self, before: np.ndarray, c: np.ndarray, emit: np.ndarray, plus: np.ndarray) -> np.ndarray:
        return np.log10(self.weight * self.follow[before, c] * emit + (1 - self.weight) * plus / self.total)

    def batch(self, texts: list[bytes | None]) -> dict[str, pa.Array]:
        """Sums over the words that need no others' counts, and each text's
        words outside the dictionary with what stands around them: the class
        before, and the number behind (of the dictionary)."""
        x, ends, rest = self.lexicon.read(texts)
        c, before = self.lexicon.classes(x, ends)
        opens = np.r_[0, ends[:-1] + 1]
        known = x >= 0
        at = np.flatnonzero(~known)
        lengths = np.add.reduceat((~known).astype(np.int64), opens)
        if not self.tokens:
            known[ends] = False  # not even ends were seen
        closed = (c >= 0) & (before >= 0)
        score = np.where(closed, self.mix(before, c, self.emit[x], self.plus[x]), 0.0)
        sums = {"n_tokens": ends - opens + 1, "n_known": np.add.reduceat(known.astype(np.int64), opens), "base": np.add.reduceat(np.where(known, np.log10(self.plus[x]), 0.0), opens), "score": np.add.reduceat(score, opens)}
        return {k: pa.array(v) for k, v in sums.items()} | {"rest": lists(strings(rest), lengths), "before": lists(before[at], lengths), "after": lists(x[at + 1], lengths)}

    def late(self, x: Late, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What these words add to each row's n_known, base and score."""
        own = self.mix(x.before, x.cls, np.where(x.cls == self.lexicon.rare, (x.c + 1) / self.rare_total, x.c / np.maximum(self.into[x.cls], 1.0)), x.c + 1)
        behind = np.where(x.after >= 0, self.mix(x.cls, self.lexicon.cls[x.after], self.emit[x.after], self.plus[x.after]), 0.0)
        add = lambda v: np.bincount(x.row, weights=v, minlength=rows)
        return add(x.c > 0), add(np.log10(x.c + 1)), add(own + behind)


def fit(texts: DataFrame) -> tuple[BrownModel, DataFrame]:
    """``texts``: text. The model, and the table of all words: word, c, cls
    (the class of the dictionary's words is the model's). Null and empty texts
    are an end each; repeated rows count each; very long texts are counted
    whole; of an empty table every word is unseen."""
    small_batches(texts.sparkSession)
    counts = materialize(count_words(texts), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") >= ENOUGH)).first()
    tokens, distinct, frequent = map(int, total)
    levels = sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().collect()), reverse=True)
    least, room = 1, DICTIONARY
    for c, n in levels:
        room -= n
        if room < 0:
            least = c + 1
            break
    in_dictionary = ((F.col("c") >= least) & (F.octet_length("word") <= LONGEST)) | (F.col("word") == END)
    short = counts.filter(in_dictionary).toArrow()
    names, c = short.column("word").to_pylist(), short.column("c").to_numpy()
    order = sorted(range(len(names)), key=lambda k: (-c[k], names[k]))
    words = {names[k].encode(): i for i, k in enumerate(order)}
    c = c[order].astype(float) if order else np.zeros(0)

    top = [w for w in list(words)[: CLUSTERED + 1] if w != END_KEY][:CLUSTERED]
    number = {w: i for i, w in enumerate(top)}
    rare, end = len(top), len(top) + 1
    a, b, n = count_pairs(texts, number, rare, end)
    classes = min(CLASSES, max(1, len(top)))
    cls = exchange(a, b, n.astype(float), len(top), classes, 2)
    size, rare_class, end_class = classes + 2, classes, classes + 1
    g = np.zeros((size, size))
    np.add.at(g, (cls[a], cls[b]), n)

    # The further words of the dictionary, each by its own neighbours.
    of = np.array([cls[number[w]] if w in number else end_class if w == END_KEY else rare_class for w in words] or [end_class])
    wanted = np.r_[(of[: len(c)] == rare_class) & (c >= ENOUGH), np.zeros(int(not len(c)), bool)]
    late = frequent > int((c >= ENOUGH).sum())
    assigned = int(wanted.sum())
    flags = flag_words(counts.filter((F.col("c") >= ENOUGH) & ~in_dictionary)) if late else np.zeros(1, np.uint64)
    lexicon = Lexicon(words, of, rare_class, end_class, size, late, flags)
    sides = None
    if assigned or late:
        sides = materialize(assign_classes(count_sides(texts, lexicon, wanted), lexicon, g, classes), "lm-sides")
        near = sides.filter("word >= 0").select("word", "cls").toArrow()
        of = of.copy()
        of[near.column("word").to_numpy()] = near.column("cls").to_numpy()
        lexicon = replace(lexicon, cls=of)

    # Then the words outside it.
    every = counts.withColumn("cls", F.lit(rare_class))
    g = count_classes(texts, lexicon)
    if late:
        told = materialize(assign_open(sides.filter("word = -1"), lexicon, g.astype(float), classes), "word-classes")
        placed = told.filter("word is not null").select("word", "cls")
        assigned += placed.count()
        g = g + sum_pairs(told.filter("word is null"), size) + count_chains(sides.filter("word = -2"), placed, rare_class, size)
        every = counts.join(placed, "word", "left").withColumn("cls", F.coalesce("cls", F.lit(rare_class)))
    if sides is not None:
        discard(sides)
    g = g.astype(float)
    into = g.sum(0)
    share = (into + 1e-9) / (into + 1e-9).sum()
    follow = (g + SMOOTH * share) / (g.sum(1, keepdims=True) + SMOOTH)

    plus = c + 1 if len(c) else np.ones(1)
    rare_total = into[rare_class] + distinct - len(top) - assigned - (1 if tokens else 0) + 1.0
    emit = np.where(of == rare_class, plus / rare_total, (plus - 1) / np.maximum(into[of], 1.0)) if tokens else np.ones(1)

    # Leave-one-out: how much likelier a class bigram makes its second class.
    at = g > 0
    ratio = (g[at] - 1 + SMOOTH * share[np.nonzero(at)[1]]) / (g.sum(1)[np.nonzero(at)[0]] - 1 + SMOOTH) / share[np.nonzero(at)[1]]
    weight = 0.5
    for _ in range(30):
        if tokens:
            part = weight * ratio / (weight * ratio + 1 - weight)
            weight = float(np.clip((part * g[at]).sum() / g[at].sum(), 0.01, 0.99))
    return BrownModel(lexicon, plus, emit, follow, weight, into, rare_total, tokens + distinct + 1.0, tokens), every


def score_documents(docs: DataFrame, model: BrownModel, every: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score,
    score, perplexity (of the score, per token).

    Null and empty texts are the end alone. Rows that repeat are scored alike;
    with nothing to learn from, every token is unseen; an empty table gives an
    empty result; other columns are not read."""

    small_batches(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part, texts in blocks(batches):
            out = model.batch(texts)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(texts))), part.column("id"), *out.values()], ["row", "id", *out])
            row += len(texts)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                part = whole.slice(k, 512)
                known, base, score = model.late(Late.of(part, model.lexicon.rare), part.num_rows)
                sums = [np.array(part.column(name)) + add for name, add in (("n_known", known.astype(np.int64)), ("base", base), ("score", score))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_tokens"), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = materialize(rows.mapInArrow(first, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rest array<string>, before array<int>, after array<int>"), "lm-parts")
    return (
        look_up(parts, every)
        .mapInArrow(second, f"id {kind}, n_tokens long, n_known long, base double, score double")
        .select(
            F.col("id").alias(id_col),
            "n_tokens",
            "n_known",
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") - F.col("n_tokens") * float(np.log10(model.total))).alias("base_score"),
            "score",
        )
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    )


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from all documents outside the held-out fold and score every one."""
    out = fold(F.col(id_col), folds) == held
    model, every = fit(docs.filter(~out).select(F.col(text_col).alias("text")))
    return score_documents(docs, model, every, id_col, text_col).withColumn("held_out", fold(F.col(id_col), folds) == held)
