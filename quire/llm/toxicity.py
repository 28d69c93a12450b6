"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document is labelled. A sentence
scores ``p = sigmoid(bias + sum of its words' weights)`` and the document is
toxic unless every sentence is harmless: noisy-or, ``P = 1 - prod(1 - p)``. The
gradient of the document's log-loss flows through the noisy-or to the sentences
that carry it, so the model also locates the offending sentences.

The model is fitted on a bounded sample (``SAMPLE_PER_LABEL`` documents a label,
``SAMPLE_CHARS`` characters a label) without the copies in it; scoring reads
every whole text, with no shuffle. Words that fewer than ``MIN_DOCUMENTS``
different texts of the sample hold get no weight; of the others those that the
penalty leaves one are kept by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, fold, small_batches

SAMPLE_PER_LABEL, SAMPLE_CHARS = 3000, 5_000_000
#: Clean documents weigh ``NEGATIVES`` times as much, so that few are rejected.
MIN_DOCUMENTS, STEPS, RATE, PENALTY, BIAS, NEGATIVES = 5, 200, 1.0, 1e-4, -10.0, 3.0
BIAS_RATE = 0.3

#: ASCII letters, digits and bytes of other scripts form words; these end a
#: sentence; the rest separates words.
_ENDS = b".!?\n\r"
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else (10 if b in _ENDS else 32) for b in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased words, with b"|" where a sentence ends."""
    return text.lower().encode("utf-8", "replace").translate(_TABLE).replace(b"\n", b" | ").split()


@dataclass
class NoisyOrModel:
    words: dict[bytes, int]  # those with a weight, from 1; the end of a sentence is -1
    weights: np.ndarray  # by number; 0 of all other words
    bias: float

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the scores of its sentences that have words."""
        get, size, out = self.words.get, len(self.weights), []
        for text in texts:
            said = tokens(text)
            x = np.fromiter(map(get, said, repeat(0)), np.int64, len(said))
            end = x < 0
            sentence = np.cumsum(end)[~end]
            if not len(sentence):
                out.append(np.zeros(0))
                continue
            number = np.cumsum(np.r_[False, sentence[1:] != sentence[:-1]])
            x = x[~end]
            told = np.flatnonzero(x)
            pairs = np.unique(number[told] * size + x[told])  # a word counts once in a sentence
            total = np.bincount(pairs // size, weights=self.weights[pairs % size], minlength=number[-1] + 1)
            out.append(1 / (1 + np.exp(-np.clip(self.bias + total, -30, 30))))
        return out


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(labelled: list[tuple[int, str]]) -> NoisyOrModel:
    """Fit on (label, text) pairs; without both labels, all weights are zero."""
    flat, labels, number = [], [], {}
    for label, text in dict.fromkeys(labelled):
        x = np.array([-1 if w == b"|" else number.setdefault(w, len(number)) for w in tokens(text)], np.int32)
        if (x >= 0).any():
            flat.append(np.r_[x, np.int32(-1)])
            labels.append(label)
    if len(set(labels)) < 2:
        return NoisyOrModel({b"|": -1}, np.zeros(1), BIAS)
    size = len(number)
    y = np.array(labels, float)
    x = np.concatenate(flat).astype(np.int64)
    doc = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    use = np.bincount(np.unique(doc[x >= 0] * size + x[x >= 0]) % size, minlength=size) >= MIN_DOCUMENTS
    # A word counts once in a sentence.
    sentence, doc = np.cumsum(x < 0)[x >= 0], doc[x >= 0]
    pairs, at = np.unique(sentence * size + x[x >= 0], return_index=True)
    word, doc = (pairs % size).astype(np.int32), doc[at]
    opens = np.flatnonzero(np.r_[True, np.diff(pairs // size) > 0])
    of = np.repeat(np.arange(len(opens), dtype=np.int32), np.diff(np.r_[opens, len(word)]))
    bag = doc[opens]
    first = np.flatnonzero(np.r_[True, np.diff(bag) > 0])
    w, bias = np.zeros(size), BIAS
    g2, b2 = np.full(size, 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(bias + np.add.reduceat(w[word], opens), -30, 30)))
        clean = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), first)
        big = np.maximum(-np.expm1(clean), 1e-9)
        dz = p * np.where(y > 0, -np.exp(clean) / big, NEGATIVES)[bag] / len(y)
        g = np.bincount(word, weights=dz[of], minlength=size)
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
        w = np.where(use, np.sign(w) * np.maximum(np.abs(w) - RATE * PENALTY / np.sqrt(g2), 0), 0)
        gb = dz.sum()
        b2 += gb * gb
        bias -= BIAS_RATE * gb / np.sqrt(b2)
    told = np.flatnonzero(w)
    names = list(number)
    return NoisyOrModel({b"|": -1} | {names[i]: k for k, i in enumerate(told.tolist(), 1)}, np.r_[0.0, w[told]], float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held: int = 0) -> NoisyOrModel:
    """Learn from labelled rows outside the held-out fold. Null labels, null ids
    and ids that carry both labels teach nothing."""
    marks = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most"))
        .filter("label = most")
        .select("id", "label")
    )
    return fit(bounded_sample(marks, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), SAMPLE_PER_LABEL, SAMPLE_CHARS))


def score_documents(docs: DataFrame, model: NoisyOrModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, score, predicted (1 from ``threshold`` on) and
    worst_sentence (its number among the sentences that have words, from 0;
    null without any). Null and empty texts have no sentence and score 0. Rows
    that repeat are scored alike; an empty table gives an empty result; other
    columns are not read. Very long texts are scored whole, a batch of few."""
    small_batches(docs.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = model.scores(pdf["text"].tolist())
            s = np.array([noisy_or(p) for p in found])
            worst = pd.array([int(p.argmax()) if len(p) else None for p in found], dtype="Int32")
            yield pd.DataFrame({"id": pdf["id"], "score": s, "predicted": (s >= threshold).astype("int32"), "worst_sentence": worst})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(score, f"id {kind}, score double, predicted int, worst_sentence int").withColumnRenamed("id", id_col)


def offending_sentences(docs: DataFrame, model: NoisyOrModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per sentence that alone reaches the threshold: id, sentence
    (number among those with words), score, words (its words, in order). Null
    and empty texts have none; rows with null or repeated ids are searched each;
    an empty table gives an empty result; other columns are not read."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, at = [], []
            for row, (text, p) in enumerate(zip(pdf["text"], model.scores(pdf["text"].tolist()), strict=True)):
                said = [s for s in re.split(rb" ?\| ?", b" ".join(tokens(text))) if s]
                for k in np.flatnonzero(p >= threshold).tolist():
                    at.append(row)
                    out.append((k, float(p[k]), said[k].decode()))
            found = pd.DataFrame(out, columns=["sentence", "score", "words"])
            found.insert(0, "id", pdf["id"].iloc[at].to_numpy())
            yield found

    return rows.mapInPandas(locate, f"id {kind}, sentence int, score double, words string").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns, in
    one pass without a shuffle. Null and empty texts are clean; a score at the
    threshold goes; rows that repeat stay or go alike; without labels of both
    kinds all stay; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series([noisy_or(p) for p in model.scores(text.tolist())], dtype=float)

    return plain.filter(score(F.coalesce(F.col(f"c{at}"), F.lit(""))) < threshold).toDF(*names)

