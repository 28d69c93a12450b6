"""Language identification by a bidirectional gated recurrent network over bytes.

A text is a sequence of bytes (A-Z lower-cased). One recurrent layer reads it
forwards, another backwards, and every position gets a distribution over
languages from both states. The log-probabilities of positions that belong to
letters are summed over a document, which gives the document's probabilities.

The state is carried through the text, over words, digits and punctuation. So
that positions of many texts can be computed side by side, a text is read in
windows of ``WINDOW`` bytes, cut between characters; each window's reading
begins ``CONTEXT`` bytes before it and ends as many behind it, so that either
state has met what stands around the window, and each position is labelled once.

The network is trained here, in numpy, by backpropagation through time with
Adam, on windows of a bounded sample of documents (``SAMPLE_PER_LANG`` documents
and ``SAMPLE_CHARS`` characters a language). Prediction reads every whole text,
with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, fold, small_batches

SAMPLE_PER_LANG, SAMPLE_CHARS = 400, 2_000_000
HIDDEN, BATCH, SPAN, STEPS, RATE = 12, 192, 72, 260, 0.02
WINDOW, CONTEXT = 512, 32
#: Windows computed side by side, numbers a run of them may hold, and bytes of
#: texts that are cut in windows at once.
RUN, CELLS, GROUP = 1024, 1 << 23, 1 << 20
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes of letters: a-z and all of other scripts.
_TELLS = np.array([b >= 128 or 97 <= b <= 122 for b in range(256)])


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)


def windows(data: np.ndarray, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's windows: where the reading begins, where the window begins
    and ends. A reading ends ``context`` bytes behind the window or with the text."""
    if len(data) <= window + context:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(data))
    cut = np.arange(window, len(data), window)
    for _ in range(3):  # forward to where a character begins
        cut = cut + ((cut < len(data)) & (data[np.minimum(cut, len(data) - 1)] & 0xC0 == 0x80))
    begin = np.r_[0, cut[cut < len(data)]]
    return np.maximum(begin - context, 0), begin, np.r_[begin[1:], len(data)]


def log_softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    x = x - x.max(axis, keepdims=True)
    return x - np.log(np.exp(x).sum(axis, keepdims=True))


def turned(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps x sequences, or steps x numbers x sequences: each sequence's first
    n steps in reverse order."""
    t = np.arange(len(x))[:, None]
    t = np.where(t < n, n - 1 - t, t)
    return np.take_along_axis(x, t if x.ndim == 2 else t[:, None, :], 0)


@dataclass
class ByteGRU:
    """Parameters: for each direction ``e`` (3H x 256: what a byte adds to the
    gates: reset, update, candidate), ``u`` (3H x H) and ``b``; ``v`` (L x 2H),
    ``c``. Sequences run along the last axis."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 0) -> "ByteGRU":
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p |= {f"e{d}": r.normal(0, 0.3, (3 * hidden, 256)), f"u{d}": r.normal(0, hidden**-0.5, (3 * hidden, hidden)), f"b{d}": np.zeros((3 * hidden, 1))}
        p |= {"v": r.normal(0, 0.3, (len(languages), 2 * hidden)), "c": np.zeros((len(languages), 1))}
        return cls(languages, {k: x.astype(np.float32) for k, x in p.items()})

    def _states(self, x: np.ndarray, active: np.ndarray, d: str, past: list | None = None) -> np.ndarray:
        """``x``: steps x sequences of bytes; the first ``active[t]`` sequences,
        which are the longest, have a step t. States, steps x H x sequences."""
        hid = self.p["u" + d].shape[1]
        # The gates open linearly, min(1, max(0, x / 4 + 1 / 2)), so the slope and
        # the middle can be put in the weights.
        slope = np.where(np.arange(3 * hid)[:, None] < 2 * hid, 0.25, 1.0).astype(self.p["c"].dtype)
        e = (self.p["e" + d] + self.p["b" + d]) * slope + np.where(slope < 1, slope.dtype.type(0.5), 0)
        u = self.p["u" + d] * slope
        states = np.zeros((len(x), hid, x.shape[1]), u.dtype)
        h = np.zeros((hid, x.shape[1]), u.dtype)
        for t, m in enumerate(active.tolist()):
            if m < h.shape[1]:
                h = np.ascontiguousarray(h[:, :m])
            a, g = np.take(e, x[t, :m], 1), u @ h
            rz = a[: 2 * hid]
            rz += g[: 2 * hid]
            np.clip(rz, 0, 1, out=rz)
            r, z, gc, c = rz[:hid], rz[hid:], g[2 * hid :], a[2 * hid :]
            c += r * gc
            np.tanh(c, out=c)
            if past is not None:
                past.append((h, r, z, c, gc))
            h = h + z * (c - h)
            states[t, :, :m] = h
        return states

    def scores(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probabilities, steps x languages x sequences. ``n``: lengths, falling."""
        active = (n > np.arange(len(x))[:, None]).sum(1)
        hid = self.p["uf"].shape[1]
        forth = self.p["v"][:, :hid] @ self._states(x, active, "f") + self.p["c"]
        back = self.p["v"][:, hid:] @ self._states(turned(x, n), active, "b")
        return log_softmax(forth + turned(back, n), 1)

    def gradients(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean log-loss over all positions, and its gradients through time."""
        steps, count = x.shape
        active = (n > np.arange(steps)[:, None]).sum(1)
        mask = (np.arange(steps)[:, None] < n).astype(self.p["c"].dtype)
        runs = {d: (y, past := [], self._states(y, active, d, past)) for d, y in (("f", x), ("b", turned(x, n)))}
        both = np.concatenate((runs["f"][2], turned(runs["b"][2], n)), 1)
        told = log_softmax(self.p["v"] @ both + self.p["c"], 1)
        loss = -float((told[:, label, np.arange(count)] * mask).sum() / mask.sum())
        delta = np.exp(told)
        delta[:, label, np.arange(count)] -= 1
        delta *= (mask / mask.sum())[:, None, :]
        hid = self.p["uf"].shape[1]
        g = {"v": np.einsum("tlb,thb->lh", delta, both, optimize=True), "c": delta.sum((0, 2))[:, None]}
        above = self.p["v"].T @ delta
        for d, part in (("f", above[:, :hid]), ("b", turned(above[:, hid:], n))):
            y, past, _ = runs[d]
            u, back = self.p[f"u{d}"], np.zeros((hid, count), part.dtype)
            gu, inputs = np.zeros_like(u), np.zeros((steps, 3 * hid, count), part.dtype)
            for t in range(steps - 1, -1, -1):
                h, r, z, c, gc = past[t]
                m = h.shape[1]
                dh = back[:, :m] + part[t, :, :m]
                dn = dh * z * (1 - c * c)
                dz = dh * (c - h) * (0.25 * ((z > 0) & (z < 1)))
                dr = dn * gc * (0.25 * ((r > 0) & (r < 1)))
                dg = np.concatenate((dr, dz, dn * r))
                inputs[t, :, :m] = np.concatenate((dr, dz, dn))
                back[:, :m] = dh * (1 - z) + u.T @ dg
                gu += dg @ h.T
            g[f"u{d}"], g[f"b{d}"] = gu, inputs.sum((0, 2))[:, None]
            g[f"e{d}"] = np.stack([np.bincount(y.ravel(), weights=inputs[:, k].ravel(), minlength=256) for k in range(3 * hid)])
        return loss, g


def lay_out(data: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps x sequences: ``n`` (falling) bytes of ``data`` from each ``lo``; 0 behind."""
    at = lo + np.arange(n.max(initial=0))[:, None]
    inside = at < lo + n
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(at.shape, np.uint8)


def fit(pairs: list[tuple[str, str]], steps: int = STEPS, seed: int = 0) -> ByteGRU:
    """Fit on (language, text) pairs; every language weighs the same. Windows
    are drawn from all of a language's texts, one behind the other."""
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in pairs:
        by.setdefault(lang, []).append(text_bytes(text + " "))
    data = {k: np.concatenate(x) for k, x in by.items() if any(_TELLS[t].any() for t in x)}
    model = ByteGRU.fresh(sorted(data))
    if len(model.languages) < 2:
        return model
    r, m, v = np.random.default_rng(seed), {}, {}
    each = max(1, BATCH // len(model.languages))
    every = np.concatenate([data[k] for k in model.languages])
    first = np.cumsum([0] + [len(data[k]) for k in model.languages])
    for step in range(1, steps + 1):
        lo, n, label = [], [], []
        for k, lang in enumerate(model.languages):
            size = min(SPAN, len(data[lang]))
            lo.append(first[k] + r.integers(0, len(data[lang]) - size + 1, each))
            n.append(np.full(each, size))
            label.append(np.full(each, k))
        lo, n, label = np.concatenate(lo), np.concatenate(n), np.concatenate(label)
        order = np.argsort(-n, kind="stable")
        rate = RATE * (1 - step / (steps + 1))
        for k, g in model.gradients(lay_out(every, lo[order], n[order]), n[order], label[order])[1].items():
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g
            v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
            model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> ByteGRU:
    """Learn from documents outside the held-out fold that have a text, a lang
    and an id. Repeated rows may be drawn each; a text longer than the sample's
    bound teaches nothing. From an empty table, or a single language, a model
    without or with one language results."""
    use = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held))
    marks = use.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"))
    return fit(bounded_sample(marks, use.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), SAMPLE_PER_LANG, SAMPLE_CHARS))


def document_scores(model: ByteGRU, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-probabilities over the letters' positions (documents x
    languages), and the number of these positions."""
    sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    at = 0
    while at < len(texts):
        datas, held, first = [], 0, at
        while at < len(texts) and (not held or held < GROUP):
            datas.append(text_bytes(texts[at]))
            held += len(datas[-1])
            at += 1
        data = np.concatenate(datas)
        cuts = [windows(d) for d in datas]
        base = np.cumsum([0] + [len(d) for d in datas])
        doc = np.repeat(np.arange(len(datas)), [len(c[1]) for c in cuts])
        lo, begin, end = (np.concatenate([c[k] for c in cuts]) + base[doc] for k in range(3))
        n = np.minimum(end + CONTEXT, base[doc + 1]) - lo
        order = np.argsort(-n, kind="stable")
        width = max(1, min(RUN, CELLS // (max(n.max(initial=1), 1) * max(len(model.languages), HIDDEN))))
        for k in range(0, len(order), width):
            some = order[k : k + width]
            some = some[n[some] > 0]
            if not len(some):
                continue
            x = lay_out(data, lo[some], n[some])
            place = np.arange(len(x))[:, None] + lo[some]
            use = _TELLS[x] & (place >= begin[some]) & (place < end[some])
            told = (model.scores(x, n[some]) * use[:, None, :]).sum(0, dtype=float).T
            np.add.at(sums, first + doc[some], told)
            np.add.at(counts, first + doc[some], use.sum(0))
    return sums, counts


def identify(docs: DataFrame, model: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (its probability).

    Null text and text without a letter are "und" with score 0; so is all text
    where nothing could be learned. Ties go to the language that sorts first.
    Very long texts are read window by window. Rows that repeat are labelled
    alike; an empty table gives an empty result; other columns are not read."""
    small_batches(docs.sparkSession)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            told = np.array([_LETTER.search(t) is not None for t in texts], bool) & bool(model.languages)
            name, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if model.languages and len(texts):
                p = np.exp(log_softmax(document_scores(model, texts)[0]))
                name = np.where(told, np.array(model.languages, object)[p.argmax(1)], UNDETERMINED)
                score = np.where(told, p.max(1), 0.0)
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": name, "score": score})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def label_positions(model: ByteGRU, text: str) -> list[str]:
    """The language of each byte of a text."""
    data = text_bytes(text)
    out: list[str] = []
    for lo, begin, end in zip(*windows(data), strict=True):
        n = np.array([min(end + CONTEXT, len(data)) - lo])
        if n[0]:
            best = model.scores(lay_out(data, np.array([lo]), n), n)[begin - lo : end - lo, :, 0].argmax(1)
            out += [model.languages[k] for k in best]
    return out
