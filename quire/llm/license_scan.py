"""License scans: an exact containment join of text blocks with templates.

A template is a license passage; its tokens are its different pairs of
neighbouring words. A block is a run of as many words as the template has, and
``SLACK`` more; every block of every text is looked at, word by word. A block
matches a template T that has at least ``alpha = ceil(THRESHOLD * |T|)`` of its
tokens. The tokens of all templates are put in one global order, rarest in the
corpus first. A matching block must contain one of T's first ``|T| - alpha + 1``
tokens (prefix filter); the text must have alpha pairs at least (length filter);
and when the first of T's tokens that a text contains is T's i-th, ``|T| - i``
of them are left, which must reach alpha (positional filter). For what is left
the tokens of every block are counted in full, so the join is exact.

The templates are fixed, so their tokens (under 2,000) are all that is sent to
every task; their words' document frequencies are counted over the whole corpus.
Nothing else is shuffled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Passages of public licenses and of the notices that name them.
TEMPLATES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "mpl-text": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-text": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
}
#: Share of a template's tokens, and words of a block beyond the template's, by share.
THRESHOLD, SLACK = 0.8, 0.2

#: Lower-cases A-Z; words are runs of 0-9, a-z and bytes of other scripts.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words in Spark's regular expressions.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

Pair = tuple[bytes, bytes]


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def pairs_of(words: list[bytes]) -> set[Pair]:
    return set(zip(words, words[1:], strict=False))


@dataclass
class Template:
    label: str
    tokens: list[Pair]  # rarest in the corpus first
    least: int
    block: int  # words of a block

    @property
    def prefix(self) -> list[Pair]:
        return self.tokens[: len(self.tokens) - self.least + 1]


def order_templates(frequency: dict[str, int], templates: dict[str, str], threshold: float = THRESHOLD, slack: float = SLACK) -> list[Template]:
    """``frequency``: of words. A pair is as rare as its rarer word; any order
    of the tokens gives the same matches."""
    out = []
    for label, text in templates.items():
        words = license_words(text)
        rare = lambda p: (min(frequency.get(w.decode(), 0) for w in p), max(frequency.get(w.decode(), 0) for w in p), p)
        tokens = sorted(pairs_of(words), key=rare)
        out.append(Template(label, tokens, math.ceil(threshold * len(tokens) - 1e-9), len(words) + math.ceil(slack * len(words))))
    return out


class Scanner:
    def __init__(self, templates: list[Template], phrases: dict[str, str]):
        self.templates = templates
        self.tokens: dict[Pair, list[tuple[int, int]]] = defaultdict(list)  # template, place in its order
        for k, t in enumerate(templates):
            for i, p in enumerate(t.tokens):
                self.tokens[p].append((k, i))
        self.heads = {p[0] for p in self.tokens}
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.firsts = {p[0] for p, _ in self.phrases}
        # A text without any of these words has neither a phrase nor a prefix token.
        self.signs = self.firsts.union(p[0] for t in templates for p in t.prefix)

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(start, label) of each place where a phrase's words stand."""
        out = []
        for i in [i for i, w in enumerate(words) if w in self.firsts]:
            out += [(i, label) for p, label in self.phrases if words[i : i + len(p)] == p]
        return out

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first, last, label, containment): runs of matching blocks, by the
        first words of the first and last block, and the best containment."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        last, heads = len(words) - 1, self.heads
        for at in [i for i, w in enumerate(words) if w in heads]:
            if at < last:
                for k, i in self.tokens.get((words[at], words[at + 1]), ()):
                    hits[k].append((at, i))
        out = []
        for k, found in sorted(hits.items()):
            t = self.templates[k]
            first = min(i for _, i in found)
            if len(words) - 1 < t.least or len(t.tokens) - first < t.least or len({i for _, i in found}) < t.least:
                continue
            out += [(a, b, t.label, n / len(t.tokens)) for a, b, n in matching_runs(found, len(words), t.block, t.least)]
        return sorted(out)


def matching_runs(found: list[tuple[int, int]], words: int, block: int, least: int) -> list[tuple[int, int, int]]:
    """Runs (first, last, most) of starts whose block of ``block`` words (or the
    text) has ``least`` different tokens or more. ``found``: (place, token).

    A token is in the blocks that start up to ``block - 2`` words before one of
    its places; where two places are closer, the block counts it once."""
    end = max(words - block, 0)  # the last start
    before: dict[int, int] = {}
    change: dict[int, int] = defaultdict(int)
    for at, token in sorted(found):
        first = max(at - block + 2, before.get(token, -1) + 1, 0)
        if first <= min(at, end):
            change[first] += 1
            change[min(at, end) + 1] -= 1
        before[token] = at
    runs: list[tuple[int, int, int]] = []
    at = sorted(change)
    n = 0
    for here, there in zip(at, at[1:], strict=False):
        n += change[here]
        if n >= least:
            if runs and runs[-1][1] == here - 1:
                runs[-1] = (runs[-1][0], there - 1, max(runs[-1][2], n))
            else:
                runs.append((here, there - 1, n))
    return runs


def word_frequency(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None) -> dict[str, int]:
    """In how many documents each word of the templates occurs; null texts have none."""
    wanted = sorted({w.decode() for t in (templates or TEMPLATES).values() for w in license_words(t)})
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    have = F.array_intersect(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.array(*map(F.lit, wanted)))
    return {r["word"]: r["count"] for r in docs.select(F.explode(have).alias("word")).groupBy("word").count().collect()}


def license_scanner(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> Scanner:
    """``templates``: label -> passage. Of an empty table all words are as rare."""
    templates = templates or TEMPLATES
    return Scanner(order_templates(word_frequency(docs, text_col, templates), templates, threshold), phrases or PHRASES)


def license_blocks(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text block that meets a template, in runs of neighbouring blocks:
    id, first_word and last_word (where the run's first block begins and its
    last one ends), label, containment (the best), block (the run's words).

    Rows with null or repeated ids are scanned each; null and empty texts have
    no block; very long texts are scanned whole; an empty table gives an empty
    result; other columns are not read."""
    small_batches(docs.sparkSession)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = {t.label: t.block for t in scanner.templates}
        for pdf in batches:
            out, at = [], []
            for k, text in enumerate(pdf["text"]):
                words = license_words(text)
                if not scanner.signs.isdisjoint(words):
                    for first, last, label, share in scanner.blocks(words):
                        end = min(last + size[label], len(words))
                        at.append(k)
                        out.append((first, end - 1, label, share, b" ".join(words[first:end]).decode("utf-8", "replace")))
            found = pd.DataFrame(out, columns=["first_word", "last_word", "label", "containment", "block"])
            found.insert(0, "id", pdf["id"].iloc[at].to_numpy())
            yield found

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(find, f"id {kind}, first_word long, last_word long, label string, containment double, block string").withColumnRenamed("id", id_col)


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word (of the
    phrases; null without one), base_labels, labels, score (1 with a phrase,
    else the best containment of a matching block, else 0).

    Null text counts as empty: no words, no labels (empty strings), score 0.
    Rows that repeat are scanned alike; an empty table gives an empty result;
    other columns are not read."""
    scanner = scanner or license_scanner(docs, text_col)
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = license_words(text)
                if scanner.signs.isdisjoint(words):
                    out.append((len(words), 0, None, None, "", "", 0.0))
                    continue
                places, blocks = scanner.places(words), scanner.blocks(words)
                base = {label for _, label in places}
                at = [i for i, _ in places]
                score = 1.0 if places else max((share for *_, share in blocks), default=0.0)
                out.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base.union(b[2] for b in blocks))), score))
            found = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]).astype({"first_word": "Int64", "last_word": "Int64"})
            found.insert(0, "id", pdf["id"].to_numpy())
            yield found

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(scan, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)
