"""URL filters: rules for hosts and paths, then a weighted vocabulary.

A rule names a host and a path; the longest one that fits decides. Where none
fits, an Aho-Corasick automaton finds all terms of the vocabulary in the URL in
one pass; a hit counts where no letter or digit touches it. One strict term, or
``SOFT_LIMIT`` different soft ones, block the URL.

Rules and vocabulary are parameters of bounded size, built into lookups once a
task; URLs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

#: Weights of terms: a strict one blocks alone, of soft ones several must occur.
STRICT_TERMS = ("porn", "porno", "xxx", "sexcam", "hentai", "camgirls", "viagra", "cialis", "warez", "keygen", "escorts", "phishing", "malware", "adserver", "doubleclick")
SOFT_TERMS = (
    "adult", "x", "sex", "nude", "cams", "dating", "casino", "win", "slots", "jackpot", "poker", "bet", "bets", "betting", "free", "bonus", "cheap", "pills", "pharmacy",
    "drugs", "ads", "ad", "track", "tracker", "click", "clicks", "banner", "popup", "spam", "farm", "links", "seo", "loan", "loans", "crack", "torrent", "replica", "download",
)
SOFT_LIMIT = 2
#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Most characters of all terms, and of all rules: they go to every task.
MOST_CHARS = 8 << 20
LOWER = {c: c + 32 for c in range(65, 91)}


class Judgement(NamedTuple):
    host: str
    path: str
    rule: str | None
    verdict: str
    strict_terms: int
    soft_terms: int


def split_url(url: str | None) -> tuple[str, str]:
    """Host (lower-cased in A-Z) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(LOWER), rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host, rest[:stop]


def _alnum(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z"


class UrlJudge:
    """Lookups of one task. Terms are lower-cased in A-Z; empty ones and those
    that are strict as well as soft (strict wins) are left out."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = RULES, strict: Iterable[str] = STRICT_TERMS, soft: Iterable[str] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            self.by_host.setdefault(host.translate(LOWER), []).append((path, action))
        weight = {t.translate(LOWER): False for t in soft if t} | {t.translate(LOWER): True for t in strict if t}
        self.soft_limit, self.terms = soft_limit, ahocorasick.Automaton()
        for term, is_strict in weight.items():
            self.terms.add_word(term, (term, is_strict))
        self.terms.make_automaton()

    def fitting_rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, and its action. Of rules of one length
        the one with the longer host, and of the same rule twice a block, wins."""
        labels, best = host.split("."), None
        for k in range(len(labels)):
            above = ".".join(labels[k:])
            for start, action in self.by_host.get(above, ()):
                if path.startswith(start):
                    found = (len(above) + len(start), len(above), action == "block", above + start, action)
                    best = found if best is None else max(best, found)
        return (None, None) if best is None else best[3:]

    def term_hits(self, url: str) -> tuple[int, int]:
        """Different strict and soft terms that stand in a URL by themselves."""
        text = url.translate(LOWER)
        if not len(self.terms):
            return 0, 0
        found = set()
        for end, (term, is_strict) in self.terms.iter(text):
            before = end - len(term)
            if (before < 0 or not _alnum(text[before])) and (end + 1 == len(text) or not _alnum(text[end + 1])):
                found.add((is_strict, term))
        strict = sum(s for s, _ in found)
        return strict, len(found) - strict

    def judge(self, url: str | None) -> Judgement:
        host, path = split_url(url)
        strict, soft = self.term_hits(url or "")
        rule, action = self.fitting_rule(host, path)
        own = "block" if strict or soft >= self.soft_limit else "allow"
        return Judgement(host, path, rule, action or own, strict, soft)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, strict: tuple = STRICT_TERMS, soft: tuple = SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, and how many strict
    and soft terms its URL holds (``strict_terms``, ``soft_terms``).

    A null URL, an empty one and one without ``://`` have an empty host and
    path, which no rule fits; terms are looked for all the same, and a null one
    is allowed. Very long URLs are read whole. Repeated rows are judged alike,
    null ids stay. An empty table gives an empty result; other columns, of any
    name, are not read. Only the id and the URL leave the scan."""
    if sum(map(len, (*strict, *soft))) > MOST_CHARS or sum(len(h) + len(p) for _, h, p in rules) > MOST_CHARS:
        raise ValueError(f"terms or rules of more than {MOST_CHARS} characters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(rules, strict, soft, soft_limit)
        for batch in batches:
            found = [judge.judge(u.as_py()) for u in batch.column(1)]
            columns = [pa.array([f[k] for f in found], pa.int64() if k > 3 else pa.string()) for k in range(len(Judgement._fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *Judgement._fields])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, strict_terms long, soft_terms long")
    return out.withColumnRenamed("id", id_col)
