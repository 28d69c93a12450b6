"""Tables as pipe rows and back, as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def columns_of(spans: Column) -> Column:
    """The width of a grid: the largest sum of a row's colspans."""
    return F.array_max(F.transform(spans, lambda row: F.aggregate(row, F.lit(0), lambda a, c: a + c)))


def to_markdown(rows: Column) -> Column:
    """array<array<string>> as pipe rows, a rule behind the first; bars are
    escaped and line ends are spaces."""

    def cell(c: Column) -> Column:
        return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows.getItem(0), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def from_markdown(text: Column) -> Column:
    """array<array<string>>: pipe rows without rules, split at bars that are not
    escaped."""
    rows = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.rlike(r"^\|(?!(?:\s*:?-{2,}:?\s*\|)+$)"))
    inner = F.transform(rows, lambda x: F.regexp_replace(x, r"^\||(?<!\\)\|$", ""))
    return F.transform(inner, lambda x: F.transform(F.split(x, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))


def onto_template(cells: Column, template: Column) -> Column:
    """Texts put on a template by row and column; the template's own where the
    text has no such cell."""
    return F.transform(template, lambda row, r: F.transform(row, lambda c, i: F.coalesce(F.try_element_at(F.coalesce(F.try_element_at(cells, r + 1), F.array().cast("array<string>")), i + 1), c)))
