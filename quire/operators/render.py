"""Rendering node tables as XHTML, Typst source, style sheets and EPUB files."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import RTL_LANGUAGES, escape_html
from quire.operators.tables import columns_of

#: Fixed pattern: the inline dialect, one alternative for each form: code, link,
#: strong, em.
INLINE = re.compile(r"`(?P<code>[^`]+)`|\[(?P<label>[^\]]*)\]\((?P<url>[^)]+)\)|\*\*(?P<strong>.+?)\*\*|(?<!\*)\*(?!\*)(?P<em>.+?)(?<!\*)\*(?!\*)")
CELLS = "array<array<struct<text:string,is_header:boolean,colspan:int,rowspan:int>>>"
TYPST_MARKS = re.compile(r"([*_`#@$<>\[\]\\])")


def escape_typst_text(s: str) -> str:
    return TYPST_MARKS.sub(r"\\\1", s)


def inline(text: str | None, escape: Callable[[str], str], forms: dict[str, Callable[[re.Match], str]]) -> str:
    """One pass: each form is rendered, what lies between is escaped once."""
    out, at = [], 0
    for m in INLINE.finditer(text or ""):
        form = next(k for k in ("code", "url", "strong", "em") if m[k] is not None)
        out += [escape(text[at : m.start()]), forms[form](m)]
        at = m.end()
    return "".join(out) + escape((text or "")[at:])


def inline_xhtml(text: str | None) -> str:
    e = html.escape
    return inline(text, e, {"code": lambda m: f"<code>{e(m['code'])}</code>", "url": lambda m: f'<a href="{e(m["url"])}">{e(m["label"])}</a>', "strong": lambda m: f"<strong>{inline_xhtml(m['strong'])}</strong>", "em": lambda m: f"<em>{inline_xhtml(m['em'])}</em>"})


def inline_typst(text: str | None) -> str:
    e = escape_typst_text
    return inline(text, e, {"code": lambda m: f"`{m['code']}`", "url": lambda m: f'#link("{m["url"]}")[{e(m["label"])}]', "strong": lambda m: f"*{inline_typst(m['strong'])}*", "em": lambda m: f"_{inline_typst(m['em'])}_"})


def rendered(text: Column, form: str) -> Column:
    """Inline text as "xhtml" or "typst"."""
    fn = {"xhtml": inline_xhtml, "typst": inline_typst}[form]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn)

    return F.pandas_udf(run, "string")(F.coalesce(text, F.lit("")))


def rendered_all(texts: Column, form: str) -> Column:
    """As ``rendered``, for each text of an array; null texts are empty."""
    fn = {"xhtml": inline_xhtml, "typst": inline_typst}[form]

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [fn(t) for t in x])

    return F.pandas_udf(run, "array<string>")(texts)


def _with_cells(nodes: DataFrame, form: str) -> DataFrame:
    """Adds ``grid``: the nodes' cells with rendered texts (null without any).
    One call of Python renders all texts of a table."""
    if "cells" not in nodes.columns:
        return nodes.withColumn("grid", F.lit(None).cast(CELLS))
    flat = F.transform(F.flatten("cells"), lambda c: c["text"])
    widths = F.transform("cells", lambda r: F.size(r))
    begins = F.transform(F.sequence(F.lit(1), F.size("cells")), lambda k: F.aggregate(F.slice(widths, F.lit(1), k - 1), F.lit(0), lambda a, b: a + b))
    out = nodes.withColumn("_t", rendered_all(flat, form))
    grid = F.zip_with("cells", begins, lambda row, b: F.transform(row, lambda c, k: F.struct(F.element_at("_t", b + k + 1).alias("text"), c["is_header"].alias("is_header"), c["colspan"].alias("colspan"), c["rowspan"].alias("rowspan"))))
    return out.withColumn("grid", F.when(F.size("cells") > 0, grid)).drop("_t")


def _with_images(nodes: DataFrame) -> DataFrame:
    """Adds ``paths``, ``alts`` of the images that have a source; empty without."""
    if "images" not in nodes.columns:
        return nodes.withColumns({"paths": F.array().cast("array<string>"), "alts": F.array().cast("array<string>")})
    some = F.filter(F.coalesce("images", F.array().cast(nodes.schema["images"].dataType)), lambda i: F.coalesce(i["src"], F.lit("")) != "")
    return nodes.withColumns({"paths": F.transform(some, lambda i: i["src"]), "alts": F.transform(some, lambda i: F.coalesce(i["alt"], F.lit("")))})


def _items(nodes: DataFrame) -> DataFrame:
    """Rendered items of each list, in order: doc_id, parent_id, items."""
    own = nodes.filter(F.col("kind") == "list_item").select("doc_id", "parent_id", "pos", "inline")
    return own.groupBy("doc_id", "parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "inline"))), lambda x: x["inline"]).alias("items"))


def xhtml_blocks(nodes: DataFrame) -> DataFrame:
    """Adds ``block``: the markup of each top-level node. ``nodes``: doc_id,
    node_id, parent_id, pos, kind, level, text, attrs (map), and where there are
    tables and figures cells and images (src: a path below the book's assets)."""
    n = _with_images(_with_cells(nodes.withColumn("inline", rendered(F.col("text"), "xhtml")), "xhtml"))
    top = n.filter((F.col("kind") != "list_item") | F.col("parent_id").isNull())
    both = top.join(_items(n).withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left")
    h = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    listed = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    tag = F.when(F.try_element_at("attrs", F.lit("ordered")) == "true", "ol").otherwise("ul")
    language = F.try_element_at("attrs", F.lit("language"))
    plain = F.coalesce("text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        plain = F.replace(plain, F.lit(a), F.lit(b))

    def wrap(name: str, body: Column | str = "inline") -> Column:
        return F.concat(F.lit(f"<{name}>"), body if isinstance(body, Column) else F.col(body), F.lit(f"</{name.split()[0]}>"))

    kind = F.col("kind")
    block = (
        F.when(kind == "heading", F.concat(F.lit("<h"), h, F.lit(">"), F.col("inline"), F.lit("</h"), h, F.lit(">")))
        .when((kind == "paragraph") & (F.col("inline") != ""), wrap("p"))
        .when(kind == "quote", F.concat(F.lit("<blockquote><p>"), F.col("inline"), F.lit("</p></blockquote>")))
        .when(kind == "code", F.concat(F.lit("<pre><code"), F.coalesce(F.concat(F.lit(' class="language-'), language, F.lit('"')), F.lit("")), F.lit(">"), plain, F.lit("</code></pre>")))
        .when(kind == "list", F.concat(F.lit("<"), tag, F.lit(">"), listed, F.lit("</"), tag, F.lit(">")))
        .when(kind == "list_item", F.concat(F.lit("<ul><li>"), F.col("inline"), F.lit("</li></ul>")))
        .when(kind == "footnote", F.concat(F.lit('<aside epub:type="footnote">'), F.col("inline"), F.lit("</aside>")))
        .when(kind == "page_break", F.lit('<div style="page-break-after: always;"></div>'))
        .when(kind == "equation", F.concat(F.lit("<p>"), plain, F.lit("</p>")))
        .when(kind == "table", table_xhtml(F.coalesce("grid", F.array().cast(CELLS)), F.nullif("inline", F.lit(""))))
        .when(kind == "figure", figure_xhtml(F.col("paths"), F.col("alts"), F.col("inline"), F.try_element_at("attrs", F.lit("width_ratio")).cast("double")))
    )
    return both.withColumn("block", block).drop("inline", "items", "grid", "paths", "alts")


def typst_blocks(nodes: DataFrame) -> DataFrame:
    """As ``xhtml_blocks``, in Typst."""
    n = _with_images(_with_cells(nodes.withColumn("inline", rendered(F.col("text"), "typst")), "typst"))
    top = n.filter((F.col("kind") != "list_item") | F.col("parent_id").isNull())
    both = top.join(_items(n).withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left")
    kind, plain = F.col("kind"), F.coalesce("text", F.lit(""))
    mark = F.when(F.try_element_at("attrs", F.lit("ordered")) == "true", "+ ").otherwise("- ")
    listed = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.concat(mark, x)), "\n")
    block = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("="), F.coalesce("level", F.lit(1))), F.lit(" "), F.col("inline")))
        .when(kind == "paragraph", F.col("inline"))
        .when(kind == "quote", F.concat(F.lit("#quote(block: true)["), F.col("inline"), F.lit("]")))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce(F.try_element_at("attrs", F.lit("language")), F.lit("")), F.lit("\n"), F.replace(plain, F.lit("`"), F.lit("\\`")), F.lit("\n```")))
        .when(kind == "list", listed)
        .when(kind == "list_item", F.concat(F.lit("- "), F.col("inline")))
        .when(kind == "footnote", F.concat(F.lit("#footnote["), F.col("inline"), F.lit("]")))
        .when(kind == "page_break", F.lit("#pagebreak()"))
        .when(kind == "equation", F.concat(F.lit("$ "), plain, F.lit(" $")))
        .when(kind == "table", table_typst(F.coalesce("grid", F.array().cast(CELLS)), columns_of(F.transform("grid", lambda r: F.transform(r, lambda c: c["colspan"]))), F.nullif("inline", F.lit(""))))
        .when(kind == "figure", figure_typst(F.col("paths"), F.col("inline"), F.try_element_at("attrs", F.lit("width_ratio")).cast("double")))
    )
    return both.withColumn("block", block).drop("inline", "items", "grid", "paths", "alts")


def bodies(blocks: DataFrame, keys: list[str], glue: str) -> DataFrame:
    """One body per key: its blocks in order."""
    listed = blocks.filter(F.coalesce("block", F.lit("")) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return listed.select(*keys, F.array_join(F.transform("b", lambda x: x["block"]), glue).alias("body"))


def table_xhtml(cells: Column, caption: Column) -> Column:
    """array<array<struct<text, is_header, colspan, rowspan>>> as a table; texts are inline already."""

    def cell(c: Column) -> Column:
        tag = F.when(c["is_header"], "th").otherwise("td")
        spans = [F.when(c[s] > 1, F.concat(F.lit(f' {s}="'), c[s].cast("string"), F.lit('"'))).otherwise("") for s in ("colspan", "rowspan")]
        return F.concat(F.lit("<"), tag, *spans, F.lit(">"), c["text"], F.lit("</"), tag, F.lit(">"))

    rows = F.array_join(F.transform(cells, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "")
    head = F.coalesce(F.concat(F.lit("<caption>"), caption, F.lit("</caption>")), F.lit(""))
    return F.when(F.size(cells) > 0, F.concat(F.lit("<table>"), head, rows, F.lit("</table>"))).otherwise("")


def direction_of(lang: str | None) -> str:
    return "rtl" if (lang or "").replace("_", "-").split("-")[0].lower() in RTL_LANGUAGES else "ltr"


@dataclass(frozen=True)
class Typography:
    """How a book is set. Lengths in millimetres, points or multiples of the
    body size (em); the heading sizes are multiples of the body size, by level."""

    body_font: str = "serif"
    heading_font: str | None = None
    code_font: str = "monospace"
    body_size_pt: float = 11.0
    leading: float = 1.75
    justify: bool = True
    paragraph_indent_em: float = 0.0
    paragraph_spacing_em: float = 0.6
    heading_scale: tuple[float, ...] = (2.0, 1.6, 1.3, 1.15, 1.05, 1.0)
    margin_inner_mm: float = 22
    margin_outer_mm: float = 16
    margin_top_mm: float = 20
    margin_bottom_mm: float = 20
    page_size: str = "a5"
    running_heads: bool = False
    digit_style: str = "latin"
    font_files: tuple[str, ...] = ()

    @classmethod
    def of(cls, settings: dict) -> "Typography":
        """From settings by name; texts of numbers and flags are read as such."""
        known = {f.name: f for f in fields(cls)}
        out = {}
        for name, value in settings.items():
            if name in known and value is not None:
                default = known[name].default
                if isinstance(default, bool):
                    value = value if isinstance(value, bool) else str(value).lower() == "true"
                elif isinstance(default, (int, float)):
                    value = float(value)
                elif isinstance(default, tuple):
                    value = tuple(value)
                out[name] = value
        return cls(**out)

    def heading_sizes(self) -> list[tuple[int, float]]:
        return [(k, round(self.body_size_pt * scale, 2)) for k, scale in enumerate(self.heading_scale, 1)]


#: Widths and heights of page sizes in millimetres.
PAGES = {"a4": (210, 297), "a5": (148, 210), "b5": (176, 250), "letter": (215.9, 279.4), "trade": (152.4, 228.6)}


def _rule(selector: str, **properties: object) -> str:
    told = "; ".join(f"{name.replace('_', '-')}: {value}" for name, value in properties.items() if value is not None)
    return f"{selector} {{ {told}; }}"


def style_sheet(typography: dict, lang: str) -> str:
    """CSS of a book. Sides are logical (inline start and end), so nothing is
    mirrored by hand: the page's own direction does it."""
    t, side = Typography.of(typography), direction_of(lang)
    css = [f'@font-face {{ font-family: "{t.body_font}"; src: url("../fonts/{name}"); }}' for name in t.font_files]
    css.append(_rule("@page", margin_block=f"{t.margin_top_mm:g}mm {t.margin_bottom_mm:g}mm", margin_inline=f"{t.margin_inner_mm:g}mm {t.margin_outer_mm:g}mm"))
    css.append(_rule(":root", direction=side, font=f'{t.body_size_pt:g}pt/{t.leading:g} "{t.body_font}", serif'))
    css.append(_rule("p", margin_block=f"0 {t.paragraph_spacing_em:g}em", text_indent=f"{t.paragraph_indent_em:g}em", text_align="justify" if t.justify else "start"))
    css += [_rule(f"h{k}", font_size=f"{size:g}pt", break_after="avoid") for k, size in t.heading_sizes()]
    if t.heading_font:
        css.append(_rule(", ".join(f"h{k}" for k, _ in t.heading_sizes()), font_family=f'"{t.heading_font}", serif'))
    css.append(_rule("pre, code", font_family=f'"{t.code_font}", monospace', direction="ltr", unicode_bidi="isolate", white_space="pre-wrap"))
    css.append(_rule("a", unicode_bidi="isolate"))
    css.append(_rule("blockquote", margin_inline_start="2em"))
    css.append(_rule("img", max_width="100%"))
    css.append(_rule("figure, table", margin_block="1em", break_inside="avoid"))
    css.append(_rule("table", border_collapse="collapse", inline_size="100%"))
    css.append(_rule("td, th", border="thin solid", padding="0.3em", text_align="start"))
    if t.digit_style in COUNTERS:
        css.append(_rule("ol", list_style_type=COUNTERS[t.digit_style]))
    return "\n".join(css) + "\n"


#: List counters and Typst numberings of digit styles.
COUNTERS = {"persian": "persian", "arabic": "arabic-indic"}
NUMBERINGS = {"persian": "۱", "arabic": "١"}


def typst_preamble(typography: dict, lang: str) -> str:
    """What a Typst source sets ahead of its body."""
    t, side = Typography.of(typography), direction_of(lang)
    width, height = PAGES.get(t.page_size.lower(), PAGES["a5"])
    number = NUMBERINGS.get(t.digit_style, "1")
    head = ", header: context { let found = query(selector(heading.where(level: 1)).before(here())); if found.len() > 0 { align(center, found.last().body) } }" if t.running_heads else ""
    margin = ", ".join(f"{name}: {mm:g}mm" for name, mm in (("inside", t.margin_inner_mm), ("outside", t.margin_outer_mm), ("top", t.margin_top_mm), ("bottom", t.margin_bottom_mm)))
    font = ", ".join(f'"{f}"' for f in (t.body_font, "serif") if f)
    out = [
        f"#set page(width: {width:g}mm, height: {height:g}mm, margin: ({margin}), binding: {'right' if side == 'rtl' else 'left'}, numbering: \"{number}\"{head})",
        f"#set text(font: ({font},), size: {t.body_size_pt:g}pt, lang: \"{lang.replace('_', '-').split('-')[0]}\", dir: {side})",
        # Typst's leading is the space between lines, not their distance.
        f"#set par(leading: {max(t.leading - 1, 0):g}em, spacing: {max(t.leading - 1, 0) + t.paragraph_spacing_em:g}em, first-line-indent: {t.paragraph_indent_em:g}em, justify: {'true' if t.justify else 'false'})",
        f'#show raw: set text(font: "{t.code_font}", dir: ltr)',
    ]
    named = f'font: "{t.heading_font}", ' if t.heading_font else ""
    out += [f"#show heading.where(level: {k}): set text({named}size: {size:g}pt)" for k, size in t.heading_sizes()]
    if t.digit_style in NUMBERINGS:
        out.append(f'#set enum(numbering: "{number}.")')
    return "\n".join(out) + "\n"


def typst_sources(bodies_: DataFrame, typography: dict, lang: str) -> DataFrame:
    """Whole Typst sources: ``bodies_`` with ``source``, the settings and the body."""
    return bodies_.withColumn("source", F.concat(F.lit(typst_preamble(typography, lang) + "\n"), F.col("body"), F.lit("\n")))


def epub_file(title: str, lang: str, chapters: list[tuple[str, str]], css: str, identifier: str) -> bytes:
    """An EPUB of (title, body) chapters."""
    e, side = html.escape, direction_of(lang)
    page = lambda t, b: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{e(lang)}" dir="{side}"><head><title>{e(t)}</title><link rel="stylesheet" href="../style/book.css"/></head><body>{b}</body></html>'
    names = [f"chapters/chapter{k}.xhtml" for k in range(1, len(chapters) + 1)]
    nav = "".join(f'<li><a href="{n.split("/")[1]}">{e(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    items = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(names)))
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{e(identifier)}</dc:identifier><dc:title>{e(title)}</dc:title><dc:language>{e(lang)}</dc:language></metadata><manifest><item id="nav" href="chapters/nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style/book.css" media-type="text/css"/>{items}</manifest><spine page-progression-direction="{side}">{refs}</spine></package>'
    files = {"META-INF/container.xml": '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', "OEBPS/content.opf": opf, "OEBPS/style/book.css": css, "OEBPS/chapters/nav.xhtml": page(title, f'<nav epub:type="toc"><ol>{nav}</ol></nav>')}
    files |= {f"OEBPS/{n}": page(t, b) for n, (t, b) in zip(names, chapters, strict=True)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), "application/epub+zip")
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def epub_books(chapters: DataFrame, lang: str, css: str) -> DataFrame:
    """One row per book: doc_id, n_chapters, epub. ``chapters``: doc_id (string),
    chapter_no, title, body. A book's chapters are one group: as large as a book."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                docs, books = part["doc_id"].to_pylist(), part["parts"].to_pylist()
                files = [epub_file(parts[0]["title"], lang, [(x["title"], x["body"]) for x in parts], css, f"quire-{doc}") for doc, parts in zip(docs, books, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(map(len, books), pa.int32()), pa.array(files, pa.binary())], names=["doc_id", "n_chapters", "epub"])

    parts = F.array_sort(F.collect_list(F.struct("chapter_no", "title", "body")))
    return chapters.groupBy("doc_id").agg(parts.alias("parts")).mapInArrow(build, "doc_id string, n_chapters int, epub binary")


def figure_xhtml(paths: Column, alts: Column, caption: Column, width_ratio: Column) -> Column:
    """A figure of images (arrays of paths and alternative texts); without an
    image there is no figure. ``caption`` is inline markup already."""
    style = F.when((width_ratio > 0) & (width_ratio <= 1), F.concat(F.lit(' style="width:'), F.bround(width_ratio * 100, 1).cast("string"), F.lit('%"'))).otherwise("")
    images = F.array_join(F.transform(F.arrays_zip(paths.alias("p"), alts.alias("a")), lambda x: F.concat(F.lit('<img src="../assets/'), x["p"], F.lit('" alt="'), escape_html(F.coalesce(x["a"], F.lit(""))), F.lit('"'), F.coalesce(style, F.lit("")), F.lit("/>"))), "")
    below = F.coalesce(F.concat(F.lit("<figcaption>"), F.nullif(caption, F.lit("")), F.lit("</figcaption>")), F.lit(""))
    return F.when(F.size(paths) > 0, F.concat(F.lit("<figure>"), images, below, F.lit("</figure>"))).otherwise("")


def table_typst(cells: Column, columns: Column, caption: Column) -> Column:
    """A Typst table; texts are Typst markup already, the caption is escaped."""

    def cell(c: Column) -> Column:
        body = F.when(c["is_header"], F.concat(F.lit("*"), c["text"], F.lit("*"))).otherwise(c["text"])
        wide, high = (F.when(c[k] > 1, F.concat(F.lit(f"{k}: "), c[k].cast("string"))) for k in ("colspan", "rowspan"))
        span = F.when((c["colspan"] > 1) | (c["rowspan"] > 1), F.concat(F.lit("table.cell("), F.concat_ws(", ", wide, high), F.lit(")"))).otherwise("")
        return F.concat(span, F.lit("["), body, F.lit("]"))

    flat = F.flatten(F.transform(cells, lambda r: F.transform(r, cell)))
    table = F.concat(F.lit("table(columns: "), columns.cast("string"), F.lit(", "), F.array_join(flat, ", "), F.lit(")"))
    return F.when(F.size(cells) == 0, "").otherwise(F.coalesce(F.concat(F.lit("#figure("), table, F.lit(", caption: ["), caption, F.lit("])")), F.concat(F.lit("#"), table)))


def figure_typst(paths: Column, caption: Column, width_ratio: Column) -> Column:
    """One Typst figure of all images, side by side where there are several."""
    width = F.when((width_ratio > 0) & (width_ratio <= 1), F.concat(F.lit(", width: "), F.bround(width_ratio * 100, 1).cast("string"), F.lit("%"))).otherwise("")
    images = F.transform(paths, lambda p: F.concat(F.lit('image("assets/'), F.replace(p, F.lit('"'), F.lit('\\"')), F.lit('"'), F.coalesce(width, F.lit("")), F.lit(")")))
    body = F.when(F.size(paths) == 1, images[0]).otherwise(F.concat(F.lit("grid(columns: "), F.size(paths).cast("string"), F.lit(", "), F.array_join(images, ", "), F.lit(")")))
    below = F.coalesce(F.concat(F.lit(", caption: ["), F.nullif(caption, F.lit("")), F.lit("]")), F.lit(""))
    return F.when(F.size(paths) > 0, F.concat(F.lit("#figure("), body, below, F.lit(")"))).otherwise("")


def covers(books: DataFrame, translated: DataFrame) -> DataFrame:
    """Each book's cover: a translated one takes the place of its own.
    ``books``: doc_id, cover_asset_id; ``translated``: doc_id, asset_id."""
    return books.join(translated.select("doc_id", F.col("asset_id").alias("_t")), "doc_id", "left").withColumn("cover_asset_id", F.coalesce("_t", "cover_asset_id")).drop("_t")
