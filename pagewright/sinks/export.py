"""Pages and cells as Markdown, HTML, text and tagged text.

Exporters take an array of textline cells in order, so that a document is built without exploding; documents of several
pages are joined by export_documents in page order. Null arrays give empty text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import html_encode, is_blank, number_text, trim

_END = "[\\s]+$"


def _is_heading(c: Column) -> Column:
    return F.lower(F.coalesce(c["font_name"], F.lit(""))).contains("heading")


def _joined(cells: Column, one: Callable[[Column], Column], separator: str, test: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(F.coalesce(cells, F.filter(cells, lambda _: F.lit(False))), lambda c: ~is_blank(c["text"]) if test is None else test(c))
    return F.coalesce(F.array_join(F.transform(kept, one), separator), F.lit(""))


def markdown(cells: Column) -> Column:
    return F.regexp_replace(_joined(cells, lambda c: F.concat(F.when(_is_heading(c), "# ").otherwise(""), c["text"]), "\n\n"), _END, "")


def text(cells: Column) -> Column:
    return F.regexp_replace(_joined(cells, lambda c: c["text"], "\n"), _END, "")


def html_body(cells: Column) -> Column:
    def one(c: Column) -> Column:
        tag = F.when(_is_heading(c), "h1").otherwise("p")
        return F.concat(F.lit("  <"), tag, F.lit(">"), html_encode(c["text"]), F.lit("</"), tag, F.lit(">"))

    return _joined(cells, one, "\n", lambda c: ~is_blank(html_encode(c["text"])))


def html(cells: Column, title: Column) -> Column:
    return html_document(html_body(cells), title)


def html_document(body: Column, title: Column) -> Column:
    head = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n  <meta charset="utf-8" />\n  <title>'), html_encode(title), F.lit("</title>\n</head>\n<body>\n"))
    return F.concat(head, body, F.when(body == "", "").otherwise("\n"), F.lit("</body>\n</html>"))


def doctags_page(cells: Column, number: Column, rect: Column) -> Column:
    """One page element: number from 1, size, and each line with its lower left and upper right corner."""

    def one(c: Column) -> Column:
        corners = F.concat_ws(",", *[number_text(c["rect"][k]) for k in ("r_x0", "r_y0", "r_x2", "r_y2")])
        return F.concat(F.lit('    <text bbox="'), corners, F.lit('">'), html_encode(c["text"]), F.lit("</text>"))

    body = _joined(cells, one, "\n", lambda c: ~is_blank(html_encode(c["text"])))
    head = F.concat(F.lit('  <page num="'), number.cast("string"), F.lit('" width="'), number_text(rect["r_x2"]), F.lit('" height="'), number_text(rect["r_y2"]), F.lit('">'))
    return F.concat(head, F.lit("\n"), body, F.when(body == "", "").otherwise("\n"), F.lit("  </page>"))


def doctags_document(pages: Column) -> Column:
    return F.concat(F.lit("<document>\n"), pages, F.when(pages == "", "").otherwise("\n"), F.lit("</document>"))


def export_documents(pages: DataFrame, form: str, key: str = "doc_key", page_no: str = "page_no", cells: str = "cells", rect: str = "rect") -> DataFrame:
    """key, content: the pages of each document (key, page_no, cells, and rect for doctags) in the given form.
    Pages are rendered where they lie; only their text is shuffled."""
    c = F.col(cells)
    render = {"markdown": markdown, "text": text, "html": html_body}
    number = F.col(page_no) if form != "doctags" else F.col(page_no)
    body = doctags_page(c, number, F.col(rect)) if form == "doctags" else render[form](c)
    separator = {"markdown": "\n\n", "text": "\n", "html": "\n", "doctags": "\n"}[form]
    parts = pages.select(key, F.struct(F.col(page_no).alias("page_no"), body.alias("body")).alias("p"))
    whole = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["body"]), lambda b: b != ""), separator)
    out = parts.groupBy(key).agg(whole.alias("content"))
    if form == "html":
        return out.withColumn("content", html_document(F.col("content"), F.col(key).cast("string")))
    return out.withColumn("content", doctags_document(F.col("content"))) if form == "doctags" else out


def page_counts(pages: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, page_no, chars, words, lines of pages (char_cells, word_cells, textline_cells)."""
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda _: F.lit(True))), F.lit(0))
    return pages.select(key, "page_no", n("char_cells").alias("chars"), n("word_cells").alias("words"), n("textline_cells").alias("lines"))


def color_counts(pages: DataFrame, by: list[str]) -> DataFrame:
    """by, color, n: how often characters have each colour; those without one aren't counted."""
    c = pages.select(*by, F.explode("char_cells").alias("c")).where(F.col("c.rgba").isNotNull())
    color = F.concat(F.lit("rgba("), F.concat_ws(",", *[F.col(f"c.rgba.{k}").cast("string") for k in "rgba"]), F.lit(")"))
    return c.groupBy(*by, color.alias("color")).agg(F.count(F.lit(1)).alias("n"))


def extraction_report(pages: DataFrame, key: str = "doc_key") -> DataFrame:
    """key, content, pages, colors: the text of a document's pages, each under a header of its number, the counts of each
    page, and the colours of its characters."""
    texts = F.transform(F.filter("textline_cells", lambda c: c["text"].isNotNull()), lambda c: F.concat(F.regexp_replace(c["text"], _END, ""), F.lit("\n")))
    body = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.coalesce(F.array_join(texts, ""), F.lit("")), F.lit("\n"))
    parts = pages.select(key, F.struct("page_no", body.alias("body")).alias("p"))
    texts_ = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["body"]), "").alias("content"))
    counts = page_counts(pages, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("page_no").alias("page"), "chars", "words", "lines"))).alias("pages"))
    colors = color_counts(pages, [key]).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("color", "n")))).alias("colors"))
    return texts_.join(counts, key).join(colors, key, "left").withColumn("colors", F.coalesce("colors", F.create_map().cast("map<string,bigint>")))


def text_dump(pages: DataFrame, by: list[str]) -> DataFrame:
    """by, texts: the texts of a page's lines in order; nulls are left out."""
    return pages.select(*by, F.filter(F.transform("textline_cells", lambda c: c["text"]), lambda t: t.isNotNull()).alias("texts"))


def comparison_report(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """on and, of two sets of page_counts: left and right counts (0 where a side has no such page), and whether all agree."""
    names = ("chars", "words", "lines")
    a = left.select(*on, *[F.col(n).alias(f"left_{n}") for n in names])
    b = right.select(*on, *[F.col(n).alias(f"right_{n}") for n in names])
    both = a.join(b, on, "full_outer").na.fill(0, [f"{s}_{n}" for s in ("left", "right") for n in names])
    same = F.lit(True)
    for n in names:
        same = same & (F.col(f"left_{n}") == F.col(f"right_{n}"))
    return both.withColumn("equal", same)


def comparison_totals(report: DataFrame) -> DataFrame:
    """One row: pages, mismatches and the totals of both sides."""
    sums = [F.sum(f"{s}_{n}").alias(f"{s}_{n}") for s in ("left", "right") for n in ("chars", "words", "lines")]
    return report.agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("equal")).alias("mismatches"), *sums)


def data_uri(mimetype: Column, content: Column) -> Column:
    """The content of an image as a data URI, in one line."""
    return F.concat(F.lit("data:"), mimetype, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def _each_json(df: DataFrame, columns: list[str], out: str, change: Callable[..., str | None]) -> DataFrame:
    """df with out: change of the texts of columns, row by row in Arrow batches."""
    fields = [f for f in df.schema.fields if f.name != out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            made = pa.array([change(*row) for row in zip(*own)], pa.string())
            keep = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keep], made], names=[*keep, out])

    return df.mapInArrow(work, T.StructType([*fields, T.StructField(out, T.StringType())]))


def _rounded(v: object, digits: int) -> object:
    if isinstance(v, float):
        return round(v, digits)
    if isinstance(v, dict):
        return {k: _rounded(x, digits) for k, x in v.items()}
    return [_rounded(x, digits) for x in v] if isinstance(v, list) else v


def round_json(df: DataFrame, page_json: str = "page_json", out: str = "rounded", digits: int = 3) -> DataFrame:
    """df with out: the JSON with all its fractions rounded, at any depth, half to even of the exact binary value.
    Null and invalid JSON give null."""

    def change(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_rounded(json.loads(text), digits), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return _each_json(df, [page_json], out, change)


def _merged(raw: object, own: object) -> object:
    """own, with the members that only raw has."""
    if isinstance(raw, dict) and isinstance(own, dict):
        return {**{k: _merged(raw.get(k), v) for k, v in own.items()}, **{k: v for k, v in raw.items() if k not in own}}
    if isinstance(raw, list) and isinstance(own, list) and len(raw) == len(own):
        return [_merged(a, b) for a, b in zip(raw, own)]
    return own


def with_unknown_members(df: DataFrame, page_json: str, written: str, out: str = "json") -> DataFrame:
    """df with out: the JSON written from a typed page, with the members of the JSON it was read from that pages have no
    field for, at any depth. Where that is null or invalid, what was written."""

    def change(raw: str | None, own: str | None) -> str | None:
        try:
            return own if raw is None or own is None else json.dumps(_merged(json.loads(raw), json.loads(own)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return own

    return _each_json(df, [page_json, written], out, change)


__all__ = ["color_counts", "comparison_report", "comparison_totals", "data_uri", "doctags_page", "export_documents", "extraction_report", "html", "html_body", "markdown", "page_counts", "round_json", "text", "text_dump", "trim", "with_unknown_members"]
