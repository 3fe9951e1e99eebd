"""Queries over text sources and exporters. The documents' texts stand for files of each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import SPACE, document_key, extension, slug
from pagewright.schema import PAGE
from pagewright.session import spread, table
from pagewright.sinks import export
from pagewright.sources import plain
from pagewright.sources.convert import convert, read_segmented
from pagewright.sources.files import html_lines
from pagewright.sources.layout import lay_out, page_json, page_struct


def _sql_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"


_LINES = f"[t for t in [{_sql_trim('x')} for x in regexp_split_to_array(text, '\\r\\n|\\r|\\n')] if t <> '']"
_PLACE = "1000.0 - 14.0 * pos - 12.0 AS b, 1000.0 - 14.0 * pos AS t"


def _cells_sql(lines: str, text: str = "line", font: str = "'BodyFont'") -> str:
    return (
        f"WITH d AS (SELECT doc_id, {lines} AS ls FROM documents WHERE text IS NOT NULL), "
        "e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d) "
        f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {text} AS text, {font} AS font, {_PLACE} FROM e"
    )


def _cells(spark: SparkSession, sf: str, lines: Column) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", lay_out(lines).alias("cells"))
    c = d.select("doc_id", F.explode("cells").alias("c"))
    return c.select("doc_id", F.col("c.index").alias("pos"), F.col("c.text").alias("text"), F.col("c.font_name").alias("font"), F.col("c.rect.r_y0").alias("b"), F.col("c.rect.r_y2").alias("t"))


def src_text_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, plain.text_lines("text"))


def src_markdown_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, plain.markdown_lines("text"))


def src_csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, plain.csv_lines("text"))


def src_latex_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf, plain.latex_lines("text"))


def src_xml_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell's text, escaped, within an element per word."""
    one = F.concat(F.lit("<doc><line>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" "), F.lit("</line><line>")), F.lit("</line></doc>"))
    valid = F.regexp_replace(one, "[^\\t\\n\\r\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")
    cells = table(spark, sf, "word_cells").where("text is not null").select("cell_id", "text").distinct()
    lines = cells.select("cell_id", F.posexplode(plain.xml_lines(valid)).alias("pos", "l"))
    return lines.select("cell_id", F.col("pos").cast("bigint").alias("pos"), F.col("l.text").alias("text"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    page = page_struct(lay_out(plain.markdown_lines("text")))
    return spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.lit(1).alias("page_no"), page.alias("page"))


def _export(form: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        pages = _pages(spark, sf).select("doc_id", "page_no", F.col("page.textline_cells").alias("cells"), F.col("page.dimension.rect").alias("rect"))
        return export.export_documents(pages, form, key="doc_id")

    query.__name__ = f"export_{form}"
    return query


def export_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Textline cells of decoded pages as one text per document, pages in order."""
    cells = table(spark, sf, "textline_cells").select("doc_key", "page_no", "cell_id", "cell_index", "text", "font_name").distinct()
    own = F.struct("cell_index", "cell_id", "text", "font_name")
    pages = cells.groupBy("doc_key", "page_no").agg(F.array_sort(F.collect_list(own)).alias("cells"))
    return export.export_documents(pages, "markdown")


def export_json(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages written as JSON and read back: their texts, and the place of their last line."""
    j = _pages(spark, sf).select("doc_id", page_json(F.col("page")).alias("json"))
    cells = F.from_json("json", PAGE)["textline_cells"]
    back = j.select("doc_id", F.size(F.json_object_keys("json")).cast("bigint").alias("keys"), cells.alias("c"))
    return back.select("doc_id", "keys", F.array_join(F.transform("c", lambda c: c["text"]), "\n").alias("texts"), F.coalesce(F.try_element_at("c", F.lit(-1))["rect"]["r_y0"], F.lit(0.0)).alias("last_b"))


def dispatch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "runs").groupBy(extension("file_path").alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def document_slugs(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "runs")
    return r.select("run_id", slug("doc_index", "file_path").alias("slug"), document_key("file_path", "run_id").alias("document_key"))


_NO_MARKS = "regexp_replace(line, '^#+', '')"
_MD_SQL = (
    f"WITH d AS (SELECT doc_id, {_LINES} AS ls FROM documents WHERE text IS NOT NULL), "
    "e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d), "
    f"h AS (SELECT doc_id, pos, starts_with(line, '#') AS h, CASE WHEN starts_with(line, '#') THEN {_sql_trim(_NO_MARKS)} ELSE line END AS x FROM e), "
    f"m AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN starts_with(x, '* ') OR starts_with(x, '- ') THEN {_sql_trim('substr(x, 3)')} ELSE x END AS text, CASE WHEN h THEN 'HeadingFont' ELSE 'BodyFont' END AS font FROM h) "
)
_SHOWN = f"regexp_matches(text, '[^{SPACE}]')"
_ENCODED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_HIGH = f"array_to_string([CASE WHEN ord(c) BETWEEN 160 AND 255 THEN '&#' || ord(c) || ';' ELSE c END for c in string_split({_ENCODED}, '')], '')"

QUERIES = {f.__name__: f for f in (src_text_cells, src_markdown_cells, src_csv_cells, src_latex_cells, src_xml_cells, _export("markdown"), _export("text"), _export("html"), _export("doctags"), export_lines, export_json, dispatch_counts, document_slugs)}
_NAME = "regexp_extract(file_path, '([^/\\\\]*)$', 1)"
_STEM = f"regexp_replace({_NAME}, '(.)\\.[^.]*$', '\\1')"
SQL = {
    "src_text_cells": _cells_sql(_LINES),
    "src_csv_cells": _cells_sql(f"[array_to_string(r, chr(32) || chr(9) || chr(32)) for r in [[{_sql_trim('f')} for f in string_split(x, ',')] for x in regexp_split_to_array(text, '\\r\\n|\\r|\\n')] if len([f for f in r if f <> '']) > 0]", font="''"),
    "src_latex_cells": _cells_sql(f"[t for t in [{_sql_trim('x')} for x in regexp_split_to_array(regexp_replace(regexp_replace(text, '\\[a-zA-Z]+\\{{.*?\\}}', '', 'g'), '\\[a-zA-Z]+', '', 'g'), '[\\r\\n]')] if t <> '']", font="''"),
    "src_markdown_cells": _MD_SQL + f"SELECT doc_id, pos, text, font, {_PLACE} FROM m",
    "export_markdown": _MD_SQL + f"SELECT d.doc_id, regexp_replace(coalesce(string_agg(CASE WHEN font = 'HeadingFont' THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY pos) FILTER ({_SHOWN}), ''), '\\s+$', '') AS content FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id",
    "export_text": _MD_SQL + f"SELECT d.doc_id, regexp_replace(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER ({_SHOWN}), ''), '\\s+$', '') AS content FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id",
    "export_html": _MD_SQL
    + f", t AS (SELECT doc_id, pos, CASE WHEN font = 'HeadingFont' THEN 'h1' ELSE 'p' END AS tag, {_HIGH} AS enc, text FROM m WHERE {_SHOWN} OR text LIKE '%' || chr(160) || '%'), "
    + "b AS (SELECT doc_id, string_agg('  <' || tag || '>' || enc || '</' || tag || '>', chr(10) ORDER BY pos) || chr(10) AS body FROM t GROUP BY doc_id) "
    + "SELECT d.doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '  <meta charset=\"utf-8\" />' || chr(10) || '  <title>' || d.doc_id || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || coalesce(body, '') || '</body>' || chr(10) || '</html>' AS content FROM d LEFT JOIN b ON d.doc_id = b.doc_id",
    "export_doctags": _MD_SQL
    + f", t AS (SELECT doc_id, string_agg('    <text bbox=\"10,' || CAST(1000 - 14 * pos - 12 AS BIGINT) || ',900,' || CAST(1000 - 14 * pos AS BIGINT) || '\">' || {_HIGH} || '</text>', chr(10) ORDER BY pos) || chr(10) AS body FROM m WHERE {_SHOWN} OR text LIKE '%' || chr(160) || '%' GROUP BY doc_id) "
    + "SELECT d.doc_id, '<document>' || chr(10) || '  <page num=\"1\" width=\"1000\" height=\"1000\">' || chr(10) || coalesce(body, '') || '  </page>' || chr(10) || '</document>' AS content FROM d LEFT JOIN t ON d.doc_id = t.doc_id",
    "export_lines": f"WITH c AS (SELECT DISTINCT doc_key, page_no, cell_id, cell_index, text, font_name FROM textline_cells) SELECT doc_key, regexp_replace(coalesce(string_agg(CASE WHEN lower(coalesce(font_name, '')) LIKE '%heading%' THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY page_no, cell_index, cell_id) FILTER ({_SHOWN}), ''), '\\s+$', '') AS content FROM c GROUP BY doc_key",
    "export_json": _MD_SQL + "SELECT d.doc_id, CAST(12 AS BIGINT) AS keys, coalesce(string_agg(text, chr(10) ORDER BY pos), '') AS texts, coalesce(1000.0 - 14.0 * max(pos) - 12.0, 0.0) AS last_b FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id",
    "dispatch_counts": "SELECT lower(regexp_extract(file_path, '(\\.[^./\\\\]*)$', 1)) AS ext, count(*) AS files FROM runs GROUP BY 1",
    "document_slugs": f"SELECT run_id, lpad(CAST(doc_index AS VARCHAR), 4, '0') || '-' || CASE WHEN s = '' THEN 'document' ELSE s END AS slug, regexp_replace(stem, '[ .]', '_', 'g') || '_' || run_id AS document_key FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(stem, '[^\\p{{L}}\\p{{Nd}}]', '_', 'g')), '_{{2,}}', '_', 'g'), '^_+', ''), '_+$', '') AS s FROM (SELECT *, {_STEM} AS stem FROM runs))",
    "src_xml_cells": f"WITH c AS (SELECT DISTINCT cell_id, text FROM word_cells WHERE text IS NOT NULL), w AS (SELECT cell_id, [t for t in [{_sql_trim('x')} for x in string_split(text, ' ')] if t <> ''] AS ls FROM c) SELECT cell_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS pos, unnest(ls) AS text FROM w",
}


def src_html_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of HTML in messages' raw text."""
    return _cells(spark, sf, html_lines("text"))


def src_mail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as .eml files: one page each, by number of cells and the first lines."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("doc_key"), F.lit("a.eml").alias("path"), F.encode("text", "UTF-8").alias("content"))
    cells = F.col("page.textline_cells")
    return convert(d).select("doc_key", "page_no", F.size(cells).alias("cells"), F.get(cells, F.lit(0))["text"].alias("first"), F.get(cells, F.lit(4))["rect"]["r_y2"].alias("body_top"), "error")


def src_segmented_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Segmented JSON and envelopes as typed pages, by their sizes."""
    p = read_segmented(table(spark, sf, "segmented_pages"))
    n = lambda c: F.coalesce(F.size(f"page.{c}"), F.lit(-1)).alias(c)
    return p.select("record_id", n("char_cells"), n("textline_cells"), n("shapes"), n("bitmap_resources"))


QUERIES.update({f.__name__: f for f in (src_html_cells, src_mail_pages, src_segmented_pages)})
