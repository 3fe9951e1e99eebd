"""Documents of any format into segmented pages, by extension.

documents: doc_key, path, content (binary), and optionally format (a hint that wins over the path's extension). Plain
formats stay in the JVM; the others go through one parsing pass. A document that fails keeps its row with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.geometry import box, box_rect
from pagewright.functions.text import extension
from pagewright.schema import ARRAYS, BITMAP, ENVELOPE, PAGE
from pagewright.sources import files, plain
from pagewright.sources.layout import lay_out, page_struct

PLAIN = {
    **{e: plain.text_lines for e in (".txt", ".log", ".ini")},
    **{e: plain.markdown_lines for e in (".md", ".markdown", ".adoc", ".asciidoc")},
    **{e: plain.csv_lines for e in (".csv", ".tsv")},
    **{e: plain.latex_lines for e in (".tex", ".latex")},
}


def resolved_extension(path: str | Column, hint: Column | None = None) -> Column:
    """The hint, with or without its dot, else the path's extension; lower case."""
    own = extension(path)
    if hint is None:
        return own
    h = F.lower(F.trim(hint))
    return F.when(h.isNull() | (h == ""), own).when(h.startswith("."), h).otherwise(F.concat(F.lit("."), h))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_key, path, content of the files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return df.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("doc_key"), "path", "content")


def convert(documents: DataFrame, extra: dict[str, files.Parser] | None = None) -> DataFrame:
    """doc_key, page_no, page, error: one row per page; one row with page null and the error where a document failed."""
    hint = F.col("format") if "format" in documents.columns else None
    d = documents.select("doc_key", "content", resolved_extension("path", hint).alias("ext"))
    own = {e: f for e, f in PLAIN.items() if e not in (extra or {})}
    is_plain = F.col("ext").isin(*own)
    text = F.regexp_replace(F.decode(F.col("content"), "UTF-8"), "^\ufeff", "")
    lines = None
    for f in dict.fromkeys(own.values()):
        names = [e for e, g in own.items() if g is f]
        lines = F.when(F.col("ext").isin(*names), f(text)) if lines is None else lines.when(F.col("ext").isin(*names), f(text))
    a = d.where(is_plain).select("doc_key", F.lit(1).alias("page_no"), page_struct(lay_out(lines)).alias("page"), F.when(F.col("content").isNull(), F.lit("ValueError: no content")).alias("error"))
    a = a.withColumn("page", F.when(F.col("error").isNull(), F.col("page")))

    parsed = files.parse_files(d.where(~F.coalesce(is_plain, F.lit(False))), extra=extra)
    pages = parsed.select("doc_key", "ext", "width", "height", "error", F.posexplode_outer("pages").alias("pos", "p"))
    w, h = F.coalesce("width", F.lit(1000.0)), F.coalesce("height", F.lit(1000.0))
    mail = F.col("ext").isin(".eml", ".msg")
    cells = F.when(mail, lay_out(F.col("p.lines"), F.col("p.first"), gap_after=4)).otherwise(lay_out(F.col("p.lines"), F.col("p.first")))
    shown = ~(F.col("ext") == ".epub") | (F.size("p.lines") > 0)
    page = page_struct(cells, flags=F.when(F.col("width").isNotNull(), False).otherwise(shown), width=w, height=h)
    # an image is a page of its size that holds itself
    image = F.array(F.struct(F.lit(0).alias("index"), box_rect(box(F.lit(0.0), F.lit(0.0), w, h)).alias("rect"), F.lit("stream://image").alias("uri"), F.lit(None).alias("image"), F.lit("embedded").alias("mode"))).cast(f"array<{BITMAP}>")
    page = page.withField("bitmap_resources", F.when(F.col("width").isNotNull(), image).otherwise(page["bitmap_resources"]))
    b = pages.select("doc_key", (F.coalesce("pos", F.lit(0)) + 1).alias("page_no"), F.when(F.col("error").isNull(), page).alias("page"), "error")
    return a.unionByName(b)


#: Arrays that an envelope doesn't have beside its payloads.
_PAGE_ARRAYS = ("char_cells", "textline_cells", "shapes", "bitmap_resources")


def read_segmented(pages: DataFrame, page_json: str = "page_json") -> DataFrame:
    """pages with page, from segmented JSON or a decoded envelope (original, else sanitized; its images and cells become
    bitmaps and characters, words and lines are empty). An envelope has a payload and none of a page's own arrays.
    A lone object in place of an array is an array of one. Invalid JSON, and an envelope without payload, give null."""
    # a text that is cut would be read in part
    valid = F.try_parse_json(page_json).isNotNull()
    parsed = pages.withColumn("_json", F.when(valid, F.col(page_json))).withColumns({"_own": F.from_json("_json", PAGE), "_env": F.from_json("_json", ENVELOPE), "_keys": F.coalesce(F.json_object_keys("_json"), F.array().cast("array<string>"))})
    j, own, envelope, keys = F.col("_json"), F.col("_own"), F.col("_env"), F.col("_keys")
    has = lambda k: F.array_contains(keys, k)
    is_envelope = (has("original") | has("sanitized")) & ~F.arrays_overlap(keys, F.array(*[F.lit(k) for k in _PAGE_ARRAYS]))
    first = envelope["original"].isNotNull()
    e = lambda n: F.when(first, envelope["original"][n]).otherwise(envelope["sanitized"][n])
    kind = parsed.schema["_own"].dataType
    none = lambda n: F.array().cast(kind[n].dataType)

    def whole(c: Column, n: str, lone: Column) -> Column:
        """An array, or what a lone object in its place gives; looked at again only where no array could be read."""
        element = kind[n].dataType.elementType
        if not isinstance(element, T.StructType):
            return c
        return F.when(c.isNotNull(), c).otherwise(F.when(lone.startswith("{"), F.array(F.from_json(lone, element))))

    def some(n: str, name: str) -> Column:
        lone = F.when(first, F.get_json_object(j, f"$.original.{name}")).otherwise(F.get_json_object(j, f"$.sanitized.{name}"))
        return F.coalesce(whole(e(name), n, lone), none(n))

    page = F.struct(*[(whole(own[f.name], f.name, F.get_json_object(j, f"$.{f.name}")) if f.name in ARRAYS else own[f.name]).alias(f.name) for f in kind.fields])
    projected = F.struct(
        e("dimension").alias("dimension"),
        some("bitmap_resources", "images").alias("bitmap_resources"),
        some("char_cells", "cells").alias("char_cells"),
        none("word_cells").alias("word_cells"),
        none("textline_cells").alias("textline_cells"),
        F.lit(False).alias("has_chars"),
        F.lit(False).alias("has_words"),
        F.lit(False).alias("has_lines"),
        some("widgets", "widgets").alias("widgets"),
        some("hyperlinks", "hyperlinks").alias("hyperlinks"),
        none("lines").alias("lines"),
        some("shapes", "shapes").alias("shapes"),
    )
    payload = first | envelope["sanitized"].isNotNull()
    out = F.when(is_envelope, F.when(payload, projected)).when(own.isNotNull(), page)
    return parsed.withColumn("page", out).withColumn("page", F.when(is_envelope & F.col("page").isNotNull(), F.col("page").withField("has_chars", F.size("page.char_cells") > 0)).otherwise(F.col("page"))).drop("_json", "_own", "_env", "_keys")
