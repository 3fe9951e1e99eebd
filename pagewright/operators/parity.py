"""Differences between two sets of segmented pages.

Each page is reduced once to a signature: counts, hashes and means. Expected and actual signatures meet by one join on
the page, and every rule looks at the pair, so the pages themselves are read once and never joined.

Distributions are compared as hashes of the sorted keys, which are equal exactly if the histograms are.
Null pages count as pages without any key. Severities: critical, major, minor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, multiset_hash, rounded_text, sequence_hash, string_key, uri_part, utf16_length
from pagewright.functions.text import col as _col
from pagewright.schema import ARRAYS, FLAGS, PAGE, REQUIRED
from pagewright.session import quick_building

CELL_ARRAYS = ("char_cells", "word_cells", "textline_cells")
CORNERS = ("r_x0", "r_y0", "r_x1", "r_y1", "r_x2", "r_y2", "r_x3", "r_y3")
CRITICAL, MAJOR, MINOR = "critical", "major", "minor"


@dataclass(frozen=True)
class Options:
    """What is compared, with which tolerances and digits, and the severities that can be set."""

    tolerance: float = 0.001
    text_hashes: bool = True
    text_fields: bool = True
    text: str = MAJOR
    ocr: bool = True
    geometry_signatures: bool = True
    digits: int = 2
    geometry: str = MINOR
    fonts: bool = True
    confidence: bool = True
    confidence_tolerance: float = 0.001
    reading_order: bool = True
    bitmaps: bool = True
    widgets: bool = True
    hyperlinks: bool = True
    shapes: bool = True
    context_fields: bool = True
    context: str = MINOR


def _keys(items: Column, key: Callable[[Column], Column]) -> Column:
    return multiset_hash(F.transform(items, lambda c: F.coalesce(key(c), F.lit("_missing_"))))


def _count(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, lambda c: F.coalesce(test(c), F.lit(False))))


def _mean(items: Column, value: Callable[[Column], Column]) -> tuple[Column, Column]:
    own = F.filter(F.transform(items, value), lambda v: v.isNotNull())
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
    return F.size(own), F.try_divide(total, F.size(own))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("_missing_"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("_missing_")) for p in parts])


def _color(c: Column) -> Column:
    return F.when(c.isNull(), "_missing_").otherwise(F.concat_ws(",", *[_text(c[k]) for k in "rgba"]))


def _rect(r: Column, digits: int) -> Column:
    return F.when(r.isNull(), "_missing_").otherwise(_joined(*[rounded_text(r[k], digits) for k in CORNERS], string_key(r["coord_origin"])))


def _cells(a: Column, digits: int) -> dict[str, Column]:
    meaning = lambda c: _joined(_text(c["index"]), string_key(c["text"]), string_key(c["orig"]), string_key(c["text_direction"]), _text(c["rendering_mode"]), _text(c["widget"]), string_key(c["font_key"]), string_key(c["font_name"]), _color(c["rgba"]))
    index = F.transform(a, lambda c: c["index"])
    known = F.filter(index, lambda i: i.isNotNull())
    sure, mean = _mean(a, lambda c: c["confidence"])
    by_index = F.array_sort(F.transform(F.filter(a, lambda c: c["index"].isNotNull()), lambda c: F.struct(c["index"].alias("i"), meaning(c).alias("m"))))
    return {
        "text": sequence_hash(F.transform(a, lambda c: c["text"])),
        "direction": _keys(a, lambda c: string_key(c["text_direction"])),
        "mode": _keys(a, lambda c: _text(c["rendering_mode"])),
        "length": _keys(a, lambda c: utf16_length(c["text"]).cast("string")),
        "delta": _keys(a, lambda c: F.abs(utf16_length(c["text"]) - utf16_length(c["orig"])).cast("string")),
        "font_name": _keys(a, lambda c: string_key(c["font_name"])),
        "font_key": _keys(a, lambda c: string_key(c["font_key"])),
        "color": _keys(a, lambda c: _color(c["rgba"])),
        "widgets": _count(a, lambda c: c["widget"]),
        "with_text": _count(a, lambda c: ~is_blank(c["text"])),
        "with_orig": _count(a, lambda c: ~is_blank(c["orig"])),
        "equal": _count(a, lambda c: c["text"] == c["orig"]),
        "meaning": sequence_hash(F.transform(a, meaning)),
        "repeated": F.size(known) - F.size(F.array_distinct(known)),
        "unnumbered": F.size(index) - F.size(known),
        "map": sequence_hash(F.transform(by_index, lambda s: F.concat(s["i"].cast("string"), F.lit("="), s["m"]))),
        "ocr": _count(a, lambda c: c["from_ocr"]),
        "geometry": _keys(a, lambda c: _rect(c["rect"], digits)),
        "font": sequence_hash(F.transform(a, lambda c: _joined(string_key(c["font_key"]), string_key(c["font_name"])))),
        "sure": sure,
        "confidence": mean,
        "order": sequence_hash(F.transform(F.filter(known, lambda i: F.abs(i) < 2**31), lambda i: i.cast("string"))),
        "numbered": F.size(F.filter(known, lambda i: F.abs(i) < 2**31)),
    }


def _context(p: Column, digits: int) -> dict[str, Column]:
    number = lambda c: F.coalesce(rounded_text(c, digits), F.lit("_missing_"))
    b, w, h, s = p["bitmap_resources"], p["widgets"], p["hyperlinks"], p["shapes"]
    points = lambda x: F.array_join(F.transform(x, lambda q: F.array_join(F.transform(q, lambda v: number(v)), ",")), ";")
    wide, mean = _mean(s, lambda c: c["line_width"])
    return {
        "bitmap_resource_signature": _keys(b, lambda c: _joined(_rect(c["rect"], digits), string_key(c["uri"]), string_key(c["mode"]), string_key(c["image"]["mimetype"]), _text(c["image"]["dpi"]), number(c["image"]["size"]["width"]), number(c["image"]["size"]["height"]))),
        "widget_signature": _keys(w, lambda c: _joined(_rect(c["rect"], digits), string_key(c["widget_text"]), string_key(c["widget_description"]), string_key(c["widget_field_name"]), string_key(c["widget_field_type"]))),
        "hyperlink_signature": _keys(h, lambda c: _joined(_rect(c["rect"], digits), string_key(c["uri"]))),
        "shape_signature": _keys(s, lambda c: _joined(_text(c["parent_id"]), points(c["points"]), string_key(c["coord_origin"]), _text(c["has_graphics_state"]), number(c["line_width"]), number(c["miter_limit"]), _text(c["line_cap"]), _text(c["line_join"]), number(c["dash_phase"]), F.array_join(F.transform(c["dash_array"], number), ","), number(c["flatness"]), _color(c["rgb_stroking"]), _color(c["rgb_filling"]))),
        "bitmap_mode_distribution": _keys(b, lambda c: string_key(c["mode"])),
        "bitmap_mimetype_distribution": _keys(b, lambda c: string_key(c["image"]["mimetype"])),
        "bitmap_dpi_distribution": _keys(b, lambda c: _text(c["image"]["dpi"])),
        "widget_field_type_distribution": _keys(w, lambda c: string_key(c["widget_field_type"])),
        "widget_text_presence_count": _count(w, lambda c: ~is_blank(c["widget_text"])),
        "hyperlink_scheme_distribution": _keys(h, lambda c: uri_part(c["uri"], "PROTOCOL")),
        "hyperlink_host_distribution": _keys(h, lambda c: uri_part(c["uri"], "HOST")),
        "shape_graphics_state_count": _count(s, lambda c: c["has_graphics_state"]),
        "shape_line_width_mean": mean,
        "shape_widths": wide,
        "shape_point_count_distribution": _keys(s, lambda c: F.size(c["points"]).cast("string")),
        "shape_line_cap_distribution": _keys(s, lambda c: _text(c["line_cap"])),
        "shape_line_join_distribution": _keys(s, lambda c: _text(c["line_join"])),
        "shape_fill_color_distribution": _keys(s, lambda c: _color(c["rgb_filling"])),
        "shape_stroke_color_distribution": _keys(s, lambda c: _color(c["rgb_stroking"])),
    }


@quick_building()
def signatures(pages: DataFrame, on: list[str], page_json: str = "page_json", options: Options = Options()) -> DataFrame:
    """on and sig: one row per page. Narrow; the pages' JSON is checked once, read as a page once, and its top level once."""
    raw = F.coalesce(F.when(F.expr(f"try_parse_json({page_json})").isNotNull(), F.col(page_json)), F.lit("{}"))
    parsed = pages.select(*on, raw.alias("_raw")).withColumns({"_p": F.from_json("_raw", PAGE), "_top": F.from_json("_raw", "map<string,string>")})
    p = F.col("_p")
    there = {f"has_array_{a}": F.coalesce(F.try_element_at("_top", F.lit(a)).startswith("["), F.lit(False)) for a in ARRAYS}
    empty = {a: F.coalesce(p[a], F.array().cast(parsed.schema["_p"].dataType[a].dataType)) for a in ARRAYS}
    parts = [F.coalesce(F.map_keys("_top"), F.array().cast("array<string>")).alias("keys")]
    parts += [c.alias(n) for n, c in there.items()]
    parts += [F.size(empty[a]).alias(f"size_{a}") for a in ARRAYS]
    parts += [p[f].alias(f) for f in FLAGS]
    parts += [p["dimension"]["boundary_type"].alias("boundary"), p["dimension"]["rect"].alias("rect"), F.coalesce(F.try_element_at("_top", F.lit("dimension")).startswith("{"), F.lit(False)).alias("has_dimension")]
    parts += [F.struct(*[c.alias(n) for n, c in _cells(empty[a], options.digits).items()]).alias(a) for a in CELL_ARRAYS]
    full = F.struct(*[empty[a].alias(a) for a in ARRAYS])
    parts.append(F.struct(*[c.alias(n) for n, c in _context(full, options.digits).items()]).alias("context"))
    return parsed.select(*on, F.struct(*parts).alias("sig"))


def _rules(e: Column, a: Column, o: Options) -> list[Column]:
    """An array of (severity, code, message) per rule; nulls where a rule doesn't fire."""
    out: list[Column] = []

    def fire(when: Column, severity: str, code: str, message: str | Column) -> None:
        m = message if isinstance(message, Column) else F.lit(message)
        out.append(F.array(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), m.alias("message")))))

    def each(names: Column, severity: str, code: str) -> None:
        out.append(F.transform(names, lambda n: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), n.alias("message"))))

    required = F.array(*[F.lit(k) for k in REQUIRED])
    each(F.array_except(required, a["keys"]), CRITICAL, "missing_required_top_level_key")
    each(F.array_except(required, e["keys"]), CRITICAL, "missing_required_top_level_key_expected")
    each(F.array_except(e["keys"], a["keys"]), MAJOR, "missing_expected_top_level_key")
    each(F.array_except(a["keys"], e["keys"]), MINOR, "unexpected_top_level_key")
    for n in ARRAYS:
        fire(~e[f"has_array_{n}"], CRITICAL, "expected_array_missing", n)
        fire(~a[f"has_array_{n}"], CRITICAL, "actual_array_missing", n)
        fire(e[f"has_array_{n}"] & a[f"has_array_{n}"] & (e[f"size_{n}"] != a[f"size_{n}"]), MAJOR, "array_count_mismatch", n)
    for n in FLAGS:
        fire(e[n].isNull(), CRITICAL, "expected_boolean_missing", n)
        fire(a[n].isNull(), CRITICAL, "actual_boolean_missing", n)
        fire(e[n] != a[n], MAJOR, "boolean_mismatch", n)
    fire(~e["has_dimension"], CRITICAL, "expected_dimension_missing", "dimension")
    fire(~a["has_dimension"], CRITICAL, "actual_dimension_missing", "dimension")
    fire(e["boundary"] != a["boundary"], MINOR, "dimension_boundary_type_mismatch", "boundary_type")
    for k in CORNERS:
        fire(F.abs(e["rect"][k] - a["rect"][k]) > o.tolerance, MINOR, "dimension_rect_mismatch", k)
    for n in CELL_ARRAYS:
        x, y = e[n], a[n]
        ready = e[f"has_array_{n}"] & a[f"has_array_{n}"]

        def differs(key: str, severity: str, code: str, when: Column | None = None, n: str = n, x: Column = x, y: Column = y, ready: Column = ready) -> None:
            fire(ready & ~x[key].eqNullSafe(y[key]) & (F.lit(True) if when is None else when), severity, code, n)

        if o.text_hashes:
            differs("text", MAJOR, "text_hash_mismatch")
        if o.text_fields:
            for key, code in (("direction", "text_direction"), ("mode", "rendering_mode"), ("length", "text_length"), ("delta", "text_orig_length_delta"), ("font_name", "font_name"), ("font_key", "font_key"), ("color", "text_color")):
                differs(key, o.text, f"{code}_distribution_mismatch")
            for key, code in (("widgets", "widget_flag"), ("with_text", "text_presence"), ("with_orig", "orig_presence"), ("equal", "text_orig_equality")):
                differs(key, o.text, f"{code}_count_mismatch")
            differs("meaning", o.text, "text_semantic_sequence_mismatch")
            broken = (x["repeated"] > 0) | (y["repeated"] > 0) | (x["unnumbered"] > 0) | (y["unnumbered"] > 0)
            fire(ready & broken, o.text, "text_index_integrity_mismatch", n)
            differs("map", o.text, "text_index_value_map_mismatch", ~broken)
        if o.ocr:
            differs("ocr", MAJOR, "ocr_from_ocr_count_mismatch")
        if o.geometry_signatures:
            differs("geometry", o.geometry, "geometry_signature_mismatch")
        if o.fonts:
            differs("font", MAJOR, "font_signature_mismatch")
        if o.confidence:
            differs("sure", MAJOR, "confidence_value_count_mismatch")
            fire(ready & (x["sure"] == y["sure"]) & (F.abs(x["confidence"] - y["confidence"]) > o.confidence_tolerance), MINOR, "confidence_mean_mismatch", n)
        if n == "textline_cells" and o.reading_order:
            differs("numbered", MAJOR, "reading_order_index_count_mismatch")
            differs("order", MAJOR, "reading_order_index_mismatch", x["numbered"] == y["numbered"])
    x, y = e["context"], a["context"]
    signatures_ = {"bitmap_resource_signature": o.bitmaps, "widget_signature": o.widgets, "hyperlink_signature": o.hyperlinks, "shape_signature": o.shapes}
    fields = ("bitmap_mode_distribution", "bitmap_mimetype_distribution", "bitmap_dpi_distribution", "widget_field_type_distribution", "widget_text_presence_count", "hyperlink_scheme_distribution", "hyperlink_host_distribution", "shape_graphics_state_count", "shape_point_count_distribution", "shape_line_cap_distribution", "shape_line_join_distribution", "shape_fill_color_distribution", "shape_stroke_color_distribution")
    for code in [*[c for c, on in signatures_.items() if on], *(fields if o.context_fields else ())]:
        of = {"bitmap": "bitmap_resources", "widget": "widgets", "hyperlink": "hyperlinks", "shape": "shapes"}[code.split("_")[0]]
        fire(e[f"has_array_{of}"] & a[f"has_array_{of}"] & ~x[code].eqNullSafe(y[code]), o.context, f"{code}_mismatch", of)
    if o.context_fields:
        fire((x["shape_widths"] == y["shape_widths"]) & (x["shape_widths"] > 0) & (F.abs(x["shape_line_width_mean"] - y["shape_line_width_mean"]) > o.tolerance), o.context, "shape_line_width_mean_mismatch", "shapes")
    return out


@quick_building()
def compare(expected: DataFrame, actual: DataFrame, on: list[str], options: Options = Options(), by: list[str] | None = None) -> DataFrame:
    """on, by, severity, code, message: the differences of the pages of both sets; a page that only one set holds can't be
    compared, which is critical. by: columns of actual that tell several copies of a page apart; each is held against the
    one expected page."""
    by = by or []
    e, a = signatures(expected, on, options=options).withColumnRenamed("sig", "e"), signatures(actual, [*on, *by], options=options).withColumnRenamed("sig", "a")
    both = e.join(a, on, "full_outer")
    alone = F.when(F.col("e").isNull(), "no expected page").when(F.col("a").isNull(), "no actual page")
    lost = F.array(F.struct(F.lit(CRITICAL).alias("severity"), F.lit("decode_or_compare_failed").alias("code"), alone.alias("message")))
    found = F.when(alone.isNotNull(), lost).otherwise(F.filter(F.flatten(F.array(*_rules(F.col("e"), F.col("a"), options))), lambda d: d.isNotNull()))
    return both.select(*on, *by, F.explode(found).alias("d")).select(*on, *by, "d.severity", "d.code", "d.message")


def check_pages(expected: DataFrame, documents: DataFrame, doc: str = "doc_key", page: str = "page_no", pages: str = "page_count", failed: str | None = None) -> DataFrame:
    """Critical rows for expected pages whose document is absent, failed or too short."""
    e = expected.select(doc, page).distinct().join(documents, doc, "left")
    code = F.when(F.col(pages).isNull(), "regression_pdf_missing")
    if failed is not None:
        code = code.when(F.col(failed), "document_processing_failed")
    code = code.when((F.col(page) <= 0) | (F.col(page) > F.col(pages)), "page_number_out_of_range")
    return e.select(doc, page, F.lit(CRITICAL).alias("severity"), code.alias("code")).where("code is not null")


def _counts() -> list[Column]:
    by = lambda s: F.count_if(F.col("severity") == s)
    return [by(CRITICAL).alias("critical"), by(MAJOR).alias("major"), by(MINOR).alias("minor"), F.count_if(F.col("code").startswith("ocr_")).alias("ocr_drift")]


@dataclass(frozen=True)
class Thresholds:
    """The most differences that pass; None is no limit."""

    critical: int | None = 0
    major: int | None = 0
    minor: int | None = None
    ocr_drift: int | None = 0

    def passed(self) -> Column:
        ok = F.lit(True)
        for name in ("critical", "major", "minor", "ocr_drift"):
            if getattr(self, name) is not None:
                ok = ok & (F.col(name) <= getattr(self, name))
        return ok


def rollup(diffs: DataFrame, pages: DataFrame | None = None, doc: str = "doc_key", page: str = "page_no", thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Counts by severity, and of OCR drift, per page, document and corpus (level 0, 1, 2), and whether they pass.
    pages: all that were compared, so that those without any difference have rows too."""
    own = diffs.select(doc, page, "severity", "code")
    if pages is not None:
        own = own.unionByName(pages.select(doc, page).distinct(), allowMissingColumns=True)
    out = own.rollup(doc, page).agg(F.grouping_id().alias("level_bits"), *_counts())
    level = F.when(F.col("level_bits") == 0, 0).when(F.col("level_bits") == 1, 1).otherwise(2)
    return out.select(doc, page, level.alias("level"), "critical", "major", "minor", "ocr_drift", thresholds.passed().alias("passed"))


def gate(diffs: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """passed, and the corpus's counts: false if any exceeds its threshold."""
    return diffs.agg(*_counts()).withColumn("passed", thresholds.passed())


def discover(files: DataFrame, path: str = "path", documents: int | None = None, pages: int | None = None) -> DataFrame:
    """doc, page_no and path of files named <doc>.pdf.page_no_<n>.py.json: of the first documents by name, the first pages."""
    pattern = r"(?i)^(.+\.pdf)\.page_no_(\d+)\.py\.json$"
    name = F.regexp_extract(_col(path), r"([^/\\]*)$", 1)
    out = files.select(path, F.regexp_extract(name, pattern, 1).alias("doc"), F.expr("0").alias("_"), F.regexp_extract(name, pattern, 2).alias("n")).where("doc <> ''")
    out = out.select("doc", F.col("n").cast("int").alias("page_no"), path)
    if documents is not None:
        first = out.select("doc").distinct().orderBy("doc").limit(documents)
        out = out.join(F.broadcast(first), "doc")
    return out.orderBy("doc", "page_no") if pages is None else out.orderBy("doc", "page_no").limit(pages)
