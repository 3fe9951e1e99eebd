"""Lines of text laid out on a page of fixed size, and pages as segmented JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.geometry import box, box_rect
from pagewright.schema import ARRAYS, BITMAP, LINK, SHAPE, SOURCE, WIDGET

#: The page and its lines (fixed values): size, distance of lines, height and sides of a line's box.
PAGE_SIZE, STEP, LINE_HEIGHT, LEFT, RIGHT = 1000.0, 14.0, 12.0, 10.0, 900.0
BODY, HEADING = "BodyFont", "HeadingFont"


def line(text: Column, font: Column | str | None = None) -> Column:
    return F.struct(text.alias("text"), (font if isinstance(font, Column) else F.lit(font)).cast("string").alias("font"))


def cell(index: Column, b: Column, text: Column, font: Column, confidence: Column | float = 1.0, source: Column | None = None) -> Column:
    black = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in (("r", 0), ("g", 0), ("b", 0), ("a", 255))])
    return F.struct(
        index.cast("bigint").alias("index"),
        black.alias("rgba"),
        box_rect(b).alias("rect"),
        text.alias("text"),
        text.alias("orig"),
        F.lit("left_to_right").alias("text_direction"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        F.lit(False).alias("from_ocr"),
        F.lit(0).cast("bigint").alias("rendering_mode"),
        F.lit(False).alias("widget"),
        F.lit("").alias("font_key"),
        F.coalesce(font, F.lit("")).alias("font_name"),
        (source if source is not None else F.lit(None)).cast(SOURCE).alias("source"),
    )


def lay_out(lines: Column, first_index: Column | int = 0, gap_after: int | None = None) -> Column:
    """Cells of an array of lines (text, font), from the top downwards without end. gap_after: so many lines, then one
    step more."""
    first = first_index if isinstance(first_index, Column) else F.lit(first_index)

    def place(x: Column, i: Column) -> Column:
        row = i if gap_after is None else i + F.when(i >= gap_after, 1).otherwise(0)
        top = F.lit(PAGE_SIZE) - row * F.lit(STEP)
        return cell(i + first, box(F.lit(LEFT), top - LINE_HEIGHT, F.lit(RIGHT), top), x["text"], x["font"])

    return F.transform(lines, place)


def page_struct(cells: Column, boundary: str = "crop_box", flags: bool | Column = True, width: Column | float = PAGE_SIZE, height: Column | float = PAGE_SIZE) -> Column:
    """A segmented page with the twelve keys, whose textline_cells are the cells."""
    w, h = [x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height)]
    whole = box(F.lit(0.0), F.lit(0.0), w.cast("double"), h.cast("double"))
    side = F.struct(F.lit(0.0).alias("l"), h.cast("double").alias("t"), w.cast("double").alias("r"), F.lit(0.0).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    dimension = F.struct(F.lit(0.0).alias("angle"), box_rect(whole).alias("rect"), F.lit(boundary).alias("boundary_type"), *[side.alias(f"{n}_bbox") for n in ("art", "bleed", "crop", "media", "trim")])
    empty = {"bitmap_resources": BITMAP, "widgets": WIDGET, "hyperlinks": LINK, "lines": "string", "shapes": SHAPE}
    none = F.filter(cells, lambda _: F.lit(False))
    flag = flags if isinstance(flags, Column) else F.lit(flags)
    arrays = {n: F.array().cast(f"array<{empty[n]}>") if n in empty else cells if n == "textline_cells" else none for n in ARRAYS}
    order = ["bitmap_resources", "char_cells", "word_cells", "textline_cells"]
    return F.struct(
        dimension.alias("dimension"),
        *[arrays[n].alias(n) for n in order],
        *[flag.alias(n) for n in ("has_chars", "has_words", "has_lines")],
        *[arrays[n].alias(n) for n in ("widgets", "hyperlinks", "lines", "shapes")],
    )


def page_json(page: Column) -> Column:
    """Segmented JSON with nulls written."""
    return F.to_json(page, {"ignoreNullFields": "false"})
