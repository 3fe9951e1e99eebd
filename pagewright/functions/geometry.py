"""Boxes as columns: structs of l, b, r, t in a plane whose y axis points up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import col

X = ("r_x0", "r_x1", "r_x2", "r_x3")
Y = ("r_y0", "r_y1", "r_y2", "r_y3")


def box(l: Column, b: Column, r: Column, t: Column) -> Column:  # noqa: E741
    return F.struct(l.alias("l"), b.alias("b"), r.alias("r"), t.alias("t"))


def rect_box(rect: str | Column) -> Column:
    """The box around the four corners of an oriented rectangle."""
    c = col(rect)
    xs, ys = [c[x] for x in X], [c[y] for y in Y]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def box_rect(b: Column, origin: str = "BOTTOMLEFT") -> Column:
    parts = {"r_x0": b["l"], "r_y0": b["b"], "r_x1": b["r"], "r_y1": b["b"], "r_x2": b["r"], "r_y2": b["t"], "r_x3": b["l"], "r_y3": b["t"]}
    return F.struct(*[v.cast("double").alias(k) for k, v in parts.items()], F.lit(origin).alias("coord_origin"))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["r"] - b["l"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["t"] - b["b"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def overlaps_x(a: Column, b: Column) -> Column:
    return (a["l"] < b["r"]) & (b["l"] < a["r"])


def overlaps_y(a: Column, b: Column) -> Column:
    return (a["b"] < b["t"]) & (b["b"] < a["t"])


def overlaps(a: Column, b: Column) -> Column:
    return overlaps_x(a, b) & overlaps_y(a, b)


def intersection(a: Column, b: Column) -> Column:
    """The common box; all zeros where there is none."""
    zero = F.lit(0.0)
    own = box(F.greatest(a["l"], b["l"]), F.greatest(a["b"], b["b"]), F.least(a["r"], b["r"]), F.least(a["t"], b["t"]))
    return F.when(overlaps(a, b), own).otherwise(box(zero, zero, zero, zero))


def intersection_area(a: Column, b: Column) -> Column:
    return F.when(overlaps(a, b), (F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])) * (F.least(a["t"], b["t"]) - F.greatest(a["b"], b["b"]))).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    common = intersection_area(a, b)
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / union).otherwise(F.lit(0.0))


def over_self(a: Column, b: Column) -> Column:
    """The part of a that lies within b."""
    return F.when(area(a) > 0, intersection_area(a, b) / area(a)).otherwise(F.lit(0.0))


def left_of(a: Column, b: Column) -> Column:
    return a["r"] <= b["l"]


def above(a: Column, b: Column) -> Column:
    return a["b"] >= b["t"]


def same_box(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def union_box(*boxes: Column) -> Column:
    return box(F.least(*[x["l"] for x in boxes]), F.least(*[x["b"] for x in boxes]), F.greatest(*[x["r"] for x in boxes]), F.greatest(*[x["t"] for x in boxes]))


def flip(b: Column, page_height: Column) -> Column:
    """Between planes whose y axis points down and up."""
    return box(b["l"], page_height - b["t"], b["r"], page_height - b["b"])


def image_dpi(pixels: Column, box_width: Column) -> Column:
    return F.when(box_width > 0, F.round(pixels * 72 / box_width)).otherwise(72).cast("bigint")
