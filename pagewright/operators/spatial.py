"""Joins and groups of boxes on pages.

Boxes of one page meet through an equi-join on the page and an overlap condition, so the plan is a hash or merge join.
Pages with very many boxes can be cut into tiles: grid_join explodes each box to the tiles it touches, joins on the tile
and keeps a pair in the tile of its common lower left corner only, so no pair comes twice and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators.grouped import per_group


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], left: str = "a", right: str = "b", condition: Column | None = None) -> DataFrame:
    """Pairs of rows of the same page whose box columns left and right overlap. a and b share only the columns on."""
    both = a.join(b, on).where(g.overlaps(F.col(left), F.col(right)))
    return both if condition is None else both.where(condition)


#: Tiles or buckets that a row may stand in; what is larger goes another way.
MOST_TILES = 64


def grid_join(a: DataFrame, b: DataFrame, on: list[str], size: float, left: str = "a", right: str = "b") -> DataFrame:
    """overlap_join by tiles of the given size: for pages, or whole planes, with too many boxes for one key. A box that
    touches more than MOST_TILES tiles isn't exploded: it meets the other side by an overlap_join of its own."""

    def spans(box: str) -> tuple[Column, Column]:
        part = lambda lo, hi: F.floor(F.col(box)[hi] / size) - F.floor(F.col(box)[lo] / size) + 1
        return part("l", "r"), part("b", "t")

    def is_small(box: str) -> Column:
        w, h = spans(box)
        return F.coalesce((w <= MOST_TILES) & (h <= MOST_TILES) & (w * h <= MOST_TILES), F.lit(False))

    def tiles(box: str) -> Column:
        span = lambda lo, hi: F.sequence(F.floor(F.col(box)[lo] / size), F.greatest(F.floor(F.col(box)[lo] / size), F.floor(F.col(box)[hi] / size)))
        return F.flatten(F.transform(span("l", "r"), lambda x: F.transform(span("b", "t"), lambda y: F.struct(x.alias("x"), y.alias("y")))))

    ta = a.where(is_small(left)).withColumn("_tile", F.explode(tiles(left)))
    tb = b.where(is_small(right)).withColumn("_tile", F.explode(tiles(right)))
    both = ta.join(tb, [*on, "_tile"]).where(g.overlaps(F.col(left), F.col(right)))
    corner = F.struct(F.floor(F.greatest(F.col(left)["l"], F.col(right)["l"]) / size).alias("x"), F.floor(F.greatest(F.col(left)["b"], F.col(right)["b"]) / size).alias("y"))
    both = both.where(F.col("_tile") == corner).drop("_tile")
    large = overlap_join(a.where(~is_small(left)), b, on, left, right).unionByName(overlap_join(a.where(is_small(left)), b.where(~is_small(right)), on, left, right))
    return both.unionByName(large)


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of intervals that hold a point, ends included. Both sides meet in buckets of the given width, which should be
    about the intervals' usual length. An interval of more than MOST_TILES buckets stands instead in the at most
    MOST_TILES of a width that is larger by a power of MOST_TILES, and meets the points at that level."""
    usable = intervals.where(F.col(low) <= F.col(high))
    length = (F.col(high) - F.col(low)) / width
    level = F.when(length < MOST_TILES - 1, 0).otherwise(F.ceil(F.log(float(MOST_TILES), F.greatest(length, F.lit(1.0)) / (MOST_TILES - 2)))).cast("int")
    i = usable.withColumn("_level", level).withColumn("_width", F.lit(width) * F.pow(F.lit(float(MOST_TILES)), F.col("_level")))
    i = i.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / F.col("_width")), F.floor(F.col(high) / F.col("_width"))))).drop("_width")
    levels = [r["_level"] for r in i.select("_level").distinct().collect()]  # a few: they grow with the logarithm of the longest
    p = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")))
    p = p.withColumn("_bucket", F.floor(F.col(point) / (F.lit(width) * F.pow(F.lit(float(MOST_TILES)), F.col("_level")))))
    return p.join(i, [*on, "_level", "_bucket"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bucket", "_level")


def best_match(cells: DataFrame, clusters: DataFrame, on: list[str], cell_id: str, order: str, cell_box: str = "a", cluster_box: str = "b", least: float = 0.2) -> DataFrame:
    """For each cell the cluster that holds the largest part of it, above least; of equal ones the first by order.
    Partial aggregation keeps one candidate per cell before the shuffle."""
    part = g.over_self(F.col(cell_box), F.col(cluster_box))
    both = overlap_join(cells, clusters, on, cell_box, cluster_box).withColumn("part", part).where(F.col("part") > least)
    keep = [c for c in both.columns if c not in (*on, cell_id)]
    best = F.min_by(F.struct(*keep), F.struct(-F.col("part"), F.col(order)))
    return both.groupBy(*on, cell_id).agg(best.alias("m")).select(*on, cell_id, "m.*")


def unmatched(cells: DataFrame, matched: DataFrame, on: list[str]) -> DataFrame:
    return cells.join(matched.select(*on).distinct(), on, "left_anti")


def contained(a: DataFrame, b: DataFrame, on: list[str], left: str = "a", right: str = "b", least: float = 0.8) -> DataFrame:
    """Pairs where more than least of the left box lies within the right one."""
    return overlap_join(a, b, on, left, right, g.over_self(F.col(left), F.col(right)) > least)


def union_boxes(df: DataFrame, by: list[str], box: str = "a") -> DataFrame:
    """The box around all boxes of a group."""
    c = F.col(box)
    return df.groupBy(*by).agg(F.min(c["l"]).alias("l"), F.min(c["b"]).alias("b"), F.max(c["r"]).alias("r"), F.max(c["t"]).alias("t"))


def first_by_index(df: DataFrame, by: list[str], index: str, order: str) -> DataFrame:
    """The first row of each index, by order."""
    w = Window.partitionBy(*by, index).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


class Forest:
    """Disjoint sets over positions, by rank with halved paths."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.rank = [0] * n

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.parent[b] = a
        self.rank[a] += self.rank[a] == self.rank[b]

    def groups(self) -> list[list[int]]:
        """Members of each set, sets and members in order of insertion."""
        out: dict[int, list[int]] = {}
        for i in range(len(self.parent)):
            out.setdefault(self.find(i), []).append(i)
        return list(out.values())


def overlapping_pairs(l: np.ndarray, b: np.ndarray, r: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int]]:  # noqa: E741
    """Pairs of positions i < j of overlapping boxes: of a few at once, of many by a sweep over l."""
    if len(l) <= 512:
        meet = (l[:, None] < r[None]) & (l[None] < r[:, None]) & (b[:, None] < t[None]) & (b[None] < t[:, None])
        yield from zip(*(x.tolist() for x in np.nonzero(np.triu(meet, 1))))
        return
    order = np.argsort(l, kind="stable")
    left = l[order]
    for at, i in enumerate(order):
        upto = np.searchsorted(left, r[i], "left")
        near = order[at + 1 : upto]
        for j in near[(b[i] < t[near]) & (b[near] < t[i]) & (l[i] < r[near])]:
            yield (int(i), int(j)) if i < j else (int(j), int(i))


def components(df: DataFrame, on: list[str], id: str, box: str = "a") -> DataFrame:
    """on, id, component: the connected components of overlapping boxes of each page; a component is named by its least id.
    Pages bound the groups."""
    own = df.select(*on, id, *[F.col(box)[k].cast("double").alias(f"_{k}") for k in "lbrt"])

    def work(page: dict) -> tuple:
        ids = page[id]
        sets = Forest(len(ids))
        for i, j in overlapping_pairs(*[page[f"_{k}"] for k in "lbrt"]):
            sets.union(i, j)
        first: dict[int, Any] = {}
        roots = [sets.find(i) for i in range(len(ids))]  # in the order of ids
        for r, i in zip(roots, ids):
            first.setdefault(r, i)
        return ([first[r] for r in roots],)

    return per_group(own, on, [id], work, f"component {own.schema[id].dataType.simpleString()}").select(*on, id, "component")
