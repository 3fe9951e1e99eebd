"""Reading order of a page's elements, from what lies above what.

An element follows another if it lies strictly below it, overlaps it sideways and nothing stands between. Elements are
then widened a little towards their neighbours, the relation is drawn again, and the page is walked from its heads
downwards, climbing first to whatever above is still unread. Headers come first and footers last.

Elements that don't differ in the order of heads (page, then the higher of overlapping ones, then the left one) keep the
order of the input: the comparison isn't transitive, so the sort is stable by definition here.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
from pyspark.sql import DataFrame

from pagewright.operators.grouped import per_group

#: Share of the page's width by which an element may grow to each side, and slack of the search (fixed values).
GROW, SLACK = 0.15, 0.1


#: Elements whose relation to all others is drawn at once.
STRIP = 512


def _relation(box: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """For each element those above it and those below it, in input order. An element between i and j is below i, above j
    and beside none of them sideways; so for i only the highest element below counts, and for j the lowest above."""
    l, b, r, t = box.T  # noqa: E741
    n = len(box)
    flat = t <= b  # an element without height stands between others only if it is strictly so
    strips = [slice(i, min(n, i + STRIP)) for i in range(0, n, STRIP)]
    top = [np.full(n, -np.inf), np.full(n, -np.inf)]  # of those below i: the highest lower edge, by flat
    low = [np.full(n, np.inf), np.full(n, np.inf)]  # of those above j: the lowest upper edge, by flat
    edges = []
    for s in strips:
        side = (l[s, None] < r[None]) & (l[None] < r[s, None])
        higher = b[s, None] >= t[None]  # i of the strip strictly above j
        below = higher & side & (b[None] < b[s, None])
        over = higher & side & (t[None] < t[s, None])
        for kind in (0, 1):
            k = flat if kind else ~flat
            top[kind][s] = np.where(below & k[None], b[None], -np.inf).max(axis=1)
            if k[s].any():
                low[kind] = np.minimum(low[kind], np.where(over & k[s, None], t[s, None], np.inf).min(axis=0))
        reach = (l[s, None] < (r + SLACK)[None]) & ((l - SLACK)[None] < r[s, None]) & (t[s, None] > t[None])
        i, j = np.nonzero(reach & higher & side)
        edges.append((i + s.start, j))
    i, j = (np.concatenate(x) for x in zip(*edges))
    free = (i != j) & (top[0][i] < t[j]) & (top[1][i] <= t[j]) & (low[0][j] > b[i]) & (low[1][j] >= b[i])
    up: list[list[int]] = [[] for _ in range(n)]
    down: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(i[free].tolist(), j[free].tolist()):
        down[x].append(y)
        up[y].append(x)
    return up, down


def _sorted(members: list[int], box: np.ndarray) -> list[int]:
    def compare(i: int, j: int) -> int:
        a, c = box[i], box[j]
        if a[0] < c[2] and c[0] < a[2]:
            return int(np.sign(c[1] - a[1]))
        return int(np.sign(a[0] - c[0]))

    return sorted(members, key=cmp_to_key(compare))


def order_of(box: np.ndarray, page_width: float) -> list[int]:
    """Positions in reading order of boxes (l, b, r, t)."""
    if not len(box):
        return []
    box = np.array(box, float)
    up, down = _relation(box)
    most = GROW * page_width
    wide = box.copy()
    for i in range(len(box)):
        for near in (up[i][:1], down[i][:1]):
            for k in near:
                lo, hi = min(wide[i, 0], box[k, 0]), max(wide[i, 2], box[k, 2])
                if wide[i, 0] - lo <= most and hi - wide[i, 2] <= most:
                    wide[i, 0], wide[i, 2] = lo, hi
    up, down = _relation(wide)
    heads = _sorted([i for i, above in enumerate(up) if not above], wide)
    down = [_sorted(d, wide) for d in down]
    read, out = [False] * len(box), []

    def visit(i: int) -> None:
        read[i] = True
        out.append(i)

    for head in heads:
        if read[head]:
            continue
        visit(head)
        stack = [iter(down[head])]
        while stack:
            i = next(stack[-1], None)
            if i is None:
                stack.pop()
                continue
            while (above := next((k for k in up[i] if not read[k]), None)) is not None:
                i = above
            if not read[i]:
                visit(i)
                stack.append(iter(down[i]))
    return out


def reading_order(elements: DataFrame, on: list[str]) -> DataFrame:
    """elements with order, their place on the page from 0. elements: on, pos, label, l, b, r, t, page_width."""

    def work(page: dict) -> tuple:
        box = np.column_stack([page[k] for k in "lbrt"]).astype(float)
        label = np.array([x or "" for x in page["label"]], dtype=object)
        place = np.zeros(len(box), dtype="int32")
        at = 0
        header, footer = label == "page_header", label == "page_footer"
        for part in (header, ~(header | footer), footer):
            rows = np.flatnonzero(part)
            if len(rows):
                own = rows[order_of(box[rows], float(page["page_width"][rows[0]]))]
                place[own] = np.arange(at, at + len(own))
                at += len(own)
        return (place,)

    return per_group(elements, on, ["pos"], work, "order int")
