"""Layout post-processing: clusters of a page cleaned of overlaps and given their cells.

One page at a time, within grouped workers; pages bound the groups. Boxes of a page are rows of one array, so overlap
tests are whole-array operations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pagewright.operators.grouped import per_group
from pagewright.operators.spatial import Forest

#: Labels in the order of the detector's classes (fixed values).
LABELS = ("caption", "footnote", "formula", "list_item", "page_footer", "page_header", "picture", "section_header", "table", "text", "title", "document_index", "code", "checkbox_selected", "checkbox_unselected", "form", "key_value_region")
#: Labels of clusters that hold others, and those of them that aren't pictures (fixed values).
SPECIAL = ("form", "key_value_region", "table", "document_index", "picture")
WRAPPERS = ("form", "key_value_region", "table", "document_index")
#: Least confidence by label (fixed values); labels not listed need none.
CONFIDENCE = {
    "caption": 0.5, "footnote": 0.5, "formula": 0.5, "list_item": 0.5, "page_footer": 0.5, "page_header": 0.5, "picture": 0.5, "section_header": 0.45,
    "table": 0.5, "text": 0.5, "title": 0.45, "code": 0.45, "checkbox_selected": 0.45, "checkbox_unselected": 0.45, "form": 0.45, "key_value_region": 0.45, "document_index": 0.45,
}
RELABEL = {"title": "section_header"}
#: By kind of cluster: largest ratio of areas and least difference of confidence at which the surer one is kept (fixed values).
PREFERENCE = {"regular": (1.3, 0.05), "picture": (2.0, 0.3), "wrapper": (2.0, 0.2)}
OVERLAP, CONTAINED, ASSIGN, WHOLE_PAGE = 0.8, 0.8, 0.2, 0.9


def _area(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, x[..., 2] - x[..., 0]) * np.maximum(0, x[..., 3] - x[..., 1])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of intersection of all boxes x with all boxes y (l, b, r, t)."""
    a, b = x[:, None], y[None]
    w = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    h = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    return np.where((w > 0) & (h > 0), w * h, 0.0)


def _share(common: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.divide(common, own, out=np.zeros_like(common), where=own > 0)


class Page:
    """A page's clusters as columns, in their order; members are lists of positions of cells."""

    def __init__(self, ids: list[int], labels: list[str], boxes: np.ndarray, confidence: np.ndarray, cells: np.ndarray, index: np.ndarray, texts: list, cell_confidence: np.ndarray, page_area: float, assign: bool = True, keep_empty: bool = False, orphans: bool = True) -> None:
        self.ids, self.labels, self.box, self.sure = list(ids), list(labels), np.array(boxes, float).reshape(-1, 4), np.array(confidence, float)
        self.cells, self.index, self.cell_sure = np.array(cells, float).reshape(-1, 4), np.array(index), cell_confidence
        self.shown = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        self.page_area, self.assign, self.keep_empty, self.orphans = page_area, assign, keep_empty, orphans
        self.first = {i: self.box[p].copy() for p, i in enumerate(self.ids)}  # the index is built from these and never renewed
        self.members: list[list[int]] = [[] for _ in self.ids]
        self.children: dict[int, list[int]] = {}

    def once(self, members: list[int]) -> list[int]:
        """Cells by first use of their index."""
        return list({self.index[m]: m for m in reversed(members)}.values())[::-1]

    def by_index(self, members: list[int]) -> list[int]:
        return sorted(members, key=lambda m: self.index[m])

    def _surer(self, positions: list[int]) -> list[int]:
        return [p for p in positions if self.sure[p] >= CONFIDENCE.get((self.labels[p] or "").lower(), 0.0)]

    def _take_cells(self, own: list[int]) -> None:
        for p in own:
            self.members[p] = []
        cells = [m for m in self.shown if _area(self.cells[m]) > 0]
        if cells and own:
            part = _share(_common(self.cells[cells], self.box[own]), _area(self.cells[cells])[:, None])
            best = part.argmax(axis=1)  # the first of equal ones
            for m, row, k in zip(cells, part, best):
                if row[k] > ASSIGN:
                    self.members[own[k]].append(m)
        for p in own:
            self.members[p] = self.once(self.members[p])

    def _add_orphans(self, own: list[int]) -> list[int]:
        taken = {self.index[m] for p in own for m in self.members[p]}
        left = [m for m in self.shown if self.index[m] not in taken]
        following = max(self.ids, default=0) + 1
        for n, m in enumerate(left):
            self.ids.append(following + n)
            self.labels.append("text")
            self.box = np.vstack([self.box, self.cells[m]])
            self.sure = np.append(self.sure, self.cell_sure[m])
            self.members.append([m])
        return own + list(range(len(self.ids) - len(left), len(self.ids)))

    def _shrink(self, own: list[int]) -> None:
        for p in own:
            if self.members[p]:
                c = self.cells[self.members[p]]
                around = np.array([c[:, 0].min(), c[:, 1].min(), c[:, 2].max(), c[:, 3].max()])
                if self.labels[p] == "table":
                    around = np.append(np.minimum(around[:2], self.box[p][:2]), np.maximum(around[2:], self.box[p][2:]))
                self.box[p] = around

    def _merge(self, own: list[int], kind: str) -> list[int]:
        """One cluster of each group of overlapping ones; it takes the others' cells."""
        if len(own) < 2:
            return own
        now = self.box[own]
        listed = np.array([self.ids[p] in self.first for p in own])
        then = np.array([self.first.get(self.ids[p], np.zeros(4)) for p in own])
        near = _common(now, then) > 0
        for side in (0, 2):
            near |= (then[None, :, 0] <= now[:, None, side]) & (now[:, None, side] <= then[None, :, 2])
        for side in (1, 3):
            near |= (then[None, :, 1] <= now[:, None, side]) & (now[:, None, side] <= then[None, :, 3])
        near &= listed[None]
        common, area = _common(now, now), _area(now)
        union = area[:, None] + area[None] - common
        apart = _share(common, np.broadcast_to(area[:, None], common.shape))
        alike = (_share(common, union) > OVERLAP) | (apart > CONTAINED) | (apart.T > CONTAINED)
        alike &= (area[:, None] > 0) & (area[None] > 0)
        sets = Forest(len(own))
        for i, j in zip(*np.nonzero(near & alike)):
            if i != j:
                sets.union(int(i), int(j))
        out = []
        for group in sets.groups():
            members = [own[g] for g in group]
            best = members[0] if len(members) == 1 else self._best(members, *PREFERENCE[kind])
            if len(members) > 1:
                cells = self.members[best] + [m for p in members if p != best for m in self.members[p]]
                self.members[best] = self.by_index(self.once(cells))
            out.append(best)
        return out

    def _prefers(self, a: int, b: int, ratio_limit: float, margin: float) -> bool:
        area = _area(self.box)
        ratio = area[a] / area[b] if area[b] > 0 else np.inf
        if self.labels[a] == "list_item" and self.labels[b] == "text" and abs(1 - ratio) < 0.2:
            return True
        if self.labels[a] == "code" and area[b] > 0 and _common(self.box[[b]], self.box[[a]])[0, 0] / area[b] > CONTAINED:
            return True
        return not (ratio <= ratio_limit and self.sure[b] - self.sure[a] > margin)

    def _best(self, members: list[int], ratio_limit: float, margin: float) -> int:
        fit = [a for a in members if all(self._prefers(a, b, ratio_limit, margin) for b in members if b != a)]
        if not fit:
            return members[0]
        best, area = fit[0], _area(self.box)
        for a in fit[1:]:
            if area[a] > area[best] and self.sure[best] - self.sure[a] <= margin:
                best = a
        return best

    def _in_order(self, own: list[int]) -> list[int]:
        def key(p: int) -> tuple:
            least = min((self.index[m] for m in self.members[p]), default=np.iinfo(np.int64).max)
            return least, -self.box[p][3], self.box[p][0]

        return sorted(own, key=key)

    def run(self) -> list[int]:
        regular = self._surer([p for p, x in enumerate(self.labels) if x not in SPECIAL])
        special = self._surer([p for p, x in enumerate(self.labels) if x in SPECIAL])
        for p in regular:
            self.labels[p] = RELABEL.get(self.labels[p], self.labels[p])
        if self.assign:
            self._take_cells(regular)
            if not self.keep_empty:
                regular = [p for p in regular if self.members[p] or self.labels[p] == "formula"]
            if self.orphans:
                regular = self._add_orphans(regular)
        for _ in range(3):
            before = len(regular)
            self._shrink(regular)
            regular = self._merge(regular, "regular")
            if len(regular) == before:
                break
        if self.page_area > 0:
            special = [p for p in special if self.labels[p] != "picture" or _area(self.box[p]) / self.page_area <= WHOLE_PAGE]
        for s in special:
            if not regular:
                continue
            inside = _share(_common(self.box[regular], self.box[[s]])[:, 0], _area(self.box[regular]))
            held = self._in_order([p for p, x in zip(regular, inside) if x > CONTAINED])
            if held:
                self.children[s] = held
                if self.labels[s] in ("form", "key_value_region"):
                    c = self.box[held]
                    self.box[s] = [c[:, 0].min(), c[:, 1].min(), c[:, 2].max(), c[:, 3].max()]
                self.members[s] = self.by_index(self.once([m for p in held for m in self.members[p]])) if self.assign else []
        special = self._merge([p for p in special if self.labels[p] == "picture"], "picture") + self._merge([p for p in special if self.labels[p] in WRAPPERS], "wrapper")
        held = {c for s in special for c in self.children.get(s, [])}
        final = self._in_order([p for p in regular if p not in held] + special)
        for p in final:
            self.members[p] = self.by_index(self.members[p])
        return final


_OUT = "pos int, id int, label string, l double, b double, r double, t double, confidence double, cells array<bigint>, children array<int>"


def postprocess(clusters: DataFrame, cells: DataFrame, pages: DataFrame, on: list[str], **options: bool) -> DataFrame:
    """on, pos, id, label, l, b, r, t, confidence, cells (their index), children (their id): the final clusters in order.

    clusters: on, pos, id, label, l, b, r, t, confidence; cells: on, pos, index, text, l, b, r, t, confidence;
    pages: on, page_width, page_height. Pages without clusters get those of their cells."""
    from pyspark.sql import functions as F

    kinds = ["kind", "pos", "id", "index", "label", "text", "l", "b", "r", "t", "confidence"]
    n = lambda t: F.lit(None).cast(t)
    a = clusters.select(*on, F.lit("c").alias("kind"), "pos", F.col("id").cast("int").alias("id"), n("bigint").alias("index"), "label", n("string").alias("text"), "l", "b", "r", "t", "confidence")
    b = cells.select(*on, F.lit("t").alias("kind"), "pos", n("int").alias("id"), "index", n("string").alias("label"), "text", "l", "b", "r", "t", "confidence")
    p = pages.select(*on, F.lit("p").alias("kind"), F.lit(0).alias("pos"), n("int").alias("id"), n("bigint").alias("index"), n("string").alias("label"), n("string").alias("text"), F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), F.col("page_width").alias("r"), F.col("page_height").alias("t"), n("double").alias("confidence"))
    every = a.unionByName(b).unionByName(p).select(*on, *kinds)

    def work(page: dict) -> tuple:
        kind = np.array(page["kind"], dtype=object)
        c, t, q = (np.flatnonzero(kind == k) for k in "ctp")
        pick = lambda name, rows: [page[name][i] for i in rows.tolist()]
        box = np.column_stack([page[k] for k in "lbrt"]).astype(float)
        size = float(_area(box[q])[0]) if len(q) else 0.0
        sure = np.asarray(page["confidence"], float)
        own = Page(pick("id", c), pick("label", c), box[c], sure[c], box[t], np.array(pick("index", t)), pick("text", t), np.nan_to_num(sure[t]), size, **options)
        final = own.run()
        ids = [own.ids[f] for f in final]
        boxes = own.box[final] if final else np.zeros((0, 4))
        cells_, children = [[int(own.index[m]) for m in own.members[f]] for f in final], [[own.ids[x] for x in own.children.get(f, [])] for f in final]
        return list(range(len(final))), ids, [own.labels[f] for f in final], *boxes.T, own.sure[final] if final else [], cells_, children

    return per_group(every, on, ["kind", "pos"], work, _OUT, keep=on)
