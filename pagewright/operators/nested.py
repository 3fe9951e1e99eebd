"""Nested page records into flat node tables with interval labels.

A depth-first traversal gives every node of a record a pre-order and a post-order number; one node lies within another
exactly if its interval (pre, post) does. Node tables carry those numbers, and children find their parents by interval
containment: a binary search in the parents' sorted pre-order numbers.

Defined results: null and invalid JSON give no rows (NaN and Infinity are no JSON), nor do values other than objects.
A lone object in place of an array is an array of one. Null elements give no row, but count for the places after them.
Records of any size and depth are read whole. Columns other than the id and the JSON are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays of a page and their names in an envelope's payload.
ARRAYS = {"char_cells": "cells", "word_cells": "word_cells", "textline_cells": "textline_cells", "shapes": "shapes", "bitmap_resources": "images", "widgets": "widgets", "hyperlinks": "hyperlinks"}
#: Arrays that an envelope doesn't have beside its payloads.
PAGE_ARRAYS = ("char_cells", "textline_cells", "shapes", "bitmap_resources")
#: Members of an element that have tables of their own, and theirs; a list's has one row per entry.
_CELL: dict = {"source": {}, "rect": {}, "rgba": {}}
PARTS: dict[str, dict] = {
    "char_cells": _CELL,
    "word_cells": _CELL,
    "textline_cells": _CELL,
    "bitmap_resources": {"image": {"size": {}}, "rect": {}},
    "shapes": {"points": {}, "dash_array": {}, "rgb_stroking": {}, "rgb_filling": {}},
    "widgets": {"rect": {}},
    "hyperlinks": {"rect": {}},
}
LISTS = ("points", "dash_array")
#: Columns of the tables, by the last name of their path: strings unless given.
TYPES = {
    "cell": {"index": "bigint", "text": "string", "orig": "string", "text_direction": "string", "confidence": "double", "from_ocr": "boolean", "rendering_mode": "bigint", "widget": "boolean", "font_key": "string", "font_name": "string"},
    "source": {"start_time": "double", "end_time": "double", "voice": "string"},
    "shape": {"index": "bigint", "parent_id": "bigint", "coord_origin": "string", "has_graphics_state": "boolean", "line_width": "double", "miter_limit": "double", "line_cap": "bigint", "line_join": "bigint", "dash_phase": "double", "flatness": "double"},
    "bitmap": {"index": "bigint", "uri": "string", "mode": "string"},
    "image": {"mimetype": "string", "dpi": "bigint", "uri": "string"},
    "size": {"width": "double", "height": "double"},
    "rect": {**{f"r_{a}{i}": "double" for i in range(4) for a in "xy"}, "coord_origin": "string"},
    "colour": {k: "bigint" for k in "rgba"},
    "widget": {"index": "bigint", "widget_text": "string", "widget_description": "string", "widget_field_name": "string", "widget_field_type": "string"},
    "hyperlink": {"index": "bigint", "uri": "string"},
}
_TYPE_OF = {"char_cells": "cell", "word_cells": "cell", "textline_cells": "cell", "shapes": "shape", "bitmap_resources": "bitmap", "widgets": "widget", "hyperlinks": "hyperlink", "rgba": "colour", "rgb_stroking": "colour", "rgb_filling": "colour"}

_FIELDS = [("path", pa.string()), ("pos", pa.int64()), ("sub_pos", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("depth", pa.int32()), ("parent_pre", pa.int64()), ("value", pa.string())]
_TYPES = [T.StructField("path", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("sub_pos", T.LongType()), T.StructField("pre", T.LongType()), T.StructField("post", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("parent_pre", T.LongType()), T.StructField("value", T.StringType())]


def _refuse(name: str) -> None:
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _deep(text: str) -> object:
    """JSON nested too deeply for the recursive parser."""
    top: list = []
    stack: list = [top]
    keys: list = [None]
    at, expect = 0, "value"
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("token")
            break
        at = m.end()
        mark = m.group(1)
        here = stack[-1]
        if expect in ("value", "value_or_end") and mark in (None, "{", "["):
            v: object = {} if mark == "{" else [] if mark == "[" else json.loads(m.group(2) or m.group(3))
            if isinstance(here, dict):
                here[keys[-1]] = v
            else:
                here.append(v)
            if mark:
                stack.append(v)
                keys.append(None)
                expect = "key_or_end" if mark == "{" else "value_or_end"
            else:
                expect = "more"
        elif expect in ("key", "key_or_end") and m.group(2):
            keys[-1], expect = json.loads(m.group(2)), "colon"
        elif expect == "colon" and mark == ":":
            expect = "value"
        elif expect == "more" and mark == "," and len(stack) > 1:
            expect = "key" if isinstance(here, dict) else "value"
        elif mark in ("}", "]") and len(stack) > 1 and isinstance(here, dict) == (mark == "}") and expect in ("more", "key_or_end", "value_or_end"):
            stack.pop()
            keys.pop()
            expect = "more"
        else:
            raise ValueError("place")
    if len(stack) != 1 or len(top) != 1:
        raise ValueError("end")
    return top[0]


def read_json(text: str | None) -> object:
    """The value, or None for null and invalid text."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        try:
            return _deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def payload(page: object) -> tuple[dict, bool] | None:
    """The object that holds the arrays, and whether it is an envelope's."""
    if not isinstance(page, dict):
        return None
    if ("original" in page or "sanitized" in page) and not any(k in page for k in PAGE_ARRAYS):
        own = page.get("original")
        own = page.get("sanitized") if own is None else own
        return (own, True) if isinstance(own, dict) else None
    return page, False


def label(root: object) -> tuple[list[int], list[int], list[int], dict[int, int]]:
    """pre and post numbers and depths by visit, and the visit of each container by its identity."""
    pre, post, depth, visit = [], [], [], {}
    stack: list = [(root, 0, False)]
    left = 0
    while stack:
        node, d, done = stack.pop()
        if done:
            post[node] = left
            left += 1
            continue
        me = len(pre)
        pre.append(me)
        post.append(-1)
        depth.append(d)
        stack.append((me, d, True))
        kids = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        if kids or isinstance(node, (dict, list)):
            visit[id(node)] = me
        stack.extend((k, d + 1, False) for k in reversed(list(kids)))
    return pre, post, depth, visit


def _text(v: object) -> str:
    try:
        return json.dumps(v, separators=(",", ":"))
    except RecursionError:
        return ""


def page_nodes(text: str | None, values: bool = True, paths: frozenset[str] | None = None) -> list[tuple]:
    """(path, pos, sub_pos, pre, post, depth, parent_pre, value) of the nodes of a page that have tables, or of these paths."""
    page = read_json(text)
    own = payload(page)
    if own is None:
        return []
    body, envelope = own
    pre, post, depth, visit = label(page)
    out: list[tuple] = []

    def children(node: object, me: int) -> list[int]:
        """The visits of a container's members: each begins after the one before it, which covers as many visits as it has nodes."""
        found, at = [], me + 1
        for _ in node:  # type: ignore[attr-defined]
            found.append(at)
            # the subtree that begins at visit v has post[v] - v + depth[v] + 1 nodes
            at += post[at] - at + depth[at] + 1
        return found

    def add(path: str, rows: list[tuple], parents: list[tuple]) -> None:
        """rows (visit, value, sub_pos) below parents (visit, pos), each in the order of visits: a row lies within the last
        parent that begins before it, if its interval does."""
        begin = np.array([pre[a] for a, _ in parents])
        owner = np.searchsorted(begin, np.array([pre[a] for a, _, _ in rows]), side="right") - 1
        for (at, v, sub), o in zip(rows, owner):
            parent, pos = parents[o]
            if post[at] < post[parent]:
                out.append((path, pos, sub, pre[at], post[at], depth[at], pre[parent], _text(v) if values else None))

    def parts_of(path: str, parts: dict, parents: list[tuple]) -> None:
        """The tables of the members of parents (visit, pos, value)."""
        found: dict[str, list[tuple]] = {}
        for at, pos, item in parents:
            if not isinstance(item, dict) or not any(item.get(p) is not None for p in parts):
                continue
            for name, kid in zip(item, children(item, at)):
                v = item[name]
                if name not in parts or v is None:
                    continue
                rows = found.setdefault(name, [])
                if name not in LISTS:
                    rows.append((kid, v, -1, pos))
                elif isinstance(v, list) and (name != "points" or not (v and all(isinstance(x, (int, float)) for x in v))):
                    rows += [(a, x, i, pos) for i, (x, a) in enumerate(zip(v, children(v, kid)))]
                else:  # a lone entry
                    rows.append((kid, v, 0, pos))
        for name, rows in found.items():
            own_path = f"{path}.{name}"
            if paths is None or own_path in paths:
                add(own_path, [r[:3] for r in rows], [p[:2] for p in parents])
            if parts[name]:
                parts_of(own_path, parts[name], [(a, pos, v) for a, v, _, pos in rows])

    at_body = visit[id(body)]
    members = dict(zip(body, children(body, at_body)))
    for path, inner in ARRAYS.items():
        name = inner if envelope else path
        found = body.get(name)
        if found is None:
            continue
        me = members[name]
        items, places = (found, children(found, me)) if isinstance(found, list) else ([found], [me])
        parents = [(at, pos, item) for pos, (item, at) in enumerate(zip(items, places)) if item is not None]
        if paths is None or path in paths:
            out += [(path, pos, -1, pre[at], post[at], depth[at], pre[at_body], _text(item) if values else None) for at, pos, item in parents]
        parts = {n: p for n, p in PARTS[path].items() if paths is None or any(x.startswith(f"{path}.{n}") for x in paths)}
        if parts and parents:
            parts_of(path, parts, parents)
    return out


def node_tables(df: DataFrame, record_id: str = "record_id", page_json: str = "page_json", values: bool = True, paths: tuple[str, ...] | None = None) -> DataFrame:
    """record_id, path, pos, sub_pos, pre, post, depth, parent_pre, value: one row per node that has a table, or that has one
    of the paths. No shuffle."""
    wanted = None if paths is None else frozenset(paths)
    df = df.select(F.col(record_id).alias("record_id"), F.col(page_json).alias("page_json"))
    kind = df.schema["record_id"]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            owner: list[int] = []

            def flush() -> pa.RecordBatch:
                columns = [ids.take(pa.array(owner, pa.int64()))] + [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)]
                return pa.RecordBatch.from_arrays(columns, names=["record_id"] + [n for n, _ in _FIELDS])

            for i, text in enumerate(batch.column(1)):
                own = page_nodes(text.as_py(), values, wanted)
                rows += own
                owner += [i] * len(own)
                if len(rows) > 20_000:
                    yield flush()
                    rows, owner = [], []
            if rows:
                yield flush()

    return df.mapInArrow(nodes, T.StructType([T.StructField("record_id", kind.dataType), *_TYPES]))


def typed(nodes: DataFrame, kind: str) -> DataFrame:
    """record_id, path, pos, sub_pos, pre, post and the columns of one type (TYPES): a table of its own. Values of another
    type than their column's are null, number-like strings are read."""
    columns = TYPES[kind]
    last = F.element_at(F.split("path", r"\."), -1)
    names = [p for p, k in _TYPE_OF.items() if k == kind] or [kind]
    own = nodes.where(last.isin(*names)).select("record_id", "path", "pos", "sub_pos", "pre", "post", F.json_tuple("value", *columns).alias(*[f"_{c}" for c in columns]))
    return own.select("record_id", "path", "pos", "sub_pos", "pre", "post", *[F.col(f"_{c}").try_cast(t).alias(c) for c, t in columns.items()])


def within(children: DataFrame, parents: DataFrame, take: list[str], prefix: str = "parent_") -> DataFrame:
    """children with the columns take of the parent whose interval contains theirs. Both go through one sort of each record by
    pre: parents of one table don't nest, so only the last that begins before a child can hold it. Children without one
    are left out."""
    width = F.struct("pre", "post", *take)
    tagged = children.withColumn("_p", F.lit(None).cast(parents.select(width.alias("x")).schema["x"].dataType))
    other = parents.select("record_id", "pre", "post", width.alias("_p"))
    both = tagged.unionByName(other, allowMissingColumns=True).withColumn("_child", F.col("_p").isNull())
    over = Window.partitionBy("record_id").orderBy("pre", "_child").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_p", F.last("_p", ignorenulls=True).over(over)).where(F.col("_child") & (F.col("_p.pre") < F.col("pre")) & (F.col("post") < F.col("_p.post")))
    return held.select(*children.columns, *[F.col(f"_p.{c}").alias(f"{prefix}{c}") for c in take])
