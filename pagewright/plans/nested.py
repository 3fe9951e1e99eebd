"""Queries over nested pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.nested import node_tables, typed, within
from pagewright.session import table

#: Paths whose rows p4_found gives.
FOUND = ("char_cells", "textline_cells", "shapes", "bitmap_resources", "char_cells.source", "textline_cells.source", "bitmap_resources.image", "shapes.points")


def _nodes(spark: SparkSession, sf: str, *paths: str, values: bool = True) -> DataFrame:
    return node_tables(table(spark, sf, "segmented_pages").where("record_id is not null"), values=values, paths=paths or None)


def p4_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All node tables with labels and values, one row per node."""
    return _nodes(spark, sf)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf, *FOUND, values=False).select("record_id", "path", "pos", "sub_pos").distinct()


def p4_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table, by path."""
    return _nodes(spark, sf, values=False).groupBy("path").agg(F.count(F.lit(1)).alias("nodes"))


_CELLS = ("char_cells", "word_cells", "textline_cells")


def p4_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The table of cells."""
    return typed(_nodes(spark, sf, *_CELLS), "cell").select("record_id", "path", "pos", F.col("index").alias("cell_index"), "text", "orig", "font_name", F.round("confidence", 6).alias("confidence")).distinct()


def p4_rects(spark: SparkSession, sf: str) -> DataFrame:
    """The table of rectangles, each linked to its element by interval containment."""
    nodes = _nodes(spark, sf, "textline_cells", "textline_cells.rect")
    rects = within(typed(nodes, "rect").drop("pos"), typed(nodes, "cell"), ["pos"], "cell_")
    return rects.select("record_id", "cell_pos", "r_x0", "r_y0", "r_x2", "r_y2", "coord_origin").distinct()


def p4_images(spark: SparkSession, sf: str) -> DataFrame:
    """The images of bitmaps with the sizes within them: two steps of containment."""
    nodes = _nodes(spark, sf, "bitmap_resources", "bitmap_resources.image", "bitmap_resources.image.size")
    images = within(typed(nodes, "image"), typed(nodes, "bitmap"), ["pos", "index"], "bitmap_")
    sizes = within(typed(nodes, "size").drop("path", "pos", "sub_pos"), images, ["bitmap_pos", "bitmap_index", "mimetype", "dpi"], "image_")
    return sizes.select("record_id", F.col("image_bitmap_pos").alias("bitmap_pos"), F.col("image_bitmap_index").alias("bitmap_index"), F.col("image_mimetype").alias("mimetype"), F.col("image_dpi").alias("dpi"), "width", "height").distinct()


def p4_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points linked to their shapes by interval containment."""
    nodes = _nodes(spark, sf, "shapes", "shapes.points")
    points = nodes.where("path = 'shapes.points'").select("record_id", "sub_pos", "pre", "post", "value")
    own = within(points, typed(nodes, "shape"), ["pos", "index"], "shape_")
    number = lambda v: F.get_json_object("value", f"$[{v}]").try_cast("double")
    return own.select("record_id", "shape_pos", "shape_index", F.col("sub_pos").alias("point_pos"), number(0).alias("x"), number(1).alias("y")).distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_nodes, p4_paths, p4_cells, p4_rects, p4_images, p4_points)}
_ENVELOPE = "(json_exists(j, '$.original') OR json_exists(j, '$.sanitized')) AND NOT json_exists(j, '$.char_cells') AND NOT json_exists(j, '$.textline_cells') AND NOT json_exists(j, '$.shapes') AND NOT json_exists(j, '$.bitmap_resources')"
_ITEMS = "CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'NULL' THEN [] ELSE [v] END"
_ARRAY = "SELECT record_id, '{0}' AS path, json_extract(b, CASE WHEN env THEN '$.{1}' ELSE '$.{0}' END) AS v FROM q"
_PART = "SELECT record_id, path || '.{0}', pos, -1 FROM e WHERE path IN ({1}) AND json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.{0}'), 'NULL') <> 'NULL'"
_PAGES = (
    f"WITH p AS (SELECT record_id, CAST(page_json AS JSON) AS j FROM segmented_pages WHERE json_valid(page_json)), "
    f"q AS (SELECT record_id, {_ENVELOPE} AS env, CASE WHEN {_ENVELOPE} THEN CASE WHEN coalesce(json_type(j, '$.original'), 'NULL') <> 'NULL' THEN json_extract(j, '$.original') ELSE json_extract(j, '$.sanitized') END ELSE j END AS b FROM p), "
    "a AS ({0}), "
    f"l AS (SELECT record_id, path, {_ITEMS} AS items FROM a WHERE v IS NOT NULL), "
    "e AS (SELECT * FROM (SELECT record_id, path, unnest(items) AS x, generate_subscripts(items, 1) - 1 AS pos FROM l) WHERE json_type(x) <> 'NULL')"
)


def _elements(*arrays: tuple[str, str]) -> str:
    return _PAGES.replace("{0}", " UNION ALL ".join(_ARRAY.format(*x) for x in arrays))


_CELL_ARRAYS = (("char_cells", "cells"), ("word_cells", "word_cells"), ("textline_cells", "textline_cells"))
_NUMBER = "TRY_CAST(json_extract_string({0}, '$.{1}') AS {2})"
SQL: dict[str, str] = {
    "p4_found": _elements(("char_cells", "cells"), ("textline_cells", "textline_cells"), ("shapes", "shapes"), ("bitmap_resources", "images")) + ", "
    "n AS (SELECT record_id, pos, json_extract(x, '$.points[*]') AS ps FROM e WHERE path = 'shapes' AND json_type(x, '$.points') = 'ARRAY') "
    "SELECT DISTINCT record_id, path, CAST(pos AS BIGINT) AS pos, CAST(sub_pos AS BIGINT) AS sub_pos FROM ("
    "SELECT record_id, path, pos, -1 AS sub_pos FROM e UNION ALL " + _PART.format("source", "'char_cells', 'textline_cells'") + " UNION ALL " + _PART.format("image", "'bitmap_resources'") + " UNION ALL SELECT record_id, 'shapes.points', pos, generate_subscripts(ps, 1) - 1 FROM n)",
    "p4_cells": _elements(*_CELL_ARRAYS) + " SELECT DISTINCT record_id, path, CAST(pos AS BIGINT) AS pos, " + _NUMBER.format("x", "index", "BIGINT") + " AS cell_index, json_extract_string(x, '$.text') AS text, json_extract_string(x, '$.orig') AS orig, json_extract_string(x, '$.font_name') AS font_name, round(" + _NUMBER.format("x", "confidence", "DOUBLE") + ", 6) AS confidence FROM e",
    "p4_rects": _elements(("textline_cells", "textline_cells")) + " SELECT DISTINCT record_id, CAST(pos AS BIGINT) AS cell_pos, " + ", ".join(f"{_NUMBER.format('r', c, 'DOUBLE')} AS {c}" for c in ("r_x0", "r_y0", "r_x2", "r_y2")) + ", json_extract_string(r, '$.coord_origin') AS coord_origin FROM (SELECT record_id, pos, json_extract(x, '$.rect') AS r FROM e WHERE json_type(x) = 'OBJECT') WHERE coalesce(json_type(r), 'NULL') <> 'NULL'",
    "p4_images": _elements(("bitmap_resources", "images")) + " SELECT DISTINCT record_id, CAST(pos AS BIGINT) AS bitmap_pos, " + _NUMBER.format("x", "index", "BIGINT") + " AS bitmap_index, json_extract_string(i, '$.mimetype') AS mimetype, " + _NUMBER.format("i", "dpi", "BIGINT") + " AS dpi, " + _NUMBER.format("s", "width", "DOUBLE") + " AS width, " + _NUMBER.format("s", "height", "DOUBLE") + " AS height FROM (SELECT record_id, pos, x, json_extract(x, '$.image') AS i, json_extract(x, '$.image.size') AS s FROM e) WHERE json_type(i) = 'OBJECT' AND coalesce(json_type(s), 'NULL') <> 'NULL'",
    "p4_points": _elements(("shapes", "shapes")) + ", n AS (SELECT record_id, pos, TRY_CAST(json_extract_string(x, '$.index') AS BIGINT) AS i, json_extract(x, '$.points[*]') AS ps FROM e WHERE json_type(x, '$.points') = 'ARRAY'), "
    "k AS (SELECT record_id, pos, i, unnest(ps) AS q, generate_subscripts(ps, 1) - 1 AS sub FROM n) "
    "SELECT DISTINCT record_id, CAST(pos AS BIGINT) AS shape_pos, i AS shape_index, CAST(sub AS BIGINT) AS point_pos, TRY_CAST(json_extract_string(q, '$[0]') AS DOUBLE) AS x, TRY_CAST(json_extract_string(q, '$[1]') AS DOUBLE) AS y FROM k",
}
_OBJECT = "SELECT path || '.{0}' AS path, 1 AS n FROM e WHERE path IN ({1}) AND json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.{0}'), 'NULL') <> 'NULL'"
_ENTRIES = "SELECT path || '.{0}', CASE json_type(x, '$.{0}') WHEN 'ARRAY' THEN json_array_length(x, '$.{0}') ELSE 1 END FROM e WHERE path = 'shapes' AND json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.{0}'), 'NULL') <> 'NULL'"
_WITH_CELLS = "'char_cells', 'word_cells', 'textline_cells'"
_COUNTED = (
    *(_OBJECT.format(n, p) for n, p in (("source", _WITH_CELLS), ("rgba", _WITH_CELLS), ("rect", _WITH_CELLS + ", 'bitmap_resources', 'widgets', 'hyperlinks'"), ("image", "'bitmap_resources'"), ("image.size", "'bitmap_resources'"), ("rgb_stroking", "'shapes'"), ("rgb_filling", "'shapes'"))),
    *(_ENTRIES.format(n) for n in ("points", "dash_array")),
)
SQL["p4_paths"] = _elements(*_CELL_ARRAYS, ("shapes", "shapes"), ("bitmap_resources", "images"), ("widgets", "widgets"), ("hyperlinks", "hyperlinks")) + " SELECT path, CAST(sum(n) AS BIGINT) AS nodes FROM (SELECT path, 1 AS n FROM e UNION ALL " + " UNION ALL ".join(_COUNTED) + ") GROUP BY 1 HAVING sum(n) > 0"
#: Sizes of a page's arrays: -1 where there is none; an envelope's are never null.
_SIZE = "CASE WHEN b IS NULL OR json_type(b) <> 'OBJECT' THEN -1 WHEN env THEN {1} ELSE coalesce(CASE json_type(b, '$.{0}') WHEN 'ARRAY' THEN json_array_length(b, '$.{0}') WHEN 'OBJECT' THEN 1 END, -1) END"
_INNER = "coalesce(CASE json_type(b, '$.{0}') WHEN 'ARRAY' THEN json_array_length(b, '$.{0}') WHEN 'OBJECT' THEN 1 END, 0)"
SQL["src_segmented_pages"] = (
    f"WITH p AS (SELECT record_id, CASE WHEN json_valid(page_json) THEN CAST(page_json AS JSON) END AS j FROM segmented_pages), q AS (SELECT record_id, coalesce({_ENVELOPE}, false) AS env, CASE WHEN coalesce({_ENVELOPE}, false) THEN CASE WHEN coalesce(json_type(j, '$.original'), 'NULL') <> 'NULL' THEN json_extract(j, '$.original') ELSE json_extract(j, '$.sanitized') END ELSE j END AS b FROM p) SELECT record_id, "
    + ", ".join(f"CAST({_SIZE.format(n, '0' if inner is None else _INNER.format(inner))} AS INT) AS {n}" for n, inner in (("char_cells", "cells"), ("textline_cells", None), ("shapes", "shapes"), ("bitmap_resources", "images")))
    + " FROM q"
)
