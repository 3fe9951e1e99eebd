"""Queries over boxes, cells, batches, transcripts and page sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions.text import SPACE, is_blank, multiset_hash, sequence_hash, string_key
from pagewright.operators import layout, parity, pipeline, reading_order, spatial
from pagewright.schema import REQUIRED
from pagewright.session import broadcast_if_small, cut_lineage, table
from pagewright.sources.audio import hydrate, transcript_line

PAGE = ["doc_key", "page_no"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_COLUMNS = ("doc_key", "page_no", "cell_id", "cell_index", "text", "orig", "confidence", "font_name", "font_key", "text_direction")


def _cells(spark: SparkSession, sf: str, kind: str, box: str, *keep: str) -> DataFrame:
    """One row per cell (a redelivered one counts once) with its box; columns besides the page are named by kind."""
    t = table(spark, sf, f"{kind}_cells").dropDuplicates(["cell_id"])
    return t.select(*PAGE, F.col("cell_id").alias(f"{kind}_id"), *[F.col(c).alias(f"{kind}_{c}") for c in keep], g.rect_box("rect").alias(box))


def _box_sql(kind: str, keep: str = "") -> str:
    x, y = [", ".join(f"rect.r_{a}{i}" for i in range(4)) for a in "xy"]
    return f"(SELECT DISTINCT ON (cell_id) doc_key, page_no, cell_id{keep}, least({x}) AS l, least({y}) AS b, greatest({x}) AS r, greatest({y}) AS t FROM {kind}_cells)"


_COMMON = "(least(a.r, b.r) - greatest(a.l, b.l)) * (least(a.t, b.t) - greatest(a.b, b.b))"
_MEET = "a.doc_key = b.doc_key AND a.page_no = b.page_no AND a.l < b.r AND b.l < a.r AND a.b < b.t AND b.b < a.t"
_AREA = "greatest(0, {0}.r - {0}.l) * greatest(0, {0}.t - {0}.b)"


@_query(f"SELECT cell_id AS textline_id, round(r - l, 6) AS width, round(t - b, 6) AS height, round({_AREA.format('a')}, 4) AS area FROM {_box_sql('textline')} a")
def geo_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = _cells(spark, sf, "textline", "a")
    a = F.col("a")
    return c.select("textline_id", F.round(g.width(a), 6).alias("width"), F.round(g.height(a), 6).alias("height"), F.round(g.area(a), 4).alias("area"))


@_query(f"SELECT a.cell_id AS word_id, b.cell_id AS textline_id, round({_COMMON}, 4) AS common, round({_COMMON} / ({_AREA.format('a')} + {_AREA.format('b')} - {_COMMON}), 6) AS iou FROM {_box_sql('word')} a JOIN {_box_sql('textline')} b ON {_MEET}")
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    both = spatial.overlap_join(_cells(spark, sf, "word", "a"), _cells(spark, sf, "textline", "b"), PAGE)
    a, b = F.col("a"), F.col("b")
    return both.select("word_id", "textline_id", F.round(g.intersection_area(a, b), 4).alias("common"), F.round(g.iou(a, b), 6).alias("iou"))


@_query(f"SELECT a.cell_id AS word_id, b.cell_id AS textline_id FROM {_box_sql('word')} a JOIN {_box_sql('textline')} b ON {_MEET}")
def grid_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.grid_join(_cells(spark, sf, "word", "a"), _cells(spark, sf, "textline", "b"), PAGE, 200.0).select("word_id", "textline_id")


@_query(
    f"SELECT word_id, textline_id, round(part, 6) AS part FROM (SELECT a.cell_id AS word_id, b.cell_id AS textline_id, {_COMMON} / ({_AREA.format('a')}) AS part, row_number() OVER (PARTITION BY a.cell_id ORDER BY {_COMMON} / ({_AREA.format('a')}) DESC, b.cell_id) AS n FROM {_box_sql('word')} a JOIN {_box_sql('textline')} b ON {_MEET} WHERE {_AREA.format('a')} > 0 AND {_COMMON} / ({_AREA.format('a')}) > 0.2) WHERE n = 1"
)
def best_match_join(spark: SparkSession, sf: str) -> DataFrame:
    m = spatial.best_match(_cells(spark, sf, "word", "a"), _cells(spark, sf, "textline", "b"), PAGE, "word_id", "textline_id")
    return m.select("word_id", "textline_id", F.round("part", 6).alias("part"))


_SHOWN = f"regexp_matches(text, '[^{SPACE}]')"


_HALVES = f"(SELECT doc_key, page_no, cell_id, l, b, (l + r) / 2 AS r, t FROM {_box_sql('textline')})"


@_query(f"SELECT cell_id AS word_id FROM {_box_sql('word', ', text')} a WHERE {_SHOWN} AND NOT EXISTS (SELECT 1 FROM {_HALVES} b WHERE {_MEET} AND {_COMMON} / ({_AREA.format('a')}) > 0.2)")
def unassigned_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that lie in the left half of no line."""
    words = _cells(spark, sf, "word", "a", "text").where(~is_blank("word_text"))
    halves = _cells(spark, sf, "textline", "b").withColumn("b", g.box(F.col("b.l"), F.col("b.b"), (F.col("b.l") + F.col("b.r")) / 2, F.col("b.t")))
    m = spatial.best_match(words.drop("word_text"), halves, PAGE, "word_id", "textline_id")
    return spatial.unmatched(words.select("word_id"), m, ["word_id"])


@_query(f"SELECT a.cell_id AS word_id, b.cell_id AS textline_id FROM {_box_sql('word')} a JOIN {_box_sql('textline')} b ON {_MEET} WHERE {_COMMON} / ({_AREA.format('a')}) > 0.8")
def containment_join(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.contained(_cells(spark, sf, "word", "a"), _cells(spark, sf, "textline", "b"), PAGE).select("word_id", "textline_id")


@_query("WITH s AS (SELECT DISTINCT audio_key, segment_id, start_time, end_time FROM asr_segments WHERE end_time >= start_time) SELECT p.segment_id AS at_segment, i.segment_id AS in_segment FROM (SELECT DISTINCT audio_key, segment_id, start_time FROM asr_segments) p JOIN s i ON p.audio_key = i.audio_key AND p.start_time BETWEEN i.start_time AND i.end_time WHERE p.segment_id <> i.segment_id")
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that begin while another lasts."""
    s = table(spark, sf, "asr_segments")
    p = s.select("audio_key", F.col("segment_id").alias("at_segment"), F.col("start_time").alias("at")).distinct()
    i = s.select("audio_key", F.col("segment_id").alias("in_segment"), F.col("start_time").alias("low"), F.col("end_time").alias("high")).distinct()
    return spatial.interval_join(p, i, ["audio_key"], "at", "low", "high", 10.0).where("at_segment <> in_segment").select("at_segment", "in_segment")


@_query(f"SELECT doc_key, page_no, min(l) AS l, min(b) AS b, max(r) AS r, max(t) AS t FROM {_box_sql('textline')} GROUP BY doc_key, page_no")
def page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.union_boxes(_cells(spark, sf, "textline", "a"), PAGE)


@_query("SELECT doc_key, page_no, cell_index AS textline_cell_index, min(cell_id) AS textline_id FROM textline_cells GROUP BY ALL")
def first_of_index(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.first_by_index(_cells(spark, sf, "textline", "a", "cell_index"), PAGE, "textline_cell_index", "textline_id").drop("a")


@_query(
    f"WITH RECURSIVE n AS (SELECT doc_key, page_no, cell_id, l - 4 AS l, b - 4 AS b, r + 4 AS r, t + 4 AS t FROM {_box_sql('word')}), e AS (SELECT a.cell_id AS x, b.cell_id AS y FROM n a JOIN n b ON {_MEET}), "
    "c(x, y) AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x) SELECT n.doc_key, n.page_no, n.cell_id AS word_id, min(c.y) AS component FROM n JOIN c ON c.x = n.cell_id GROUP BY ALL"
)
def box_components(spark: SparkSession, sf: str) -> DataFrame:
    """Words whose boxes, widened by 4 on each side, overlap in chains."""
    w = _cells(spark, sf, "word", "a")
    wide = g.box(F.col("a.l") - 4, F.col("a.b") - 4, F.col("a.r") + 4, F.col("a.t") + 4)
    return spatial.components(w.withColumn("a", wide), PAGE, "word_id")


@_query("SELECT rgba.r || ',' || rgba.g || ',' || rgba.b || ',' || rgba.a AS color, count(*) AS cells FROM (SELECT DISTINCT ON (cell_id) rgba FROM textline_cells) GROUP BY 1 ORDER BY cells DESC, color LIMIT 10")
def top_colors(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "textline_cells").select("cell_id", "rgba").dropDuplicates(["cell_id"])
    color = F.concat_ws(",", *[F.col(f"rgba.{k}").cast("string") for k in "rgba"])
    return c.groupBy(color.alias("color")).agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), "color").limit(10)


@_query(f"SELECT CASE WHEN text_direction IS NULL THEN '_missing_' WHEN NOT regexp_matches(text_direction, '[^{SPACE}]') THEN '_empty_' ELSE text_direction END AS direction, CASE WHEN font_name IS NULL THEN '_missing_' WHEN NOT regexp_matches(font_name, '[^{SPACE}]') THEN '_empty_' ELSE font_name END AS font, count(*) AS cells, avg(confidence) AS confidence, count(*) FILTER (text = orig) AS equal FROM textline_cells GROUP BY 1, 2")
def cell_distributions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "textline_cells")
    return c.groupBy(string_key("text_direction").alias("direction"), string_key("font_name").alias("font")).agg(F.count(F.lit(1)).alias("cells"), F.avg("confidence").alias("confidence"), F.count_if(F.col("text") == F.col("orig")).alias("equal"))


_SEQ = "upper(sha256(coalesce(string_agg(coalesce({0}, '') || chr(31), '' ORDER BY {1}), '')))"


@_query(
    f"WITH c AS (SELECT DISTINCT ON (cell_id) doc_key, page_no, cell_index, cell_id, text, orig FROM textline_cells) SELECT doc_key, page_no, {_SEQ.format('text', 'cell_index, cell_id')} AS text_hash, {_SEQ.format('text', 'text')} AS bag_hash, count(*) - count(DISTINCT cell_index) AS repeated FROM c WHERE text IS NOT NULL GROUP BY 1, 2"
)
def page_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence and multiset hashes of each page's texts, and repeated index values."""
    c = table(spark, sf, "textline_cells").where("text is not null").select(*PAGE, "cell_index", "cell_id", "text").dropDuplicates(["cell_id"])
    s = c.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("cell_index", "cell_id", "text"))).alias("c"), (F.count(F.lit(1)) - F.count_distinct("cell_index")).alias("repeated"))
    texts = F.transform("c", lambda x: x["text"])
    return s.select(*PAGE, sequence_hash(texts).alias("text_hash"), multiset_hash(texts).alias("bag_hash"), "repeated")


@_query("SELECT coalesce(a.doc_key, b.doc_key) AS doc_key, coalesce(a.font, b.font) AS font, coalesce(a.n, 0) AS textlines, coalesce(b.n, 0) AS words FROM (SELECT doc_key, coalesce(font_name, '_missing_') AS font, count(*) AS n FROM textline_cells GROUP BY 1, 2) a FULL JOIN (SELECT doc_key, coalesce(font_name, '_missing_') AS font, count(*) AS n FROM word_cells GROUP BY 1, 2) b ON a.doc_key = b.doc_key AND a.font = b.font WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def distribution_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Where the fonts of a document's textlines and words differ in number."""
    n = lambda kind, name: table(spark, sf, f"{kind}_cells").groupBy("doc_key", F.coalesce("font_name", F.lit("_missing_")).alias("font")).agg(F.count(F.lit(1)).alias(name))
    both = n("textline", "textlines").join(n("word", "words"), ["doc_key", "font"], "full_outer").na.fill(0, ["textlines", "words"])
    return both.where("textlines <> words")


def _elements(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "textline_cells").dropDuplicates(["cell_id"])
    e = c.select(*PAGE, F.col("cell_id").alias("pos"), "text", "cell_index", "confidence", "font_name", g.rect_box("rect").alias("a"))
    label = F.when(F.col("a.b") > 770, "page_header").when(F.col("a.t") < 60, "page_footer").otherwise("text")
    return e.select(*PAGE, "pos", "text", F.col("cell_index").alias("index"), "confidence", "font_name", label.alias("label"), "a.l", "a.b", "a.r", "a.t", F.lit(600.0).alias("page_width"), F.lit(842.0).alias("page_height"))


@_query()
def reading_order_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reading_order.reading_order(_elements(spark, sf), PAGE).select(*PAGE, "pos", "order", "label")


@_query()
def layout_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of words: each textline proposes one, by its font, and a table encloses each page's lower half."""
    lines = _elements(spark, sf)
    label = F.when(F.col("font_name") == "HeadingFont", "title").when(F.col("font_name") == "Mono-Regular", "code").when(F.col("font_name") == "Serif-Italic", "list_item").otherwise("text")
    c = lines.select(*PAGE, "pos", F.col("pos").alias("id"), label.alias("label"), "l", "b", "r", "t", F.coalesce("confidence", F.lit(0.4)).alias("confidence"))
    low = lines.groupBy(*PAGE).agg(F.max("pos").alias("m"), F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.avg("t").alias("t"))
    c = c.unionByName(low.select(*PAGE, (F.col("m") + 1_000_000_000).alias("pos"), (F.col("m") + 1_000_000_000).alias("id"), F.lit("table").alias("label"), "l", "b", "r", "t", F.lit(0.9).alias("confidence")))
    words = table(spark, sf, "word_cells").dropDuplicates(["cell_id"]).select(*PAGE, F.col("cell_id").alias("pos"), F.col("cell_index").alias("index"), "text", g.rect_box("rect").alias("a"), "confidence")
    words = words.select(*PAGE, "pos", "index", "text", "a.l", "a.b", "a.r", "a.t", "confidence")
    return layout.postprocess(c, words, lines.select(*PAGE, "page_width", "page_height").distinct(), PAGE)


@_query("SELECT status AS key, 'status' AS kind, count(*) AS n FROM runs WHERE status <> '' GROUP BY 1 UNION ALL SELECT pipeline_status, 'pipeline_status', count(*) FROM runs WHERE pipeline_status <> '' GROUP BY 1 UNION ALL SELECT code, 'code', count(*) FROM diagnostics WHERE code <> '' GROUP BY 1 UNION ALL SELECT stage_name, 'stage', count(*) FROM diagnostics WHERE stage_name <> '' GROUP BY 1")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    r, d = table(spark, sf, "runs"), table(spark, sf, "diagnostics")
    out = None
    for df, key, kind in ((r, "status", "status"), (r, "pipeline_status", "pipeline_status"), (d, "code", "code"), (d, "stage_name", "stage")):
        part = pipeline.count_by(df, [], key).select(F.col(key).alias("key"), F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_PER = "SELECT run_id, count(*) AS d, count(*) FILTER (recoverable) AS r FROM diagnostics GROUP BY 1"
_DONE = "CAST(coalesce(sum({0}) FILTER (status <> 'skipped'), 0) AS BIGINT)"


@_query(
    f"SELECT batch_run_id, count(*) AS documents, count(*) FILTER (status = 'succeeded') AS succeeded_documents, count(*) FILTER (status = 'failed') AS failed_documents, count(*) FILTER (status = 'skipped') AS skipped_documents, {_DONE.format('page_count')} AS pages, {_DONE.format('attempted')} AS attempted_pages, {_DONE.format('succeeded')} AS succeeded_pages, "
    f"CAST(coalesce(sum(d), 0) AS BIGINT) AS diagnostics, CAST(coalesce(sum(r), 0) AS BIGINT) AS recoverable_diagnostics, CAST(coalesce(sum(d), 0) - coalesce(sum(r), 0) AS BIGINT) AS fatal_diagnostics FROM runs LEFT JOIN ({_PER}) USING (run_id) GROUP BY 1"
)
def batch_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.batch_summary(table(spark, sf, "runs"), table(spark, sf, "diagnostics"))


@_query("SELECT run_id, CASE WHEN bool_or(status NOT IN ('succeeded', 'skipped')) OVER (PARTITION BY batch_run_id ORDER BY doc_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'skipped' ELSE status END AS status FROM runs")
def stop_on_failure(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.stop_on_failure(table(spark, sf, "runs"), "batch_run_id", "doc_index").select("run_id", "status")


@_query("WITH s AS (SELECT DISTINCT audio_key, segment_id, start_time, end_time, text, voice FROM asr_segments) SELECT audio_key, segment_id, printf('[%.2f -> %.2f] ', start_time, end_time) || text AS line FROM s")
def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "asr_segments").select("audio_key", "segment_id", "start_time", "end_time", "text", "voice").distinct()
    line: Column = F.when(F.col("end_time").isNotNull() & F.col("start_time").isNotNull(), transcript_line(F.col("start_time"), F.col("end_time"), F.col("text")))
    return s.select("audio_key", "segment_id", line.alias("line"))


@_query("WITH s AS (SELECT DISTINCT audio_key, segment_id, start_time, end_time, text, voice FROM asr_segments) SELECT audio_key, row_number() OVER (PARTITION BY audio_key ORDER BY start_time, segment_id) - 1 AS pos, text, start_time, end_time, voice FROM s")
def transcript_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = hydrate(table(spark, sf, "asr_segments")).select("audio_key", F.explode("cells").alias("c"))
    return c.select("audio_key", F.col("c.index").alias("pos"), F.col("c.text").alias("text"), F.col("c.source.start_time").alias("start_time"), F.col("c.source.end_time").alias("end_time"), F.col("c.source.voice").alias("voice"))


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """The differences of every later record of a page from its first; a redelivered record counts once."""
    p = table(spark, sf, "segmented_pages").select(*PAGE, "record_id", "page_json").where("doc_key is not null and page_no is not null")
    p = p.withColumn("place", F.struct(F.col("record_id").isNull().alias("unnumbered"), F.col("record_id").alias("id"), F.xxhash64("page_json").alias("hash")))
    several = cut_lineage(p.groupBy(*PAGE).agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").select(*PAGE, "first"))
    p = p.join(broadcast_if_small(several, 100_000), PAGE)
    later = p.where("place <> first").dropDuplicates([*PAGE, "place"])
    return parity.compare(p.where("place = first").dropDuplicates(PAGE), later, PAGE, by=["record_id"])


@_query()
def parity_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf)


_KEYS = "[" + ", ".join(f"'{k}'" for k in REQUIRED) + "]"
_KEY_DIFFS = (
    "WITH p AS (SELECT DISTINCT doc_key, page_no, record_id, page_json AS e, regexp_replace(page_json, '\"(shapes|has_lines)\"\\s*:', '\"\\1_\":', 'g') AS a FROM segmented_pages WHERE record_id IS NOT NULL), "
    "k AS (SELECT doc_key, page_no, record_id, CASE WHEN json_valid(e) THEN list_distinct(coalesce(json_keys(e), [])) ELSE [] END AS e, CASE WHEN json_valid(a) THEN list_distinct(coalesce(json_keys(a), [])) ELSE [] END AS a FROM p), "
    f"d AS (SELECT doc_key, page_no, record_id, 'critical' AS severity, 'missing_required_top_level_key' AS code, unnest(list_filter({_KEYS}, lambda x: NOT list_contains(a, x))) AS message FROM k "
    f"UNION ALL SELECT doc_key, page_no, record_id, 'critical', 'missing_required_top_level_key_expected', unnest(list_filter({_KEYS}, lambda x: NOT list_contains(e, x))) FROM k "
    "UNION ALL SELECT doc_key, page_no, record_id, 'major', 'missing_expected_top_level_key', unnest(list_filter(e, lambda x: NOT list_contains(a, x))) FROM k "
    "UNION ALL SELECT doc_key, page_no, record_id, 'minor', 'unexpected_top_level_key', unnest(list_filter(a, lambda x: NOT list_contains(e, x))) FROM k) "
)
_KEY_CODES = ("missing_required_top_level_key", "missing_required_top_level_key_expected", "missing_expected_top_level_key", "unexpected_top_level_key")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "segmented_pages").where("record_id is not null").select(*PAGE, "record_id", "page_json").dropDuplicates(["record_id", "page_json"])


@_query(_KEY_DIFFS + "SELECT record_id, severity, code, message FROM d")
def parity_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The differences in keys of all records from a copy in which two keys have other names."""
    return _key_diffs(spark, sf).select("record_id", "severity", "code", "message")


def _key_diffs(spark: SparkSession, sf: str) -> DataFrame:
    p = _records(spark, sf)
    other = p.withColumn("page_json", F.regexp_replace("page_json", '"(shapes|has_lines)"\\s*:', '"$1_":'))
    return parity.compare(p, other, ["record_id"], by=PAGE).where(F.col("code").isin(*_KEY_CODES))


_SEVERITIES = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "major", "minor"))


@_query(_KEY_DIFFS + f", u AS (SELECT doc_key, page_no, severity FROM d UNION ALL SELECT DISTINCT doc_key, page_no, NULL FROM p), r AS (SELECT doc_key, page_no, CASE grouping(doc_key, page_no) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level, {_SEVERITIES} FROM u GROUP BY ROLLUP (doc_key, page_no)) SELECT coalesce(doc_key, '') AS doc_key, coalesce(page_no, 0) AS page_no, level, critical, major, minor, critical = 0 AND major = 0 AS passed FROM r")
def parity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The differences in keys per page, document and corpus; pages without any pass."""
    return parity.rollup(_key_diffs(spark, sf), _records(spark, sf)).drop("ocr_drift").na.fill("", ["doc_key"]).na.fill(0, ["page_no"])


@_query(_KEY_DIFFS + f", t AS (SELECT {_SEVERITIES} FROM d) SELECT *, critical = 0 AND major = 0 AND minor <= 100000 AS passed FROM t")
def parity_gate(spark: SparkSession, sf: str) -> DataFrame:
    return parity.gate(_key_diffs(spark, sf), parity.Thresholds(minor=100_000)).drop("ocr_drift")


_OCR_COUNT = "len(list_filter(json_extract({0}, '$.{1}[*].from_ocr'), lambda x: x = 'true'))"
_SIDES = (
    "WITH p AS (SELECT DISTINCT record_id, CAST(page_json AS JSON) AS e, CAST(regexp_replace(regexp_replace(page_json, '(\"from_ocr\"\\s*:\\s*)false', '\\1true', 'g'), '(\"has_lines\"\\s*:\\s*)true', '\\1false', 'g') AS JSON) AS a FROM segmented_pages WHERE record_id IS NOT NULL AND json_valid(page_json)) "
    + " UNION ALL ".join(f"SELECT record_id, 'ocr_from_ocr_count_mismatch' AS code, '{n}' AS message FROM p WHERE json_type(e, '$.{n}') = 'ARRAY' AND {_OCR_COUNT.format('e', n)} <> {_OCR_COUNT.format('a', n)}" for n in ("char_cells", "word_cells", "textline_cells"))
    + " UNION ALL SELECT record_id, 'boolean_mismatch', 'has_lines' FROM p WHERE json_type(e, '$.has_lines') = 'BOOLEAN' AND json_extract_string(e, '$.has_lines') <> json_extract_string(a, '$.has_lines')"
)


@_query(_SIDES)
def parity_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The differences in flags of all records from a copy in which cells come from OCR and pages have no lines."""
    p = _records(spark, sf)
    changed = F.regexp_replace(F.regexp_replace("page_json", '("from_ocr"\\s*:\\s*)false', "$1true"), '("has_lines"\\s*:\\s*)true', "$1false")
    d = parity.compare(p, p.withColumn("page_json", changed), ["record_id"])
    return d.where(F.col("code").isin("ocr_from_ocr_count_mismatch", "boolean_mismatch")).select("record_id", "code", "message")


#: What is done to a page's JSON: a pattern and what takes its place.
_CHANGES = {
    "text": (r'(?<k>"text"\s*:\s*")', "${k}~"),
    "ocr": (r'(?<k>"from_ocr"\s*:\s*)false', "${k}true"),
    "geometry": (r'(?<k>"r_x1"\s*:\s*-?)(?=\d)', "${k}1"),
    "key": (r'"shapes"\s*:', '"shapes_":'),
}


@_query()
def parity_perturbed(spark: SparkSession, sf: str) -> DataFrame:
    """The differences of all records from a copy in which each, by its hash, stays the same, is changed in one way or lost."""
    p = table(spark, sf, "segmented_pages").select(*PAGE, "record_id", "page_json")
    p = p.withColumn("row", F.xxhash64(*PAGE, "record_id", "page_json")).dropDuplicates(["row"])
    kinds = ["same", *_CHANGES, "lost"]
    change = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("row", F.lit(len(kinds))) + 1).cast("int"))
    json = F.when(F.col("change") == "same", F.col("page_json"))
    for k, (pattern, new) in _CHANGES.items():
        json = json.when(F.col("change") == k, F.regexp_replace("page_json", pattern, new))
    other = p.withColumn("change", change).withColumn("page_json", json)
    return parity.compare(p, other, ["row"], by=[*PAGE, "record_id", "change"]).drop("row")


@_query("WITH d AS (SELECT doc_key, max(page_count) // 2 AS page_count, bool_or(status = 'failed') AS failed FROM runs WHERE doc_index % 5 <> 0 GROUP BY 1), e AS (SELECT DISTINCT doc_key, page_no FROM textline_cells), c AS (SELECT doc_key, page_no, CASE WHEN page_count IS NULL THEN 'regression_pdf_missing' WHEN failed THEN 'document_processing_failed' WHEN page_no <= 0 OR page_no > page_count THEN 'page_number_out_of_range' END AS code FROM e LEFT JOIN d USING (doc_key)) SELECT doc_key, page_no, 'critical' AS severity, code FROM c WHERE code IS NOT NULL")
def expected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with lines that the runs don't account for, where every fifth document of a batch is absent and half of the
    pages are left."""
    d = table(spark, sf, "runs").where("doc_index % 5 <> 0").groupBy("doc_key").agg(F.floor(F.max("page_count") / 2).alias("page_count"), F.bool_or(F.col("status") == "failed").alias("failed"))
    return parity.check_pages(table(spark, sf, "textline_cells"), d, failed="failed")


@_query("SELECT doc_key, page_no FROM (SELECT doc_key, page_no, dense_rank() OVER (ORDER BY doc_key) AS d FROM (SELECT DISTINCT doc_key, page_no FROM textline_cells)) WHERE d <= 5 ORDER BY doc_key, page_no LIMIT 12")
def first_documents_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve pages of the first five documents, as a harness limits its work."""
    p = table(spark, sf, "textline_cells").select(*PAGE).distinct()
    docs = p.select("doc_key").distinct().orderBy("doc_key").limit(5)
    return p.join(F.broadcast(docs), "doc_key").orderBy(*PAGE).limit(12)


@_query("SELECT doc_key, page_no, kind, count(*) AS cells FROM (SELECT doc_key, page_no, 'char' AS kind FROM char_cells UNION ALL SELECT doc_key, page_no, 'word' FROM word_cells UNION ALL SELECT doc_key, page_no, 'textline' FROM textline_cells) GROUP BY ALL")
def cells_of_all_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The three kinds of cells as one bag, counted."""
    parts = [table(spark, sf, f"{k}_cells").select(*PAGE, F.lit(k).alias("kind")) for k in ("char", "word", "textline")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*PAGE, "kind").agg(F.count(F.lit(1)).alias("cells"))
