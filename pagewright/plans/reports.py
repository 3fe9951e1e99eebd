"""Queries over staged conversion, batches, reports and JSON as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.functions.text import slug
from pagewright.operators import conversion, pipeline
from pagewright.operators.layout import LABELS
from pagewright.plans.nested import _elements
from pagewright.schema import REQUIRED
from pagewright.session import table
from pagewright.sinks import export
from pagewright.sources.audio import transcribe
from pagewright.sources.convert import read_segmented
from pagewright.sources.layout import page_json

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Reports on segmented pages


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are valid pages and no envelopes, once each."""
    p = table(spark, sf, "segmented_pages").where("record_id is not null").select("record_id", "doc_key", "page_no", "page_json").dropDuplicates(["record_id"])
    keys = F.json_object_keys("page_json")
    return p.where(F.expr("try_parse_json(page_json)").isNotNull() & ~F.arrays_overlap(keys, F.array(F.lit("original"), F.lit("sanitized"))))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_segmented(_records(spark, sf)).select("record_id", "doc_key", "page_no", "page.char_cells", "page.word_cells", "page.textline_cells")


_CELLS = _elements(("char_cells", "char_cells"), ("word_cells", "word_cells"), ("textline_cells", "textline_cells")).replace("WHERE json_valid(page_json)", "WHERE json_valid(page_json) AND json_type(page_json) = 'OBJECT' AND NOT json_exists(page_json, '$.original') AND NOT json_exists(page_json, '$.sanitized')")
_KNOWN = "(SELECT DISTINCT record_id, doc_key, page_no FROM segmented_pages) s JOIN (SELECT DISTINCT record_id FROM p) USING (record_id)"
_COUNTED = ", ".join(f"coalesce(max(len(items)) FILTER (path = '{p}_cells'), 0) AS {n}" for p, n in (("char", "chars"), ("word", "words"), ("textline", "lines")))
_COUNTS = _CELLS + f", c AS (SELECT record_id, doc_key, page_no, {_COUNTED} FROM {_KNOWN} LEFT JOIN l USING (record_id) GROUP BY ALL) "


@_query(_COUNTS + "SELECT record_id, page_no, chars, words, lines FROM c")
def page_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return export.page_counts(_pages(spark, sf), "record_id")


@_query(_CELLS + f" SELECT doc_key, 'rgba(' || json_extract_string(x, '$.rgba.r') || ',' || json_extract_string(x, '$.rgba.g') || ',' || json_extract_string(x, '$.rgba.b') || ',' || json_extract_string(x, '$.rgba.a') || ')' AS color, count(*) AS n FROM e JOIN (SELECT DISTINCT record_id, doc_key FROM segmented_pages) USING (record_id) WHERE path = 'char_cells' AND json_type(x, '$.rgba') = 'OBJECT' GROUP BY 1, 2")
def extraction_colors(spark: SparkSession, sf: str) -> DataFrame:
    """How often the characters of each document have each colour."""
    return export.color_counts(_pages(spark, sf), ["doc_key"])


_TEXT = "json_extract_string(x, '$.text')"
_LINES = f"SELECT record_id, string_agg(regexp_replace({_TEXT}, '[\\s]+$', '') || chr(10), '' ORDER BY pos) FILTER ({_TEXT} IS NOT NULL) AS body FROM e WHERE path = 'textline_cells' GROUP BY 1"


@_query(_CELLS + f", t AS ({_LINES}), f AS (SELECT doc_key, page_no, min(record_id) AS record_id FROM {_KNOWN} GROUP BY 1, 2) SELECT doc_key, string_agg('--- Page ' || page_no || ' ---' || chr(10) || coalesce(body, '') || chr(10), '' ORDER BY page_no) AS content, count(*) AS pages FROM f LEFT JOIN t USING (record_id) WHERE doc_key IS NOT NULL AND page_no IS NOT NULL GROUP BY doc_key")
def extraction_report(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each document, a header before each page; of several records of a page the first."""
    p = _pages(spark, sf).where("doc_key is not null and page_no is not null")
    first = p.groupBy("doc_key", "page_no").agg(F.min("record_id").alias("record_id"))
    return export.extraction_report(p.join(first, ["doc_key", "page_no", "record_id"])).select("doc_key", "content", F.size("pages").cast("bigint").alias("pages"))


@_query(_CELLS + f" SELECT record_id, string_agg({_TEXT}, chr(10) ORDER BY pos) AS texts FROM e WHERE path = 'textline_cells' AND {_TEXT} IS NOT NULL GROUP BY 1")
def text_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of each record's lines."""
    return export.text_dump(_pages(spark, sf), ["record_id"]).where(F.size("texts") > 0).select("record_id", F.array_join("texts", "\n").alias("texts"))


_PAIRS = ", ".join(f"coalesce({s}.{n}, 0) AS {name}_{n}" for s, name in (("a", "left"), ("b", "right")) for n in ("chars", "words", "lines"))
_REPORT = _COUNTS + f", m AS (SELECT doc_key, page_no, min(record_id) AS lo, max(record_id) AS hi FROM c GROUP BY 1, 2), x AS (SELECT c.* FROM c JOIN m ON c.record_id = m.lo), y AS (SELECT c.* FROM c JOIN m ON c.record_id = m.hi WHERE m.page_no % 5 <> 0), r AS (SELECT coalesce(a.doc_key, b.doc_key) AS doc_key, coalesce(a.page_no, b.page_no) AS page_no, {_PAIRS} FROM x a FULL JOIN y b ON a.doc_key = b.doc_key AND a.page_no = b.page_no) "


def _comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = _pages(spark, sf).where("doc_key is not null and page_no is not null")
    counts = export.page_counts(c.withColumn("record", F.struct("record_id", "doc_key")), "record").select("record.*", "page_no", "chars", "words", "lines")
    own = F.struct("chars", "words", "lines")
    both = counts.groupBy("doc_key", "page_no").agg(F.min_by(own, "record_id").alias("a"), F.max_by(own, "record_id").alias("b"))
    left = both.select("doc_key", "page_no", "a.*")
    right = both.where("page_no % 5 <> 0").select("doc_key", "page_no", "b.*")
    return export.comparison_report(left, right, ["doc_key", "page_no"])


_EQUAL = "left_chars = right_chars AND left_words = right_words AND left_lines = right_lines"


@_query(_REPORT + f"SELECT *, {_EQUAL} AS equal FROM r WHERE doc_key IS NOT NULL AND page_no IS NOT NULL")
def comparison_report(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of each page's first record against those of its last, every fifth page being absent there."""
    return _comparison(spark, sf)


@_query(_REPORT + f"SELECT count(*) AS pages, count(*) FILTER (NOT ({_EQUAL})) AS mismatches, " + ", ".join(f"CAST(sum({s}_{n}) AS BIGINT) AS {s}_{n}" for s in ("left", "right") for n in ("chars", "words", "lines")) + " FROM r WHERE doc_key IS NOT NULL AND page_no IS NOT NULL")
def comparison_totals(spark: SparkSession, sf: str) -> DataFrame:
    return export.comparison_totals(_comparison(spark, sf))


# JSON as files


@_query(f"SELECT record_id, round(TRY_CAST(json_extract_string(page_json, '$.dimension.rect.r_x2') AS DOUBLE), 3) AS width, round(TRY_CAST(json_extract_string(page_json, '$.textline_cells[0].rect.r_x0') AS DOUBLE), 3) AS x FROM (SELECT DISTINCT record_id, page_json FROM segmented_pages WHERE record_id IS NOT NULL AND json_valid(page_json))")
def json_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """All records with their fractions rounded."""
    p = table(spark, sf, "segmented_pages").where("record_id is not null").select("record_id", "page_json").distinct().where(F.expr("try_parse_json(page_json)").isNotNull())
    r = export.round_json(p)
    n = lambda path: F.get_json_object("rounded", path).try_cast("double")
    return r.select("record_id", n("$.dimension.rect.r_x2").alias("width"), n("$.textline_cells[0].rect.r_x0").alias("x"))


_KEYS = "array_to_string(list_sort(list_distinct(list_concat({0}, [{1}]))), ',')"
_DIMENSION = ("angle", "rect", "boundary_type", "art_bbox", "bleed_bbox", "crop_bbox", "media_bbox", "trim_bbox")


@_query(
    f"SELECT record_id, {_KEYS.format('json_keys(page_json)', ', '.join(repr(k) for k in REQUIRED))} AS keys, CASE WHEN json_type(page_json, '$.dimension') = 'OBJECT' THEN {_KEYS.format('json_keys(page_json, ' + repr('$.dimension') + ')', ', '.join(repr(k) for k in _DIMENSION))} END AS dimension_keys "
    "FROM (SELECT DISTINCT record_id, page_json FROM segmented_pages WHERE record_id IS NOT NULL AND json_valid(page_json) AND NOT json_exists(page_json, '$.original') AND NOT json_exists(page_json, '$.sanitized')) WHERE json_type(page_json) = 'OBJECT'"
)
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records read as pages and written again keep the members that pages don't know."""
    p = read_segmented(_records(spark, sf)).withColumn("written", page_json(F.col("page"))).select("record_id", "page_json", "written")
    own = export.with_unknown_members(p, "page_json", "written")
    keys = lambda j: F.array_join(F.array_sort(F.array_distinct(F.json_object_keys(j))), ",")
    return own.select("record_id", keys(F.col("json")).alias("keys"), keys(F.get_json_object("json", "$.dimension")).alias("dimension_keys"))


@_query("SELECT doc_id, md5('data:text/plain;base64,' || to_base64(encode(text))) AS uri FROM documents WHERE text IS NOT NULL")
def data_uris(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(export.data_uri(F.lit("text/plain"), F.encode("text", "UTF-8"))).alias("uri"))


# Boxes


_LINE = "(SELECT DISTINCT ON (cell_id) cell_id, " + ", ".join(f"{f}({', '.join(f'rect.r_{a}{i}' for i in range(4))}) AS {n}" for f, a, n in (("least", "x", "l"), ("least", "y", "b"), ("greatest", "x", "r"), ("greatest", "y", "t"))) + " FROM textline_cells)"


@_query(f"SELECT cell_id, r <= 300.0 AS is_left, b >= 400.0 AS is_above, l = l AND NOT (l IS NULL) AS is_same, 842.0 - t AS flipped_b, 842.0 - b AS flipped_t, CASE WHEN r > l THEN CAST(round(1000 * 72 / (r - l)) AS BIGINT) ELSE 72 END AS dpi FROM {_LINE}")
def box_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Lines left of and above a fixed box, equal to themselves, in the plane whose y axis points down, and the density of a
    picture of 1000 pixels in their place."""
    t = table(spark, sf, "textline_cells").dropDuplicates(["cell_id"]).select("cell_id", g.rect_box("rect").alias("a"))
    a, fixed = F.col("a"), g.box(*[F.lit(v) for v in (300.0, 300.0, 500.0, 400.0)])
    down = g.flip(a, F.lit(842.0))
    return t.select("cell_id", g.left_of(a, fixed).alias("is_left"), g.above(a, fixed).alias("is_above"), g.same_box(a, a).alias("is_same"), down["b"].alias("flipped_b"), down["t"].alias("flipped_t"), g.image_dpi(F.lit(1000), a["r"] - a["l"]).alias("dpi"))


@_query(
    f"WITH w AS (SELECT DISTINCT ON (cell_id) doc_key, page_no, cell_id, cell_index % 20 AS label_id, coalesce(confidence, 0.05) AS score, {_LINE.split('cell_id, ')[1].split(' FROM')[0]} FROM word_cells) "
    f"SELECT doc_key, page_no, cell_id AS pos, row_number() OVER (PARTITION BY doc_key, page_no ORDER BY cell_id) AS id, [{', '.join(repr(x) for x in LABELS)}][label_id + 1] AS label, round(b, 6) AS b, round(t, 6) AS t FROM w WHERE score >= 0.1 AND label_id BETWEEN 0 AND {len(LABELS) - 1}"
)
def detected_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Words as a detector's boxes, from the upper left corner, made clusters."""
    w = table(spark, sf, "word_cells").dropDuplicates(["cell_id"]).withColumn("a", g.rect_box("rect"))
    d = w.select("doc_key", "page_no", F.col("cell_id").alias("pos"), (F.col("cell_index") % 20).alias("label_id"), F.coalesce("confidence", F.lit(0.05)).alias("score"), "a.l", (842.0 - F.col("a.t")).alias("t"), "a.r", (842.0 - F.col("a.b")).alias("b"))
    pages = w.select("doc_key", "page_no", F.lit(842.0).alias("page_height")).distinct()
    return conversion.clusters_of(d, pages).select("doc_key", "page_no", "pos", F.col("id").cast("bigint").alias("id"), "label", F.round("b", 6).alias("b"), F.round("t", 6).alias("t"))


@_query("WITH p AS (SELECT DISTINCT doc_key, page_no FROM textline_cells), c AS (SELECT doc_key, page_no % 4 AS a, max(page_no) AS of_page FROM p WHERE page_no % 3 <> 0 GROUP BY 1, 2) SELECT p.doc_key, p.page_no, c.of_page AS id FROM p JOIN c ON p.doc_key = c.doc_key AND p.page_no % 4 = c.a")
def clusters_by_angle(spark: SparkSession, sf: str) -> DataFrame:
    """The compatible look-up: pages turned by their number modulo four, of which every third has no clusters."""
    p = table(spark, sf, "textline_cells").select("doc_key", "page_no", (F.col("page_no") % 4 + 0.5).alias("angle")).distinct()
    return conversion.clusters_by_angle(p.where("page_no % 3 <> 0").select("doc_key", "page_no", F.col("page_no").alias("id")), p).select("doc_key", "page_no", "id")


# Runs and batches


def _run(spark: SparkSession, sf: str, **request) -> conversion.Converted:
    docs = table(spark, sf, "runs").where("doc_key is not null").groupBy("doc_key").agg(F.min("file_path").alias("file_path"), F.min("doc_index").alias("doc_index"), F.min("batch_run_id").alias("batch_run_id"))
    p = table(spark, sf, "segmented_pages").where("doc_key is not null and page_no is not null")
    pages = p.groupBy("doc_key", "page_no").agg(F.min_by("page_json", "record_id").alias("page_json"))
    return conversion.convert_documents(docs, pages, conversion.Request(**request))


_DOCS = (
    "WITH d AS (SELECT doc_key, min(file_path) AS file_path, min(doc_index) AS doc_index, min(batch_run_id) AS batch_run_id FROM runs WHERE doc_key IS NOT NULL GROUP BY 1), "
    "g AS (SELECT doc_key, page_no, page_json, row_number() OVER (PARTITION BY doc_key, page_no ORDER BY record_id) AS n FROM segmented_pages WHERE doc_key IS NOT NULL AND page_no IS NOT NULL AND record_id IS NOT NULL), "
    "p AS (SELECT doc_key, page_no, CASE WHEN page_json IS NULL THEN true WHEN NOT json_valid(page_json) THEN true WHEN json_type(page_json) <> 'OBJECT' THEN true WHEN (json_exists(page_json, '$.original') OR json_exists(page_json, '$.sanitized')) AND NOT json_exists(page_json, '$.char_cells') AND NOT json_exists(page_json, '$.textline_cells') AND NOT json_exists(page_json, '$.shapes') AND NOT json_exists(page_json, '$.bitmap_resources') AND coalesce(json_type(page_json, '$.original'), 'NULL') = 'NULL' AND coalesce(json_type(page_json, '$.sanitized'), 'NULL') = 'NULL' THEN true ELSE false END AS bad FROM g WHERE n = 1), "
    "c AS (SELECT doc_key, count(*) AS page_count, min(page_no) FILTER (bad) AS first, count(*) FILTER (bad) AS bads FROM p GROUP BY 1), "
)
_STRICT = _DOCS + (
    "r AS (SELECT d.*, coalesce(page_count, 0) AS page_count, first, (SELECT count(*) FROM p WHERE p.doc_key = d.doc_key AND (first IS NULL OR page_no <= first)) AS attempted, (SELECT count(*) FROM p WHERE p.doc_key = d.doc_key AND (first IS NULL OR page_no < first)) AS succeeded FROM d LEFT JOIN c USING (doc_key)), "
    "s AS (SELECT *, CASE WHEN page_count = 0 THEN 'load_document' WHEN first IS NOT NULL THEN 'decode_pages' END AS failure_stage FROM r) "
)


@_query(_STRICT + "SELECT doc_key, CASE WHEN failure_stage IS NULL THEN 'succeeded' ELSE 'failed' END AS status, coalesce(failure_stage, '') AS failure_stage, page_count, attempted, succeeded FROM s")
def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every document of the runs through the twelve stages; a page that can't be decoded fails its document."""
    r = _run(spark, sf).documents
    return r.select("doc_key", "status", F.coalesce("failure_stage", F.lit("")).alias("failure_stage"), *[F.col(c).cast("bigint").alias(c) for c in ("page_count", "attempted", "succeeded")])


@_query(_STRICT + ", i(i, stage) AS (SELECT unnest(range(12)), unnest(['init_session', 'load_document', 'decode_pages', 'apply_ocr_fallback', 'apply_layout_inference', 'apply_layout_postprocessing', 'apply_reading_order', 'transform_pages', 'extract_annotations', 'extract_table_of_contents', 'extract_meta_xml', 'unload_document'])), f AS (SELECT doc_key, CASE failure_stage WHEN 'load_document' THEN 1 WHEN 'decode_pages' THEN 2 END AS stop FROM s) SELECT stage, CASE WHEN i = 11 OR stop IS NULL OR i < stop THEN 'succeeded' WHEN i = stop THEN 'failed' ELSE 'skipped' END AS status, count(*) AS documents FROM f, i GROUP BY 1, 2")
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents end each stage in each way."""
    s = _run(spark, sf).documents.select(F.explode("stages").alias("s"))
    return s.groupBy(F.col("s.stage").alias("stage"), F.col("s.status").alias("status")).agg(F.count(F.lit(1)).alias("documents"))


@_query(_DOCS + "q AS (SELECT doc_key, page_no, bad FROM p JOIN d USING (doc_key)) SELECT 'decode_page_failed' AS code, 'decode_pages' AS stage_name, true AS recoverable, count(*) AS n FROM q WHERE bad UNION ALL SELECT 'stage_failed', 'load_document', false, count(*) FROM d WHERE doc_key NOT IN (SELECT doc_key FROM p) HAVING count(*) > 0")
def diagnostic_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The diagnostics of a run that goes on after pages that can't be decoded."""
    d = _run(spark, sf, continue_on_page_error=True).documents.select(F.explode("diagnostics").alias("d"))
    return d.groupBy("d.code", "d.stage_name", "d.recoverable").agg(F.count(F.lit(1)).alias("n"))


@_query(_DOCS + "q AS (SELECT doc_key, page_no, bad, row_number() OVER (PARTITION BY doc_key ORDER BY page_no) AS n FROM p WHERE page_no <= 2) SELECT d.doc_key, count(q.page_no) AS attempted, count(q.page_no) FILTER (NOT bad) AS succeeded FROM d JOIN c USING (doc_key) LEFT JOIN q USING (doc_key) GROUP BY 1")
def limited_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages decoded where at most the first two are asked for."""
    r = _run(spark, sf, continue_on_page_error=True, max_pages=2).documents.where("page_count > 0")
    return r.select("doc_key", *[F.col(c).cast("bigint").alias(c) for c in ("attempted", "succeeded")])


@_query(_STRICT + ", b AS (SELECT *, CASE WHEN failure_stage IS NULL THEN 'succeeded' ELSE 'failed' END AS status, min(doc_index) FILTER (failure_stage IS NOT NULL) OVER (PARTITION BY batch_run_id) AS stop FROM s) SELECT doc_key, CASE WHEN doc_index > stop THEN 'skipped' ELSE status END AS status, CASE WHEN doc_index > stop THEN 'batch_document_skipped' WHEN status = 'failed' THEN 'stage_failed' ELSE '' END AS code FROM b")
def batch_stops(spark: SparkSession, sf: str) -> DataFrame:
    """The runs as batches that stop at their first failure."""
    b = conversion.batch_documents(_run(spark, sf).documents, continue_on_failure=False)
    return b.select("doc_key", "status", F.coalesce(F.try_element_at("diagnostics", F.lit(-1))["code"], F.lit("")).alias("code"))


_KIND = "SELECT batch_run_id, '{0}' AS kind, {1} AS key, count(*) AS n FROM {2} WHERE trim({1}) <> '' GROUP BY 1, 3"
_NOTED = "(SELECT batch_run_id, d.* FROM diagnostics d JOIN runs USING (run_id))"


@_query(" UNION ALL ".join(_KIND.format(*x) for x in (("status_counts", "status", "runs"), ("pipeline_status_counts", "pipeline_status", "runs"), ("code_counts", "code", _NOTED), ("stage_counts", "stage_name", _NOTED))))
def batch_count_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The four maps of counts of each batch, one row per key."""
    m = pipeline.count_maps(table(spark, sf, "runs"), table(spark, sf, "diagnostics"))
    out = None
    for kind in ("status_counts", "pipeline_status_counts", "code_counts", "stage_counts"):
        part = m.select("batch_run_id", F.lit(kind).alias("kind"), F.explode(kind).alias("key", "n"))
        out = part if out is None else out.unionByName(part)
    return out


_SLUG = "lpad(CAST(doc_index AS VARCHAR), 4, '0')"


@_query(
    f"WITH n AS (SELECT run_id, count(*) AS n FROM diagnostics GROUP BY 1) SELECT batch_run_id, {_SLUG} AS folder, 'summary.json' AS file, coalesce(status, '') || ' ' || coalesce(CAST(page_count AS VARCHAR), '') AS content FROM runs "
    f"UNION ALL SELECT batch_run_id, {_SLUG}, 'diagnostics.json', CAST(coalesce(n, 0) AS VARCHAR) FROM runs LEFT JOIN n USING (run_id) UNION ALL SELECT batch_run_id, '', 'manifest.json', CAST(count(*) AS VARCHAR) FROM runs GROUP BY 1"
)
def bundle_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files of each batch, by what their JSON says."""
    files = pipeline.artifact_bundle(table(spark, sf, "runs"), table(spark, sf, "diagnostics"), slug("doc_index", "file_path"))
    j, file = F.col("content"), F.element_at(F.split("relative_path", "/"), -1)
    said = F.when(file == "summary.json", F.concat_ws(" ", F.coalesce(F.get_json_object(j, "$.status"), F.lit("")), F.coalesce(F.get_json_object(j, "$.page_count"), F.lit("")))).otherwise(F.json_array_length(j).cast("string"))
    folder = F.when(F.contains("relative_path", F.lit("/")), F.substring("relative_path", 1, 4)).otherwise("")
    return files.select("batch_run_id", folder.alias("folder"), file.alias("file"), said.alias("content"))


class Lines:
    """Stands for a speech engine: content is its transcript already, a segment a line."""

    name = "lines"

    def available(self) -> bool:
        return True

    def transcribe(self, content, check):
        return [(float(i), i + 1.0, t, None) for i, t in enumerate(content.decode("utf-8").split("\n"))], "en"


@_query("WITH s AS (SELECT DISTINCT audio_key, segment_id, text FROM asr_segments WHERE audio_key IS NOT NULL AND text IS NOT NULL), a AS (SELECT audio_key, count(*) AS n, sum(length(text) - length(replace(text, chr(10), ''))) AS breaks FROM s GROUP BY 1) SELECT audio_key, CASE WHEN audio_key LIKE '%1' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN audio_key LIKE '%1' THEN 'stage_failed' ELSE 'asr_transcription_success' END AS code, CAST(CASE WHEN audio_key LIKE '%1' THEN 0 ELSE n + breaks END AS BIGINT) AS segments FROM a")
def audio_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings through the stages of transcription; some have a path of another host."""
    s = table(spark, sf, "asr_segments").where("audio_key is not null and text is not null").select("audio_key", "segment_id", "text").distinct()
    audio = s.groupBy("audio_key").agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), "\n"), "UTF-8").alias("content"))
    path = F.when(F.col("audio_key").endswith("1"), F.concat(F.lit("//host/"), "audio_key")).otherwise(F.concat(F.lit("/a/"), "audio_key"))
    r = transcribe(audio.withColumn("path", path), Lines())
    return r.select("audio_key", "status", F.col("diagnostics")[0]["code"].alias("code"), F.coalesce(F.size(F.filter("segments", lambda _: F.lit(True))), F.lit(0)).cast("bigint").alias("segments"))
