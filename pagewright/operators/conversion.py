"""Conversion of documents in twelve stages, as one plan over all documents and their pages.

A stage is a transformation of the table of pages and of one row of state per document: where it failed, and why. What a
failed document has yet before it is skipped by condition, not by exception, so a bad document never stops another, and
no document is gathered into one task: pages stay rows. Decoding, OCR and layout detection are functions over rows or
providers called page by page.

States of a document: succeeded, or failed at the first stage that fails; later stages are skipped, unloading always runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import geometry as g
from pagewright.operators import layout, reading_order
from pagewright.operators.pipeline import FAILED, SKIPPED, STAGES, SUCCEEDED, Policy, Provider, provider_chain, run_ocr, stop_on_failure
from pagewright.schema import CELL
from pagewright.session import cut_lineage
from pagewright.sources.convert import read_segmented
from pagewright.sources.layout import cell, page_json

KEY = ["doc_key", "page_no"]
(INIT, LOAD, DECODE, OCR, INFER, POST, ORDER, TRANSFORM, ANNOTATIONS, CONTENTS, META, UNLOAD) = STAGES
#: Payloads of a document, by the stage that takes them, and the columns of documents that hold them.
PAYLOADS = {ANNOTATIONS: "annotations_json", CONTENTS: "table_of_contents_json", META: "meta_xml_json"}
#: Least score of a detection (fixed value).
LEAST_SCORE = 0.1
DIAGNOSTIC = "struct<code:string,stage_name:string,page_number:int,error_type:string,message:string,recoverable:boolean>"


@dataclass(frozen=True)
class Request:
    """What is asked of a conversion; columns of documents (run_id, password, ...) are per document."""

    timeout: float = 30.0
    max_pages: int | None = None
    continue_on_page_error: bool = False
    ocr: bool = False
    policy: Policy = field(default_factory=Policy)
    layout: bool = False
    compat: bool = False
    transform: Callable[[DataFrame], DataFrame | None] | None = None
    annotations: bool = False
    table_of_contents: bool = False
    meta: bool = False

    def __post_init__(self) -> None:
        if self.timeout <= 0:
            raise ValueError("the timeout must be positive")
        if self.max_pages is not None and self.max_pages <= 0:
            raise ValueError("the page limit must be positive")

    def includes(self, stage: str) -> bool:
        return {ANNOTATIONS: self.annotations, CONTENTS: self.table_of_contents, META: self.meta}[stage]


@dataclass(frozen=True)
class Converted:
    """documents: one row each, with status, stages and diagnostics; pages: doc_key, page_no, page of what was decoded;
    page_errors: doc_key, page_no, error_type, message."""

    documents: DataFrame
    pages: DataFrame
    page_errors: DataFrame


def with_run_ids(documents: DataFrame, run: str = "run_id", of: tuple[str, ...] = ("doc_index", "file_path")) -> DataFrame:
    """documents with run ids where there were none: hashes of the row's columns, so that a task that runs again gives the same."""
    own = F.concat(F.lit("run_"), F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in of])))
    return documents.withColumn(run, F.coalesce(F.col(run), own) if run in documents.columns else own)


def decode(pages: DataFrame) -> DataFrame:
    """pages (page_json) with page and error, which is null for a page that could be read."""
    read = read_segmented(pages)
    is_object = F.expr("try_parse_json(page_json)").isNotNull() & F.ltrim("page_json").startswith("{")
    error = F.when(F.col("page_json").isNull(), "no page").when(~is_object, "invalid JSON").when(F.col("page").isNull(), "no payload")
    return read.withColumn("error", error).withColumn("page", F.when(error.isNull(), F.col("page")))


# OCR


def resolved_bitmap(uri: Column, file_path: Column) -> Column:
    """The local path of a bitmap: of a file URI, a rooted path, or one relative to the document's folder; else null."""
    folder = F.regexp_extract(file_path, r"^(.*[/\\])", 1)
    rooted = uri.rlike(r"^([/\\]|[A-Za-z]:[/\\])")
    return F.when(F.trim(uri) == "", None).when(uri.rlike("(?i)^file://"), F.url_decode(F.regexp_replace(uri, "(?i)^file://(localhost)?", ""))).when(rooted, uri).when(uri.rlike("(?i)^[a-z][a-z0-9+.-]+:"), None).otherwise(F.concat(folder, uri))


def needs_ocr(page: Column, file_path: Column) -> Column:
    """Pages without word cells that have a bitmap on a local path."""
    local = F.exists(page["bitmap_resources"], lambda b: F.coalesce(resolved_bitmap(b["uri"], file_path).isNotNull(), F.lit(False)))
    return F.coalesce(F.size(page["word_cells"]) <= 0, F.lit(True)) & F.coalesce(local, F.lit(False))


def with_word(page: Column, text: Column, confidence: Column) -> Column:
    """The page with one word cell of its size that holds the text read from its bitmap; its index follows the largest."""
    r = page["dimension"]["rect"]
    index = F.coalesce(F.array_max(F.transform(page["word_cells"], lambda c: c["index"])) + 1, F.lit(0))
    word = cell(index, g.rect_box(r), text, F.lit("ocr"), confidence).withField("text_direction", F.lit("unknown")).withField("font_key", F.lit("ocr")).withField("from_ocr", F.lit(True)).cast(CELL)
    return page.withField("word_cells", F.concat(F.coalesce(page["word_cells"], F.array().cast(f"array<{CELL}>")), F.array(word))).withField("has_words", F.lit(True))


_OCR = "doc_key string, page_no int, text string, confidence double, provider string, codes array<struct<code:string,provider:string>>, error string"


def read_bitmaps(pages: DataFrame, providers: list[Provider], policy: Policy) -> DataFrame:
    """doc_key, page_no, text, confidence, provider, codes, error of each page (doc_key, page_no, file_path, bitmaps), by
    the chain of providers. A provider gets a page's paths, and gives its text or (text, confidence)."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    chain = provider_chain([], providers, policy.preferred)
    schema = to_arrow_schema(T._parse_datatype_string(_OCR))

    def work(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                out: dict[str, Any] = {"doc_key": row["doc_key"], "page_no": row["page_no"], "codes": []}
                try:
                    result, out["provider"], notes = run_ocr(chain, policy, row)
                    out["codes"] = [{"code": c, "provider": p} for c, p in notes]
                    out["text"], out["confidence"] = result if isinstance(result, tuple) else (result, None)
                except Exception as x:  # noqa: BLE001  fatal for this document only
                    out["error"] = f"{type(x).__name__}: {x}"
                rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col("doc_key").cast("string"), F.col("page_no").cast("int"), "file_path", "bitmaps").mapInArrow(work, T._parse_datatype_string(_OCR))


# Layout


def clusters_of(detections: DataFrame, pages: DataFrame, on: list[str] = KEY) -> DataFrame:
    """on, pos, id, label, l, b, r, t, confidence: a detector's boxes as clusters. detections: on, pos, label_id, score and
    l, t, r, b from the upper left corner; pages: on, page_height. Low scores and unknown labels are left out, ids count
    from 1 by pos."""
    names = F.array(*[F.lit(x) for x in layout.LABELS])
    own = detections.where((F.col("score") >= LEAST_SCORE) & (F.col("label_id") >= 0) & (F.col("label_id") < len(layout.LABELS)))
    own = own.join(pages.select(*on, "page_height"), on)
    row = F.struct("pos", F.element_at(names, F.col("label_id").cast("int") + 1).alias("label"), "l", (F.col("page_height") - F.col("b")).alias("b"), "r", (F.col("page_height") - F.col("t")).alias("t"), F.col("score").alias("confidence"))
    numbered = own.groupBy(*on).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(*on, F.posexplode("rows").alias("n", "c"))  # a page bounds the group
    return numbered.select(*on, "c.pos", (F.col("n") + 1).alias("id"), "c.label", "c.l", "c.b", "c.r", "c.t", "c.confidence")


def clusters_by_angle(clusters: DataFrame, pages: DataFrame, doc: str = "doc_key", page: str = "page_no") -> DataFrame:
    """Compatible look-up: pages (doc, page, angle) get the clusters of the document's last page of that number which is
    their whole angle, as if clusters were kept under the angle of the page they were found on; others get none."""
    angle = F.col("angle").cast("int")
    last = pages.join(clusters.select(doc, page).distinct(), [doc, page], "left_semi").groupBy(doc, angle.alias("_angle")).agg(F.max(page).alias("_of"))
    own = pages.select(doc, page, angle.alias("_angle")).join(last, [doc, "_angle"])
    return own.join(clusters.withColumnRenamed(page, "_of"), [doc, "_of"]).drop("_angle", "_of")


def ordered_pages(pages: DataFrame, clusters: DataFrame, compat: bool = False) -> DataFrame:
    """pages (doc_key, page_no, page) with their lines put into the order of the clusters they belong to, and clusters:
    the final ones. compat: clusters found by angle, lines replaced by the cells of all three kinds in reading order."""
    p = F.col("page")
    size = pages.select(*KEY, p["dimension"]["rect"]["r_x2"].alias("page_width"), p["dimension"]["rect"]["r_y2"].alias("page_height"))
    if compat:
        clusters = clusters_by_angle(clusters, pages.select(*KEY, p["dimension"]["angle"].alias("angle")))
        cells = F.concat(*[F.coalesce(p[k], F.array().cast(f"array<{CELL}>")) for k in ("char_cells", "word_cells", "textline_cells")])
    else:
        cells = p["textline_cells"]
    c = pages.select(*KEY, F.posexplode(cells).alias("pos", "cell")).withColumn("box", g.rect_box("cell.rect"))
    flat = c.select(*KEY, "pos", F.coalesce("cell.index", "pos").cast("bigint").alias("index"), F.col("cell.text").alias("text"), "box.l", "box.b", "box.r", "box.t", F.col("cell.confidence").alias("confidence"))
    final = layout.postprocess(clusters, flat, size, KEY)
    if compat:
        elements = flat.join(size, KEY).withColumn("label", F.lit("text"))
        order = reading_order.reading_order(elements, KEY).select(*KEY, "pos", F.struct("order").alias("place"))
    else:
        elements = final.join(size, KEY)
        placed = reading_order.reading_order(elements, KEY).select(*KEY, "order", F.posexplode("cells").alias("within", "index"))
        first = placed.groupBy(*KEY, "index").agg(F.min(F.struct("order", "within")).alias("place"))
        order = flat.select(*KEY, "pos", "index").join(first, [*KEY, "index"], "left").select(*KEY, "pos", "place")
    lines = c.select(*KEY, "pos", "cell").join(order, [*KEY, "pos"], "left")
    # lines without a cluster follow, as they stood; a page bounds the group
    sorted_ = lines.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("place").isNull().alias("none"), "place", "pos", "cell"))), lambda x: x["cell"]).alias("_lines"))
    done = pages.join(sorted_, KEY, "left").withColumn("page", F.when(F.col("_lines").isNotNull(), p.withField("textline_cells", F.col("_lines"))).otherwise(p)).drop("_lines")
    return done


# The run


def _diagnostic(code: str | Column, stage: str | None, error_type: str | Column, message: Column, recoverable: bool | Column, page: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(code).alias("code"), F.lit(stage).cast("string").alias("stage_name"), (page if page is not None else F.lit(None)).cast("int").alias("page_number"), as_column(error_type).alias("error_type"), message.alias("message"), as_column(recoverable).alias("recoverable"))


def convert_documents(
    documents: DataFrame,
    pages: DataFrame,
    request: Request = Request(),
    decoder: Callable[[DataFrame], DataFrame] = decode,
    ocr_providers: list[Provider] | None = None,
    detector: Callable[[DataFrame], DataFrame] | None = None,
) -> Converted:
    """Runs the stages. documents: doc_key, file_path, optionally run_id, annotations_json, table_of_contents_json,
    meta_xml_json and, by stage name, <stage>_error; pages: doc_key, page_no from 1, and what the decoder reads.
    detector: from pages (doc_key, page_no, page) to detections as clusters_of takes them.

    A document without file_path can't be asked for: it fails before the first stage. One without pages fails to load.
    Of a page that stands several times the least row counts."""
    docs = with_run_ids(documents, of=tuple(c for c in ("doc_index", "file_path") if c in documents.columns)).dropDuplicates(["doc_key"])
    decoded = cut_lineage(decoder(pages).select(*KEY, "page", "error"))  # each page is decoded once
    # pages of a document are counted without being gathered
    within = decoded if request.max_pages is None else decoded.where(F.col("page_no") <= request.max_pages)
    bad = F.col("error").isNotNull()
    every = decoded.groupBy("doc_key").agg(F.count_distinct("page_no").cast("int").alias("page_count"))
    stop = within.groupBy("doc_key").agg(F.min(F.when(bad, F.struct("page_no", "error"))).alias("first"))
    if request.continue_on_page_error:
        kept = within.where(~bad)
        counts = within.groupBy("doc_key").agg(F.count(F.lit(1)).cast("int").alias("attempted"), F.count_if(~bad).cast("int").alias("succeeded"))
    else:
        reached = within.join(stop, "doc_key").where(F.col("first").isNull() | (F.col("page_no") <= F.col("first.page_no"))).drop("first")
        kept = reached.where(~bad)
        counts = reached.groupBy("doc_key").agg(F.count(F.lit(1)).cast("int").alias("attempted"), F.count_if(~bad).cast("int").alias("succeeded"))
    errors = within.where(bad & F.lit(request.continue_on_page_error)).select(*KEY, F.lit("PageDecodeError").alias("error_type"), F.col("error").alias("message"))

    state = docs.join(every, "doc_key", "left").join(stop, "doc_key", "left").join(counts, "doc_key", "left").na.fill(0, ["page_count", "attempted", "succeeded"])
    unasked = F.coalesce(F.trim("file_path") == "", F.lit(True))
    failure = F.when(unasked, F.struct(F.lit(-1).alias("at"), F.lit("no file path").alias("message")))
    failure = failure.when(F.col("page_count") == 0, F.struct(F.lit(STAGES.index(LOAD)).alias("at"), F.lit("no such document").alias("message")))
    if not request.continue_on_page_error:
        failure = failure.when(F.col("first").isNotNull(), F.struct(F.lit(STAGES.index(DECODE)).alias("at"), F.concat(F.lit("page "), F.col("first.page_no").cast("string"), F.lit(": "), F.col("first.error")).alias("message")))
    state = state.withColumn("failure", failure).drop("first")
    extra: list[DataFrame] = []  # doc_key, d: diagnostics of the stages
    if request.continue_on_page_error:
        extra.append(errors.select("doc_key", _diagnostic("decode_page_failed", DECODE, "PageDecodeError", F.col("message"), True, F.col("page_no")).alias("d")))
    own = kept.select(*KEY, "page")

    def fails(state: DataFrame, found: DataFrame, stage: str) -> DataFrame:
        """state where the documents of found (doc_key, message) fail at a stage, if they haven't yet."""
        new = F.struct(F.lit(STAGES.index(stage)).alias("at"), F.col("message"))
        return state.join(found, "doc_key", "left").withColumn("failure", F.coalesce("failure", F.when(F.col("message").isNotNull(), new))).drop("message")

    def asked_for(state: DataFrame, pages_: DataFrame) -> DataFrame:
        return pages_.join(state.where("failure is null").select("doc_key", "file_path"), "doc_key")

    state = state.withColumns({"ocr_provider": F.lit(None).cast("string"), "layout_applied": F.lit(False)})
    if request.ocr and not ocr_providers:
        note = _diagnostic("ocr_provider_unavailable", OCR, "NoOcrProvider", F.lit("no OCR provider is configured"), not request.policy.required)
        extra.append(state.where("failure is null").select("doc_key", note.alias("d")))
        if request.policy.required:
            state = fails(state, state.select("doc_key", F.lit("no OCR provider is configured").alias("message")), OCR)
    elif request.ocr:
        todo = asked_for(state, own).where(needs_ocr(F.col("page"), F.col("file_path")))
        paths = F.array_compact(F.transform("page.bitmap_resources", lambda b: resolved_bitmap(b["uri"], F.col("file_path"))))
        read = read_bitmaps(todo.select(*KEY, "file_path", paths.alias("bitmaps")), ocr_providers, request.policy)
        notes = read.select("doc_key", F.explode("codes").alias("c")).select("doc_key", "c.*").distinct()
        extra.append(notes.select("doc_key", _diagnostic(F.col("code"), OCR, "OcrProvider", F.col("provider"), True).alias("d")))
        per = read.groupBy("doc_key").agg(F.min("error").alias("message"), F.min(F.when(F.col("text").isNotNull(), F.col("provider"))).alias("_provider"))
        state = fails(state, per.select("doc_key", "message"), OCR).join(per.select("doc_key", "_provider"), "doc_key", "left").withColumn("ocr_provider", F.col("_provider")).drop("_provider")
        texts = read.where("text is not null").select(*KEY, "text", "confidence")
        own = own.join(texts, KEY, "left").withColumn("page", F.when(F.col("text").isNotNull(), with_word(F.col("page"), F.col("text"), F.col("confidence"))).otherwise(F.col("page"))).drop("text", "confidence")
    if request.layout and detector is not None:
        todo = asked_for(state, own).drop("file_path")
        found = clusters_of(detector(todo), todo.select(*KEY, F.col("page.dimension.rect.r_y2").alias("page_height")))
        done = ordered_pages(todo, found, request.compat)
        own = done.unionByName(own.join(state.where("failure is not null").select("doc_key"), "doc_key", "left_semi"))
        state = state.join(found.select("doc_key").distinct().withColumn("_has", F.lit(True)), "doc_key", "left").withColumn("layout_applied", F.col("failure").isNull() & F.coalesce("_has", F.lit(False))).drop("_has")
    if request.transform is not None:
        todo = asked_for(state, own).drop("file_path")
        new = request.transform(todo)
        if new is None:
            state = fails(state, state.select("doc_key", F.lit("the transform gave no pages").alias("message")), TRANSFORM)
        else:
            gone = todo.select("doc_key").distinct().join(new.select("doc_key").distinct(), "doc_key", "left_anti")
            extra.append(gone.select("doc_key", _diagnostic("transform_returned_empty", TRANSFORM, "TransformReturnedEmpty", F.lit("the transform gave no pages of this document"), True).alias("d")))
            own = new.select(*KEY, "page").unionByName(own.join(state.where("failure is not null").select("doc_key"), "doc_key", "left_semi"))
    for stage, column in PAYLOADS.items():
        wanted = request.includes(stage)
        if wanted and f"{stage}_error" in state.columns:
            new = F.struct(F.lit(STAGES.index(stage)).alias("at"), F.col(f"{stage}_error").alias("message"))
            state = state.withColumn("failure", F.coalesce("failure", F.when(F.col(f"{stage}_error").isNotNull(), new)))
        reached = F.col("failure").isNull() | (F.col("failure.at") > STAGES.index(stage))
        there = F.col(column) if column in state.columns else F.lit(None).cast("string")
        state = state.withColumn(column, F.when(reached & F.lit(wanted), there))

    at, ok = F.col("failure.at"), F.col("failure").isNull()
    results = []
    for i, name in enumerate(STAGES):
        cleanup = name == UNLOAD
        status = F.lit(SUCCEEDED) if cleanup else F.when(ok | (F.lit(i) < at), SUCCEEDED).when(at == i, FAILED).otherwise(SKIPPED)
        results.append(F.struct(F.lit(name).alias("stage"), F.lit("cleanup" if cleanup else "regular").alias("kind"), status.alias("status"), F.when(at == i, F.col("failure.message")).alias("error")))
    stages = F.when(at == -1, F.array().cast("array<struct<stage:string,kind:string,status:string,error:string>>")).otherwise(F.array(*results))
    failed_stage = F.when(at >= 0, F.element_at(F.array(*[F.lit(s) for s in STAGES]), at + 1))
    last = F.when(at == -1, F.array(_diagnostic("batch_document_unhandled_exception", None, "ValueError", F.col("failure.message"), False)))
    last = last.when(~ok, F.array(F.struct(F.lit("stage_failed").alias("code"), failed_stage.alias("stage_name"), F.lit(None).cast("int").alias("page_number"), F.lit("StageFailure").alias("error_type"), F.col("failure.message").alias("message"), F.lit(False).alias("recoverable"))))
    notes = None
    for d in extra:
        notes = d if notes is None else notes.unionByName(d)
    if notes is None:
        state = state.withColumn("_notes", F.array().cast(f"array<{DIAGNOSTIC}>"))
    else:
        grouped = notes.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.col("d").cast(DIAGNOSTIC))).alias("_notes"))  # at most a few a page
        state = state.join(grouped, "doc_key", "left")
    none = F.array().cast(f"array<{DIAGNOSTIC}>")
    state = state.withColumns({"status": F.when(ok, SUCCEEDED).otherwise(FAILED), "failure_stage": failed_stage, "error": F.col("failure.message"), "stages": stages, "diagnostics": F.concat(F.coalesce("_notes", none), F.coalesce(last.cast(f"array<{DIAGNOSTIC}>"), none))})
    return Converted(state.drop("failure", "_notes"), own, errors)


def backend_runs(converted: DataFrame) -> DataFrame:
    """doc_key, status, pages, stages, diagnostics of documents that have no stages (doc_key, page_no, page, error): a
    failure is one failed stage and its diagnostic."""
    per = converted.groupBy("doc_key").agg(F.count("page").cast("int").alias("pages"), F.min("error").alias("error"))
    failed = F.col("error").isNotNull()
    stage = F.array(F.struct(F.lit("backend_convert").alias("stage"), F.lit("regular").alias("kind"), F.lit(FAILED).alias("status"), F.col("error").alias("error")))
    note = F.array(_diagnostic("backend_failure", "backend_convert", F.split_part(F.col("error"), F.lit(":"), F.lit(1)), F.col("error"), False))
    return per.select("doc_key", F.when(failed, FAILED).otherwise(SUCCEEDED).alias("status"), "pages", F.when(failed, stage).otherwise(F.slice(stage, 1, 0)).alias("stages"), F.when(failed, note).otherwise(F.slice(note, 1, 0)).alias("diagnostics"))


def batch_documents(results: DataFrame, continue_on_failure: bool = True, batch: str = "batch_run_id", index: str = "doc_index") -> DataFrame:
    """results in batches: where a batch stops at its first failure, what follows is skipped and says so."""
    if continue_on_failure:
        return results
    stopped = stop_on_failure(results.withColumn("_was", F.col("status")), batch, index)
    skipped = (F.col("status") == SKIPPED) & (F.col("_was") != SKIPPED)
    note = F.array(_diagnostic("batch_document_skipped", None, "BatchExecutionStopped", F.lit("an earlier document of the batch failed"), True)).cast(f"array<{DIAGNOSTIC}>")
    empty = {c: F.when(~skipped, F.col(c)) for c in ("failure_stage", "error", "stages") if c in results.columns}
    zero = {c: F.when(skipped, 0).otherwise(F.col(c)) for c in ("page_count", "attempted", "succeeded") if c in results.columns}
    return stopped.withColumns({"diagnostics": F.when(skipped, note).otherwise(F.col("diagnostics")), **empty, **zero}).drop("_was")


def segmented(pages: DataFrame) -> DataFrame:
    """doc_key, page_no, page_json of converted pages."""
    return pages.select(*KEY, page_json(F.col("page")).alias("page_json"))


__all__ = ["Converted", "Request", "backend_runs", "batch_documents", "clusters_by_angle", "clusters_of", "convert_documents", "decode", "needs_ocr", "ordered_pages", "read_bitmaps", "resolved_bitmap", "segmented", "with_run_ids", "with_word"]
