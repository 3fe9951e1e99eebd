"""Staged conversion with per-document status, diagnostics, provider policies and batches.

A stage is a named function from DataFrame to DataFrame; stages of a pipeline are chained lazily and fuse into one plan.
Where stages are imperative (a decoder, a provider), run_stages carries a document through them inside one task: the first
failure, cancellation or timeout ends it, later regular stages are skipped, cleanup stages always run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUCCEEDED, FAILED, CANCELLED, TIMED_OUT, SKIPPED = "succeeded", "failed", "cancelled", "timedout", "skipped"
#: Stages of a page conversion in order (fixed values); the last is a cleanup stage.
STAGES = ("init_session", "load_document", "decode_pages", "apply_ocr_fallback", "apply_layout_inference", "apply_layout_postprocessing", "apply_reading_order", "transform_pages", "extract_annotations", "extract_table_of_contents", "extract_meta_xml", "unload_document")


class Cancelled(Exception):
    """Raised by a stage to cancel its document."""


@dataclass(frozen=True)
class Stage:
    name: str
    action: Callable[[dict[str, Any]], None]
    cleanup: bool = False


@dataclass
class Run:
    status: str = SUCCEEDED
    failure_stage: str | None = None
    error: str | None = None
    results: list[dict[str, Any]] = field(default_factory=list)
    events: list[dict[str, Any]] = field(default_factory=list)


def run_stages(stages: Iterable[Stage], context: dict[str, Any], timeout: float | None = None, clock: Callable[[], float] = time.monotonic) -> Run:
    """Carries one document through the stages. The deadline is looked at between stages, and by stages that call
    context["check"]. The first terminal status stays, whatever cleanup does."""
    if timeout is not None and timeout <= 0:
        raise ValueError("the timeout must be positive")
    begin, run = clock(), Run()

    def check() -> None:
        if timeout is not None and clock() - begin > timeout:
            raise TimeoutError(f"over {timeout:g} s")

    context["check"] = check
    run.events.append({"kind": "run_started", "stage": None})
    for stage in stages:
        if run.status != SUCCEEDED and not stage.cleanup:
            run.results.append({"stage": stage.name, "kind": "regular", "status": SKIPPED, "duration_us": 0, "error": None})
            continue
        run.events.append({"kind": "stage_started", "stage": stage.name})
        at, status, error = clock(), SUCCEEDED, None
        try:
            if run.status == SUCCEEDED:
                check()
            else:
                context["check"] = lambda: None  # cleanup isn't cancelled
            stage.action(context)
        except (Cancelled, TimeoutError) as x:
            status, error = CANCELLED, f"{type(x).__name__}: {x}"
            if run.status == SUCCEEDED:
                run.status, run.failure_stage, run.error = TIMED_OUT if isinstance(x, TimeoutError) else CANCELLED, stage.name, error
        except Exception as x:  # noqa: BLE001
            status, error = FAILED, f"{type(x).__name__}: {x}"
            if run.status == SUCCEEDED:
                run.status, run.failure_stage, run.error = FAILED, stage.name, error
        run.results.append({"stage": stage.name, "kind": "cleanup" if stage.cleanup else "regular", "status": status, "duration_us": int((clock() - at) * 1e6), "error": error})
        run.events.append({"kind": "stage_completed" if status == SUCCEEDED else "stage_failed", "stage": stage.name})
    run.events.append({"kind": "run_completed", "stage": None})
    return run


_RUN = "status string, failure_stage string, error string, stages array<struct<stage:string,kind:string,status:string,duration_us:bigint,error:string>>"


def convert_each(documents: DataFrame, stages: Callable[[], list[Stage]], outputs: str, timeout: float | None = None) -> DataFrame:
    """documents with the run (status, failure_stage, error, stages) and the outputs (a DDL string) that stages left in the
    context under their names. Each document is one row of one task; no shuffle."""
    extra = T._parse_datatype_string(f"{outputs}, {_RUN}")
    made = [n for n in extra.names if n not in ("status", "failure_stage", "error", "stages")]
    columns = documents.columns

    def work(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType([*documents_schema.fields, *extra.fields]))
        own = stages()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                context = dict(row)
                run = run_stages(own, context, timeout)
                rows.append({**{c: row[c] for c in columns}, **{n: context.get(n) for n in made}, "status": run.status, "failure_stage": run.failure_stage, "error": run.error, "stages": run.results})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    documents_schema = documents.schema
    return documents.mapInArrow(work, T.StructType([*documents_schema.fields, *extra.fields]))


def stage_diagnostics(runs: DataFrame, on: list[str], stages: str = "stages") -> DataFrame:
    """on, code, stage_name, error, recoverable: failed and cancelled stages, none of them recoverable."""
    s = runs.select(*on, F.explode(stages).alias("s")).where(F.col("s.status").isin(FAILED, CANCELLED))
    return s.select(*on, F.concat(F.lit("stage_"), F.col("s.status")).alias("code"), F.col("s.stage").alias("stage_name"), F.col("s.error").alias("error"), F.lit(False).alias("recoverable"))


# Batches


def stop_on_failure(runs: DataFrame, batch: str, index: str, status: str = "status") -> DataFrame:
    """runs where whatever follows a batch's first failure is skipped. The first failure is found by aggregation, so a
    batch isn't sorted."""
    first = runs.where(~F.col(status).isin(SUCCEEDED, SKIPPED)).groupBy(batch).agg(F.min(index).alias("_first"))
    after = F.col(index) > F.col("_first")
    return runs.join(first, batch, "left").withColumn(status, F.when(after, SKIPPED).otherwise(F.col(status))).drop("_first")


def count_by(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, key, n: counts per key, null and blank keys left out."""
    return df.where(F.col(key).isNotNull() & (F.trim(key) != "")).groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))


def count_maps(runs: DataFrame, diagnostics: DataFrame, batch: str = "batch_run_id", run: str = "run_id") -> DataFrame:
    """batch and four maps of counts: by status, pipeline status, diagnostic code and stage. Counted before gathering, so a
    map is as large as its keys are many."""
    noted = diagnostics.join(runs.select(run, batch), run)
    out = runs.select(batch).distinct()
    for name, df, key in (("status_counts", runs, "status"), ("pipeline_status_counts", runs, "pipeline_status"), ("code_counts", noted, "code"), ("stage_counts", noted, "stage_name")):
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col("n").alias("value")))))
        out = out.join(count_by(df, [batch], key).groupBy(batch).agg(entries.alias(name)), batch, "left").withColumn(name, F.coalesce(F.col(name), F.create_map().cast("map<string,bigint>")))
    return out


def batch_summary(runs: DataFrame, diagnostics: DataFrame, batch: str = "batch_run_id", run: str = "run_id") -> DataFrame:
    """One row per batch: ten counters. runs and diagnostics meet after both are aggregated by run and batch."""
    per_run = diagnostics.groupBy(run).agg(F.count(F.lit(1)).alias("_d"), F.count_if("recoverable").alias("_r"))
    done = F.col("status") != SKIPPED
    s = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint")
    return (
        runs.join(per_run, run, "left")
        .groupBy(batch)
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if(F.col("status") == SUCCEEDED).alias("succeeded_documents"),
            F.count_if(F.col("status") == FAILED).alias("failed_documents"),
            F.count_if(F.col("status") == SKIPPED).alias("skipped_documents"),
            s("page_count").alias("pages"),
            s("attempted").alias("attempted_pages"),
            s("succeeded").alias("succeeded_pages"),
            F.coalesce(F.sum("_d"), F.lit(0)).alias("diagnostics"),
            F.coalesce(F.sum("_r"), F.lit(0)).alias("recoverable_diagnostics"),
            (F.coalesce(F.sum("_d"), F.lit(0)) - F.coalesce(F.sum("_r"), F.lit(0))).alias("fatal_diagnostics"),
        )
    )


def artifact_bundle(runs: DataFrame, diagnostics: DataFrame, slug: Column, pages: DataFrame | None = None, run: str = "run_id", batch: str = "batch_run_id") -> DataFrame:
    """batch, relative_path, content_type, content: the files of a batch, ordered by path where they are written."""
    own = runs.withColumn("_slug", slug)
    kind = F.lit("application/json")
    summary = F.to_json(F.struct(*[F.col(c) for c in runs.columns]), {"ignoreNullFields": "false"})
    files = [own.select(batch, F.concat("_slug", F.lit("/summary.json")).alias("relative_path"), kind.alias("content_type"), summary.alias("content"))]
    lists = diagnostics.groupBy(run).agg(F.to_json(F.sort_array(F.collect_list(F.struct("code", "stage_name", "page_number", "error_type", "message", "recoverable"))), {"ignoreNullFields": "false"}).alias("_d"))
    files.append(own.join(lists, run, "left").select(batch, F.concat("_slug", F.lit("/diagnostics.json")).alias("relative_path"), kind.alias("content_type"), F.coalesce("_d", F.lit("[]")).alias("content")))
    if pages is not None:
        own_pages = pages.groupBy(run).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page_json"))), lambda p: p["page_json"]), ","), F.lit("]")).alias("_p"))
        files.append(own.join(own_pages, run).select(batch, F.concat("_slug", F.lit("/pages.segmented.json")).alias("relative_path"), kind.alias("content_type"), F.col("_p").alias("content")))
    entries = own.groupBy(batch).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("doc_index", "_slug", "status"))), lambda e: F.struct(e["doc_index"].alias("index"), e["_slug"].alias("path"), e["status"].alias("status")))).alias("content"))
    files.append(entries.select(batch, F.lit("manifest.json").alias("relative_path"), kind.alias("content_type"), "content"))
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def write_bundle(files: DataFrame, directory: str, clean: bool = True) -> None:
    """Writes relative_path and content below a directory that all executors share. Paths that lead out of it are refused
    before anything is written or removed. Each partition writes its own files, so nothing is collected."""
    import shutil
    from pathlib import Path

    bad = F.col("relative_path").rlike(r"(^|[/\\])\.\.([/\\]|$)") | F.col("relative_path").rlike(r"^([/\\]|[A-Za-z]:)")
    outside = files.where(bad).select("relative_path").take(1)
    if outside:
        raise ValueError(f"outside of the directory: {outside[0][0]}")
    root = Path(directory)
    if clean and root.exists():
        shutil.rmtree(root)
    root.mkdir(parents=True, exist_ok=True)

    def write(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = Path(directory, path)
                at.parent.mkdir(parents=True, exist_ok=True)
                at.write_text(content or "", encoding="utf-8")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("relative_path", "content").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


# Providers


class Provider(Protocol):
    name: str
    priority: int
    external: bool
    trusted: bool

    def available(self) -> bool: ...
    def supports(self, language: str | None) -> bool: ...
    def process(self, request: dict[str, Any]) -> tuple[str, Any]: ...


@dataclass(frozen=True)
class Policy:
    language: str | None = None
    preferred: tuple[str, ...] = ()
    allowed: tuple[str, ...] | None = None
    allow_external: bool = False
    allow_untrusted: bool = False
    required: bool = False


def provider_chain(custom: list[Provider], default: list[Provider], preferred: tuple[str, ...] = ()) -> list[Provider]:
    """Each name once, custom ones first; then preferred names in their order, then by priority and name."""
    by: dict[str, Provider] = {}
    for p in [*custom, *default]:
        by.setdefault(p.name.casefold(), p)
    rank = {n.casefold(): i for i, n in reversed(list(enumerate(preferred)))}
    return sorted(by.values(), key=lambda p: (rank.get(p.name.casefold(), len(rank)), p.priority, p.name.casefold()))


def run_ocr(chain: list[Provider], policy: Policy, request: dict[str, Any]) -> tuple[Any, str | None, list[tuple[str, str]]]:
    """(result or None, the provider's name, diagnostics (code, provider)). A provider that raises is fatal; recoverable
    failures pass on to the next; if none is left, that fails only where a result is required."""
    notes: list[tuple[str, str]] = []
    for p in chain:
        name = p.name
        if policy.allowed is not None and name.casefold() not in {a.casefold() for a in policy.allowed}:
            notes.append(("ocr_provider_not_allowed", name))
        elif p.external and not policy.allow_external:
            notes.append(("ocr_provider_external_blocked", name))
        elif not p.trusted and not policy.allow_untrusted:
            notes.append(("ocr_provider_untrusted", name))
        elif not p.supports(policy.language):
            notes.append(("ocr_provider_capability_mismatch", name))
        elif not p.available():
            notes.append(("ocr_provider_unavailable", name))
        else:
            status, result = p.process(request)
            if status == "succeeded":
                return result, name, [*notes, ("ocr_provider_succeeded", name)]
            if status == "no_changes":
                return None, name, [*notes, ("ocr_provider_no_changes", name)]
            if status == "fatal":
                raise RuntimeError(f"{name}: {result}")
            notes.append(("ocr_provider_recoverable_failure", name))
    if chain:
        notes.append(("ocr_provider_exhausted", ""))
    if policy.required:
        raise RuntimeError("no provider gave text")
    return None, None, notes


def run_layout(chain: list[Provider], request: dict[str, Any]) -> tuple[Any, str | None, list[tuple[str, str]]]:
    """As run_ocr, but exceptions pass on to the next provider, and trust and origin don't count."""
    notes: list[tuple[str, str]] = []
    for p in chain:
        if not p.available():
            notes.append(("layout_provider_unavailable", p.name))
            continue
        try:
            status, result = p.process(request)
        except Exception:  # noqa: BLE001
            notes.append(("layout_provider_exception", p.name))
            continue
        if status == "succeeded":
            return result, p.name, notes
        if status == "fatal":
            raise RuntimeError(f"{p.name}: {result}")
    return None, None, notes


def transformed(pages: DataFrame, transform: Callable[[DataFrame], DataFrame | None] | None) -> DataFrame:
    """The page set after a user's transform; a transform that gives nothing is an error."""
    if transform is None:
        return pages
    out = transform(pages)
    if out is None:
        raise ValueError("the transform gave no pages")
    return out


__all__ = ["artifact_bundle", "batch_summary", "convert_each", "count_by", "count_maps", "provider_chain", "run_layout", "run_ocr", "run_stages", "stage_diagnostics", "stop_on_failure", "transformed", "write_bundle"]
