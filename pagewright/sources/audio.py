"""Transcripts as pages: a cell per segment with its times and voice; and as lines of text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.geometry import box
from pagewright.operators.pipeline import Stage, convert_each
from pagewright.sources.layout import cell

HYDRATED = ("audio_key", "index", "text", "start_time", "end_time", "voice")


def hydrate(segments: DataFrame, key: str = "audio_key") -> DataFrame:
    """key, page_no, cells: one page per recording, whose cells follow in order of time. A recording's cells form one
    row, so a recording bounds the group."""
    own = segments.where(F.col(key).isNotNull()).select(key, F.struct("start_time", "segment_id", "end_time", "text", "voice").alias("s")).distinct()
    rows = own.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    none = box(*[F.lit(0.0)] * 4)

    def one(s: Column, i: Column) -> Column:
        source = F.struct(s["start_time"].alias("start_time"), s["end_time"].alias("end_time"), s["voice"].alias("voice"))
        return cell(i, none, s["text"], F.lit(""), 1.0, source)

    return rows.select(key, F.lit(1).alias("page_no"), F.transform("s", one).alias("cells"))


def transcript_line(start: Column, end: Column, text: Column) -> Column:
    """[start -> end] text, with two decimals."""
    return F.concat(F.lit("["), F.format_string("%.2f", start), F.lit(" -> "), F.format_string("%.2f", end), F.lit("] "), text)


#: Stages of a transcription (fixed values); the last is a cleanup stage.
AUDIO_STAGES = ("init_session", "load_audio", "transcribe_audio", "hydrate_document", "unload_audio")
TIMEOUT = 300.0


class Transcriber(Protocol):
    """Gives segments (start, end, text, voice or None) and the language of 16 kHz mono samples."""

    name: str

    def available(self) -> bool: ...
    def transcribe(self, content: bytes, check: Callable[[], None]) -> tuple[list[tuple[float, float, str, str | None]], str | None]: ...


_SEGMENT = "struct<start_time:double,end_time:double,text:string,voice:string>"


def refused(path: Column) -> Column:
    """Why a path can't be transcribed: none given, or one of another host."""
    return F.when(F.coalesce(F.trim(path) == "", F.lit(True)), "no path").when(path.rlike(r"^(\\\\|//)"), "paths of other hosts are not read")


def transcribe(audio: DataFrame, provider: Transcriber | None, transcode: Callable[[bytes], bytes] | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """audio (audio_key, path, content: null where there is no file; raw: whether content is PCM already) with segments,
    language, provider, the run (status, failure_stage, error, stages) and diagnostics. One row a recording, no shuffle.
    transcode: turns any format into 16 kHz mono PCM, in the workers; without one, content goes to the provider as it is."""

    def stages() -> list[Stage]:
        def init(c: dict[str, Any]) -> None:
            if provider is None:
                raise ValueError("an ASR provider must be configured")
            if not provider.available():
                raise ValueError(f"the ASR provider {provider.name} is not available")

        def load(c: dict[str, Any]) -> None:
            if c["_refused"]:
                raise ValueError(c["_refused"])
            if c["content"] is None:
                raise FileNotFoundError(c["path"])
            c["_samples"] = c["content"] if c.get("raw") or transcode is None else transcode(bytes(c["content"]))

        def run(c: dict[str, Any]) -> None:
            found, c["language"] = provider.transcribe(bytes(c["_samples"]), c["check"])
            c["check"]()
            c["provider"] = provider.name
            c["_found"] = found

        def hydrated(c: dict[str, Any]) -> None:
            c["segments"] = [dict(zip(("start_time", "end_time", "text", "voice"), s)) for s in c["_found"]]

        return [Stage(n, f) for n, f in zip(AUDIO_STAGES, (init, load, run, hydrated))] + [Stage(AUDIO_STAGES[-1], lambda c: c.pop("_samples", None), True)]

    own = audio.withColumn("_refused", refused(F.col("path")))
    done = convert_each(own, stages, f"segments array<{_SEGMENT}>, language string, provider string", timeout).drop("_refused")
    failed_at = F.col("failure_stage")
    note = lambda code, recoverable: F.struct(F.lit(code).alias("code"), failed_at.alias("stage_name"), F.col("error").alias("message"), F.lit(recoverable).alias("recoverable"))
    code = (
        F.when(F.col("status") == "succeeded", note("asr_transcription_success", True).withField("stage_name", F.lit(AUDIO_STAGES[2])))
        .when(F.col("status") == "timedout", note("timeout", False))
        .when(failed_at == AUDIO_STAGES[0], note("asr_provider_missing", False))
        .when(failed_at == AUDIO_STAGES[2], note("asr_transcription_failed", False))
        .otherwise(note("stage_failed", False))
    )
    return done.withColumn("diagnostics", F.array(code))


def segments_of(transcribed: DataFrame) -> DataFrame:
    """audio_key, segment_id (the place), start_time, end_time, text, voice: as hydrate takes them."""
    return transcribed.select("audio_key", F.posexplode("segments").alias("segment_id", "s")).select("audio_key", F.col("segment_id").cast("bigint").alias("segment_id"), "s.*")
