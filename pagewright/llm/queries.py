"""The queries of the operators here, over whole tables, and their SQL where DuckDB can run it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.canonical import canonical_text, changed_cells
from pagewright.llm.encoding import garbled_cells
from pagewright.llm.mixing import mix
from pagewright.llm.moderation import moderate, rates
from pagewright.llm.packing import CAPACITY, containers
from pagewright.llm.runs import exact_runs, repeated_runs
from pagewright.llm.splitting import LIMIT, split_texts
from pagewright.llm.transcripts import speaker_turns
from pagewright.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_cells(table(spark, sf, "textline_cells"), table(spark, sf, "char_cells"), restore=False)


def p1_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled_cells(table(spark, sf, "textline_cells"), table(spark, sf, "char_cells"))


def p2_turns(spark: SparkSession, sf: str) -> DataFrame:
    return speaker_turns(table(spark, sf, "asr_segments"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_turns(spark, sf).select("audio_key", "first_segment_id", "last_segment_id")


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    parts = [changed_cells(table(spark, sf, f"{kind}_cells")).withColumn("cell_kind", F.lit(kind)) for kind in ("textline", "word")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).select("cell_kind", "cell_id").distinct()


def p3_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every textline and word cell with its text in the consistent form."""
    parts = [canonical_text(table(spark, sf, f"{kind}_cells").select(F.lit(kind).alias("cell_kind"), "cell_id", "doc_key", "page_no", "cell_index", "text")) for kind in ("textline", "word")]
    return parts[0].unionByName(parts[1])


def _long_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Textlines over the limit; a redelivered cell counts once."""
    return table(spark, sf, "textline_cells").where(F.length("text") > LIMIT).select("cell_id", "text").dropDuplicates(["cell_id", "text"])


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(_long_lines(spark, sf)).drop("text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).where("piece_no = 1").select("cell_id").distinct()


def p6_runs(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_runs(table(spark, sf, "asr_segments"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_runs(spark, sf).select("audio_key", "first_segment_id", "last_segment_id")


def p6_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of segments whose text is the same to the letter, by the same walk."""
    return exact_runs(table(spark, sf, "asr_segments")).select("audio_key", "first_segment_id", "last_segment_id", "count", "start_time", "end_time")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(table(spark, sf, "documents").select("doc_id", "text"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    per = p7_containers(spark, sf).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("items"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), (F.sum("n") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "mix_targets"))[1]


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return moderate(table(spark, sf, "documents").select("doc_id", "source", "text"), table(spark, sf, "review_labels"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).where("flagged").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rates(p9_scores(spark, sf))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_turns, p3_found, p3_canonical, p5_found, p5_pieces, p6_found, p6_runs, p6_exact, p7_containers, p7_fill, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}

SQL: dict[str, str] = {
    "p6_exact": "WITH s AS (SELECT DISTINCT audio_key, segment_id, start_time, end_time, text FROM asr_segments WHERE audio_key IS NOT NULL AND segment_id IS NOT NULL AND start_time IS NOT NULL), "
    "n AS (SELECT *, coalesce(lag(text) OVER w = text AND trim(text, ' ') <> '', false) AS again FROM s WINDOW w AS (PARTITION BY audio_key ORDER BY start_time, segment_id)), "
    "r AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY audio_key ORDER BY start_time, segment_id) AS run FROM n) "
    "SELECT audio_key, arg_min(segment_id, (start_time, segment_id)) AS first_segment_id, arg_max(segment_id, (start_time, segment_id)) AS last_segment_id, count(*) AS count, min(start_time) AS start_time, max(greatest(coalesce(end_time, start_time), start_time)) AS end_time FROM r GROUP BY audio_key, run HAVING count(*) > 1",
    "p5_found": "SELECT DISTINCT cell_id FROM textline_cells WHERE length(text) > 320",
}
