"""Sources mixed to target weights by nested hash thresholds.

Tokens are summed by source and bucket of a hash of doc_id. Running sums over a source's buckets tell the bucket in
which its budget ends; only that bucket is refined, by the next bits of the hash, LEVELS times. What lies below the
final threshold is taken once more than the source's full rounds: a filter, no sort.

The size of the mix is the largest that no source's repeats exceed, or a smaller one asked for. A source's budget is its
share of it; full rounds take every document, the rest takes those below the threshold.

Defined results: documents of sources without target (null too) are not used. Targets that are null or not positive,
and sources without tokens, get nothing; the others' shares are scaled to sum to 1. A null max_repeats is 1. Repeated
rows are items of their own that are taken together. Null texts have no tokens. Shares miss their budget by less than
the tokens of one bucket of the last level, in practice one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.tokens import VOCABULARY, token_sizes
from pagewright.session import broadcast_if_small, cut_lineage

#: Bits of the hash per level, and levels: 2**40 thresholds.
BITS, LEVELS = 10, 4
MAX_SOURCES_BROADCAST = 10_000


def _hashed(documents: DataFrame, vocabulary: str) -> DataFrame:
    sized = token_sizes(documents, keep=("doc_id", "source"), vocabulary=vocabulary)
    return cut_lineage(sized.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << (BITS * LEVELS)) - 1))))


def _budgets(sized: DataFrame, targets: DataFrame, mix_tokens: int | None) -> DataFrame:
    """source, target_share, tokens, rounds, budget: full rounds, and the tokens to take besides."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    t = t.join(have, "source", "left").na.fill(0, ["tokens"]).withColumn("max_repeats", F.greatest("max_repeats", F.lit(0)))
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    t = t.withColumn("weight", F.when(usable, F.col("target_share")))
    every = Window.partitionBy(F.lit(0))  # one row per source
    t = t.withColumn("weight", F.col("weight") / F.sum("weight").over(every))
    most = F.min(F.col("tokens") * F.col("max_repeats") / F.col("weight")).over(every)
    size = most if mix_tokens is None else F.least(most, F.lit(float(mix_tokens)))
    t = t.withColumn("wanted", F.coalesce(F.floor(F.col("weight") * size + 1e-6), F.lit(0)))
    rounds = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("wanted") / F.col("tokens")), F.col("max_repeats"))).otherwise(0).cast("bigint")
    t = t.withColumn("rounds", rounds)
    left = F.when(F.col("rounds") < F.col("max_repeats"), F.col("wanted") - F.col("rounds") * F.col("tokens")).otherwise(0)
    return t.select("source", "target_share", "tokens", "rounds", left.cast("bigint").alias("budget"))


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: take documents whose hash lies below it once more."""
    state = budgets.where("budget > 0").select("source", F.col("budget").alias("left"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(1, LEVELS + 1):
        state = cut_lineage(state)
        shift = BITS * (LEVELS - level)
        inside = sized.join(broadcast_if_small(state, MAX_SOURCES_BROADCAST), "source").where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "prefix", "left", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2**BITS rows a source
        sums = sums.withColumn("upto", upto)
        # the first bucket whose running sum exceeds the budget; beyond the last bucket where none does
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))))
        state = sums.groupBy("source", "left").agg(over.alias("o"), (F.max("bucket") + 1).alias("end"), F.max("upto").alias("all"))
        state = state.select("source", (F.col("left") - F.coalesce("o.before", "all")).alias("left"), F.coalesce("o.bucket", "end").alias("prefix"))
    return state.select("source", F.col("prefix").alias("threshold"))


def mix(documents: DataFrame, targets: DataFrame, mix_tokens: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, uses) and the report (source, target_share, tokens, used_tokens,
    actual_share, documents, most_uses)."""
    sized = _hashed(documents, vocabulary)
    budgets = cut_lineage(_budgets(sized, targets, mix_tokens))
    plan = cut_lineage(budgets.join(_thresholds(sized, budgets), "source", "left").na.fill(0, ["threshold"]))
    used = sized.join(broadcast_if_small(plan, MAX_SOURCES_BROADCAST), "source")
    chosen = used.select("doc_id", "source", "n_tokens", (F.col("rounds") + (F.col("h") < F.col("threshold")).cast("bigint")).alias("uses")).where("uses > 0")
    sums = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    report = plan.select("source", "target_share", "tokens").join(sums, "source", "left").na.fill(0, ["used_tokens", "documents", "most_uses"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    report = report.withColumn("actual_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0))
    return chosen, report.select("source", "target_share", "tokens", "used_tokens", "actual_share", "documents", "most_uses")
