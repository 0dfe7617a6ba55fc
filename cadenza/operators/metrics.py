"""Agreement of two event tables: sets, multisets, capacities, paired deltas, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import precision_recall_f1, safe_ratio


def key_counts(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key of either side with its counts p and t. One shuffle: both sides are summed together."""
    both = predicted.select(*key, F.lit(1).alias("p"), F.lit(0).alias("t")).unionAll(truth.select(*key, F.lit(0).alias("p"), F.lit(1).alias("t")))
    return both.groupBy(*key).agg(F.sum("p").alias("p"), F.sum("t").alias("t"))


def set_agreement(predicted: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """tp, fp, fn and precision, recall, F1 over distinct keys, with the raw row counts."""
    sums = key_counts(predicted, truth, key).agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("pred_rows"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("truth_rows"),
        F.count(F.when((F.col("p") > 0) & (F.col("t") > 0), 1)).alias("tp"),
        F.count(F.when((F.col("p") > 0) & (F.col("t") == 0), 1)).alias("fp"),
        F.count(F.when((F.col("p") == 0) & (F.col("t") > 0), 1)).alias("fn"),
    )
    scores = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("*", *(c.alias(n) for c, n in zip(scores, ("precision", "recall", "f1"), strict=True)))


def multiset_agreement(predicted: DataFrame, truth: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """matched, predicted and expected counts with repeats kept, and F1 = 2 m / (p + e), null if both are empty."""
    sums = key_counts(predicted, truth, [*(by or []), *key]).groupBy(*(by or [])).agg(
        F.coalesce(F.sum(F.least("p", "t")), F.lit(0)).alias("matched"), F.coalesce(F.sum("p"), F.lit(0)).alias("predicted"), F.coalesce(F.sum("t"), F.lit(0)).alias("expected")
    )
    return sums.withColumn("f1", safe_ratio(2 * F.col("matched"), F.col("predicted") + F.col("expected"), None))


def count_capacity(predicted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """What counts alone allow: sums of the lesser, the surplus and the deficit."""
    return key_counts(predicted, truth, by).agg(
        F.sum(F.least("p", "t")).alias("capacity"), F.sum(F.greatest(F.col("p") - F.col("t"), F.lit(0))).alias("surplus"), F.sum(F.greatest(F.col("t") - F.col("p"), F.lit(0))).alias("deficit")
    )


def paired_delta(df: DataFrame, unit: str, arm: str, value: Column, first: str, second: str) -> DataFrame:
    """Units with both arms: their means and the difference."""
    wide = df.groupBy(unit).agg(F.avg(F.when(F.col(arm) == first, value)).alias("a"), F.avg(F.when(F.col(arm) == second, value)).alias("b"))
    return wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn("delta", F.col("b") - F.col("a"))


def threshold_sweep(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """For every distinct score as a threshold (kept: at least that score): tp, fp, fn, precision, recall and f1.

    Scores are counted first, so the running sums go over distinct scores, not rows.
    """
    by = by or []
    counts = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    down = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    all_of = W.partitionBy(*by)
    out = counts.select(*by, score, F.sum("pos").over(down).alias("tp"), (F.sum("n").over(down) - F.sum("pos").over(down)).alias("fp"), (F.sum("pos").over(all_of) - F.sum("pos").over(down)).alias("fn"))
    scores = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("*", *(c.alias(n) for c, n in zip(scores, ("precision", "recall", "f1"), strict=True)))


def best_threshold(sweep: DataFrame, score: str) -> DataFrame:
    """The threshold with the best f1; then precision, recall, fewer kept, higher threshold."""
    rank = F.struct("f1", "precision", "recall", (-(F.col("tp") + F.col("fp"))).alias("kept"), F.col(score))
    return sweep.agg(F.max_by(F.struct(*sweep.columns), rank).alias("best")).select("best.*")


def leave_one_out_mean(df: DataFrame, group: str, value: Column) -> DataFrame:
    """For each group the mean of all other groups' values, by subtraction from the total."""
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return sums.crossJoin(F.broadcast(total)).select(group, "n", (F.col("tn") - F.col("n")).alias("n_others"), safe_ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"), None).alias("mean_others"))
