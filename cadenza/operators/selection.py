"""Choosing thresholds, caps, rules and configurations: sweeps with tie-breaks, gates, filters fitted to labels, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

SCORES = ("precision", "recall", "f1")


def scored(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    return [c.alias(n) for c, n in zip(C.precision_recall_f1(tp, fp, fn, digits), SCORES, strict=True)]


def per_cap(reports: DataFrame, cap: str = "cap") -> DataFrame:
    """Sums over measures (cap, tp, fp, fn, exact) for each proposal budget, and their agreement."""
    sums = reports.groupBy(cap).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("measures"), F.count(F.when(F.col("exact"), 1)).alias("exact_measures"))
    return sums.select("*", *scored(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("exact_measures") == F.col("measures")).alias("all_exact"))


def best_cap(caps: DataFrame, cap: str = "cap") -> DataFrame:
    """One row: the cap of best F1, the least of equals, and the least cap with the greatest recall."""
    top = caps.agg(F.max_by(F.struct(cap, "f1"), F.struct("f1", -F.col(cap))).alias("b"), F.max_by(F.struct(cap, "recall"), F.struct("recall", -F.col(cap))).alias("r"))
    return top.select(F.col(f"b.{cap}").alias("best_cap"), F.col("b.f1").alias("best_f1"), F.col(f"r.{cap}").alias("least_cap_of_most_recall"), F.col("r.recall").alias("most_recall"))


def capped(df: DataFrame, by: list[str], order: list[Column], cap: int | Column) -> DataFrame:
    """The first rows of each group in an order: a number, or a column that holds it (as many as the truth has, say)."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("__rank") <= cap).drop("__rank")


#: Keys that rank thresholds, best first; each ends in the threshold, so there are no ties.
KEYS = {
    "f1": ("f1", "precision", "recall", "-kept", "threshold"),
    "exact": ("f1", "exact", "recall", "precision", "-kept", "threshold"),
    "recall": ("f1", "recall", "precision", "-kept", "threshold"),
}


def label_sweep(df: DataFrame, score: str, label: str, by: list[str] | None = None, above: float = 1e-9, parts: int = 256) -> DataFrame:
    """Every distinct score, and one above the greatest, as a threshold (kept: at least that score): tp, fp, fn, kept and agreement.

    Rows are counted by score first. Without groups the distinct scores are dealt to ranges, so that running sums go over a range and the sums
    of the ranges above it, not over all scores in one task."""
    by = by or []
    counts = df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    top = counts.groupBy(*by).agg((F.max("threshold") + above).alias("threshold"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"))
    counts = running_total(counts.unionByName(top), by, "threshold", ["pos", "n"], parts)
    total = counts.groupBy(*by).agg(F.sum("pos").alias("__all"))
    rows = counts.join(F.broadcast(total), by) if by else counts.crossJoin(F.broadcast(total))
    out = rows.select(*by, "threshold", F.col("pos_total").alias("tp"), (F.col("n_total") - F.col("pos_total")).alias("fp"), (F.col("__all") - F.col("pos_total")).alias("fn"), F.col("n_total").alias("kept"))
    return out.select("*", *scored(F.col("tp"), F.col("fp"), F.col("fn")))


def running_total(df: DataFrame, by: list[str], at: str, values: list[str], parts: int = 256) -> DataFrame:
    """Sums of values over the rows of a group at this position or above it, as columns with _total. `at` has no ties within a group.

    Without groups the positions are cut into about `parts` ranges at their approximate quantiles: a window goes over one range, and adds
    what the ranges above it sum to, a table of that many rows. The cuts only decide what a task holds, not the sums."""
    down = W.partitionBy(*by).orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    if by:
        return df.select("*", *(F.sum(v).over(down).alias(f"{v}_total") for v in values))
    cuts = df.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000).alias("c")).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    if cuts:
        part = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda s, c: s + (F.col(at) >= c).cast("int"))
    dealt = df.withColumn("__part", part)
    over = dealt.groupBy("__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    above = over.select("__part", *(F.coalesce(F.sum(f"__{v}").over(W.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__{v}") for v in values))
    own = W.partitionBy("__part").orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(above), "__part")
    return rows.select(*df.columns, *((F.sum(v).over(own) + F.col(f"__{v}")).alias(f"{v}_total") for v in values))


def best(sweep: DataFrame, key: tuple[str, ...] = KEYS["f1"], by: list[str] | None = None) -> DataFrame:
    """Of each group the row that ranks first by a key; a column after a minus counts down."""
    order = F.struct(*((-F.col(k[1:])).alias(f"k{n}") if k[0] == "-" else F.col(k).alias(f"k{n}") for n, k in enumerate(key)))
    return sweep.groupBy(*(by or [])).agg(F.max_by(F.struct(*sweep.columns), order).alias("b")).select("b.*")


def threshold_grid(scores: DataFrame, score: str, budget: int = 64) -> DataFrame:
    """At most `budget` thresholds: one above the greatest score, and distinct scores at evenly spaced ranks (rounded half to even). A number is given to
    each distinct score by ranges, see running_total."""
    values = scores.select(F.col(score).cast("double").alias("threshold")).where("threshold IS NOT NULL").distinct().withColumn("one", F.lit(1).cast("long"))
    counted = running_total(values, [], "threshold", ["one"])
    n = values.count()
    if not n:
        raise ValueError("a grid of thresholds needs a score")
    some = min(n, budget - 1)
    places = sorted({round(k * (n - 1) / max(1, some - 1)) for k in range(some)}) if n > some else None
    kept = counted if places is None else counted.where((n - F.col("one_total")).isin(places))
    top = values.agg((F.max("threshold") + 1e-9).alias("threshold"))
    return kept.select("threshold").unionByName(top)


def swept(thresholds: DataFrame, rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Every row once for each threshold it reaches (few thresholds, see threshold_grid), so that a selector can run on each (threshold, group)."""
    return rows.join(F.broadcast(thresholds), F.col(score) >= F.col("threshold")).select("threshold", *by, *(c for c in rows.columns if c not in by))


def first_rule(evaluations: DataFrame, order: str, precision: float, recall: float) -> DataFrame:
    """The first rule, in a fixed order, that reaches both gates; no row if none does."""
    good = evaluations.where((F.col("precision") >= precision) & (F.col("recall") >= recall))
    return good.agg(F.min_by(F.struct(*evaluations.columns), order).alias("b")).where("b IS NOT NULL").select("b.*")


def rules_against(rules: DataFrame, assignments: DataFrame, truth: DataFrame, key: list[str], accepts: Column, rule: list[str]) -> DataFrame:
    """(rule, accepted, tp, fp, fn, agreement) of the keys that each of a few rules accepts, as sets against the truth's."""
    predicted = assignments.join(F.broadcast(rules), accepts).select(*rule, *key).distinct().withColumn("__p", F.lit(1))
    wanted = truth.select(*key).distinct()
    hit = predicted.join(wanted.withColumn("__t", F.lit(1)), key, "left").groupBy(*rule).agg(F.count("*").alias("accepted"), F.count("__t").alias("tp"))
    total = wanted.agg(F.count("*").alias("__all"))
    rows = rules.select(*rule).join(hit, rule, "left").na.fill(0, ["accepted", "tp"]).crossJoin(F.broadcast(total))
    rows = rows.select(*rule, "accepted", "tp", (F.col("accepted") - F.col("tp")).alias("fp"), (F.col("__all") - F.col("tp")).alias("fn"))
    return rows.select("*", *scored(F.col("tp"), F.col("fp"), F.col("fn")))


def best_of(configs: DataFrame, key: list[Column]) -> DataFrame:
    """The configuration that ranks first by a list of columns, greatest first."""
    return configs.agg(F.max_by(F.struct(*configs.columns), F.struct(*(k.alias(f"k{n}") for n, k in enumerate(key)))).alias("b")).select("b.*")


def non_regression(metrics: DataFrame, name: str, base: str, other: str, columns: list[str], epsilon: float = 1e-9) -> DataFrame:
    """One row (selected, and for each column whether the other configuration holds it): the other only if none is below the base's by more than epsilon."""
    pick = lambda who, c: F.max(F.when(F.col(name) == who, F.col(c)))
    row = metrics.agg(*((pick(other, c) >= pick(base, c) - epsilon).alias(f"{c}_holds") for c in columns))
    every = F.forall(F.array(*(f"{c}_holds" for c in columns)), lambda x: F.coalesce(x, F.lit(False)))
    return row.withColumn("selected", F.when(every, other).otherwise(base))


def adoption(base: DataFrame, candidate: DataFrame, by: str, value: str, invariant: bool = True, least: int = 2) -> DataFrame:
    """One row: the sum of changes, how many groups improved, got worse or stayed, and whether the candidate is adopted: it gains, in `least` groups or more, and loses in none."""
    both = base.select(by, F.col(value).alias("a")).join(candidate.select(by, F.col(value).alias("b")), by, "full").na.fill(0, ["a", "b"]).withColumn("d", F.col("b") - F.col("a"))
    count = lambda c: F.count(F.when(c, 1))
    out = both.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("delta"), count(F.col("d") > 0).alias("improved"), count(F.col("d") < 0).alias("regressed"), count(F.col("d") == 0).alias("unchanged"))
    return out.withColumn("adopted", F.lit(invariant) & (F.col("delta") > 0) & (F.col("improved") >= least) & (F.col("regressed") == 0))


def folds(df: DataFrame, group: str, groups: DataFrame | None = None) -> DataFrame:
    """Every row as training row of each other group's fold (column held_out) and as test row of its own; the groups are few."""
    names = (groups or df).select(F.col(group).alias("held_out")).distinct()
    return df.crossJoin(F.broadcast(names)).withColumn("is_test", F.col(group) == F.col("held_out"))


def out_of_fold(df: DataFrame, group: str, fit, score) -> DataFrame:
    """Every row with a score from a model that saw all groups but its own: fit(training rows) for each group gives whatever score(model, rows) takes."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]  # a few works
    parts = [score(fit(df.where(F.col(group) != n)), df.where(F.col(group) == n)) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums over folds (by a method, mode and k, say) with their agreement, and how many folds have the right count or the right set."""
    sums = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("folds"), F.count(F.when(F.col("tp") + F.col("fp") == F.col("tp") + F.col("fn"), 1)).alias("exact_count_folds"), F.count(F.when((F.col("fp") == 0) & (F.col("fn") == 0), 1)).alias("exact_set_folds"))
    return sums.select("*", *scored(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_micro(rows: DataFrame, pairs: dict[str, tuple[str, str]], by: list[str] | None = None) -> DataFrame:
    """For each named (part, whole) the mean of the rows' ratios and the ratio of their sums (name_macro, name_micro)."""
    ratio = lambda a, b: C.safe_ratio(F.col(a), F.col(b))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(x for name, (a, b) in pairs.items() for x in (F.round(F.avg(ratio(a, b)), 6).alias(f"{name}_macro"), F.round(C.safe_ratio(F.sum(a), F.sum(b)), 6).alias(f"{name}_micro"))))


def centroid_filter(training: DataFrame, label: str, features: list[str]) -> DataFrame:
    """One row, the model of a filter: for each feature the midpoint of both classes' means, the scale (population deviation, 1 if it is 0) and the weight; and the
    greatest threshold that keeps every positive. Without negatives all weights are 0 and all is kept; without positives there is no row."""
    of = lambda c, k: F.avg(F.when(F.col(label) == k, F.col(c)))
    stats = training.agg(F.count(F.when(F.col(label) == 1, 1)).alias("positives"), F.count(F.when(F.col(label) == 0, 1)).alias("negatives"), *(x for c in features for x in (of(c, 1).alias(f"{c}_p"), of(c, 0).alias(f"{c}_n"), F.when(F.stddev_pop(c) > 1e-9, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_s"))))
    both = F.col("negatives") > 0
    shape = lambda c: F.struct(F.when(both, (F.col(f"{c}_p") + F.col(f"{c}_n")) / 2).otherwise(0.0).alias("midpoint"), F.when(both, F.col(f"{c}_s")).otherwise(1.0).alias("scale"), F.when(both, (F.col(f"{c}_p") - F.col(f"{c}_n")) / F.col(f"{c}_s")).otherwise(0.0).alias("weight")).alias(c)
    model = stats.where("positives > 0").select("positives", "negatives", *map(shape, features))
    least = training.where(F.col(label) == 1).crossJoin(F.broadcast(model.select(*(F.col(c).alias(f"__{c}") for c in features)))).agg(F.min(_centroid_score(features)).alias("threshold"))
    return model.crossJoin(F.broadcast(least))


def _centroid_score(features: list[str]) -> Column:
    score = F.lit(0.0)
    for c in features:
        score = score + F.col(f"__{c}.weight") * (F.col(c) - F.col(f"__{c}.midpoint")) / F.col(f"__{c}.scale")
    return score


def filtered(rows: DataFrame, model: DataFrame, features: list[str], epsilon: float = 1e-9) -> DataFrame:
    """Rows that a centroid filter keeps, with their score."""
    named = model.select(*(F.col(c).alias(f"__{c}") for c in features), F.col("threshold").alias("__t"))
    return rows.crossJoin(F.broadcast(named)).withColumn("score", _centroid_score(features)).where(F.col("score") + epsilon >= F.col("__t")).select(*rows.columns, "score")


def unanimous(df: DataFrame, by: list[str], value: str, default: str) -> DataFrame:
    """(by, value) of groups whose values are all equal and differ from the default."""
    return df.groupBy(*by).agg(F.min(value).alias(value), F.max(value).alias("__max"), F.count(value).alias("__n"), F.count("*").alias("__all"), F.first(default).alias("__d")).where((F.col(value) == F.col("__max")) & (F.col("__n") == F.col("__all")) & (F.col(value) != F.col("__d"))).select(*by, value)


def nearest_class(distances: DataFrame, by: list[str], label: str, distance: str, k: int = 3) -> DataFrame:
    """(by, label, mean): the class whose `k` nearest samples are nearest on average; of equals the least change (label) in size, then the lesser one."""
    near = distances.withColumn("__k", F.row_number().over(W.partitionBy(*by, label).orderBy(distance))).where(F.col("__k") <= k)
    means = near.groupBy(*by, label).agg(F.avg(distance).alias("mean"))
    return means.groupBy(*by).agg(F.min_by(F.struct(label, "mean"), F.struct("mean", F.abs(label), label)).alias("b")).select(*by, "b.*")


def nearest_mean_gap(distances: DataFrame, by: list[str], label: str, distance: str, k: int = 3) -> DataFrame:
    """(by, score): mean of the k least distances to negatives less that to positives."""
    near = distances.withColumn("__k", F.row_number().over(W.partitionBy(*by, label).orderBy(distance))).where(F.col("__k") <= k)
    of = lambda v: F.avg(F.when(F.col(label) == v, F.col(distance)))
    return near.groupBy(*by).agg((of(0) - of(1)).alias("score"))


def leading_candidate(df: DataFrame, by: list[str], *, threshold: float, margin: float, lead: float, x_radius: float, most: int) -> DataFrame:
    """(by, id): of candidates (by, id, x, score, rank, kept; x in staff spaces) left of a group's first kept one, if that stands `lead` or more from the edge and fewer
    than `most` are kept, the best that is at most `margin` below the threshold and further than `x_radius` from every kept one."""
    kept = df.where("kept").groupBy(*by).agg(F.min("x").alias("__first"), F.count("*").alias("__n")).where((F.col("__first") >= lead) & (F.col("__n") < most) & F.lit(margin > 0))
    # what is more than x_radius left of the first kept one is as far from all others
    able = df.where(~F.col("kept")).join(kept, by).where((F.col("x") < F.col("__first") - x_radius) & (F.col("score") >= threshold - margin))
    return able.groupBy(*by).agg(F.max_by("id", F.struct("score", -F.col("rank"), "id")).alias("id"))


def needs_leading_rest(expected: Column, extent: Column, gap: Column, pickup: Column, has_notes: Column, *, rest: float = 0.5, least: float = 3.0) -> Column:
    """Whether half a beat of silence before the first note explains what a measure lacks."""
    return ~pickup & has_notes & (F.abs(expected - extent - rest) < 1e-9) & (gap >= least)
