"""Small models from SQL aggregates: standardising, diagonal discriminants, naive Bayes ratios, logistic regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot, sigmoid


def standardized(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """Columns less their means, over population deviations of at least `floor`."""
    stats = df.agg(*(F.struct(F.avg(c).alias("m"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias("s")).alias(f"__{c}") for c in columns))
    return df.crossJoin(F.broadcast(stats)).select(*(((F.col(c) - F.col(f"__{c}.m")) / F.col(f"__{c}.s")).alias(c) if c in columns else F.col(c) for c in df.columns))


def class_moments(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Count, means and sums of squared deviations of both classes, one row."""
    of = lambda c, k: F.when(F.col(label) == k, F.col(c))
    return df.agg(*(F.count(F.when(F.col(label) == k, 1)).alias(f"n{k}") for k in (0, 1)), *(F.avg(of(c, k)).alias(f"{c}_m{k}") for c in columns for k in (0, 1)), *((F.var_pop(of(c, k)) * F.count(of(c, k))).alias(f"{c}_ss{k}") for c in columns for k in (0, 1)))


def diagonal_discriminant(df: DataFrame, label: str, columns: list[str], add: float = 0.5) -> DataFrame:
    """score = sum of w (x - midpoint), w = (m1 - m0) / (pooled variance + add)."""
    m = class_moments(df, label, columns)
    score = F.lit(0.0)
    for c in columns:
        weight = (F.col(f"{c}_m1") - F.col(f"{c}_m0")) / ((F.col(f"{c}_ss0") + F.col(f"{c}_ss1")) / (F.col("n0") + F.col("n1") - 2) + add)
        score = score + weight * (F.col(c) - (F.col(f"{c}_m0") + F.col(f"{c}_m1")) / 2)
    return df.crossJoin(F.broadcast(m)).select(*df.columns, score.alias("score"))


def naive_bayes_ratio(df: DataFrame, label: str, columns: list[str], add: float = 0.35) -> DataFrame:
    """Log ratio of Gaussian likelihoods without class priors; sample variances plus `add`."""
    m = class_moments(df, label, columns)
    score = F.lit(0.0)
    for c in columns:
        v1, v0 = (F.col(f"{c}_ss{k}") / (F.col(f"n{k}") - 1) + add for k in (1, 0))
        far = lambda k, v, c=c: (F.col(c) - F.col(f"{c}_m{k}")) * (F.col(c) - F.col(f"{c}_m{k}")) / v
        score = score + 0.5 * (F.log(v0 / v1) + far(0, v0) - far(1, v1))
    return df.crossJoin(F.broadcast(m)).select(*df.columns, score.alias("score"))


def logistic(x: np.ndarray, y: np.ndarray, *, l2: float = 1.0, rate: float = 0.08, slower: float = 500.0, steps: int = 1200) -> np.ndarray:
    """Weights and intercept of a class-balanced logistic model, by a fixed number of gradient steps, each shorter than the one before. The penalty is l2 over the number of rows."""
    x1 = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    w = np.zeros(x1.shape[1])
    ridge = np.r_[np.full(x.shape[1], l2 / max(len(x), 1)), 0]
    for step in range(steps):
        w -= rate / (1 + step / slower) * (x1.T @ (weight * (1 / (1 + np.exp(-np.clip(x1 @ w, -60, 60))) - y)) + ridge * w)
    return w


def ranker(differences: np.ndarray, *, l2: float = 1.0, rate: float = 0.06, slower: float = 400.0, steps: int = 1000) -> np.ndarray:
    """Weights under which differences of a better and a worse row are positive: a logistic model without intercept, by gradient steps."""
    d, w = np.asarray(differences, float), np.zeros(np.shape(differences)[1])
    for step in range(steps):
        w -= rate / (1 + step / slower) * ((l2 * w - d.T @ (1 / (1 + np.exp(np.clip(d @ w, -60, 60))))) / max(len(d), 1))
    return w


def fit_logistic(df: DataFrame, by: list[str], label: str, features: list[str], **options) -> DataFrame:
    """(by, weights, intercept) of a logistic model for each group of training rows (a fold, say). A group is fitted in one task, so it has to be a sample that fits there."""
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    rows = df.select(*by, F.array(*(F.col(c).cast("double") for c in features)).alias("__x"), F.col(label).cast("double").alias("__y"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table.column("__x").to_pylist(), float).reshape(len(table), len(features))
        w = logistic(x, table.column("__y").to_numpy(), **options)
        return pa.table({**{c: pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(by, key, strict=False)}, "weights": pa.array([w[:-1].tolist()]), "intercept": pa.array([w[-1]])})

    return rows.groupBy(*by).applyInArrow(run, kinds + "weights array<double>, intercept double")


def score_logistic(rows: DataFrame, model: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Rows with their probability under their group's model (few groups)."""
    named = model.select(*by, F.col("weights").alias("__w"), F.col("intercept").alias("__b"))
    joined = rows.join(F.broadcast(named), by) if by else rows.crossJoin(F.broadcast(named))
    return joined.withColumn("score", sigmoid(dot(F.array(*(F.col(c).cast("double") for c in features)), F.col("__w")) + F.col("__b"))).drop("__w", "__b")


def label_pairs(df: DataFrame, unit: list[str], key: str, label: str, features: list[str]) -> DataFrame:
    """(unit, positive, negative, differences of the features): each positive with each negative of its unit. A unit is a measure with some dozen candidates."""
    side = lambda v, name: df.where(F.col(label) == v).select(*unit, F.col(key).alias(name), *(F.col(c).cast("double").alias(f"__{name}_{c}") for c in features))
    pairs = side(1, "positive").join(side(0, "negative"), unit)
    return pairs.select(*unit, "positive", "negative", *((F.col(f"__positive_{c}") - F.col(f"__negative_{c}")).alias(c) for c in features))


def fit_ranker(df: DataFrame, by: list[str], unit: list[str], key: str, label: str, features: list[str], **options) -> DataFrame:
    """(by, weights) that rank positives over negatives of the same unit, for each group of training rows; its pairs are fitted in one task."""
    pairs = label_pairs(df, [*by, *(u for u in unit if u not in by)], key, label, features)
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def run(group: tuple, table: pa.Table) -> pa.Table:
        w = ranker(np.array(table.column("__d").to_pylist(), float).reshape(len(table), len(features)), **options)
        return pa.table({**{c: pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(by, group, strict=False)}, "weights": pa.array([w.tolist()])})

    return pairs.select(*by, F.array(*features).alias("__d")).groupBy(*by).applyInArrow(run, kinds + "weights array<double>")
