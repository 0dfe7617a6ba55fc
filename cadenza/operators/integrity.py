"""Constraint queries: manifests of files, frozen snapshots, chains of revisions, catalogs that cover their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file under a path, names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split("://", 1)[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differences(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(name, problem) where a manifest differs from a frozen one: missing, added, changed or listed twice."""
    sides = [m.groupBy("name").agg(F.count("*").alias(f"n_{k}"), F.min("sha256").alias(f"sha_{k}")) for k, m in enumerate((frozen, now))]
    problem = F.when(F.col("n_1").isNull(), "missing").when(F.col("n_0").isNull(), "added").when((F.col("n_0") > 1) | (F.col("n_1") > 1), "listed twice").when(~F.col("sha_0").eqNullSafe(F.col("sha_1")), "changed")
    return sides[0].join(sides[1], "name", "full").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def broken_chain(revisions: DataFrame, by: str, order: str, own: str, previous: str) -> DataFrame:
    """Revisions whose `previous` isn't the `own` hash of the revision before; the first has none before it."""
    before = F.lag(own).over(W.partitionBy(by).orderBy(order))
    return revisions.withColumn("expected", before).where(~F.col("expected").eqNullSafe(F.col(previous)))


def catalog_problems(entries: DataFrame, by: str, page: str) -> DataFrame:
    """(group, n, repeats, missing) of groups whose pages, one row each, repeat or leave gaps between the first and the last."""
    found = entries.groupBy(by).agg(F.count(page).alias("n"), F.countDistinct(page).alias("d"), (F.max(page) - F.min(page) + 1).alias("span"))
    return found.select(by, "n", (F.col("n") - F.col("d")).alias("repeats"), (F.col("span") - F.col("d")).cast("long").alias("missing")).where("repeats > 0 OR missing > 0")
