"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations with partial sums and joins back; the nodes with very many links are
joined by a broadcast of bounded size. The tables are written to the shared folder, so lost executors
cost one step at most. The number of rounds
grows with the logarithm of a component's size. Nothing but one check row a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_counted
from .storage import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller and own) neighbours to the least of its neighbours and itself; a written table."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select("b", "a"))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
    found = join_counted(both.where("v > u") if large else both, least, "u", "n")
    if large:
        out = found.select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = found.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    out = materialize(out.where("a != b").distinct(), "links")
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) the table (node, root): every linked node and the least node it reaches."""
    now = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        half = _star(now, True)
        new = _star(half, False)
        # done when every node has one link and no node is both a root and linked on
        row = new.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()
        flat = (row[0] or 1) == 1 and new.select(F.col("b").alias("a")).join(new, "a", "left_semi").isEmpty()
        discard(now, half)
        now = new
        if flat:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
