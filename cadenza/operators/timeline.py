"""Ordered-axis operators: islands, gaps, prefix sums, as-of and range lookups, interval stabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exclusive_prefix(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before each row of its group."""
    frame = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)))


def clusters(df: DataFrame, by: list[str], at: Column, order: list[str], gap: float, out: str, *, touching: bool = False) -> DataFrame:
    """Number from 0 of each row's single-link cluster: a new one starts where the step from the row before is at least
    `gap` (over `gap`, if touching rows belong together)."""
    w = W.partitionBy(*by).orderBy(*order)
    step = at - F.lag(at).over(w)
    new = F.when(step > gap if touching else step >= gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of intervals that overlap or touch, by group."""
    w = W.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(before >= F.col(start), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What lies between merged intervals of a group: (gap_start, gap_end)."""
    w = W.partitionBy(*by).orderBy(start)
    return merged_intervals(df, by, start, end).select(*by, F.lag(end).over(w).alias("gap_start"), F.col(start).alias("gap_end")).where("gap_start IS NOT NULL AND gap_start < gap_end")


def overlaps(df: DataFrame, by: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Rows that start before an earlier row of the group has ended."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__before", F.max(end).over(w)).where(F.col(start) < F.col("__before")).drop("__before")


def spans_above(df: DataFrame, by: list[str], at: str, active: Column, least: int, bridge: int) -> DataFrame:
    """Spans of consecutive whole positions where `active` holds, at least `least` long; then those at most `bridge` apart are merged."""
    on = df.where(active).withColumn("__run", F.col(at) - F.row_number().over(W.partitionBy(*by).orderBy(at)))
    runs = on.groupBy(*by, "__run").agg(F.min(at).alias("start"), F.max(at).alias("end")).where(F.col("end") - F.col("start") + 1 >= least)
    w = W.partitionBy(*by).orderBy("start")
    joined = runs.withColumn("__new", F.when(F.col("start") - F.lag("end").over(w) - 1 <= bridge, 0).otherwise(1)).withColumn("__span", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return joined.groupBy(*by, "__span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__span")


def as_of(probes: DataFrame, states: DataFrame, by: list[str], at: str, value: str, default: Column | None = None) -> DataFrame:
    """Each probe with the latest state at or before it, by one sort of both tables together (no range join)."""
    both = probes.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(states.schema[value].dataType)).unionByName(
        states.select(*by, at, F.col(value).alias("__value"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = W.partitionBy(*by).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    found = F.last("__value", ignorenulls=True).over(w)
    return both.withColumn(value, found if default is None else F.coalesce(found, default)).where("__side = 1").drop("__side", "__value")


def bin_of(x: Column, edges: list[float]) -> Column:
    """Number from 1 of the first edge strictly greater than x; what is beyond the last edge is in the last bin."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, 0, -1):
        out = F.when(x < edges[k - 1], k).otherwise(out)
    return out


def stab(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, *, cell: float, by: list[str] | None = None) -> DataFrame:
    """Pairs with start <= point < end. An interval stands in each cell of width `cell` that it covers, a point in its own, so they meet by equality and each pair once."""
    tall = intervals.where(F.col(start) < F.col(end)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    return tall.join(points.withColumn("__cell", F.floor(F.col(at) / cell)), [*(by or []), "__cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__cell")


def state_spans(df: DataFrame, by: list[str], order: list[str], at: str, value: str, edge: int) -> DataFrame:
    """(by, value, at, e): each run of a value as a span from its first row to the next run's, cut where a multiple of `edge` is passed and where one ends it."""
    rows = runs(df, by, order, value).withColumn("__d", F.floor(F.col(at) / edge))
    spans = rows.groupBy(*by, "run", "__d").agg(F.min(value).alias(value), F.min(at).alias(at))
    stop = (F.col("__d") + 1) * edge
    return spans.select(*by, value, at, F.least(F.coalesce(F.lead(at).over(W.partitionBy(*by).orderBy(at, "run")), stop), stop).alias("e"))


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Number of each row's run of equal consecutive values, as column run."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, half: int, out: str) -> DataFrame:
    """Centred mean over `half` rows on either side; fewer at the edges."""
    return df.withColumn(out, F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)))


def simultaneities(notes: DataFrame, by: list[str], at: str, pitch: str, duration: str) -> DataFrame:
    """Groups of equal onset with their pitches in order, and whether their durations agree."""
    return notes.groupBy(*by, at).agg(F.sort_array(F.collect_list(pitch)).alias("pitches"), F.max(duration).alias(duration), (F.min(duration) == F.max(duration)).alias("agree"))


def fold_ties(notes: DataFrame, by: list[str], at: str, duration: str, starts: str, stops: str) -> DataFrame:
    """Notes of a pitch (in `by`) with tied ones made one: a note that ends a tie goes on the last one that begins one, if no other ended it since; else it begins a note. Notes
    without ties in between stay by themselves."""
    w = W.partitionBy(*by).orderBy(at)
    tied = F.col(starts) | F.col(stops)
    before = F.last(F.when(tied, F.col(starts)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col(stops) & F.coalesce(before, F.lit(False)), 0).otherwise(1)
    marked = notes.withColumn("__new", F.when(tied, new).otherwise(0)).withColumn("__chain", F.when(tied, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("__own", F.when(~tied, F.row_number().over(w)))
    return marked.groupBy(*by, "__chain", "__own").agg(F.min(at).alias(at), F.sum(duration).alias(duration)).drop("__chain", "__own")


def dense_measures(events: DataFrame, by: list[str], measure: str) -> DataFrame:
    """Every whole measure between a group's first and last one."""
    return events.groupBy(*by).agg(F.min(measure).alias("lo"), F.max(measure).alias("hi")).select(*by, F.explode(F.sequence("lo", "hi")).alias(measure))


def expand_route(sections: DataFrame, route: str, section: str, length: str) -> DataFrame:
    """Each visit of a section by the route (a text of single letters) with its running offset; (place, section, length, start)."""
    letters = F.filter(F.split(F.lit(route), ""), lambda x: x != "")
    visits = sections.sparkSession.range(1).select(F.posexplode(letters).alias("place", section))
    w = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # a route has at most 128 visits
    return visits.join(sections.select(section, length), section).withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))
