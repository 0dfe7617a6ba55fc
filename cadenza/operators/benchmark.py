"""A note benchmark: requests joined to their records, truth from notes, and evaluation of predictions by identity.

An identity is a list of key columns. Times are beats; they are compared after rounding to four places. Problems are
rows, so a run can stop on them or report them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .metrics import set_agreement

GATE = 0.8


def repeated(df: DataFrame, key: list[str], problem: str = "duplicate") -> DataFrame:
    return df.groupBy(*key).count().where("count > 1").select(*key, F.lit(problem).alias("problem"))


def requests(targets: DataFrame, records: DataFrame, key: list[str], index: str) -> tuple[DataFrame, DataFrame]:
    """Targets with their records (one for each key), and problems: record missing, listed twice, or its `index` drifted from the target's."""
    unique = records.groupBy(*key).agg(F.count("*").alias("__n"), F.first(F.struct(*records.columns)).alias("__r"))
    joined = targets.join(unique, key, "left")
    drift = ~F.col(f"__r.{index}").eqNullSafe(F.col(index))
    problem = F.when(F.col("__n").isNull(), "missing record").when(F.col("__n") > 1, "duplicate record").when(drift, "mapping drift")
    own = [F.col(f"__r.{c}").alias(c) for c in records.columns if c not in (*key, *targets.columns)]
    marked = joined.withColumn("problem", problem)
    return marked.where("problem IS NULL").select(*targets.columns, *own), marked.where("problem IS NOT NULL").select(*key, "problem")


def rests_between(notes: Column, extent: Column) -> Column:
    """Silences (onset, duration) of a measure: what its notes, an array of structs in order of onset, leave open up to the extent."""
    end = lambda n: n["onset"] + n["duration"]
    rest = lambda a, b: F.struct(F.round(a, 4).alias("onset"), F.round(b - a, 4).alias("duration"))
    none = F.array().cast("array<struct<onset:double,duration:double>>")
    start = F.struct(F.lit(0.0).alias("at"), none.alias("out"))

    def step(state, n):
        gap = F.when(n["onset"] > state["at"], F.concat(state["out"], F.array(rest(state["at"], n["onset"])))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], end(n)).alias("at"), gap.alias("out"))

    return F.aggregate(notes, start, step, lambda s: F.when(s["at"] < extent, F.concat(s["out"], F.array(rest(s["at"], extent)))).otherwise(s["out"]))


def truth(asked: DataFrame, notes: DataFrame, by: list[str], *, length: str = "expected_beats", pickup: str = "allow_pickup") -> tuple[DataFrame, DataFrame]:
    """(identity rows with extent, notes, rests; problems). Notes are looked up by their measure once grouped; a pickup ends with its notes."""
    note = F.struct(F.col("onset_beats").alias("onset"), F.col("pitch_midi").alias("pitch"), F.col("duration_beats").alias("duration"))
    grouped = notes.groupBy(*by).agg(F.array_sort(F.collect_list(note)).alias("notes"))
    none = F.array().cast(grouped.schema["notes"].dataType)
    rows = asked.join(grouped, by, "left").withColumn("notes", F.coalesce("notes", none))
    last = F.array_max(F.transform("notes", lambda n: n["onset"] + n["duration"]))
    rows = rows.withColumn("extent", F.when(F.col(pickup), last).otherwise(F.col(length)))
    bad = lambda test: F.exists("notes", test)
    problem = F.when(F.col("extent").isNull(), "a pickup without notes").when(bad(lambda n: n["onset"] < 0), "negative onset").when(bad(lambda n: n["duration"] <= 0), "no duration").when(last > F.col("extent") + 1e-9, "past the measure")
    rows = rows.withColumn("problem", problem)
    return rows.where("problem IS NULL").withColumn("rests", rests_between(F.col("notes"), F.col("extent"))).drop("problem"), rows.where("problem IS NOT NULL").select(*by, "problem")


def prediction_problems(predictions: DataFrame, truths: DataFrame, key: list[str]) -> DataFrame:
    """(key, problem): identities listed twice or unknown; events before the measure, without duration, past its extent, pitches outside 0 to 127, rests that overlap rests or notes."""
    known = predictions.join(truths.select(*key, "extent"), key, "left")
    end = lambda e: e["onset"] + e["duration"]
    rests, notes, extent = F.coalesce("rests", F.array().cast(predictions.schema["rests"].dataType)), F.coalesce("notes", F.array().cast(predictions.schema["notes"].dataType)), F.col("extent")
    found = [F.when(extent.isNull(), F.lit("unknown identity"))]
    for name, events in (("note", notes), ("rest", rests)):
        found += [F.when(F.exists(events, lambda e: e["onset"] < 0), F.lit(f"negative {name} onset")), F.when(F.exists(events, lambda e: e["duration"] <= 0), F.lit(f"{name} without duration")), F.when(F.exists(events, lambda e: end(e) > extent + 1e-9), F.lit(f"{name} past the measure"))]
    found.append(F.when(F.exists(notes, lambda n: ~n["pitch"].between(0, 127)), F.lit("pitch outside 0 to 127")))
    meets = lambda a, b: (a["onset"] < end(b)) & (b["onset"] < end(a))
    ordered = F.array_sort(rests)
    found.append(F.when(F.exists(F.sequence(F.lit(1), F.size(ordered)), lambda k: (k < F.size(ordered)) & (F.get(ordered, k)["onset"] < end(F.get(ordered, k - 1)))), F.lit("rests overlap")))
    found.append(F.when(F.exists(rests, lambda r: F.exists(notes, lambda n: meets(r, n))), F.lit("rest overlaps a note")))
    rows = known.select(*key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))
    return rows.unionByName(repeated(predictions, key))


def _key(e: Column, *fields: str) -> Column:
    return F.struct(*(F.round(e[f], 4).alias(f) if f != "pitch" else e[f].cast("int").alias(f) for f in fields))


def evaluate(predictions: DataFrame, truths: DataFrame, key: list[str]) -> DataFrame:
    """One row for each truth: ordered matches of pitch, onset and duration, note F1 over distinct notes, rest agreement, and whether the measure is exact. A missing prediction is empty."""
    p = predictions.select(*key, F.col("notes").alias("pn"), F.col("rests").alias("pr"), F.lit(True).alias("__there"))
    t = truths.select(*key, F.col("notes").alias("tn"), F.col("rests").alias("tr"))
    rows = t.join(p, key, "left")
    order = lambda c: F.array_sort(F.transform(F.coalesce(c, F.array()), lambda n: _key(n, "onset", "pitch", "duration")))
    rests = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array()), lambda r: _key(r, "onset", "duration")))
    empty = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("pn", "tn", "pr", "tr")}
    rows = rows.select(*key, F.coalesce("__there", F.lit(False)).alias("there"), *(order(empty[c]).alias(c) for c in ("pn", "tn")), *(rests(empty[c]).alias(c) for c in ("pr", "tr")))
    same = lambda field: F.size(F.filter(F.zip_with("pn", "tn", lambda a, b: a[field] == b[field]), lambda x: x)).cast("long")
    distinct = [F.array_distinct(c) for c in ("pn", "tn")]
    size = lambda x: F.size(x).cast("long")
    rows = rows.select(
        *key, F.when(F.col("there"), "evaluated").otherwise("missing_prediction").alias("status"), size("pn").alias("pred_note_count"), size("tn").alias("truth_note_count"), F.greatest(size("pn"), size("tn")).alias("compared_notes"),
        same("pitch").alias("pitch_matches"), same("onset").alias("onset_matches"), same("duration").alias("duration_matches"),
        size(F.array_intersect(*distinct)).alias("note_tp"), size(F.array_except(*distinct)).alias("note_fp"), size(F.array_except(*distinct[::-1])).alias("note_fn"),
        size(F.array_intersect("pr", "tr")).alias("rest_tp"), size(F.array_except("pr", "tr")).alias("rest_fp"), size(F.array_except("tr", "pr")).alias("rest_fn"),
    )
    f1 = C.precision_recall_f1(F.col("note_tp"), F.col("note_fp"), F.col("note_fn"))[2]
    rows = rows.withColumn("note_f1", f1)
    exact = (F.col("pred_note_count") == F.col("truth_note_count")) & (F.col("note_f1") == 1.0) & (F.col("rest_fp") + F.col("rest_fn") == 0)
    return rows.withColumn("exact_measure", exact)


def weighted(matches: str, total: str) -> Column:
    """Sum over sum, not the mean of ratios."""
    return F.round(C.safe_ratio(F.sum(matches), F.sum(total)), 6)


def summary(results: DataFrame, predictions: DataFrame, truths: DataFrame, key: list[str], measure: str) -> DataFrame:
    """One row: counts, exact measures, note agreement over all distinct notes by `measure`, ordered accuracies, rest agreement."""

    def notes(df: DataFrame) -> DataFrame:
        n = df.select(F.col(measure).alias("measure"), F.explode("notes").alias("n"))
        return n.select("measure", F.round("n.onset", 4).alias("onset"), F.round("n.duration", 4).alias("duration"), F.col("n.pitch").cast("int").alias("pitch"))

    known = predictions.join(truths.select(*key), key, "left_semi")
    agreement = set_agreement(notes(known), notes(truths), ["measure", "onset", "duration", "pitch"]).select(F.col("precision").alias("note_precision"), F.col("recall").alias("note_recall"), F.col("f1").alias("note_f1"))
    rest = C.precision_recall_f1(F.sum("rest_tp"), F.sum("rest_fp"), F.sum("rest_fn"))
    totals = results.agg(
        F.count("*").alias("targets"), F.count(F.when(F.col("status") == "evaluated", 1)).alias("predicted"), F.count(F.when(F.col("exact_measure"), 1)).alias("exact_measures"),
        F.round(C.safe_ratio(F.count(F.when(F.col("exact_measure"), 1)), F.count("*")), 6).alias("exact_measure_rate"), *(weighted(f"{x}_matches", "compared_notes").alias(f"ordered_{x}_accuracy") for x in ("pitch", "onset", "duration")),
        *(c.alias(f"rest_{n}") for c, n in zip(rest, ("precision", "recall", "f1"), strict=True)),
    )
    return totals.crossJoin(F.broadcast(agreement))


def work_coverage(works: DataFrame, truths: DataFrame, predictions: DataFrame, metrics: DataFrame, by: str, *, rates: list[str], means: list[str], gate: float = GATE) -> DataFrame:
    """One row: works, those with truth, those also predicted, match rates and means over evaluated works, and whether coverage reaches the gate."""
    has = lambda df, n: df.select(by).distinct().withColumn(n, F.lit(1))
    rows = works.select(by).join(has(truths, "__t"), by, "left").join(has(predictions, "__p"), by, "left").join(metrics, by, "left")
    both = F.col("__t").isNotNull() & F.col("__p").isNotNull()
    one = lambda c: F.count(F.when(c, 1))
    evaluated = F.count(F.when(both & F.col(means[0]).isNotNull(), 1))
    out = rows.agg(
        F.count("*").alias("works_total"), F.count("__t").alias("works_with_truth"), one(both).alias("works_with_predictions"), evaluated.alias("works_evaluated"),
        *(C.safe_ratio(one(both & F.col(r)), evaluated).alias(f"{r}_rate") for r in rates), *(F.round(C.safe_ratio(F.sum(F.when(both, F.col(m))), evaluated), 6).alias(f"{m}_avg") for m in means),
    )
    coverage = F.round(C.safe_ratio(F.col("works_with_predictions"), F.col("works_with_truth")), 6)
    return out.select("*", coverage.alias("evaluation_coverage"), F.round(C.safe_ratio(F.col("works_with_truth"), F.col("works_total")), 6).alias("truth_coverage"), (coverage >= gate).alias("coverage_gate_passed"))


def overlap_pairs(df: DataFrame, by: list[str], key: str, start: str, end: str, cell: float) -> DataFrame:
    """(by, first, second): each pair of half-open intervals of a group that overlap, the one that starts first (then the lesser key) first.

    An interval is listed in every cell of width `cell` that it covers, the later starter only in its own, so a pair meets once and no group is paired with itself."""
    tall = df.where(F.col(start) < F.col(end)).select(*by, F.col(key).alias("first"), F.col(start).alias("__a"), F.col(end).alias("__b"), F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))).alias("__cell"))
    later = df.where(F.col(start) < F.col(end)).select(*by, F.col(key).alias("second"), F.col(start).alias("__c"), F.floor(F.col(start) / cell).alias("__cell"))
    met = tall.join(later, [*by, "__cell"]).where((F.col("__c") < F.col("__b")) & ((F.col("__a") < F.col("__c")) | ((F.col("__a") == F.col("__c")) & (F.col("first") < F.col("second")))))
    return met.select(*by, "first", "second")
