"""Comparison of a candidate score with a reviewed edition: bar alignment, agreement of events, form, and audited regions.

Bars are rows (score, place, number, meter, meter_valid, partial_reason, notes, rests, chords): `place` orders the
written bars from 0, `number` names them; notes are structs (onset, duration, pitch, tie_start, tie_end), rests
(onset, duration, visible), chords (onset, symbol), all times in ticks. Scores are rows (score, valid,
ticks_per_quarter, route, route_status). Events are bags: duplicate heads count, voices don't.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

KINDS = ("notes", "rests", "chords")
MOST_BARS = 512


def note_keys(notes: Column) -> Column:
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("long")
    return F.transform(notes, lambda n: F.array(n["onset"].cast("long"), n["duration"].cast("long"), n["pitch"].cast("long"), flag(n["tie_start"]), flag(n["tie_end"])))


def event_keys(kind: str) -> Column:
    """A bar's events of a kind as an array of texts, to be compared as a bag; hidden rests don't count."""
    column = F.coalesce(F.col(kind), F.array())
    if kind == "notes":
        return F.transform(note_keys(column), lambda k: F.array_join(k, ":"))
    if kind == "rests":
        return F.transform(F.filter(column, lambda r: F.coalesce(r["visible"], F.lit(True))), lambda r: F.concat_ws(":", r["onset"], r["duration"]))
    return F.transform(column, lambda c: F.concat_ws(":", c["onset"], C.plain_accidentals(c["symbol"])))


def keyed(bars: DataFrame, by: str) -> DataFrame:
    return bars.select(by, "place", "number", "meter", "meter_valid", "partial_reason", *(event_keys(k).alias(k) for k in KINDS))


def similarities(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """F1 of every bar of one score with every bar of the other, 0 where both are empty."""
    names = {x: k for k, x in enumerate({x for bar in (*left, *right) for x in bar})}
    a, b = (np.zeros((len(bars), len(names)), np.int32) for bars in (left, right))
    for counts, bars in ((a, left), (b, right)):
        for row, bar in enumerate(bars):
            np.add.at(counts[row], [names[x] for x in bar], 1)
    common = np.zeros((len(left), len(right)))
    for x in np.flatnonzero(a.any(0) & b.any(0)):
        rows, columns = np.flatnonzero(a[:, x]), np.flatnonzero(b[:, x])
        common[np.ix_(rows, columns)] += np.minimum.outer(a[rows, x], b[columns, x])
    total = a.sum(1)[:, None] + b.sum(1)[None]
    return np.divide(2 * common, total, out=np.zeros_like(common), where=total > 0)


def align(similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least-cost global alignment, -1 for a gap: a pair costs 1 less its similarity, a gap 1. Of equal costs a pair goes first, then a bar that is missing."""
    n, m = similarity.shape
    cost = np.empty((n + 1, m + 1))
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    step = np.full((n + 1, m + 1), 1, np.int8)
    step[0] = 2
    for i in range(1, n + 1):
        pair, missing = cost[i - 1, :-1] + 1 - similarity[i - 1], cost[i - 1, 1:] + 1
        row, choice = cost[i], step[i]
        for j in range(1, m + 1):
            best, kind = pair[j - 1], 0
            if missing[j - 1] < best:
                best, kind = missing[j - 1], 1
            if row[j - 1] + 1 < best:
                best, kind = row[j - 1] + 1, 2
            row[j], choice[j] = best, kind
    left, right, i, j = [], [], n, m
    while i or j:
        kind = step[i, j]
        i, j = i - (kind != 2), j - (kind != 1)
        left.append(-1 if kind == 2 else i)
        right.append(-1 if kind == 1 else j)
    return np.array(left[::-1], np.int64), np.array(right[::-1], np.int64)


def align_bars(reference: DataFrame, candidate: DataFrame, by: str, most: int = MOST_BARS) -> DataFrame:
    """(by, column, reference, candidate): the alignment of each score's bars by their notes, as places; null in a gap.

    A score is one task's work; more than `most` bars are an error, as the work grows with the product of both lengths.
    """
    kind = reference.schema[by].dataType.simpleString()
    shape = lambda df: df.select(F.col(by).alias(by), F.col("place").alias("place"), event_keys("notes").alias("notes"))

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if max(len(a), len(b)) > most:
            raise ValueError(f"at most {most} bars a score can be aligned, {key[0].as_py()} has {max(len(a), len(b))}")
        a, b = (x.sort_by("place") for x in (a, b))
        left, right = align(similarities(a.column("notes").to_pylist(), b.column("notes").to_pylist()))
        pick = lambda x, at: pa.array([x.column("place")[k].as_py() if k >= 0 else None for k in at.tolist()], pa.int64())
        return pa.table({by: pa.array([key[0].as_py()] * len(left), (a if len(a) else b).schema.field(by).type), "column": pa.array(np.arange(len(left))), "reference": pick(a, left), "candidate": pick(b, right)})

    return shape(reference).groupBy(by).cogroup(shape(candidate).groupBy(by)).applyInArrow(run, f"`{by}` {kind}, column long, reference long, candidate long")


def compared_bars(alignment: DataFrame, reference: DataFrame, candidate: DataFrame, by: str) -> DataFrame:
    """Each alignment column with both bars' numbers, matched, predicted and expected counts of each kind, and whether the bar is exact."""
    sides = [keyed(df, by).select(by, F.col("place").alias(name), F.struct("number", "meter", "meter_valid", "partial_reason", *KINDS).alias(f"_{name}")) for df, name in ((reference, "reference"), (candidate, "candidate"))]
    rows = alignment.join(sides[0], [by, "reference"], "left").join(sides[1], [by, "candidate"], "left")
    ref, pred = F.col("_reference"), F.col("_candidate")
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    counts = [c for k in KINDS for c in (C.common_count(ref[k], pred[k]).cast("long").alias(f"{k}_matched"), size(pred[k]).cast("long").alias(f"{k}_predicted"), size(ref[k]).cast("long").alias(f"{k}_expected"))]
    paired = ref.isNotNull() & pred.isNotNull()
    exact = paired & ref["meter"].eqNullSafe(pred["meter"])
    for k in KINDS:
        exact = exact & C.same_bag(ref[k], pred[k])
    kind = F.when(ref.isNull(), "extra").when(pred.isNull(), "missing").when(~exact, "notation")
    return rows.select(by, "column", ref["number"].alias("measure"), pred["number"].alias("candidate_measure"), pred["meter_valid"].alias("meter_valid"), pred["partial_reason"].alias("partial_reason"), *counts, paired.alias("paired"), exact.alias("exact"), kind.alias("kind"))


def dice(matched: str, predicted: str, expected: str) -> Column:
    return C.safe_ratio(2 * F.col(matched), F.col(predicted) + F.col(expected), None)


def edition_summary(compared: DataFrame, by: str) -> DataFrame:
    """One row a score: event F1s, the exact share of all alignment columns, the paired share of edition bars, and the share of ordinary candidate bars with a valid meter."""
    sums = [F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in KINDS for x in ("matched", "predicted", "expected")]
    ordinary = F.col("candidate_measure").isNotNull() & F.col("meter_valid").isNotNull() & (F.coalesce("partial_reason", F.lit("")) == "")
    one = lambda c: F.count(F.when(c, 1))
    rows = compared.groupBy(by).agg(
        *sums, F.count("*").alias("alignment_columns"), one(F.col("paired")).alias("paired_measures"), one(F.col("exact")).alias("exact_measures"), F.count("measure").alias("reference_measures"), F.count("candidate_measure").alias("candidate_measures"),
        one(ordinary).alias("meter_scored_measures"), one(ordinary & F.col("meter_valid")).alias("meter_valid_measures"), one(F.coalesce("partial_reason", F.lit("")) != "").alias("meter_partial_measures"),
    )
    ratio = lambda a, b: C.safe_ratio(F.col(a), F.col(b), None)
    return rows.select("*", dice("notes_matched", "notes_predicted", "notes_expected").alias("edition_note_f1"), dice("chords_matched", "chords_predicted", "chords_expected").alias("chord_f1"), dice("rests_matched", "rests_predicted", "rests_expected").alias("rest_f1"), ratio("exact_measures", "alignment_columns").alias("edition_exact_bar_rate"), ratio("paired_measures", "reference_measures").alias("bar_coverage"), ratio("meter_valid_measures", "meter_scored_measures").alias("meter_valid_rate"))


def form_match(compared: DataFrame, reference: DataFrame, candidate: DataFrame, by: str) -> DataFrame:
    """(by, form_exact_match): whether the candidate's route, told in the edition's bars by the alignment, is the edition's; null unless both are resolved."""
    pairs = compared.where("paired").groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("candidate_measure", "measure"))).alias("to"))
    side = lambda df, n: df.select(by, F.col("route").alias(f"route_{n}"), F.col("route_status").alias(f"status_{n}"))
    rows = side(reference, "r").join(side(candidate, "c"), by).join(pairs, by, "left")
    mapped = F.transform("route_c", lambda x: F.try_element_at("to", x))
    same = F.coalesce((F.size(mapped) == F.size("route_r")) & F.forall(F.zip_with(mapped, "route_r", lambda a, b: a.eqNullSafe(b)), lambda x: x), F.lit(False))
    return rows.select(by, F.when((F.col("status_r") == "resolved") & (F.col("status_c") == "resolved"), same).alias("form_exact_match"))


def compare_editions(reference_bars: DataFrame, candidate_bars: DataFrame, reference: DataFrame, candidate: DataFrame, by: str = "score") -> tuple[DataFrame, DataFrame]:
    """(metrics, mismatches) of candidate scores against editions. An invalid candidate has null metrics; an invalid edition, or other ticks, is an error row with `problem`."""
    scores = reference.select(by, F.col("valid").alias("__r"), F.col("ticks_per_quarter").alias("__t")).join(candidate.select(by, F.col("valid").alias("__c"), F.col("ticks_per_quarter").alias("__u")), by)
    problem = F.when(~F.coalesce("__r", F.lit(False)), "the edition can't be read").when(~F.coalesce("__c", F.lit(False)), "the candidate can't be read").when(F.col("__t") != F.col("__u"), "time units differ")
    scores = scores.select(by, problem.alias("problem"))
    good = scores.where("problem IS NULL").select(by)
    a, b = (x.join(good, by, "left_semi") for x in (reference_bars, candidate_bars))
    compared = compared_bars(align_bars(a, b, by), a, b, by)
    form = form_match(compared, reference, candidate, by)
    metrics = scores.join(edition_summary(compared, by), by, "left").join(form, by, "left")
    metrics = metrics.withColumn("form_exact_match", F.when(F.col("problem").isNull(), F.col("form_exact_match")))
    wrong = compared.where("NOT exact").select(by, "measure", "candidate_measure", "kind")
    routes = metrics.where("NOT form_exact_match").select(by, F.lit(None).cast(compared.schema["measure"].dataType).alias("measure"), F.lit(None).cast(compared.schema["candidate_measure"].dataType).alias("candidate_measure"), F.lit("form").alias("kind"))
    return metrics, wrong.unionByName(routes)


def source_audit(mask: DataFrame, compared: DataFrame, by: str) -> DataFrame:
    """(by, note F1 and coverage) over audited bars (by, edition_bar): a missing bar's notes count as missed, bars that only the candidate has don't count. Null without audited bars."""
    rows = mask.select(by, F.col("edition_bar").alias("measure")).join(compared, [by, "measure"], "left")
    sums = rows.groupBy(by).agg(F.count("*").alias("source_scored_measures"), F.count("candidate_measure").alias("source_matched_measures"), *(F.sum(F.coalesce(f"notes_{x}", F.lit(0))).alias(f"notes_{x}") for x in ("matched", "predicted", "expected")))
    return sums.withColumn("source_note_f1", dice("notes_matched", "notes_predicted", "notes_expected"))


def audit_problems(mask: DataFrame, bars: DataFrame, by: str) -> DataFrame:
    """(by, edition_bar, problem) of audited bars (edition_bar, note_events_sha256, expected_noteheads): listed twice, unknown, or other events than the edition's."""
    own = bars.select(by, F.col("number").alias("edition_bar"), C.events_hash(note_keys(F.col("notes"))).alias("__hash"), F.size("notes").alias("__n"))
    rows = mask.groupBy(by, "edition_bar").agg(F.count("*").alias("__times"), F.first("note_events_sha256").alias("__said"), F.first("expected_noteheads").alias("__heads")).join(own, [by, "edition_bar"], "left")
    problem = F.when(F.col("__times") > 1, "listed twice").when(F.col("__n").isNull(), "unknown bar").when(~(F.col("__hash").eqNullSafe(F.col("__said")) & F.col("__n").eqNullSafe(F.col("__heads"))), "events differ")
    return rows.select(by, "edition_bar", problem.alias("problem")).where("problem IS NOT NULL")


def cohort(works: DataFrame, models: DataFrame, runs: DataFrame, by: str = "score", model: str = "model") -> DataFrame:
    """Every work with every model: the registered run's columns, status `not_run` without one. Both lists are short by nature, one row a planned run."""
    plan = works.select(by).crossJoin(F.broadcast(models.select(model)))
    return plan.join(runs, [by, model], "left").withColumn("status", F.coalesce("status", F.lit("not_run")))


def run_status(cases: DataFrame) -> DataFrame:
    """Cases (status, candidate_valid, route_status, n_missing, identical, has_decisions, n_issues) with their final status: failed runs and candidates
    that can't be read fail; what is unresolved, incomplete, identical with the edition, undocumented or has issues is partial."""
    partial = (F.col("route_status") != "resolved") | (F.col("n_missing") > 0) | F.col("identical") | ~F.col("has_decisions") | (F.col("n_issues") > 0)
    status = F.when(F.col("status").isin("not_run", "failed"), F.col("status")).when(~F.coalesce("candidate_valid", F.lit(False)), "failed").when(F.coalesce(partial, F.lit(True)), "partial").otherwise(F.col("status"))
    return cases.withColumn("status", status)


def cohort_problems(runs: DataFrame, works: DataFrame, models: DataFrame, by: str = "score", model: str = "model") -> DataFrame:
    """(by, model, problem) of registered runs: unknown work or model, listed twice, other source than the frozen one (input_sha256 against source_sha256)."""
    rows = runs.groupBy(by, model).agg(F.count("*").alias("n"), F.min("input_sha256").alias("a"), F.max("input_sha256").alias("b"))
    rows = rows.join(works.select(by, "source_sha256"), by, "left").join(models.select(model, F.lit(1).alias("known")), model, "left")
    problem = F.when(F.col("source_sha256").isNull(), "unknown work").when(F.col("known").isNull(), "unknown model").when(F.col("n") > 1, "listed twice").when((F.col("a") != F.col("source_sha256")) | (F.col("b") != F.col("source_sha256")), "other source")
    return rows.select(by, model, problem.alias("problem")).where("problem IS NOT NULL")
