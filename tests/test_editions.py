"""Editions and benchmarks: alignment against brute force, comparisons of changed scores, truth and its problems."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from cadenza.operators import benchmark, editions
from cadenza.operators import events as views
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

BAR = "score string, place long, number int, meter string, meter_valid boolean, partial_reason string, notes array<struct<onset:long,duration:long,pitch:int,tie_start:boolean,tie_end:boolean>>, rests array<struct<onset:long,duration:long,visible:boolean>>, chords array<struct<onset:long,symbol:string>>"
SCORE = "score string, valid boolean, ticks_per_quarter int, route array<int>, route_status string"


def bar(score, place, pitches, **more):
    row = {"number": place + 1, "meter": "3/4", "meter_valid": True, "partial_reason": None, "rests": [], "chords": []} | more
    return score, place, row["number"], row["meter"], row["meter_valid"], row["partial_reason"], [(k * 384, 384, p, False, False) for k, p in enumerate(pitches)], row["rests"], row["chords"]


@settings(max_examples=120)
@given(st.lists(st.lists(st.integers(0, 2), max_size=3), max_size=5), st.lists(st.lists(st.integers(0, 2), max_size=3), max_size=5))
def test_alignment_is_of_least_cost(a, b):
    a, b = ([[str(x) for x in bar_] for bar_ in side] for side in (a, b))

    def f1(x, y):
        return 2 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) if x or y else 0.0

    assert np.allclose(editions.similarities(a, b), np.array([[f1(x, y) for y in b] for x in a]).reshape(len(a), len(b)))

    @lru_cache(None)
    def cost(i, j):
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j
        return min(cost(i + 1, j + 1) + 1 - f1(a[i], b[j]), cost(i + 1, j) + 1, cost(i, j + 1) + 1)

    left, right = editions.align(editions.similarities(a, b))
    total = sum(1 if i < 0 or j < 0 else 1 - f1(a[i], b[j]) for i, j in zip(left, right, strict=True))
    assert total == pytest.approx(cost(0, 0))
    assert [i for i in left if i >= 0] == list(range(len(a))) and [j for j in right if j >= 0] == list(range(len(b)))


def compare(spark, reference, candidate, routes=([1, 2, 3], [1, 2, 3])):
    refs, cands = (spark.createDataFrame(x, BAR) for x in (reference, candidate))
    scores = [spark.createDataFrame([("s", True, 384, r, "resolved" if r else "unsupported")], SCORE) for r in routes]
    metrics, wrong = editions.compare_editions(refs, cands, *scores)
    return metrics.first(), sorted((r.measure, r.candidate_measure, r.kind) for r in wrong.na.fill(-1).collect())


PIECE = [[60, 62, 64], [65, 67, 69], [71, 72, 60]]


def test_equal_scores(spark):
    m, wrong = compare(spark, [bar("s", k, p) for k, p in enumerate(PIECE)], [bar("s", k, p) for k, p in enumerate(PIECE)])
    assert (m.edition_note_f1, m.edition_exact_bar_rate, m.bar_coverage, m.form_exact_match, m.meter_valid_rate, m.problem) == (1.0, 1.0, 1.0, True, 1.0, None) and wrong == []


def test_a_missing_bar_does_not_shift_the_later_ones(spark):
    reference = [bar("s", k, p) for k, p in enumerate(PIECE)]
    m, wrong = compare(spark, reference, [bar("s", 0, PIECE[0]), bar("s", 1, PIECE[2])], ([1, 2, 3], [1, 2]))
    assert (m.paired_measures, m.exact_measures, m.alignment_columns, m.form_exact_match) == (2, 2, 3, False)
    assert wrong == [(-1, -1, "form"), (2, -1, "missing")] and m.edition_note_f1 == pytest.approx(2 * 6 / 15)


def test_repeated_heads_hidden_rests_and_signs_count_as_they_should(spark):
    reference = [bar("s", 0, [60, 62], rests=[(768, 384, True), (0, 10, False)], chords=[(0, "B♭")])]
    same = [bar("s", 0, [60, 62], rests=[(768, 384, None)], chords=[(0, " Bb ")])]
    m, _ = compare(spark, reference, same, ([1], [1]))
    assert m.exact_measures == 1 and m.chord_f1 == 1.0 and m.rest_f1 == 1.0
    twice = [(*same[0][:6], [*same[0][6], same[0][6][0]], *same[0][7:])]
    m, wrong = compare(spark, reference, twice, ([1], [1]))
    assert (m.notes_matched, m.notes_predicted, m.exact_measures) == (2, 3, 0) and wrong == [(1, 1, "notation")]
    other, _ = compare(spark, reference, [bar("s", 0, [60, 62], meter="4/4", rests=[(768, 384, True)], chords=[(0, "Bb")])], ([1], None))
    assert other.exact_measures == 0 and other.form_exact_match is None


def test_scores_that_cannot_be_compared(spark):
    empty = spark.createDataFrame([], BAR)
    side = lambda valid, ticks: spark.createDataFrame([("s", valid, ticks, [1], "resolved")], SCORE)
    for a, b, problem in ((side(False, 384), side(True, 384), "the edition can't be read"), (side(True, 384), side(False, 384), "the candidate can't be read"), (side(True, 384), side(True, 96), "time units differ")):
        metrics, wrong = editions.compare_editions(empty, empty, a, b)
        assert [(r.problem, r.edition_note_f1, r.form_exact_match) for r in metrics.collect()] == [(problem, None, None)] and wrong.count() == 0


def test_too_many_bars_are_refused(spark):
    long = spark.createDataFrame([bar("s", k, [60]) for k in range(6)], BAR)
    with pytest.raises(Exception, match="at most 5 bars"):
        editions.align_bars(long, long, "score", most=5).collect()


def test_source_audit(spark):
    reference = spark.createDataFrame([bar("s", k, p) for k, p in enumerate(PIECE)], BAR)
    candidate = spark.createDataFrame([bar("s", 0, [60, 62, 65]), bar("s", 1, PIECE[2])], BAR)
    compared = editions.compared_bars(editions.align_bars(reference, candidate, "score"), reference, candidate, "score")
    keys = reference.select("number", editions.C.events_hash(editions.note_keys(F.col("notes"))).alias("h"), F.size("notes").alias("n")).collect()
    mask = spark.createDataFrame([("s", r.number, r.h, r.n) for r in keys if r.number < 3], "score string, edition_bar int, note_events_sha256 string, expected_noteheads int")
    (row,) = editions.source_audit(mask, compared, "score").collect()
    assert (row.source_scored_measures, row.source_matched_measures, row.notes_matched, row.notes_expected) == (2, 1, 2, 6)
    assert row.source_note_f1 == pytest.approx(2 * 2 / (6 + 3))
    assert editions.audit_problems(mask, reference, "score").count() == 0
    wrong = mask.unionAll(mask.limit(1)).unionAll(spark.createDataFrame([("s", 9, "x", 1), ("s", 3, "x", 3)], mask.schema))
    assert {(r.edition_bar, r.problem) for r in editions.audit_problems(wrong, reference, "score").collect()} == {(1, "listed twice"), (9, "unknown bar"), (3, "events differ")}


def test_cohorts(spark):
    works, models = spark.createDataFrame([("a", "h1"), ("b", "h2")], "score string, source_sha256 string"), spark.createDataFrame([("m",), ("n",)], "model string")
    runs = spark.createDataFrame([("a", "m", "complete", "h1"), ("b", "m", "failed", "x"), ("c", "m", "complete", "h"), ("a", "z", "complete", "h1")], "score string, model string, status string, input_sha256 string")
    assert {(r.score, r.model, r.status) for r in editions.cohort(works, models, runs).collect()} == {("a", "m", "complete"), ("a", "n", "not_run"), ("b", "m", "failed"), ("b", "n", "not_run")}
    assert {(r.score, r.model, r.problem) for r in editions.cohort_problems(runs, works, models).collect()} == {("b", "m", "other source"), ("c", "m", "unknown work"), ("a", "z", "unknown model")}
    cases = [("complete", True, "resolved", 0, False, True, 0), ("complete", True, "resolved", 1, False, True, 0), ("complete", False, None, None, False, True, 0), ("not_run", None, None, None, None, None, None), ("complete", True, "resolved", 0, True, True, 0)]
    df = spark.createDataFrame(cases, "status string, candidate_valid boolean, route_status string, n_missing int, identical boolean, has_decisions boolean, n_issues int")
    assert [r.status for r in editions.run_status(df).collect()] == ["complete", "partial", "failed", "not_run", "partial"]


def test_benchmark_requests_and_truth(spark):
    targets = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 1, 8)], "system int, measure int, index int")
    records = spark.createDataFrame([(1, 1, 5, "p"), (1, 2, 9, "q"), (2, 1, 8, "r"), (2, 1, 8, "s")], "system int, measure int, index int, path string")
    good, bad = benchmark.requests(targets, records, ["system", "measure"], "index")
    assert [(r.system, r.measure, r.path) for r in good.collect()] == [(1, 1, "p")]
    assert {(r.system, r.measure, r.problem) for r in bad.collect()} == {(1, 2, "mapping drift"), (1, 3, "missing record"), (2, 1, "duplicate record")}
    asked = spark.createDataFrame([(1, 4.0, False), (2, 4.0, True), (3, 4.0, True), (4, 4.0, False), (5, 4.0, False)], "id int, expected_beats double, allow_pickup boolean")
    notes = spark.createDataFrame([(1, 1.0, 1.0, 60), (1, 1.0, 2.0, 64), (2, 0.0, 1.5, 60), (4, 3.0, 2.0, 60)], "id int, onset_beats double, duration_beats double, pitch_midi int")
    rows, problems = benchmark.truth(asked, notes, ["id"])
    assert {r.id: (r.extent, [tuple(x) for x in r.rests]) for r in rows.collect()} == {1: (4.0, [(0.0, 1.0), (3.0, 1.0)]), 2: (1.5, []), 5: (4.0, [(0.0, 4.0)])}
    assert {(r.id, r.problem) for r in problems.collect()} == {(3, "a pickup without notes"), (4, "past the measure")}


EVENTS = "id int, notes array<struct<onset:double,pitch:int,duration:double>>, rests array<struct<onset:double,duration:double>>"


def test_benchmark_predictions(spark):
    truths = spark.createDataFrame([(1, [(0.0, 60, 1.0), (1.0, 62, 1.0)], [(2.0, 1.0)]), (2, [(0.0, 60, 3.0)], []), (3, [], [(0.0, 3.0)])], EVENTS).withColumn("extent", F.lit(3.0))
    predictions = spark.createDataFrame([(1, [(1.0, 62, 1.0), (0.0, 60, 1.0)], [(2.0, 1.0)]), (2, [(0.0, 61, 3.0), (0.0, 61, 3.0)], [])], EVENTS)
    rows = {r.id: r for r in benchmark.evaluate(predictions, truths, ["id"]).collect()}
    assert rows[1].exact_measure and rows[1].note_f1 == 1.0
    assert (rows[2].note_tp, rows[2].note_fp, rows[2].note_fn, rows[2].onset_matches, rows[2].compared_notes) == (0, 1, 1, 1, 2)
    assert (rows[3].status, rows[3].exact_measure, rows[3].rest_fn) == ("missing_prediction", False, 1)
    assert benchmark.prediction_problems(predictions, truths, ["id"]).count() == 0
    bad = spark.createDataFrame([(1, [(-1.0, 200, 0.0)], [(0.0, 2.0), (1.0, 5.0)]), (9, [], []), (3, [(0.0, 60, 1.0)], [(0.5, 1.0)]), (3, [], [])], EVENTS)
    found = {(r.id, r.problem) for r in benchmark.prediction_problems(bad, truths, ["id"]).collect()}
    assert found == {(1, "negative note onset"), (1, "note without duration"), (1, "rest past the measure"), (1, "pitch outside 0 to 127"), (1, "rests overlap"), (9, "unknown identity"), (3, "rest overlaps a note"), (3, "duplicate")}


def test_views_sources_and_stubs(spark):
    events = spark.createDataFrame([("a", "note", 1, 0.0, 1.0, 60, 1, None), ("a", "chord", 1, 0.0, None, None, None, "Am")], "w string, kind string, measure int, onset_beats double, duration_beats double, pitch_midi int, accidental int, symbol string")
    assert views.melody_view(events, ["w"]).columns == ["w", *views.NOTE_FIELDS]
    notes, chords = views.canonical_view(events, ["w"])
    assert notes.columns[-1] == "accidental" and [r.symbol for r in chords.collect()] == ["Am"]
    works = spark.createDataFrame([("a", "3/4", "G"), ("b", None, "D"), ("c", "none", None)], "w string, time_signature string, key_hint string")
    meters, filled, given = views.with_stubs(works, notes, None, "w")
    assert {r.w: r.time_signature for r in meters.collect()} == {"a": "3/4", "b": "4/4", "c": "4/4"}
    assert filled.groupBy("w").count().orderBy("w").collect() == [("a", 1), ("b", 4), ("c", 4)] and {(r.w, r.symbol) for r in given.collect()} == {("b", "D"), ("c", "C")}
    candidates = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "w string, path string, place int")
    files = spark.createDataFrame([("y",)], "path string")
    assert {(r.w, r.path) for r in views.first_existing(candidates, files, "w").collect()} == {("a", "y"), ("b", None)}


def test_admission_rules(spark):
    kind = "id int, mode string, truth_used boolean, gate_passed boolean, fifths int, family string, method string, accidental_count int, glyph_ids array<string>, right_px int"
    rows = [(1, "initial", False, True, -1, "flat", "m", 1, ["a"], 5), (2, "later", None, False, 3, "sharp", "x", 3, [], -1), (3, "initial", False, True, 2, "flat", "m", 1, ["a", "b"], 0), (4, "initial", False, True, None, None, "m", None, None, 0)]
    got = {r.id: r for r in views.key_context(spark.createDataFrame(rows, kind), ["m"]).collect()}
    assert got[1].reasons == [] and got[1].accepted_fifths == -1
    assert got[2].reasons == ["detector_mode_is_not_initial", "prediction_is_not_truth_blind", "detector_structural_gate_failed", "detector_fifths_is_not_independently_supported", "detector_selection_method_is_not_supported", "detector_search_region_right_is_invalid"]
    assert got[3].reasons == ["detector_signature_family_is_inconsistent", "accidental_count_does_not_match_fifths"] and got[4].reasons == ["detector_fifths_is_not_an_integer"]
    bars = spark.createDataFrame([("a", k) for k in range(1, 8)], "w string, bar int")
    out = spark.createDataFrame([("a", ["notes"], [2], 4, 5), ("a", ["form"], [7], None, None)], "w string, dimensions array<string>, bars array<int>, first int, last int")
    assert sorted(r.bar for r in views.excluded_bars(bars, out, "w").collect()) == [2, 4, 5]
    targets = spark.createDataFrame([(1, "h", None), (2, "h", None), (3, "h", "known"), (4, "h", None)], "bar int, events_hash string, known_exclusion string")
    said = [(1, "r1", "supported", True, "h", "e"), (1, "r2", "supported", True, "h", "e"), (2, "r1", "uncertain", True, "h", "dark"), (2, "r2", "supported", True, "x", "e"), (3, "r1", "supported", True, "h", "e"), (3, "r2", "supported", True, "h", "e"), (4, "r1", "supported", True, "h", "e")]
    verdicts = spark.createDataFrame(said, "bar int, reader_id string, status string, context_checked boolean, events_hash string, evidence string")
    good, bad = views.admitted(targets, verdicts, ["bar"])
    assert [r.bar for r in good.collect()] == [1]
    assert {r.bar: r.reasons for r in bad.collect()} == {2: ["r1: uncertain: dark", "r2: observed notes differ or lack context"], 3: ["known"], 4: ["too few readers"]}


def test_zips_and_unions(spark):
    a, b = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "s string, place int, v string"), spark.createDataFrame([("s", 1, 7)], "s string, place int, n int")
    good, bad = views.strict_zip({"a": a, "b": b}, ["s"])
    assert [(r.place, r.a.v, r.b.n) for r in good.collect()] == [(1, "x", 7)] and [(r.place, r.missing) for r in bad.collect()] == [(2, ["b"])]
    assert views.union_outputs(a, b).count() == 3
    mapping = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("t", 1, 9)], "s string, k int, bar int")
    bars = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "s string, number int")
    assert {(r.s, r.valid) for r in views.injective_targets(mapping, bars, "s", "bar", "number").collect()} == {("s", False), ("t", False)}
    assert {(r.s, r.n_missing) for r in views.covers(bars, mapping.withColumnRenamed("bar", "number"), "s", "number").collect()} == {("s", 1), ("t", 1)}
    units = spark.createDataFrame([(1, True, True, None), (2, None, None, "x"), (3, False, False, "")], "k int, segmentation_confounded boolean, meter_valid boolean, partial_reason string")
    assert [r.k for r in views.clean_units(units).collect()] == [3] and [r.k for r in views.ordinary_bars(units).collect()] == [1, 3]
    assert views.filled(a, spark.createDataFrame([("s", 1), ("s", 9)], "s string, place int"), ["s", "place"]).count() == 2
