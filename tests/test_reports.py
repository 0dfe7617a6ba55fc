"""Reports, gates and contracts on small cases."""

from __future__ import annotations

import hashlib

import pytest
from cadenza.operators import integrity, reports
from cadenza.operators import selection as S
from pyspark.sql import functions as F


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_event_comparison_of_empty_and_duplicate_events(spark):
    kind = "w string, kind string, measure int, onset_beats double, duration_beats double, pitch_midi int, symbol string"
    p = spark.createDataFrame([("a", "note", 1, 0.0, 1.0, 60, None), ("a", "note", 1, 0.0, 1.0, 60, None), ("a", "note", 1, 0.00001, 1.0, 62, None), ("a", "chord", 1, 0.0, None, None, " Am ")], kind)
    t = spark.createDataFrame([("a", "note", 1, 0.0, 1.0, 60, None), ("a", "note", 1, 0.0, 1.0, 62, None), ("a", "chord", 1, 2.0, None, None, "Am")], kind)
    meters = spark.createDataFrame([("a", "3/4", "3/4"), ("b", None, None)], "w string, time_signature_pred string, time_signature_truth string")
    rows = {r.w: r for r in reports.compare_events(p, t, ["w"], meters).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.pred_notes, a.truth_notes, a.note_count_delta, a.note_count_match, a.note_true_positives, a.note_f1) == (3, 2, 1, False, 2, 1.0)
    assert (a.chord_f1, a.chord_f1_measure_only, a.time_signature_match) == (0.0, 1.0, True)
    assert (b.note_f1, b.pred_notes, b.note_count_match, b.time_signature_match) == (0.0, 0, True, False)
    assert len(a) == 30  # the work and 29 values


def test_issues_resolutions_and_completion(spark):
    scores = spark.createDataFrame([("a", True, [], [], "resolved"), ("b", False, ["bad"], ["odd"], "unsupported"), ("c", False, [], [], "resolved")], "s string, valid boolean, errors array<string>, warnings array<string>, route_status string")
    bars = spark.createDataFrame([("a", 1, None, 384, 1152, "pickup_candidate"), ("a", 2, False, 768, 1152, None), ("a", 3, True, 1152, 1152, None), ("b", 1, True, 1152, 1152, None)], "s string, number int, meter_valid boolean, duration_ticks long, expected_ticks long, partial_reason string")
    decisions = spark.createDataFrame([("a", "d1", "bar 1", "c", "x", "r", "u"), ("a", "d2", "bar 1", "", "x", "r", "u")], "s string, id string, location string, category string, adopted_choice string, reason string, uncertainty string")
    issues = reports.score_issues(scores, bars, decisions, "s")
    rows = issues.collect()
    assert sorted((r.s, r.kind, r.measure or 0) for r in rows) == [("a", "decisions", 0), ("a", "meter", 1), ("a", "meter", 2), ("b", "form", 0), ("b", "parse", 0), ("b", "parser_warning", 0), ("c", "empty", 0), ("c", "parse", 0)]
    meter = {r.measure: r.issue_id for r in rows if r.kind == "meter"}
    form = next(r.issue_id for r in rows if r.kind == "form")
    told = [("a", 1, meter[1], "h", "unpaired_pickup", 4, "why"), ("a", 2, meter[1], "h", "unpaired_pickup", 4, "again"), ("a", 3, meter[2], "h", "unpaired_pickup", 4, "why"), ("a", 4, "nothing", "h", "source_irregular_meter", 4, "why"), ("b", 1, form, "h", "source_irregular_meter", 4, "why"), ("a", 5, "x", "h", "source_irregular_meter", 4, " ")]
    resolutions = spark.createDataFrame(told, "s string, place int, issue_id string, abc_sha256 string, category string, inspection_call int, reason string")
    drafts = spark.createDataFrame([("a", "h", True), ("b", "h", False), ("c", "h", True)], "s string, abc_sha256 string, complete_claimed boolean")
    seen = spark.createDataFrame([("a", 4)], "s string, call int")
    marked, wrong = reports.resolve_issues(issues, resolutions, drafts, seen, "s")
    assert {(r.s, r.place, r.problem) for r in wrong.collect()} == {("a", 2, "duplicate resolution"), ("a", 3, "unsupported category"), ("a", 4, "stale or unmatched issue"), ("b", 1, "must be corrected"), ("a", 5, "blank or too long text")}
    assert [r.measure for r in marked.where("resolved").collect()] == [1]
    stale, _ = reports.resolve_issues(issues, resolutions, drafts.withColumn("abc_sha256", F.lit("new")), seen, "s")
    assert stale.where("resolved").count() == 0
    _, uncited = reports.resolve_issues(issues, resolutions.where("place = 1 AND s = 'a'"), drafts, seen.limit(0), "s")
    assert [r.problem for r in uncited.collect()] == ["no inspection cited"]
    only = marked.where("s = 'a' AND measure = 1")
    none = wrong.limit(0)
    assert {r.s: r.status for r in reports.completion(drafts, only, none, "s").collect()} == {"a": "ready_with_source_exceptions", "b": "partial", "c": "ready"}
    assert {r.s: r.status for r in reports.completion(drafts, marked, wrong, "s").collect()} == {"a": "needs_resolution", "b": "needs_resolution", "c": "needs_resolution"}


def test_catalogs(spark):
    kind = "song_number int, mapping_status string, pdf_pages array<int>, manuscript_pages array<int>, title string, slug string"
    good = [(1, "verified", [2, 3], [1, 2], "A", "a"), (2, "missing", [], [3], "B", "b"), (3, "unresolved", [], [], "-", None)]
    front = spark.createDataFrame([(1,)], "pdf_page int")
    df = spark.createDataFrame(good, kind)
    assert reports.catalog_problems(df, front, 3).count() == 0
    (row,) = reports.catalog_summary(df, front).collect()
    assert tuple(row) == (3, 2, 1, 1, 1, 2, 1)
    assert reports.differing_totals(reports.catalog_summary(df, front).withColumn("c", F.lit("x")), reports.catalog_summary(df, front).withColumn("c", F.lit("x")).withColumn("table_rows", F.lit(4)), ["c"]).select("name", "computed", "stored").collect() == [("table_rows", "3", "4")]
    bad = [(1, "verified", [2, 4], [1, 2], "A", "a"), (2, "missing", [5], [], "-", "b"), (2, "odd", [], [], "-", None), (5, "unresolved", [], [], "x", None), (6, "verified", [], [], "x", None)]
    found = {(r.song_number, r.problem) for r in reports.catalog_problems(spark.createDataFrame(bad, kind), front, 5).collect()}
    assert found == {(1, "pages aren't consecutive"), (2, "unverified entry owns pages"), (2, "missing work without name or pages"), (2, "unknown status"), (2, "listed twice"), (5, "placeholder is named or mapped"), (6, "verified without every page"), (None, "numbers aren't a run"), (None, "page 3 isn't covered")}


def test_labels_seals_and_attestations(spark):
    works = spark.createDataFrame([(k, "s", "e") for k in "abcdefg"], "w string, source_sha256 string, edition_sha256 string")
    ok = [("1", "why")]
    labels = [("a", "s", "e", "draft", ok), ("b", "s", "x", "draft", ok), ("c", "s", "e", "odd", ok), ("d", "s", "e", "draft", [("1", " ")]), ("e", "s", "e", "draft", [*ok, *ok]), ("f", "s", "e", "draft", ok), ("f", "s", "e", "draft", ok), ("z", "s", "e", "draft", ok)]
    df = spark.createDataFrame(labels, "w string, source_sha256 string, edition_sha256 string, status string, decisions array<struct<id:string,reason:string>>")
    assert {(r.w, r.problem) for r in reports.label_problems(df, works, "w").collect()} == {("b", "made for other files"), ("c", "unknown status"), ("d", "decision without id or reason"), ("e", "decision listed twice"), ("f", "listed twice"), ("g", "missing labels"), ("z", "unknown work")}
    predictions = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "r"), ("d", "s")], "w string, body string")
    seals = spark.createDataFrame([("a", sha("p"), 1), ("b", sha("x"), 1), ("c", sha("r"), 9)], "w string, sha256 string, sealed_at int")
    opened = spark.createDataFrame([("a", 5), ("c", 5)], "w string, opened_at int")
    assert {(r.w, r.problem) for r in reports.sealed_before_truth(predictions, seals, opened, "w", "body").collect()} == {("b", "changed after sealing"), ("c", "sealed after truth was opened"), ("d", "not sealed")}
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 1, "c")], "g string, n int, body string")
    pin = sha(sha("a") + "\n" + sha("b"))
    pins = spark.createDataFrame([("x", pin), ("y", "no"), ("z", "no")], "g string, sha256 string")
    assert {(r.g, r.problem) for r in reports.hash_gate(rows, pins, ["g"], ["n"], "body").collect()} == {("y", "changed"), ("z", "missing rows")}
    runs = spark.createDataFrame([(k, "m", st, "h", "h") for k, st in (("a", "complete"), ("b", "complete"), ("c", "complete"), ("d", "failed"), ("e", "complete"))], "w string, model string, status string, abc_sha256 string, decision_log_sha256 string")
    trace = [("a", "m", "input_only", True, False, "r", 1, "h", "h"), ("b", "x", "input_only", True, False, "r", 1, "h", "h"), ("c", "m", "input_only", True, True, "r", 1, "h", "h"), ("d", "m", "input_only", True, False, "r", 0, None, None), ("f", "m", "input_only", True, False, "r", 0, None, None)]
    traces = spark.createDataFrame(trace, "w string, model string, isolation string, fresh_context boolean, network_access boolean, runner_name string, revision_passes int, abc_sha256 string, decision_log_sha256 string")
    assert {(r.w, r.problem) for r in reports.attestation_problems(runs, traces, ["w"], ["model"]).collect()} == {("b", "differs: model"), ("c", "isolation isn't attested"), ("e", "no runner record")}
    old = traces.withColumn("abc_sha256", F.lit("other"))
    assert ("a", "output hashes missing or different") in {(r.w, r.problem) for r in reports.attestation_problems(runs, old, ["w"], ["model"]).collect()}


def test_revisions_stop_and_keep_every_attempt():
    fix = lambda draft, issues: draft - 1
    assert reports.revise(1, lambda d: ["x"] * d, fix) == [(1, ["x"]), (0, [])]
    assert [d for d, _ in reports.revise(9, lambda d: ["x"] * d, fix)] == [9, 8, 7]


def test_source_maps(spark):
    rows = [(1, "primary", "s1", None, None), (2, "primary", "s1", None, None), (3, "return_copy", "s2", None, "again"), (4, "editorial_insertion", None, "e1", "why"), (5, "editorial_insertion", None, "e1", "why"), (5, "primary", "s9", None, None), (6, "return_copy", "s2", None, " "), (9, "primary", "s2", None, None)]
    a = spark.createDataFrame([("w", *r) for r in rows], "w string, written_bar int, kind string, source_bar_id string, editorial_id string, reason string")
    expected, bars = spark.createDataFrame([("w", "s1"), ("w", "s2")], "w string, source_bar_id string"), spark.createDataFrame([("w", 7)], "w string, n_bars int")
    found = {(r.problem, r.id) for r in reports.coverage_problems(a, expected, bars, "w").collect()}
    assert found == {("missing_source", "s2"), ("duplicate_primary", "s1"), ("unknown_source", "s9"), ("unclassified_bar", "6"), ("unclassified_bar", "7"), ("duplicate_bar", "5"), ("duplicate_editorial", "e1"), ("out_of_range", "9")}


def test_lanes_and_dimensions(spark):
    lanes = spark.createDataFrame([(1, "base", ["a"], 1), (1, "x", ["a"], 2), (2, "base", ["b"], 1), (3, "x", ["c"], 1)], "k int, lane string, ids array<string>, n int")
    got = {(r.k, r.present, r.ids_equal, r.n_equal) for r in reports.lane_invariance(lanes, ["k"], "lane", "base", ["ids", "n"]).collect()}
    assert got == {(1, True, True, False), (2, False, False, False), (3, False, False, False)}
    a, b = (spark.createDataFrame([(1, v)], "k int, v array<int>") for v in ([60, 62, 64], [60, 61, None]))
    assert {tuple(r) for r in reports.changed_places(a, b, ["k"], "v").collect()} == {(1, 1, 62, 61), (1, 2, 64, None)}
    df = spark.range(1).select(F.lit(1).alias("k"), F.struct(F.lit(1).alias("x"), F.lit("a").alias("y")).alias("l"), F.struct(F.lit(1).alias("x"), F.lit("b").alias("y")).alias("r"))
    assert {(r.dimension, r.status) for r in reports.dimension_comparison(df, ["k"], ["x", "y"], "l", "r").collect()} == {("x", "matched"), ("y", "mismatched")}
    assert reports.differing_paths({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"b": 2, "c": [1]}, "d": True, "e": 0}) == ["a.b", "d", "e"]
    routes = spark.createDataFrame([(1, [1, 2], [1, 2]), (2, [1, 2], [1, 2, 1]), (3, [1], [2])], "k int, a array<int>, b array<int>")
    assert {r.k: r.first_mismatch for r in reports.route_mismatch(routes, "a", "b").collect()} == {1: None, 2: 3, 3: 1}


def test_batches_first_items_and_kinds(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",)], "w string")
    status = spark.createDataFrame([("a", "complete"), ("b", "complete")], "w string, state string")
    stages = spark.createDataFrame([("a", "initial", True, 1.0), ("a", "reviewed", True, None), ("b", "initial", True, 2.0)], "w string, stage string, complete boolean, cost double")
    rows = {r.w: (r.done, r.outcome, r.cost, r.n_costs) for r in reports.batch_status(plan, status, stages, "w", ["initial", "reviewed"]).collect()}
    assert rows == {"a": (True, "complete", 1.0, 1), "b": (False, "missing a stage record", 2.0, 1), "c": (False, "not started", None, 0)}
    items = spark.createDataFrame([("a", k) for k in range(7)] + [("b", 1)], "w string, n int")
    got = reports.first_items(items, ["w"], [F.col("n")]).collect()
    assert sorted((r.w, r.n, r.more) for r in got) == [("a", k, 2) for k in range(5)] + [("b", 1, 0)]
    kinds = spark.createDataFrame([("x", 1), ("x", 3), ("y", 5)], "kind string, v int")
    rows = reports.by_kind(kinds, "kind", {"x": {"total": F.sum("v")}, "y": {"most": F.max("v"), "total": F.count("*")}})
    assert {tuple(r) for r in rows.collect()} == {("x", 2, "total", 4.0), ("y", 1, "most", 5.0), ("y", 1, "total", 1.0)}
    crops = spark.createDataFrame([("s", [1]), ("s", [2, 3]), ("t", [1])], "s string, n array<int>")
    assert {(r.s, r.merged, r.missing_boundaries, r.one_to_one, r.distinct) for r in reports.segmentation(crops, ["s"], "n").collect()} == {("s", 1, 1, False, True), ("t", 0, 0, True, True)}
    attempts = spark.createDataFrame([("m", 10, 5, 2, 0.5), ("m", None, 5, None, None), ("m", 1, 1, None, 0.25)], "m string, input_tokens int, output_tokens int, cached_tokens int, cost double")
    (u,) = reports.usage_totals(attempts, ["m"]).collect()
    assert (u.attempts, u.known, u.input_tokens, u.cached_tokens, u.output_tokens, u.cost) == (3, 2, 11, 2, 6, 0.75)
    assert {(r.kind, r.n) for r in reports.status_counts(kinds, [], "kind").collect()} == {("x", 2), ("y", 1)}


def test_audits_triage_and_dotted_halves(spark):
    targets = spark.createDataFrame([(1, ["a", "b"], "p1"), (2, ["a"], "p1"), (3, ["a"], "p2")], "bar int, events array<string>, location string")
    said = [(1, "r1", "supported", [], ["b", "a"], "p1"), (1, "r2", "supported", [], ["a", "b"], "p1"), (2, "r1", "supported", ["x"], ["a"], "p1"), (2, "r2", "supported", [], ["a"], "p9"), (3, "r1", "supported", [], ["a"], "p2")]
    good, bad = reports.audit_expansion(targets, spark.createDataFrame(said, "bar int, reader_id string, status string, issues array<string>, events array<string>, location string"), ["bar"])
    assert [r.bar for r in good.collect()] == [1]
    assert {r.bar: r.reasons for r in bad.collect()} == {2: ["r1: has issues", "r2: other location"], 3: ["too few readers"]}
    rows = spark.createDataFrame([(1, "x", 2.0, 3.0, False), (2, "y", 2.0, 3.0, True), (3, "z", 3.0, None, False), (4, "w", 3.0, 3.0, False)], "k int, body string, visual_beats double, expected_beats double, allow_pickup boolean")
    seal = spark.createDataFrame([(1, sha("x")), (2, sha("y")), (3, sha("z")), (4, "old"), (5, "gone")], "k int, sha256 string")
    fine, wrong = reports.triage(rows, seal, ["k"], "body")
    assert {r.k: (r.flag, r.reason) for r in fine.collect()} == {1: (True, "review_visual_meter_deficit"), 2: (False, "pickup_exempt"), 3: (False, "not_evaluable_missing_meter_context")}
    assert {(r.k, r.problem) for r in wrong.collect()} == {(4, "changed"), (5, "missing")}
    decisions = spark.createDataFrame([(1, True, 3.0, ["a", "b"], [["x", "y"]]), (2, False, 3.0, ["a", "b"], [["x", "y"]]), (3, True, 4.0, ["a", "b"], [["x", "y"]]), (4, True, 3.0, ["a", "b"], []), (5, True, 3.0, ["a", "c"], [["x", "y"]])], "k int, accepted boolean, expected_beats double, chosen_ids array<string>, dot_pairs array<array<string>>")
    lane = spark.createDataFrame([(k, c, 1) for k in range(1, 6) for c in "ab"], "k int, candidate_id string, onset_group int")
    assert {r.k: (r.applied, r.duration_beats) for r in reports.dotted_half(decisions, lane, ["k"]).collect()} == {1: (True, 3.0), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None)}


def test_integrity(spark, tmp_path):
    manifest = lambda rows: spark.createDataFrame(rows, "name string, bytes long, sha256 string")
    assert {(r.name, r.problem) for r in integrity.differences(manifest([("a", 1, "x"), ("b", 1, "y")]), manifest([("a", 1, "z"), ("c", 1, "y")])).collect()} == {("a", "changed"), ("b", "missing"), ("c", "added")}


def sweep_rows(spark):
    return spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.5, 1), (0.1, 0)], "s double, y int")


def test_sweeps_equal_brute_force(spark):
    rows = [(r.s, r.y) for r in sweep_rows(spark).collect()]
    got = {round(r.threshold, 6): (r.tp, r.fp, r.fn, r.kept) for r in S.label_sweep(sweep_rows(spark), "s", "y", parts=3).collect()}
    for t, found in got.items():
        kept = [y for s, y in rows if s >= t]
        assert found == (sum(kept), len(kept) - sum(kept), 3 - sum(kept), len(kept)) or t == 0.9 and found[3] in (0, 1)
    assert len(S.label_sweep(sweep_rows(spark), "s", "y").collect()) == 5
    assert S.best(S.label_sweep(sweep_rows(spark), "s", "y")).first().threshold == 0.5
    many = spark.range(5000).selectExpr("id % 997 AS s", "CAST(id % 3 = 0 AS INT) AS y")
    a, b = ({r.threshold: (r.tp, r.fp) for r in S.label_sweep(many, "s", "y", parts=n).collect()} for n in (1, 40))
    assert a == b and len(a) == 998
    grouped = many.withColumn("g", F.col("s") % 2)
    assert S.label_sweep(grouped, "s", "y", ["g"]).count() == 999


@pytest.mark.parametrize(("n", "budget"), [(5, 64), (200, 9), (200, 2), (1, 5)])
def test_threshold_grids(spark, n, budget):
    values = [k / 7 for k in range(n)]
    got = sorted(r.threshold for r in S.threshold_grid(spark.createDataFrame([(v,) for v in values], "s double"), "s", budget).collect())
    some = min(n, budget - 1)
    chosen = values if n <= some else sorted({values[round(k * (n - 1) / max(1, some - 1))] for k in range(some)})
    assert got == pytest.approx([*chosen, values[-1] + 1e-9]) and len(got) <= max(budget, 2)


def test_choices(spark):
    df = spark.createDataFrame([(1, 0.9, 0.2), (2, 0.95, 0.6), (3, 0.99, 0.7)], "rule int, precision double, recall double")
    assert S.first_rule(df, "rule", 0.9, 0.5).first().rule == 2 and S.first_rule(df, "rule", 1.0, 0.5).count() == 0
    assert S.best_of(df, [F.col("precision"), F.col("recall")]).first().rule == 3
    metrics = spark.createDataFrame([("B", 0.5, 0.5), ("C", 0.6, 0.4)], "name string, f1 double, pitch double")
    assert S.non_regression(metrics, "name", "B", "C", ["f1", "pitch"]).first().selected == "B"
    assert S.non_regression(metrics, "name", "B", "C", ["f1"]).first().selected == "C"
    rules = spark.createDataFrame([(1.0,), (2.0,)], "most double")
    found = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.5), (2, "c", 3.0)], "k int, id string, cost double")
    truth = spark.createDataFrame([(1, "a"), (1, "x")], "k int, id string")
    rows = {r.most: (r.accepted, r.tp, r.fp, r.fn) for r in S.rules_against(rules, found, truth, ["k", "id"], F.col("cost") <= F.col("most"), ["most"]).collect()}
    assert rows == {1.0: (1, 1, 0, 1), 2.0: (2, 1, 1, 1)}
    t = spark.createDataFrame([(0.3,), (0.7,)], "threshold double")
    assert S.swept(t, sweep_rows(spark).withColumn("g", F.lit(0)), "s", ["g"]).groupBy("threshold").count().orderBy("threshold").collect() == [(0.3, 4), (0.7, 3)]


def test_folds_and_filters(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 5.0, 0), ("b", 1.5, 1), ("c", 6.0, 0)], "g string, x double, y int")
    f = S.folds(df, "g")
    assert f.count() == 12 and f.where("is_test").count() == 4
    mean = lambda rows: rows.agg(F.avg("x")).first()[0]
    out = {(r.g, r.x): r.score for r in S.out_of_fold(df, "g", mean, lambda m, rows: rows.withColumn("score", F.lit(m))).collect()}
    assert out["a", 1.0] == 3.75 and out["c", 6.0] == 2.5
    assert S.centroid_filter(df.where("y = 0"), "y", ["x"]).count() == 0
    whole = S.centroid_filter(df.where("y = 1"), "y", ["x"])
    assert S.filtered(df, whole, ["x"]).count() == 4
    kept = S.filtered(df, S.centroid_filter(df, "y", ["x"]), ["x"])
    assert sorted(r.x for r in kept.collect()) == [1.0, 1.5]
    d = spark.createDataFrame([(1, 0, 0.5), (1, 0, 0.7), (1, 1, 0.2), (1, 1, 0.9), (1, -1, 0.6), (1, -1, 0.6)], "k int, label int, d double")
    assert tuple(S.nearest_class(d, ["k"], "label", "d", 2).first()) == (1, 1, 0.55)
    assert S.nearest_mean_gap(d.where("label >= 0"), ["k"], "label", "d", 1).first().score == pytest.approx(0.3)
    folds = spark.createDataFrame([("m", 1, 0, 0), ("m", 1, 1, 1), ("m", 2, 0, 1)], "m string, tp int, fp int, fn int")
    (r,) = S.fold_summary(folds, ["m"]).collect()
    assert (r.tp, r.exact_count_folds, r.exact_set_folds, r.folds) == (4, 2, 1, 3)


def test_leading_candidates(spark):
    rows = [(0, "a", 5.0, 0.9, 1, True), (0, "b", 1.0, 0.45, 2, False), (0, "c", 2.0, 0.45, 3, False), (0, "d", 4.8, 0.8, 4, False), (0, "e", 0.5, 0.1, 5, False)]
    df = spark.createDataFrame(rows, "g int, id string, x double, score double, rank int, kept boolean")
    pick = lambda **o: [r.id for r in S.leading_candidate(df, ["g"], **({"threshold": 0.5, "margin": 0.1, "lead": 3.0, "x_radius": 1.0, "most": 3} | o)).collect()]
    assert pick() == ["b"] and pick(lead=6.0) == [] and pick(most=1) == [] and pick(margin=0.0) == []
    rest = S.needs_leading_rest(F.lit(3.0), F.lit(2.5), F.lit(3.5), F.lit(False), F.lit(True))
    assert spark.range(1).select(rest, S.needs_leading_rest(F.lit(3.0), F.lit(2.0), F.lit(3.5), F.lit(False), F.lit(True))).first() == (True, False)
