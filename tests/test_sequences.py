"""Folds and dynamic programs against brute force."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pytest
from cadenza.operators import sequences as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_traces_are_least_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    found = S.trace(a, b)
    assert sum(k != "exact" for k, _, _ in found) == row[-1]
    assert [i for _, i, _ in found if i is not None] == list(range(len(a))) and [j for _, _, j in found if j is not None] == list(range(len(b)))


def test_edits_of_a_table(spark):
    df = spark.createDataFrame([(1, list("kitten"), list("sitting")), (2, [], ["x"]), (3, None, ["x"])], "k int, a array<string>, b array<string>")
    got = {r.k: r for r in S.edits(df, "a", "b").select("k", *S.edit_counts()).collect()}
    assert (got[1].exact, got[1].substitution, got[1].deletion, got[1].distance) == (4, 2, 1, 3) and got[2].deletion == 1


def test_clusters(spark):
    rng = np.random.default_rng(0)
    lists = [sorted(round(float(x), 2) for x in rng.uniform(0, 10, n)) for n in (0, 1, 5, 30)]

    def by_mean(values, tolerance):
        out = []
        for v in values:
            if out and abs(v - out[-1][0]) <= tolerance:
                members = [*out[-1][1], v]
                out[-1] = (round(sum(members) / len(members), 3), members)
            else:
                out.append((round(v, 3), [v]))
        return out

    def by_first(values, tolerance):
        out, first, n = [], None, -1
        for v in values:
            if first is None or v - first > tolerance:
                first, n = v, n + 1
            out.append(n)
        return out

    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, v array<double>")
    got = {r.k: r for r in df.select("k", S.mean_clusters(F.col("v"), 0.7).alias("m"), S.anchored_clusters(F.col("v"), 0.7).alias("a")).collect()}
    for k, x in enumerate(lists):
        assert [c.members for c in got[k].m] == [m for _, m in by_mean(x, 0.7)]
        assert got[k].a == by_first(x, 0.7)


def test_anchored_groups(spark):
    rows = [(0, 0.0, "a", 60, 0.5, 1), (0, 0.2, "b", 60, 0.9, 2), (0, 0.3, "c", 64, 0.4, 3), (0, 0.4, "d", 67, 0.3, 4), (0, 2.0, "e", 60, 0.1, 5)]
    df = spark.createDataFrame(rows, "g int, x double, id string, pitch int, score double, rank int")
    got = {(r.cluster, r.id) for r in S.anchored_groups(df, ["g"], "x", "pitch", "score", "rank", "id", 0.5, 2).collect()}
    assert got == {(0, "b"), (0, "c"), (1, "e")}


def test_longest_gapped_run(spark):
    def brute(bits, gap):
        places, best = [k for k, x in enumerate(bits) if x], (0, None, None)
        runs = []
        for p in places:
            if runs and p - runs[-1][-1] - 1 <= gap:
                runs[-1].append(p)
            else:
                runs.append([p])
        for r in runs:
            if r[-1] - r[0] + 1 > best[0]:
                best = (r[-1] - r[0] + 1, r[0], r[-1])
        return best

    rng = np.random.default_rng(3)
    lists = [[], [False], *(rng.random(n) < 0.4 for n in (1, 5, 20, 40, 60))]
    df = spark.createDataFrame([(k, [bool(b) for b in x]) for k, x in enumerate(lists)], "k int, b array<boolean>")
    for gap in (0, 1, 3):
        got = {r.k: tuple(r.r) for r in df.select("k", S.longest_gapped_run(F.col("b"), gap).alias("r")).collect()}
        assert got == {k: brute(x, gap) for k, x in enumerate(lists)}


SYMBOL = st.fixed_dictionaries({"kind": st.sampled_from(["note", "rest"]), "duration": st.sampled_from([0.5, 1.0, 1.5, 2.0]), "costs": st.dictionaries(st.sampled_from([0.5, 1.0, 1.5, 2.0]), st.integers(0, 4).map(float), max_size=4)})


@settings(max_examples=150)
@given(st.lists(SYMBOL, min_size=1, max_size=4), st.sampled_from([2.0, 3.0, 4.0]), st.booleans())
def test_meter_decoding(symbols, expected, pickup):
    lengths, status = S.decode_meter(symbols, expected, pickup)
    seen = [s["duration"] for s in symbols]
    if sum(seen) == expected:
        assert (lengths, status) == (seen, "already_meter_complete")
    elif pickup and sum(seen) < expected:
        assert (lengths, status) == (seen, "pickup_preserved")
    else:
        options = [(sum(s["costs"].get(d, 1.0) + (0.75 if d != s["duration"] else 0) for s, d in zip(symbols, some, strict=True)), some) for some in product(*[S.REST_LENGTHS if s["kind"] == "rest" else S.NOTE_LENGTHS for s in symbols]) if sum(some) == expected]
        if options:
            assert tuple(lengths) == min(options)[1] and status == ("meter_repaired" if lengths != seen else "meter_confirmed")
        else:
            assert (lengths, status) == (seen, "unresolved_visual_total")


def test_meter_of_a_table(spark):
    rows = [(1, [("note", 1.0, {"2.0": 0.0}), ("note", 1.0, None)], 3.0, False), (2, [], 3.0, True)]
    df = spark.createDataFrame(rows, "k int, s array<struct<kind:string,duration:double,costs:map<string,double>>>, e double, p boolean")
    got = {r.k: r.fit for r in S.fit_meter(df, "s", "e", "p").collect()}
    assert (got[1].durations, got[1].onsets, got[1].status) == ([2.0, 1.0], [0.0, 2.0], "meter_repaired") and got[2].status == "pickup_preserved"


@settings(max_examples=200)
@given(st.lists(st.integers(0, 2), max_size=4), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5)), max_size=6))
def test_rising_alignments(wanted, candidates):
    kinds, scores = [k for k, _ in candidates], [float(s) for _, s in candidates]
    every = []
    for n in range(min(len(wanted), len(kinds)) + 1):
        for left in combinations(range(len(wanted)), n):
            for right in combinations(range(len(kinds)), n):
                if all(wanted[i] == kinds[j] for i, j in zip(left, right, strict=True)):
                    every.append((-n, -sum(scores[j] for j in right), tuple(zip(left, right, strict=True))))
    best = min(every)
    count, pairs = S.rising(wanted, kinds, scores)
    assert count == -best[0] and sum(scores[j] for _, j in pairs) == -best[1]
    full = S.full_rising(wanted, kinds, scores)
    whole = [(-s, tuple(j for _, j in p)) for n, s, p in every if -n == len(wanted)]
    assert (full is None) == (not whole) and (full is None or (sum(scores[j] for j in full), tuple(full)) == max(whole))


def test_pitch_alignment_of_a_table(spark):
    df = spark.createDataFrame([(1, [60, 62], [(60, 0.5), (61, 0.9), (62, 0.7)]), (2, [60, 62], [(62, 0.7), (60, 0.5)]), (3, [], [])], "k int, w array<int>, c array<struct<pitch:int,score:double>>")
    got = {r.k: r.proposal for r in S.align_pitches(df, "w", "c").collect()}
    assert got[1].status == "available" and [(p.expected, p.candidate) for p in got[1].pairs] == [(0, 0), (1, 2)] and got[1].confidence == 0.6
    assert got[2].status == "partial" and len(got[2].pairs) == 1 and got[3].confidence == 1.0


def test_onset_groups():
    candidates = [{"id": k, "x": x, "y": 0.0, "pitch": p, "score": s} for k, x, p, s in (("a", 0.0, 60, 1.0), ("b", 1.0, 64, 1.0), ("c", 50.0, 62, 1.0), ("d", 52.0, 99, 0.1))]
    cost, ids = S.align_groups([[60, 64], [62]], candidates, 100.0, 10.0)
    assert ids == [["a", "b"], ["c"]]
    assert S.align_groups([[60], [62], [64]], candidates[:1], 100.0, 10.0)[1].count([]) == 2
    assert S.align_groups([], candidates, 100.0, 10.0)[1] == [] and cost > 0

    def brute(i, j):  # all ways, without memory
        if i == 3:
            return 0.0
        options = [brute(i + 1, j) + S.MISSING]
        for k in range(j, len(candidates)):
            options.append((k - j) * S.SKIPPED + S.group_cost([p[i]], [candidates[k]], (i + 1) / 4, 100.0, 10.0) + brute(i + 1, k + 1))
        return min(options)

    p = [60, 62, 99]
    assert S.align_groups([[x] for x in p], candidates, 100.0, 10.0)[0] == pytest.approx(brute(0, 0), abs=0.01)


def test_onset_groups_of_a_table(spark):
    df = spark.createDataFrame([(1, [[60], [62]], [("a", 1.0, 0.0, 60, 1.0), ("b", 60.0, 0.0, 62, 1.0)], 100.0, 10.0)], "k int, g array<array<int>>, c array<struct<id:string,x:double,y:double,pitch:int,score:double>>, w double, s double")
    assert S.align_onsets(df, "g", "c", "w", "s").first().alignment.ids == [["a"], ["b"]]


def test_staff_lines(spark):
    assert S.five_lines([0, 10, 20, 30, 40, 47]) == [0, 10, 20, 30, 40]
    assert S.five_lines([0, 10, 20, 30]) is None and S.five_lines([0, 1, 2, 3, 4]) is None and S.five_lines([0, 30, 33, 60, 90]) is None
    df = spark.createDataFrame([(1, [40.0, 0.0, 10.0, 20.0, 30.0]), (2, None)], "k int, r array<double>")
    assert {r.k: r.lines for r in S.staff_lines(df, "r").collect()} == {1: [0.0, 10.0, 20.0, 30.0, 40.0], 2: None}


@settings(max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 150), st.integers(6, 10), st.integers(0, 3)), max_size=6))
def test_staves_that_stand_apart(spans):
    staves = [{"top": t, "bottom": t + 4 * s, "spacing": s, "deviation": d / 10, "support": 1.0} for t, s, d in spans]

    def apart(some):
        some = sorted(some, key=lambda k: staves[k]["top"])
        return all(staves[b]["top"] - staves[a]["bottom"] >= max(12, round(min(staves[a]["spacing"], staves[b]["spacing"]) * 1.5)) for a, b in zip(some, some[1:], strict=False))

    best = max(((n, -sum(staves[k]["deviation"] for k in some)) for n in range(len(staves) + 1) for some in combinations(range(len(staves)), n) if apart(some)), default=(0, 0))
    got = S.distinct_staves(staves)
    assert apart(got) and len(got) == best[0] and -sum(staves[k]["deviation"] for k in got) == pytest.approx(best[1])


@settings(max_examples=60)
@given(st.integers(1, 4), st.randoms(use_true_random=False))
def test_staff_tracking(n, rng):
    support = [[float(rng.randint(0, 5)) for _ in range(5)] for _ in range(n)]

    def gain(path):
        return sum(support[k][p] for k, p in enumerate(path)) - sum(1.8 * abs(a - b) for a, b in zip(path, path[1:], strict=False)) - sum(0.04 * abs(p - 2) for p in path[1:])

    best = max(gain(p) for p in product(range(5), repeat=n))
    assert gain([s + 2 for s in S.track_shift(support)]) == pytest.approx(best)
    assert S.track_shift([]) == []


def test_rhythm_reports(spark):
    kind = "id int, predicted array<struct<kind:string,onset:double,duration:double,heads:int>>, truth array<struct<kind:string,onset:double,duration:double,heads:int>>"
    n, r = lambda o, d: ("note", o, d, 1), lambda o, d: ("rest", o, d, 0)
    df = spark.createDataFrame([(1, [n(0.0, 1.0), r(1.0, 2.0)], [n(0.0, 1.0), r(1.0, 2.0)]), (2, [n(0.0, 1.0), n(1.0, 2.0)], [n(0.0, 2.0)])], kind)
    rows = {x.id: x for x in S.rhythm_report(df, ["id"]).collect()}
    assert rows[1].exact_rhythm and (rows[2].duration_correct, rows[2].duration_total, rows[2].overproduced) == (0, 2, True)
    total = S.rhythm_summary(S.rhythm_report(df, ["id"])).first()
    assert (total.exact, total.rest_f1, total.duration_accuracy) == (1, 1.0, round(1 / 3, 6))


def test_composed_events(spark):
    head = lambda k, g, x, p, d: {"id": k, "group": g, "x": x, "pitch": p, "duration": d, "costs": {}}
    two = [head("a", 1, 5.0, 60, 1.0), head("b", 1, 5.1, 64, 1.0), head("c", 2, 9.0, 62, 2.0)]
    whole = S.compose(two, [], 3.0, False)
    assert whole["status"] == "already_meter_complete" and [(n["id"], n["onset"], n["duration"]) for n in whole["notes"]] == [("a", 0.0, 1.0), ("b", 0.0, 1.0), ("c", 1.0, 2.0)]
    led = S.compose(two, [], 3.5, False)
    assert led["rests"] == [{"onset": 0.0, "duration": 0.5}] and led["notes"][0]["onset"] == 0.5
    assert S.compose(two, [], None, False)["status"] == "missing_expected_meter"
    long = S.compose(two, [], 9.0, False)
    assert long["status"].startswith("meter_fallback") and sum(n["duration"] for n in long["notes"] if n["id"] != "b") + sum(r["duration"] for r in long["rests"]) == 9.0
    assert S.compose(two, [{"x": 7.0, "duration": 0.5, "costs": {}}], 4.0, True)["status"] == "pickup_preserved"
    kind = "k int, h array<struct<id:string,group:int,x:double,pitch:int,duration:double,costs:map<string,double>>>, r array<struct<x:double,duration:double,costs:map<string,double>>>, e double, p boolean"
    df = spark.createDataFrame([(1, [("a", 1, 5.0, 60, 1.0, {"2.0": 0.0, "1.0": 1.0})], [], 2.0, False)], kind)
    assert [(n.onset, n.duration) for n in S.composed(df, "h", "r", "e", "p").first().events.notes] == [(0.0, 2.0)]
