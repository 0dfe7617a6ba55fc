"""Matching, suppression and neighbours against brute force."""

from __future__ import annotations

import itertools
from math import hypot
from time import process_time

import numpy as np
from cadenza.operators import rasters, spatial
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LINE = st.lists(st.integers(0, 12), max_size=9)


def brute_pairs(a, b, most, distance=lambda x, y: abs(x - y)):
    pairs = sorted((distance(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if distance(x, y) <= most)
    used_a, used_b, out = set(), set(), []
    for _, i, j in pairs:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            out.append((i, j))
    return sorted(out)


@settings(max_examples=400)
@given(LINE, LINE, st.integers(0, 6))
def test_closest_pairs_on_a_line(a, b, most):
    assert sorted(spatial.closest_pairs_on_line(np.array(a, float), np.array(b, float), most)) == brute_pairs(a, b, most)


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8), st.integers(1, 5))
def test_closest_pairs_in_the_plane(a, b, most):
    x, y = (np.array(p, float).reshape(-1, 2) for p in (a, b))
    assert sorted(spatial.closest_pairs(x, y, most)) == brute_pairs(a, b, most, lambda p, q: hypot(p[0] - q[0], p[1] - q[1]))


@settings(max_examples=300)
@given(LINE, LINE, st.integers(0, 6))
def test_sequential_rules(a, b, most):
    def brute(order):
        free, out = set(range(len(b))), []
        for i in order:
            able = [(abs(a[i] - b[j]), j) for j in free if abs(a[i] - b[j]) <= most]
            if able:
                free.discard(min(able)[1])
                out.append((i, min(able)[1]))
        return out

    x, y = np.array(a, float), np.array(b, float)
    assert spatial.nearest_unused(x, y, most) == brute(range(len(a)))
    assert spatial.sorted_unused(x, y, most) == brute(sorted(range(len(a)), key=lambda i: (a[i], i)))


def test_rules_differ():
    a, b = np.array([0.0, 1.0]), np.array([0.9, 5.0])
    assert spatial.closest_pairs_on_line(a, b, 2) == [(1, 0)] and spatial.nearest_unused(a, b, 2) == [(0, 0)]


def points(spark, rng, n, groups=3):
    return [(int(rng.integers(groups)), k, float(rng.integers(0, 60)), float(rng.integers(0, 20)), float(rng.integers(0, 9))) for k in range(n)], "g int, id long, x double, y double, score double"


def test_matching_of_tables(spark):
    """Chains split groups, and change nothing; either side of a group may be empty."""
    rng = np.random.default_rng(1)
    (a, kind), (b, _) = points(spark, rng, 60), points(spark, rng, 50)
    a = [r for r in a if r[0] != 2]
    left, right = spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)
    for at, rule, distance in ((["x"], spatial.closest_pairs_on_line, lambda p, q: abs(p[2] - q[2])), (["x", "y"], spatial.closest_pairs, lambda p, q: hypot(p[2] - q[2], p[3] - q[3]))):
        got = {(r.g, r.left_key, r.right_key) for r in spatial.match(left, right, ["g"], "id", at, 4.0, rule).collect()}
        expected = set()
        for g in range(3):
            p, q = ([r for r in rows if r[0] == g] for rows in (a, b))
            expected |= {(g, p[i][1], q[j][1]) for i, j in brute_pairs(p, q, 4.0, distance)}
        assert got == expected
    pairs = spatial.match(left, right, ["g"], "id", ["x"], 4.0)
    report = {r.g: r for r in spatial.match_report(pairs, left, right, ["g"]).collect()}
    n = {g: sum(r[0] == g for r in b) for g in range(3)}
    assert all(r.tp + r.fn == n[g] for g, r in report.items()) and report[2].tp == 0 and not report[2].exact
    assert spatial.unmatched(left, pairs, ["g"], "id", "left").count() == len(a) - pairs.count()
    near = {(r.g, r.left_key, r.right_key) for r in spatial.within(left, right, ["g"], "id", 4.0).collect()}
    assert near == {(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and hypot(p[2] - q[2], p[3] - q[3]) <= 4}


def test_ellipses(spark):
    c = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 9.0, 9.0)], "g int, id long, x double, y double")
    t = spark.createDataFrame([(0, 7, 1.5, 0.0, 2.0, 1.0), (0, 8, 0.0, 0.5, 1.0, 1.0)], "g int, id long, x double, y double, radius_x double, radius_y double")
    assert sorted((r.left_key, r.right_key) for r in spatial.match_ellipses(c, t, ["g"], "id").collect()) == [(1, 8), (2, 7)]
    assert sorted((r.left_key, r.right_key) for r in spatial.within_ellipses(c, t, ["g"], "id", 1.0).collect()) == [(1, 7), (1, 8), (2, 7)]


def test_suppression(spark):
    rng = np.random.default_rng(2)
    rows, kind = points(spark, rng, 150)
    df = spark.createDataFrame(rows, kind)
    for at, most in ((["x"], None), (["x", "y"], None), (["x", "y"], 5)):
        got = {(r.g, r.id, r.place) for r in spatial.suppress(df, ["g"], "id", at, "score", 3.0, most).collect()}
        expected = set()
        for g in range(3):
            kept = []
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4], r[1])):
                if all((abs(r[2] - k[2]) if len(at) == 1 else hypot(r[2] - k[2], r[3] - k[3])) >= 3 for k in kept):
                    kept.append(r)
            expected |= {(g, r[1], n) for n, r in enumerate(kept[:most], 1)}
        assert got == expected


HEADS = "g int, id string, x double, y double, score double, rank int, kept boolean"


def test_selection_and_recovery_of_heads(spark):
    rows = [(0, "a", 0.0, 0.0, 0.9, 1, True), (0, "b", 0.2, 2.0, 0.8, 2, False), (0, "c", 0.3, 0.4, 0.85, 3, False), (0, "d", 5.0, 0.0, 0.7, 4, True), (0, "e", 5.1, 1.5, 0.3, 5, False), (0, "f", 9.0, 0.0, 0.2, 6, False)]
    df = spark.createDataFrame(rows, HEADS)
    pick = lambda **o: [r.id for r in spatial.select_heads(df, ["g"], **o).orderBy("place").collect()]
    assert pick(threshold=0.5, x_radius=1.0, least=0, most=9) == ["a", "d"]
    assert pick(threshold=0.5, x_radius=1.0, least=3, most=9) == ["a", "d", "f"]
    assert pick(threshold=0.1, x_radius=1.0, least=0, most=2) == ["a", "d"]
    assert pick(threshold=0.25, x_radius=1.0, least=0, most=2, y_gap=1.0) == ["a", "b", "d", "e"]
    found = spatial.recover_heads(df, ["g"], threshold=0.25, x_radius=1.0, gap=(1.0, 3.0), ratio=0.4).collect()
    assert sorted((r.id, r.group, r.y_gap) for r in found) == [("b", 1, 2.0), ("e", 2, 1.5)]
    assert [r.id for r in spatial.recover_heads(df, ["g"], threshold=0.25, x_radius=1.0, gap=(1.0, 3.0), ratio=0.5).collect()] == ["b"]


def test_spaced_maxima(spark):
    values = [0, 3, 1, 4, 4, 0, 2, 0, 0, 5, 1]
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(values)], "g int, at int, v double")
    peaks = [k for k, v in enumerate(values) if v == max(values[max(0, k - 2) : k + 3])]
    kept = []
    for k in peaks:
        if kept and k - kept[-1] < 3:
            if values[k] > values[kept[-1]]:
                kept[-1] = k
        else:
            kept.append(k)
    assert [r["at"] for r in spatial.spaced_maxima(df, ["g"], "at", "v", 2, 3).orderBy("at").collect()] == kept


def test_nearest_two_in_blocks(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>")
    d = ((vectors[:, None] - vectors[None]) ** 2).sum(-1) + np.diag([np.inf] * 40)
    expected = {k: tuple(np.argsort(d[k])[:2].tolist()) for k in range(40)}
    for size in (1 << 20, 500):
        got = {r.id: (r.nearest, r.second) for r in spatial.nearest_two(df, df, "id", "v", most_bytes=size).collect()}
        assert got == expected
    kept = spatial.retrieved(spatial.nearest_two(df, df, "id", "v"), df.withColumn("told", F.col("id") * 2), "id", 1.5, ["told"]).collect()
    assert all(r.accepted == (r.distance <= 1.5) and r.told == (r.nearest * 2 if r.accepted else None) for r in kept)
    one = spatial.nearest_two(df.limit(1), df.limit(1), "id", "v").collect()
    assert [(r.nearest, r.second) for r in one] == [(None, None)]


def test_nearest_two_of_many_copies_and_rows_without_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(6000, 6)), 1) / 3  # ties that rounding could break
    vectors[rng.permutation(6000)[:2000]] = vectors[7]
    odd = [(6000, None), (6001, [1.0]), (6002, [float("nan")] * 6)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + odd, "id long, v array<double>")
    expected = {6000: (None, None, None, None), 6001: (None, None, None, None), 6002: (None, None, None, None)}
    for k, v in enumerate(vectors):
        d = np.add.accumulate((vectors - v) ** 2, axis=1)[:, -1]
        d[k] = np.inf
        a, b = np.argsort(d, kind="stable")[:2].tolist()
        expected[k] = a, float(np.sqrt(d[a])), b, float(np.sqrt(d[b]))
    for size in (1 << 26, 100_000):
        got = {r.id: (r.nearest, r.distance, r.second, r.second_distance) for r in spatial.nearest_two(df, df, "id", "v", most_bytes=size).collect()}
        assert got == expected


def test_nearest_two_measures_few_vectors():
    """Products rule nearly all vectors out: a hundred million pairs take seconds."""
    bank = np.random.default_rng(6).normal(size=(20_000, 64))
    began = process_time()
    squares, at = spatial._two_nearest(bank[:5000], bank, np.arange(5000))
    assert process_time() - began < 20
    for k in range(0, 5000, 500):
        d = ((bank - bank[k]) ** 2).sum(1)
        d[k] = np.inf
        assert at[k].tolist() == np.argsort(d)[:2].tolist() and np.allclose(squares[k], np.sort(d)[:2])


def test_candidate_union(spark):
    grid = spark.createDataFrame([(0, "p", 0.0, 0.0, 1), (0, "q", 5.0, 0.0, 2)], "g int, id string, x double, y double, rank int")
    stems = spark.createDataFrame([(0, 0.3, 0.1, 0.5), (0, 9.0, 0.0, 0.4), (0, 9.4, 0.0, 0.9)], "g int, x double, y double, score double")
    got = [(r.id, r.x, r.grid_ids, r.stem_ids, r.score) for r in spatial.union_candidates(grid, stems, ["g"], x_reach=0.5, y_reach=0.5).orderBy("id").collect()]
    assert got == [("u001", 0.0, ["p"], ["stem001"], 0.5), ("u002", 5.0, ["q"], [], 0.0), ("u003", 9.2, [], ["stem002", "stem003"], 0.9)]


def brute_components(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for dx, dy in itertools.product((-1, 0, 1), repeat=2):
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        out.append(part)
    return out


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40))
def test_components_of_masks(cells):
    mask = np.zeros((10, 10), bool)
    for x, y in cells:
        mask[y, x] = True
    expected = sorted((min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p), len(p)) for p in brute_components(cells))
    assert sorted(rasters.components(mask)) == expected


def test_sweeps_of_a_selector(spark):
    rows = [(0, "a", 0.0, 0.0, 0.9, 1), (0, "b", 5.0, 0.0, 0.6, 2), (1, "c", 0.0, 0.0, 0.4, 1), (1, "d", 9.0, 0.0, 0.7, 2)]
    df = spark.createDataFrame(rows, "g int, id string, x double, y double, score double, rank int")
    truth = spark.createDataFrame([(0, "t", 0.1, 0.0), (0, "u", 5.0, 0.1), (1, "v", 0.0, 0.0)], "g int, id string, x double, y double")
    grid = spark.createDataFrame([(0.8,), (0.5,), (0.1,)], "threshold double")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.exact) for r in spatial.sweep_heads(df, grid, ["g"], truth, 1.0, x_radius=1.0, least=0, most=9).collect()}
    assert got == {0.8: (1, 0, 2, 0), 0.5: (2, 1, 1, 1), 0.1: (3, 1, 0, 1)}


DYAD = "g int, id string, x double, y double, left double, right double, score double, rank int, stem_x double, stem_score double, kept boolean"


def test_dyads_on_one_stem(spark):
    pair = [(0, "a", 3.0, 1.0, 2.6, 3.4, 0.5, 1, 3.4, 0.9, False), (0, "b", 3.1, 2.0, 2.7, 3.5, 0.5, 2, 3.4, 0.3, False)]
    dots = [(0, "p", 4.2, 1.1, 4.1, 4.3, -0.1, 3, None, 0.1, False), (0, "q", 4.3, 2.1, 4.2, 4.4, -0.1, 4, None, 0.1, False)]
    old = [(0, "m", 6.0, 9.0, 5.6, 6.4, 0.8, 5, None, 0.9, True), (0, "n", 9.0, 2.0, 8.6, 9.4, 0.8, 6, None, 0.2, True)]

    def decide(rows):
        r = spatial.dyads(spark.createDataFrame(rows, DYAD), ["g"], 1.0).first().decision
        return r.status, r.proposed

    assert decide(pair + dots + old) == ("accepted", ["a", "b"])
    assert decide(pair + old)[0] == "rejected_sparse_pair_cluster_count"
    assert decide(pair + dots + old[:1])[0] == "rejected_current_candidate_count"
    assert decide(pair + dots + [old[1], (*old[1][:2], 9.2, *old[1][3:])])[0] == "rejected_current_onset_group_count"
    strong = [old[0], (*old[1][:9], 0.9, True)]
    assert decide(pair + dots + strong)[0] == "rejected_strong_displaced_candidate"
    left = [(0, r[1], r[2] - 2.5, r[3], r[4] - 2.5, r[5] - 2.5, *r[6:8], r[8] and r[8] - 2.5, *r[9:]) for r in pair + dots]
    assert decide(left + old)[0] == "rejected_leading_edge_pair"
