"""Pictures: thresholds, spans, components, windows, staves, boxes and boundaries."""

from __future__ import annotations

import numpy as np
import pytest
from cadenza.operators import rasters as R
from pyspark.sql import functions as F


def page(width=300, height=200, staves=((40, 10), (120, 10))):
    picture = np.full((height, width), 255, np.uint8)
    for top, spacing in staves:
        for k in range(5):
            picture[top + k * spacing, 20 : width - 20] = 0
    return picture


def table(spark, **pictures):
    return spark.createDataFrame([(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in pictures.items()], "id string, width int, height int, pixels binary")


def test_thresholds_and_densities(spark):
    dark, light = np.full((10, 10), 100, np.uint8), np.full((10, 10), 255, np.uint8)
    rows = R.run_rasters(table(spark, dark=dark, light=light), "id", R.ink_threshold, "int", "t")
    assert {r.id: r.t for r in rows.collect()} == {"dark": 150, "light": 220}
    half = np.r_[np.full(50, 60), np.full(50, 200)].astype(np.uint8).reshape(10, 10)
    assert 80 <= R.otsu(half) < 200 and R.otsu(np.zeros((0, 0), np.uint8)) == 127
    rng = np.random.default_rng(0)
    noisy = rng.integers(0, 256, (20, 20)).astype(np.uint8)

    def brute(picture):
        values, best, where = picture.ravel().astype(int), -1.0, 127
        for t in range(256):
            a, b = values[values <= t], values[values > t]
            if len(a) and len(b) and (v := len(a) * len(b) * (a.mean() - b.mean()) ** 2) > best + 1e-6:
                best, where = v, t
        return min(235, max(80, where))

    assert R.otsu(noisy) == brute(noisy)
    assert R.row_density(page())[40] > 0.8 and R.row_density(page())[41] == 0


def test_spans_and_averages():
    rng = np.random.default_rng(1)
    v = rng.random(50)
    assert np.allclose(R.moving_average(v, 5), [v[max(0, k - 2) : k + 3].mean() for k in range(50)])
    on = np.array([0, 1, 1, 0, 1, 0, 0, 0, 1, 1, 1], float)
    assert R.active_spans(on, 0.5, 1, 2) == [(1, 4), (8, 10)] and R.active_spans(on, 0.5, 2, 0) == [(1, 2), (8, 10)] and R.active_spans(on, 2.0, 1, 1) == []
    assert R.span_peak(on, 1, 4) == (1.0, 2) and R.span_peak(np.zeros(9), 2, 5) == (0.0, 3)


def test_bounds_skew_and_ink():
    p = page(600, 200)
    left, right = R.horizontal_bounds(p, 40, 81)
    assert 0 <= left <= 20 and 560 <= right <= 600
    assert R.horizontal_bounds(np.full((50, 300), 255, np.uint8), 0, 50) == (0, 300)
    assert R.skew(p) == 0.0 and abs(R.skew(R.rotated(p, 2.0)) + 2.0) <= 0.5
    faded = np.r_[np.full(990, 240), np.full(10, 120)].astype(np.uint8).reshape(20, 50)
    out = R.darkened(faded)
    assert out.max() == 255 and out.min() < 40


def test_staves_of_a_page():
    found = R.system_staffs(page())
    assert [(top, bottom) for top, bottom, _ in found] == [(40, 80), (120, 160)] and found[0][2] == [40, 50, 60, 70, 80]
    assert R.system_staffs(np.full((100, 100), 255, np.uint8)) == []


def test_components_and_merging():
    mask = np.zeros((12, 12), bool)
    mask[1:3, 1:3] = mask[3, 3] = mask[8:11, 8] = True
    assert R.components(mask) == [(1, 1, 3, 3, 5), (8, 8, 8, 10, 3)]
    close = [(0, 0, 4, 4, 20), (6, 0, 9, 4, 15), (40, 0, 44, 4, 20)]
    assert R.merged_components(close, 10.0) == [(0, 0, 9, 4, 35), (40, 0, 44, 4, 20)]
    stem = [(0, 0, 4, 4, 20), (5, 0, 6, 30, 60)]
    assert R.merged_components(stem, 10.0) == stem
    staff = np.zeros((20, 20), bool)
    staff[10] = True
    staff[4:7, 4:7] = True
    assert R.without_staff(staff, [10], 10.0).sum() == 9


def test_windows_strokes_and_closing():
    mask = np.zeros((60, 60), bool)
    y, x = np.mgrid[:60, :60]
    mask[((x - 20) / 6) ** 2 + ((y - 30) / 5) ** 2 <= 1] = True
    on, off = (R.score_window(mask, cx, 30, 13, 11, 10.0) for cx in (20, 45))
    assert on["score"] > 0.7 > off["score"] == 0.0 and on["ink_count"] > 80
    line = np.zeros((60, 60), bool)
    line[30] = True
    assert R.score_window(line, 30, 30, 13, 11, 10.0)["score"] < 0.3
    stroke = np.zeros((60, 60), bool)
    stroke[10:50, 20] = stroke[30, 30:40] = True
    kept = R.vertical_strokes(stroke, 10.0)
    assert kept[30, 20] and not kept[30, 30:40].any()
    gap = np.ones((7, 7), bool)
    gap[3, 3] = False
    assert R.closed(gap).all() and not R.closed(np.zeros((4, 4), bool)).any()


def test_patches(spark):
    a, b = np.zeros((3, 3)), np.zeros((3, 3))
    a[1, 1] = b[1, 2] = 1.0
    assert R.shift_distance(a, b, 0) == pytest.approx(2 / 9) and R.shift_distance(a, b, 1) == 0.0
    patches = spark.createDataFrame([(1, a.ravel().tolist())], "id int, vector array<double>")
    samples = spark.createDataFrame([("p", b.ravel().tolist(), 1), ("n", np.ones(9).tolist(), 0)], "sample string, vector array<double>, label int")
    got = {r["sample"]: (r.label, round(r.distance, 6)) for r in R.patch_distances(patches, samples, "id", 3).collect()}
    assert got == {"p": (1, 0.0), "n": (0, round(8 / 9, 6))}
    with pytest.raises(ValueError):
        R.patch_distances(patches, samples, "id", 3, most_bytes=10)


def test_pgm(spark, tmp_path):
    p = page(30, 20, ((2, 3),))
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made here\n30 20\n255\n" + p.tobytes())
    rows = R.pgm_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.width, r.height, bytes(r.pixels)) for r in rows] == [(30, 20, p.tobytes())]
    with pytest.raises(ValueError):
        R.from_pgm(b"P6\n1 1\n255\nabc")


def test_boundaries(spark):
    cases = {"plain": [0.5], "edges": [0.02, 0.06, 0.5, 0.95, 0.99], "twice": [0.3, 0.3000001, 0.7], "outside": [-0.2, 0.4, 1.3], "none": []}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "k string, b array<double>")
    got = {r.k: (r.e, r.n) for r in df.select("k", R.measure_edges(F.col("b")).alias("e"), R.measure_count(F.col("b")).alias("n")).collect()}
    assert got == {"plain": ([0.0, 0.5, 1.0], 2), "edges": ([0.06, 0.5, 0.95], 2), "twice": ([0.0, 0.3, 0.7, 1.0], 3), "outside": ([0.0, 0.4, 1.0], 2), "none": ([0.0, 1.0], 1)}
    at = lambda x, *e: R.measure_of(F.lit(x), F.array(*map(F.lit, e)))
    assert spark.range(1).select(at(0.1, 0.0, 0.5, 1.0).alias("a"), at(0.5, 0.0, 0.5, 1.0).alias("b"), at(1.0, 0.0, 0.5, 1.0).alias("c"), at(0.3, 0.0).alias("d")).first() == (1, 2, 2, 1)


def test_bands(spark):
    systems = spark.createDataFrame([("p", 1, (100, 200, 900, 300), 1000, 1400), ("p", 2, (100, 420, 900, 520), 1000, 1400)], f"page string, n int, box {R.BOX}, width int, height int")
    rows = {r.n: r for r in R.system_bands(systems, "page", "n").collect()}
    assert tuple(rows[1].crop) == (88, 182, 912, 324)
    assert tuple(rows[1].above) == (88, 128, 912, 247) and tuple(rows[2].below) == (88, 473, 912, 592)
    assert tuple(rows[1].below) == (88, 253, 912, 372) and tuple(rows[2].above) == (88, 348, 912, 467)
    accepted = spark.createDataFrame([("p", 1, True, 0.2, None), ("p", 2, True, 0.0, None), ("q", 1, True, 0.0, None)], "page string, n int, accepted boolean, ink double, reason string")
    assert {(r.page, r.n): (r.accepted, r.reason) for r in R.without_blank_tail(accepted, "page", "n", "ink", 0.1).collect()} == {("p", 1): (True, None), ("p", 2): (False, "insufficient_musical_ink"), ("q", 1): (True, None)}
    boxes = spark.createDataFrame([("p", 1, 10, 20, 99), ("p", 2, 40, 60, 99)], "page string, n int, top int, bottom int, height int")
    assert [(r.previous_bottom, r.next_top) for r in R.neighbour_bounds(boxes, "page", "n").orderBy("n").collect()] == [(0, 40), (20, 99)]


def test_barlines_and_collages(spark):
    p = page(400, 120, ((40, 10),))
    for x in (100, 250, 253):
        p[40:81, x] = 0
    p[55:60, 300] = 0
    assert [round(x * 400) for x in R.barlines(p, 40, 80)] in ([100, 250], [99, 249], [100, 251], [99, 251], [101, 250])
    a, b = np.zeros((2, 3), np.uint8), np.ones((1, 5), np.uint8)
    whole = R.collage([a, b], 2)
    assert whole.shape == (5, 5) and whole[0, 3] == 255 and whole[2:4].min() == 255 and whole[4].tolist() == [1] * 5
    rows = [("p", 2, 5, 1, bytearray(b.tobytes())), ("p", 1, 3, 2, bytearray(a.tobytes()))]
    df = spark.createDataFrame(rows, "page string, n int, width int, height int, pixels binary")
    assert bytes(R.page_collages(df, "page", "n", 2).first().pixels) == whole.tobytes()


def test_staff_rows_bands_and_tracking():
    p = page(300, 120, ((40, 10),))
    assert R.staff_rows(R.row_density(p)) == [40, 50, 60, 70, 80] and R.staff_band(p) == (36, 84)
    assert R.staff_rows(np.zeros(9)) == [] and R.staff_band(np.full((30, 30), 255, np.uint8)) == (0, 8)
    bent = np.full((120, 300), 255, np.uint8)
    for x in range(300):
        bent[[40 + k * 10 + (2 if x >= 150 else 0) for k in range(5)], x] = 0
    path = R.track_staff(bent, [40, 50, 60, 70, 80], 10.0)
    assert len(path) == 300 and abs(path[20]) <= 1 and 1 <= path[280] <= 3
    brute = [[sum(bool((bent[max(0, round(line + s) - 1) : round(line + s) + 2, c] <= R.ink_threshold(bent)).any()) for line in (40, 50, 60, 70, 80) for c in range(max(0, x - 3), min(300, x + 4))) for s in range(-3, 4)] for x in (0, 7, 149, 299)]
    assert R.shift_support(bent, [40, 50, 60, 70, 80], 3)[[0, 7, 149, 299]].tolist() == brute


def test_boundary_clean_up():
    p = page(400, 120, ((40, 10),))
    p[20:81, 24] = 0  # a stem that rises over the staff
    p[55:59, 2:10] = p[55:59, 200:230] = 0
    assert R.without_stems(p, [24 / 400, 0.5]) == [0.5]
    short = page(400, 120, ((40, 10),))
    short[40:81, 24] = 0
    assert R.without_stems(short, [24 / 400, 0.5]) == [24 / 400, 0.5]
    end = page(400, 120, ((40, 10),))
    end[40:81, 372:381] = 0
    end[25:81, 355] = 0
    assert R.without_stems(end, [0.5, 355 / 400, 376 / 400]) == [0.5, 376 / 400]
    assert R.without_stems(np.full((50, 50), 255, np.uint8), [0.1]) == [0.1]
    music = page(400, 120, ((40, 10),))
    music[53:58, 60:120] = 0
    assert R.without_blank_ends(music, [0.0, 0.5, 1.0]) == [0.0, 0.5]
    music[63:68, 300:340] = 0
    assert R.without_blank_ends(music, [0.0, 0.5, 1.0]) == [0.0, 0.5, 1.0]
