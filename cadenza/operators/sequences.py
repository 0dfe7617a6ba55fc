"""Folds and dynamic programs over short ordered lists: clusters of three kinds, runs, traces of edits, meter fitting, alignments.

A list is one row: `gathered` puts a group's rows into an array in order. Folds are column expressions; programs with
back-tracking run on the arrays in Arrow batches. Lists are measures, systems or pieces, so a row is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def gathered(df: DataFrame, by: list[str], order: list[str], out: str = "items") -> DataFrame:
    """One row a group: its other columns as an array of structs, in order."""
    rest = [c for c in df.columns if c not in (*by, *order)]
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(out))


def mapped(df: DataFrame, column: str, run: Callable[[object], object], kind: str, out: str) -> DataFrame:
    """A column computed in Python from another one, null from null, in Arrow batches."""

    def apply(batches):
        for batch in batches:
            made = [None if x is None else run(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, result)], names=[*batch.schema.names, out])

    empty = df.sparkSession.createDataFrame([], f"x {kind}")
    result = empty.toArrow().schema.field(0).type
    return df.mapInArrow(apply, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` {kind}")


def mean_clusters(values: Column, tolerance: float) -> Column:
    """Ascending values as clusters (center, members): a value joins the last cluster if it is within the tolerance of its mean, rounded to three places."""
    one = lambda v: F.struct(F.round(v, 3).alias("center"), F.array(v).alias("members"))

    def step(found: Column, v: Column) -> Column:
        last = F.element_at(found, -1)
        members = F.concat(last["members"], F.array(v))
        mean = F.round(F.aggregate(members, F.lit(0.0), lambda s, x: s + x) / F.size(members), 3)
        joins = F.abs(v - last["center"]) <= tolerance
        return F.when(F.size(found) == 0, F.array(one(v))).when(joins, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(mean.alias("center"), members.alias("members"))))).otherwise(F.concat(found, F.array(one(v))))

    return F.aggregate(values, F.array().cast("array<struct<center:double,members:array<double>>>"), step)


def anchored_clusters(values: Column, tolerance: float) -> Column:
    """The number from 0 of each ascending value's cluster: a new one starts where a value is more than the tolerance past its cluster's first."""
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, v: Column) -> Column:
        new = state["first"].isNull() | (v - state["first"] > tolerance)
        n = state["n"] + new.cast("int")
        return F.struct(F.when(new, v).otherwise(state["first"]).alias("first"), n.alias("n"), F.concat(state["out"], F.array(n)).alias("out"))

    return F.aggregate(values, zero, step, lambda s: s["out"])


def anchored_groups(df: DataFrame, by: list[str], at: str, pitch: str, score: str, rank: str, key: str, tolerance: float, most: int) -> DataFrame:
    """(by, cluster, key): points in anchored clusters on `at`; of each cluster and pitch the best by score, then lower rank, then greater key; of these the `most` best."""
    from pyspark.sql import Window as W

    order = [at, key]
    rows = gathered(df.select(*by, F.col(at).cast("double").alias(at), key, pitch, score, rank), by, order)
    numbers = anchored_clusters(F.transform("items", lambda i: i[at]), tolerance)
    flat = rows.select(*by, F.explode(F.arrays_zip("items", numbers.alias("cluster"))).alias("z")).select(*by, "z.cluster", "z.items.*")
    best = flat.withColumn("__k", F.row_number().over(W.partitionBy(*by, "cluster", pitch).orderBy(F.desc(score), rank, F.desc(key)))).where("__k = 1")
    return best.withColumn("__k", F.row_number().over(W.partitionBy(*by, "cluster").orderBy(F.desc(score), rank, key))).where(F.col("__k") <= most).drop("__k")


def longest_gapped_run(present: Column, max_gap: int) -> Column:
    """(length, start, end) of the longest run of positions where an array holds true, gaps of at most `max_gap` included, the first of equals; nulls without one."""
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("k"), none.alias("start"), none.alias("last"), F.struct(F.lit(0).alias("length"), none.alias("start"), none.alias("end")).alias("best"))

    def better(best: Column, start: Column, last: Column) -> Column:
        return F.when(start.isNotNull() & (last - start + 1 > best["length"]), F.struct((last - start + 1).alias("length"), start.alias("start"), last.alias("end"))).otherwise(best)

    def step(s: Column, here: Column) -> Column:
        on = F.coalesce(here, F.lit(False))
        breaks = s["last"].isNotNull() & (s["k"] - s["last"] - on.cast("int") > max_gap)
        start = F.when(breaks, none).otherwise(s["start"])
        best = F.when(breaks, better(s["best"], s["start"], s["last"])).otherwise(s["best"])
        return F.struct((s["k"] + 1).alias("k"), F.when(on, F.coalesce(start, s["k"])).otherwise(start).alias("start"), F.when(on, s["k"]).when(breaks, none).otherwise(s["last"]).alias("last"), best.alias("best"))

    return F.aggregate(present, zero, step, lambda s: better(s["best"], s["start"], s["last"]))


def trace(a: Sequence, b: Sequence) -> list[tuple[str, int | None, int | None]]:
    """Least edits of a prediction a and a truth b as (kind, place in a, place in b): exact, substitution, insertion (a alone) or deletion (b alone); of equal costs in that order, from the end."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), int)
    cost[:, 0], cost[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("exact" if a[i] == b[j] else "substitution", i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(("insertion", i, None))
        else:
            j -= 1
            out.append(("deletion", None, j))
    return out[::-1]


EDITS = "array<struct<kind:string,a:int,b:int>>"


def edits(df: DataFrame, a: str, b: str, out: str = "edits") -> DataFrame:
    """Rows with the least edits from one array of tokens to the other."""
    pairs = df.withColumn("__pair", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("a"), F.col(b).alias("b"))))
    return mapped(pairs, "__pair", lambda p: [{"kind": k, "a": i, "b": j} for k, i, j in trace(p["a"], p["b"])], EDITS, out).drop("__pair")


def edit_counts(column: str = "edits") -> list[Column]:
    """Counts of each kind of edit, and the distance."""
    count = lambda kind: F.size(F.filter(column, lambda e: e["kind"] == kind)).cast("long")
    kinds = [count(k).alias(k) for k in ("exact", "substitution", "insertion", "deletion")]
    return [*kinds, (F.size(column).cast("long") - count("exact")).alias("distance")]


NOTE_LENGTHS, REST_LENGTHS, EDIT_PENALTY = (0.5, 1.0, 1.5, 2.0), (0.5, 1.0, 1.5), 0.75


def decode_meter(symbols: Sequence[dict], expected: float, pickup: bool, penalty: float = EDIT_PENALTY) -> tuple[list[float], str]:
    """Durations of a measure's symbols (kind, duration, costs) on a half-beat grid that sum to the expected beats at least cost, and what was done.

    A duration costs what the symbol says of it (1 if nothing), and `penalty` if it isn't the one seen; of equal costs the lesser durations, first symbol first."""
    seen = [float(s["duration"]) for s in symbols]
    if abs(sum(seen) - expected) <= 1e-9 * max(abs(sum(seen)), abs(expected)):
        return seen, "already_meter_complete"
    if pickup and sum(seen) <= expected:
        return seen, "pickup_preserved"
    target, states = round(expected * 2), {0: (0.0, ())}
    for s, own in zip(symbols, seen, strict=True):
        costs, found = {float(k): float(v) for k, v in (s.get("costs") or {}).items()}, {}
        for total, (cost, chosen) in states.items():
            for length in REST_LENGTHS if s["kind"] == "rest" else NOTE_LENGTHS:
                if (at := total + round(length * 2)) <= target:
                    option = (cost + costs.get(length, 1.0) + (0.0 if abs(length - own) < 1e-9 else penalty), (*chosen, length))
                    found[at] = min(found.get(at, option), option)
        states = found
    if target not in states:
        return seen, "unresolved_visual_total"
    chosen = list(states[target][1])
    return chosen, "meter_repaired" if any(abs(a - b) > 1e-9 for a, b in zip(chosen, seen, strict=True)) else "meter_confirmed"


def fit_meter(df: DataFrame, symbols: str, expected: str, pickup: str, out: str = "fit") -> DataFrame:
    """Rows with (durations, onsets, status) for an array of symbols (kind, duration, costs: map from a duration as text to its cost)."""
    given = df.withColumn("__given", F.struct(F.transform(symbols, lambda s: F.struct(s["kind"].alias("kind"), s["duration"].alias("duration"), F.map_entries(s["costs"]).alias("costs"))).alias("s"), F.col(expected).cast("double").alias("e"), F.col(pickup).alias("p")))

    def run(x):
        lengths, status = decode_meter([{**s, "costs": {c["key"]: c["value"] for c in s["costs"] or ()}} for s in x["s"] or ()], x["e"], bool(x["p"]))
        return {"durations": lengths, "onsets": np.cumsum([0.0, *lengths])[:-1].tolist(), "status": status}

    return mapped(given, "__given", run, "struct<durations:array<double>,onsets:array<double>,status:string>", out).drop("__given")


def rising(wanted: Sequence, kinds: Sequence, scores: Sequence[float]) -> tuple[int, list[tuple[int, int]]]:
    """Pairs (place in wanted, place in kinds) of equal values that rise in both, as many as possible, then with the greatest sum of scores, then the least places."""
    n, m = len(wanted), len(kinds)
    best: list[list[tuple]] = [[(0, 0.0, ())] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            options = [best[i + 1][j], best[i][j + 1]]
            if wanted[i] == kinds[j]:
                count, score, pairs = best[i + 1][j + 1]
                options.append((count + 1, score + scores[j], ((i, j), *pairs)))
            best[i][j] = min(options, key=lambda o: (-o[0], -o[1], o[2]))
    return best[0][0][0], list(best[0][0][2])


def full_rising(wanted: Sequence, kinds: Sequence, scores: Sequence[float]) -> list[int] | None:
    """Rising places of all wanted values with the greatest sum of scores, then the greatest places; None if there are none."""
    paths: dict[int, tuple[float, tuple[int, ...]]] = {-1: (0.0, ())}
    for value in wanted:
        found, best = {}, None
        for j in range(len(kinds)):
            if j - 1 in paths:
                best = max(best or paths[j - 1], paths[j - 1])
            if best is not None and kinds[j] == value:
                found[j] = (best[0] + scores[j], (*best[1], j))
        if not found:
            return None
        paths = found
    return list(max(paths.values())[1])


def align_pitches(df: DataFrame, wanted: str, candidates: str, out: str = "proposal") -> DataFrame:
    """Rows with a proposal (status, pairs, confidence) from expected pitches and candidates (array of structs pitch, score, in order of x): a full
    alignment if there is one (confidence: its mean score within 0 and 1, 1 if nothing is expected), else the best partial one."""
    given = df.withColumn("__given", F.struct(F.col(wanted).alias("w"), F.transform(candidates, lambda c: F.struct(c["pitch"].alias("pitch"), c["score"].cast("double").alias("score"))).alias("c")))

    def run(x):
        want, kinds, scores = x["w"] or [], [c["pitch"] for c in x["c"] or ()], [c["score"] or 0.0 for c in x["c"] or ()]
        if not want:
            return {"status": "available", "pairs": [], "confidence": 1.0}
        if (full := full_rising(want, kinds, scores)) is not None:
            return {"status": "available", "pairs": [{"expected": i, "candidate": j} for i, j in enumerate(full)], "confidence": round(max(0.0, min(1.0, sum(scores[j] for j in full) / len(full))), 6)}
        count, pairs = rising(want, kinds, scores)
        return {"status": "partial", "pairs": [{"expected": i, "candidate": j} for i, j in pairs], "confidence": round(sum(scores[j] for _, j in pairs) / count, 6) if count else None}

    return mapped(given, "__given", run, "struct<status:string,pairs:array<struct<expected:int,candidate:int>>,confidence:double>", out).drop("__given")


def group_cost(pitches: Sequence[int], picked: Sequence[dict], position: float, width: float, spacing: float) -> float:
    """What it costs to take candidates (pitch, score, x) for a chord's pitches: pitch errors, missing evidence, place in the picture, spread on x."""
    order = sorted(picked, key=lambda c: (c["pitch"], str(c["id"])))
    pitch = sum(min(abs(p - c["pitch"]), 12) / 3 for p, c in zip(pitches, order, strict=True)) / max(1, len(pitches))
    xs = [c["x"] for c in picked]
    return pitch + 0.7 * sum(1 - c["score"] for c in picked) / len(picked) + 0.18 * abs(sum(xs) / len(xs) / max(1.0, width) - position) + 0.25 * (max(xs) - min(xs)) / max(1.0, spacing)


MISSING, SKIPPED, CHORD_TOLERANCE = 8.0, 0.002, 0.6


def align_groups(groups: Sequence[Sequence[int]], candidates: Sequence[dict], width: float, spacing: float, tolerance: float = CHORD_TOLERANCE) -> tuple[float, list[list[str]]]:
    """Cost and, for each onset group of pitches in order, the ids of the candidates (id, x, y, pitch, score) taken for it, left to right; none if it is missing.

    A skipped candidate costs a little, a missing pitch much; a chord's candidates lie within `tolerance` spacings of its first."""
    items = sorted(candidates, key=lambda c: (c["x"], c["y"], str(c["id"])))
    reach, n, m = max(1.0, spacing * tolerance), len(groups), len(items)
    best: list[list[tuple[float, tuple]]] = [[(0.0, ())] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m, -1, -1):
            size = len(groups[i])
            rest = best[i + 1][j]
            options = [(rest[0] + MISSING * size, ((), *rest[1]))]
            if j < m:
                options.append((best[i][j + 1][0] + SKIPPED, best[i][j + 1][1]))
                tail = [k for k in range(j + 1, m) if items[k]["x"] - items[j]["x"] <= reach]
                for more in combinations(tail, size - 1):
                    at = (j, *more)
                    after = best[i + 1][at[-1] + 1]
                    cost = group_cost(sorted(groups[i]), [items[k] for k in at], (i + 1) / (n + 1), width, spacing)
                    options.append((cost + after[0], (tuple(str(items[k]["id"]) for k in at), *after[1])))
            best[i][j] = min(options, key=lambda o: (round(o[0], 12), o[1]))
    return best[0][0][0], [list(x) for x in best[0][0][1]]


def align_onsets(df: DataFrame, groups: str, candidates: str, width: str, spacing: str, out: str = "alignment") -> DataFrame:
    """Rows with (total_cost, aligned_groups, ids of each group) for arrays of onset groups (arrays of pitches) and candidates."""
    given = df.withColumn("__given", F.struct(F.col(groups).alias("g"), F.col(candidates).alias("c"), F.col(width).cast("double").alias("w"), F.col(spacing).cast("double").alias("s")))

    def run(x):
        cost, ids = align_groups(x["g"] or [], x["c"] or [], x["w"], x["s"])
        return {"total_cost": round(cost, 9), "aligned_groups": sum(map(bool, ids)), "ids": ids}

    return mapped(given, "__given", run, "struct<total_cost:double,aligned_groups:int,ids:array<array<string>>>", out).drop("__given")


def five_lines(rows: Sequence[float], spacing: tuple[float, float] = (6.0, 80.0), most: float = 0.25) -> list[float] | None:
    """The five of these heights whose greatest deviation from their mean step is the least share of it, first of equals; None if
    no five have a mean step within `spacing` and a share of at most `most`."""
    best = None
    for some in combinations(sorted(rows), 5):
        mean = (some[4] - some[0]) / 4
        if spacing[0] <= mean <= spacing[1]:
            off = max(abs(b - a - mean) for a, b in zip(some, some[1:], strict=False)) / mean
            if off <= most and (best is None or off < best[0]):
                best = off, list(some)
    return best and best[1]


def staff_lines(df: DataFrame, rows: str, out: str = "lines") -> DataFrame:
    return mapped(df, rows, lambda x: five_lines([float(v) for v in x]), "array<double>", out)


def distinct_staves(staves: Sequence[dict], gap: float = 1.5, least: float = 12.0) -> list[int]:
    """Places, from top to bottom, of as many staves (top, bottom, spacing, deviation, support) as can stand apart, of these with the
    least sum of deviations, then the greatest sum of supports. Two staves are apart by `gap` of the lesser spacing, and `least`."""
    order = sorted(range(len(staves)), key=lambda k: (staves[k]["bottom"], staves[k]["deviation"], -staves[k]["support"], k))
    ending: list[tuple[int, float, float, tuple[int, ...]]] = []
    for k in order:
        own, found = staves[k], (0, 0.0, 0.0, ())
        for before in ending:
            last = staves[before[3][-1]]
            if own["top"] - last["bottom"] >= max(least, round(min(own["spacing"], last["spacing"]) * gap)) and before[:3] > found[:3]:
                found = before
        ending.append((found[0] + 1, found[1] - own["deviation"], found[2] + own["support"], (*found[3], k)))
    return list(max(ending, key=lambda e: e[:3])[3]) if ending else []


def chosen_staves(df: DataFrame, staves: str, out: str = "chosen") -> DataFrame:
    """Rows with the places of the staves (array of structs) that are chosen."""
    return mapped(df, staves, distinct_staves, "array<int>", out)


def track_shift(support: Sequence[Sequence[float]], penalty: float = 1.8, pull: float = 0.04) -> list[int]:
    """The path of shifts, around 0, that gathers most support[step][shift], less `penalty` for each unit of change and `pull` for each unit from 0."""
    support = np.asarray(support, float)
    if not support.size:
        return []
    shifts = np.arange(support.shape[1]) - support.shape[1] // 2
    apart = penalty * np.abs(shifts[:, None] - shifts[None])
    total, back = support[0], []
    for row in support[1:]:
        every = total[:, None] - apart
        back.append(every.argmax(0))
        total = every.max(0) - pull * np.abs(shifts) + row
    path = [int(total.argmax())]
    for came in back[::-1]:
        path.append(int(came[path[-1]]))
    return [int(shifts[k]) for k in path[::-1]]


def tracked(df: DataFrame, support: str, out: str = "shifts") -> DataFrame:
    return mapped(df, support, track_shift, "array<int>", out)


def rhythm_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of predicted and true rhythms (arrays of structs kind, onset, duration, heads, in order): durations of note groups place by place, rests as
    sets (1 where there are none to find), and whether the whole rhythm is exact."""
    notes = lambda c: F.filter(c, lambda t: t["kind"] == "note")
    rests = lambda c: F.array_distinct(F.transform(F.filter(c, lambda t: t["kind"] == "rest"), lambda t: F.struct(F.round(t["onset"], 4).alias("o"), F.round(t["duration"], 4).alias("d"))))
    size = lambda x: F.size(x).cast("long")
    right = size(F.filter(F.zip_with(notes("predicted"), notes("truth"), lambda a, b: F.round(a["duration"], 4) == F.round(b["duration"], 4)), lambda x: x))
    p, t = rests("predicted"), rests("truth")
    out = rows.select(
        *by, right.alias("duration_correct"), F.greatest(size(notes("predicted")), size(notes("truth"))).alias("duration_total"), size(notes("predicted")).alias("predicted_groups"), size(notes("truth")).alias("truth_groups"),
        size(F.array_intersect(p, t)).alias("rest_tp"), size(F.array_except(p, t)).alias("rest_fp"), size(F.array_except(t, p)).alias("rest_fn"), F.col("predicted").eqNullSafe(F.col("truth")).alias("exact_rhythm"),
    )
    return out.withColumn("overproduced", F.col("predicted_groups") > F.col("truth_groups"))


def rhythm_summary(report: DataFrame) -> DataFrame:
    """One row: sums of a rhythm report, duration accuracy, and rest precision, recall and F1, which are 1 where nothing was missed or added."""
    s = report.agg(F.count("*").alias("measures"), *(F.sum(c).alias(c) for c in ("duration_correct", "duration_total", "predicted_groups", "truth_groups", "rest_tp", "rest_fp", "rest_fn")), F.count(F.when(F.col("overproduced"), 1)).alias("overproduced"), F.count(F.when(F.col("exact_rhythm"), 1)).alias("exact"))
    tp, fp, fn = F.col("rest_tp"), F.col("rest_fp"), F.col("rest_fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise((fn == 0).cast("double"))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise((fp == 0).cast("double"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return s.select("*", F.round(C.safe_ratio(F.col("duration_correct"), F.col("duration_total")), 6).alias("duration_accuracy"), F.round(precision, 6).alias("rest_precision"), F.round(recall, 6).alias("rest_recall"), F.round(f1, 6).alias("rest_f1"))


LEADING_REST, LEADING_GAP = 0.5, 3.0


def compose(heads: Sequence[dict], rests: Sequence[dict], expected: float | None, pickup: bool) -> dict:
    """A measure's events from repaired heads (id, group, x, pitch, duration, costs; x in staff spaces) and seen rests (x, duration, costs): groups in order of x with the first head's
    duration, rests between them; half a beat of silence goes first if just that is missing and there is room; then the meter is fitted, with rests added at the end if that can't be.

    (status, notes: id, pitch, onset, duration; rests: onset, duration). Without a meter nothing is timed."""
    if expected is None:
        return {"status": "missing_expected_meter", "notes": [{"id": h["id"], "pitch": h["pitch"], "onset": None, "duration": None} for h in heads], "rests": []}
    groups: dict[int, list[dict]] = {}
    for h in sorted(heads, key=lambda h: (h["group"], h["x"], str(h["id"]))):
        groups.setdefault(h["group"], []).append(h)
    symbols = [{"kind": "note", "x": sum(h["x"] for h in g) / len(g), "duration": g[0]["duration"], "costs": g[0].get("costs"), "heads": g} for g in groups.values()]
    extent = sum(s["duration"] for s in symbols)
    silent = [{"kind": "rest", **r} for r in rests]
    if not pickup and symbols and abs(expected - extent - LEADING_REST) < 1e-9 and min(h["x"] for h in heads) >= LEADING_GAP:
        silent = [{"kind": "rest", "x": -1.0, "duration": LEADING_REST, "costs": {}}]
    symbols = sorted([*symbols, *silent], key=lambda s: s["x"])
    lengths, status = decode_meter(symbols, expected, pickup)
    if abs(sum(lengths) - expected) > 1e-9 and not (pickup and sum(lengths) <= expected):
        room = sum(3 if s["kind"] == "rest" else 4 for s in symbols)
        while room < round(expected * 2):
            symbols.append({"kind": "rest", "x": symbols[-1]["x"] + 1 if symbols else 0.0, "duration": 0.5, "costs": {0.5: 1.0, 1.0: 0.8, 1.5: 0.9}})
            room += 3
        lengths, fitted = decode_meter(symbols, expected, pickup)
        status = f"meter_fallback:{fitted}"
    out, at = {"status": status, "notes": [], "rests": []}, 0.0
    for s, length in zip(symbols, lengths, strict=True):
        if s["kind"] == "note":
            out["notes"] += [{"id": h["id"], "pitch": h["pitch"], "onset": at, "duration": length} for h in s["heads"]]
        else:
            out["rests"].append({"onset": at, "duration": length})
        at += length
    return out


def composed(df: DataFrame, heads: str, rests: str, expected: str, pickup: str, out: str = "events") -> DataFrame:
    """Rows with the events of `compose`; costs are maps from a duration as text."""
    given = df.withColumn("__given", F.struct(F.col(heads).alias("h"), F.col(rests).alias("r"), F.col(expected).cast("double").alias("e"), F.col(pickup).alias("p")))
    plain = lambda items: [{**i, "costs": {float(k): v for k, v in (i.get("costs") or ())}} for i in items or ()]
    kind = "struct<status:string,notes:array<struct<id:string,pitch:int,onset:double,duration:double>>,rests:array<struct<onset:double,duration:double>>>"
    return mapped(given, "__given", lambda x: compose(plain(x["h"]), plain(x["r"]), x["e"], bool(x["p"])), kind, out).drop("__given")
