"""Points on one or two axes: distance joins by grid cells, one-to-one matching, suppression, nearest neighbours.

Sequential rules run group by group in Python. A group is first split into chains, runs of points on the x axis whose
steps are within the rule's reach: what is further apart can't conflict or match, so chains are independent, and a
group with very many points is dealt over tasks wherever it has a gap. Rows of a group are taken by their key.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .grouped import map_groups
from .timeline import clusters


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def closest_pairs_on_line(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Greedy over all pairs within `most` on a line: the closest free pair first, ties by place in a, then in b.

    The closest pair of free points stands at neighbouring positions, so a heap of neighbours does in n log n steps what
    sorting all pairs would: a list of positions, each with its free places of a and of b in order, linked as they empty.
    """
    positions, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    held: list[tuple[list[int], list[int]]] = [([], []) for _ in positions]
    for k in range(len(a) - 1, -1, -1):
        held[at[k]][0].append(k)
    for k in range(len(b) - 1, -1, -1):
        held[at[len(a) + k]][1].append(k)
    after, before = list(range(1, len(positions) + 1)), list(range(-1, len(positions) - 1))
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(u: int, v: int) -> None:
        for p, q in ((u, v), (v, u)) if u != v else ((u, u),):
            if held[p][0] and held[q][1] and (d := abs(positions[p] - positions[q])) <= most:
                heappush(heap, (d, held[p][0][-1], held[q][1][-1], p, q))

    for k in range(len(positions)):
        offer(k, k)
        if k:
            offer(k - 1, k)
    out = []
    while heap:
        _, i, j, p, q = heappop(heap)
        if not held[p][0] or not held[q][1] or held[p][0][-1] != i or held[q][1][-1] != j:
            continue
        held[p][0].pop()
        held[q][1].pop()
        out.append((i, j))
        for k in {p, q}:
            if held[k][0] or held[k][1]:
                offer(k, k)
                if before[k] >= 0:
                    offer(before[k], k)
                if after[k] < len(positions):
                    offer(k, after[k])
            else:
                left, right = before[k], after[k]
                if left >= 0:
                    after[left] = right
                if right < len(positions):
                    before[right] = left
                if left >= 0 and right < len(positions):
                    offer(left, right)
    return out


def greedy(pairs: list[tuple]) -> list[tuple]:
    """Of (distance, i, j, ...) in ascending order those whose i and j are both free."""
    used_i, used_j, out = set(), set(), []
    heapify(pairs)
    while pairs:
        pair = heappop(pairs)
        if pair[1] not in used_i and pair[2] not in used_j:
            used_i.add(pair[1])
            used_j.add(pair[2])
            out.append(pair)
    return out


def closest_pairs(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """The same greedy rule for points (x, y) by Euclidean distance; only points within `most` on x are looked at."""
    order = np.argsort(b[:, 0], kind="stable")
    xs, pairs = b[order, 0], []
    for i, (x, y) in enumerate(a):
        for j in order[np.searchsorted(xs, x - most) : np.searchsorted(xs, x + most, "right")]:
            if (d := float(np.hypot(x - b[j, 0], y - b[j, 1]))) <= most:
                pairs.append((d, i, int(j)))
    return [(i, j) for _, i, j in greedy(pairs)]


def ellipse_pairs(points: np.ndarray, ellipses: np.ndarray) -> list[tuple[int, int]]:
    """The greedy rule by distance in radii, within ellipses (x, y, radius x, radius y)."""
    pairs = []
    for j, (x, y, rx, ry) in enumerate(ellipses):
        d = np.sqrt(((points[:, 0] - x) / rx) ** 2 + ((points[:, 1] - y) / ry) ** 2)
        pairs += [(float(d[i]), int(i), j) for i in np.flatnonzero(d <= 1)]
    return [(i, j) for _, i, j in greedy(pairs)]


def nearest_unused(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Each of a in its order takes the nearest free one of b within `most`, the first of equals."""
    order = np.argsort(b, kind="stable")
    free = [(float(b[j]), int(j)) for j in order]
    out = []
    for i, x in enumerate(a):
        k = bisect_left(free, (float(x), -1))
        best = None
        for at in (k, k - 1):
            while 0 <= at < len(free):
                d = abs(free[at][0] - x)
                if d > most or (best and d > best[0]):
                    break
                best = min(best or (d, free[at][1], at), (d, free[at][1], at))
                at += 1 if at >= k else -1
        if best:
            out.append((i, best[1]))
            del free[best[2]]
    return out


def sorted_unused(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """The same, with a taken by position."""
    order = np.argsort(a, kind="stable")
    return [(int(order[i]), j) for i, j in nearest_unused(a[order], b, most)]


def match(left: DataFrame, right: DataFrame, by: list[str], key: str, at: list[str], most: float, rule: Callable = closest_pairs_on_line, *, shape: list[str] | None = None, reach: float | None | str = "most", order: str | None = None) -> DataFrame:
    """Matched pairs of each group: (by, left_key, right_key, distance). `at` are the axes (one or two), `shape` further columns of
    the right side that the rule gets, `order` what the left side is taken by (else the key). Groups are cut into chains, runs of points of both sides whose steps on the first axis are at most
    the reach of the rule; with None they aren't."""
    side = lambda df, k, more: df.select(*by, key, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*at, *more])), F.lit(k).alias("__side"))
    both = side(left, 0, [order] if order else []).unionByName(side(right, 1, shape or []), allowMissingColumns=True)
    reach = most if reach == "most" else reach
    chain = F.lit(0).cast("long")
    both = both.withColumn("__chain", chain) if reach is None else clusters(both, by, F.col(at[0]), [at[0], "__side"], reach, "__chain", touching=True)

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict] | None:
        p, q = np.flatnonzero(g["__side"] == 0), np.flatnonzero(g["__side"] == 1)
        if not len(p) or not len(q):
            return None
        x, y = np.stack([g[c][p] for c in at], 1), np.stack([g[c][q] for c in (*at, *(shape or []))], 1)
        pairs = rule(x[:, 0], y[:, 0], most) if len(at) == 1 else rule(x, y, most) if shape is None else rule(x, y)
        if not pairs:
            return None
        i, j = (np.array([pair[k] for pair in pairs], int) for k in (0, 1))
        return p[i], {"right_key": q[j], "distance": np.sqrt(((x[i] - y[j][:, : len(at)]) ** 2).sum(1))}

    found = map_groups(both, [*by, "__chain"], ["__side", *([order] if order else []), key], run, [*by, key], "distance double", {"right_key": key})
    return found.select(*by, F.col(key).alias("left_key"), "right_key", "distance")


def match_ellipses(candidates: DataFrame, truths: DataFrame, by: list[str], key: str, margin: float = 1.0) -> DataFrame:
    """Candidates (x, y) inside the truths' ellipses (x, y, radius_x, radius_y, grown by `margin`), closest in radii first. Radii must be positive."""
    grown = truths.select(*by, key, "x", "y", (F.col("radius_x") * margin).alias("radius_x"), (F.col("radius_y") * margin).alias("radius_y"))
    return match(candidates, grown, by, key, ["x", "y"], 1.0, lambda a, b: ellipse_pairs(a, b), shape=["radius_x", "radius_y"], reach=None)


def match_report(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1, exact): agreement of each group that has rows on either side."""
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    rows = count(left, "n_left").join(count(right, "n_right"), by, "full").join(count(pairs, "tp"), by, "left").na.fill(0, ["n_left", "n_right", "tp"])
    rows = rows.select(*by, "tp", (F.col("n_left") - F.col("tp")).alias("fp"), (F.col("n_right") - F.col("tp")).alias("fn"))
    scores = C.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("*", *(c.alias(n) for c, n in zip(scores, ("precision", "recall", "f1"), strict=True)), (F.col("fn") == 0).alias("exact"))


def unmatched(rows: DataFrame, pairs: DataFrame, by: list[str], key: str, side: str) -> DataFrame:
    return rows.join(pairs.select(*by, F.col(f"{side}_key").alias(key)), [*by, key], "left_anti")


def within(left: DataFrame, right: DataFrame, by: list[str], key: str, most: float) -> DataFrame:
    """(by, left_key, right_key, distance): all pairs of points (x, y) at most `most` apart. Points meet in grid cells of that width: the left one
    stands in its own cell, the right one in the nine around it, so a pair meets once and a group is not paired with itself."""
    cell = lambda c: F.floor(F.col(c) / most)
    a = left.select(*by, F.col(key).alias("left_key"), F.col("x").alias("__x"), F.col("y").alias("__y"), cell("x").alias("__i"), cell("y").alias("__j"))
    near = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell(c) + d))
    b = right.select(*by, F.col(key).alias("right_key"), "x", "y", near("x").alias("__i")).withColumn("__j", near("y"))
    distance = F.hypot(F.col("__x") - F.col("x"), F.col("__y") - F.col("y"))
    return a.join(b, [*by, "__i", "__j"]).select(*by, "left_key", "right_key", distance.alias("distance")).where(F.col("distance") <= most)


def within_ellipses(points: DataFrame, ellipses: DataFrame, by: list[str], key: str, cell: float) -> DataFrame:
    """(by, left_key, right_key, distance in radii): points inside ellipses. An ellipse stands in every cell of width `cell` that its box covers."""
    at = lambda e: F.floor(e / cell)
    a = points.select(*by, F.col(key).alias("left_key"), F.col("x").alias("__x"), F.col("y").alias("__y"), at(F.col("x")).alias("__i"), at(F.col("y")).alias("__j"))
    spread = lambda c, r: F.explode(F.sequence(at(F.col(c) - F.col(r)), at(F.col(c) + F.col(r))))
    b = ellipses.select(*by, F.col(key).alias("right_key"), "x", "y", "radius_x", "radius_y", spread("x", "radius_x").alias("__i")).withColumn("__j", spread("y", "radius_y"))
    distance = C.ellipse_distance(F.col("__x") - F.col("x"), F.col("__y") - F.col("y"), F.col("radius_x"), F.col("radius_y"))
    return a.join(b, [*by, "__i", "__j"]).select(*by, "left_key", "right_key", distance.alias("distance")).where("distance <= 1")


def suppress(df: DataFrame, by: list[str], key: str, at: list[str], score: str, least: float, most: int | None = None) -> DataFrame:
    """Non-max suppression: by falling score (ties by key) a row is kept if no kept one is nearer than `least`; (by, key, place) of at most `most` a group."""
    rows = df.select(*by, key, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys(at)), F.col(score).alias("__score"))
    chain = clusters(rows, by, F.col(at[0]), [at[0], key], least, "__chain").withColumn("__down", -F.col("__score"))

    def run(g: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
        points, kept, line = np.stack([g[c] for c in at], 1), [], []
        for k, p in enumerate(points):
            lo, clash = bisect_left(line, (p[0] - least, -1)), False
            for x, j in line[lo:]:
                if x > p[0] + least:
                    break
                if (abs(x - p[0]) if len(at) == 1 else np.sqrt(((points[j] - p) ** 2).sum())) < least:
                    clash = True
                    break
            if not clash:
                kept.append(k)
                insort(line, (p[0], k))
        return np.array(kept, np.int64), {}

    kept = map_groups(chain, [*by, "__chain"], ["__down", key], run, [*by, key, "__score"]).withColumnRenamed("__score", score)
    placed = kept.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), key)))
    return placed.where(F.col("place") <= most if most else F.lit(True)).select(*by, key, "place")


def select_heads(df: DataFrame, by: list[str], *, threshold: float | str, x_radius: float, least: int, most: int, y_gap: float | None = None) -> DataFrame:
    """Candidates (by, id, x, y, score, rank; x and y in staff spaces) that a selector keeps, in the order it takes them (column place). A threshold may be a column of `by`.

    By falling score, then rank, then id: first those at the threshold or above, then, while fewer than `least`, others. A
    candidate conflicts with a kept one within `x_radius` on x, and, if `y_gap` is given, nearer than that on y. Without `y_gap`
    at most `most` are kept; with it at most `most` onset groups (runs on x with steps below `x_radius`), and heads of a group are free.
    """
    kinds = ", ".join(f"`{c}` {_kind(df, c)}" for c in by)

    def groups(xs: list[float]) -> int:
        xs = sorted(xs)
        return len(xs) and 1 + sum(b - a >= x_radius for a, b in zip(xs, xs[1:], strict=False))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "rank", "id"], ascending=[False, True, True]).reset_index(drop=True)
        x, y, kept = rows.x.to_numpy(float), rows.y.to_numpy(float), []

        def allowed(k: int) -> bool:
            near = [j for j in kept if abs(x[k] - x[j]) < x_radius]
            if any(y_gap is None or abs(y[k] - y[j]) < y_gap for j in near):
                return False
            return y_gap is None or bool(near) or groups([x[j] for j in kept]) < most

        least_score = rows[threshold].iloc[0] if isinstance(threshold, str) else threshold
        good = [k for k in range(len(rows)) if rows.score[k] >= least_score]
        for k in good:
            if y_gap is None and len(kept) >= most:
                break
            if allowed(k):
                kept.append(k)
        for k in range(len(rows)):
            if len(kept) >= min(least, most):
                break
            if k not in kept and allowed(k):
                kept.append(k)
        return rows.iloc[kept][[*by, "id"]].assign(place=range(1, len(kept) + 1))

    return df.select(*by, "id", "x", "y", "score", "rank").groupBy(*by).applyInPandas(run, f"{kinds}, id {_kind(df, 'id')}, place int")


def recover_heads(df: DataFrame, by: list[str], *, threshold: float, x_radius: float, gap: tuple[float, float], ratio: float) -> DataFrame:
    """At most one more head for each onset group of kept candidates (by, id, x, y, score, rank, kept): the best one within `x_radius` of
    the group whose distance on y from its nearest head is in `gap`, at the threshold and `ratio` of the group's best score or above, and
    that doesn't change the number of onset groups. (by, id, group from 1, y_gap, score_ratio)"""
    kinds = ", ".join(f"`{c}` {_kind(df, c)}" for c in by)

    def count(xs: list[float]) -> int:
        xs = sorted(xs)
        return len(xs) and 1 + sum(b - a >= x_radius for a, b in zip(xs, xs[1:], strict=False))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "rank", "id"], ascending=[False, True, True])
        base = rows[rows.kept].sort_values(["x", "y", "id"])
        groups, out = [], []
        for head in base.itertuples():
            if groups and head.x - groups[-1][-1].x < x_radius:
                groups[-1].append(head)
            else:
                groups.append([head])
        taken, xs, total = set(base.id), list(base.x), count(list(base.x))
        for number, group in enumerate(groups, 1):
            best = max(h.score for h in group)
            for c in rows.itertuples():
                if c.id in taken or not any(abs(c.x - h.x) < x_radius for h in group):
                    continue
                near = min(abs(c.y - h.y) for h in group)
                if gap[0] <= near <= gap[1] and c.score >= threshold and c.score >= best * ratio and count([*xs, c.x]) == total:
                    out.append((*(getattr(c, b) for b in by), c.id, number, near, c.score / best if best > 0 else None))
                    taken.add(c.id)
                    xs.append(c.x)
                    break
        return pd.DataFrame(out, columns=[*by, "id", "group", "y_gap", "score_ratio"])

    return df.select(*by, "id", "x", "y", "score", "rank", "kept").groupBy(*by).applyInPandas(run, f"{kinds}, id {_kind(df, 'id')}, group int, y_gap double, score_ratio double")


def local_maxima(df: DataFrame, by: list[str], at: str, score: str, radius: float, floor: float | None = None) -> DataFrame:
    """Rows whose score is the highest within `radius` on either side, the leftmost of equals within it, and at least `floor`."""
    groups = ", ".join(f"`{c}`" for c in by)
    best = F.expr(f"max(struct(`{score}` AS s, -`{at}` AS x)) OVER (PARTITION BY {groups} ORDER BY `{at}` RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)")
    kept = df.withColumn("__best", best).where((F.col("__best.s") == F.col(score)) & (F.col("__best.x") == -F.col(at))).drop("__best")
    return kept if floor is None else kept.where(F.col(score) >= floor)


def spaced_maxima(df: DataFrame, by: list[str], at: str, score: str, reach: int, least: float) -> DataFrame:
    """Rows that are no lower than any within `reach` rows on either side; from left to right, one nearer than `least` to the kept one before it
    replaces it if its score is higher, else it goes. (by, at, score)"""
    near = W.partitionBy(*by).orderBy(at).rowsBetween(-reach, reach)
    peaks = df.withColumn("__top", F.max(score).over(near)).where(F.col(score) == F.col("__top"))
    one = F.struct(F.col(at).alias("at"), F.col(score).alias("score"))
    grouped = peaks.groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("p"))
    kind = grouped.schema["p"].dataType.simpleString()

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (p["at"] - F.try_element_at(kept, F.lit(-1))["at"] >= least), F.concat(kept, F.array(p))).when(p["score"] > last["score"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(p))).otherwise(kept)

    kept = F.aggregate("p", F.array().cast(kind), step)
    return grouped.select(*by, F.explode(kept).alias("k")).select(*by, F.col("k.at").alias(at), F.col("k.score").alias(score))


#: Bytes of a bank of vectors that is broadcast at once; queries and vectors that are multiplied at once; pairs a task looks at.
BANK_BYTES, TILE, TASK_PAIRS = 64 << 20, (256, 1024), 1 << 28


def _two_nearest(queries: np.ndarray, bank: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places in the bank of each query's two nearest vectors but the one left out (-1: none), ties by place; missing ones are inf and -1.

    Products of 32-bit floats show which vectors could be among the two: those within a bound of the products' error. Only these are measured, in 64 bits, summed in the vectors' order."""
    width = bank.shape[1]
    middle = bank.mean(0)
    scale = max(float(np.abs(bank - middle).max()), float(np.abs(queries - middle).max(initial=0)), 1e-300)
    small, own = (bank - middle) / scale, (queries - middle) / scale
    norms, own_norms = (small**2).sum(1), (own**2).sum(1)
    right = np.ascontiguousarray(np.c_[small, norms].T, np.float32)
    left = np.c_[-2 * own, np.ones(len(own))].astype(np.float32)
    error = (width + 32) * 2.0**-22 * (np.sqrt(own_norms) + np.sqrt(norms.max())) ** 2
    best, at = np.full((len(queries), 2), np.inf), np.full((len(queries), 2), -1)
    for lo in range(0, len(queries), TILE[0]):
        part = slice(lo, lo + TILE[0])
        q, d, k, out = queries[part], best[part], at[part], left_out[part]
        every = np.arange(len(q))
        for start in range(0, len(bank), TILE[1]):
            s = left[part] @ right[:, start : start + TILE[1]]
            mine = np.flatnonzero((out >= start) & (out < start + s.shape[1]))
            s[mine, out[mine] - start] = np.inf
            limit = d[:, 1] / scale / scale - own_norms[part] + error[part]
            if start == 0 and s.shape[1] > 2:
                limit = np.minimum(limit, np.partition(s, 1, axis=1)[:, 1] + 2 * error[part])
            row, column = divmod(np.flatnonzero(s <= limit.astype(np.float32)[:, None]), s.shape[1])
            hits = np.isfinite(s[row, column])
            row, column = row[hits], column[hits] + start
            for first in range(0, len(row), 1 << 16):
                r, c = row[first : first + (1 << 16)], column[first : first + (1 << 16)]
                exact = np.add.accumulate((q[r] - bank[c]) ** 2, axis=1)[:, -1]
                rows, far, place = np.r_[every, every, r], np.r_[d[:, 0], d[:, 1], exact], np.r_[k[:, 0], k[:, 1], c]
                order = np.lexsort((place, far, rows))
                head = order[np.searchsorted(rows[order], every)[:, None] + np.arange(2)]
                d[:], k[:] = far[head], place[head]
    return best, at


def _finite(vectors: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `width` finite numbers, and these as rows."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = np.array(pc.fill_null(pc.list_value_length(whole), -1)) == width
    values = whole.filter(pa.array(n)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    fine = np.isfinite(values).all(1)
    n[n] = fine
    return n, values[fine]


def nearest_two(queries: DataFrame, bank: DataFrame, key: str, vector: str, *, most_bytes: int = BANK_BYTES) -> DataFrame:
    """(key, nearest, distance, second, second_distance) by Euclidean distance, the row of the same key left out, ties by key. Vectors that are null, have
    an entry that isn't finite, or are shorter than others have no neighbours and aren't any.

    Of equal vectors the three least keys stay in the bank: one may be a query's own, and two are all it can get. The bank is broadcast in blocks of
    at most `most_bytes`; with several, the blocks' best are merged, so memory is bounded whatever its size. Every query meets every block."""
    kind, spark = _kind(bank, key), queries.sparkSession
    width = bank.select(F.max(F.size(vector))).first()[0] or 1
    n = bank.count()
    blocks = 1 + n * (8 * width + 16) // most_bytes
    least = bank.select(key, vector).withColumn("__k", F.row_number().over(W.partitionBy(vector).orderBy(key))).where("__k <= 3")
    dealt = least.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    tasks = 1 + queries.count() * (1 + n // blocks) // TASK_PAIRS
    asked = queries.select(key, vector).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > TILE[1] else 1, tasks))
    found = []
    for block in range(blocks):
        rows = dealt.where(F.col("__block") == block).select(key, vector).orderBy(key).toArrow()
        fine, values = _finite(rows.column(1), width)
        shared = spark.sparkContext.broadcast((rows.column(0).combine_chunks().filter(pa.array(fine)), values))

        def run(batches, shared=shared):
            names, values = shared.value
            for batch in batches:
                fine, own = _finite(batch.column(1), width)
                asking = batch.column(0).filter(pa.array(fine))
                if not len(names) or not len(own):
                    continue
                left_out = np.array(pc.fill_null(pc.index_in(asking, value_set=names), -1))
                squares, at = _two_nearest(own, values, left_out)
                row, k = np.nonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(row)), names.take(pa.array(at[row, k])), pa.array(squares[row, k])], names=[key, "other", "square"])

        found.append(asked.mapInArrow(run, f"`{key}` {kind}, other {kind}, square double"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.slice(F.sort_array(F.collect_list(F.struct("square", "other"))), 1, 2)  # squares: their roots may tie where they don't
    rows = queries.select(key).join(every.groupBy(key).agg(best.alias("b")), key, "left")
    pick = lambda k, c: F.get("b", k)[c]
    return rows.select(key, pick(0, "other").alias("nearest"), F.sqrt(pick(0, "square")).alias("distance"), pick(1, "other").alias("second"), F.sqrt(pick(1, "square")).alias("second_distance"))


def retrieved(nearest: DataFrame, bank: DataFrame, key: str, threshold: float, values: list[str]) -> DataFrame:
    """Nearest rows with the bank's values of the source, nulls where the distance exceeds the threshold, and whether it was accepted."""
    source = bank.select(F.col(key).alias("nearest"), *values)
    rows = nearest.join(source, "nearest", "left").withColumn("accepted", F.coalesce(F.col("distance") <= threshold, F.lit(False)))
    return rows.select(*nearest.columns, "accepted", *(F.when(F.col("accepted"), F.col(v)).alias(v) for v in values))


def union_candidates(grid: DataFrame, stems: DataFrame, by: list[str], *, x_reach: float, y_reach: float) -> DataFrame:
    """(by, id, x, y, grid_ids, stem_ids, score): candidates of a grid (id, x, y, rank) and of stems (x, y, score) as one list; x and y in staff spaces.

    Stems go in order of x, y, falling score. Each joins the nearest candidate within the reach on both axes (in reaches; a grid one first of equals, then by place), which moves halfway
    if no grid candidate is in it, or else stands by itself. The result is numbered u001, u002, ... by place, grid candidates first, then their rank."""
    kinds = ", ".join(f"`{c}` {_kind(grid, c)}" for c in by)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = [{"x": float(r.x), "y": float(r.y), "rank": int(r.rank), "grid": [str(r.id)], "stems": [], "score": 0.0} for r in (a.sort_values(["rank", "id"]).itertuples() if len(a) else ())]
        for number, stem in enumerate(b.sort_values(["x", "y", "score"], ascending=[True, True, False]).itertuples() if len(b) else (), 1):
            off = lambda r, s=stem: np.hypot((r["x"] - s.x) / x_reach, (r["y"] - s.y) / y_reach)
            near = [r for r in rows if abs(r["x"] - stem.x) <= x_reach and abs(r["y"] - stem.y) <= y_reach]
            if near:
                best = min(near, key=lambda r: (off(r), not r["grid"], r["x"], r["y"]))
                if not best["grid"]:
                    best["x"], best["y"] = (best["x"] + stem.x) / 2, (best["y"] + stem.y) / 2
                best["stems"], best["score"] = [*best["stems"], f"stem{number:03d}"], max(best["score"], float(stem.score))
            else:
                rows.append({"x": float(stem.x), "y": float(stem.y), "rank": 10**9, "grid": [], "stems": [f"stem{number:03d}"], "score": float(stem.score)})
        rows.sort(key=lambda r: (r["x"], r["y"], not r["grid"], r["rank"], r["stems"]))
        first = (a if len(a) else b).iloc[0]
        return pd.DataFrame([(*(first[c] for c in by), f"u{k:03d}", r["x"], r["y"], r["grid"], sorted(r["stems"]), r["score"]) for k, r in enumerate(rows, 1)], columns=[*by, "id", "x", "y", "grid_ids", "stem_ids", "score"])

    return grid.select(*by, "id", "x", "y", "rank").groupBy(*by).cogroup(stems.select(*by, "x", "y", "score").groupBy(*by)).applyInPandas(run, f"{kinds}, id string, x double, y double, grid_ids array<string>, stem_ids array<string>, score double")


def sweep_heads(df: DataFrame, thresholds: DataFrame, by: list[str], truth: DataFrame, match_within: float, **selector) -> DataFrame:
    """(threshold, tp, fp, fn, kept, exact, precision, recall, f1): the selector run on every group at each of a few thresholds, its heads matched with the truth (by, id, x, y) by distance."""
    grid = [float(r.threshold) for r in thresholds.select("threshold").distinct().collect()]  # a budget of some dozens, see threshold_grid
    at = F.explode(F.array(*map(F.lit, grid))).alias("threshold")
    rows, keys = df.select("*", at), ["threshold", *by]
    chosen = select_heads(rows, keys, threshold="threshold", **selector).join(rows.select(*keys, "id", "x", "y"), [*keys, "id"])
    wanted = truth.select("*", at)
    report = match_report(match(chosen, wanted, keys, "id", ["x", "y"], match_within, closest_pairs), chosen, wanted, keys)
    sums = report.groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count(F.when(F.col("exact") & (F.col("fp") == 0), 1)).alias("exact"))
    scores = C.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("*", (F.col("tp") + F.col("fp")).alias("kept"), *(c.alias(n) for c, n in zip(scores, ("precision", "recall", "f1"), strict=True)))


#: Limits of a pair of heads on one stem with dots behind it, in staff spaces and scores.
DYAD = {"dx": 0.5, "dy": (0.8, 1.2), "score": 0.0, "shared_stem": 0.55, "other_stem": 0.25, "stem_margin": 0.4, "least_x": 1.0, "staff_margin": 0.5, "dot_dx": (0.75, 2.5), "dot_dy": 0.2, "dots_dx": 0.5, "dot_score": 0.0, "dot_stem": 0.35}


def propose_dyad(rows: list[dict], x_radius: float, limits: dict = DYAD) -> dict:
    """Whether two kept heads of two onsets give way to a pair on one stem: `status`, `current`, `proposed` ids.

    Rows are candidates (id, x, y, left, right, score, rank, stem_x, stem_score, kept; x and y in staff spaces, y from the top line, so that the staff is 0 to 4). A pair lies near on x, about a space
    apart on y, on or near the staff, a strong stem of one passes both, and each has a weak blob behind it at its height, both one above the other. All pairs must lie at one place; the
    best is taken, unless it is at the very left, and if every head it displaces has a weak stem or is off the staff."""
    on_staff = lambda r: -limits["staff_margin"] <= r["y"] <= 4 + limits["staff_margin"]
    current = sorted((r for r in rows if r["kept"]), key=lambda r: (r["x"], r["y"], r["id"]))
    out = {"status": "accepted", "current": [r["id"] for r in current], "proposed": []}
    if len(current) != 2:
        return out | {"status": "rejected_current_candidate_count"}
    if current[1]["x"] - current[0]["x"] < x_radius:
        return out | {"status": "rejected_current_onset_group_count"}
    pairs = []
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            near = abs(a["x"] - b["x"]) <= limits["dx"] and limits["dy"][0] <= abs(a["y"] - b["y"]) <= limits["dy"][1]
            if not near or min(a["score"], b["score"]) < limits["score"] or not (on_staff(a) and on_staff(b)) or min(a["stem_score"], b["stem_score"]) < limits["other_stem"]:
                continue
            stems = [r["stem_x"] for r in (a, b) if r["stem_x"] is not None and r["stem_score"] >= limits["shared_stem"]]
            if not any(all(h["left"] - limits["stem_margin"] <= x <= h["right"] + limits["stem_margin"] for h in (a, b)) for x in stems):
                continue
            behind = max(a["x"], b["x"])
            dots = [[d for d in rows if d is not a and d is not b and limits["dot_dx"][0] <= d["x"] - behind <= limits["dot_dx"][1] and abs(d["y"] - h["y"]) <= limits["dot_dy"] and d["score"] <= limits["dot_score"] and d["stem_score"] <= limits["dot_stem"]] for h in (a, b)]
            if any(abs(p["x"] - q["x"]) <= limits["dots_dx"] for p in dots[0] for q in dots[1]):
                pairs.append((a, b))
    pairs.sort(key=lambda p: p[0]["x"] + p[1]["x"])
    centres = [(a["x"] + b["x"]) / 2 for a, b in pairs]
    if not pairs or any(q - p >= x_radius for p, q in zip(centres, centres[1:], strict=False)):
        return out | {"status": "rejected_sparse_pair_cluster_count"}
    best = max(pairs, key=lambda p: (p[0]["score"] + p[1]["score"], min(p[0]["stem_score"], p[1]["stem_score"]), -abs(p[0]["x"] - p[1]["x"]), sorted(r["id"] for r in p)))
    out["proposed"] = [r["id"] for r in sorted(best, key=lambda r: (r["x"], r["y"], r["id"]))]
    displaced = [r for r in current if r["id"] not in out["proposed"]]
    if min(r["x"] for r in best) < limits["least_x"]:
        return out | {"status": "rejected_leading_edge_pair"}
    if not displaced:
        return out | {"status": "already_selected"}
    if any(r["stem_score"] >= limits["shared_stem"] and on_staff(r) for r in displaced):
        return out | {"status": "rejected_strong_displaced_candidate"}
    return out


def dyads(df: DataFrame, by: list[str], x_radius: float) -> DataFrame:
    """(by, decision) of propose_dyad for each measure."""
    from .sequences import gathered, mapped

    rows = gathered(df, by, ["rank", "id"])
    return mapped(rows, "items", lambda items: propose_dyad(items, x_radius), "struct<status:string,current:array<string>,proposed:array<string>>", "decision").drop("items")
