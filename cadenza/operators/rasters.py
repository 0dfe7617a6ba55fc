"""Grey pictures as rows: thresholds, densities, spans, staff rows, components, window scores, boundaries and boxes.

A picture is a row (id, width, height, pixels), pixels one byte each, row by row, 0 black. `run_rasters` hands each picture to a
function as a numpy array and returns its results as rows; pictures are pages or crops, so a row is small. Boxes and lists of
boundaries need no pixels and are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<left:int,top:int,right:int,bottom:int>"


def run_rasters(pictures: DataFrame, key: str, run: Callable[[np.ndarray], object], kind: str, out: str, *, extra: list[str] | None = None) -> DataFrame:
    """(key, out): what `run` gives for each picture, and the columns of `extra` as further arguments."""
    rows = pictures.select(key, "width", "height", "pixels", *(extra or []))
    result = pictures.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field(0).type

    def apply(batches):
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                picture = np.frombuffer(row["pixels"] or b"", np.uint8)
                picture = picture[: row["width"] * row["height"]].reshape(row["height"], row["width"])
                made.append(run(picture, *(row[c] for c in extra or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, result)], names=[key, out])

    return rows.mapInArrow(apply, f"`{key}` {rows.schema[0].dataType.simpleString()}, `{out}` {kind}")


def from_pgm(blob: bytes) -> tuple[int, int, bytes]:
    """Width, height and pixels of a binary PGM file of one byte a pixel."""
    fields, at = [], 0
    while len(fields) < 4:
        while blob[at : at + 1].isspace():
            at += 1
        if blob[at : at + 1] == b"#":
            at = blob.index(b"\n", at) + 1
            continue
        end = at
        while not blob[end : end + 1].isspace():
            end += 1
        fields.append(blob[at:end])
        at = end
    if fields[0] != b"P5" or int(fields[3]) > 255:
        raise ValueError("not a binary PGM of one byte a pixel")
    width, height = int(fields[1]), int(fields[2])
    return width, height, blob[at + 1 : at + 1 + width * height]


def pgm_files(files: DataFrame) -> DataFrame:
    """(path, width, height, pixels) of binary PGM files (path, content)."""

    def apply(batches):
        for batch in batches:
            rows = [from_pgm(bytes(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary())))], names=["path", "width", "height", "pixels"])

    return files.select("path", "content").mapInArrow(apply, "path string, width int, height int, pixels binary")


def ink_threshold(picture: np.ndarray) -> int:
    """Below which a pixel is ink: 28 darker than the mean, from 150 to 220."""
    return int(max(150, min(220, int(picture.mean() - 28)))) if picture.size else 150


def otsu(picture: np.ndarray) -> int:
    """The threshold of the greatest variance between both sides, the least of equals, from 80 to 235; 127 for a picture of nothing before that."""
    counts = np.bincount(picture.ravel(), minlength=256)[:256].astype(float)
    below, total = np.cumsum(counts), counts.sum()
    sums = np.cumsum(counts * np.arange(256))
    able = (below > 0) & (below < total)
    if not able.any():
        return 127
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.where(able, below * above * (sums / below - (sums[-1] - sums) / above) ** 2, -1.0)
    return int(min(235, max(80, int(variance.argmax()))))


def row_density(picture: np.ndarray, left: int = 0, right: int | None = None, threshold: int | None = None) -> np.ndarray:
    """Share of ink in each row between two columns."""
    dark = picture[:, left:right] < (ink_threshold(picture) if threshold is None else threshold)
    return dark.sum(1) / max(1, dark.shape[1])


def moving_average(values: np.ndarray, window: int) -> np.ndarray:
    """Centred means over a window, shorter at the edges."""
    n, half = len(values), window // 2
    sums = np.r_[0.0, np.cumsum(values)]
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (sums[hi] - sums[lo]) / (hi - lo)


def active_spans(values: np.ndarray, threshold: float, least: int, gap: int) -> list[tuple[int, int]]:
    """First and last places of runs at the threshold or above, at least `least` long; then those whose step is at most `gap` are one."""
    on = np.r_[False, np.asarray(values) >= threshold, False]
    edges = np.flatnonzero(on[1:] != on[:-1])
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[::2], edges[1::2] - 1, strict=True):
        if b - a + 1 >= least:
            if out and a - out[-1][1] <= gap:
                out[-1] = out[-1][0], int(b)
            else:
                out.append((int(a), int(b)))
    return out


def odd(n: int) -> int:
    return n if n % 2 else n + 1


def horizontal_bounds(picture: np.ndarray, top: int, bottom: int, threshold: int | None = None) -> tuple[int, int]:
    """Left and right edge of what is written between two rows, with a margin of 24; the whole width if nothing is."""
    width = picture.shape[1]
    dark = picture[top:bottom] < (ink_threshold(picture) if threshold is None else threshold)
    smooth = moving_average(dark.sum(0) / max(1, bottom - top), odd(max(21, int(width * 0.012))))
    peak = smooth.max(initial=0.0)
    spans = active_spans(smooth, max(peak * 0.2, 0.02), max(80, int(width * 0.08)), max(20, int(width * 0.01))) if peak > 0 else []
    return (max(0, spans[0][0] - 24), min(width, spans[-1][1] + 24)) if spans else (0, width)


def span_peak(density: np.ndarray, start: int, end: int) -> tuple[float, int]:
    """Greatest value and weighted centre, rounded, of a span; its middle if it is empty."""
    values = np.asarray(density[start : end + 1], float)
    total = values.sum()
    return float(values.max()), (start + end) // 2 if total <= 0 else int(round(float(((start + np.arange(len(values))) * values).sum() / total)))


def peakiness(picture: np.ndarray) -> float:
    """How uneven the ink of the rows is: the sum of squared deviations of their densities, a margin of 2 % left out."""
    left = int(picture.shape[1] * 0.02)
    density = row_density(picture, left, max(left + 1, int(picture.shape[1] * 0.98)))
    return float(((density - density.mean()) ** 2).sum()) if len(density) else 0.0


def rotated(picture: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """A picture turned about its middle, nearest pixels, what comes from outside white."""
    height, width = picture.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:height, :width].astype(float)
    dy, dx = y - (height - 1) / 2, x - (width - 1) / 2
    sx = np.rint(np.cos(a) * dx - np.sin(a) * dy + (width - 1) / 2).astype(int)
    sy = np.rint(np.sin(a) * dx + np.cos(a) * dy + (height - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
    out = np.full_like(picture, fill)
    out[inside] = picture[sy[inside], sx[inside]]
    return out


def skew(picture: np.ndarray, most: float = 4.0, steps: int = 33) -> float:
    """The turn, of evenly spaced ones, that makes rows most uneven; the least of equals in size."""
    turns = sorted(np.linspace(-most, most, steps).tolist(), key=abs)
    return float(max(turns, key=lambda t: (round(peakiness(rotated(picture, t)), 12), -abs(t))))


def darkened(picture: np.ndarray, gamma: float = 3.5) -> np.ndarray:
    """Ink made darker: values over the 99th percentile's are white, the others follow a power."""
    counts = np.bincount(picture.ravel(), minlength=256)
    if not counts.sum():
        return picture
    white = max(int(np.searchsorted(np.cumsum(counts), counts.sum() * 0.99)), 1)
    table = np.rint(np.minimum(1.0, np.arange(256) / white) ** gamma * 255).astype(np.uint8)
    return table[picture]


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes (left, top, right, bottom, inclusive) and areas of regions of ink that touch, also at corners, in order of their first pixel by rows.

    Runs of each row are linked to the row above's and joined."""
    parent: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    runs, above = [], []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.r_[False, row, False].astype(np.int8)))
        own = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            runs.append((y, a, b))
            own.append(k)
            for j in above:
                if runs[j][1] <= b and a <= runs[j][2]:
                    p, q = sorted((root(j), root(k)))
                    parent[q] = p
        above = own
    found: dict[int, list[int]] = {}
    for k, (y, a, b) in enumerate(runs):
        box = found.setdefault(root(k), [a, y, b - 1, y, 0])
        box[0], box[2], box[3], box[4] = min(box[0], a), max(box[2], b - 1), max(box[3], y), box[4] + b - a
    return [tuple(found[k]) for k in sorted(found)]


def cell_components(cells: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, x, y, component): occupied cells of a grid with the number from 0 of their component, in order of its least cell by y, then x. A group is one task's work."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*by, x, y).schema)

    def run(table: pa.Table) -> pa.Table:
        cx, cy = (table.column(c).to_numpy().astype(np.int64) for c in (x, y))
        order = np.lexsort((cx, cy))
        parent = np.arange(len(order))
        at = {(int(cx[k]), int(cy[k])): n for n, k in enumerate(order)}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for n, k in enumerate(order):
            for step in ((-1, 0), (-1, -1), (0, -1), (1, -1)):
                if (m := at.get((int(cx[k]) + step[0], int(cy[k]) + step[1]))) is not None:
                    p, q = sorted((root(n), root(m)))
                    parent[q] = p
        roots = np.array([root(n) for n in range(len(order))], int)
        number = np.empty(len(order), np.int64)
        number[order] = np.unique(roots, return_inverse=True)[1]
        return table.append_column("component", pa.array(number))

    return cells.select(*by, x, y).distinct().groupBy(*by).applyInArrow(run, f"{kinds}, component long")


def merged_components(boxes: Sequence[tuple[int, int, int, int, int]], spacing: float) -> list[tuple[int, int, int, int, int]]:
    """Components joined while one, grown by a share of the spacing, touches another, in order, until none does; not where that would hang a narrow stem on something."""
    pad_x, pad_y, tallest = max(2, round(spacing * 0.35)), max(2, round(spacing * 0.28)), max(10, round(spacing * 2.2))

    def size(b):
        return b[2] - b[0] + 1, b[3] - b[1] + 1

    def stem(b):
        return size(b)[0] <= max(2, round(spacing * 0.35)) and size(b)[1] >= spacing * 0.45

    def union(a, b):
        return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]

    def joins(a, b):
        touch = a[0] - pad_x <= b[2] and b[0] <= a[2] + pad_x and a[1] - pad_y <= b[3] and b[1] <= a[3] + pad_y
        return touch and not (size(union(a, b))[1] > tallest and (stem(a) or stem(b)))

    left, out = list(boxes), []
    while left:
        now, left = left[0], left[1:]
        while True:
            keep = []
            for other in left:
                if joins(now, other):
                    now = union(now, other)
                else:
                    keep.append(other)
            if len(keep) == len(left):
                break
            left = keep
        out.append(now)
    return out


def without_staff(mask: np.ndarray, lines: Sequence[int], spacing: float | None) -> np.ndarray:
    """A mask without the rows near staff lines that hold ink over 18 % of their width."""
    out, radius = mask.copy(), max(1, round(spacing * 0.08)) if spacing else 1
    for line in lines:
        for y in range(max(0, line - radius), min(len(mask), line + radius + 1)):
            if mask[y].mean() >= 0.18:
                out[y] = False
    return out


WINDOW_FEATURES = ("ink_count", "ink_density", "core_density", "vertical_support", "horizontal_support", "row_peak_density", "column_peak_density", "line_dominance", "stem_evidence")


def score_window(mask: np.ndarray, x: int, y: int, width: int, height: int, spacing: float) -> dict[str, float]:
    """How much a window about a point looks like a note head: a linear score of the ink in its core, its rows and columns, a stem at its middle, less that of lines; and the features."""
    padded = np.pad(mask, ((height, height), (width, width)))
    top, left = y - height // 2 + height, x - width // 2 + width
    window = padded[top : top + height, left : left + width]
    rows, columns = window.sum(1), window.sum(0)
    rx, ry = max(2.0, width * 0.31), max(2.0, height * 0.34)
    v, u = np.mgrid[:height, :width]
    core = window[((u - (width - 1) / 2) / rx) ** 2 + ((v - (height - 1) / 2) / ry) ** 2 <= 1].sum()
    f = {"ink_count": float(window.sum()), "ink_density": window.sum() / (width * height), "core_density": min(1.0, core / (np.pi * rx * ry))}
    f["vertical_support"] = (rows >= max(2, round(width * 0.18))).sum() / height
    f["horizontal_support"] = (columns >= max(2, round(height * 0.22))).sum() / width
    f["row_peak_density"], f["column_peak_density"] = rows.max(initial=0) / width, columns.max(initial=0) / height
    f["line_dominance"] = f["row_peak_density"] * (1 - f["vertical_support"])
    lo, hi = max(0, y - round(spacing * 0.9)), min(len(mask), y + round(spacing * 0.9) + 1)
    f["stem_evidence"] = min(1.0, mask[lo:hi, max(0, x - 1) : min(mask.shape[1], x + 2)].sum() / max(1, (hi - lo) * 3) * 2.5)
    score = 0.46 * f["core_density"] + 0.24 * f["vertical_support"] + 0.18 * f["horizontal_support"] + 0.12 * f["ink_density"] + 0.04 * f["stem_evidence"] - 0.16 * f["line_dominance"]
    return {"score": round(float(min(1.0, max(0.0, score))), 6), **{k: round(float(f[k]), 6) for k in WINDOW_FEATURES}}


def vertical_strokes(mask: np.ndarray, spacing: float) -> np.ndarray:
    """Ink that lies, in its column or one beside it, in a vertical stroke: 58 % of a window of about a staff space is ink."""
    height, window = mask.shape[0], max(13, round(spacing * 1.05))
    half = window // 2
    sums = np.r_[np.zeros((1, mask.shape[1]), int), np.cumsum(mask, 0)]
    y = np.arange(height)
    support = sums[np.minimum(height, y + half + 1)] - sums[np.maximum(0, y - half)]
    wide = np.pad(support, ((0, 0), (1, 1)))
    near = np.maximum(np.maximum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
    return mask & (near / max(1, min(window, height)) >= 0.58)


def closed(mask: np.ndarray) -> np.ndarray:
    """A mask grown by one pixel and shrunk by one; what is outside counts as nothing when growing and is left out when shrinking."""
    shifts = [(dy, dx) for dy in range(3) for dx in range(3)]
    take = lambda m, fill: np.stack([np.pad(m, 1, constant_values=fill)[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy, dx in shifts])
    return take(take(mask, False).any(0), True).all(0)


def shift_distance(a: np.ndarray, b: np.ndarray, most: int = 1) -> float:
    """Least mean squared difference of two patches over moves of the first by up to `most`, zeros moved in."""
    height, width = a.shape
    wide = np.pad(np.asarray(a, float), most)
    return min(float(((wide[most - dy : most - dy + height, most - dx : most - dx + width] - b) ** 2).mean()) for dy in range(-most, most + 1) for dx in range(-most, most + 1))


def patch_distances(patches: DataFrame, samples: DataFrame, key: str, width: int, *, most: int = 1, most_bytes: int = 64 << 20) -> DataFrame:
    """(key, sample, label, distance) of patches (key, vector) to labelled samples (sample, vector, label), which are broadcast; a training bank over `most_bytes` is refused."""
    rows = samples.select("sample", "vector", "label").orderBy("sample").toArrow()
    if rows.nbytes > most_bytes:
        raise ValueError(f"a bank of {rows.nbytes} bytes is more than {most_bytes}")
    bank = [(r["sample"], np.array(r["vector"], float).reshape(-1, width), r["label"]) for r in rows.to_pylist()]
    shared = patches.sparkSession.sparkContext.broadcast(bank)
    kind, sample = patches.schema[key].dataType.simpleString(), samples.schema["sample"].dataType.simpleString()
    types = [rows.schema.field(c).type for c in ("sample", "label")]

    def run(batches):
        for batch in batches:
            out = [(row[key], s, label, shift_distance(np.array(row["vector"], float).reshape(-1, width), v, most)) for row in batch.to_pylist() for s, v, label in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], types[0]), pa.array([o[2] for o in out], types[1]), pa.array([o[3] for o in out], pa.float64())], names=[key, "sample", "label", "distance"])

    return patches.select(key, "vector").mapInArrow(run, f"`{key}` {kind}, sample {sample}, label {samples.schema['label'].dataType.simpleString()}, distance double")


#: Shares of a system's width where a barline is its left or right edge.
LEADING, TRAILING = 0.08, 0.92


def distinct_edges(edges: Column, epsilon: float = 1e-6) -> Column:
    """Ascending numbers without those at most epsilon past the one kept before."""
    kind = "array<double>"
    return F.aggregate(edges, F.array().cast(kind), lambda kept, x: F.when((F.size(kept) == 0) | (F.abs(x - F.try_element_at(kept, F.lit(-1))) > epsilon), F.concat(kept, F.array(x))).otherwise(kept))


def measure_edges(barlines: Column, leading: float = LEADING, trailing: float = TRAILING) -> Column:
    """Edges of a system's measures from its barlines, as shares of its width: the last one near the left edge opens, the first one near the right edge closes, those between divide."""
    inside = F.array_sort(F.filter(F.transform(barlines, lambda x: x.cast("double")), lambda x: x.between(0.0, 1.0)))
    left = F.coalesce(F.array_max(F.filter(inside, lambda x: x <= leading)), F.lit(0.0))
    right = F.coalesce(F.array_min(F.filter(inside, lambda x: x >= trailing)), F.lit(1.0))
    middle = F.filter(inside, lambda x: (x > leading) & (x < trailing))
    return F.when(right <= left, F.array(F.lit(0.0), F.lit(1.0))).otherwise(distinct_edges(F.concat(F.array(left), middle, F.array(right))))


def measure_count(barlines: Column) -> Column:
    return F.greatest(F.size(measure_edges(barlines)) - 1, F.lit(0))


def measure_of(x: Column, edges: Column) -> Column:
    """Number from 1 of the first edge after the opening one that is strictly right of x; past the last one, the last measure."""
    n = F.size(edges)
    after = F.filter(F.transform(edges, lambda e, k: F.when((k > 0) & (x < e), k)), lambda k: k.isNotNull())
    return F.coalesce(F.array_min(after), F.greatest(n - 1, F.lit(1)))


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


def expanded(b: Column, width: Column, height: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """A box grown on its sides, within the page."""
    return box(F.greatest(b["left"] - left, F.lit(0)), F.greatest(b["top"] - top, F.lit(0)), F.least(width, b["right"] + right), F.least(height, b["bottom"] + bottom))


def _floor(x: Column) -> Column:
    return F.floor(x).cast("int")


def system_crop(b: Column, width: Column, height: Column) -> Column:
    side, tall = F.greatest(F.lit(12), _floor(width * 0.004)), b["bottom"] - b["top"]
    return expanded(b, width, height, side, side, F.greatest(F.lit(18), _floor(tall / 8)), F.greatest(F.lit(24), _floor(tall / 6)))


def annotation_crop(b: Column, width: Column, height: Column, above: bool) -> Column:
    tall = F.greatest(F.lit(1), b["bottom"] - b["top"])
    side, main, other = F.greatest(F.lit(12), _floor(width * 0.004)), F.greatest(F.lit(18), _floor(tall / 4)), F.greatest(F.lit(6), _floor(tall / 12))
    return expanded(b, width, height, side, side, main if above else other, other if above else main)


def band_above(b: Column, previous_bottom: Column, height: Column, wanted: Column, overlap: Column) -> Column:
    """The band over a system where chord symbols stand: it reaches into the staff by the overlap, half its height at most, and up to 6 below the system before, 12 high at least."""
    into = F.least(F.greatest(overlap, F.lit(0)), _floor(F.greatest(F.lit(1), b["bottom"] - b["top"]) / 2))
    bottom = F.least(height, b["top"] + into)
    top = F.greatest(F.greatest(F.lit(0), previous_bottom + 6), bottom - wanted - into)
    return box(b["left"], F.when(bottom - top < 12, F.greatest(F.lit(0), bottom - 12)).otherwise(top), b["right"], bottom)


def band_below(b: Column, next_top: Column, height: Column, wanted: Column, overlap: Column) -> Column:
    """The same under a system, down to 6 above the next one."""
    into = F.least(F.greatest(overlap, F.lit(0)), _floor(F.greatest(F.lit(1), b["bottom"] - b["top"]) / 2))
    top = F.greatest(F.lit(0), b["bottom"] - into)
    bottom = F.least(F.least(height, F.greatest(top + 12, next_top - 6)), top + wanted + into)
    return box(b["left"], top, b["right"], F.when(bottom - top < 12, F.least(height, top + 12)).otherwise(bottom))


def system_bands(systems: DataFrame, page: str, order: str) -> DataFrame:
    """Systems of a page (box, width, height) with their crop and the bands above and below, each bounded by the systems before and after it."""
    from pyspark.sql import Window as W

    w = W.partitionBy(page).orderBy(order)
    b, tall = F.col("box"), F.col("box.bottom") - F.col("box.top")
    wanted, overlap = F.greatest(F.lit(32), F.least(F.lit(96), _floor(tall / 2))), F.greatest(F.lit(24), _floor(tall * 0.40))
    before, after = F.coalesce(F.lag("box.bottom").over(w), F.lit(0)), F.coalesce(F.lead("box.top").over(w), F.col("height"))
    rows = systems.withColumn("__before", before).withColumn("__after", after)
    above, below = band_above(b, F.col("__before"), F.col("height"), wanted, overlap), band_below(b, F.col("__after"), F.col("height"), wanted, overlap)
    return rows.select(*systems.columns, system_crop(b, F.col("width"), F.col("height")).alias("crop"), annotation_crop(above, F.col("width"), F.col("height"), True).alias("above"), annotation_crop(below, F.col("width"), F.col("height"), False).alias("below"))


def without_blank_tail(systems: DataFrame, page: str, order: str, ink: str, least: float) -> DataFrame:
    """Systems with `accepted` false after the last accepted one of the page that holds enough ink; where none does, as they were."""
    from pyspark.sql import Window as W

    last = F.max(F.when(F.col("accepted") & (F.coalesce(ink, F.lit(0.0)) >= least), F.col(order))).over(W.partitionBy(page))
    rows = systems.withColumn("__last", last)
    gone = F.col("accepted") & F.col("__last").isNotNull() & (F.col(order) > F.col("__last"))
    return rows.withColumn("reason", F.when(gone, "insufficient_musical_ink").otherwise(F.col("reason"))).withColumn("accepted", F.col("accepted") & ~gone).drop("__last")


def neighbour_bounds(boxes: DataFrame, page: str, order: str) -> DataFrame:
    """Boxes with the bottom of the one before (0 at first) and the top of the one after (the page's height at last)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(page).orderBy(order)
    return boxes.withColumn("previous_bottom", F.coalesce(F.lag("bottom").over(w), F.lit(0))).withColumn("next_top", F.coalesce(F.lead("top").over(w), F.col("height")))


def system_staffs(picture: np.ndarray, *, support: float = 0.45) -> list[tuple[int, int, list[float]]]:
    """Systems of a page by their staves: rows whose ink reaches over `support` of the width are line candidates, five evenly spaced ones a staff; (top, bottom, lines) of as many staves as stand apart."""
    from itertools import combinations

    from .sequences import distinct_staves

    density = row_density(picture)
    lines = [span_peak(density, a, b) for a, b in active_spans(density, support, 1, 1)]
    staves = []
    for k in range(len(lines)):
        for some in combinations(lines[k : k + 9], 5):  # a staff's lines stand among nine neighbours at most
            rows = [row for _, row in some]
            mean = (rows[4] - rows[0]) / 4
            if some[0] is lines[k] and 6 <= mean <= 80 and (off := max(abs(b - a - mean) for a, b in zip(rows, rows[1:], strict=False)) / mean) <= 0.3:
                staves.append({"top": rows[0], "bottom": rows[4], "spacing": mean, "deviation": off, "support": sum(s for s, _ in some) / 5, "rows": rows})
    return [(int(staves[k]["top"]), int(staves[k]["bottom"]), [float(r) for r in staves[k]["rows"]]) for k in distinct_staves(staves)]


def column_runs(dark: np.ndarray, tolerance: int = 1) -> np.ndarray:
    """The longest vertical run of ink in each column, ink within `tolerance` columns counting."""
    height, width = dark.shape
    wide = np.pad(dark, ((0, 0), (tolerance, tolerance)))
    near = np.zeros_like(dark)
    for k in range(2 * tolerance + 1):
        near |= wide[:, k : k + width]
    best, now = np.zeros(width, int), np.zeros(width, int)
    for row in near:
        now = np.where(row, now + 1, 0)
        best = np.maximum(best, now)
    return best


def barlines(picture: np.ndarray, top: int, bottom: int, *, least: float = 0.85, gap: float = 0.03, tolerance: int = 1) -> list[float]:
    """Places, as shares of the width, of columns whose ink runs over most of a staff's height: local maxima within two columns, one within `gap` of the width, the longer one of those too near."""
    dark = picture[max(0, top) : bottom + 1] < ink_threshold(picture)
    runs, width = column_runs(dark, tolerance), picture.shape[1]
    peaks: list[int] = []
    for x in np.flatnonzero(runs >= least * dark.shape[0]).tolist():
        if runs[x] < runs[max(0, x - 2) : x + 3].max():
            continue
        if peaks and x - peaks[-1] < max(1, int(width * gap)):
            if runs[x] > runs[peaks[-1]]:
                peaks[-1] = x
        else:
            peaks.append(x)
    return [x / width for x in peaks]


def collage(pictures: list[np.ndarray], space: int = 24) -> np.ndarray:
    """Pictures under each other on white, left edges aligned, `space` rows between."""
    width = max(p.shape[1] for p in pictures)
    rows = []
    for k, p in enumerate(pictures):
        rows += [np.full((space, width), 255, np.uint8)] * bool(k) + [np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=255)]
    return np.concatenate(rows)


def page_collages(pictures: DataFrame, page: str, order: str, space: int = 24) -> DataFrame:
    """(page, width, height, pixels): a page's pictures put under each other in order."""
    kind = pictures.schema[page].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]) for r in rows.sort_by(order).to_pylist()]
        whole = collage(parts, space)
        return pa.table({page: pa.array([key[0].as_py()], rows.schema.field(page).type), "width": pa.array([whole.shape[1]], pa.int32()), "height": pa.array([whole.shape[0]], pa.int32()), "pixels": pa.array([whole.tobytes()], pa.binary())})

    return pictures.select(page, order, "width", "height", "pixels").groupBy(page).applyInArrow(run, f"`{page}` {kind}, width int, height int, pixels binary")


def staff_rows(density: np.ndarray) -> list[int]:
    """The five rows of a staff in a row density: middles of spans at 45 % of its maximum (8 % at least), evenly spaced by 6 to 80, with the least deviation, then most support; none if there aren't any."""
    from itertools import combinations

    if not len(density) or density.max() <= 0:
        return []
    spans = [span_peak(density, a, b) for a, b in active_spans(density, max(0.08, 0.45 * float(density.max())), 1, 0)]
    best = None
    for some in combinations(spans, 5):
        rows = sorted(row for _, row in some)
        mean = (rows[4] - rows[0]) / 4
        if 6 <= mean <= 80:
            off = max(abs(b - a - mean) for a, b in zip(rows, rows[1:], strict=False)) / mean
            rank = (off, -sum(support for support, _ in some) / 5, rows)
            if off <= 0.3 and (best is None or rank < best):
                best = rank
    return best[2] if best else []


def staff_band(picture: np.ndarray, pad: int = 4) -> tuple[int, int]:
    """First and last row of a crop's staff, `pad` rows around it; without a regular staff, of the rows with ink over 70 % of the width, or of the five darkest."""
    height, width = picture.shape
    left = max(0, round(0.05 * width))
    density = row_density(picture, left, min(width, max(left + 1, round(0.95 * width))))
    rows = staff_rows(density) or np.flatnonzero(density >= 0.7).tolist()
    if len(rows) < 5:
        rows = sorted(np.argsort(-density, kind="stable")[:5].tolist())
    return max(0, min(rows) - pad), min(height - 1, max(rows) + pad)


def shift_support(picture: np.ndarray, lines: list[float], limit: int, *, reach: int = 3, near: int = 1) -> np.ndarray:
    """[column, shift + limit]: in how many columns within `reach` the five lines, shifted down, have ink within `near` rows."""
    dark = picture <= ink_threshold(picture)
    height, width = dark.shape
    out = np.zeros((width, 2 * limit + 1))
    sums = np.r_[np.zeros((1, width), int), np.cumsum(dark, 0)]
    for k, shift in enumerate(range(-limit, limit + 1)):
        for line in lines:
            y = round(line + shift)
            lo, hi = min(max(0, y - near), height), min(max(0, y + near + 1), height)
            there = (sums[hi] - sums[lo] > 0).astype(int) if hi > lo else np.zeros(width, int)
            wide = np.r_[0, np.cumsum(there)]
            at = np.arange(width)
            out[:, k] += wide[np.minimum(width, at + reach + 1)] - wide[np.maximum(0, at - reach)]
    return out


def track_staff(picture: np.ndarray, lines: list[float], spacing: float) -> list[int]:
    """The shift of a staff's five lines in each column, at most three quarters of a space (3 at least), as a smooth path."""
    from .sequences import track_shift

    limit = max(3, round(spacing * 0.75))
    return track_shift(shift_support(picture, lines, limit))


def ink_above(dark: np.ndarray, x: int, row: int) -> int:
    """How many rows upwards from `row` hold ink without a break within a column of x."""
    strip = dark[: row + 1, max(0, x - 1) : x + 2].any(1)[::-1]
    return len(strip) if strip.all() else int(strip.argmin())


def without_stems(picture: np.ndarray, edges: list[float], *, leading: float = LEADING, trailing: float = TRAILING) -> list[float]:
    """Barline places without note stems at both ends: the first one near the left edge goes if its ink rises nine tenths of a space over the staff and there is ink left of it; the last but one, close
    before a thick closing barline, goes if it is thin and its ink rises seven tenths of a space."""
    height, width = picture.shape
    top, bottom = staff_band(picture)
    rows = staff_rows(row_density(picture, max(0, round(0.05 * width)), max(1, round(0.95 * width))))
    if len(rows) < 5:
        return list(edges)
    dark = picture < ink_threshold(picture)
    spacing, out = float(np.median(np.diff(rows))), list(edges)
    off_lines = np.ones(height, bool)
    for r in rows:
        off_lines[max(0, r - 1) : r + 2] = False
    off_lines[:top] = off_lines[bottom + 1 :] = False
    if out and 0.05 < out[0] <= leading:
        x = round(out[0] * width)
        before = dark[off_lines, : max(0, x - 12)]
        if ink_above(dark, x, top - 1) >= 0.9 * spacing and before.size and before.mean() >= 0.02:
            out = out[1:]
    if len(out) >= 2 and out[-1] >= trailing > out[-2] and round((out[-1] - out[-2]) * width) <= 4 * spacing:
        thick = [thickness(dark[top : bottom + 1], round(e * width)) for e in out[-2:]]
        if thick[0] < 8 <= thick[1] and ink_above(dark, round(out[-2] * width), top - 1) >= 0.7 * spacing:
            out = [*out[:-2], out[-1]]
    return out


def thickness(staff: np.ndarray, x: int, share: float = 0.6) -> int:
    """Width of the run of columns around x with ink over a share of the staff's height."""
    full = staff.mean(0) >= share
    if not 0 <= x < len(full):
        return 0
    left = right = x
    while left > 0 and full[left - 1]:
        left -= 1
    while right + 1 < len(full) and full[right + 1]:
        right += 1
    return right - left + 1 if full[left : right + 1].any() else 0


def without_blank_ends(picture: np.ndarray, edges: list[float], least: float = 0.12, ink: float = 0.01) -> list[float]:
    """Measure edges without a first or last measure that is `least` wide or more and holds next to no ink off the staff's lines."""
    width = picture.shape[1]
    top, bottom = staff_band(picture)
    rows = staff_rows(row_density(picture))
    dark = picture < ink_threshold(picture)
    keep = np.zeros(picture.shape[0], bool)
    keep[top : bottom + 1] = True
    for r in rows:
        keep[max(0, r - 1) : r + 2] = False

    def blank(a: float, b: float) -> bool:
        part = dark[keep, round(a * width) + 4 : max(round(a * width) + 4, round(b * width) - 4)]
        return b - a >= least and (not part.size or part.mean() < ink)

    out = list(edges)
    if len(out) >= 3 and out[-1] >= 1 - 1e-6 and blank(out[-2], out[-1]):
        out = out[:-1]
    if len(out) >= 3 and out[0] <= 1e-6 and blank(out[0], out[1]):
        out = out[1:]
    return out
