"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Words and punctuation runs of the lower-cased text, alone and in pairs, fall into hash buckets.
One multinomial over the buckets is counted from trusted documents (quality 1, not toxic), one
from the whole raw corpus. A text's score is the mean over its n-grams of log(trusted / raw).
Every text is held against one threshold: the score that a stated share of trusted documents
misses when each is scored by the trusted counts of the other half (so not by its own), rounded
down to a step of 1/`STEPS`; it is read off a histogram of at most 2 x `REACH` x `STEPS` cells.

Raw counts cover all rows. Trusted documents are at most `trusted_rows` ids, those with the
smallest hashes, so their list (8 bytes each) is safe to broadcast. Ids of any type are taken as
text and known by 64-bit hashes.

Defined results: null is the empty text, which has no words and fails the base rules. Without
labels or trusted documents the score is 0 and only the base rules decide. Labels that occur
several times must all say quality 1 and not toxic; null labels aren't trusted. Repeated rows
count as often as they occur. Null ids are never trusted. An empty table gives no row. A text whose
score equals the threshold is kept. Texts of any length are counted whole. Only key and text are
read, other columns are passed on by keep_good whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .storage import map_batches

#: The symbols counted by the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
STEPS, REACH = 4096, 32
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: 0 white space, 1 letters, digits and bytes of other characters, 2 punctuation and controls.
_CLASS = np.array([0 if ragged.SEPARATOR[b] else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of STATISTICS for each text."""
    starts, ends, first = ragged.words(buf, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)), np.int64)
    out[:, 0] = np.diff(first)
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    out[:, 1] = ragged.sums(points[ends] - points[starts], first)
    out[:, 2] = ragged.sums(_IS_SYMBOL[buf], offsets)
    out[:, 3] = _repeated_lines(buf, offsets, starts)
    out[:, 4] = _repeated_window_words(ragged.span_hashes(buf, starts, ends), first)
    return out


def _keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return ragged.mix64(hashes + row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _repeated_lines(buf: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))  # a break at a text's end starts an empty line
    ends = np.sort(np.concatenate([offsets[1:], breaks]))
    row = np.searchsorted(offsets[1:], ends, "left")
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends, row = starts[full], ends[full], row[full]
    key = _keyed(ragged.span_hashes(buf, starts, ends), row)
    _, at = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[at], minlength=rows)


def _repeated_window_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that lie in a window which the text has at least twice."""
    n, row = len(hashes), ragged.row_of(first)
    if n < WINDOW:
        return np.zeros(len(first) - 1, np.int64)
    windows = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - WINDOW + 1 + k]
    inside = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    _, which, count = np.unique(_keyed(windows[inside], row[inside]), return_inverse=True, return_counts=True)
    again = inside[count[which] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return ragged.sums(np.cumsum(cover[:-1]) > 0, first)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def ngram_buckets(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' unigrams and bigrams, and the texts' first indices."""
    kind = _CLASS[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    token = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[token], ends[token]
    hashes = ragged.span_hashes(ragged.LOWER[buf], starts, ends)
    first = np.searchsorted(starts, offsets)
    grams = np.empty((len(hashes), 2), np.uint64)
    grams[:, 0], grams[:, 1] = hashes, hashes
    row = ragged.row_of(first)
    pair = np.flatnonzero(row[1:] == row[:-1])
    grams[pair, 1] = ragged.mix64(hashes[pair] * np.uint64(3) + hashes[pair + 1])
    keep = np.ones((len(hashes), 2), bool)
    keep[:, 1] = False
    keep[pair, 1] = True
    flat = (grams[keep] % np.uint64(buckets)).astype(np.int64)
    per_row = 2 * np.diff(first) - (np.diff(first) > 0)
    return flat, np.r_[0, np.cumsum(per_row)]


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        flat, first = ngram_buckets(buf, offsets, len(self.ratio))
        return ragged.sums(self.ratio[flat], first) / np.maximum(np.diff(first), 1)


def log_ratio(trusted: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """log of the trusted multinomial over the raw one, both smoothed towards the raw shares."""
    share = (raw + 1e-3) / (raw + 1e-3).sum()
    if not trusted.sum():
        return np.zeros(len(raw))
    return np.log((trusted + smoothing * share * len(raw)) / (trusted.sum() + smoothing * len(raw))) - np.log(share)


def trusted_ids(labels: DataFrame, rows: int, key: str = "doc_id") -> np.ndarray:
    """Sorted hashes of trusted documents' ids, at most `rows`, the smallest ones."""
    good = labels.select(_hashed(key).alias("id"), "quality", "toxic").where("id is not null").groupBy("id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")).where("q = 1 and t = 0")
    some = good.select("id").orderBy("id").limit(rows)
    return np.sort(some.toArrow().column(0).to_numpy())


def _hashed(key: str) -> Column:
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(_hashed(key).alias("key"), F.col(text).alias("text"))


def _trusted(ids: np.ndarray, keys: pa.Array) -> np.ndarray:
    """0 for others, 1 or 2 for trusted documents: their halves."""
    at = keys.fill_null(0).to_numpy(zero_copy_only=False)
    if not len(ids):
        return np.zeros(len(at), np.int64)
    found = (ids[np.minimum(np.searchsorted(ids, at), len(ids) - 1)] == at) & ~keys.is_null().to_numpy(zero_copy_only=False)
    return np.where(found, 1 + (ragged.mix64(at.astype(np.uint64)) & np.uint64(1)).astype(np.int64), 0)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int = 1 << 16, trusted_rows: int = 1 << 18, smoothing: float = 0.5, miss: float = 0.002) -> Model:
    """Count both multinomials and set the threshold. At most 3 x buckets counts and 2 x REACH x STEPS cells reach the driver."""
    ids = docs.sparkSession.sparkContext.broadcast(trusted_ids(labels, trusted_rows, key))
    rows = _rows(docs, key, text)

    def count(batches):
        total = np.zeros(3 * buckets, np.int64)
        for batch in batches:
            half = _trusted(ids.value, batch.column(0))
            for lo, hi, buf, offsets in ragged.slices(batch.column(1)):
                flat, first = ngram_buckets(buf, offsets, buckets)
                total[:buckets] += np.bincount(flat, minlength=buckets)
                own = np.repeat(half[lo:hi], np.diff(first))
                if own.any():
                    total += np.bincount(flat[own > 0] + own[own > 0] * buckets, minlength=3 * buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    cells = map_batches(rows, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(3 * buckets)
    counts[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    raw, *halves = counts.reshape(3, buckets)
    if not halves[0].sum() + halves[1].sum():
        return Model(np.zeros(buckets), -np.inf)
    across = docs.sparkSession.sparkContext.broadcast([Model(log_ratio(2 * halves[1 - k], raw, smoothing), 0) for k in (0, 1)])

    def held_out(batches):
        total = np.zeros(2 * REACH * STEPS, np.int64)
        for batch in batches:
            half = _trusted(ids.value, batch.column(0))
            for k in (0, 1):
                for _, _, buf, offsets in ragged.slices(batch.column(1).filter(pa.array(half == k + 1))):
                    scores = across.value[k].scores(buf, offsets)[~base_failed(statistics(buf, offsets))]
                    total += np.bincount(np.clip(np.floor((scores + REACH) * STEPS), 0, len(total) - 1).astype(np.int64), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    cells = map_batches(rows, held_out, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    cell, below = cells.column(0).to_numpy(), np.cumsum(cells.column(1).to_numpy())
    threshold = cell[np.searchsorted(below, miss * (below[-1] - 1), "right")] / STEPS - REACH if len(cell) else -np.inf
    return Model(log_ratio(halves[0] + halves[1], raw, smoothing), float(threshold))


def _judge(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, scores, base failures and verdicts of an Arrow array of texts."""
    stats, scores = [np.zeros((0, len(STATISTICS)), np.int64)], [np.zeros(0)]
    for _, _, buf, offsets in ragged.slices(texts):
        stats.append(statistics(buf, offsets))
        scores.append(model.scores(buf, offsets))
    stats, scores = np.concatenate(stats), np.concatenate(scores)
    failed = base_failed(stats)
    return stats, scores, failed, ~failed & (scores >= model.threshold)


def judge(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, the statistics, base_failed, kept and score."""
    rows, shared = docs.select(F.col(key), F.col(text).alias("__text")), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            stats, scores, failed, kept = _judge(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in stats.T), pa.array(failed), pa.array(kept), pa.array(scores)], names=[key, *STATISTICS, "base_failed", "kept", "score"])

    kinds = ", ".join(f"{n} long" for n in STATISTICS)
    return map_batches(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {kinds}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_judge(shared.value, batch.column(at))[3]))

    return map_batches(docs, run, docs.schema)
