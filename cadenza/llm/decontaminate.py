"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased (A-Z); shingles are five words, or the whole item if it has fewer. Every item
and every window with as many shingles as the item gets a 64-bit SimHash of its shingles, each
weighted by its occurrences. Fingerprints are split into four blocks of 16 bits: two within
`RADIUS` = 15 bits agree in some block up to 3 bits, so an index of all block values within 3 bits
of an item's finds every window in radius. Found pairs are verified by exact weighted-shingle
similarity, the sum of the lesser over the sum of the greater counts.

A window without any shingle of any item has similarity 0, whatever its fingerprint, so windows
are laid only where an item's shingle stands nearby; this loses nothing. A text shorter than an
item is one window. Items are taken in blocks of at most `items` items and about 8 MB of text (an index
of about 35 MB), `together` blocks at a time; between two such passes the rows are written, and the blocks
of a pass are destroyed before those of the next are sent.

Defined results: null and empty texts and items match nothing. Equal items are reported each.
Repeated rows give repeated results. A null item id is reported as null. An empty table gives no row, an
empty benchmark no match. A similarity of exactly `SIMILARITY` counts. Texts of any length are scanned whole.
Columns other than key and text are not read when scanning, and passed on by keep_clean whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .storage import discard, map_batches, materialize

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
_WIDTH, _LEADING = 64 // BLOCKS, 20


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of ragged word hashes, and the rows' first indices."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros_like(first)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    out = ragged.mix64(out)
    per_row = np.maximum(np.diff(first) - k + 1, 0)
    start = np.r_[0, np.cumsum(per_row)]
    return ragged.gather(out, first[:-1], per_row), start


def simhash(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all windows of `size` hashes: a bit is set if it is in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    kind = np.uint8 if size < 256 else np.uint16 if size < 1 << 16 else np.int64  # differences are right modulo their range
    total = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    return np.packbits(total[size:] - total[: len(total) - size] > size // 2, bitorder="little").view("<u8")


def block_neighbours(radius: int) -> np.ndarray:
    """All block patterns with at most `radius` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(_WIDTH), n)], np.int64)


@dataclass
class Block:
    """Items of one block: ids, shingle length and count, fingerprints, shingle counts, and the two indexes."""

    ids: list
    k: np.ndarray
    size: np.ndarray
    fingerprints: np.ndarray
    counts: list[Counter]
    shingles: dict[int, np.ndarray]
    keys: np.ndarray
    owners: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[object, str]]) -> Block | None:
        ids, k, size, prints, counts, known = [], [], [], [], [], {}
        for item, text in items:
            (_, _, buf, offsets), *_ = ragged.slices(pa.array([text or ""]))
            buf = ragged.LOWER[buf]
            starts, ends, first = ragged.words(buf, offsets)
            if not len(starts):
                continue
            k.append(min(SHINGLE, len(starts)))
            hashes, _ = shingle_hashes(ragged.span_hashes(buf, starts, ends), first, k[-1])
            ids.append(item)
            size.append(len(hashes))
            prints.append(simhash(hashes, len(hashes))[0])
            counts.append(Counter(hashes.tolist()))
            known.setdefault(k[-1], []).append(hashes)
        if not ids:
            return None
        k, size, prints = np.array(k), np.array(size), np.array(prints, np.uint64)
        near = block_neighbours(RADIUS // BLOCKS)
        parts = [_keys(k, size, b, ((prints >> np.uint64(b * _WIDTH)) & np.uint64(0xFFFF)).astype(np.int64))[:, None] ^ near for b in range(BLOCKS)]
        keys = np.concatenate([p.ravel() for p in parts])
        owners = np.tile(np.repeat(np.arange(len(ids)), len(near)), BLOCKS)
        order = np.argsort(keys, kind="stable")
        return cls(ids, k, size, prints, counts, {x: np.unique(np.concatenate(h)) for x, h in known.items()}, keys[order], owners[order].astype(np.int32))

    def _leading(self, k: int) -> np.ndarray:
        """A table of the leading bits of all shingles of this length, made where it is used."""
        tables = self.__dict__.setdefault("_tables", {})
        if k not in tables:
            tables[k] = np.zeros(1 << _LEADING, bool)
            tables[k][self.shingles[k] >> np.uint64(64 - _LEADING)] = True
        return tables[k]

    def pairs(self, prints: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of this size within RADIUS."""
        found = []
        for b in range(BLOCKS):
            key = _keys(k, size, b, ((prints >> np.uint64(b * _WIDTH)) & np.uint64(0xFFFF)).astype(np.int64))
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            at = np.flatnonzero(hi > lo)
            item = ragged.gather(self.owners, lo[at], (hi - lo)[at])
            window = np.repeat(at, (hi - lo)[at])
            near = np.bitwise_count(prints[window] ^ self.fingerprints[item]) <= RADIUS
            found.append(window[near] * len(self.ids) + item[near])
        both = np.unique(np.concatenate(found))
        return both // len(self.ids), both % len(self.ids)

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[int, dict[int, float]]:
        """For each row with a match: items and their best similarity."""
        out: dict[int, dict[int, float]] = {}
        for k, own in self.shingles.items():
            hashes, start = shingle_hashes(words, first, k)
            at = np.flatnonzero(self._leading(k)[hashes >> np.uint64(64 - _LEADING)])
            at = at[own[np.minimum(np.searchsorted(own, hashes[at]), len(own) - 1)] == hashes[at]]
            sizes = np.unique(self.size[self.k == k])
            row = np.searchsorted(start, at, "right") - 1
            reach = int(sizes.max()) - 1
            lo, hi = np.maximum(at - reach, start[row]), np.minimum(at + reach + 1, start[row + 1])
            new = np.r_[True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])] if len(at) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            lo, hi, row = lo[heads], np.maximum.reduceat(hi, heads) if len(heads) else hi, row[heads]
            for size in sizes:
                self._windows(hashes, start, lo, hi, row, k, int(size), out)
        return out

    def _windows(self, hashes, start, lo, hi, row, k, size, out) -> None:
        length = hi - lo
        whole = (length < size) & (length == start[row + 1] - start[row]) & (length >= SIMILARITY * size)
        for wanted in (np.flatnonzero(length >= size), *np.flatnonzero(whole)[:, None]):
            if not len(wanted):
                continue
            n = min(size, int(length[wanted].min()))
            flat = ragged.gather(hashes, lo[wanted], length[wanted])
            region = np.repeat(wanted, length[wanted])
            inside = np.flatnonzero(region[: len(flat) - n + 1] == region[n - 1 :])
            window, item = self.pairs(simhash(flat, n)[inside], k, size)
            for w, i in zip(inside[window].tolist(), item.tolist(), strict=True):
                found = out.setdefault(int(row[region[w]]), {})
                if (s := similarity(Counter(flat[w : w + n].tolist()), self.counts[i])) >= max(SIMILARITY, found.get(i, 0)):
                    found[i] = s


def _keys(k, size, block: int, value: np.ndarray) -> np.ndarray:
    return ((np.int64(size) * 8 + k) * BLOCKS + block << _WIDTH) + value


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle counts."""
    less = (a & b).total()
    return less / (a.total() + b.total() - less)


def blocks(benchmark: DataFrame, *, key: str = "item_id", text: str = "text", items: int = 1024, size: int = 8 << 20) -> Iterator[Block]:
    """The benchmark's items in blocks of at most `items` items and about `size` characters."""
    held, held_size = [], 0
    for row in benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        held.append((row.i, row.t))
        held_size += len(row.t)
        if len(held) >= items or held_size >= size:
            if block := Block.build(held):
                yield block
            held, held_size = [], 0
    if held and (block := Block.build(held)):
        yield block


def _scan(texts: pa.Array, own: list[Block]) -> Iterator[tuple[int, int, dict[int, float]]]:
    """Rows with a match in a block: (row, block, items and their similarities). Words are hashed once for all blocks."""
    for lo, _, buf, offsets in ragged.slices(texts):
        buf = ragged.LOWER[buf]
        starts, ends, first = ragged.words(buf, offsets)
        words = ragged.span_hashes(buf, starts, ends)
        for k, block in enumerate(own):
            for row, found in block.matches(words, first).items():
                if found:
                    yield lo + row, k, found


def _passes(docs: DataFrame, benchmark: DataFrame, item_key: str, run, schema, together: int, items: int) -> DataFrame:
    """Apply `run` with `together` blocks at a time. What a pass but the last gives is written, and its blocks are destroyed,
    so driver and executors hold the blocks of one pass, however large the benchmark is."""
    sc, made, last = docs.sparkSession.sparkContext, blocks(benchmark, key=item_key, items=items), None
    some = list(islice(made, together))
    while some:
        after = list(islice(made, together))
        shared = sc.broadcast(some)
        docs = map_batches(docs, partial(run, shared), schema)
        if after:
            written = materialize(docs, "scanned")
            shared.destroy()
            if last is not None:
                discard(last)
            docs = last = written
        some = after
    return docs


def find(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", together: int = 4, items: int = 1024) -> DataFrame:
    """One row per input row: key, contaminated, n_items, item_ids (ascending) and max_similarity (null without a match)."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.array().cast(f"array<{item_kind}>").alias("items"), F.lit(None).cast("double").alias("best"))

    def run(shared, batches):
        for batch in batches:
            found, best = {}, {}
            for row, k, similar in _scan(batch.column(1), shared.value):
                found.setdefault(row, []).extend(shared.value[k].ids[i] for i in sorted(similar))
                best[row] = max(best.get(row, 0.0), *similar.values())
            columns = batch.columns
            if found:
                had, most = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                columns[2] = pa.array([x + found.get(k, []) for k, x in enumerate(had)], batch.schema.field(2).type)
                columns[3] = pa.array([max(x or 0.0, best[k]) if k in best else x for k, x in enumerate(most)], pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=["key", "text", "items", "best"])

    rows = _passes(rows, benchmark, item_key, run, rows.schema, together, items)
    return rows.select(F.col("key").cast(kind).alias(key), (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), F.col("best").alias("max_similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", together: int = 4, items: int = 1024) -> DataFrame:
    """The rows without a match, with all their columns."""
    at = docs.columns.index(text)

    def run(shared, batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, *_ in _scan(batch.column(at), shared.value)]] = False
            yield batch.filter(pa.array(clean))

    return _passes(docs, benchmark, item_key, run, docs.schema, together, items)
