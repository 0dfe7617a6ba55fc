"""Token ids as directly addressable codes in segment files.

An id array is split into chunks of `bits` bits. Level 0 holds every id's lowest chunk, level
k+1 the next chunk of those ids that have one; a bitmap at each level marks the ids that go on,
and a rank directory holds the number of marks before each block of 512. An id's place at the
next level is the rank of its mark, so any token is read by at most `levels` lookups, without
decoding what stands around it.

Files: texts are encoded where they are read, and the ids written to the shared folder once. Rows of ids are
then dealt by ranges of (key, hash of the ids, row), so rows that share a key, or the null key, spread over
tasks too; the number of ranges comes from the number of ids. Sorted ranges are packed into segments of whole
documents (about `segment_ids` ids each). A segment is one row of a Parquet file, written by Spark's
committer, so a lost executor or a task run twice leaves no broken or double file.

Defined results: null is the empty text, which has the end id only. Rows with equal keys come in order of a
hash of their ids; rows that are equal in both are alike. Null keys come first. An empty table gives no
segment. A text of any length is one document; its ids must fit in memory. Only key and text are read, so
other columns' names don't matter.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .storage import discard, map_batches, materialize, shared_folder, worker_cache
from .word_encode import Pool, encode_joined

BLOCK = 512
MAGIC = b"DAC1"


def _pack_bits(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the bitmap, and the number of marks before each block."""
    words = np.zeros(-(-len(marks) // BLOCK) * BLOCK // 8, np.uint8)
    words[: -(-len(marks) // 8)] = np.packbits(marks, bitorder="little")
    words = words.view("<u8")
    per_block = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
    return words, (np.cumsum(per_block, dtype=np.uint32) - per_block).astype("<u4")


def dac_encode(ids: np.ndarray, bits: int = 8) -> bytes:
    """Header (magic, bits, levels, level lengths), then each level's chunks, bitmap and rank directory."""
    rest, levels = np.asarray(ids, np.uint32), []
    dtype = np.dtype("<u1" if bits <= 8 else "<u2")
    while True:
        marks = rest >> np.uint32(bits) > 0
        chunks = (rest & np.uint32((1 << bits) - 1)).astype(dtype)
        levels.append((chunks, *_pack_bits(marks)))
        if not marks.any():
            break
        rest = rest[marks] >> np.uint32(bits)
    head = MAGIC + bytes([bits, len(levels)]) + np.array([len(x[0]) for x in levels], "<u4").tobytes()
    return head + b"".join(part.tobytes() for level in levels for part in level)


class Dac:
    """Random access to an encoded id array."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.bits, count = blob[4], blob[5]
        sizes = np.frombuffer(blob, "<u4", count, 6)
        at, dtype = 6 + 4 * count, np.dtype("<u1" if self.bits <= 8 else "<u2")
        self.levels, self.size = [], int(sizes[0])
        for n in map(int, sizes):
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(blob, dtype, n, at)
            at += chunks.nbytes
            words = np.frombuffer(blob, "<u8", blocks * (BLOCK // 64), at)
            at += words.nbytes
            ranks = np.frombuffer(blob, "<u4", blocks, at)
            at += ranks.nbytes
            self.levels.append((chunks, words, ranks))

    def __getitem__(self, at) -> np.ndarray:
        """The ids at these positions, in any order: at each level one chunk, one rank and at most eight words of the bitmap."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (chunks, words, ranks) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(self.bits * k)
            goes_on = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            if not goes_on.any():
                break
            at, who = at[goes_on], who[goes_on]
            at = self._rank(words, ranks, at)
        return out

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks before each position."""
        block = words.reshape(-1, BLOCK // 64)[at >> 9]
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        place, column = (at >> 6 & 7)[:, None], np.arange(BLOCK // 64)[None]
        marks = np.bitwise_count(np.where(column < place, block, np.where(column == place, block & low[:, None], np.uint64(0))))
        return ranks[at >> 9].astype(np.int64) + marks.sum(1, dtype=np.int64)

    def range(self, lo: int, hi: int) -> np.ndarray:
        """The ids at lo, ..., hi - 1: a run of neighbours is a run at every level."""
        out, who = np.zeros(hi - lo, np.uint32), slice(None)
        for k, (chunks, words, ranks) in enumerate(self.levels):
            if lo == hi:
                break
            out[who] |= chunks[lo:hi].astype(np.uint32) << np.uint32(self.bits * k)
            marks = np.unpackbits(words.view(np.uint8)[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo] > 0
            n = int(marks.sum())
            if not n:
                break
            who = np.flatnonzero(marks) if k == 0 else who[marks]
            lo = int(self._rank(words, ranks, np.array([lo]))[0])
            hi = lo + n
        return out


#: Runs of letters, single digits and runs of signs of lower-cased Latin-1, and its characters that aren't simply one of these.
_PIECES = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\\s]+")
_APART = re.compile("['\x1c-\x1f\x80-\xbf\xd7\u0100-\U0010ffff]|<\\|")
_WORDS = re.compile("[^\x20\x09-\x0D]+")


def _words(text: str) -> list[str]:
    """Pieces that the tokenizer works on one by one: in texts of plain Latin-1 letters, digits and signs these, each apart, in
    lower case; else white-space separated words with A-Z in lower case. Where a special token's string may stand, words as they are."""
    if not _APART.search(text):
        return _PIECES.findall(text.lower())
    return _WORDS.findall(text if "<|" in text else text.encode().lower().decode())


@worker_cache
def _pool(path: str) -> Pool:
    """Ids of words for a tokenizer that drops white space, puts A-Z in lower case and works on each word alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # every core has a task of its own
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), n

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart = np.zeros(len(words), bool)  # of several pieces, perhaps
        if _APART.search(" ".join(words)):
            apart[:] = [bool(_APART.search(w)) for w in words]
        if apart.all() or not last.any():
            return one_by_one(words)
        plain, n_plain = encode_joined(tokenizer, [w + " " for w, x in zip(words, apart, strict=True) if not x], last, True)
        if not apart.any():
            return plain, n_plain
        other, n_other = one_by_one([w for w, x in zip(words, apart, strict=True) if x])
        n = np.empty(len(words), np.int64)
        n[~apart], n[apart] = n_plain, n_other
        out = np.empty(int(n.sum()), np.int32)
        mine = np.repeat(apart, n)
        out[~mine], out[mine] = plain, other
        return out, n

    signs = [chr(c) for c in range(0x21, 0x180)]
    for probe in ("a b", " Ab\t\nc<|x|>  d' s", "é  é\x0c'll", *(f"a{c}B {c}{c}7{c} É{c}é" for c in signs)):
        if tokenizer.encode(probe, add_special_tokens=False).ids != encode(_words(probe))[0].tolist():
            raise ValueError(f"{path} doesn't encode word by word")
    return Pool(encode, limit=1 << 19)


def encode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """One row per input row: key, n (ids with the end id) and ids, as little-endian numbers of 16 bits, or 32 where the vocabulary needs them."""
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        pool = _pool(tokenizer)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo in range(0, len(texts), 128):
                flat, n = pool([_words(t) for t in texts.slice(lo, 128).to_pylist()])
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id).astype(width)
                cut = np.r_[0, np.cumsum(n + 1)] * flat.itemsize
                ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 128), pa.array(n + 1), ids, pa.array(np.full(len(n), flat.itemsize, np.int32))], names=["key", "n", "ids", "width"])

    return map_batches(rows, run, f"key {rows.schema[0].dataType.simpleString()}, n long, ids binary, width int", cache=_pool)


def write_ids(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, segment_ids: int = 1 << 20, partition_ids: int = 1 << 23, path: str | None = None) -> str:
    """Encode all texts and write segment files in ascending order of key; returns their folder. A task packs about `partition_ids` ids.

    Segments: part, segment (in order within part), first (ids before it in its part), n_docs,
    n_ids, keys (array), lengths (little-endian 32-bit numbers), codes.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    encoded = materialize(encode(docs, tokenizer, key=key, text=text, end_id=end_id), "encoded", compression="zstd")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, 1 + total // partition_ids)
    order = F.col("key").asc_nulls_first(), F.col("h").asc()
    rows = encoded.select("key", "n", "ids", "width", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, *order, F.col("row").asc()).sortWithinPartitions(*order).select("key", "n", "ids", "width")
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        keys, lengths, ids, held = [], [], [], 0

        def close():
            nonlocal segment, first, held
            all_ids, n = np.concatenate(ids), np.concatenate(lengths)
            names = pa.concat_arrays(keys)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([len(n)], pa.int32()), pa.array([len(all_ids)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([n.astype("<u4").tobytes()], pa.binary()), pa.array([dac_encode(all_ids)], pa.binary())],
                names=["part", "segment", "first", "n_docs", "n_ids", "keys", "lengths", "codes"],
            )
            segment, first, held = segment + 1, first + len(all_ids), 0
            keys.clear(), lengths.clear(), ids.clear()
            return out

        for batch in batches:
            n = batch.column(1).to_numpy()
            lo = 0
            while lo < len(n):  # whole documents up to a segment's size
                hi = min(len(n), lo + 1 + int(np.searchsorted(np.cumsum(n[lo:]), segment_ids - held)))
                width = batch.column(3)[lo].as_py()
                ids.append(np.frombuffer(_bytes_of(batch.column(2).slice(lo, hi - lo)), f"<u{width}").astype(np.uint32))
                lengths.append(n[lo:hi])
                keys.append(batch.column(0).slice(lo, hi - lo))
                held, lo = held + len(ids[-1]), hi
                if held >= segment_ids:
                    yield close()
        if keys:
            yield close()

    map_batches(rows, run, f"part int, segment int, first long, n_docs int, n_ids long, keys array<{kind}>, lengths binary, codes binary").write.parquet(path, compression="zstd")
    discard(encoded)
    return path


def _bytes_of(column: pa.Array) -> bytes:
    """The concatenated values of a binary column."""
    wide = pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return data[int(ends[0]) : int(ends[-1])] if data is not None else b""


def part_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each part: one row for each part reaches the driver."""
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, before = {}, 0
    for part, n in totals:
        starts[part] = before
        before += n
    return starts


def read_ids(segments: DataFrame, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from segment files: key, start, n_tokens, ids_crc32 and, if asked for, ids."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    starts = part_starts(segments)
    columns = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, names, lengths, codes = (batch.column(k)[row] for k in range(5))
                dac, n = Dac(codes.as_py()), np.frombuffer(lengths.as_py(), "<u4").astype(np.int64)
                inside = np.concatenate([[0], np.cumsum(n)])
                for lo in range(0, len(n), 256):
                    hi = min(lo + 256, len(n))
                    ids = dac.range(int(inside[lo]), int(inside[hi])).astype("<u4")
                    cut = inside[lo : hi + 1] - inside[lo]
                    sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    out = [names.values.slice(lo, hi - lo), pa.array(starts[part.as_py()] + first.as_py() + inside[lo:hi]), pa.array(n[lo:hi]), pa.array(sums, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(out, names=columns)

    rows = segments.select("part", "first", "keys", "lengths", "codes")
    return map_batches(rows, run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
