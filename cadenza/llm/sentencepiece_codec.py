"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker, unigram scores or
score-ordered merges, unknown token and byte fallback are rebuilt as a tokenizers pipeline.
If no piece has a marker after another character, the text falls apart before each run of
markers, so distinct chunks are encoded once, in multithreaded batches, and put together.
Ids are decoded from a table of the pieces' bytes. `parity` names the texts on which this differs from the
sentencepiece library. That library adds up a text's unigram scores as 32-bit floats, so far into a long text it
decides between paths of nearly equal score by rounding; here each is decided by its own sum.

Defined results: null and empty texts have no ids and come back as the empty text. Texts whose
normalisation isn't the identity come back normalised (`round_trip` is then false). Repeated rows
give repeated results, an empty table no row. Texts of any length are encoded whole. Columns other than those
asked for are not read, so their names don't matter.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .storage import map_batches, worker_cache
from .word_encode import Pool, encode_joined

MARK = "▁"
#: Piece types and model types of the SentencePiece format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def protobuf_fields(blob: bytes):
    """Yield (field number, value): numbers of varint and fixed fields, bytes of length-delimited ones."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        elif tag & 7 == 2:
            size = varint()
            value, at = blob[at : at + size], at + size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            value, at = struct.unpack("<d" if size == 8 else "<f", blob[at : at + size])[0], at + size
        else:
            raise ValueError("not a protobuf of this format")
        yield tag >> 3, value


@dataclass
class Spec:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def read(cls, path: str) -> Spec:
        out = cls()
        with open(path, "rb") as file:
            blob = file.read()
        for number, value in protobuf_fields(blob):
            if number == 1:
                f = dict(protobuf_fields(value))
                out.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                f = dict(protobuf_fields(value))
                out.kind, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(protobuf_fields(value))
                out.charsmap, out.dummy_prefix, out.squeeze, out.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if out.kind not in (UNIGRAM, BPE) or not out.escape:
            raise ValueError(f"{path}: only unigram and BPE models that escape white space")
        return out


def model_alone(spec: Spec):
    """The tokenizers model without normaliser: unigram scores, or merges in order of score, and byte fallback."""
    from tokenizers import Tokenizer, models

    ids = {piece: k for k, (piece, _, _) in enumerate(spec.pieces)}
    unknown = next(k for k, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN)
    if spec.kind == UNIGRAM:
        return Tokenizer(models.Unigram([(p, s if kind in (NORMAL, USER_DEFINED) else -1e9) for p, s, kind in spec.pieces], unknown, spec.byte_fallback))
    usable = {p for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)}
    merges = [(-s, ids[p], ids[p[:k]], ids[p[k:]]) for p, s, _ in spec.pieces if p in usable for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    pairs = [(spec.pieces[a][0], spec.pieces[b][0]) for *_, a, b in sorted(merges)]
    return Tokenizer(models.BPE(ids, pairs, unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback))


def build(spec: Spec):
    """The whole pipeline for a model: normaliser, marker, model and decoder."""
    from tokenizers import Regex, decoders, normalizers

    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] if spec.dummy_prefix else []
    whole = model_alone(spec)
    whole.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    own = [p for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if own:
        whole.add_tokens(own)
    return whole


class Codec:
    """Encodes batches of texts and decodes ids for one model file."""

    def __init__(self, path: str):
        self.spec = Spec.read(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"  # whatever another operator left in this worker
        alone = model_alone(self.spec)
        own = any(kind == USER_DEFINED for *_, kind in self.spec.pieces)
        self.chunked = not own and not any(MARK in p.lstrip(MARK) for p, _, kind in self.spec.pieces if kind == NORMAL)
        self.plain = not self.spec.charsmap and not self.spec.squeeze and self.spec.dummy_prefix
        first = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces], bool)

        def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
            marked = np.array([MARK in c for c in chunks], bool)  # with several markers, encoded one by one
            n, found = np.zeros(len(chunks), np.int64), {}
            for kind in (False, True):
                some = [MARK + c for c, x in zip(chunks, marked, strict=True) if x == kind]
                if some:
                    found[kind], n[marked == kind] = encode_joined(alone, some, first, False, 1 if kind else 64)
            out, mine = np.empty(int(n.sum()), np.int32), np.repeat(marked, n)
            for kind, ids in found.items():
                out[mine == kind] = ids
            return out, n

        self.pool = Pool(encode, limit=1 << 17)
        table = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.spec.pieces]
        self.length = np.array([len(x) for x in table], np.int64)
        self.start, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(table), np.uint8)

    @cached_property
    def whole(self):
        return build(self.spec)

    def _chunks(self, text: str) -> list[str]:
        """What follows the first marker of each chunk of the normalised text."""
        if not self.plain:
            text = self.whole.normalizer.normalize_str(text)[1:] if text else text
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for k, part in enumerate(parts):
            if part or k == len(parts) - 1:
                out.append(MARK * run + part)
                run = 0
            else:
                run += 1
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        if self.chunked and self.spec.dummy_prefix:
            return self.pool([self._chunks(t) for t in texts])
        found = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, without the marker put before it; stray bytes stay as they are."""
        flat = ragged.gather(self.bytes, self.start[ids], self.length[ids]).tobytes()
        ends = np.cumsum(ragged.sums(self.length[ids], np.r_[0, np.cumsum(counts)]))
        parts = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        if not (self.spec.squeeze or self.spec.dummy_prefix):
            return parts
        return [x[self._leading(ids[a:b]) :] for x, a, b in zip(parts, [0, *np.cumsum(counts)[:-1].tolist()], np.cumsum(counts).tolist(), strict=True)]

    def _leading(self, ids: np.ndarray) -> int:
        """How many markers at the start of a text are dropped: the first; where white space is squeezed, one of each piece as long as there is no text."""
        dropped = 0
        for k in ids.tolist():
            piece, _, kind = self.spec.pieces[k]
            if kind == CONTROL:
                continue
            if kind not in (NORMAL, USER_DEFINED) or not piece.startswith(MARK):
                break
            dropped += 1
            if piece != MARK or not self.spec.squeeze:
                break
        return dropped


@worker_cache
def load(path: str) -> Codec:
    return Codec(path)


def parity(path: str, texts: list[str]) -> list[int]:
    """Positions of texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=path), load(path)
    flat, n = ours.encode(texts)
    ids = np.split(flat, np.cumsum(n)[:-1])
    back = ours.decode(flat, n)
    return [k for k, (text, own) in enumerate(zip(texts, ids, strict=True)) if theirs.encode(text) != own.tolist() or theirs.decode(own.tolist()) != back[k].decode("utf-8", "replace")]


def encode_documents(docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ids, n_tokens, ids_crc32 (as little-endian unsigned 32-bit integers) and round_trip."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))

    def run(batches):
        codec = load(model)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                flat, n = codec.encode(part)
                cut = np.r_[0, np.cumsum(n)]
                sums = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                same = [back == t.encode() for back, t in zip(codec.decode(flat, n), part, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), ids, pa.array(n), pa.array(sums, pa.int64()), pa.array(same)], names=[key, "ids", "n_tokens", "ids_crc32", "round_trip"])

    return map_batches(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean", cache=load)


def decode_documents(encoded: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per input row: key and text. Null ids give the empty text."""
    rows = encoded.select(F.col(key), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))

    def run(batches):
        codec = load(model)
        for batch in batches:
            lists = batch.column(1)
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in codec.decode(flat, n)], pa.string())], names=[key, "text"])

    return map_batches(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, text string", cache=load)
