"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

The library's pre-tokenisation splits each text; distinct pre-tokens of a batch are laid out as
one flat symbol array. In each round every pre-token merges all occurrences of its own
lowest-ranked pair, all pre-tokens at once; when no pair is left, the surviving symbols are
counted. Merges only make pairs of higher rank, so this equals merging one pair at a time.

Defined results: null is the empty text with no bytes and no tokens. Strings of added tokens
inside a text count as one token, the library's default. Any text length works; counts of
pre-tokens seen before are remembered in a table of bounded size. Repeated rows give repeated
results, and columns other than key and text are not read.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, worker_cache

#: The split pattern of the public byte-level pre-tokeniser, with \s as the Unicode White_Space property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class ByteBpe:
    """Merge ranks of a byte-level BPE in the tokenizers library's JSON format, and a bounded memory of counts."""

    def __init__(self, path: str, remember: int = 1 << 20):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, shape = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or shape["type"] != "ByteLevel" or shape["add_prefix_space"] or not shape["use_regex"] or spec["normalizer"] or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or any(model.get(k) for k in ("ignore_merges", "end_of_word_suffix", "continuing_subword_prefix", "dropout", "byte_fallback")):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split, self.remember, self.known, self.missed = regex.compile(PATTERN), remember, {}, 0

    def _ranks(self, left: np.ndarray, right: np.ndarray, inside: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(inside & (self.keys[at] == key), self.rank[at], _NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces in one array, and the pieces' first indices."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_symbol, done_owner = [], []
        while len(symbol) > 1:
            rank = np.full(len(symbol), _NO_RANK, np.int32)
            rank[:-1] = self._ranks(symbol[:-1], symbol[1:], owner[:-1] == owner[1:])
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, heads)
            counts = np.diff(np.r_[heads, len(symbol)])
            lowest = np.repeat(lowest, counts)
            busy = lowest != _NO_RANK
            done_symbol.append(symbol[~busy])
            done_owner.append(owner[~busy])
            symbol, owner, rank, lowest = symbol[busy], owner[busy], rank[busy], lowest[busy]
            if not len(symbol):
                break
            at = np.flatnonzero(rank == lowest)
            run = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])]  # of a pair like (a, a) every other one merges
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, owner = symbol[stays], owner[stays]
        done_symbol.append(symbol)
        done_owner.append(owner)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def _learn(self, pieces: set[str]) -> None:
        batch, size = [], 0
        for piece in chain(pieces, (None,)):
            if piece is not None:
                batch.append(piece)
                size += len(piece)
            if batch and (piece is None or size > 1 << 16):
                _, first = self.merge([x.encode() for x in batch])
                self.known.update(zip(batch, np.diff(first).tolist(), strict=True))
                batch, size = [], 0

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        found, extra = [], []
        for text in texts:
            parts = self.added.split(text) if self.added else [text]
            extra.append(len(parts) - 1)
            found.append(self.split.findall(parts[0]) if len(parts) == 1 else [x for p in parts for x in self.split.findall(p)])
        seen = set().union(*found)
        fresh = {x for x in seen if x not in self.known}
        full = len(self.known) + len(fresh) > self.remember
        if full:  # what is known, mostly the frequent pieces, stays until as many others have missed it
            self.missed += len(fresh)
            if self.missed > self.remember:
                self.known.clear()
                self.missed, fresh, full = 0, seen, False
        self._learn(fresh)
        of = self.known.__getitem__
        out = [sum(map(of, pieces)) + more for pieces, more in zip(found, extra, strict=True)]
        if full:
            for x in fresh:
                del self.known[x]
        return out


@worker_cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens and over_limit. `tokenizer` is the path of a JSON file on every machine."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"))

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            texts, sizes, numbers = batch.column(1).fill_null(""), [], []
            for lo in range(0, len(texts), 256):
                part = texts.slice(lo, 256).to_pylist()
                sizes += [len(t.encode()) for t in part]
                numbers += bpe.counts(part)
            n = pa.array(numbers, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([x > limit for x in numbers], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", cache=load)
