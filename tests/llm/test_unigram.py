"""The unigram half of the SentencePiece codec: small models written by hand, held against the sentencepiece library."""

from __future__ import annotations

import math
import random
import struct
from collections import Counter

import pytest
import sentencepiece
from cadenza.llm import queries
from cadenza.llm import sentencepiece_codec as codec
from tests.conftest import SF

MARK = codec.MARK
TEXTS = ["", " ", "a", "  two  spaces ", "ﬁne ½ Ａｂｃ ① ﷺ", "tab\tand\nline", "日本語 🎵 é é", "x" * 300, "▁marked▁text", "ends in space "]


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def message(number, blob):
    return varint(number << 3 | 2) + varint(len(blob)) + blob


def number(field, value):
    return varint(field << 3) + varint(value)


def charsmap():
    blob = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return dict(codec.protobuf_fields(dict(codec.protobuf_fields(blob))[3]))[2]


def write_model(path, words, *, byte_fallback, squeeze, dummy, charsmap=b""):
    """A unigram model of frequent words, their characters and pairs, with scores from counts."""
    pieces = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, codec.BYTE) for b in range(256)] * byte_fallback
    counts = Counter()
    for w, n in words.items():
        whole = MARK + w
        counts[whole] += n
        for size in (1, 2, 3):
            for k in range(len(whole) - size + 1):
                if MARK not in whole[k + 1 : k + size]:
                    counts[whole[k : k + size]] += n / (4 * size)
    total = sum(counts.values())
    rng = random.Random(5)  # no two paths tie, as the library adds up 32-bit floats
    pieces += [(p, math.log(n / total) - rng.random() / 100, codec.NORMAL) for p, n in sorted(counts.items())]
    blob = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, kind)) for p, s, kind in pieces)
    blob += message(2, number(3, codec.UNIGRAM) + number(35, byte_fallback))
    blob += message(3, message(1, b"own") + message(2, charsmap) + number(3, dummy) + number(4, squeeze) + number(5, 1))
    path.write_bytes(blob)
    return str(path)


@pytest.fixture(scope="module")
def documents(spark):
    return [r.text for r in queries.table(spark, SF, "documents").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def words(documents):
    return dict(Counter(w for t in documents for w in t.split()).most_common(800))


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize(("squeeze", "dummy"), [(True, True), (False, True), (False, False)])
def test_unigram_parity(tmp_path, documents, words, fallback, squeeze, dummy):
    path = write_model(tmp_path / "unigram.model", words, byte_fallback=fallback, squeeze=squeeze, dummy=dummy)
    texts = [t for t in documents if len(t) < 1500][:60] + TEXTS  # see the codec on long texts
    assert [texts[k][:40] for k in codec.parity(path, texts)] == []


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_parity_with_a_character_map(tmp_path, documents, words, fallback):
    path = write_model(tmp_path / "mapped.model", words, byte_fallback=fallback, squeeze=True, dummy=True, charsmap=charsmap())
    texts = [t for t in documents if len(t) < 1500][:60] + TEXTS  # see the codec on long texts
    assert [texts[k][:40] for k in codec.parity(path, texts)] == []


def test_unigram_query(spark, tmp_path, documents, words):
    """Through the operator: ids of every short document equal the library's, and decoding gives its normalised text."""
    path = write_model(tmp_path / "unigram.model", words, byte_fallback=True, squeeze=True, dummy=True, charsmap=charsmap())
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = queries.table(spark, SF, "documents")
    out = codec.encode_documents(docs, path)
    back = {r.doc_id: r.text for r in codec.decode_documents(out, path).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in out.collect() if len(text[r.doc_id]) < 1500]
    assert len(rows) > 50
    for r in rows:
        assert r.ids == theirs.encode(text[r.doc_id]) and back[r.doc_id] == theirs.decode(r.ids)


def test_bpe_parity_on_every_document_of_a_table(spark):
    import public_tokenizers

    texts = [r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    assert len(texts) >= 1000 and codec.parity(public_tokenizers.path("piece_bpe_32k.model"), texts) == []
