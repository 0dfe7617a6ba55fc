"""Registered queries against brute force over every document: quality rules, SentencePiece, token counts, and values on odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
from cadenza.llm import decontaminate, near_dup, pii, quality, queries, ragged, secret_scan, sentencepiece_codec, token_count, token_output
from tests.conftest import SF

from .test_llm import ODD, by_id, odd  # noqa: F401


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    repeated = len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated


def hash_of(token: bytes) -> int:
    return int(ragged.span_hashes(np.frombuffer(token, np.uint8), np.array([0]), np.array([len(token)]))[0])


def grams_of(text, known={}):  # noqa: B006 - remembers hashes
    """Buckets of a text's tokens and pairs of tokens: runs of letters, digits and other characters, and runs of signs."""
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0D]+", text.encode())
    h = [known.setdefault(t, hash_of(t.lower())) for t in tokens]
    pairs = [int(ragged.mix64(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
    return [x % (1 << 16) for x in (*h, *pairs)]


def test_quality_query(spark):
    """Statistics, base rules, scores, threshold and verdict of every document, from counts written out."""
    docs = [(r.doc_id, r.text or "") for r in queries.table(spark, SF, "documents").collect()]
    labels = {}
    for r in queries.table(spark, SF, "labels").collect():
        labels.setdefault(r.doc_id, []).append((r.quality, r.toxic))
    trusted = {i for i, x in labels.items() if all(q == 1 and t == 0 for q, t in x)}
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long").selectExpr("doc_id", "xxhash64(CAST(doc_id AS STRING)) AS h").collect()
    half = {r.doc_id: int(ragged.mix64(np.array([r.h]).view(np.uint64))[0]) & 1 for r in ids}
    grams = {i: grams_of(t) for i, t in docs}
    raw, halves = Counter(), (Counter(), Counter())
    for i, _ in docs:
        raw.update(grams[i])
        if i in half:
            halves[half[i]].update(grams[i])
    size = 1 << 16
    total = sum(raw.values()) + 1e-3 * size

    def ratio(counts, times=1):
        n = times * sum(counts.values())
        return lambda b: log((times * counts[b] + 0.5 * size * (raw[b] + 1e-3) / total) / (n + 0.5 * size)) - log((raw[b] + 1e-3) / total)

    def score(of, i):
        return sum(map(of, grams[i])) / max(len(grams[i]), 1)

    stats = {i: brute_statistics(t) for i, t in docs}
    failed = {i: s[0] < 20 or 100 * s[4] > 30 * s[0] for i, s in stats.items()}
    across = (ratio(halves[1], 2), ratio(halves[0], 2))
    held_out = sorted(score(across[half[i]], i) for i, _ in docs if i in half and not failed[i])
    threshold = floor((held_out[floor(0.002 * (len(held_out) - 1))] + quality.REACH) * quality.STEPS) / quality.STEPS - quality.REACH
    whole = ratio(halves[0] + halves[1])
    got = by_id(queries.op4_quality_rules(spark, SF))
    for i, _ in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*stats[i], failed[i])
        assert r.score == pytest.approx(score(whole, i), abs=1e-9)
        if abs(r.score - threshold) > 1e-9:
            assert r.kept == (not failed[i] and r.score >= threshold)


def test_sentencepiece_query(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs, got = sentencepiece.SentencePieceProcessor(model_file=path), by_id(queries.op5_sentencepiece(spark, SF))
    for r in queries.table(spark, SF, "documents").collect():
        ids = theirs.encode(r.text or "")
        assert (got[r.doc_id].ids, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_token_count_query(spark):
    from tokenizers import Tokenizer

    tokenizer, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), by_id(queries.op9_token_count(spark, SF))
    for r in queries.table(spark, SF, "documents").collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(got[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 512)


def test_values_on_odd_rows(spark, odd):  # noqa: F811
    """Nulls as empty texts, the same values for the same texts, whatever their ids and other columns."""
    grammar = secret_scan.train(secret_scan.published_credentials())
    model = quality.train(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    made = {
        "secrets": secret_scan.scan(odd, grammar, key="text"), "pii": pii.digest(pii.find(odd, key="text"), key="text"), "quality": quality.judge(odd, model, key="text"), "counts": token_count.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), key="text"),
        "pieces": sentencepiece_codec.encode_documents(odd, public_tokenizers.path("piece_bpe_32k.model"), key="text"), "copies": near_dup.find(odd, key="text"), "benchmark": decontaminate.find(odd, spark.createDataFrame([(1, "same text")], "item_id long, text string"), key="text"),
    }
    for name, df in made.items():
        rows = [r.asDict() for r in df.collect()]
        assert len(rows) == len(ODD) + 1, name
        by_text = {}
        for r in rows:
            text = r.pop("text")
            assert by_text.setdefault(text, r) == r, (name, text)
        plain = {k: v for k, v in by_text[""].items() if k != "component_id"}
        assert {k: v for k, v in by_text[None].items() if k != "component_id"} == plain, name
    assert len(texts) == len(ODD)
    empty = {r["text"]: r for r in map(lambda r: r.asDict(), made["secrets"].collect())}[None]
    assert (empty["spans"], empty["base_sha256"], empty["best_margin"]) == ("", hashlib.sha256(b"").hexdigest(), None)
    counted = {r.text: r for r in made["counts"].collect()}
    assert (counted[None].n_bytes, counted[None].n_tokens, counted[None].over_limit) == (0, 0, False)
    judged = {r.text: r for r in made["quality"].collect()}
    assert judged[None].base_failed and not judged[None].kept and judged["x " * 3000].n_repeat_words == 3000
    same = {r.text: (r.contaminated, r.max_similarity) for r in made["benchmark"].collect()}
    assert same["same text"] == (True, 1.0) and same[None] == (False, None)


def test_repeated_ids_of_different_copies(spark):
    """A copy goes though it shares its id with a row that stays."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(3, a), (5, a.upper()), (5, b), (None, b), (5, b), (None, "other words here"), (None, "Other words  here")]
    for kind, cast in (("long", lambda x: x), ("string", lambda x: x if x is None else f"id{x}")):
        df = spark.createDataFrame([(cast(i), t) for i, t in rows], f"doc_id {kind}, text string")
        kept = [(r.doc_id, r.text.lower()) for r in near_dup.keep_one(df).collect()]
        assert len(kept) == 3 and set(kept[:9]) >= {(cast(3), a), (cast(5), b)}


def test_string_ids(spark):
    docs = queries.table(spark, SF, "documents").selectExpr("concat('d', doc_id) AS doc_id", "text", "lang")
    labels = queries.table(spark, SF, "labels").selectExpr("concat('d', doc_id) AS doc_id", "quality", "toxic")
    rows = quality.judge(docs, quality.train(docs, labels)).where("kept").count()
    assert 0 < rows < docs.count() and near_dup.find(docs).count() == docs.count()
    folder = token_output.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert token_output.read_ids(spark.read.parquet(folder)).count() == docs.count()
