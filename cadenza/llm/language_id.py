"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each codeword bit, a binary classifier over
hashed byte n-grams (n = 2, 3, 4) tells languages with +1 from languages with -1: a
multinomial model whose weights are log-odds of the two sides' n-gram frequencies. All
training rows are counted, on the executors. A text's bit margins are decoded to the codeword
with the least weighted logistic loss; texts whose two best codewords are close are flagged.

Defined results: null texts and texts without a letter are `und` with score 0; so is every
text if there is no training row. Rows with null label, null id or null text are not learned
from. Repeated rows count as often as they occur. Ties in loss go to the language that sorts
first. An empty table gives no row. Texts of any length are read whole. Other columns of the input are
not read, so their names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .storage import discard, map_batches, materialize

UNDETERMINED = "und"
NGRAMS = (2, 3, 4)

#: Letters of ASCII in lower case, bytes of other characters as they are, all else a space.
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def ngram_features(buf: np.ndarray, offsets: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram at each byte; `buckets` where it would leave the text."""
    x, shift = _FOLD[buf], np.uint32(32 - int(buckets).bit_length() + 1)
    found = []
    gram = x
    for n in range(2, max(NGRAMS) + 1):
        nxt = np.zeros_like(x)
        nxt[: len(x) - n + 1] = x[n - 1 :]
        gram = gram | (nxt << np.uint32(8 * (n - 1)))
        if n in NGRAMS:
            feature = (((gram + np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
            for k in range(1, n):
                last = offsets[1:] - k
                feature[last[last >= offsets[:-1]]] = buckets
            found.append(feature)
    return found


def codebook(languages: int) -> np.ndarray:
    """Codewords as rows of +1 and -1: all useful columns up to six languages, else the best of several seeded random codes."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 6:
        columns = np.arange(1, 1 << (languages - 1))
        return np.array([np.where((columns << 1) >> k & 1, 1, -1) for k in range(languages)], np.int8)
    bits, best = int(np.ceil(10 * np.log2(languages))), (-1, None)
    for seed in range(64):
        code = np.where(np.random.default_rng(seed).random((languages, bits)) < 0.5, -1, 1).astype(np.int8)
        if (abs(code.sum(0)) == languages).any():
            continue
        near = int(((bits - code.astype(int) @ code.T) // 2 + bits * np.eye(languages, dtype=int)).min())
        best = max(best, (near, code), key=lambda x: x[0])
    return best[1]


@dataclass
class Model:
    """languages x bits code, bits x (buckets + 1) weights and the bits' decoding weights and scales."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray
    scale: np.ndarray
    buckets: int
    margin: float

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out, total = np.zeros((len(offsets) - 1, len(self.weights))), np.zeros(len(offsets) - 1)
        full = np.flatnonzero(np.diff(offsets))
        for feature in ngram_features(buf, offsets, self.buckets):
            total += ragged.sums(feature < self.buckets, offsets)
            for b, w in enumerate(self.weights):
                out[full, b] += np.add.reduceat(w[feature], offsets[full], dtype=np.float64) if len(full) else 0
        return out / np.maximum(total, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share in a softmax of negative losses, and whether another is close."""
        z = margins * self.scale
        loss = np.stack([(self.bit_weight * np.logaddexp(0, -z * word)).sum(1) for word in self.code], 1)
        order = np.argsort(loss, 1, kind="stable")
        rows = np.arange(len(loss))
        share = np.exp(loss.min(1, keepdims=True) - loss)
        second = loss[rows, order[:, min(1, loss.shape[1] - 1)]]
        close = (second - loss[rows, order[:, 0]] < self.margin) & (loss.shape[1] > 1)
        return order[:, 0], share[rows, order[:, 0]] / share.sum(1), close


HELD = 64


def _counter(buckets: int):
    """Counts (label, bucket, n) of a partition. At most `HELD` labels' counts are held; the ones longest unseen go on."""

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def put(label):
            total = held.pop(label)
            full = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([label] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(total[full])], names=["label", "bucket", "n"])

        for batch in batches:
            names, label = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True) if batch.num_rows else ([], [])
            for lo, hi, buf, offsets in ragged.slices(batch.column(0)):
                features, rows, own = ngram_features(buf, offsets, buckets), np.diff(offsets), label[lo:hi]
                for k in np.unique(own):
                    mask, name = np.repeat(own == k, rows), str(names[k])
                    total = held.pop(name, None)
                    held[name] = (0 if total is None else total) + sum(np.bincount(f[mask], minlength=buckets + 1)[:buckets] for f in features)
                while len(held) > HELD:
                    yield put(next(iter(held)))
        for name in list(held):
            yield put(name)

    return count


def train(docs: DataFrame, *, train_on: Column, text: str = "text", label: str = "lang", buckets: int = 1 << 16, smoothing: float = 0.5, margin: float = 0.5) -> Model | None:
    """Fit on all rows where `train_on` holds and text and label are not null; None if there are none.

    The classifiers are fitted on the executors, for blocks of buckets at a time. What reaches the driver is the
    list of languages, a weight for each bit and bucket, and each language's mean margins.
    """
    rows = docs.where(train_on & F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    counts = materialize(map_batches(rows, _counter(buckets), "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    # a label whose texts have no n-gram is learned all the same
    totals = dict(rows.select("label", F.lit(0).cast("long").alias("n")).union(counts.select("label", "n")).groupBy("label").agg(F.sum("n").alias("n")).collect())
    languages = sorted(totals)
    if not languages:
        return None
    code, block = codebook(len(languages)), max(64, (1 << 22) // max(len(languages), 64))
    index = {x: k for k, x in enumerate(languages)}
    mass = np.maximum(np.array([totals[x] for x in languages]) + smoothing / 64 * buckets, 1e-9)

    def fit(table: pa.Table) -> pa.Table:
        first = table.column("block")[0].as_py() * block
        n = np.zeros((len(languages), min(block, buckets - first)))
        n[[index[x] for x in table.column("label").to_pylist()], table.column("bucket").to_numpy() - first] = table.column("n").to_numpy()
        share = (n + smoothing / 64) / mass[:, None]
        weights = np.zeros((code.shape[1], n.shape[1]), np.float32)
        for b, bit in enumerate(code.T):
            if len(set(bit)) == 2:
                weights[b] = np.clip(np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)), -6, 6)
        return pa.table({"first": pa.array([first], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary()), "own": pa.array([(share @ weights.T).tobytes()], pa.binary())})

    # a block without any n-gram still has weights: its shares differ by the languages' totals alone
    every = docs.sparkSession.range(-(-buckets // block)).select(F.lit(languages[0]).alias("label"), (F.col("id") * block).cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    cells = counts.union(every).groupBy("label", "bucket").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("bucket") / block))
    fitted = cells.groupBy("block").applyInArrow(fit, "first long, weights binary, own binary").toArrow().sort_by("first").to_pylist()
    discard(counts)
    weights = np.zeros((code.shape[1], buckets + 1), np.float32)
    own = np.zeros((len(languages), code.shape[1]))
    for part in fitted:
        w = np.frombuffer(part["weights"], np.float32).reshape(code.shape[1], -1)
        weights[:, part["first"] : part["first"] + w.shape[1]] = w
        own += np.frombuffer(part["own"]).reshape(own.shape)
    own *= code
    scale = 4 / np.maximum(abs(own).mean(0), 1e-6)
    bit_weight = np.clip(own.min(0) * scale / 4, 0.05, 2)
    return Model(languages, code, weights, bit_weight / bit_weight.sum() * 4, scale, buckets, margin)


def _has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = ((buf | 0x20) >= 0x61) & ((buf | 0x20) <= 0x7A) & (buf < 0x80)
    found = ragged.sums(letter, offsets) > 0
    for k in np.flatnonzero(~found & (ragged.sums(buf >= 0x80, offsets) > 0)):
        found[k] = any(c.isalpha() for c in bytes(buf[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace"))
    return found


def predict_texts(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and ambiguity flags of an Arrow array of texts."""
    names, scores, flags = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if model is None:
        return names, scores, flags
    for lo, hi, buf, offsets in ragged.slices(texts):
        known = _has_letter(buf, offsets)
        best, share, close = model.decode(model.margins(buf, offsets))
        for k in np.flatnonzero(known):
            names[lo + k] = model.languages[best[k]]
        scores[lo:hi], flags[lo:hi] = np.where(known, share, 0), close & known
    return names, scores, flags


def identify(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: key, the columns of `keep`, lang_pred, score and ambiguous. Only the text is looked at."""
    rows = docs.select(F.col(key), *(keep or []), F.col(text).alias("__text"))
    carried = rows.columns[:-1]
    model_b = docs.sparkSession.sparkContext.broadcast(model)  # at most bits x buckets floats, whatever the input

    def run(batches):
        for batch in batches:
            names, scores, flags = predict_texts(model_b.value, batch.column(len(carried)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(names, pa.string()), pa.array(scores), pa.array(flags)], names=[*carried, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", lang_pred string, score double, ambiguous boolean"
    return map_batches(rows, run, schema)
