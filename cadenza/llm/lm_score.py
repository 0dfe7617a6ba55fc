"""Language-model scores: a log-bilinear neural model, trained by noise-contrastive estimation.

Counts of all training words are summed over the corpus (by 64-bit hash; with V distinct words two
of them clash with probability V^2 / 2^65). The neural model's vocabulary grows with the root of the
training tokens: three quarters of its classes or more are the most frequent tokens, the end of a text among
them, and all other words, seen or not, are dealt to the other classes by hash, so they have vectors
too. Classes lie in groups, and a token's probability is that of its group after the `CONTEXTS` tokens before
it, times that of its class in the group after the last of them, times, for a hashed class, the word's share in it:

  log p(g | h) = log u_g + sum over places j of a_j (r_j(h_j) . q_j(g) + b_j(g) - log u_g), normalised over groups
  log p(w | g, h) = r(h_1) . q(w) + b(w), normalised over the classes of the group

so scores are products of batches of context vectors with the vectors of all groups and of a group's classes.

Learning uses counts over the whole training corpus: of each class after each, and of each group after each of the
`TOP` most frequent classes at each place. Noise comes from the unigram distribution, `noise` times as often as data;
its expectation is taken over the whole vocabulary, so training is deterministic. The classes: first the `CORE` most
frequent ones, the last of them standing for all others, are trained together on the driver; then executors fit the
word vectors and biases of all classes to the contexts' vectors, and the contexts' to the words': each row is a logistic
regression of its own on the pairs it has, so blocks of rows need nothing from each other. The groups: classes whose
word vectors are close, by halving them along their principal direction, over and over. The places: one model each,
and then their weights a_j, by `ROUNDS` Newton steps on all training tokens, one pass each.

A word of a hashed class pays log((count + 1) / mass), where mass sums (count + 1) over the words of its
class, and 1 for words not seen in training; so a text's score is the log probability of a proper model.

Counts are looked up in two ways. At most `head` words, the most frequent ones, are broadcast (16
bytes each). All others are joined by hash with the table of counts, so nothing broadcast grows
with the corpus. No word is dropped.

Defined results: null is the empty text, which is one end token. Rows with null ids are scored,
are not held out and are not learned from. Without training rows every count is 0. Repeated rows
count as often as they occur. An empty table gives no row. Words of equal frequency rank by hash. Texts of any
length are scored whole. Only key and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged
from .joins import HOT
from .storage import discard, map_batches, materialize

END = np.uint64(0)
CORE = 1024  # classes trained together before all are fitted
CONTEXTS, TOP, MOST_GROUPS, ROUNDS = 3, 2048, 128, 2
_FINE = 64  # steps of count levels in each power of two


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and the texts' first indices."""
    buf = ragged.LOWER[buf]
    starts, ends, first = ragged.words(buf, offsets)
    return np.insert(ragged.span_hashes(buf, starts, ends), first[1:], END), first + np.arange(len(first))


def _count(batches):
    """Words and their counts in a partition, merged whenever many have gathered."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge():
        words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for _, _, buf, offsets in ragged.slices(batch.column(0), 1 << 20):
            held.append(np.unique(tokens(buf, offsets)[0], return_counts=True))
        if sum(len(w) for w, _ in held) > 1 << 21:
            held = [merge()]
            if len(held[0][0]) > 1 << 20:  # what has gathered goes on, so memory is bounded
                yield _word_batch(*held.pop())
    if held:
        yield _word_batch(*merge())


def _word_batch(words, n):
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The table (word, n) of all tokens; the end of a text is word 0."""
    return map_batches(docs.select(F.col(text).alias("text")), _count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words (sorted hashes, counts and classes, -1 for hashed ones), the numbers of classes of one word
    and of hashed ones, and totals of the corpus."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    short: int
    hashed: int
    total: int
    distinct: int
    least_level: int

    @property
    def size(self) -> int:
        return self.short + self.hashed

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the words; -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def class_of(self, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.classes[at] if len(self.classes) else -1, -1)
        return np.where(own >= 0, own, self.short + hashes.view(np.int64) % self.hashed)


def _level() -> Column:
    return F.floor(F.log2("n") * _FINE).cast("int")


def vocabulary(counts: DataFrame, *, classes: int | None = None, head: int = 1 << 18) -> Vocabulary:
    """Totals, and the words at the highest count levels as long as they are at most `head`."""
    levels = sorted(counts.groupBy(_level().alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    least, held = 1 << 30, 0
    for level, words, _ in levels:
        if held + words > head:
            break
        least, held = level, held + words
    rows = counts.where(_level() >= least).toArrow()
    words, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    total = sum(x.n for x in levels)
    size = classes or max(1024, isqrt(total))
    hashed = max(1, min(size // 4, total // 8192))  # with fewer tokens a class, its vectors learn chance
    best = [*np.flatnonzero(words == END), *(k for k in np.lexsort((words, -n)) if words[k] != END)][: size - hashed]
    own = np.full(len(words), -1)
    own[best] = np.arange(len(best))
    return Vocabulary(words, n, own, len(best), hashed, total, sum(x.words for x in levels), least)


def class_pairs(docs: DataFrame, vocab: Vocabulary, *, text: str = "text") -> DataFrame:
    """The table (a, b, n): how often class b follows class a in the whole corpus; a text starts after an end."""
    size = vocab.size
    kept = vocab.classes >= 0
    small = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocab.words[kept], vocab.counts[kept], vocab.classes[kept], vocab.short, vocab.hashed, 0, 0, 0))

    def merge(held):
        cells, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return cells, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def put(cells, n):
        return pa.RecordBatch.from_arrays([pa.array(cells // size), pa.array(cells % size), pa.array(n)], names=["a", "b", "n"])

    def run(batches):
        v, held = small.value, []
        for batch in batches:
            for _, _, buf, offsets in ragged.slices(batch.column(0), 1 << 20):
                hashes, _ = tokens(buf, offsets)
                c = v.class_of(v.find(hashes), hashes)
                held.append(np.unique(np.r_[0, c[:-1]] * size + c, return_counts=True))  # each text ends with class 0, so the next starts after it
            if sum(len(c) for c, _ in held) > 1 << 20:
                held = [merge(held)]
                if len(held[0][0]) > 1 << 19:
                    yield put(*held.pop())
        if held:
            yield put(*merge(held))

    return map_batches(docs.select(F.col(text).alias("text")), run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def core_pairs(pairs: DataFrame, size: int) -> np.ndarray:
    """Counts of each of `size` classes after each, the last one standing for all further ones."""
    rows = pairs.groupBy(F.least("a", F.lit(size - 1)).alias("a"), F.least("b", F.lit(size - 1)).alias("b")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out[rows.column(0).to_numpy(), rows.column(1).to_numpy()] = rows.column(2).to_numpy()
    return out


@dataclass
class LogBilinear:
    """Context vectors, the matrix between them and word vectors, word vectors, and biases."""

    context: np.ndarray
    between: np.ndarray
    word: np.ndarray
    bias: np.ndarray

    def scores(self, classes: np.ndarray) -> np.ndarray:
        return (self.context[classes] @ self.between) @ self.word.T + self.bias

    def normalisers(self, batch: int = 256) -> np.ndarray:
        """Log of the sum of exponential scores after each class."""
        out = [np.empty(0)]
        for lo in range(0, len(self.context), batch):
            s = self.scores(np.arange(lo, min(lo + batch, len(self.context))))
            top = s.max(1, keepdims=True)
            out.append((top + np.log(np.exp(s - top).sum(1, keepdims=True, dtype=np.float64))).ravel())
        return np.concatenate(out)

    def log_probabilities(self, batch: int = 256) -> np.ndarray:
        """Normalised natural log probability of each class after each class."""
        out = []
        for lo in range(0, len(self.context), batch):
            s = self.scores(np.arange(lo, min(lo + batch, len(self.context)))).astype(np.float64)
            top = s.max(1, keepdims=True)
            out.append(s - top - np.log(np.exp(s - top).sum(1, keepdims=True)))
        return np.concatenate(out)


def train(pairs: np.ndarray, *, width: int = 32, noise: int = 16, steps: int = 250, rate: float = 0.05, prior: float = 15.0, seed: int = 6) -> LogBilinear:
    """Noise-contrastive estimation on counts of each word (column) after each context (row): tell data from `noise` times as many draws of the unigram distribution. `prior` is the precision of the vectors' Gaussian prior."""
    (rows, size), rng = pairs.shape, np.random.default_rng(seed)
    joint = (pairs / max(pairs.sum(), 1)).astype(np.float32)
    before = joint.sum(1, keepdims=True)
    unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * size)
    log_noise = np.log(noise * unigram).astype(np.float32)
    against = (noise * before * unigram).astype(np.float32)
    model = [rng.normal(0, 0.1, (rows, width)), np.eye(width), rng.normal(0, 0.1, (size, width)), np.log(unigram)]
    model = [x.astype(np.float32) for x in model]
    pull = prior / max(pairs.sum(), 1)  # of a Gaussian prior on the vectors
    first, second = [np.zeros_like(x) for x in model], [np.zeros_like(x) for x in model]
    for step in range(1, steps + 1):
        context, between, word, bias = model
        mapped = context @ between
        data = 1 / (1 + np.exp(-np.clip(mapped @ word.T + bias - log_noise, -30, 30)))  # probability of being data
        slope = against * data - joint * (1 - data)
        back = slope @ word
        found = [back @ between.T, context.T @ back, slope.T @ mapped, slope.sum(0)]
        found = [found[0] + pull * context, found[1], found[2] + pull * word, found[3]]
        decay = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in enumerate(found):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = model[k] - decay * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return LogBilinear(*model)


def fit_rows(joint: np.ndarray, features: np.ndarray, offset: np.ndarray, chance: np.ndarray, noise_log: np.ndarray, start: np.ndarray, free: np.ndarray, pull: np.ndarray, *, steps: int, rate: float = 0.05) -> np.ndarray:
    """Noise-contrastive estimation of rows of vectors against fixed features: joint[row, column] is the share of data,
    chance that of noise, offset + vector . feature the score. `free` tells which entries of a vector may change."""
    now, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        data = now @ features.T
        data += offset - noise_log
        np.clip(data, -30, 30, out=data)
        data = 1 / (1 + np.exp(-data))
        slope = (chance + joint) * data - joint
        g = (slope @ features + pull * now) * free
        if step == 1:
            norm = np.sqrt((g * g).mean(1, keepdims=True)) + 1e-30  # rows differ much in frequency
        g = g / norm
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        now = now - rate * min(1.0, 2 * (1 - step / (steps + 1))) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return now


def fit(pairs: DataFrame, model: LogBilinear, before: np.ndarray, unigram: np.ndarray, total: float, words: bool, *, noise: int = 16, steps: int = 40, prior: float = 15.0) -> LogBilinear:
    """Fit the rows of all words (with their biases) or all contexts, in blocks dealt over the executors."""
    size, width = model.context.shape
    side, other = ("b", "a") if words else ("a", "b")
    block = max(1, (1 << 21) // size)
    shared = pairs.sparkSession.sparkContext.broadcast((model, before, unigram))

    def run(table: pa.Table) -> pa.Table:
        m, p, q = shared.value
        row, column, n = (table.column(k).to_numpy() for k in (side, other, "n"))
        rows = np.unique(row)
        joint = np.zeros((len(rows), size), np.float32)
        joint[np.searchsorted(rows, row), column] = n / total
        one = np.ones((size, 1), np.float32)
        if words:
            features, offset = np.c_[m.context @ m.between, one], np.float32(0)
            start, chance, noise_log = np.c_[m.word[rows], m.bias[rows]], noise * q[rows][:, None] * p, np.log(noise * q[rows])[:, None]
        else:
            features, offset = np.c_[m.word @ m.between.T, 0 * one], m.bias
            start, chance, noise_log = np.c_[m.context[rows], np.zeros(len(rows))], noise * p[rows][:, None] * q, np.log(noise * q)
        pull = np.r_[np.full(width, prior / total), 0].astype(np.float32)
        free = np.r_[np.ones(width), float(words)].astype(np.float32)
        f = lambda x: np.asarray(x, np.float32)
        out = fit_rows(joint, f(features), f(offset), f(chance), f(noise_log), f(start), free, pull, steps=steps)
        return pa.table({"row": pa.array(rows), "vector": pa.array([x.tobytes() for x in out], pa.binary())})

    got = pairs.withColumn("block", F.floor(F.col(side) / block)).groupBy("block").applyInArrow(run, "row long, vector binary").toArrow()
    out = LogBilinear(model.context.copy(), model.between, model.word.copy(), model.bias.copy())
    if len(got):
        rows, vectors = got.column(0).to_numpy(), np.frombuffer(b"".join(got.column(1).to_pylist()), np.float32).reshape(-1, width + 1)
        if words:
            out.word[rows], out.bias[rows] = vectors[:, :-1], vectors[:, -1]
        else:
            out.context[rows] = vectors[:, :-1]
    return out


def learn_model(pairs: DataFrame, size: int, *, steps: int) -> LogBilinear:
    """The model of all classes: the core trained together, then all words, contexts and words fitted."""
    core = min(CORE, size)
    model = train(core_pairs(pairs, core), steps=steps)
    if core == size:
        return model
    before, after = np.zeros(size), np.zeros(size)
    for out, side in ((before, "a"), (after, "b")):
        rows = pairs.groupBy(side).agg(F.sum("n").alias("n")).toArrow()
        out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    total = max(after.sum(), 1.0)
    unigram = (after + 0.5) / (after.sum() + 0.5 * size)
    whole = np.minimum(np.arange(size), core - 1)
    bias = np.where(whole < core - 1, model.bias[whole], np.log(unigram)).astype(np.float32)
    model = LogBilinear(model.context[whole], model.between, model.word[whole], bias)
    for words in (True, False):
        model = fit(pairs, model, (before / total).astype(np.float32), unigram.astype(np.float32), total, words, steps=max(1, steps // 6))
    return model


def contexts(classes: np.ndarray, first: np.ndarray, places: int = CONTEXTS) -> list[np.ndarray]:
    """The classes of the tokens 1, 2, ... before each; before a text stand ends (class 0)."""
    at = np.arange(len(classes)) - first[:-1][ragged.row_of(first)]
    return [np.where(at >= j, np.r_[np.zeros(min(j, len(classes)), classes.dtype), classes[:-j]], 0) for j in range(1, places + 1)]


def groups_of(vectors: np.ndarray, groups: int) -> np.ndarray:
    """The group of each class: halves along the principal direction of their vectors, until there are `groups` (a power of two) of them."""
    parts = [np.arange(len(vectors))]
    while len(parts) < groups:
        halves = []
        for part in parts:
            centred = vectors[part].astype(np.float64) - vectors[part].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            axis = axis * np.sign(axis[np.abs(axis).argmax()])
            order = part[np.lexsort((part, np.round(centred @ axis, 9)))]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    out = np.zeros(len(vectors), np.int64)
    for k, part in enumerate(parts):
        out[part] = k
    return out


def group_count(size: int) -> int:
    """The greatest power of two that is at most the root of the number of classes, and MOST_GROUPS."""
    return min(MOST_GROUPS, 1 << max(0, (isqrt(size)).bit_length() - 1))


def group_pairs(docs: DataFrame, vocab: Vocabulary, group: np.ndarray, *, text: str = "text") -> np.ndarray:
    """Counts [place, context, group] of each group after each of the TOP most frequent classes (the last stands for the others) at each place, over the whole corpus."""
    top, n = min(TOP, vocab.size), int(group.max(initial=0)) + 1
    kept = vocab.classes >= 0
    small = Vocabulary(vocab.words[kept], vocab.counts[kept], vocab.classes[kept], vocab.short, vocab.hashed, 0, 0, 0)
    shared = docs.sparkSession.sparkContext.broadcast((small, group))

    def run(batches):
        (v, g), total = shared.value, np.zeros(CONTEXTS * top * n, np.int64)
        for batch in batches:
            for _, _, buf, offsets in ragged.slices(batch.column(0)):
                hashes, first = tokens(buf, offsets)
                c = v.class_of(v.find(hashes), hashes)
                for j, h in enumerate(contexts(c, first)):
                    total += np.bincount((j * top + np.minimum(h, top - 1)) * n + g[c], minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["cell", "n"])

    got = map_batches(docs.select(F.col(text).alias("text")), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CONTEXTS * top * n)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(CONTEXTS, top, n)


@dataclass
class Places:
    """The model of groups: for each place context vectors, group vectors, and biases less the log shares of groups; the places' weights; log shares."""

    context: list[np.ndarray]
    group: list[np.ndarray]
    bias: list[np.ndarray]
    weight: np.ndarray
    share: np.ndarray

    def features(self, before: list[np.ndarray]) -> list[np.ndarray]:
        top = len(self.context[0])
        return [c[np.minimum(h, top - 1)] @ g.T + b for c, g, b, h in zip(self.context, self.group, self.bias, before, strict=True)]

    def log_probabilities(self, before: list[np.ndarray]) -> np.ndarray:
        """Normalised log probabilities of all groups after these contexts."""
        s = np.repeat(self.share[None], len(before[0]), 0)
        for a, f in zip(self.weight, self.features(before), strict=True):
            s += np.float32(a) * f
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def learn_places(counts: np.ndarray, *, steps: int) -> Places:
    """One model for each place, all with the same weight at first."""
    total = counts[0].sum(0)
    share = np.log((total + 0.5) / (total.sum() + 0.5 * len(total))).astype(np.float32)
    models = [train(c, steps=steps, width=16) for c in counts]
    return Places([(m.context @ m.between).astype(np.float32) for m in models], [m.word for m in models], [(m.bias - share).astype(np.float32) for m in models], np.full(len(models), 1 / len(models)), share)


def place_sums(places: Places, parts, most: int = 1 << 21, piece: int = 512) -> np.ndarray:
    """Of the tokens of `parts` (their contexts, and their groups): how many, and the slopes (one a place) and curvatures (place by place) of the sum of their log probabilities by the places' weights.

    What doesn't depend on a token's own group is worked out once for all of about `most` tokens that have the same contexts."""
    k, top = len(places.weight), len(places.context[0])
    tables = [c @ g.T + b for c, g, b in zip(places.context, places.group, places.bias, strict=True)]
    slope, bend, n, held, waiting = np.zeros(k), np.zeros((k, k)), 0, [], 0

    def spend():
        keys, every = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(keys), piece):
            key, times = keys[lo : lo + piece], every[lo : lo + piece]
            features = [t[key // top**j % top] for j, t in enumerate(tables)]
            p = places.share + sum(np.float32(a) * f for a, f in zip(places.weight, features, strict=True))
            np.exp(p - p.max(1, keepdims=True), out=p)
            p *= (times / p.sum(1))[:, None].astype(np.float32)
            drawn = [p * f for f in features]
            sums = np.stack([x.sum(1) for x in drawn]).astype(np.float64)
            slope[:] -= sums.sum(1)
            bend[:] += (sums / times) @ sums.T
            for i, x in enumerate(drawn):
                for j in range(i, k):
                    both = np.vdot(x, features[j])
                    bend[i, j] -= both
                    bend[j, i] -= both * (i != j)

    for before, groups in parts:
        capped = [np.minimum(h, top - 1) for h in before]
        slope += [t[h, groups].sum(dtype=np.float64) for t, h in zip(tables, capped, strict=True)]
        held.append(sum(h.astype(np.int64) * top**j for j, h in enumerate(capped)))
        n, waiting = n + len(groups), waiting + len(groups)
        if waiting >= most:
            spend()
            held, waiting = [], 0
    if waiting:
        spend()
    return np.r_[n, slope, bend.ravel()]


def weigh_places(places: Places, source: DataFrame | list[np.ndarray], *of, text: str = "text", rounds: int = ROUNDS) -> Places:
    """Set the places' weights by Newton steps on the log probabilities of the groups of all tokens, one pass a step. The sum is concave in them.
    The tokens: those of documents, given with the vocabulary and the classes' groups; or contexts, given with the tokens' groups."""
    k = len(places.weight)
    if not isinstance(source, DataFrame):
        passes = lambda now: place_sums(now, [(source, *of)])
    else:
        vocab, group = of
        kept, sc = vocab.classes >= 0, source.sparkSession.sparkContext
        small = Vocabulary(vocab.words[kept], vocab.counts[kept], vocab.classes[kept], vocab.short, vocab.hashed, 0, 0, 0)

        def passes(now):
            shared = sc.broadcast((small, group, now))

            def run(batches):
                v, g, model = shared.value

                def parts():
                    for batch in batches:
                        for _, _, buf, offsets in ragged.slices(batch.column(0)):
                            hashes, first = tokens(buf, offsets)
                            c = v.class_of(v.find(hashes), hashes)
                            yield contexts(c, first), g[c]

                yield pa.RecordBatch.from_arrays([pa.array([place_sums(model, parts())])], names=["sums"])

            got = map_batches(source.select(F.col(text).alias("text")), run, "sums array<double>").toArrow().column(0).to_pylist()
            return np.array(got, float).reshape(-1, 1 + k + k * k).sum(0)

    for _ in range(rounds):
        n, slope, bend = np.split(passes(places), [1, 1 + k])
        if not n[0]:
            return places
        step = np.linalg.solve(-bend.reshape(k, k) / n + 1e-6 * np.eye(k), slope / n)
        step = step / max(1.0, float(np.abs(step).max()))
        places = Places(places.context, places.group, places.bias, places.weight + step, places.share)
    return places


def _log_sums(s: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; s is overwritten. Scores are small numbers, so their exponentials are summed as they are, and shifted only where that overflows."""
    top = s.max(initial=0.0)
    if top < 60:
        return np.log(np.exp(s, out=s).sum(1))
    shift = s.max(1)
    s -= shift[:, None]
    return shift + np.log(np.exp(s, out=s).sum(1))


def _same(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, the distinct ones, which of them each key in that order is, and where each begins (one more at the end)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    return order, ordered[new], np.cumsum(new) - 1, np.r_[np.flatnonzero(new), len(keys)]


@dataclass
class Scorer:
    """Context and word vectors and biases of classes, their groups, the model of groups, and logs of hashed classes' masses."""

    before: np.ndarray
    after: np.ndarray
    bias: np.ndarray
    group: np.ndarray
    places: Places
    log_mass: np.ndarray

    def tables(self) -> Tables:
        """What scoring multiplies: biases are a further entry of the vectors, places' weights are in their context vectors."""
        p = self.places
        order = np.argsort(self.group, kind="stable")
        members = np.split(order, np.flatnonzero(np.diff(self.group[order])) + 1)
        place = np.zeros(len(self.group), np.int64)
        for own in members:
            place[own] = np.arange(len(own))
        share = p.share + sum(a * b for a, b in zip(p.weight, p.bias, strict=True))
        f = lambda x: np.ascontiguousarray(x, np.float32)
        one = np.ones((len(self.before), 1))
        return Tables([f(a * c) for a, c in zip(p.weight, p.context, strict=True)], f(np.r_[np.concatenate(p.group, 1).T, share[None]]), f(np.c_[self.before, one]), [f(np.c_[self.after, self.bias][own].T) for own in members], self.group, place)


@dataclass
class Tables:
    contexts: list[np.ndarray]
    groups: np.ndarray
    before: np.ndarray
    after: list[np.ndarray]
    group: np.ndarray
    place: np.ndarray

    def token_logs(self, classes: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each token's class after its contexts, by products over the groups and over the classes of its group."""
        g, top = self.group[classes], len(self.contexts[0])
        capped = [np.minimum(h, top - 1) for h in before]
        out = np.empty(len(classes))
        order, key, at, ends = _same(sum(h.astype(np.int64) * top**j for j, h in enumerate(capped)))  # contexts recur
        for lo in range(0, len(key), 1 << 12):  # pieces that stay in a core's cache
            part = key[lo : lo + (1 << 12)]
            some = slice(ends[lo], ends[lo + len(part)])
            mine, row = order[some], at[some] - lo
            x = np.concatenate([c[part // top**j % top] for j, c in enumerate(self.contexts)] + [np.ones((len(part), 1), np.float32)], 1)
            s = x @ self.groups
            own = s[row, g[mine]].astype(np.float64)
            out[mine] = own - _log_sums(s)[row]
        size = len(self.before)
        order, key, at, ends = _same(g * size + before[0])  # a group, and the last context
        last = np.searchsorted(key, np.arange(len(self.after) + 1) * size)
        for k in np.flatnonzero(np.diff(last)):
            lo, hi = last[k], last[k + 1]
            some = slice(ends[lo], ends[hi])
            mine, row = order[some], at[some] - lo
            s = self.before[key[lo:hi] - k * size] @ self.after[k]
            own = s[row, self.place[classes[mine]]].astype(np.float64)
            out[mine] += own - _log_sums(s)[row]
        return out


def _score(vocab, scorer):
    def run(batches):
        v, model = vocab.value, scorer.value
        tables = model.tables()
        logs = np.log10(v.counts + 1.0)
        for batch in batches:
            out = []
            for _, _, buf, offsets in ragged.slices(batch.column(1), 1 << 20):
                hashes, first = tokens(buf, offsets)
                at, row = v.find(hashes), ragged.row_of(first)
                c, head = v.class_of(at, hashes), at >= 0
                value = np.where(head, logs[at] if len(logs) else 0, 0)
                rare = c >= v.short
                neural = ragged.sums(tables.token_logs(c, contexts(c, first)), first) / np.log(10)
                value_rare = np.where(rare, value - model.log_mass[np.maximum(c - v.short, 0)], 0)
                tail = np.flatnonzero(~head)
                order = tail[np.lexsort((hashes[tail], row[tail]))]
                new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(order)]
                heads = np.flatnonzero(new)
                cut = np.searchsorted(row[order[heads]], np.arange(len(first)))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (hashes[order[heads]].view(np.int64), np.diff(np.r_[heads, len(order)]).astype(np.int32))]
                out.append([pa.array(x) for x in (np.diff(first), ragged.sums(head, first), ragged.sums(value, first), ragged.sums(value_rare, first), neural)] + lists)
            for (lo, *_), columns in zip(ragged.slices(batch.column(1), 1 << 20), out, strict=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(columns[0])), *columns], names=["uid", "n_tokens", "n_head", "head_log", "rare_log", "neural", "tail", "times"])

    return run


def learn_scorer(corpus: DataFrame, vocab: Vocabulary, mass: np.ndarray, *, text: str = "text", steps: int) -> Scorer:
    """All of the neural model from the training corpus."""
    pairs = materialize(class_pairs(corpus, vocab, text=text), "class-pairs")
    model = learn_model(pairs, vocab.size, steps=steps)
    discard(pairs)
    group = groups_of(model.word, group_count(vocab.size))
    places = learn_places(group_pairs(corpus, vocab, group, text=text), steps=max(1, steps // 2))
    places = weigh_places(places, corpus, vocab, group, text=text)
    return Scorer((model.context @ model.between).astype(np.float32), model.word.astype(np.float32), model.bias.astype(np.float32), group, places, np.log10(mass))


def _join_words(scored: DataFrame, tail: DataFrame, rare: DataFrame, counted: int = 64) -> DataFrame:
    """Join the words of texts with the rare words of training. Words that many texts have, though training has them rarely
    or not at all, are found from one text in `counted`; they are at most one in `HOT` words, so they are joined by a broadcast."""
    some = scored.where(F.pmod(F.xxhash64("uid"), F.lit(counted)) == 0).select(F.explode("tail").alias("word"))
    hot = materialize(some.groupBy("word").count().where(F.col("count") * counted >= HOT).select("word"), "hot-words")
    if hot.isEmpty():
        return tail.join(rare, "word")
    frequent = rare.join(F.broadcast(hot), "word")
    return tail.join(F.broadcast(frequent), "word").unionByName(tail.join(F.broadcast(hot), "word", "left_anti").join(rare, "word"))


def score(docs: DataFrame, *, held_out: Column, learn: Column, key: str = "doc_id", text: str = "text", classes: int | None = None, head: int = 1 << 18, steps: int = 250) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    corpus = docs.where(F.coalesce(learn, F.lit(False)))
    counts = materialize(word_counts(corpus, text=text), "words")
    vocab = vocabulary(counts, classes=classes, head=head)
    mass = np.ones(vocab.hashed)  # sums of (count + 1) over the words of each hashed class, and 1
    for r in counts.groupBy(F.pmod("word", F.lit(vocab.hashed)).alias("k")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        mass[r.k] += r.n
    listed = vocab.classes >= 0
    np.subtract.at(mass, vocab.words[listed].view(np.int64) % vocab.hashed, vocab.counts[listed] + 1)
    model = learn_scorer(corpus, vocab, mass, text=text, steps=steps)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), held_out.alias("held_out"), F.col(text).alias("text"))
    run, schema = _score(sc.broadcast(vocab), sc.broadcast(model)), "n_tokens long, n_head long, head_log double, rare_log double, neural double, tail array<long>, times array<int>"

    def carry(batches):
        for batch in batches:
            carried = batch.select(["key", "held_out"])
            lo = 0
            for out in run([batch.select(["uid", "text"])]):
                part = carried.slice(lo, out.num_rows)
                lo += out.num_rows
                yield pa.RecordBatch.from_arrays([out.column(0), *part.columns, *out.columns[1:]], names=["uid", "key", "held_out", *out.schema.names[1:]])

    scored = materialize(map_batches(rows, carry, f"uid long, key {kind}, held_out boolean, {schema}"), "scored")
    tail = scored.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("uid", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    known = _join_words(scored, tail, counts.where(_level() < vocab.least_level)).groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"), F.sum("times").alias("n_tail"))
    zero = F.coalesce(F.col("tail_log"), F.lit(0.0))
    log_base = float(np.log10(vocab.total + vocab.distinct + 1))
    return scored.select("uid", "key", "held_out", "n_tokens", "n_head", "head_log", "rare_log", "neural").join(known, "uid", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + zero - F.col("n_tokens") * log_base).alias("base_score"),
        (F.col("neural") + F.col("rare_log") + zero).alias("score"),
    )
