"""Secret scans: base patterns, and automata inferred from labelled credentials.

Base kinds are fixed patterns (assign, access, hex). Their values in the corpus, labelled by the context they
stand in, and credentials built from published formats (`opaque`: random strings of usual alphabets and
no fixed format) are the training strings. For each label a probabilistic automaton is inferred. Every
candidate, a run of `LEAST` credential characters or more, each of its parts between = and /, and what starts
with a published prefix in it, is scored under all automata: the log likelihood ratio a symbol of the label
against ordinary text. Ordinary text is the likelier of a Markov chain, counted over all shorter runs of the
whole corpus outside base spans together with made-up names, paths and dates, and of automata of numbers, UUIDs
and timestamps. A label's threshold is what its strings reach when the automaton learned from the other half,
and not below what ordinary tokens reach. Candidates above a threshold give added spans unless they overlap a
base span; of those that overlap each other, the one whose ratios sum to most above the threshold, then the
first, then the longest. Base spans always stay.

The training strings are a bounded sample: of each kind's values of at most `longest` symbols, the least hash in
each of `buckets` buckets for each length, so a frequent format doesn't crowd out a rare one, and of these the
`per_label` least hashes. Scanning covers every character of every text.

Defined results: null is the empty text and has no span. Positions are code points, ends exclusive. Repeated
rows give repeated results. An empty table leaves the published formats. Texts of any length are scanned in
time proportional to their length. Columns other than key and text are not read by the scan, so their
names don't matter.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, insort
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged
from .automata import Automaton, infer
from .storage import discard, map_batches, materialize

#: Base kinds in order, their patterns (ASCII letters of the names in either case) and least lengths.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Published credential formats as (label, prefix, alphabets and lengths of what follows it).
_ALNUM, _UPPER = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
FORMATS = (
    ("github", "ghp_", ((_ALNUM, 36),)),
    ("gitlab", "glpat-", ((_ALNUM + "_-", 20),)),
    ("slack", "xoxb-", ((string.digits, 12), ("-", 1), (string.digits, 12), ("-", 1), (_ALNUM, 24))),
    ("stripe", "sk_live_", ((_ALNUM, 24),)),
    ("google", "AIza", ((_ALNUM + "_-", 35),)),
    ("jwt", "eyJ", ((_ALNUM + "_-", 60),)),
    ("npm", "npm_", ((_ALNUM, 36),)),
)

#: Fewest symbols of a candidate.
LEAST = 16
CANDIDATE = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST},}}")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


_PREFIXED = [re.compile(re.escape(prefix) + f"[{re.escape(''.join(sorted(set().union(*(x for x, _ in parts)))))}]+") for _, prefix, parts in FORMATS]


def candidates(text: str) -> Iterable[tuple[int, int, str]]:
    """Runs of credential characters, their parts between = and /, and what follows a published prefix."""
    for m in CANDIDATE.finditer(text):
        parts = {m.span()}
        for separators in ("=", "=/"):
            parts |= {(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(f"[^{separators}]+", m[0])}
        parts |= {p.span() for prefixed in _PREFIXED for p in prefixed.finditer(text, *m.span())}
        found = set()
        for start, end in parts:
            value = text[start:end].lstrip("=/-+")
            start = end - len(value)
            value = value.rstrip("=/-+")
            if len(value) >= LEAST:
                found.add((start, start + len(value), value))
        yield from sorted(found)


_CREDENTIAL_BYTE = np.isin(np.arange(256), list((_ALNUM + "+/_=-").encode()))
_NAME = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", re.IGNORECASE)


def suspicious(texts: pa.Array) -> np.ndarray:
    """Texts that can have a span at all: those with a run of `LEAST` credential bytes (which access keys, long hex
    strings and candidates are), or a named assignment. Runs over a text's border flag too much, never too little."""
    out = []
    for _, _, buf, offsets in ragged.slices(texts):
        flag = np.zeros(len(offsets) - 1, bool)
        stops = np.r_[-1, np.flatnonzero(~_CREDENTIAL_BYTE[buf]), len(buf)]
        for k in np.flatnonzero(np.diff(stops) > LEAST):
            lo, hi = np.searchsorted(offsets, (stops[k] + 1, stops[k + 1] - 1), "right") - 1
            flag[lo : hi + 1] = True
        for k in np.flatnonzero(~flag & (ragged.sums((buf == 0x3A) | (buf == 0x3D), offsets) > 0)):
            flag[k] = bool(_NAME.search(buf[offsets[k] : offsets[k + 1]].tobytes()))
        out.append(flag)
    return np.concatenate(out) if out else np.zeros(0, bool)


def published_credentials(per_format: int = 200) -> dict[str, list[str]]:
    """Strings of the published formats and of none (`opaque`), the same ones each time."""
    rng = random.Random(20)
    found = {label: [prefix + "".join("".join(rng.choices(x, k=n)) for x, n in parts) for _ in range(per_format)] for label, prefix, parts in FORMATS}
    found["opaque"] = ["".join(rng.choices(_ALNUM + rng.choice(("", "+/", "_-")), k=rng.randint(LEAST, 64))) for _ in range(4 * per_format)]
    for label, alphabet in (("opaque_lower", string.ascii_lowercase + string.digits), ("opaque_upper", _UPPER)):
        found[label] = ["".join(rng.choices(alphabet, k=rng.randint(LEAST, 64))) for _ in range(2 * per_format)]
    return found


def _ordinary_tokens(count: int = 600) -> list[str]:
    """Tokens that aren't secrets: joined words, paths, dates and numbered names, from a fixed generator."""
    rng = random.Random(21)
    part = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    kinds = [lambda: "-".join(part() for _ in range(rng.randint(2, 6))) + f"-{rng.randint(1, 2030)}", lambda: "/".join(part().capitalize() for _ in range(4)) + f"/{rng.randint(1, 99)}", lambda: "_".join(part() for _ in range(4)) + f"_{rng.randint(0, 9)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-{part()}", lambda: f"{part().upper()}{rng.randint(10, 99999)}{part()}{part()}", lambda: "".join(part().capitalize() for _ in range(4)), lambda: "_".join(part().upper() for _ in range(4)), lambda: "=" * rng.randint(16, 60), lambda: "-" * rng.randint(16, 60)]
    return [rng.choice(kinds)() for _ in range(count)]


def _ordinary_shapes(count: int = 200) -> list[list[str]]:
    """Numbers, UUIDs and timestamps."""
    rng = random.Random(22)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    kinds = (lambda: "".join(rng.choices(string.digits, k=rng.randint(16, 40))), lambda: "-".join(map(hexes, (8, 4, 4, 4, 12))), lambda: f"20{rng.randint(0, 39):02}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}-{rng.randint(0, 59):02}-{rng.randint(0, 59):02}Z")
    return [[kind() for _ in range(count)] for kind in kinds]


_SYMBOLS = sorted({*_ALNUM, *"+/_=-"})
_EDGE = 0  # what stands for the border of a run


def _bigrams(buf: np.ndarray) -> np.ndarray:
    """Counts of byte pairs within runs of credential bytes shorter than `LEAST`, with _EDGE around them."""
    inside = _CREDENTIAL_BYTE[buf]
    stops = np.r_[-1, np.flatnonzero(~inside), len(buf)]
    long = np.flatnonzero(np.diff(stops) > LEAST)
    x = np.where(inside, buf, _EDGE).astype(np.int64)
    for k in long:
        x[stops[k] + 1 : stops[k + 1]] = _EDGE
    x = np.r_[_EDGE, x, _EDGE]
    return np.bincount(x[:-1] << 8 | x[1:], minlength=1 << 16)


@dataclass
class Ordinary:
    """The log probability of a symbol after each, and automata of shapes; a text is scored by the likeliest of them."""

    steps: dict[str, dict[str, float]]
    shapes: list[Automaton]

    @classmethod
    def fit(cls, counts: np.ndarray | None = None, *, mass: float = 50_000.0, prior: float = 20.0) -> Ordinary:
        """From counts of byte pairs, which weigh `mass` pairs, and the made-up tokens; `prior` pairs of each symbol follow the shares of all."""
        made = sum(_bigrams_of(t) for t in _ordinary_tokens()).astype(float)
        if counts is not None and counts.sum():
            made += counts * (mass / counts.sum())
        at = np.array([_EDGE, *map(ord, _SYMBOLS)])
        made = made.reshape(256, 256)[np.ix_(at, at)]
        made[0, 0] = 0
        share = (made.sum(0) + 0.5) / (made.sum() + 0.5 * len(at))
        logs = np.log((made + prior * share) / (made.sum(1, keepdims=True) + prior))
        names = ["", *_SYMBOLS]
        return cls({a: dict(zip(names, row, strict=True)) for a, row in zip(names, logs.tolist(), strict=True)}, [infer(x) for x in _ordinary_shapes()])

    def log_likelihood(self, text: str) -> float:
        before, total, steps = "", 0.0, self.steps
        for symbol in text:
            total += steps[before][symbol]
            before = symbol
        return max(total + steps[before][""], *(a.log_likelihood(text) for a in self.shapes))


def _bigrams_of(token: str) -> np.ndarray:
    x = np.r_[_EDGE, np.frombuffer(token.encode(), np.uint8), _EDGE].astype(np.int64)
    return np.bincount(x[:-1] << 8 | x[1:], minlength=1 << 16)


def harvest(docs: DataFrame, *, text: str = "text", per_label: int = 400, longest: int = 256, buckets: int = 128) -> tuple[dict[str, list[str]], np.ndarray]:
    """Of the corpus: a sample of each base kind's values, and the counts of byte pairs of ordinary runs over all texts."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))

    def gather(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            texts = batch.column(0)
            flags, found = suspicious(texts), set()
            for lo, hi, buf, offsets in ragged.slices(texts):
                plain = buf.copy()
                for k in np.flatnonzero(flags[lo:hi]):
                    a, b = offsets[k], offsets[k + 1]
                    spans = base_spans(texts[int(lo + k)].as_py())
                    found |= {(BASE_KINDS[x], value) for _, x, _, value in spans if len(value) <= longest}
                    if spans:  # the values' bytes, wherever they stand in this text, aren't ordinary
                        whole = plain[a:b].tobytes()
                        for _, _, _, value in spans:
                            whole = whole.replace(value.encode(), b" " * len(value.encode()))
                        plain[a:b] = np.frombuffer(whole, np.uint8)
                ends = offsets[1:-1][offsets[1:-1] < len(plain)]
                total += _bigrams(np.insert(plain, ends, 0x20))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.int64())], names=["label", "value", "cell", "n"])
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.string()), pa.nulls(len(full), pa.string()), pa.array(full, pa.int32()), pa.array(total[full])], names=["label", "value", "cell", "n"])

    got = materialize(map_batches(rows, gather, "label string, value string, cell int, n long"), "credentials")
    h = F.xxhash64("value")
    sample = got.where("value is not null").groupBy("label", F.length("value"), F.pmod(h, F.lit(buckets))).agg(F.min(F.struct(h.alias("h"), F.col("value"))).alias("x")).select("label", "x.h", "x.value")
    labelled = {kind: [r.value for r in sample.where(F.col("label") == kind).orderBy("h", "value").limit(per_label).collect()] for kind in BASE_KINDS}
    counts, cells = np.zeros(1 << 16, np.int64), got.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    discard(got)
    return labelled, counts


@dataclass
class Grammar:
    """An automaton and a threshold for each label, and the model of ordinary text."""

    automata: dict[str, tuple[Automaton, float]]
    ordinary: Ordinary

    def best(self, value: str) -> tuple[float, float, str]:
        """Of the label that exceeds its threshold by most (the first by name of equals): by how much a symbol and in sum, and its name."""
        ordinary, n = self.ordinary.log_likelihood(value), len(value) + 1
        margin, label = max(((a.log_likelihood(value) - ordinary) / n - t, x) for x, (a, t) in sorted(self.automata.items(), reverse=True)) if self.automata else (-np.inf, "")
        return margin, margin * n, label


@lru_cache(maxsize=64)
def _inferred(values: tuple[str, ...]) -> tuple[Automaton, Automaton]:
    """The automaton of all strings, and that of every other one."""
    return infer(values), infer(values[::2])


def train(labelled: dict[str, list[str]], ordinary: np.ndarray | None = None, *, miss: float = 0.02, slack: float = 0.1, false: float = 0.002) -> Grammar:
    """Infer all automata. A label's threshold is `slack` below what the share `miss` of its strings falls short of by the
    automaton of the others, but not below zero, nor below what the share `false` of ordinary tokens exceeds."""
    out = Grammar({}, Ordinary.fit(ordinary))
    plain = [t for t in _ordinary_tokens(1500)[600:] if len(t) >= LEAST] + [t for shape in _ordinary_shapes(400) for t in shape[200:]]
    against = [out.ordinary.log_likelihood(t) for t in plain]
    for label, values in sorted(labelled.items()):
        if values:
            whole, half = _inferred(tuple(values))
            own = sorted((half.log_likelihood(v) - out.ordinary.log_likelihood(v)) / (len(v) + 1) for v in values[1::2] or values)
            wrong = sorted((whole.log_likelihood(t) - o) / (len(t) + 1) for t, o in zip(plain, against, strict=True))
            out.automata[label] = whole, max(own[int(miss * len(own))] - slack, wrong[int((1 - false) * len(wrong))] + 1e-9, 0.0)
    return out


def learn(docs: DataFrame, *, text: str = "text") -> Grammar:
    """The grammar of the published formats and of the corpus."""
    labelled, ordinary = harvest(docs, text=text)
    return train(published_credentials() | labelled, ordinary)


def find_spans(text: str, grammar: Grammar) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int, float]], list[float]]:
    """Base spans (start, kind number, end), added spans (start, label, end, margin) that don't overlap them, and the margins of all candidates."""
    base = [(a, k, b) for a, k, b, _ in base_spans(text)]
    covered = _merged((a, b) for a, _, b in base)
    hits, margins = [], []
    for start, end, value in candidates(text):
        margin, total, label = grammar.best(value)
        margins.append(margin)
        if margin >= 0 and not _overlaps(covered, start, end):
            hits.append((-total, start, -end, label, margin))
    added: list[tuple[int, str, int, float]] = []
    taken: list[tuple[int, int]] = []
    for _, start, end, label, margin in sorted(hits):
        if not _overlaps(taken, start, -end):
            insort(taken, (start, -end))
            added.append((start, label, -end, margin))
    return base, sorted(added), margins


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as sorted spans that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of sorted spans that don't overlap each other overlaps [start, end)."""
    at = bisect_left(spans, (end, -1))
    return at > 0 and spans[at - 1][1] > start


def scan(docs: DataFrame, grammar: Grammar, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_candidates and best_margin (of all candidates, null without one)."""
    rows, shared = docs.select(F.col(key), F.col(text).alias("__text")), docs.sparkSession.sparkContext.broadcast(grammar)
    names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "n_candidates", "best_margin"]
    clean = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0, None)

    def describe(t):
        base, added, margins = find_spans(t, shared.value)
        told = [f"{BASE_KINDS[k]}:{a}:{b}" for a, k, b in base]
        both = sorted([(a, k, f"{BASE_KINDS[k]}:{a}:{b}") for a, k, b in base] + [(a, len(BASE_KINDS), f"{label}:{a}:{b}") for a, label, b, _ in added])
        return (*(sum(x == k for _, x, _ in base) for k in range(3)), hashlib.sha256(",".join(told).encode()).hexdigest(), ",".join(x for *_, x in both), len(added), len(margins), max(margins, default=None))

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1), [clean] * batch.num_rows
            for k in np.flatnonzero(suspicious(texts)):
                out[k] = describe(texts[int(k)].as_py())
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True))], names=names)

    return map_batches(rows, run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_candidates long, best_margin double")


def redact(docs: DataFrame, grammar: Grammar, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with each secret span of the text (overlapping ones together) replaced by a mark."""
    at, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(grammar)

    def clean(t):
        base, added, _ = find_spans(t, shared.value)
        out, done = [], 0
        for a, b in _merged([(a, b) for a, _, b in base] + [(a, b) for a, _, b, _ in added]):
            out += [t[done:a], mark]
            done = b
        return "".join([*out, t[done:]])

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            changed = {int(k): new for k in np.flatnonzero(suspicious(texts)) if (new := clean(old := texts[int(k)].as_py())) != old}
            if changed:  # texts without a secret stay in their buffer
                mask = np.zeros(len(texts), bool)
                mask[list(changed)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], texts.type))
                batch = batch.set_column(at, batch.schema.field(at), texts)
            yield batch

    return map_batches(docs, run, docs.schema)
