"""Reading ABC tunes: written bars with notes, rests and chord symbols in ticks, meters, ties and the performed route.

A reader of the notation that scores here use: headers X, T, C, M, L, Q, K, V and P; notes with accidentals, octaves, lengths,
ties and broken rhythm; chords in brackets; rests z and x and whole-bar rests Z; tuplets; barlines with repeats and numbered
endings; quoted chord symbols (annotations are skipped); inline fields; several voices, whose barlines must agree where they
sound together. Decorations, grace notes, slurs and words are read over. What it can't read is an error of that tune.

Accidentals hold to the barline; keys are major, minor or modal. Repeats and endings, or the order of sections in P:, give the
route; one that can't be followed leaves the bars valid and the route unsupported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.columns import SHARP_ORDER, STEPS, TICKS_PER_QUARTER

MOST_SIGNS = 1_000_000
WHOLE = 4 * TICKS_PER_QUARTER
NOTE = "struct<onset:long,duration:long,pitch:int,voice:string,tie_start:boolean,tie_end:boolean>"
REST = "struct<onset:long,duration:long,voice:string,visible:boolean>"
CHORD = "struct<onset:long,symbol:string,voice:string>"
BAR = f"struct<number:int,duration_ticks:long,expected_ticks:long,meter:string,meter_valid:boolean,partial_reason:string,notes:array<{NOTE}>,rests:array<{REST}>,chords:array<{CHORD}>>"
SCORE = f"valid boolean, errors array<string>, warnings array<string>, ticks_per_quarter int, measures array<{BAR}>, route array<int>, route_status string, counts struct<measures:int,noteheads:int,rests:int,chord_labels:int,performed_measures:int>"

#: Steps from the major key to each mode's, in fifths; notes in the time of others.
MODES = {"": 0, "maj": 0, "ion": 0, "m": -3, "min": -3, "aeo": -3, "dor": -2, "phr": -4, "lyd": 1, "mix": -1, "loc": -5}
TUPLETS = {2: 3, 3: 2, 4: 3, 5: 2, 6: 2, 7: 2, 8: 3, 9: 2}
MARKUP = re.compile(r"^\s*(?:%%|I:)\s*(?:begin\w*|end\w*|include|abc-include|abcm2ps|ss-pref|js|javascript|ps|postscript|svg|html)\b", re.I | re.M)
TAGS = re.compile(r"<\s*/?\s*(?:script|svg|html|iframe)\b", re.I)

SIGN = re.compile(
    r"""(?P<quoted>"[^"\n]*")|(?P<inline>\[(?P<field>[A-Za-z]):(?P<value>[^\]\n]*)\])|(?P<grace>\{[^}\n]*\})|(?P<deco>![^!\n]*!|\+[^+\n]*\+)
    |(?P<bar>:*\|[\]|:]*(?:\s*\[?(?P<ending>[0-9][0-9,-]*))?|::+|\[\||\[(?P<ending2>[0-9][0-9,-]*))|(?P<tuplet>\((?P<p>[2-9])(?::(?P<q>[0-9]*))?(?::(?P<r>[0-9]*))?)
    |(?P<chord>\[(?P<heads>[^\]\n|:]+)\](?P<clen>[0-9]*(?:/+[0-9]*)?)(?P<ctie>-?))|(?P<note>(?P<acc>\^{1,2}|_{1,2}|=)?(?P<step>[A-Ga-g])(?P<oct>[,']*)(?P<nlen>[0-9]*(?:/+[0-9]*)?)(?P<ntie>-?))
    |(?P<rest>[zx](?P<rlen>[0-9]*(?:/+[0-9]*)?))|(?P<whole>Z(?P<bars>[0-9]*))|(?P<broken><+|>+)|(?P<skip>[\s()`~.HLMOPSTuv\\&y-])""",
    re.X,
)
HEAD = re.compile(r"(\^{1,2}|_{1,2}|=)?([A-Ga-g])([,']*)([0-9]*(?:/+[0-9]*)?)(-?)")


class Unreadable(ValueError):
    """What is wrong with a tune."""


def problems(text: object) -> list[str]:
    """Why a text isn't taken as a tune: too long, headers missing or unsure, several tunes, markup."""
    if not isinstance(text, str) or len(text) > MOST_SIGNS:
        return [f"a tune is a text of at most {MOST_SIGNS} characters"]
    found = [f"no {name} header" for name in "XMK" if not re.search(rf"^{name}:[ \t]*\S+", text, re.M)]
    if len(re.findall("^X:", text, re.M)) != 1:
        found.append("exactly one tune is needed")
    if re.search(r"^[MK]:\s*\?\s*$", text, re.M):
        found.append("meter and key must be known")
    if MARKUP.search(text) or TAGS.search(text):
        found.append("markup and directives are not allowed")
    return found


def length_of(text: str) -> Fraction:
    """A length such as 3, /, //, /4 or 3/2 as a multiple."""
    top, slash, bottom = text.partition("/")
    if not slash:
        return Fraction(int(top or 1))
    strokes = 1 + len(bottom) - len(bottom.lstrip("/"))
    bottom = bottom.lstrip("/")
    return Fraction(int(top or 1), int(bottom) if bottom else 2**strokes)


def meter_of(text: str) -> tuple[int, int] | None:
    """Numerator and denominator of 3/4, C or C|; none for a free or unknown meter."""
    text = text.strip()
    if m := re.fullmatch(r"(\d+)\s*/\s*(\d+)", text):
        return (int(m[1]), int(m[2])) if int(m[1]) and int(m[2]) else None
    return {"C": (4, 4), "C|": (2, 2)}.get(text)


def key_of(text: str) -> dict[str, int]:
    """Alterations of steps in a key such as G, Bb, F#m, D dor."""
    m = re.match(r"\s*([A-G])([#b]?)\s*([A-Za-z]*)", text)
    if not m:
        if text.strip().lower().startswith(("none", "hp")):
            return {}
        raise Unreadable(f"key {text.strip()!r}")
    mode = m[3].lower()
    mode = "m" if mode == "m" else mode[:3]
    fifths = "FCGDAEB".index(m[1]) - 1 + {"#": 7, "b": -7, "": 0}[m[2]] + MODES.get(mode, 0)
    if abs(fifths) > 7:
        raise Unreadable(f"key {text.strip()!r}")
    order = SHARP_ORDER if fifths > 0 else SHARP_ORDER[::-1]
    return dict.fromkeys(order[: abs(fifths)], 1 if fifths > 0 else -1)


@dataclass
class Voice:
    """What a voice has so far: its events and barlines, and the state of its reading."""

    name: str
    key: dict[str, int]
    unit: Fraction
    at: Fraction = Fraction(0)
    events: list[dict] = field(default_factory=list)
    bars: list[tuple[Fraction, str, str]] = field(default_factory=list)
    altered: dict[tuple[str, int], int] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    tied: set[int] = field(default_factory=set)
    stretch: Fraction = Fraction(1)
    tuplet: list = field(default_factory=list)


class Tune:
    def __init__(self, text: str):
        self.voices: dict[str, Voice] = {}
        self.meters: list[tuple[Fraction, tuple[int, int] | None]] = []
        self.sections: list[tuple[Fraction, str]] = []
        self.order, self.unit, self.warnings = "", None, []
        header, body = [], False
        self.key: dict[str, int] = {}
        self.now: Voice | None = None
        for line in text.replace("\r\n", "\n").split("\n"):
            line = re.sub(r"(?<!\\)%.*$", "", line).rstrip()
            if not line:
                continue
            m = re.match(r"([A-Za-z+]):(.*)$", line)
            if m and not body:
                self.head(m[1], m[2])
                header.append(m[1])
                body = m[1] == "K"
            elif m and m[1] not in "wWs+":
                self.inline(m[1], m[2])
            elif not m and body:
                self.read(line)
        if not body:
            raise Unreadable("no K header")

    def head(self, name: str, value: str) -> None:
        if name == "M":
            self.meters = [(Fraction(0), meter_of(value))]
        elif name == "L":
            self.unit = Fraction(value.strip()) * WHOLE
        elif name == "P":
            self.order = re.sub(r"\s", "", value)
        elif name == "K":
            self.key = key_of(value)
        elif name == "V":
            self.voice(value)

    def default_unit(self) -> Fraction:
        if self.unit is not None:
            return self.unit
        meter = self.meters[0][1] if self.meters else None
        return Fraction(WHOLE, 16 if meter and Fraction(*meter) < Fraction(3, 4) else 8)

    def voice(self, value: str) -> Voice:
        name = value.split()[0] if value.split() else "1"
        if name not in self.voices:
            self.voices[name] = Voice(name, dict(self.key), self.default_unit())
        self.now = self.voices[name]
        return self.now

    def current(self) -> Voice:
        voice = self.now or (self.voices[next(iter(self.voices))] if self.voices else self.voice("1"))
        if not voice.events and not voice.bars:
            voice.key, voice.unit = voice.key or dict(self.key), voice.unit
        return voice

    def inline(self, name: str, value: str) -> None:
        if name == "V":
            self.voice(value)
            return
        voice = self.current()
        if name == "K":
            voice.key = key_of(value)
        elif name == "L":
            voice.unit = Fraction(value.strip()) * WHOLE
        elif name == "M":
            self.meters.append((voice.at, meter_of(value)))
        elif name == "P" and voice is next(iter(self.voices.values())):
            self.sections.append((voice.at, value.strip()))

    def pitch(self, voice: Voice, accidental: str | None, letter: str, octaves: str) -> int:
        octave = 4 + letter.islower() + octaves.count("'") - octaves.count(",")
        step = letter.upper()
        if accidental:
            voice.altered[step, octave] = {"^": 1, "^^": 2, "_": -1, "__": -2, "=": 0}[accidental]
        alter = voice.altered.get((step, octave), voice.key.get(step, 0))
        return 12 * (octave + 1) + STEPS[step] + alter

    def place(self, voice: Voice, length: Fraction, heads: list[tuple[int, Fraction, bool]] | None, visible: bool = True) -> None:
        """Put a note, chord (heads with their own lengths) or rest where the voice is."""
        length, heads = length * voice.stretch, heads and [(p, n * voice.stretch, t) for p, n, t in heads]
        voice.stretch = Fraction(1)
        if voice.tuplet:
            ratio, left = voice.tuplet
            length, heads = length * ratio, heads and [(p, n * ratio, t) for p, n, t in heads]
            voice.tuplet = [ratio, left - 1] if left > 1 else []
        event = {"time": voice.at, "length": length, "heads": None, "visible": visible, "labels": voice.labels}
        if heads is not None:
            event["heads"] = [{"pitch": p, "length": n, "tie": t, "tied": p in voice.tied} for p, n, t in heads]
            voice.tied = {p for p, _, t in heads if t}
        voice.labels = []
        voice.events.append(event)
        voice.at += length

    def read(self, line: str) -> None:
        at = 0
        while at < len(line):
            voice = self.current()
            m = SIGN.match(line, at)
            if not m:
                raise Unreadable(f"{line[at : at + 12]!r}")
            at = m.end()
            if m["quoted"]:
                label = m["quoted"][1:-1]
                if label[:1] not in tuple("^_<>@"):
                    voice.labels.append(label)
            elif m["inline"]:
                self.inline(m["field"], m["value"])
            elif m["bar"]:
                ending = m["ending"] or m["ending2"] or ""
                voice.bars.append((voice.at, re.sub(r"[\s0-9,\[-]", "", m["bar"]) if not m["ending2"] else "", ending))
                voice.altered = {}
            elif m["tuplet"]:
                p = int(m["p"])
                q = int(m["q"]) if m["q"] else TUPLETS[p]
                voice.tuplet = [Fraction(q, p), int(m["r"]) if m["r"] else p]
            elif m["note"]:
                length = length_of(m["nlen"]) * voice.unit
                self.place(voice, length, [(self.pitch(voice, m["acc"], m["step"], m["oct"]), length, bool(m["ntie"]))])
            elif m["chord"]:
                outer, heads = length_of(m["clen"]), []
                inner = [h for h in HEAD.finditer(m["heads"])]
                if "".join(h[0] for h in inner) != re.sub(r'"[^"]*"|\s', "", m["heads"]) or not inner:
                    raise Unreadable(f"chord {m['chord']!r}")
                for h in inner:
                    heads.append((self.pitch(voice, h[1], h[2], h[3]), length_of(h[4]) * outer * voice.unit, bool(h[5] or m["ctie"])))
                self.place(voice, heads[0][1], heads)
            elif m["rest"]:
                self.place(voice, length_of(m["rlen"]) * voice.unit, None, m["rest"][0] == "z")
            elif m["whole"]:
                meter = self.meter_at(voice.at)
                if meter is None:
                    raise Unreadable("a whole-bar rest without a meter")
                for k in range(int(m["bars"] or 1)):
                    if k:
                        voice.bars.append((voice.at, "|", ""))
                    self.place(voice, Fraction(WHOLE * meter[0], meter[1]), None)
            elif m["broken"]:
                if not voice.events:
                    raise Unreadable("a broken rhythm without a note before it")
                self.broken(voice, m["broken"])

    def broken(self, voice: Voice, sign: str) -> None:
        more, less = 2 - Fraction(1, 2 ** len(sign)), Fraction(1, 2 ** len(sign))
        before, after = (more, less) if sign[0] == ">" else (less, more)
        last = voice.events[-1]
        voice.at += last["length"] * (before - 1)
        for head in last["heads"] or ():
            head["length"] *= before
        last["length"] *= before
        voice.stretch = after

    def meter_at(self, time: Fraction) -> tuple[int, int] | None:
        known = sorted(self.meters, key=lambda m: m[0])
        at = bisect_right([t for t, _ in known], time)
        return known[at - 1][1] if at else None


def synchronised(voices: list[Voice]) -> bool:
    """Whether voices that sound together have the same barlines there."""
    for i, a in enumerate(voices):
        for b in voices[i + 1 :]:
            if not (a.events and b.events and a.bars and b.bars):
                continue
            start = max(a.events[0]["time"], b.events[0]["time"])
            stop = min(max(e["time"] + e["length"] for e in v.events) for v in (a, b))
            inside = [sorted({t for t, _, _ in v.bars if start < t <= stop}) for v in (a, b)]
            if stop > start and inside[0] != inside[1]:
                return False
    return True


def repeats_route(bars: list[tuple[int, str, str]], n: int) -> list[int]:
    """The bars, from 1, that repeats and numbered endings lead through. `bars` are signs at boundaries: (place, sign, ending), place k before bar k + 1."""
    starts = {0} | {k for k, sign, _ in bars if sign.endswith(":")}
    backs = {k for k, sign, _ in bars if sign.startswith(":")}
    endings = {k: {int(x) for part in e.split(",") for x in (range(int(part.split("-")[0]), int(part.split("-")[-1]) + 1) if part else ())} for k, _, e in bars if e}
    closes = {k for k, sign, _ in bars if sign in ("||", "|]", "]") or sign.startswith(":")}
    route, at, origin, turn, played = [], 0, 0, 1, set()
    while at < n:
        if at in starts and at != origin and at not in played:
            origin, turn = at, 1
        if at in endings and turn not in endings[at]:
            later = [k for k in sorted(endings) if k > at and turn in endings[k]]
            nearer = [k for k in sorted(closes) if k > at]
            at = min([*(later[:1]), *([] if later else nearer[:1]), n])
            continue
        route.append(at + 1)
        if len(route) > 64 * n:
            raise Unreadable("the repeats don't end")
        at += 1
        if at in backs and (at, turn) not in played:
            turns = max((max(e) for k, e in endings.items() if origin < k <= at), default=2)
            more = max((max(e) for k, e in endings.items() if k > origin and k <= at), default=0)
            again = turn < 2 if not more else turn < max(turns, 2) or any(turn + 1 in e for e in endings.values())
            if again:
                played.add((at, turn))
                turn, at = turn + 1, origin
            else:
                origin, turn = at, 1
    return route


def read_tune(text: object) -> dict:
    """The written bars and the route of a tune, or its errors."""
    empty = {"valid": False, "errors": problems(text), "warnings": [], "ticks_per_quarter": TICKS_PER_QUARTER, "measures": [], "route": None, "route_status": "unavailable", "counts": {"measures": 0, "noteheads": 0, "rests": 0, "chord_labels": 0, "performed_measures": None}}
    if empty["errors"]:
        return empty
    try:
        return {**empty, **bars_of(Tune(text)), "valid": True}
    except (Unreadable, ZeroDivisionError, ValueError) as failure:
        return {**empty, "errors": [f"can't read {failure}"]}


def whole_ticks(time: Fraction) -> int:
    if time.denominator != 1:
        raise Unreadable(f"a time of {time} ticks")
    return int(time)


def bars_of(tune: Tune) -> dict:
    voices = [v for v in tune.voices.values() if v.events]
    if not voices:
        raise Unreadable("a tune without notes or rests")
    if not synchronised(voices):
        raise Unreadable("voices whose barlines don't agree")
    end = max(e["time"] + e["length"] for v in voices for e in v.events)
    if end <= 0:
        raise Unreadable("a tune that takes no time")
    edges = sorted({Fraction(0), end, *(t for v in voices for t, _, _ in v.bars if 0 < t < end)})
    bars = []
    for k, (start, stop) in enumerate(zip(edges, edges[1:], strict=False)):
        meter = tune.meter_at(start)
        expected = Fraction(WHOLE * meter[0], meter[1]) if meter else None
        bar = {"number": k + 1, "duration_ticks": whole_ticks(stop - start), "expected_ticks": None if expected is None else whole_ticks(expected), "meter": meter and f"{meter[0]}/{meter[1]}", "meter_valid": None if expected is None else stop - start == expected, "partial_reason": None, "notes": [], "rests": [], "chords": []}
        for v in voices:
            for e in v.events:
                if start <= e["time"] < stop:
                    onset = whole_ticks(e["time"] - start)
                    for h in e["heads"] or ():
                        bar["notes"].append({"onset": onset, "duration": whole_ticks(h["length"]), "pitch": h["pitch"], "voice": v.name, "tie_start": h["tie"], "tie_end": h["tied"]})
                    if e["heads"] is None:
                        bar["rests"].append({"onset": onset, "duration": whole_ticks(e["length"]), "voice": v.name, "visible": e["visible"]})
                    bar["chords"] += [{"onset": onset, "symbol": label, "voice": v.name} for label in e["labels"]]
        for name in ("notes", "rests", "chords"):
            bar[name].sort(key=lambda x: (x["onset"], x["voice"], str(x)))
        bars.append(bar)
    first, last = bars[0], bars[-1]
    if first["expected_ticks"] is not None and first["duration_ticks"] < first["expected_ticks"]:
        first["partial_reason"], first["meter_valid"] = "pickup_candidate", None
        if last is not first and last["expected_ticks"] == first["expected_ticks"] == first["duration_ticks"] + last["duration_ticks"]:
            first["partial_reason"], last["partial_reason"] = "pickup", "pickup_complement"
            first["meter_valid"] = last["meter_valid"] = True
    route, warnings = route_of(tune, voices[0], edges, len(bars))
    counts = {"measures": len(bars), "noteheads": sum(len(b["notes"]) for b in bars), "rests": sum(r["visible"] for b in bars for r in b["rests"]), "chord_labels": sum(len(b["chords"]) for b in bars), "performed_measures": route and len(route)}
    return {"measures": bars, "route": route, "route_status": "resolved" if route else "unsupported", "warnings": warnings, "counts": counts}


def route_of(tune: Tune, voice: Voice, edges: list[Fraction], n: int) -> tuple[list[int] | None, list[str]]:
    """The performed bars, or none with a warning."""
    place = {t: k for k, t in enumerate(edges)}
    try:
        if tune.order:
            starts = [(place.get(t), name) for t, name in tune.sections]
            names = [name for _, name in starts]
            if not re.fullmatch("[A-Z]{1,128}", tune.order) or any(not re.fullmatch("[A-Z]", x) for x in names) or len(set(names)) != len(names):
                raise Unreadable("an order of sections that isn't of single letters, each named once")
            if None in [k for k, _ in starts] or not starts or starts[0][0] != 0 or any(x not in names for x in tune.order):
                raise Unreadable("sections that don't start at bars, or are missing")
            ends = {name: (k, nxt) for (k, name), nxt in zip(starts, [*(k for k, _ in starts[1:]), n], strict=True)}
            route = [bar + 1 for x in tune.order for bar in range(*ends[x])]
        else:
            signs = [(place[t], sign, ending) for t, sign, ending in voice.bars if t in place]
            opened = closed = False
            for _, sign, _ in signs:
                if sign.startswith(":"):
                    if closed and not opened:
                        raise Unreadable("a backward repeat after a closed one without a new left repeat")
                    if opened:
                        opened, closed = False, True
                opened = opened or sign.endswith(":")
            route = repeats_route(signs, n)
        if set(route) != set(range(1, n + 1)):
            raise Unreadable("a route that misses bars")
        return route, []
    except Unreadable as failure:
        return None, [f"the route can't be followed: {failure}"]


def read_abc(tunes: DataFrame, text: str = "abc") -> DataFrame:
    """Rows with what their tune says: valid, errors, warnings, measures, route, route_status, counts."""
    sample = tunes.sparkSession.createDataFrame([], SCORE).toArrow().schema
    at = tunes.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = [read_tune(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[f.name] for s in scores], f.type) for f in sample)], names=[*batch.schema.names, *sample.names])

    return tunes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tunes.schema) + ", " + SCORE)


def bars_table(scores: DataFrame, by: str) -> DataFrame:
    """(by, place from 0, and the fields of a bar) of read tunes."""
    from pyspark.sql import functions as F

    return scores.select(by, F.posexplode("measures").alias("place", "m")).select(by, "place", "m.*")
