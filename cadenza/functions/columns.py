"""Column functions: ratios, names, chord symbols, pitches, durations, hashes, clocks. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_QUARTER = 384

#: Rewrites before a chord symbol is read, in order.
SYMBOL_REWRITES = (("Δ7", "maj7"), ("Δ", "maj7"), ("♭", "b"), ("♯", "#"), ("°", "dim"), ("º", "dim"), ("ø", "m7b5"), ("–", "-"), ("—", "-"))
#: Chord qualities and their usual form.
QUALITIES = {
    "": "", "maj": "", "major": "", "m": "m", "min": "m", "minor": "m", "-": "m", "7": "7", "maj7": "maj7", "major7": "maj7",
    "m7": "m7", "min7": "m7", "minor7": "m7", "6": "6", "m6": "m6", "min6": "m6", "dim": "dim", "dim7": "dim7", "m7b5": "m7b5",
    "aug": "aug", "+": "aug", "sus": "sus", "sus2": "sus2", "sus4": "sus4", "add9": "add9", "9": "9", "11": "11", "13": "13",
}
#: Semitones of the steps, sharps' and flats' order, chord intervals, harmony kinds and alterations.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
SHARP_ORDER = "FCGDAEB"
INTERVALS = {
    "": (0, 4, 7), "maj": (0, 4, 7), "M": (0, 4, 7), "m": (0, 3, 7), "min": (0, 3, 7), "-": (0, 3, 7), "6": (0, 4, 7, 9), "m6": (0, 3, 7, 9),
    "7": (0, 4, 7, 10), "maj7": (0, 4, 7, 11), "M7": (0, 4, 7, 11), "m7": (0, 3, 7, 10), "min7": (0, 3, 7, 10), "dim": (0, 3, 6), "o": (0, 3, 6),
    "dim7": (0, 3, 6, 9), "o7": (0, 3, 6, 9), "aug": (0, 4, 8), "+": (0, 4, 8), "sus": (0, 5, 7), "sus4": (0, 5, 7), "sus2": (0, 2, 7), "7sus4": (0, 5, 7, 10),
}
KIND_SYMBOL = {"major": "", "minor": "m", "dominant": "7", "minor-sixth": "m6"}
ALTERATION = {-2: "bb", -1: "b", 0: "", 1: "#", 2: "##"}


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) if not isinstance(x, tuple) else F.array(*map(F.lit, x)) for pair in values.items() for x in pair))


def safe_ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den; `empty` where the denominator is zero (0, 1 or null by the metric's policy)."""
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(empty).cast("double"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, digits: int = 6) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, zero where undefined."""
    return tuple(F.round(safe_ratio(a, b), digits) for a, b in ((tp, tp + fp), (tp, tp + fn), (2 * tp, 2 * tp + fp + fn)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


@lru_cache(maxsize=1)
def _ascii_forms() -> dict[str, str]:
    """The ASCII part of each other character's compatibility decomposition, where it has one."""
    found = {}
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000 and (plain := unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()):
            found[chr(code)] = plain
    return found


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits of the compatibility decomposition (NFKD), with one hyphen for each run of blanks,
    hyphens, underscores or slashes; `untitled` if nothing is left. Only texts with other characters are taken apart."""
    one = lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(literal_map(_ascii_forms()), c), F.lit("")))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), one), "")).otherwise(text)
    blank = r"\s\x1C-\x1F_/-"
    kept = F.regexp_replace(F.regexp_replace(F.lower(plain), f"[^a-z0-9{blank}]", ""), f"[{blank}]+", "-")
    return F.coalesce(blank_to_null(F.regexp_replace(kept, r"^-+|-+$", "")), F.lit("untitled"))


def chord_symbol(raw: Column) -> Column:
    """Canonical chord symbol: usual signs, upper-case root, usual quality, slash bass. M alone is major and M7 a major
    seventh; other qualities are looked up as they are, then in lower case, and stay if unknown, as does a bass that
    isn't a note. A text without a root stays; null gives the empty text."""
    text = F.coalesce(raw, F.lit(""))
    for old, new in SYMBOL_REWRITES:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(?U)\s+", "")
    part = lambda k: F.regexp_extract(text, "(?s)^([A-Ga-g])(##|bb|[#b])?(.*)$", k)
    quality, known = F.substring_index(part(3), "/", 1), literal_map(QUALITIES)
    quality = F.when(quality == "M", "").when(quality == "M7", "maj7").otherwise(F.coalesce(F.try_element_at(known, quality), F.try_element_at(known, F.lower(quality)), quality))
    bass = F.regexp_extract(part(3), "(?s)^[^/]*/(.*)$", 1)
    bass = F.when(bass.rlike("^[A-Ga-g](##|bb|[#b])?$"), F.concat(F.upper(F.substring(bass, 1, 1)), F.substring(bass, 2, 2))).otherwise(bass)
    return F.when(part(1) == "", text).otherwise(F.concat(F.upper(part(1)), part(2), quality, F.when(F.contains(part(3), F.lit("/")), F.concat(F.lit("/"), bass)).otherwise("")))


def plain_accidentals(symbol: Column) -> Column:
    """A chord symbol with ASCII accidentals and no blanks around it, as a key for comparing."""
    return F.trim(F.translate(symbol, "♭♯", "b#"))


def harmony_symbol(step: Column, alter: Column, text: Column, kind: Column, bass: Column, bass_alter: Column) -> Column:
    """Chord symbol of a harmony: root, then the shown text, else the kind's usual sign, else the kind itself, and the bass. Null for an unknown root or kind."""
    sign = lambda a: F.coalesce(F.try_element_at(literal_map(ALTERATION), F.coalesce(a, F.lit(0)).cast("int")), F.lit(""))
    kind = F.trim(kind)
    body = F.coalesce(blank_to_null(text), F.try_element_at(literal_map(KIND_SYMBOL), kind), kind)
    return F.when(F.trim(step).isin(*STEPS), F.concat(F.trim(step), sign(alter), body, F.coalesce(F.concat(F.lit("/"), blank_to_null(bass), sign(bass_alter)), F.lit(""))))


def pitch_to_midi(step: Column, octave: Column, alter: Column) -> Column:
    return ((octave + 1) * 12 + F.element_at(literal_map(STEPS), step) + F.coalesce(alter, F.lit(0))).cast("int")


def key_alteration(step: Column, fifths: Column) -> Column:
    """-1, 0 or 1: what a key signature does to a step."""
    place = F.locate(step, F.lit(SHARP_ORDER)) if isinstance(step, str) else F.instr(F.lit(SHARP_ORDER), step)
    return F.when((fifths > 0) & (place <= fifths), 1).when((fifths < 0) & (8 - place <= -fifths), -1).otherwise(0)


def key_map(fifths: Column) -> Column:
    """The steps that a key signature alters, with -1 or 1; empty for no signature, null beyond seven."""
    steps = F.when(fifths >= 0, F.lit(SHARP_ORDER)).otherwise(F.lit(SHARP_ORDER[::-1]))
    names = F.filter(F.split(F.substring(steps, F.lit(1), F.abs(fifths).cast("int")), ""), lambda x: x != "")
    return F.when(F.abs(fifths) <= 7, F.map_from_arrays(names, F.transform(names, lambda _: F.signum(fifths).cast("int"))))


def staff_step(y: Column, bottom: Column, spacing: Column) -> Column:
    """Whole steps above the bottom line, half a spacing each, halves upwards."""
    return F.floor((bottom - y) / (spacing / 2) + 0.5).cast("int")


def staff_pitch(y: Column, lines: Column, fifths: Column | None = None) -> Column:
    """MIDI pitch of a height on five treble-staff lines (in any order), altered by a key signature."""
    bottom, top = F.array_max(lines), F.array_min(lines)
    place = staff_step(y, bottom, (bottom - top) / 4) + 30  # steps above C0; the bottom line is E4
    letter = F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(place, F.lit(7)) + 1).cast("int"))
    natural = pitch_to_midi(letter, F.floor(place / 7), F.lit(0))
    return natural if fifths is None else (natural + F.coalesce(key_alteration(letter, fifths), F.lit(0))).cast("int")


def midi_to_abc(pitch: Column) -> Column:
    """ABC name with sharps: capitals below the octave of middle C's successor, commas and apostrophes for octaves."""
    names = F.array(*map(F.lit, ("C", "^C", "D", "^D", "E", "F", "^F", "G", "^G", "A", "^A", "B")))
    name, octave = F.element_at(names, (F.pmod(pitch, F.lit(12)) + 1).cast("int")), F.floor(pitch / 12) - 1
    return F.when(octave >= 5, F.concat(F.lower(name), F.repeat(F.lit("'"), (octave - 5).cast("int")))).otherwise(F.concat(name, F.repeat(F.lit(","), F.greatest(4 - octave, F.lit(0)).cast("int"))))


def chord_pitches(symbol: Column) -> Column:
    """MIDI pitches of a chord symbol: bass from 36, root from 48; empty for N.C. and for unknown qualities."""
    text = F.replace(F.replace(F.trim(symbol), F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("b"))
    part = lambda k: F.regexp_extract(text, r"^([A-G][#b]?)([^/]*)(?:/([A-G][#b]?))?$", k)
    pitch_class = lambda note: F.pmod(F.element_at(literal_map(STEPS), F.substring(note, 1, 1)) + F.when(F.substring(note, 2, 1) == "#", 1).when(F.substring(note, 2, 1) == "b", -1).otherwise(0), F.lit(12))
    body = F.transform(F.element_at(literal_map(INTERVALS), part(2)), lambda i: i + 48 + pitch_class(part(1)))
    bass = F.when(part(3) != "", F.array(36 + pitch_class(part(3)))).otherwise(F.array().cast("array<int>"))
    return F.when(part(1) == "", F.array().cast("array<int>")).otherwise(F.coalesce(F.concat(bass, body), F.array().cast("array<int>")))


def ticks(beats: Column) -> Column:
    """Quarter-note beats as whole ticks; null if they aren't whole."""
    exact = beats.cast("decimal(20,8)") * TICKS_PER_QUARTER
    return F.when(exact == F.floor(exact), exact.cast("long"))


def meter_ticks(signature: Column) -> Column:
    """Ticks of a measure from a time signature such as 3/4, C or C|; null if it can't be read."""
    plain = F.when(signature == "C", "4/4").when(signature == "C|", "2/2").otherwise(signature)
    top, bottom = F.try_to_number(F.regexp_extract(plain, r"^(\d{1,3})/", 1), F.lit("999")), F.try_to_number(F.regexp_extract(plain, r"/(\d{1,3})$", 1), F.lit("999"))
    return F.when(plain.rlike(r"^\d{1,3}/\d{1,3}$") & (bottom > 0), (top * 4 * TICKS_PER_QUARTER / bottom).cast("long"))


def unit_interval(value: Column) -> Column:
    """A number within 0 and 1; what isn't a number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def optional_text(value: Column) -> Column:
    """Null for blank text, `none` and `null`."""
    return F.when(~F.lower(F.trim(value)).isin("", "none", "null"), F.trim(value))


def content_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts with a unit separator between them."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def clock(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60), (seconds % 60).cast("int"))


def ellipse_distance(dx: Column, dy: Column, rx: Column, ry: Column) -> Column:
    return F.sqrt((dx / rx) * (dx / rx) + (dy / ry) * (dy / ry))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def canonical_hash(value: Column) -> Column:
    """SHA-256 of the compact JSON of a value whose fields are given in alphabetical order, other characters than ASCII escaped."""
    chars = F.regexp_extract_all(F.to_json(value), F.lit("(?s)."), F.lit(0))

    def escaped(c):
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        pair = F.concat(unit(F.floor((code - 0x10000) / 0x400) + 0xD800), unit((code - 0x10000) % 0x400 + 0xDC00))
        return F.when(code < 0x80, c).when(code < 0x10000, unit(code)).otherwise(pair)

    return F.sha2(F.array_join(F.transform(chars, escaped), ""), 256)


def events_hash(keys: Column) -> Column:
    """SHA-256 of a bag of events, each an array of whole numbers, in order with repeats."""
    return F.sha2(F.to_json(F.array_sort(keys)), 256)


def common_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays; null counts as empty."""
    a, b = (F.coalesce(x, F.array()) for x in (a, b))
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x.eqNullSafe(v)))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))


def same_bag(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values the same number of times; null counts as empty."""
    return F.sort_array(F.coalesce(a, F.array())) == F.sort_array(F.coalesce(b, F.array()))


def bits_shifted(rows: Column, dx: int, dy: int) -> Column:
    """A binary picture, one whole number a row with its lowest bit left, moved right by dx and down by dy; what leaves is lost."""
    moved = F.transform(rows, lambda r: F.shiftleft(r, dx) if dx >= 0 else F.shiftrightunsigned(r, -dx))
    return F.transform(moved, lambda r, k: F.when((k >= dy) & (k - dy < F.size(rows)), F.get(moved, k - dy)).otherwise(F.lit(0).cast("long")))


def shift_jaccard(a: Column, b: Column, width: int, x: int = 3, y: int = 2) -> Column:
    """The best share of common ink of two binary pictures of the same height over moves of one by up to x and y; 1 if both are blank.

    Rows are whole numbers below 2^width (width at most 62 - x)."""
    mask = F.lit((1 << width) - 1).cast("long")
    ink = lambda rows: F.aggregate(rows, F.lit(0), lambda s, r: s + F.bit_count(r))

    def score(dx: int, dy: int) -> Column:
        moved = F.transform(bits_shifted(b, dx, dy), lambda r: r.bitwiseAND(mask))
        both = ink(F.zip_with(a, moved, lambda p, q: p.bitwiseAND(q)))
        return safe_ratio(both, ink(F.zip_with(a, moved, lambda p, q: p.bitwiseOR(q))), 1.0)

    return F.array_max(F.array(*(score(dx, dy) for dx in range(-x, x + 1) for dy in range(-y, y + 1))))


def without_labels(abc: Column) -> Column:
    """ABC text without quoted chord labels."""
    return F.regexp_replace(abc, '"[^"\n]*"', "")


def iso_time(at: Column) -> Column:
    """UTC time as ISO text with microseconds where there are any, and a Z; the session's time zone must be UTC."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") != "000000", F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("Z"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, not below zero, to the microsecond."""
    return F.round(F.greatest((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, F.lit(0.0)), 6)
