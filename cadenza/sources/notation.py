"""ABC text of works, written from notes and chord symbols with column functions only.

Notes are (work, measure, onset_beats, duration_beats, pitch_midi, accidental), chord symbols
(work, measure, onset_beats, place, symbol), both in quarter-note beats; `place` orders symbols
of one onset. Within a measure, notes and the gaps between them are parts on a grid of ticks;
each part is cut where a chord symbol stands, and notes that go on are tied.

Defined results: a work without notes and symbols gets a bar of four notes as its text. Works
that `problems` names get a null text. Measure 0 is a pickup and ends with what it holds.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

#: Signs of accidentals, the bar of an empty work, the finest written part of a beat.
SIGNS = {-2: "__", -1: "_", 0: "=", 1: "^", 2: "^^"}
EMPTY_BAR, FINEST = "C D E F |", 64


def duration_text(length: Column) -> Column:
    """Length in ticks as a multiple of a beat: nothing for one, n, /d or n/d, to the nearest part of 1/64 at least."""
    parts = [Fraction(t, C.TICKS_PER_QUARTER).limit_denominator(FINEST) for t in range(C.TICKS_PER_QUARTER)]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(length, F.lit(C.TICKS_PER_QUARTER)) + 1).cast("int")).cast("long")
    bottom = pick([p.denominator for p in parts])
    top = pick([p.numerator for p in parts]) + bottom * F.floor(length / C.TICKS_PER_QUARTER)
    return F.when((top == 1) & (bottom == 1), "").when(top == 1, F.concat(F.lit("/"), bottom)).when(bottom == 1, top.cast("string")).otherwise(F.concat(top, F.lit("/"), bottom))


def note_text(pitch: Column, accidental: Column) -> Column:
    """Name of a note: spelled by its accidental where that leaves a step, else with sharps."""
    step = pitch - accidental
    spelled = F.concat(F.coalesce(F.try_element_at(C.literal_map(SIGNS), accidental), F.lit("")), C.midi_to_abc(step))
    return F.when(F.pmod(step, F.lit(12)).isin(*C.STEPS.values()), spelled).otherwise(C.midi_to_abc(pitch))


def _on_grid(notes: DataFrame, by: str) -> DataFrame:
    return notes.select(by, F.col("measure").cast("long").alias("measure"), C.ticks(F.col("onset_beats")).alias("at"), C.ticks(F.col("duration_beats")).alias("length"), "pitch_midi", F.col("accidental").cast("int").alias("accidental"))


def problems(notes: DataFrame, by: str = "slug") -> DataFrame:
    """(work, measure, problem) of notes that can't be written: off the grid, not positive, of other length than those of the same onset, or overlapping."""
    rows = _on_grid(notes, by)
    groups = rows.groupBy(by, "measure", "at").agg(F.min("length").alias("least"), F.max("length").alias("length"), F.count("*").alias("n"), F.count("length").alias("known"))
    before = F.max(F.col("at") + F.col("length")).over(W.partitionBy(by, "measure").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    problem = F.when(F.col("at").isNull() | (F.col("known") < F.col("n")), "off the grid").when(F.col("least") <= 0, "not positive").when(F.col("least") != F.col("length"), "lengths differ").when(F.col("at") < before, "overlap")
    return groups.select(by, "measure", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def _pieces(notes: DataFrame, bars: DataFrame, by: str) -> DataFrame:
    """(work, measure, pieces): simultaneous notes cut at barlines, in order."""
    one = F.struct(F.col("pitch_midi").alias("pitch"), F.coalesce("accidental", F.lit(0)).alias("order"), "accidental")
    groups = _on_grid(notes, by).groupBy(by, "measure", "at").agg(F.array_sort(F.collect_list(one)).alias("heads"), F.max("length").alias("length"))
    names = F.transform("heads", lambda h: note_text(h["pitch"], h["accidental"]))
    body = F.when(F.size(names) == 1, F.element_at(names, 1)).otherwise(F.concat(F.lit("["), F.array_join(names, ""), F.lit("]")))
    start = F.col("measure") * F.col("bar") + F.col("at")
    timed = groups.join(bars, by).select(by, "bar", body.alias("body"), start.alias("start"), (start + F.col("length")).alias("stop")).where("stop > start")
    cut = timed.withColumn("measure", F.explode(F.sequence(F.floor(F.col("start") / F.col("bar")), F.floor((F.col("stop") - 1) / F.col("bar")))))
    first = F.col("measure") * F.col("bar")
    piece = F.struct(F.greatest(F.col("start") - first, F.lit(0).cast("long")).alias("begin"), "start", F.least(F.col("stop") - first, F.col("bar")).alias("end"), (F.col("stop") > first + F.col("bar")).alias("goes_on"), "body")
    return cut.groupBy(by, "measure").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))


def _symbols(chords: DataFrame, by: str) -> DataFrame:
    """(work, measure, marks): a map from ticks to the symbol there; different symbols of one onset are joined, each part once."""
    rows = chords.select(by, F.col("measure").cast("long").alias("measure"), C.ticks(F.col("onset_beats")).alias("at"), "place", F.trim("symbol").alias("symbol")).where("at IS NOT NULL")
    there = rows.groupBy(by, "measure", "at").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda s: s["symbol"])).alias("s"))
    merged = F.when(F.size("s") == 1, F.element_at("s", 1)).otherwise(F.array_join(F.array_distinct(F.filter(F.flatten(F.transform("s", lambda x: F.split(x, r"\s+"))), lambda x: x != "")), " "))
    return there.groupBy(by, "measure").agg(F.map_from_entries(F.collect_list(F.struct("at", merged.alias("symbol")))).alias("marks"))


def _bar_text() -> Column:
    """Text of one measure from its columns pieces, marks, bar and measure."""
    pieces, marks, bar = F.col("pieces"), F.col("marks"), F.col("bar")
    onsets = F.sort_array(F.map_keys(marks))
    held = F.greatest(F.coalesce(F.array_max(F.transform(pieces, lambda p: p["end"])), F.lit(0).cast("long")), F.coalesce(F.array_max(onsets), F.lit(0).cast("long")))
    fill = F.when(F.col("measure") == 0, held).otherwise(bar)

    def part(i):
        rest = F.struct(F.coalesce(F.get(pieces, i - 1)["end"], F.lit(0).cast("long")).alias("begin"), F.coalesce(F.get(pieces, i)["begin"], fill).alias("end"), F.lit(False).alias("goes_on"), F.lit("z").alias("body"))
        piece = F.get(pieces, i)
        note = F.struct(piece["begin"].alias("begin"), piece["end"].alias("end"), piece["goes_on"].alias("goes_on"), piece["body"].alias("body"))
        return F.filter(F.array(rest, note), lambda p: p["begin"] < p["end"])

    def tokens(p):
        edges = F.concat(F.array(p["begin"]), F.filter(onsets, lambda c: (c > p["begin"]) & (c < p["end"])), F.array(p["end"]))

        def token(k):
            begin, end = F.get(edges, k), F.get(edges, k + 1)
            symbol = F.try_element_at(marks, begin)
            tied = (p["body"] != "z") & (p["goes_on"] | (k < F.size(edges) - 2))
            return F.concat(F.when(symbol != "", F.concat(F.lit('"'), symbol, F.lit('"'))).otherwise(""), p["body"], duration_text(end - begin), F.when(tied, "-").otherwise(""))

        return F.transform(F.sequence(F.lit(0), F.size(edges) - 2), token)

    written = F.flatten(F.transform(F.flatten(F.transform(F.sequence(F.lit(0), F.size(pieces)), part)), tokens))
    return F.when(F.size(written) > 0, F.array_join(written, " ")).otherwise(F.concat(F.lit("z"), duration_text(F.when(fill > 0, fill).otherwise(bar))))


def abc(works: DataFrame, notes: DataFrame, chords: DataFrame, by: str = "slug") -> DataFrame:
    """(work, abc) for works (work, title, composer, time_signature, key_hint); all but the work's name may be null."""
    meter = F.coalesce(C.optional_text(F.col("time_signature")), F.lit("4/4"))
    bars = works.select(by, C.meter_ticks(meter).alias("bar"))
    known = _pieces(notes, bars, by).join(_symbols(chords, by), [by, "measure"], "full")
    every = known.groupBy(by).agg(F.min("measure").alias("lo"), F.max("measure").alias("hi")).select(by, F.explode(F.sequence("lo", "hi")).alias("measure"))
    shape = known.schema
    filled = every.join(known, [by, "measure"], "left").join(bars, by).select(by, "measure", "bar", F.coalesce("pieces", F.array().cast(shape["pieces"].dataType)).alias("pieces"), F.coalesce("marks", F.create_map().cast(shape["marks"].dataType)).alias("marks"))
    lines = filled.select(by, "measure", _bar_text().alias("line")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("measure", "line"))).alias("lines"))
    body = F.coalesce(F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), " | "), F.lit(" |")), F.lit(EMPTY_BAR))
    field = lambda letter, value: F.concat(F.lit(f"{letter}:"), value)
    text = F.concat_ws("\n", F.lit("X:1"), field("T", F.coalesce("title", F.lit(""))), field("C", F.coalesce("composer", F.lit(""))), field("M", meter), F.lit("L:1/4"), field("K", F.coalesce(C.optional_text(F.col("key_hint")), F.lit("C"))), F.concat(body, F.lit("\n")))
    bad = problems(notes, by).select(by).distinct().withColumn("bad", F.lit(True))
    return works.join(lines, by, "left").join(bad, by, "left").select(by, F.when(F.col("bad").isNull(), text).alias("abc"))
