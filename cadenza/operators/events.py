"""Views, filters and choices over score events: projections, source precedence, admission rules with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

NOTE_FIELDS = ("measure", "onset_beats", "duration_beats", "pitch_midi")
#: Pitches of the bar that stands for a work without melody, and the meter of a work that tells none.
STUB_PITCHES, STUB_METER = (60, 62, 64, 65), "4/4"


def project_notes(notes: DataFrame, by: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """The four fields of every note, and those of `optional` that the table has."""
    return notes.select(*by, *NOTE_FIELDS, *(c for c in optional if c in notes.columns))


def melody_view(events: DataFrame, by: list[str]) -> DataFrame:
    """Notes of a table of notes and chords (column kind), without chords, accidentals and ties."""
    return project_notes(events.where("kind = 'note'"), by)


def canonical_view(events: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Notes with accidentals, and harmonies (by, measure, onset_beats, symbol)."""
    return project_notes(events.where("kind = 'note'"), by, ("accidental",)), events.where("kind = 'chord'").select(*by, "measure", "onset_beats", "symbol")


def requested(df: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is asked for, and the asked keys that no row has."""
    return df.join(names.select(key).distinct(), key, "left_semi"), names.select(key).distinct().join(df, key, "left_anti")


def choose_chords(written: DataFrame, read: DataFrame, works: DataFrame, by: str, *, written_name: str = "supplied_musicxml", read_name: str = "automatic_ocr") -> tuple[DataFrame, DataFrame]:
    """Chords of each work from the written source if it has any there, else those that were read; and (work, chord_source), `none` without either.

    A chord without an onset stands at 0."""
    has = written.groupBy(by).agg(F.lit(written_name).alias("a")).join(read.groupBy(by).agg(F.lit(read_name).alias("b")), by, "full")
    sources = works.select(by).join(has, by, "left").select(by, F.coalesce("a", "b", F.lit("none")).alias("chord_source"))
    shape = lambda df: df.select(by, "measure", F.coalesce("onset_beats", F.lit(0.0)).alias("onset_beats"), "symbol")
    chosen = shape(written).unionByName(shape(read.join(written, by, "left_anti")))
    return chosen, sources


def with_stubs(works: DataFrame, notes: DataFrame, chords: DataFrame | None, by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works with a meter, notes, chords): works without notes get a bar of four, and where chords aren't known at all, the key's chord at its start."""
    missing = works.join(notes, by, "left_anti").select(by, "key_hint")
    bar = F.explode(F.array(*(F.struct(F.lit(1).alias("measure"), F.lit(float(k)).alias("onset_beats"), F.lit(1.0).alias("duration_beats"), F.lit(p).alias("pitch_midi")) for k, p in enumerate(STUB_PITCHES))))
    stubs = missing.select(by, bar.alias("n")).select(by, "n.*")
    if chords is None:
        chords = missing.select(by, F.lit(1).alias("measure"), F.lit(0.0).alias("onset_beats"), F.coalesce("key_hint", F.lit("C")).alias("symbol"))
    meters = works.withColumn("time_signature", F.coalesce(C.optional_text(F.col("time_signature")), F.lit(STUB_METER)))
    return meters, project_notes(notes, [by]).unionByName(stubs), chords


def first_existing(candidates: DataFrame, files: DataFrame, by: str, path: str = "path", place: str = "place") -> DataFrame:
    """(by, path): of each group's candidate paths the first, by place, that is among the files; null without one."""
    found = candidates.join(files.select(path).distinct().withColumn("__there", F.lit(True)), path, "left")
    return found.groupBy(by).agg(F.min_by(path, F.when(F.col("__there"), F.col(place))).alias(path))


def visible(column: str = "visible") -> Column:
    """Whether a rest counts: it does unless it says no."""
    return F.coalesce(F.col(column), F.lit(True))


def ordinary_bars(bars: DataFrame) -> DataFrame:
    """Bars whose meter was judged and that aren't partial."""
    return bars.where(F.col("meter_valid").isNotNull() & (F.coalesce("partial_reason", F.lit("")) == ""))


def clean_units(units: DataFrame) -> DataFrame:
    """Units that are known not to be confounded by segmentation."""
    return units.where(F.col("segmentation_confounded") == F.lit(False))


def head_shaped(width: Column, height: Column, area: Column, image_width: Column, spacing: Column) -> Column:
    """Whether a component could be a note head: not tiny, not too wide or high for the staff, nor too flat, steep or hollow."""
    round_ = lambda x: F.bround(x)
    spacing = F.when(spacing > 0, spacing).otherwise(10.0)
    small = (area >= 8) & (width >= 3) & (height >= 3)
    fits = (width <= image_width * 0.35) & (width <= F.greatest(F.lit(12.0), round_(spacing * 2.4))) & (height <= F.greatest(F.lit(10.0), round_(spacing * 2.2)))
    return small & fits & (width / height).between(0.3, 3.3) & (area / (width * height) >= 0.16)


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that fail (a rule that gives null fails), in order."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules)), lambda x: x.isNotNull())


#: Key signatures that are accepted, by their family, and accepted ways of selecting glyphs.
KEY_FAMILIES = {-1: "flat", 2: "sharp"}


def key_context(predictions: DataFrame, methods: list[str], families: dict[int, str] = KEY_FAMILIES) -> DataFrame:
    """Predictions (mode, truth_used, gate_passed, fifths, family, method, accidental_count, glyph_ids, right_px) with `reasons` why they
    can't serve as initial key (all that apply), and `accepted_fifths`, null unless there are none."""
    known = F.col("fifths").isin(*families)
    all_of = (
        (F.col("mode") == "initial", "detector_mode_is_not_initial"),
        (~F.col("truth_used"), "prediction_is_not_truth_blind"),
        (F.col("gate_passed"), "detector_structural_gate_failed"),
        (F.col("fifths").isNotNull(), "detector_fifths_is_not_an_integer"),
        (F.col("fifths").isNull() | known, "detector_fifths_is_not_independently_supported"),
        (~F.coalesce(known, F.lit(False)) | (F.col("family") == F.try_element_at(C.literal_map(families), F.col("fifths"))), "detector_signature_family_is_inconsistent"),
        (F.col("method").isin(*methods), "detector_selection_method_is_not_supported"),
        (~F.coalesce(known, F.lit(False)) | (F.col("accidental_count") == F.abs("fifths")), "accidental_count_does_not_match_fifths"),
        (~F.coalesce(known, F.lit(False)) | (F.size("glyph_ids") == F.abs("fifths")), "selected_glyph_count_does_not_match_fifths"),
        (F.col("right_px") >= 0, "detector_search_region_right_is_invalid"),
    )
    return predictions.withColumn("reasons", reasons(*all_of)).withColumn("accepted_fifths", F.when(F.size("reasons") == 0, F.col("fifths")))


def excluded_bars(bars: DataFrame, exclusions: DataFrame, by: str, bar: str = "bar") -> DataFrame:
    """Bars that an exclusion (by, dimensions, bars, first, last) of notes, durations or rests names or spans."""
    named = exclusions.where(F.arrays_overlap("dimensions", F.array(*map(F.lit, ("notes", "duration", "rests")))))
    spanned = F.when(F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("first") <= F.col("last")), F.sequence("first", "last")).otherwise(F.array())
    every = named.select(by, F.explode(F.array_distinct(F.concat(F.coalesce("bars", F.array()), spanned))).alias(bar)).distinct()
    return bars.join(every, [by, bar], "left_semi")


def admitted(targets: DataFrame, verdicts: DataFrame, key: list[str], readers: int = 2) -> tuple[DataFrame, DataFrame]:
    """Targets (key, events_hash, known_exclusion) that every reader supports with context and the target's own events; and the
    others with the reasons of each reader, in order of reader. Verdicts: key, reader_id, status, context_checked, events_hash, evidence."""
    target = targets.select(*key, F.col("events_hash").alias("__own"))
    same = F.coalesce(F.col("context_checked") & (F.col("events_hash") == F.col("__own")), F.lit(False))
    reason = F.when(F.col("status") != "supported", F.concat("reader_id", F.lit(": "), "status", F.lit(": "), "evidence")).when(~same, F.concat("reader_id", F.lit(": observed notes differ or lack context")))
    said = verdicts.join(target, key).groupBy(*key).agg(F.count("*").alias("__n"), F.sort_array(F.collect_list(F.when(reason.isNotNull(), F.struct("reader_id", reason.alias("r"))))).alias("__r"))
    judged = targets.join(said, key, "left")
    missing = F.when(F.coalesce("__n", F.lit(0)) < readers, F.array(F.lit("too few readers"))).otherwise(F.array())
    known = F.when(F.col("known_exclusion").isNotNull(), F.array("known_exclusion")).otherwise(F.array())
    why = F.concat(known, F.coalesce(F.transform("__r", lambda x: x["r"]), F.array()), missing)
    judged = judged.withColumn("reasons", why).drop("__n", "__r")
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def union_outputs(*tables: DataFrame) -> DataFrame:
    """All rows of tables that may lack some columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def filled(events: DataFrame, every: DataFrame, by: list[str]) -> DataFrame:
    """Every key with its events; keys without one get a row of nulls."""
    return every.join(events, by, "left")


def strict_zip(lists: dict[str, DataFrame], by: list[str], place: str = "place") -> tuple[DataFrame, DataFrame]:
    """Rows of several lists that stand at the same place, and the places that some list lacks (by, place, missing lists). One aggregation."""
    both = union_outputs(*(df.select(*by, place, F.struct(*(c for c in df.columns if c not in (*by, place))).alias(name)) for name, df in lists.items()))
    rows = both.groupBy(*by, place).agg(*(F.first(name, ignorenulls=True).alias(name) for name in lists))
    lacking = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in lists)), lambda x: x.isNotNull())
    marked = rows.withColumn("missing", lacking)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0).select(*by, place, "missing")


def mapping_problems(mapping: DataFrame, left: DataFrame, right: DataFrame, source: str, target: str, by: list[str]) -> DataFrame:
    """(by, side, id, problem) where a mapping (source, target) doesn't cover both sides exactly once: missing, repeated, unknown."""

    def side(name: str, ids: DataFrame) -> DataFrame:
        both = mapping.select(*by, F.col(name).alias("id"), F.lit(1).alias("m"), F.lit(0).alias("i")).unionByName(ids.select(*by, F.col(name).alias("id"), F.lit(0).alias("m"), F.lit(1).alias("i")))
        sums = both.groupBy(*by, "id").agg(F.sum("m").alias("m"), F.sum("i").alias("i"))
        problem = F.when(F.col("id").isNull(), "null").when(F.col("i") == 0, "unknown").when(F.col("m") == 0, "missing").when(F.col("m") > 1, "repeated")
        return sums.select(*by, F.lit(name).alias("side"), F.col("id").cast("string").alias("id"), problem.alias("problem")).where("problem IS NOT NULL")

    return side(source, left).unionByName(side(target, right))


def injective_targets(mapping: DataFrame, bars: DataFrame, by: str, target: str, bar: str) -> DataFrame:
    """(by, n, valid): of each group's mapped targets whether each is used once and is one of its bars."""
    known = bars.select(by, F.col(bar).alias(target), F.lit(1).alias("__known")).distinct()
    found = mapping.join(known, [by, target], "left")
    return found.groupBy(by).agg(F.count("*").alias("n"), ((F.count("*") == F.count_distinct(target)) & (F.count("__known") == F.count("*"))).alias("valid"))


def covers(required: DataFrame, have: DataFrame, by: str, key: str) -> DataFrame:
    """(by, n_missing): how many required keys of each group it lacks."""
    lack = required.select(by, key).distinct().join(have.select(by, key).distinct().withColumn("__has", F.lit(1)), [by, key], "left")
    return lack.groupBy(by).agg((F.count("*") - F.count("__has")).alias("n_missing"))


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Number from 1 of each row in its group's order; give an order without ties."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
