"""Playback: section routes, repeats, tie chains, the timeline of performed events, selections, accompaniment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C

#: Most letters of an order of sections, seconds that a note is held and a performance lasts at most, tempo without one.
MOST_SECTIONS, MOST_HELD, MOST_SECONDS, DEFAULT_BPM = 128, 60.0, 1800.0, 120.0


def section_plan(orders: DataFrame, labels: DataFrame, ends: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(sections (by, name, start, end), problems) of works with an order of sections (by, parts), labels (by, name, start) and the end of their music (by, end).

    An order has 1 to 128 letters A to Z, blanks apart; each is a label; labels are single letters, each once, the first at 0; a section ends where the next one starts and isn't empty."""
    letters = F.regexp_replace("parts", r"\s", "")
    named = labels.select(by, F.trim("name").alias("name"), "start").join(orders.select(by), by, "left_semi")
    w = W.partitionBy(by).orderBy("start", "name")
    sections = named.join(ends, by, "left").select(by, "name", "start", F.coalesce(F.lead("start").over(w), "end").alias("end"))
    facts = sections.groupBy(by).agg(F.min("start").alias("__first"), F.max((~F.col("name").rlike("^[A-Z]$")).cast("int")).alias("__odd"), (F.count("*") - F.count_distinct("name")).alias("__twice"), F.max((F.coalesce(F.col("end"), F.col("start")) <= F.col("start")).cast("int")).alias("__empty"), F.collect_set("name").alias("__names"))
    rows = orders.select(by, letters.alias("order")).join(facts, by, "left")
    unknown = F.size(F.array_except(F.filter(F.split("order", ""), lambda x: x != ""), F.coalesce("__names", F.array().cast("array<string>")))) > 0
    problem = (
        F.when(~F.col("order").rlike(f"^[A-Z]{{1,{MOST_SECTIONS}}}$"), "order").when((F.col("__odd") == 1) | (F.col("__twice") > 0), "labels")
        .when(~F.col("__first").eqNullSafe(F.lit(0)), "first section").when(F.col("__empty") == 1, "empty section").when(unknown, "missing section")
    )
    judged = rows.withColumn("problem", problem)
    return sections.join(judged.where("problem IS NULL").select(by, "order"), by), judged.where("problem IS NOT NULL").select(by, "problem")


def unsafe_repeats(bars: DataFrame, by: str, order: str = "time", kind: str = "bar_type") -> DataFrame:
    """(by, unsafe): whether a backward repeat follows a closed one without a new left repeat. Bars are signs as |: :| :: in order."""
    grouped = bars.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(kind), F.lit("")).alias("k")))), lambda x: x["k"]).alias("signs"))
    zero = F.struct(F.lit(False).alias("open"), F.lit(False).alias("closed"), F.lit(False).alias("unsafe"))

    def step(s: Column, sign: Column) -> Column:
        back = F.startswith(sign, F.lit(":"))
        unsafe = s["unsafe"] | (back & s["closed"] & ~s["open"])
        closed = s["closed"] | (back & s["open"])
        return F.struct((F.when(back, False).otherwise(s["open"]) | F.endswith(sign, F.lit(":"))).alias("open"), closed.alias("closed"), unsafe.alias("unsafe"))

    return grouped.select(by, F.aggregate("signs", zero, step, lambda s: s["unsafe"]).alias("unsafe"))


def play_sections(events: DataFrame, sections: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(events with their performed start and visit, problems) of a work's events (by, written, start, duration, ...) by the order of its sections (by, order, name, start, end in written time).

    A section's events are those written in it; each visit plays them after what came before. It must begin with an event, no event may last past its end, and the whole at most 30 minutes."""
    spans = sections.select(by, "order", "name", F.col("start").alias("__from"), F.col("end").alias("__to"))
    own = events.join(spans, by).where((F.col("written") >= F.col("__from")) & (F.col("written") < F.col("__to")))
    facts = own.groupBy(by, "name", "__from", "__to").agg(F.min("written").alias("__least"), F.min("start").alias("__start"), F.max(F.col("start") + F.col("duration")).alias("__last"))
    later = W.partitionBy(by).orderBy("__from").rowsBetween(1, 1)
    facts = facts.withColumn("__end", F.coalesce(F.min("__start").over(later), F.col("__last")))
    seen = spans.join(facts.drop("__to"), [by, "name", "__from"], "left")
    wrong = F.when(F.col("__least").isNull() | (F.col("__least") != F.col("__from")), "a section must begin with a note or rest").when(F.col("__last") > F.col("__end") + 1e-4, "a held note crosses a section")
    visits = sections.select(by, "order").distinct().select(by, F.posexplode(F.filter(F.split("order", ""), lambda x: x != "")).alias("visit", "name"))
    lengths = visits.join(seen.select(by, "name", "__start", (F.col("__end") - F.col("__start")).alias("__length")), [by, "name"])
    before = W.partitionBy(by).orderBy("visit").rowsBetween(W.unboundedPreceding, -1)
    placed = lengths.withColumn("__offset", F.coalesce(F.sum("__length").over(before), F.lit(0.0)))
    long = placed.groupBy(by).agg(F.sum("__length").alias("n")).where(F.col("n").isNull() | (F.col("n") <= 0) | (F.col("n") > MOST_SECONDS)).select(by, F.lit("longer than the playback limit").alias("problem"))
    problems = seen.withColumn("problem", wrong).where("problem IS NOT NULL").select(by, "problem").unionByName(long).distinct()
    played = own.drop("__from", "__to", "order").join(placed, [by, "name"]).join(problems.select(by), by, "left_anti")
    return played.select(*events.columns, "visit", "name", (F.col("__offset") + F.col("start") - F.col("__start")).alias("performed")), problems


def tie_chains(heads: DataFrame, by: str, key: str = "head", after: str = "tied_to", given: str = "given_id") -> DataFrame:
    """(by, head, chain): the id of each chain of tied heads - the one given to some of its heads, else its first head. Chains that close on themselves or whose heads were given
    different ids are left out. A piece is one task's work, linear in its heads; its chains are walked from their first heads, in order."""
    kinds = f"`{by}` {heads.schema[by].dataType.simpleString()}, `{key}` {heads.schema[key].dataType.simpleString()}, chain {heads.schema[given].dataType.simpleString()}"
    id_type = heads.sparkSession.createDataFrame([], kinds).toArrow().schema.field("chain").type

    def run(table: pa.Table) -> pa.Table:
        names, onward, ids = (table.column(c).to_pylist() for c in (key, after, given))
        to, known = dict(zip(names, onward, strict=True)), dict(zip(names, ids, strict=True))
        reached = {t for t in onward if t is not None}
        out = {}
        for head in sorted(n for n in names if to[n] is not None and n not in reached):
            chain, seen, now = [], set(), head
            while now is not None and now in to and now not in seen:
                chain.append(now)
                seen.add(now)
                now = to[now]
            told = {x for n in chain if (x := out.get(n, known[n])) is not None}
            if now in seen or len(chain) < 2 or len(told) > 1:
                continue
            for n in chain:
                out[n] = next(iter(told), head)
        return pa.table({by: pa.array([table.column(by)[0].as_py()] * len(out), table.schema.field(by).type), key: pa.array(list(out), table.schema.field(key).type), "chain": pa.array(list(out.values()), id_type)})

    return heads.select(by, key, after, given).groupBy(by).applyInArrow(run, kinds)


def initial_tempo(tempos: DataFrame, works: DataFrame, by: str, order: str = "place") -> DataFrame:
    """(by, bpm): quarter notes a minute of the last valid tempo (bpm, at) that stands at 0, else 120."""
    valid = tempos.where((F.col("at") == 0) & (F.col("bpm") > 0) & ~F.isnan("bpm") & (F.col("bpm") < float("inf")))
    found = valid.groupBy(by).agg(F.max_by("bpm", order).alias("bpm"))
    return works.select(by).join(found, by, "left").select(by, F.coalesce("bpm", F.lit(DEFAULT_BPM)).alias("bpm"))


def valid_events(events: DataFrame) -> DataFrame:
    """Events (index, start, instrument, pitch, duration, volume) that are played: finite, in time, notes that sound or rests that don't."""
    fine = F.lit(True)
    for c in ("start", "duration"):
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sounds = ((F.col("pitch") > 0) & (F.col("volume") > 0)) | ((F.col("pitch") == 0) & (F.col("volume") == 0))
    return events.where(fine & (F.col("index") >= 0) & (F.col("start") >= 0) & (F.col("start") <= MOST_SECONDS) & (F.col("instrument") >= 0) & (F.col("duration") > 0) & sounds)


def timeline(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, index, start, end): what is highlighted when, once for all heads of a chord; notes are held 60 seconds at most."""
    return valid_events(events).select(*by, "index", "start", (F.col("start") + F.least("duration", F.lit(MOST_HELD))).alias("end")).distinct()


def active_at(line: DataFrame, moments: DataFrame, by: list[str], at: str = "at", cell: float = MOST_HELD) -> DataFrame:
    """Events with start <= moment < end, for each moment. An event stands in each cell of time that it touches, one or two as it lasts at most one cell."""
    spans = line.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    return spans.join(moments.withColumn("__cell", F.floor(F.col(at) / cell)), [*by, "__cell"]).where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("__cell")


def from_selection(events: DataFrame, line: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """Valid events from the first performed visit of a chosen written index (by, index) on, told from there: what sounds then is cut, what ended before is gone; holds are capped first."""
    first = line.join(chosen, [by, "index"]).groupBy(by).agg(F.min("start").alias("__from"))
    rows = valid_events(events).join(first, by).withColumn("__end", F.col("start") + F.least("duration", F.lit(MOST_HELD))).where(F.col("__end") > F.col("__from"))
    onset = F.greatest("start", "__from")
    return rows.select(*(c for c in events.columns if c not in ("start", "duration")), (onset - F.col("__from")).alias("start"), (F.col("__end") - onset).alias("duration"))


def chord_spans(labels: DataFrame, barlines: DataFrame, jumps: DataFrame, ends: DataFrame, by: str) -> DataFrame:
    """(by, symbol, start, duration, pitches): each chord symbol sounds from its label (by, start, symbol) to the next label, barline or jump back (by, start), or the end (by, end).
    Labels of one moment that disagree, and symbols without pitches, are silent but end what sounded."""
    at = labels.groupBy(by, "start").agg(F.min("symbol").alias("symbol"), F.count_distinct("symbol").alias("__n"))
    silent = barlines.select(by, "start").unionAll(jumps.select(by, "start")).distinct().join(at, [by, "start"], "left_anti")
    points = at.select(by, "start", F.when(F.col("__n") == 1, F.col("symbol")).alias("symbol")).unionByName(silent.withColumn("symbol", F.lit(None).cast("string")))
    rows = points.join(ends, by).withColumn("__next", F.coalesce(F.lead("start").over(W.partitionBy(by).orderBy("start")), F.col("end")))
    sounding = rows.withColumn("pitches", C.chord_pitches(F.col("symbol"))).where("symbol IS NOT NULL AND __next > start")
    return sounding.where(F.size("pitches") > 0).select(by, "symbol", "start", (F.col("__next") - F.col("start")).alias("duration"), "pitches")


def visited_bars(events: DataFrame, bars: DataFrame, by: str) -> DataFrame:
    """(by, route, route_status): the bars that a performance (by, index, start, order) visits, by their first written symbol (by, number, index), each visit once; resolved if all are visited."""
    firsts = bars.where(F.col("index").isNotNull()).select(by, "number", "index")
    hits = events.join(firsts, [by, "index"]).withColumn("__visit", F.struct("number", "start"))
    w = W.partitionBy(by).orderBy("order")
    fresh = hits.withColumn("__before", F.lag("__visit").over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col("__visit")))
    route = fresh.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "number"))), lambda x: x["number"]).alias("route"))
    total = bars.groupBy(by).agg(F.count_distinct("number").alias("__n"))
    whole = F.size(F.array_distinct("route")) == F.col("__n")
    return total.join(route, by, "left").select(by, F.when(whole, F.col("route")).alias("route"), F.when(whole, "resolved").otherwise("unsupported").alias("route_status"))
