"""Roll-ups of evaluations and runs: event comparison, coverage, lanes, summaries, ledgers, gates, contracts.

A report is a DataFrame; what a run must stop on is a table of problems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def _one(c: Column) -> Column:
    return F.count(F.when(c, 1))


def compare_events(predicted: DataFrame, truth: DataFrame, by: list[str], meters: DataFrame | None = None) -> DataFrame:
    """One row a work with agreement of notes, chords, and chords by measure alone, as sets of rounded keys; counts are of rows.

    Events are rows (by, kind, measure, onset_beats, duration_beats, pitch_midi, symbol); `meters` has (by, time_signature_pred, time_signature_truth)."""
    beat = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).cast("string")
    symbol = F.trim(F.coalesce("symbol", F.lit("")))
    note = F.concat_ws("|", F.lit("n"), "measure", beat(F.col("onset_beats")), beat(F.col("duration_beats")), "pitch_midi")
    chord, loose = F.concat_ws("|", F.lit("c"), "measure", beat(F.col("onset_beats")), symbol), F.concat_ws("|", F.lit("m"), "measure", symbol)
    keys = F.when(F.col("kind") == "note", F.array(note)).otherwise(F.array(chord, loose))
    side = lambda df, p, t: df.select(*by, F.explode(keys).alias("key")).select(*by, "key", F.lit(p).alias("p"), F.lit(t).alias("t"))
    counts = side(predicted, 1, 0).unionAll(side(truth, 0, 1)).groupBy(*by, "key").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    kind, p, t = F.substring("key", 1, 1), F.col("p"), F.col("t")
    sums = []
    for letter, name, suffix in (("n", "note", ""), ("c", "chord", ""), ("m", "chord", "_measure_only")):
        own = kind == letter
        sums += [_one(own & (p > 0) & (t > 0)).alias(f"{name}_true_positives{suffix}"), _one(own & (p > 0) & (t == 0)).alias(f"{name}_false_positives{suffix}"), _one(own & (p == 0) & (t > 0)).alias(f"{name}_false_negatives{suffix}")]
        if not suffix:
            sums += [F.coalesce(F.sum(F.when(own, p)), F.lit(0)).alias(f"pred_{name}s"), F.coalesce(F.sum(F.when(own, t)), F.lit(0)).alias(f"truth_{name}s")]
    rows = counts.groupBy(*by).agg(*sums)
    if meters is not None:  # works without any event have zeros
        rows = meters.join(rows, by, "left").na.fill(0)
    more = []
    for name, suffix in (("note", ""), ("chord", ""), ("chord", "_measure_only")):
        scores = C.precision_recall_f1(*(F.col(f"{name}_{k}{suffix}") for k in ("true_positives", "false_positives", "false_negatives")))
        more += [c.alias(f"{name}_{n}{suffix}") for c, n in zip(scores, ("precision", "recall", "f1"), strict=True)]
        if not suffix:
            delta = F.col(f"pred_{name}s") - F.col(f"truth_{name}s")
            more += [delta.alias(f"{name}_count_delta"), (delta == 0).alias(f"{name}_count_match")]
    if meters is not None:
        more.append(F.coalesce(F.col("time_signature_pred") == F.col("time_signature_truth"), F.lit(False)).alias("time_signature_match"))
    return rows.select("*", *more)


def drop_out(works: DataFrame, stages: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """One row: how many works there are, and how many of them each stage still has, stage after stage."""
    rows, held, counts = works.select(by), F.lit(True), [F.count("*").alias("works")]
    for name, df in stages:
        rows = rows.join(df.select(by).distinct().withColumn(f"__{name}", F.lit(1)), by, "left")
        held = held & F.col(f"__{name}").isNotNull()
        counts.append(_one(held).alias(name))
    return rows.agg(*counts)


def ordered_zip(left: DataFrame, right: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """(by, place from 1, left, right): the n-th of one list with the n-th of the other, nulls past the shorter one. One aggregation instead of a full join."""
    w = W.partitionBy(*by, "__side").orderBy(*order)
    both = left.select(*by, *order, F.col(key).alias("__key"), F.lit(0).alias("__side")).unionAll(right.select(*by, *order, F.col(key).alias("__key"), F.lit(1).alias("__side")))
    placed = both.withColumn("place", F.row_number().over(w).cast("long"))
    pick = lambda k: F.max(F.when(F.col("__side") == k, F.col("__key")))
    return placed.groupBy(*by, "place").agg(pick(0).alias("left"), pick(1).alias("right"))


def key_cover(df: DataFrame, key: str) -> DataFrame:
    """One row: n keys, how many distinct ones, how many of the range between them are missing, and how many are repeats."""
    sums = df.groupBy(key).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("distinct_keys"), (F.max(key) - F.min(key) + 1 - F.count("*")).alias("missing"))
    return sums.withColumn("repeated", F.col("n") - F.col("distinct_keys"))


def first_of_copies(df: DataFrame, content: str, key: str) -> DataFrame:
    """The least key of each group of equal contents, and how many there are. Contents are shuffled as hashes of 256 bits."""
    return df.select(key, F.sha2(content, 256).alias("__h")).groupBy("__h").agg(F.min(key).alias(key), F.count("*").alias("copies")).drop("__h")


def capacity(units: DataFrame, by: list[str], predicted: str, truth: str) -> DataFrame:
    """What counts alone allow: predicted, truth, capacity, surplus, deficit, and the agreement that capacity would give."""
    p, t = F.col(predicted), F.col(truth)
    sums = units.groupBy(*by).agg(F.count("*").alias("units"), F.sum(p).alias("predicted"), F.sum(t).alias("truth"), F.sum(F.least(p, t)).alias("capacity"), F.sum(F.greatest(p - t, F.lit(0))).alias("surplus"), F.sum(F.greatest(t - p, F.lit(0))).alias("deficit"))
    ratio = lambda a, b: F.round(C.safe_ratio(a, b), 6)
    cap = F.col("capacity")
    return sums.select("*", ratio(cap, F.col("predicted")).alias("precision"), ratio(cap, F.col("truth")).alias("recall"), ratio(2 * cap, F.col("predicted") + F.col("truth")).alias("f1"))


def within_capacity(matches: Column, cap: Column) -> Column:
    """Share of what counts allow that matches."""
    return F.round(C.safe_ratio(matches, cap), 6)


def segmentation(crops: DataFrame, by: list[str], numbers: str) -> DataFrame:
    """(by) crops (each with an array of the measures it holds): merged ones, missing boundaries, whether each holds one."""
    n = F.size(numbers)
    return crops.groupBy(*by).agg(F.count("*").alias("crops"), F.sum(n).alias("measures"), _one(n > 1).alias("merged"), F.sum(F.greatest(n - 1, F.lit(0))).alias("missing_boundaries"), (F.size(F.array_distinct(F.flatten(F.collect_list(numbers)))) == F.sum(n)).alias("distinct")).withColumn("one_to_one", (F.col("merged") == 0) & (F.col("crops") == F.col("measures")))


def unit_hierarchy(units: DataFrame) -> DataFrame:
    """One row for each of `all`, `clean` (not confounded) and `full_event` (of a scope with all events) units: counts, capacity, and matches of pitch, onset and duration
    within it, rests, exact measures. Each unit is read once."""
    kinds = F.filter(F.array(F.lit("all"), F.when(~F.col("segmentation_confounded"), F.lit("clean")), F.when(F.col("scope") == "full_event", F.lit("full_event"))), lambda x: x.isNotNull())
    rows = units.withColumn("subset", F.explode(kinds))
    cap = capacity(rows, ["subset"], "predicted_note_count", "truth_note_count")
    names = ("exact_pitch_matches", "exact_onset_matches", "exact_duration_matches", "rest_tp", "rest_fp", "rest_fn")
    more = rows.groupBy("subset").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), _one(F.col("exact_full_measure")).alias("exact_measures"))
    out = cap.join(more, "subset")
    rest = C.precision_recall_f1(F.col("rest_tp"), F.col("rest_fp"), F.col("rest_fn"))
    return out.select("*", *(within_capacity(F.col(f"exact_{x}_matches"), F.col("capacity")).alias(f"{x}_accuracy") for x in ("pitch", "onset", "duration")), *(c.alias(f"rest_{n}") for c, n in zip(rest, ("precision", "recall", "f1"), strict=True)))


def status_counts(df: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    return df.groupBy(*by, status).agg(F.count("*").alias("n"))


def by_kind(reports: DataFrame, kind: str, rules: dict[str, dict[str, Column]]) -> DataFrame:
    """(kind, n, metric, value): for each kind of report its own aggregates, as rows."""
    named = sorted({m for rule in rules.values() for m in rule})
    values = F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*(F.coalesce(*(F.when(F.first(kind) == k, rule[m].cast("double")) for k, rule in rules.items() if m in rule)) for m in named)))
    rows = reports.groupBy(kind).agg(F.count("*").alias("n"), values.alias("v"))
    return rows.select(kind, "n", F.explode("v").alias("metric", "value")).where("value IS NOT NULL")


def model_summary(results: DataFrame, model: str, means: list[str], totals: list[str]) -> DataFrame:
    """One row a model over all planned cases: complete ones, means of measured attempted runs and how many they are, totals of known values and how many, or null."""
    tried = F.col("status") != "not_run"
    out = [F.count("*").alias("cases"), _one(tried).alias("attempted"), _one(F.col("status") == "complete").alias("complete")]
    for m in means:
        value = F.when(tried, F.col(m).cast("double"))
        out += [F.avg(value).alias(f"{m}_mean"), F.count(value).alias(f"{m}_n")]
    for t in totals:
        out += [F.sum(t).alias(f"{t}_total"), F.count(t).alias(f"{t}_n")]
    return results.groupBy(model).agg(*out)


def paired_deltas(results: DataFrame, case: str, model: str, metric: str, baseline: str) -> DataFrame:
    """(model, pairs, mean_delta): mean difference from the baseline over the cases where both are measured."""
    base = results.where(F.col(model) == baseline).select(case, F.col(metric).alias("__a"))
    both = results.where(F.col(model) != baseline).join(base, case).where(F.col(metric).isNotNull() & F.col("__a").isNotNull())
    return both.groupBy(model).agg(F.count("*").alias("pairs"), F.avg(F.col(metric) - F.col("__a")).alias("mean_delta"))


def leaders(summary: DataFrame, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows within the tolerance of the greatest value, and whether they share it. The summary has a row a model."""
    top = summary.agg(F.max(value).alias("__top"))
    tied = summary.crossJoin(F.broadcast(top)).where(F.abs(F.col(value) - F.col("__top")) <= tolerance).drop("__top")
    n = tied.agg(F.count("*").alias("__n"))
    return tied.crossJoin(F.broadcast(n)).select(*summary.columns, (F.col("__n") > 1).alias("tied"))


def usage_totals(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Tokens and cost of recorded attempts (input_tokens, output_tokens, cached_tokens, cost): totals of the known ones, with how many are known."""
    known = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    total = lambda c: F.sum(F.when(known, F.col(c)))
    return attempts.groupBy(*by).agg(F.count("*").alias("attempts"), _one(known).alias("known"), total("input_tokens").alias("input_tokens"), F.sum(F.when(known, F.coalesce("cached_tokens", F.lit(0)))).alias("cached_tokens"), total("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))


def differing_totals(computed: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, computed, stored) where a stored summary isn't what its rows give; both have the same columns."""
    names = [c for c in computed.columns if c not in by]
    tall = lambda df, side: df.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(c).cast("string") for c in names)))).alias("name", side))
    return tall(computed, "computed").join(tall(stored, "stored"), [*by, "name"], "full").where(~F.col("computed").eqNullSafe(F.col("stored")))


def meter_validity(bars: DataFrame, by: list[str], order: str) -> DataFrame:
    """Bars (duration_ticks, expected_ticks) with meter_valid (null if nothing is expected) and partial_reason: a short first bar is a pickup candidate, and a
    pickup if the last bar, of the same meter, lacks just what it holds; both are valid then."""
    w = W.partitionBy(*by)
    ends = w.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d, e = F.col("duration_ticks"), F.col("expected_ticks")
    rows = bars.select("*", F.first("duration_ticks").over(ends).alias("__d0"), F.first("expected_ticks").over(ends).alias("__e0"), F.last("duration_ticks").over(ends).alias("__d1"), F.last("expected_ticks").over(ends).alias("__e1"), F.min(order).over(w).alias("__lo"), F.max(order).over(w).alias("__hi"))
    first, last = F.col(order) == F.col("__lo"), F.col(order) == F.col("__hi")
    short = F.coalesce(F.col("__d0") < F.col("__e0"), F.lit(False))
    whole = short & (F.col("__lo") != F.col("__hi")) & F.coalesce((F.col("__e0") == F.col("__e1")) & (F.col("__d0") + F.col("__d1") == F.col("__e1")), F.lit(False))
    reason = F.when(first & whole, "pickup").when(last & whole, "pickup_complement").when(first & short, "pickup_candidate")
    valid = F.when(reason.isin("pickup", "pickup_complement"), True).when(reason == "pickup_candidate", F.lit(None)).otherwise(d == e)
    return rows.withColumn("meter_valid", valid.cast("boolean")).withColumn("partial_reason", reason).select(*bars.columns, "meter_valid", "partial_reason")


def usual_total(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, total, valid, excess): each group's sum against the most frequent sum, the least of equals."""
    sums = df.groupBy(*by).agg(F.sum(value).cast("long").alias("total"))
    usual = sums.groupBy("total").agg(F.count("*").alias("n")).agg(F.max_by("total", F.struct("n", -F.col("total"))).alias("__mode"))
    return sums.crossJoin(F.broadcast(usual)).select(*by, "total", (F.col("total") == F.col("__mode")).alias("valid"), (F.col("total") - F.col("__mode")).alias("excess"))


MILLION = 1_000_000
LEDGER = "struct<spent:decimal(38,12),open:boolean,rows:array<struct<request:int,output_tokens:long,reserved:decimal(38,12),charged:decimal(38,12),status:string>>>"


def ledger(requests: DataFrame, by: list[str], order: str, *, limit: str, input_rate: str, cached_rate: str, output_rate: str) -> DataFrame:
    """(by, request, output_tokens, reserved, charged, status) of requests (input_tokens, max_output, min_output, and what came back: actual_input, actual_output,
    actual_cached, null if unknown) against a budget, in order.

    Each reserves the worst case: its input, and as much output as the rest of the budget buys (rounded down), at most max_output. If that is less than min_output, it and all after it
    are refused. What came back replaces the reservation, cached input at its own rate; unknown or impossible usage keeps it. Rates are per million tokens, all amounts decimals.
    """
    money = lambda x: F.lit(x).cast("decimal(20,8)")
    amount = lambda c: c.cast("decimal(38,12)")
    row = F.struct(order, *(F.col(c).cast("long").alias(c) for c in ("input_tokens", "max_output", "min_output", "actual_input", "actual_output", "actual_cached")))
    grouped = requests.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("r"))
    per = lambda tokens, rate: amount(amount(tokens.cast("decimal(18,0)") * money(rate)) / MILLION)

    def step(state: Column, r: Column) -> Column:
        given = per(r["input_tokens"], input_rate)
        left = amount(money(limit).cast("decimal(38,12)") - state["spent"] - given)
        output = F.least(r["max_output"], F.greatest(F.floor(amount(left * MILLION) / money(output_rate)), F.lit(0)).cast("long"))
        able = state["open"] & (output >= r["min_output"]) & (left >= 0)
        reserved = amount(given + per(output, output_rate))
        cached = F.coalesce(r["actual_cached"], F.lit(0).cast("long"))
        sound = r["actual_input"].between(0, r["input_tokens"]) & r["actual_output"].between(0, output) & cached.between(0, r["actual_input"])
        real = amount(per(r["actual_input"] - cached, input_rate) + per(cached, cached_rate) + per(r["actual_output"], output_rate))
        known = F.coalesce(sound, F.lit(False))
        charged = F.when(~able, F.lit(0).cast("decimal(38,12)")).when(known, real).otherwise(reserved)
        status = F.when(~able, "refused").when(known, "reconciled").otherwise("reserved")
        one = F.struct((F.size(state["rows"]) + 1).alias("request"), F.when(able, output).alias("output_tokens"), F.when(able, reserved).alias("reserved"), charged.alias("charged"), status.alias("status"))
        return F.struct(amount(state["spent"] + charged).alias("spent"), able.alias("open"), F.concat(state["rows"], F.array(one)).alias("rows")).cast(LEDGER)

    zero = F.struct(F.lit(0).cast("decimal(38,12)").alias("spent"), F.lit(True).alias("open"), F.array().alias("rows")).cast(LEDGER)
    return grouped.select(*by, F.explode(F.aggregate("r", zero, step, lambda s: s["rows"])).alias("x")).select(*by, "x.*")


def running_budget(df: DataFrame, by: list[str], order: list[str], amount: Column, limit: int) -> DataFrame:
    """Rows with what has been spent up to each, exactly, and whether that is within the limit."""
    spent = F.sum(amount).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("spent", spent).withColumn("within", F.col("spent") <= limit)


def fair_shares(df: DataFrame, key: str, total: int, parts: int = 64) -> DataFrame:
    """(key, share): a whole number in equal shares; the first keys take one more each until nothing is left over. Keys are numbered by ranges, so no task holds them all."""
    from .selection import running_total

    rows = running_total(df.select(key).withColumn("__one", F.lit(1).cast("long")).withColumn("__at", -F.col(key).cast("double")), [], "__at", ["__one"], parts)
    n = df.agg(F.count("*").alias("__n"))
    return rows.crossJoin(F.broadcast(n)).select(key, (F.floor(F.lit(total) / F.col("__n")) + (F.col("__one_total") <= F.lit(total) % F.col("__n")).cast("int")).cast("long").alias("share"))


def deficit(visual: Column, expected: Column, pickup: Column, epsilon: float = 1e-6) -> Column:
    """(flag, reason, missing beats): whether a measure's visible beats fall short of its meter; a pickup is exempt, an unknown meter isn't judged."""
    missing = expected - visual
    flag = expected.isNotNull() & ~F.coalesce(pickup, F.lit(False)) & (missing > epsilon)
    reason = F.when(expected.isNull(), "not_evaluable_missing_meter_context").when(pickup, "pickup_exempt").when(missing > epsilon, "review_visual_meter_deficit").otherwise("meter_not_underfilled")
    return F.struct(F.coalesce(flag, F.lit(False)).alias("flag"), reason.alias("reason"), missing.alias("missing"))


def alarm_report(rows: DataFrame, flag: str, wrong: str) -> DataFrame:
    """One row: how alarms and errors agree over rows whose error is known, and the share of rows flagged."""
    f, e = F.col(flag), F.col(wrong)
    s = rows.where(e.isNotNull()).agg(F.count("*").alias("measures"), _one(f & e).alias("tp"), _one(f & ~e).alias("fp"), _one(~f & e).alias("fn"), _one(~f & ~e).alias("tn"))
    scores = C.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("*", *(c.alias(n) for c, n in zip(scores, ("precision", "recall", "f1"), strict=True)), F.round(C.safe_ratio(F.col("tp") + F.col("fp"), F.col("measures")), 6).alias("review_load"))


def triage(rows: DataFrame, seal: DataFrame, key: list[str], content: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose content still has the sealed hash (key, sha256), with their meter deficit; and problems: not sealed, changed, or missing."""
    both = rows.join(seal.select(*key, "sha256"), key, "full")
    problem = F.when(F.col(content).isNull(), "missing").when(F.col("sha256").isNull(), "not sealed").when(F.sha2(content, 256) != F.col("sha256"), "changed")
    marked = both.withColumn("problem", problem)
    good = marked.where("problem IS NULL").withColumn("deficit", deficit(F.col("visual_beats"), F.col("expected_beats"), F.col("allow_pickup")))
    return good.select(*rows.columns, "deficit.*"), marked.where("problem IS NOT NULL").select(*key, "problem")


def lane_diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, state) of two versions of a table: added, removed, changed or same, by one aggregation."""
    kind = a.schema[value].dataType
    side = lambda df, x, y: df.select(*key, x.alias("__a"), y.alias("__b"), F.lit(x is not none).alias("__in_a"), F.lit(y is not none).alias("__in_b"))
    none = F.lit(None).cast(kind)
    both = side(a, F.col(value), none).unionByName(side(b, none, F.col(value))).groupBy(*key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"), F.max("__in_a").alias("__in_a"), F.max("__in_b").alias("__in_b"))
    state = F.when(~F.col("__in_a"), "added").when(~F.col("__in_b"), "removed").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("changed")
    return both.select(*key, state.alias("state"))


def lane_invariance(lanes: DataFrame, key: list[str], lane: str, baseline: str, columns: list[str]) -> DataFrame:
    """(key, lane, present, a flag for each column): whether each other lane has a baseline's identities with equal values (arrays or others)."""
    base = lanes.where(F.col(lane) == baseline).select(*key, F.struct(*columns).alias("__a"))
    names = lanes.where(F.col(lane) != baseline).select(lane).distinct()
    plan = base.select(*key).unionAll(lanes.select(*key)).distinct().crossJoin(F.broadcast(names))
    rows = plan.join(base, key, "left").join(lanes.select(*key, lane, F.struct(*columns).alias("__b")), [*key, lane], "left")
    present = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return rows.select(*key, lane, present.alias("present"), *((present & F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}"))).alias(f"{c}_equal") for c in columns))


def changed_places(a: DataFrame, b: DataFrame, key: list[str], values: str) -> DataFrame:
    """(key, place from 0, before, after): where two lanes' arrays of the same length differ."""
    both = a.select(*key, F.col(values).alias("__a")).join(b.select(*key, F.col(values).alias("__b")), key)
    pairs = F.transform(F.arrays_zip("__a", "__b"), lambda z, k: F.struct(k.alias("place"), z["__a"].alias("before"), z["__b"].alias("after")))
    return both.select(*key, F.explode(F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))).alias("p")).select(*key, "p.*")


def pitch_summary(measures: DataFrame, by: str) -> DataFrame:
    """Totals and one row a score (null: all): counts, capacity, exact matches, edits, and accuracy within capacity, null without any. Measures have predicted, truth, matches and edits."""
    p, t = F.col("predicted"), F.col("truth")
    rows = measures.rollup(by).agg(F.count("*").alias("measures"), F.sum(p).alias("predicted"), F.sum(t).alias("truth"), F.sum(F.least(p, t)).alias("capacity"), F.sum("matches").alias("matches"), F.sum("edits").alias("edits"), F.grouping(by).cast("int").alias("is_total"))
    return rows.withColumn("accuracy", F.round(C.safe_ratio(F.col("matches"), F.col("capacity"), None), 6))


def coverage_problems(assignments: DataFrame, expected: DataFrame, bars: DataFrame, by: str) -> DataFrame:
    """(by, problem, id) of a source map: rows (by, written_bar, kind, source_bar_id, editorial_id, reason) against the expected source bars (by, source_bar_id) and the number of written
    bars (by, n_bars). A primary names a source bar; a return copy also a reason; an editorial insertion an id and a reason and no source."""
    rows = assignments.join(bars, by)
    told = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    sourced = F.col("kind").isin("primary", "return_copy") & told(F.col("source_bar_id"))
    editorial = (F.col("kind") == "editorial_insertion") & told(F.col("editorial_id")) & told(F.col("reason")) & F.col("source_bar_id").isNull()
    inside = F.coalesce(F.col("written_bar").between(1, F.col("n_bars")), F.lit(False))
    good = rows.where(inside)
    out = rows.where(~inside).select(by, F.lit("out_of_range").alias("problem"), F.col("written_bar").cast("string").alias("id"))

    def add(df: DataFrame, problem: str, column: str) -> None:
        nonlocal out
        out = out.unionByName(df.select(by, F.lit(problem).alias("problem"), F.col(column).cast("string").alias("id")).distinct())

    primary = good.where(sourced & (F.col("kind") == "primary"))
    add(expected.join(primary, [by, "source_bar_id"], "left_anti"), "missing_source", "source_bar_id")
    add(primary.groupBy(by, "source_bar_id").count().where("count > 1"), "duplicate_primary", "source_bar_id")
    add(good.where(sourced).join(expected, [by, "source_bar_id"], "left_anti"), "unknown_source", "source_bar_id")
    wrong = (~sourced & ~editorial) | (sourced & F.col("editorial_id").isNotNull()) | (sourced & (F.col("kind") == "return_copy") & ~told(F.col("reason")))
    every = bars.select(by, F.explode(F.when(F.col("n_bars") > 0, F.sequence(F.lit(1), F.col("n_bars")))).alias("written_bar"))
    add(good.where(wrong).select(by, "written_bar").unionByName(every.join(good, [by, "written_bar"], "left_anti").select(by, "written_bar")), "unclassified_bar", "written_bar")
    add(good.groupBy(by, "written_bar").count().where("count > 1"), "duplicate_bar", "written_bar")
    add(good.where(editorial).groupBy(by, "editorial_id").count().where("count > 1"), "duplicate_editorial", "editorial_id")
    return out


def route_mismatch(rows: DataFrame, actual: str, expected: str, out: str = "first_mismatch") -> DataFrame:
    """Rows with the first place, from 1, where two routes differ (one may end early); null if they are equal."""
    places = F.filter(F.transform(F.zip_with(actual, expected, lambda a, b: ~a.eqNullSafe(b)), lambda d, k: F.when(d, k + 1)), lambda x: x.isNotNull())
    return rows.withColumn(out, F.array_min(places))


def dimension_comparison(rows: DataFrame, by: list[str], dimensions: list[str], left: str, right: str) -> DataFrame:
    """(by, dimension, status, left_sha256, right_sha256): each dimension of two structs by the hash of its JSON."""
    one = lambda d: F.struct(F.lit(d).alias("dimension"), F.sha2(F.to_json(F.struct(F.col(f"{left}.{d}").alias("v"))), 256).alias("left_sha256"), F.sha2(F.to_json(F.struct(F.col(f"{right}.{d}").alias("v"))), 256).alias("right_sha256"))
    tall = rows.select(*by, F.explode(F.array(*map(one, dimensions))).alias("d")).select(*by, "d.*")
    return tall.withColumn("status", F.when(F.col("left_sha256") == F.col("right_sha256"), "matched").otherwise("mismatched"))


def differing_paths(left: object, right: object, prefix: str = "") -> list[str]:
    """Dotted paths of a nested value where two of them differ; a list counts as one value."""
    if left == right and type(left) is type(right):
        return []
    if isinstance(left, dict) and isinstance(right, dict):
        return [p for key in sorted(left.keys() | right.keys()) for p in differing_paths(left.get(key), right.get(key), f"{prefix}.{key}".strip("."))]
    return [prefix or "value"]


def first_items(df: DataFrame, by: list[str], order: list[Column], most: int = 5) -> DataFrame:
    """The first rows of each group, and how many more there are (column more)."""
    w = W.partitionBy(*by)
    rows = df.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return rows.where(F.col("__k") <= most).drop("__k")


def batch_status(plan: DataFrame, status: DataFrame, stages: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Every planned work with its state, how many of its stages are complete, what they cost, and whether it is done: complete with all stages on record."""
    done = stages.groupBy(key).agg(F.count_distinct(F.when(F.col("complete") & F.col("stage").isin(*names), F.col("stage"))).alias("n_complete"), F.sum("cost").alias("cost"), F.count("cost").alias("n_costs"))
    rows = plan.join(status.select(key, "state"), key, "left").join(done, key, "left").na.fill(0, ["n_complete", "n_costs"])
    finished = (F.col("state") == "complete") & (F.col("n_complete") == len(names))
    label = F.when(F.col("state").isNull(), "not started").when((F.col("state") == "complete") & ~finished, "missing a stage record").otherwise(F.col("state"))
    return rows.withColumn("done", F.coalesce(finished, F.lit(False))).withColumn("outcome", label)


#: Categories of exceptions that a source may justify, fields of a decision.
EXCEPTIONS = ("source_irregular_meter", "unpaired_pickup")
DECISION_FIELDS = ("id", "location", "category", "adopted_choice", "reason", "uncertainty")


def score_issues(scores: DataFrame, bars: DataFrame, decisions: DataFrame, by: str) -> DataFrame:
    """(by, kind, measure, observed_ticks, expected_ticks, partial_reason, detail, issue_id): errors and warnings, no bars, bars whose meter isn't valid, an unresolved route, and
    decisions that lack a field. An issue's id is the hash of what it says, so it changes with the draft."""
    none = lambda t: F.lit(None).cast(t)

    def shape(df: DataFrame, kind: str, detail: Column, measure=None, observed=None, expected=None, reason=None) -> DataFrame:
        pick = lambda c, t: none(t) if c is None else F.col(c).cast(t)
        return df.select(by, F.lit(kind).alias("kind"), pick(measure, "int").alias("measure"), pick(observed, "long").alias("observed_ticks"), pick(expected, "long").alias("expected_ticks"), pick(reason, "string").alias("partial_reason"), detail.alias("detail"))

    said = lambda c: scores.select(by, F.explode(c).alias("x"))
    issues = shape(said("errors"), "parse", F.col("x"))
    issues = issues.unionByName(shape(scores.where(~F.coalesce("valid", F.lit(False)) & (F.size("errors") == 0)), "parse", F.lit("The notation isn't valid.")))
    issues = issues.unionByName(shape(said("warnings"), "parser_warning", F.col("x")))
    issues = issues.unionByName(shape(scores.join(bars, by, "left_anti"), "empty", F.lit("There are no written bars.")))
    issues = issues.unionByName(shape(bars.where(~F.coalesce("meter_valid", F.lit(False))), "meter", F.lit("Look at the source; don't fill in rests."), "number", "duration_ticks", "expected_ticks", "partial_reason"))
    issues = issues.unionByName(shape(scores.where(~F.col("route_status").eqNullSafe(F.lit("resolved"))), "form", F.lit("The route isn't resolved.")))
    lacking = F.exists(F.array(*(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in DECISION_FIELDS)), lambda x: x == "")
    issues = issues.unionByName(shape(decisions.where(lacking), "decisions", F.concat(F.lit("A decision lacks a field: "), F.coalesce(F.col("id").cast("string"), F.lit("?")))))
    return issues.withColumn("issue_id", F.sha2(F.to_json(F.struct("detail", "expected_ticks", "kind", "measure", "observed_ticks", "partial_reason")), 256))


def resolve_issues(issues: DataFrame, resolutions: DataFrame, drafts: DataFrame, inspections: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(issues with `resolved`, problems of resolutions). A resolution (by, place, issue_id, abc_sha256, category, inspection_call, texts) counts if its texts aren't blank, it is the
    first for its issue, names an issue of this draft (by, abc_sha256), which is about a meter that is known, in a category that is allowed, and cites an inspection (by, call)."""
    texts = [c for c in ("issue_id", "abc_sha256", "category", "reason", "evidence") if c in resolutions.columns]
    w = W.partitionBy(by, "issue_id").orderBy("place")
    rows = resolutions.withColumn("__nth", F.row_number().over(w)).join(drafts.select(by, F.col("abc_sha256").alias("__draft")), by, "left")
    known = issues.groupBy(by, "issue_id").agg(F.first("kind").alias("__kind"), F.first("expected_ticks").alias("__expected"), F.first("partial_reason").alias("__partial"))
    rows = rows.join(known, [by, "issue_id"], "left").join(inspections.select(by, F.col("call").alias("inspection_call"), F.lit(True).alias("__seen")).distinct(), [by, "inspection_call"], "left")
    blank = F.exists(F.array(*(F.coalesce(F.trim(c), F.lit("")) for c in texts)), lambda x: (x == "") | (F.length(x) > 4000))
    problem = (
        F.when(blank, "blank or too long text").when(F.col("__nth") > 1, "duplicate resolution")
        .when(F.col("__kind").isNull() | ~F.col("abc_sha256").eqNullSafe(F.col("__draft")), "stale or unmatched issue")
        .when((F.col("__kind") != "meter") | F.coalesce(F.col("__expected") == 0, F.lit(True)), "must be corrected")
        .when(~F.col("category").isin(*EXCEPTIONS) | ((F.col("category") == "unpaired_pickup") & ~F.col("__partial").eqNullSafe(F.lit("pickup_candidate"))), "unsupported category")
        .when(F.col("__seen").isNull(), "no inspection cited")
    )
    judged = rows.withColumn("problem", problem)
    good = judged.where("problem IS NULL").select(by, "issue_id", F.lit(True).alias("resolved"))
    marked = issues.join(good, [by, "issue_id"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    return marked, judged.where("problem IS NOT NULL").select(by, "place", "problem")


def completion(drafts: DataFrame, issues: DataFrame, problems: DataFrame, by: str) -> DataFrame:
    """Drafts (by, complete_claimed) with their status: ready if claimed and nothing is unresolved or wrong, with source exceptions if some were accepted; else needs_resolution or partial."""
    counts = issues.groupBy(by).agg(_one(F.col("resolved")).alias("accepted"), _one(~F.col("resolved")).alias("unresolved"))
    wrong = problems.groupBy(by).agg(F.count("*").alias("errors"))
    rows = drafts.join(counts, by, "left").join(wrong, by, "left").na.fill(0, ["accepted", "unresolved", "errors"])
    clean = F.col("unresolved") + F.col("errors") == 0
    ready = F.col("complete_claimed").eqNullSafe(F.lit(True)) & clean
    status = F.when(ready & (F.col("accepted") > 0), "ready_with_source_exceptions").when(ready, "ready").when(~clean, "needs_resolution").otherwise("partial")
    return rows.withColumn("completion_ready", ready).withColumn("status", status)


def catalog_problems(entries: DataFrame, front_matter: DataFrame, n_pages: int, first: int = 1) -> DataFrame:
    """(song_number, problem) of a catalog (song_number, mapping_status, pdf_pages, manuscript_pages, title, slug): numbers that aren't a run from `first`, wrong statuses, pages that don't
    go with the status, aren't consecutive, or, all together with the front matter (pdf_page), don't cover the document exactly once (null song)."""
    status, pdf, logical = F.col("mapping_status"), F.coalesce("pdf_pages", F.array().cast("array<int>")), F.coalesce("manuscript_pages", F.array().cast("array<int>"))
    run = F.when(F.size(pdf) > 0, F.sequence(F.array_min(pdf), F.array_min(pdf) + F.size(pdf) - 1))
    found = F.filter(F.array(
        F.when(~status.isin("verified", "missing", "unresolved"), F.lit("unknown status")),
        F.when((status == "verified") & ((F.size(pdf) == 0) | (F.size(pdf) != F.size(logical))), F.lit("verified without every page")),
        F.when((status == "verified") & (F.size(pdf) > 0) & (pdf != run), F.lit("pages aren't consecutive")),
        F.when((status != "verified") & (F.size(pdf) > 0), F.lit("unverified entry owns pages")),
        F.when((status == "missing") & ((F.size(logical) == 0) | F.coalesce(F.col("title") == "-", F.lit(True))), F.lit("missing work without name or pages")),
        F.when((status == "unresolved") & ((F.size(logical) > 0) | ~F.col("title").eqNullSafe(F.lit("-")) | F.col("slug").isNotNull()), F.lit("placeholder is named or mapped")),
    ), lambda x: x.isNotNull())
    problems = entries.select("song_number", F.explode(found).alias("problem"))
    numbers = entries.groupBy("song_number").count()
    twice = numbers.where("count > 1").select("song_number", F.lit("listed twice").alias("problem"))
    span = numbers.agg(F.min("song_number").alias("lo"), F.max("song_number").alias("hi"), F.count("*").alias("n")).where((F.col("lo") != first) | (F.col("hi") - F.col("lo") + 1 != F.col("n")))
    gap = span.select(F.lit(None).cast(entries.schema["song_number"].dataType).alias("song_number"), F.lit("numbers aren't a run").alias("problem"))
    used = entries.select(F.explode(pdf).alias("page")).unionAll(front_matter.select(F.col("pdf_page").alias("page")))
    pages = used.withColumn("u", F.lit(1)).withColumn("e", F.lit(0)).unionAll(entries.sparkSession.range(1, n_pages + 1).select(F.col("id").cast("int").alias("page"), F.lit(0).alias("u"), F.lit(1).alias("e")))
    cover = pages.groupBy("page").agg(F.sum("u").alias("u"), F.sum("e").alias("e")).where("u != 1 OR e != 1")
    wrong = cover.select(F.lit(None).cast(entries.schema["song_number"].dataType).alias("song_number"), F.concat(F.lit("page "), F.col("page"), F.when(F.col("e") == 0, " is outside").when(F.col("u") == 0, " isn't covered").otherwise(" is covered twice")).alias("problem"))
    return problems.unionByName(twice).unionByName(gap).unionByName(wrong)


def catalog_summary(entries: DataFrame, front_matter: DataFrame) -> DataFrame:
    """One row of a catalog's counts, to be held against the stored ones."""
    of = lambda s: _one(F.col("mapping_status") == s)
    size = F.sum(F.size(F.coalesce("pdf_pages", F.array().cast("array<int>"))))
    rows = entries.agg(F.count("*").alias("table_rows"), (of("verified") + of("missing")).alias("named_works"), of("verified").alias("verified_present_works"), of("missing").alias("missing_named_works"), of("unresolved").alias("unresolved_placeholder_rows"), size.alias("mapped_score_pages"))
    return rows.crossJoin(F.broadcast(front_matter.agg(F.count("*").alias("front_matter_pages"))))


def label_problems(labels: DataFrame, works: DataFrame, by: str) -> DataFrame:
    """(by, problem) of label sidecars (by, source_sha256, edition_sha256, status, decisions) against frozen works (by, source_sha256, edition_sha256): missing, unknown, listed twice,
    made for other files, an unknown status, or decisions (array of structs id, reason) without id or reason or with an id twice."""
    mine = labels.groupBy(by).agg(F.count("*").alias("__n"), F.first(F.struct("source_sha256", "edition_sha256", "status", "decisions")).alias("__l"))
    rows = works.select(by, F.col("source_sha256").alias("__s"), F.col("edition_sha256").alias("__e")).join(mine, by, "full")
    ids = F.transform("__l.decisions", lambda d: F.trim(d["id"]))
    blank = F.exists("__l.decisions", lambda d: (F.coalesce(F.trim(d["id"]), F.lit("")) == "") | (F.coalesce(F.trim(d["reason"]), F.lit("")) == ""))
    problem = (
        F.when(F.col("__l").isNull(), "missing labels").when(F.col("__s").isNull(), "unknown work").when(F.col("__n") > 1, "listed twice")
        .when(~(F.col("__l.source_sha256").eqNullSafe(F.col("__s")) & F.col("__l.edition_sha256").eqNullSafe(F.col("__e"))), "made for other files")
        .when(~F.coalesce(F.col("__l.status").isin("draft", "reviewed"), F.lit(False)), "unknown status").when(blank, "decision without id or reason").when(F.size(ids) != F.size(F.array_distinct(ids)), "decision listed twice")
    )
    return rows.select(by, problem.alias("problem")).where("problem IS NOT NULL")


def sealed_before_truth(predictions: DataFrame, seals: DataFrame, openings: DataFrame, by: str, content: str) -> DataFrame:
    """(by, problem): predictions that weren't sealed, changed since, or were sealed when the truth (by, opened_at) was open already."""
    rows = predictions.select(by, F.sha2(content, 256).alias("__now")).join(seals.select(by, "sha256", "sealed_at"), by, "left").join(openings.select(by, "opened_at"), by, "left")
    problem = F.when(F.col("sha256").isNull(), "not sealed").when(F.col("sha256") != F.col("__now"), "changed after sealing").when(F.col("opened_at") <= F.col("sealed_at"), "sealed after truth was opened")
    return rows.select(by, problem.alias("problem")).where("problem IS NOT NULL")


def hash_gate(rows: DataFrame, pins: DataFrame, by: list[str], order: list[str], content: str) -> DataFrame:
    """(by, problem) of groups whose rows, hashed one after another in order, don't give the pinned hash (by, sha256), or that are on one side only."""
    row = F.sha2(content, 256)
    now = rows.select(*by, *order, row.alias("__h")).groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "__h"))), lambda x: x["__h"]), "\n"), 256).alias("__now"))
    both = now.join(pins, by, "full")
    problem = F.when(F.col("__now").isNull(), "missing rows").when(F.col("sha256").isNull(), "not pinned").when(F.col("__now") != F.col("sha256"), "changed")
    return both.select(*by, problem.alias("problem")).where("problem IS NOT NULL")


def attestation_problems(runs: DataFrame, traces: DataFrame, by: list[str], same: list[str], *, most_revisions: int = 2) -> DataFrame:
    """(by, problem): runs whose pinned runner record is missing, differs in one of the columns `same`, or doesn't attest isolation (input_only, fresh, no network, a runner, 0 to
    `most_revisions` passes) or, unless they failed, both output hashes."""
    rows = runs.alias("r").join(traces.withColumn("__there", F.lit(True)).alias("t"), by, "left")
    differs = F.filter(F.array(*(F.when(~F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in same)), lambda x: x.isNotNull())
    attested = (F.col("t.isolation") == "input_only") & F.col("t.fresh_context") & ~F.col("t.network_access") & (F.trim("t.runner_name") != "") & F.col("t.revision_passes").between(0, most_revisions)
    hashes = F.col("t.abc_sha256").isNotNull() & F.col("t.decision_log_sha256").isNotNull() & F.col("t.abc_sha256").eqNullSafe(F.col("r.abc_sha256")) & F.col("t.decision_log_sha256").eqNullSafe(F.col("r.decision_log_sha256"))
    problem = (
        F.when(F.col("t.__there").isNull(), "no runner record").when(F.size(differs) > 0, F.concat(F.lit("differs: "), F.array_join(differs, ", ")))
        .when(~F.coalesce(attested, F.lit(False)), "isolation isn't attested").when((F.col("r.status") != "failed") & ~hashes, "output hashes missing or different")
    )
    return rows.select(*(F.col(f"r.{c}").alias(c) for c in by), problem.alias("problem")).where("problem IS NOT NULL")


def revise(draft, validate, change, most: int = 2) -> list[tuple[object, list]]:
    """Every attempt with its issues: validate a draft, and while there are issues change it and try again, at most `most` times. A loop of the driver around an author."""
    attempts = [(draft, validate(draft))]
    while attempts[-1][1] and len(attempts) <= most:
        draft = change(*attempts[-1])
        attempts.append((draft, validate(draft)))
    return attempts


def audit_expansion(targets: DataFrame, verdicts: DataFrame, key: list[str], readers: int = 2) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons): targets (key, events, location) that `readers` readers support without issues, with the same events as a bag and the same location."""
    own = targets.select(*key, F.col("events").alias("__e"), F.col("location").alias("__l"))
    reason = (
        F.when(F.col("status") != "supported", F.col("status")).when(F.size("issues") > 0, "has issues")
        .when(~C.same_bag(F.col("events"), F.col("__e")), "other events").when(~F.col("location").eqNullSafe(F.col("__l")), "other location")
    )
    said = verdicts.join(own, key).groupBy(*key).agg(F.count_distinct("reader_id").alias("__n"), F.sort_array(F.collect_set(F.when(reason.isNotNull(), F.concat("reader_id", F.lit(": "), reason)))).alias("reasons"))
    rows = targets.join(said, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0))).withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    rows = rows.withColumn("reasons", F.when(F.col("__n") < readers, F.concat("reasons", F.array(F.lit("too few readers")))).otherwise(F.col("reasons"))).drop("__n")
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def dotted_half(decisions: DataFrame, lane: DataFrame, by: list[str], beats: float = 3.0) -> DataFrame:
    """(by, applied, reason, duration_beats) of repairs (accepted, expected_beats, chosen_ids, dot_pairs) by their candidates (candidate_id, onset_group): an accepted pair with
    dots, in a measure of three beats, whose two candidates share one onset group, lasts the whole measure."""
    seen = lane.groupBy(*by).agg(F.count("*").alias("__n"), F.sort_array(F.collect_set("candidate_id")).alias("__ids"), F.min("onset_group").alias("__lo"), F.max("onset_group").alias("__hi"))
    rows = decisions.join(seen, by, "left")
    fits = (F.col("__n") == 2) & (F.col("__ids") == F.sort_array(F.array_distinct("chosen_ids"))) & (F.size("chosen_ids") == 2)
    reason = (
        F.when(~F.coalesce("accepted", F.lit(False)), "sparse_repair_not_accepted").when(~F.coalesce(F.abs(F.col("expected_beats") - beats) < 1e-9, F.lit(False)), "expected_meter_is_not_three_beats")
        .when(F.size("dot_pairs") < 1, "no augmentation dots").when(~F.coalesce(fits, F.lit(False)), "candidates differ from the chosen pair")
        .when(~((F.col("__lo") == F.col("__hi")) & (F.col("__lo") > 0)), "candidates don't share an onset").otherwise("accepted_visual_dotted_half_dyad")
    )
    out = rows.select(*by, reason.alias("reason"))
    return out.select(*by, (F.col("reason") == "accepted_visual_dotted_half_dyad").alias("applied"), "reason", F.when(F.col("reason") == "accepted_visual_dotted_half_dyad", beats).alias("duration_beats"))
