"""Further queries over the driver's tables: editions, benchmarks, points, choices, reports, playback, sources - with equivalent DuckDB SQL where SQL can tell them.

Orders stand for bars, line items for their notes, customers for scores; a second version of each is the candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import benchmark, editions, models, playback, rasters, reports, selection, sequences, spatial, timeline
from ..operators import events as views
from ..sources import abc_reader, notation, payloads
from .registry import _EV, events, query, table

_BARS = """ref AS (SELECT o_custkey AS score, o_orderkey AS bar, l_linenumber % 3 AS onset, CAST(l_quantity AS BIGINT) AS dur, l_partkey % 12 AS pitch, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
cand AS (SELECT o_custkey AS score, o_orderkey AS bar, l_linenumber % 3 AS onset, CAST(l_quantity AS BIGINT) AS dur, l_partkey % 12 + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS pitch, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _bars(spark, sf_dir, changed: bool) -> DataFrame:
    """Bars of every customer, numbered by order, with their line items as notes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    shift = F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0) if changed else F.lit(0)
    note = F.struct((F.col("l_linenumber") % 3).cast("long").alias("onset"), F.col("l_quantity").cast("long").alias("duration"), (F.col("l_partkey") % 12 + shift).cast("int").alias("pitch"), F.lit(False).alias("tie_start"), F.lit(False).alias("tie_end"))
    notes = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(note).alias("notes"))
    orders = views.ranked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("score"), "o_orderkey", "o_orderstatus"), ["score"], [F.col("o_orderkey")], "number")
    bars = orders.join(notes, "o_orderkey", "left")
    return bars.select("score", (F.col("number") - 1).cast("long").alias("place"), "number", F.col("o_orderkey").alias("bar"), F.col("o_orderstatus").alias("meter"), F.lit(True).alias("meter_valid"), F.lit(None).cast("string").alias("partial_reason"), F.coalesce("notes", F.array().cast(notes.schema["notes"].dataType)).alias("notes"), F.array().cast("array<struct<onset:long,duration:long,visible:boolean>>").alias("rests"), F.array().cast("array<struct<onset:long,symbol:string>>").alias("chords"))


@query(f"""WITH {_BARS}, m AS (SELECT score, bar, sum(least(ref.n, cand.n)) AS m FROM ref JOIN cand USING (score, bar, onset, dur, pitch) GROUP BY ALL), e AS (SELECT score, bar, sum(n) AS e FROM ref GROUP BY ALL), p AS (SELECT score, bar, sum(n) AS p FROM cand GROUP BY ALL),
b AS (SELECT o_custkey AS score, coalesce(m, 0) AS m, coalesce(p, 0) AS p, coalesce(e, 0) AS e FROM orders LEFT JOIN m ON m.score = o_custkey AND m.bar = o_orderkey LEFT JOIN p ON p.score = o_custkey AND p.bar = o_orderkey LEFT JOIN e ON e.score = o_custkey AND e.bar = o_orderkey)
SELECT score, CAST(sum(m) AS BIGINT) AS notes_matched, CAST(sum(p) AS BIGINT) AS notes_predicted, CAST(sum(e) AS BIGINT) AS notes_expected, count(*) AS alignment_columns, count(*) FILTER (m = p AND m = e) AS exact_measures, round(2 * sum(m) / (sum(p) + sum(e)), 9) AS edition_note_f1, round(count(*) FILTER (m = p AND m = e) / count(*), 9) AS edition_exact_bar_rate FROM b GROUP BY score""")
def edition_comparison(spark, sf_dir):
    """Events and bars of candidate scores against editions, bars paired by number."""
    reference, candidate = (_bars(spark, sf_dir, c).drop("bar") for c in (False, True))
    paired = reference.select("score", F.col("place").alias("column"), F.col("place").alias("reference"), F.col("place").alias("candidate"))
    out = editions.edition_summary(editions.compared_bars(paired, reference, candidate, "score"), "score")
    return out.select("score", "notes_matched", "notes_predicted", "notes_expected", "alignment_columns", "exact_measures", F.round("edition_note_f1", 9).alias("edition_note_f1"), F.round("edition_exact_bar_rate", 9).alias("edition_exact_bar_rate"))


@query()
def bar_alignment(spark, sf_dir):
    """Global alignment of every customer's bars with those of the changed version; the operator is tested against brute force."""
    return editions.align_bars(_bars(spark, sf_dir, False), _bars(spark, sf_dir, True), "score")


@query(f"""WITH {_BARS}, x AS (SELECT bar, onset || ':' || dur || ':' || pitch AS k, n FROM ref) SELECT o_orderkey AS bar, coalesce((SELECT sum(n) FROM x WHERE x.bar = o_orderkey), 0)::BIGINT AS heads, coalesce((SELECT count(*) FROM x WHERE x.bar = o_orderkey), 0)::BIGINT AS distinct_heads FROM orders""")
def event_fingerprints(spark, sf_dir):
    """Heads of each bar with and without repeats; the fingerprint of a bag differs where either does."""
    keys = editions.note_keys(F.col("notes"))
    return _bars(spark, sf_dir, False).select("bar", F.size(keys).cast("long").alias("heads"), F.size(F.array_distinct(keys)).cast("long").alias("distinct_heads"))


_NOTES = """t AS (SELECT l_orderkey AS id, l_linenumber % 4 AS onset, 1 + l_partkey % 3 AS dur, l_partkey % 24 AS pitch FROM lineitem), p AS (SELECT l_orderkey AS id, l_linenumber % 4 AS onset, 1 + l_partkey % 3 AS dur, l_partkey % 24 + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS pitch FROM lineitem),
to_ AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY onset, pitch, dur) AS k FROM t), po AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY onset, pitch, dur) AS k FROM p),
o AS (SELECT id, count(*) FILTER (to_.pitch = po.pitch) AS pitch_matches, count(*) FILTER (to_.onset = po.onset) AS onset_matches, count(*) FILTER (to_.dur = po.dur) AS duration_matches, count(*) AS compared_notes FROM to_ JOIN po USING (id, k) GROUP BY id),
dt AS (SELECT DISTINCT * FROM t), dp AS (SELECT DISTINCT * FROM p), s AS (SELECT id, count(*) FILTER (a AND b) AS tp, count(*) FILTER (b AND NOT a) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM (SELECT coalesce(dt.id, dp.id) AS id, dt.id IS NOT NULL AS a, dp.id IS NOT NULL AS b FROM dt FULL JOIN dp ON dt.id = dp.id AND dt.onset = dp.onset AND dt.dur = dp.dur AND dt.pitch = dp.pitch) GROUP BY id)"""


def _benchmark(spark, sf_dir, changed: bool) -> DataFrame:
    shift = F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0) if changed else F.lit(0)
    note = F.struct((F.col("l_linenumber") % 4).cast("double").alias("onset"), (F.col("l_partkey") % 24 + shift).cast("int").alias("pitch"), (1 + F.col("l_partkey") % 3).cast("double").alias("duration"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(note).alias("notes"))
    return rows.withColumn("rests", F.array().cast("array<struct<onset:double,duration:double>>")).withColumn("extent", F.lit(7.0))


@query(f"""WITH {_NOTES} SELECT id, CAST(compared_notes AS BIGINT) AS compared_notes, pitch_matches, onset_matches, duration_matches, tp AS note_tp, fp AS note_fp, fn AS note_fn, round(2 * tp / (2 * tp + fp + fn), 6) AS note_f1, fp + fn = 0 AS exact_measure FROM o JOIN s USING (id)""")
def benchmark_evaluation(spark, sf_dir):
    """Predicted notes of every measure against the true ones, in order and as sets."""
    out = benchmark.evaluate(_benchmark(spark, sf_dir, True), _benchmark(spark, sf_dir, False), ["id"])
    return out.select("id", "compared_notes", "pitch_matches", "onset_matches", "duration_matches", "note_tp", "note_fp", "note_fn", "note_f1", "exact_measure")


@query(f"""WITH {_NOTES} SELECT count(*) AS targets, count(*) AS predicted, count(*) FILTER (fp + fn = 0) AS exact_measures, round(sum(pitch_matches) / sum(compared_notes), 6) AS ordered_pitch_accuracy, round(sum(onset_matches) / sum(compared_notes), 6) AS ordered_onset_accuracy, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS note_f1 FROM o JOIN s USING (id)""")
def benchmark_summary(spark, sf_dir):
    """The whole benchmark in one row: weighted accuracies, agreement over all distinct notes."""
    predictions, truths = _benchmark(spark, sf_dir, True), _benchmark(spark, sf_dir, False)
    out = benchmark.summary(benchmark.evaluate(predictions, truths, ["id"]), predictions, truths, ["id"], "id")
    return out.select("targets", "predicted", "exact_measures", "ordered_pitch_accuracy", "ordered_onset_accuracy", "note_f1")


@query("""WITH n AS (SELECT l_orderkey AS id, CAST(l_linenumber % 4 AS DOUBLE) AS s, l_linenumber % 4 + 0.5 + (l_partkey % 3) / 2 AS e FROM lineitem), w AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM n),
g AS (SELECT id, coalesce(b, 0) AS a, s AS z FROM w WHERE coalesce(b, 0) < s UNION ALL SELECT id, max(e), 5.0 FROM n GROUP BY id HAVING max(e) < 5.0) SELECT id, a AS onset, z - a AS duration FROM g""")
def benchmark_rests(spark, sf_dir):
    """Truth rows from notes: what a measure of five beats leaves open."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4).cast("double").alias("onset_beats"), (0.5 + (F.col("l_partkey") % 3) / 2).alias("duration_beats"), (F.col("l_partkey") % 24).cast("int").alias("pitch_midi"))
    asked = rows.select("id").distinct().withColumn("expected_beats", F.lit(5.0)).withColumn("allow_pickup", F.lit(False))
    good, _ = benchmark.truth(asked, rows, ["id"])
    return good.select("id", F.explode("rests").alias("r")).select("id", "r.onset", "r.duration")


@query("""WITH o AS (SELECT o_custkey AS c, count(*) AS n, bool_or(o_orderstatus = 'F') AS m, avg(o_orderkey % 100) AS v FROM orders GROUP BY 1), w AS (SELECT count(*) AS works_total, count(o.c) AS works_with_truth FROM customer LEFT JOIN o ON o.c = c_custkey)
SELECT works_total, works_with_truth, works_with_truth AS works_with_predictions, works_with_truth AS works_evaluated, round((SELECT count(*) FROM o WHERE m) / works_with_truth, 9) AS final_rate, (SELECT round(avg(v), 6) FROM o) AS value_avg, 1.0::DOUBLE AS evaluation_coverage, round(works_with_truth / works_total, 6) AS truth_coverage, true AS coverage_gate_passed FROM w""")
def work_coverage(spark, sf_dir):
    """Macro averages over works, match rates, and the coverage gate."""
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("work"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("work"), (F.col("o_orderstatus") == "F").alias("m"), (F.col("o_orderkey") % 100).alias("v"))
    metrics = orders.groupBy("work").agg(F.bool_or("m").alias("final"), F.avg("v").alias("value"))
    return benchmark.work_coverage(works, orders, orders, metrics, "work", rates=["final"], means=["value"]).withColumn("final_rate", F.round("final_rate", 9))


@query("""WITH p AS (SELECT o_custkey AS w, l_returnflag AS kind, l_linenumber AS m, l_partkey % 5 AS x, l_suppkey % 3 AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey), t AS (SELECT w, kind, CASE WHEN d = 0 AND x = 1 THEN m + 100 ELSE m END AS m, x, d FROM p),
n AS (SELECT coalesce(a.w, b.w) AS w, count(*) FILTER (a.w IS NOT NULL AND b.w IS NOT NULL) AS tp, count(*) FILTER (b.w IS NULL) AS fp, count(*) FILTER (a.w IS NULL) AS fn FROM (SELECT DISTINCT w, m, x, d FROM p WHERE kind <> 'N') a FULL JOIN (SELECT DISTINCT w, m, x, d FROM t WHERE kind <> 'N') b ON a.w = b.w AND a.m = b.m AND a.x = b.x AND a.d = b.d GROUP BY 1),
c AS (SELECT coalesce(a.w, b.w) AS w, count(*) FILTER (a.w IS NOT NULL AND b.w IS NOT NULL) AS tp, count(*) FILTER (b.w IS NULL) AS fp, count(*) FILTER (a.w IS NULL) AS fn FROM (SELECT DISTINCT w, m, d FROM p WHERE kind = 'N') a FULL JOIN (SELECT DISTINCT w, m, d FROM t WHERE kind = 'N') b ON a.w = b.w AND a.m = b.m AND a.d = b.d GROUP BY 1),
k AS (SELECT w, count(*) FILTER (kind <> 'N') AS notes, count(*) FILTER (kind = 'N') AS chords FROM p GROUP BY w)
SELECT k.w AS work, notes AS pred_notes, notes AS truth_notes, chords AS pred_chords, coalesce(n.tp, 0) AS note_true_positives, coalesce(n.fp, 0) AS note_false_positives, coalesce(n.fn, 0) AS note_false_negatives, round(CASE WHEN coalesce(n.tp, 0) > 0 THEN 2 * n.tp / (2 * n.tp + n.fp + n.fn) ELSE 0 END, 6) AS note_f1,
coalesce(c.tp, 0) AS chord_true_positives_measure_only, round(CASE WHEN coalesce(c.tp, 0) > 0 THEN 2 * c.tp / (2 * c.tp + c.fp + c.fn) ELSE 0 END, 6) AS chord_f1_measure_only FROM k LEFT JOIN n USING (w) LEFT JOIN c USING (w)""")
def event_metrics(spark, sf_dir):
    """Notes and chords of each work against the true ones, as sets; chords also by measure alone."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("work")), "l_orderkey")
    kind = F.when(F.col("l_returnflag") == "N", "chord").otherwise("note")
    moved = (F.col("l_suppkey") % 3 == 0) & (F.col("l_partkey") % 5 == 1)

    def side(measure):
        return rows.select("work", kind.alias("kind"), measure.alias("measure"), (F.col("l_partkey") % 5).cast("double").alias("onset_beats"), F.when(kind == "note", 1.0).alias("duration_beats"), F.when(kind == "note", (F.col("l_suppkey") % 3).cast("int")).alias("pitch_midi"), F.when(kind == "chord", (F.col("l_suppkey") % 3).cast("string")).alias("symbol"))

    out = reports.compare_events(side(F.col("l_linenumber")), side(F.when(moved, F.col("l_linenumber") + 100).otherwise(F.col("l_linenumber"))), ["work"])
    return out.select("work", "pred_notes", "truth_notes", "pred_chords", "note_true_positives", "note_false_positives", "note_false_negatives", "note_f1", "chord_true_positives_measure_only", "chord_f1_measure_only")


def _points(spark, sf_dir, kind: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_type") == kind).select("user_id", "event_id", (F.col("s") / 3600).alias("x"), F.col("value").alias("y"))


@query(f"""WITH {_EV} SELECT a.user_id, a.event_id AS left_key, b.event_id AS right_key, round(sqrt((a.s - b.s) / 3600 * ((a.s - b.s) / 3600) + (a.value - b.value) * (a.value - b.value)), 6) AS distance FROM ev a JOIN ev b ON a.user_id = b.user_id
WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND sqrt((a.s - b.s) / 3600 * ((a.s - b.s) / 3600) + (a.value - b.value) * (a.value - b.value)) <= 24.0""")
def points_within(spark, sf_dir):
    """Pairs of points at most 24 apart, by grid cells."""
    return spatial.within(_points(spark, sf_dir, "click"), _points(spark, sf_dir, "purchase"), ["user_id"], "event_id", 24.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_EV} SELECT a.user_id, a.event_id AS left_key, b.event_id AS right_key FROM ev a JOIN ev b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'
AND pow((a.s - b.s) / 3600 / (5 + b.event_id % 7), 2) + pow((a.value - b.value) / (10 + b.event_id % 11), 2) <= 1""")
def ellipses_around(spark, sf_dir):
    """Points inside ellipses of different radii."""
    ellipses = _points(spark, sf_dir, "purchase").withColumn("radius_x", (5 + F.col("event_id") % 7).cast("double")).withColumn("radius_y", (10 + F.col("event_id") % 11).cast("double"))
    return spatial.within_ellipses(_points(spark, sf_dir, "click"), ellipses, ["user_id"], "event_id", 16.0).select("user_id", "left_key", "right_key")


@query("""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM p) SELECT id AS vec_id, max(other) FILTER (k = 1) AS nearest, max(other) FILTER (k = 2) AS second FROM r WHERE k <= 2 GROUP BY id""")
def knn_top2(spark, sf_dir):
    """The nearest vector and the runner-up, each row's own left out."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return spatial.nearest_two(rows, rows, "vec_id", "embedding").select("vec_id", "nearest", "second")


@query(f"""WITH RECURSIVE {_EV}, c AS (SELECT DISTINCT user_id AS u, s // 86400 AS y, s % 86400 // 3600 AS x FROM ev), r AS (SELECT u, x, y, x AS rx, y AS ry FROM c UNION SELECT r.u, r.x, r.y, c.x, c.y FROM r JOIN c ON c.u = r.u AND abs(c.x - r.rx) <= 1 AND abs(c.y - r.ry) <= 1),
m AS (SELECT u, x, y, min(ry * 24 + rx) AS least FROM r GROUP BY ALL) SELECT u AS user_id, x, y, CAST(dense_rank() OVER (PARTITION BY u ORDER BY least) - 1 AS BIGINT) AS component FROM m""")
def connected_components(spark, sf_dir):
    """Hours of a user's days with events, as cells of a grid that touch."""
    cells = events(spark, sf_dir).select("user_id", F.floor(F.col("s") % 86400 / 3600).alias("x"), F.floor(F.col("s") / 86400).alias("y"))
    return rasters.cell_components(cells, ["user_id"], "x", "y")


@query(f"""WITH {_EV}, v AS (SELECT user_id, s, max(value) AS v FROM ev GROUP BY ALL), w AS (SELECT *, max(v) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 21600 PRECEDING AND 21600 FOLLOWING) AS top, max(v) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING) AS l FROM v)
SELECT user_id, s FROM w WHERE v = top AND (l IS NULL OR l < v) AND v >= 10""")
def local_peaks(spark, sf_dir):
    """The highest values within six hours on either side, the first of equals."""
    rows = events(spark, sf_dir).groupBy("user_id", "s").agg(F.max("value").alias("v"))
    return spatial.local_maxima(rows, ["user_id"], "s", "v", 21600, 10.0).select("user_id", "s")


_CAPS = "c AS (SELECT l_linenumber AS cap, CAST(sum(l_partkey % 3) AS BIGINT) AS tp, CAST(sum(l_partkey % 5) AS BIGINT) AS fp, CAST(sum(l_suppkey % 2) AS BIGINT) AS fn, count(*) AS measures FROM lineitem GROUP BY 1), f AS (SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c)"


@query(f"WITH {_CAPS} SELECT cap, tp, fp, fn, measures, precision, recall, f1 FROM f")
def per_cap(spark, sf_dir):
    """Agreement for each proposal budget."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("cap"), (F.col("l_partkey") % 3).alias("tp"), (F.col("l_partkey") % 5).alias("fp"), (F.col("l_suppkey") % 2).alias("fn"), F.lit(False).alias("exact"))
    return selection.per_cap(rows).select("cap", "tp", "fp", "fn", "measures", "precision", "recall", "f1")


@query(f"WITH {_CAPS} SELECT (SELECT cap FROM f ORDER BY f1 DESC, cap LIMIT 1) AS best_cap, (SELECT max(f1) FROM f) AS best_f1, (SELECT min(cap) FROM f WHERE recall = (SELECT max(recall) FROM f)) AS least_cap_of_most_recall, (SELECT max(recall) FROM f) AS most_recall")
def best_cap(spark, sf_dir):
    """The budget of best F1, and the least one with the greatest recall."""
    return selection.best_cap(per_cap(spark, sf_dir))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, 1 + o_custkey % 4 AS cap FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k <= cap""")
def oracle_count(spark, sf_dir):
    """The best rows of each group, as many as the group's own count says."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return selection.capped(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1 + F.col("o_custkey") % 4).select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT l_returnflag AS f, l_suppkey AS k, sum(l_linenumber % 2) AS a, count(*) AS n FROM lineitem GROUP BY ALL) SELECT f, count(*) AS n, round(avg(a / n), 6) AS odd_macro, round(sum(a) / sum(n), 6) AS odd_micro FROM s GROUP BY f""")
def macro_micro(spark, sf_dir):
    """Mean of ratios beside ratio of sums."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_suppkey").agg(F.sum((F.col("l_linenumber") % 2)).alias("a"), F.count("*").alias("m"))
    return selection.macro_micro(rows, {"odd": ("a", "m")}, ["f"])


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), d AS (SELECT coalesce(r.v, 0) - coalesce(a.v, 0) AS d FROM a FULL JOIN r USING (k))
SELECT CAST(sum(d) AS BIGINT) AS delta, count(*) FILTER (d > 0) AS improved, count(*) FILTER (d < 0) AS regressed, count(*) FILTER (d = 0) AS unchanged, sum(d) > 0 AND count(*) FILTER (d > 0) >= 2 AND count(*) FILTER (d < 0) = 0 AS adopted FROM d""")
def adoption_gate(spark, sf_dir):
    """Whether a change gains on the whole, in two groups or more, and loses in none."""
    lines = table(spark, sf_dir, "lineitem")
    arm = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("v"))
    return selection.adoption(arm("A"), arm("R"), "k", "v")


_LABELLED = "d AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS words, quality FROM documents JOIN labels USING (doc_id))"


def _labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("words"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(f"""WITH {_LABELLED}, m AS (SELECT avg(n_chars) AS a, greatest(stddev_pop(n_chars), 1e-6) AS s, avg(words) AS b, greatest(stddev_pop(words), 1e-6) AS t FROM d) SELECT doc_id, round((n_chars - a) / s, 6) AS n_chars, round((words - b) / t, 6) AS words FROM d, m""")
def standardized(spark, sf_dir):
    """Features less their means, over their population deviations."""
    out = models.standardized(_labelled(spark, sf_dir), ["n_chars", "words"])
    return out.select("doc_id", F.round("n_chars", 6).alias("n_chars"), F.round("words", 6).alias("words"))


@query(f"""WITH {_LABELLED}, m AS (SELECT avg(words) FILTER (quality = 1) AS m1, avg(words) FILTER (quality = 0) AS m0, var_samp(words) FILTER (quality = 1) + 0.35 AS v1, var_samp(words) FILTER (quality = 0) + 0.35 AS v0 FROM d)
SELECT doc_id, round(0.5 * (ln(v0 / v1) + (words - m0) * (words - m0) / v0 - (words - m1) * (words - m1) / v1), 6) AS score FROM d, m""")
def naive_bayes(spark, sf_dir):
    """Log ratio of both classes' Gaussian likelihoods."""
    return models.naive_bayes_ratio(_labelled(spark, sf_dir), "quality", ["words"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_LABELLED}, s AS (SELECT avg(words) FILTER (quality = 1) AS p, avg(words) FILTER (quality = 0) AS n, stddev_pop(words) AS t FROM d), x AS (SELECT doc_id, quality, (p - n) / t * (words - (p + n) / 2) / t AS score FROM d, s)
SELECT doc_id, round(score, 6) AS score FROM x WHERE score + 1e-9 >= (SELECT min(score) FROM x WHERE quality = 1)""")
def centroid_filter(spark, sf_dir):
    """A filter by both classes' centres that keeps every positive."""
    rows = _labelled(spark, sf_dir)
    return selection.filtered(rows, selection.centroid_filter(rows, "quality", ["words"]), ["words"]).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING min(l_returnflag) = max(l_returnflag) AND min(l_returnflag) <> 'N'")
def unanimous(spark, sf_dir):
    """Groups whose rows all say the same, and not what is the default."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.lit("N").alias("usual"))
    return selection.unanimous(rows, ["l_orderkey"], "l_returnflag", "usual")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS p, l_suppkey % 9 AS t, l_linestatus = 'O' AS confounded, l_returnflag AS scope, least(l_partkey % 9, l_suppkey % 9) AS m FROM lineitem),
s AS (SELECT 'all' AS subset, * FROM u UNION ALL SELECT 'clean', * FROM u WHERE NOT confounded UNION ALL SELECT 'full_event', * FROM u WHERE scope = 'N')
SELECT subset, count(*) AS units, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS truth, CAST(sum(least(p, t)) AS BIGINT) AS capacity, CAST(sum(greatest(p - t, 0)) AS BIGINT) AS surplus, CAST(sum(greatest(t - p, 0)) AS BIGINT) AS deficit, round(2 * sum(least(p, t)) / (sum(p) + sum(t)), 6) AS f1, CAST(sum(m // 2) AS BIGINT) AS exact_pitch_matches, round(sum(m // 2) / sum(least(p, t)), 6) AS pitch_accuracy FROM s GROUP BY subset""")
def unit_hierarchy(spark, sf_dir):
    """All units, the clean ones and those with all events, each read once."""
    p, t = F.col("l_partkey") % 9, F.col("l_suppkey") % 9
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(p.alias("predicted_note_count"), t.alias("truth_note_count"), (F.col("l_linestatus") == "O").alias("segmentation_confounded"), F.when(F.col("l_returnflag") == "N", "full_event").otherwise("pitch_only").alias("scope"), F.floor(F.least(p, t) / 2).alias("exact_pitch_matches"), zero.alias("exact_onset_matches"), zero.alias("exact_duration_matches"), zero.alias("rest_tp"), zero.alias("rest_fp"), zero.alias("rest_fn"), F.lit(False).alias("exact_full_measure"))
    return reports.unit_hierarchy(rows).select("subset", "units", "predicted", "truth", "capacity", "surplus", "deficit", "f1", "exact_pitch_matches", "pitch_accuracy")


_RUNS = "r AS (SELECT c_custkey AS k, c_mktsegment AS model, CASE WHEN c_custkey % 7 = 0 THEN 'not_run' WHEN c_custkey % 3 = 0 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 100 END AS f1, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS cost FROM customer)"


def _runs(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_mktsegment").alias("model"), F.when(k % 7 == 0, "not_run").when(k % 3 == 0, "partial").otherwise("complete").alias("status"), F.when(k % 5 > 0, k % 100).alias("f1"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("cost"))


@query(f"""WITH {_RUNS} SELECT model, count(*) AS cases, count(*) FILTER (status <> 'not_run') AS attempted, count(*) FILTER (status = 'complete') AS complete, round(avg(f1) FILTER (status <> 'not_run'), 9) AS f1_mean, count(f1) FILTER (status <> 'not_run') AS f1_n, CAST(sum(cost) AS BIGINT) AS cost_total, count(cost) AS cost_n FROM r GROUP BY model""")
def run_summary(spark, sf_dir):
    """Each model's means over measured attempts and totals of what is known, with how many those are."""
    return reports.model_summary(_runs(spark, sf_dir), "model", ["f1"], ["cost"]).withColumn("f1_mean", F.round("f1_mean", 9))


@query("""WITH e AS (SELECT user_id, event_type, CAST(avg(event_id % 100) AS DOUBLE) AS v FROM events GROUP BY ALL) SELECT b.event_type AS model, count(*) AS pairs, round(avg(b.v - a.v), 6) AS mean_delta FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type <> 'click' GROUP BY 1""")
def paired_models(spark, sf_dir):
    """Mean difference of each model from the first, over cases with both."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("model")).agg(F.avg(F.col("event_id") % 100).alias("v"))
    return reports.paired_deltas(rows, "user_id", "model", "v", "click").withColumn("mean_delta", F.round("mean_delta", 6))


@query("""WITH s AS (SELECT p_brand AS brand, max(p_size) AS top FROM part GROUP BY 1), t AS (SELECT * FROM s WHERE top = (SELECT max(top) FROM s)) SELECT brand, top, (SELECT count(*) FROM t) > 1 AS tied FROM t""")
def tied_leaders(spark, sf_dir):
    """Who leads, and whether the lead is shared."""
    return reports.leaders(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_size").alias("top")), "top")


_TICKS = "b AS (SELECT o_custkey AS score, o_orderkey AS bar, o_orderkey % 3 * 384 + 384 AS d, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 1152 END AS e FROM orders)"


@query(f"""WITH {_TICKS}, w AS (SELECT *, first_value(d) OVER a AS d0, last_value(d) OVER a AS d1, first_value(e) OVER a AS e0, row_number() OVER (PARTITION BY score ORDER BY bar) AS k, count(*) OVER (PARTITION BY score) AS n FROM b WINDOW a AS (PARTITION BY score ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, coalesce(d0 < e0, false) AS short, coalesce(d0 < e0 AND n > 1 AND d0 + d1 = e0, false) AS whole FROM w), p AS (SELECT *, CASE WHEN k = 1 AND whole THEN 'pickup' WHEN k = n AND whole THEN 'pickup_complement' WHEN k = 1 AND short THEN 'pickup_candidate' END AS reason FROM r)
SELECT score, bar, reason AS partial_reason, CASE WHEN reason IN ('pickup', 'pickup_complement') THEN true WHEN reason = 'pickup_candidate' THEN NULL ELSE d = e END AS meter_valid FROM p""")
def meter_repair(spark, sf_dir):
    """Bars whose meter fits, with a short first bar and the last one that completes it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(c.alias("score"), k.alias("bar"), (k % 3 * 384 + 384).alias("duration_ticks"), F.when(c % 5 != 0, F.lit(1152).cast("long")).alias("expected_ticks"))
    return reports.meter_validity(rows, ["score"], "bar").select("score", "bar", "partial_reason", "meter_valid")


@query("""WITH RECURSIVE q AS (SELECT o_custkey AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 1000 + o_orderkey % 5000 AS i, 2000 + o_orderkey % 3000 AS mo, 500 AS lo, CASE WHEN o_orderkey % 3 > 0 THEN 900 + o_orderkey % 5000 END AS ai, CASE WHEN o_orderkey % 3 > 0 THEN 400 + o_orderkey % 100 END AS ao, o_orderkey % 800 AS ac FROM orders),
l AS (SELECT w, 0::BIGINT AS k, 0::BIGINT AS spent, true AS open, NULL::BIGINT AS outp, NULL::BIGINT AS reserved, 0::BIGINT AS charged, '' AS status FROM (SELECT DISTINCT w FROM q) UNION ALL
SELECT w, k, spent + charged, able, outp, reserved, charged, status FROM (SELECT *, CASE WHEN NOT able THEN 0 WHEN sound THEN (ai - ac) * 3 + ac * 1 + ao * 15 ELSE i * 3 + outp0 * 15 END AS charged, CASE WHEN able THEN outp0 END AS outp, CASE WHEN able THEN i * 3 + outp0 * 15 END AS reserved, CASE WHEN NOT able THEN 'refused' WHEN sound THEN 'reconciled' ELSE 'reserved' END AS status
FROM (SELECT *, open0 AND outp0 >= lo AND left0 >= 0 AS able, coalesce(ai BETWEEN 0 AND i AND ao BETWEEN 0 AND outp0 AND ac BETWEEN 0 AND ai, false) AS sound FROM (SELECT l.w, q.k, l.spent, l.open AS open0, q.i, q.lo, q.ai, q.ao, q.ac, 200000 - l.spent - q.i * 3 AS left0, least(q.mo, greatest((200000 - l.spent - q.i * 3) // 15, 0)) AS outp0 FROM l JOIN q ON q.w = l.w AND q.k = l.k + 1))))
SELECT w, CAST(k AS INT) AS request, outp AS output_tokens, reserved AS reserved_micro, charged AS charged_micro, status FROM l WHERE k > 0""")
def api_ledger(spark, sf_dir):
    """A budget that reserves the worst case and takes back what wasn't used."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("w"), k.alias("at"), (1000 + k % 5000).alias("input_tokens"), (2000 + k % 3000).alias("max_output"), F.lit(500).alias("min_output"), F.when(k % 3 > 0, 900 + k % 5000).alias("actual_input"), F.when(k % 3 > 0, 400 + k % 100).alias("actual_output"), (k % 800).alias("actual_cached"))
    out = reports.ledger(rows, ["w"], "at", limit="0.20", input_rate="3", cached_rate="1", output_rate="15")
    micro = lambda c: (F.col(c) * 1_000_000).cast("long")
    return out.select("w", "request", "output_tokens", micro("reserved").alias("reserved_micro"), micro("charged").alias("charged_micro"), "status")


@query("""WITH r AS (SELECT l_orderkey AS id, sum(l_linenumber % 3) AS v, CASE WHEN l_orderkey % 4 > 0 THEN 5 END AS e, l_orderkey % 9 = 0 AS p, CASE WHEN l_orderkey % 6 > 0 THEN l_orderkey % 2 = 0 END AS wrong FROM lineitem GROUP BY l_orderkey), f AS (SELECT *, coalesce(NOT p AND e - v > 1e-6, false) AS flag FROM r)
SELECT count(*) AS measures, count(*) FILTER (flag AND wrong) AS tp, count(*) FILTER (flag AND NOT wrong) AS fp, count(*) FILTER (NOT flag AND wrong) AS fn, count(*) FILTER (NOT flag AND NOT wrong) AS tn, round(count(*) FILTER (flag) / count(*), 6) AS review_load FROM f WHERE wrong IS NOT NULL""")
def deficit_alarms(spark, sf_dir):
    """Alarms on measures that fall short of their meter, against known errors."""
    k = F.col("id")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_linenumber") % 3).cast("double").alias("v"))
    rows = rows.select("id", reports.deficit(F.col("v"), F.when(k % 4 > 0, 5.0), k % 9 == 0)["flag"].alias("flag"), F.when(k % 6 > 0, k % 2 == 0).alias("wrong"))
    return reports.alarm_report(rows, "flag", "wrong").select("measures", "tp", "fp", "fn", "tn", "review_load")


@query("""WITH iv AS (SELECT o_custkey AS c, o_orderkey AS k, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 20 + o_orderkey % 40 AS e FROM orders)
SELECT a.c AS o_custkey, a.k AS first, b.k AS second FROM iv a JOIN iv b ON a.c = b.c AND b.s < a.e AND (a.s < b.s OR (a.s = b.s AND a.k < b.k))""")
def overlap_pairs(spark, sf_dir):
    """All pairs of a customer's order spans that overlap."""
    from .driver_queries import order_intervals

    return benchmark.overlap_pairs(order_intervals(spark, sf_dir), ["o_custkey"], "o_orderkey", "s", "e", 30)


_DAYS = f"{_EV}, d AS (SELECT user_id, s // 86400 AS day FROM ev GROUP BY ALL)"


@query(f"""WITH {_DAYS}, f AS (SELECT *, CASE WHEN day - lag(day) OVER w > 2 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM f),
s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM r GROUP BY user_id, run) SELECT user_id, CAST(b - a + 1 AS INT) AS length, CAST(a AS INT) AS "start", CAST(b AS INT) AS "end" FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY b - a DESC, a) = 1""")
def longest_run(spark, sf_dir):
    """The longest run of days with events, one day without allowed in between."""
    days = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set(F.floor(F.col("s") / 86400).cast("int")).alias("days"))
    present = F.transform(F.sequence(F.lit(0), F.array_max("days")), lambda d: F.array_contains(F.col("days"), d))
    return days.select("user_id", sequences.longest_gapped_run(present, 1).alias("r")).select("user_id", "r.length", "r.start", "r.end")


@query(f"""WITH RECURSIVE {_EV}, o AS (SELECT user_id AS u, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM (SELECT DISTINCT user_id, s FROM ev)), g AS (SELECT u, k, s, s AS first, 0 AS n FROM o WHERE k = 1 UNION ALL
SELECT o.u, o.k, o.s, CASE WHEN o.s - g.first > 43200 THEN o.s ELSE g.first END, g.n + CASE WHEN o.s - g.first > 43200 THEN 1 ELSE 0 END FROM g JOIN o ON o.u = g.u AND o.k = g.k + 1) SELECT u AS user_id, CAST(n AS INT) AS cluster, min(s) AS first_s, count(*) AS n FROM g GROUP BY u, n""")
def anchored_clusters(spark, sf_dir):
    """Times within half a day of their cluster's first."""
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("s").cast("double"))).alias("t"))
    flat = rows.select("user_id", F.explode(F.arrays_zip("t", sequences.anchored_clusters(F.col("t"), 43200).alias("c"))).alias("z"))
    return flat.groupBy("user_id", F.col("z.c").alias("cluster")).agg(F.min("z.t").cast("long").alias("first_s"), F.count("*").alias("n"))


_AUDIO = "a AS (SELECT user_id AS w, event_id % 40 AS index, CAST(event_id % 2500 AS DOUBLE) AS t, event_id % 3 - 1 AS instrument, event_id % 5 * 20 AS pitch, CAST(event_id % 90 AS DOUBLE) AS d, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 80 END AS volume, event_id FROM events), v AS (SELECT * FROM a WHERE t <= 1800 AND instrument >= 0 AND d > 0 AND ((pitch > 0 AND volume > 0) OR (pitch = 0 AND volume = 0)))"


def _audio(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("w"), (k % 40).alias("index"), (k % 2500).cast("double").alias("start"), (k % 3 - 1).alias("instrument"), (k % 5 * 20).alias("pitch"), (k % 90).cast("double").alias("duration"), F.when(k % 5 == 0, 0).otherwise(80).alias("volume"), "event_id")


@query(f'WITH {_AUDIO} SELECT DISTINCT w, index, t AS "start", t + least(d, 60) AS "end" FROM v')
def playback_timeline(spark, sf_dir):
    """What is highlighted when: valid events, held a minute at most, once a chord."""
    return playback.timeline(_audio(spark, sf_dir), ["w"])


@query(f'WITH {_AUDIO}, f AS (SELECT w, min(t) AS f FROM v WHERE index = 7 GROUP BY w) SELECT v.w, event_id, greatest(t, f) - f AS "start", t + least(d, 60) - greatest(t, f) AS duration FROM v JOIN f USING (w) WHERE t + least(d, 60) > f')
def playback_selection(spark, sf_dir):
    """The rest of a performance from the first visit of a chosen symbol."""
    rows = _audio(spark, sf_dir)
    chosen = rows.select("w").distinct().withColumn("index", F.lit(7).cast("long"))
    return playback.from_selection(rows, playback.timeline(rows, ["w"]), chosen, "w").select("w", "event_id", "start", "duration")


@query(f"""WITH {_AUDIO}, l AS (SELECT DISTINCT w, index, t AS s, t + least(d, 60) AS e FROM v), m AS (SELECT unnest(range(0, 1800, 45)) AS p) SELECT w, CAST(p AS BIGINT) AS "at", count(*) AS n FROM l JOIN m ON s <= p AND p < e GROUP BY ALL""")
def playback_active(spark, sf_dir):
    """How many events sound at given moments."""
    line = playback.timeline(_audio(spark, sf_dir), ["w"])
    moments = line.select("w").distinct().crossJoin(F.broadcast(spark.range(0, 1800, 45).select(F.col("id").alias("at"))))
    return playback.active_at(line, moments, ["w"]).groupBy("w", "at").agg(F.count("*").alias("n"))


_CHORDS = f"{_EV}, lab AS (SELECT user_id AS w, s AS t, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'Am7' WHEN 'purchase' THEN 'G/B' WHEN 'error' THEN 'N.C.' ELSE 'X?' END AS symbol FROM ev)"


@query(f"""WITH {_CHORDS}, one AS (SELECT w, t, CASE WHEN count(DISTINCT symbol) = 1 THEN min(symbol) END AS symbol FROM lab GROUP BY ALL), bar AS (SELECT DISTINCT w, t // 86400 * 86400 AS t FROM lab), p AS (SELECT * FROM one UNION ALL SELECT w, t, NULL FROM bar WHERE (w, t) NOT IN (SELECT (w, t) FROM one)),
x AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY w ORDER BY t), 3000000) AS z FROM p) SELECT w, symbol, t AS "start", z - t AS duration, CASE symbol WHEN 'C' THEN '48 52 55' WHEN 'Am7' THEN '57 60 64 67' ELSE '47 55 59 62' END AS pitches FROM x WHERE symbol IN ('C', 'Am7', 'G/B') AND z > t""")
def chord_spans(spark, sf_dir):
    """Chord symbols sound until the next one, the next day's bar or the end; those that disagree or have no pitches are silent."""
    kind = F.col("event_type")
    symbol = F.when(kind == "click", "C").when(kind == "view", "Am7").when(kind == "purchase", "G/B").when(kind == "error", "N.C.").otherwise("X?")
    labels = events(spark, sf_dir).select(F.col("user_id").alias("w"), F.col("s").alias("start"), symbol.alias("symbol"))
    bars = labels.select("w", (F.floor(F.col("start") / 86400) * 86400).alias("start")).distinct()
    out = playback.chord_spans(labels, bars, bars.limit(0), labels.select("w").distinct().withColumn("end", F.lit(3_000_000).cast("long")), "w")
    return out.select("w", "symbol", "start", "duration", F.array_join(F.transform("pitches", lambda p: p.cast("string")), " ").alias("pitches"))


@query(f"""WITH {_EV}, f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM f),
c AS (SELECT user_id, run, count(*) AS n, first(event_id ORDER BY s, event_id) AS head FROM r GROUP BY ALL) SELECT r.user_id, r.event_id AS head, c.head AS chain FROM r JOIN c USING (user_id, run) WHERE n > 1""")
def tie_chains(spark, sf_dir):
    """Events of one type in a row, as heads tied to the next one: each chain has its first head's name."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("s", "event_id")
    heads = events(spark, sf_dir).select("user_id", F.col("event_id").alias("head"), F.when(F.lead("event_type").over(w) == F.col("event_type"), F.lead("event_id").over(w)).alias("tied_to"), F.lit(None).cast("long").alias("given_id"))
    return playback.tie_chains(heads, "user_id")


@query("""SELECT p_partkey, p_size * 4 AS "left", greatest(p_size * 3 - 18, 0) AS crop_top, least(3000, p_size * 3 + 60 + p_size + greatest(24, (60 + p_size) // 6)) AS crop_bottom FROM part""".replace("p_size * 3 - 18", "p_size * 3 - greatest(18, (60 + p_size) // 8)"))
def system_crops(spark, sf_dir):
    """Boxes of systems, grown for a crop and kept on the page."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", rasters.box(size * 4, size * 3, size * 4 + 900, size * 3 + 60 + size).alias("b"))
    crop = rasters.system_crop(F.col("b"), F.lit(2000), F.lit(3000))
    return rows.select("p_partkey", F.col("b.left").alias("left"), crop["top"].alias("crop_top"), crop["bottom"].alias("crop_bottom"))


@query("""WITH x AS (SELECT l_orderkey AS k, list_sort(list(round(l_discount * 9 + l_linenumber / 100, 4))) AS b FROM lineitem GROUP BY 1), i AS (SELECT k, [v for v in b if v BETWEEN 0 AND 1] AS b FROM x), e AS (SELECT k, coalesce(list_max([v for v in b if v <= 0.08]), 0.0) AS l, coalesce(list_min([v for v in b if v >= 0.92]), 1.0) AS r, [v for v in b if v > 0.08 AND v < 0.92] AS m FROM i)
SELECT k, CASE WHEN r <= l THEN 1 ELSE len(list_distinct(m)) + 1 END::INT AS measures FROM e""")
def measure_edges(spark, sf_dir):
    """Measures of systems from their barlines."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.round(F.col("l_discount") * 9 + F.col("l_linenumber") / 100, 4)).alias("b"))
    return rows.select("k", rasters.measure_count(F.col("b")).alias("measures"))


@query("""SELECT p_partkey, trim(p_brand) AS symbol_raw, least(1.0, greatest(0.0, p_size / 25 - 0.2)) AS x_fraction, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE least(1.0, p_retailprice / 1500) END AS confidence FROM part WHERE trim(p_brand) <> ''""")
def recorded_detections(spark, sf_dir):
    """Chord symbols read from model answers in code fences: fractions within 0 and 1, unreadable ones 0."""
    number = F.when(F.col("p_size") % 3 == 0, F.lit("high")).otherwise((F.col("p_retailprice") / 1500).cast("string"))
    item = F.struct(F.concat(F.lit(" "), "p_brand").alias("symbol"), (F.col("p_size") / 25 - 0.2).alias("x_fraction"), number.alias("confidence"))
    answers = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("detections"))), F.lit("\n```")).alias("answer"))
    return payloads.detections(answers, "answer", "above").select("p_partkey", "symbol_raw", "x_fraction", "confidence")


_TUNE = "n AS (SELECT o_custkey AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m, o_orderkey FROM orders), t AS (SELECT w, m, unnest(range(4)) AS b, o_orderkey FROM n)"


@query(f"WITH {_TUNE} SELECT w, CAST(m AS INT) AS measure, b * 384 AS onset, 384::BIGINT AS duration, CAST(48 + (o_orderkey * 7 + b * 5) % 30 AS INT) AS pitch FROM t")
def abc_round_trip(spark, sf_dir):
    """Every customer's orders as a tune of four notes a bar, written as ABC and read back."""
    bars = views.ranked(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), "o_orderkey"), ["slug"], [F.col("o_orderkey")], "measure")
    notes = bars.select("slug", "measure", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"), "o_orderkey").select("slug", "measure", F.col("b").cast("double").alias("onset_beats"), F.lit(1.0).alias("duration_beats"), (48 + (F.col("o_orderkey") * 7 + F.col("b") * 5) % 30).cast("int").alias("pitch_midi"), F.lit(None).cast("int").alias("accidental"))
    works = bars.select("slug").distinct().select("slug", F.concat(F.lit("Tune "), F.col("slug")).alias("title"), F.lit("x").alias("composer"), F.lit("4/4").alias("time_signature"), F.lit("C").alias("key_hint"))
    chords = notes.limit(0).select("slug", "measure", "onset_beats", F.lit(0).alias("place"), F.lit("C").alias("symbol"))
    read = abc_reader.read_abc(notation.abc(works, notes, chords))
    back = abc_reader.bars_table(read, "slug").select("slug", "number", F.explode("notes").alias("n"))
    return back.select(F.col("slug").alias("w"), F.col("number").alias("measure"), "n.onset", "n.duration", "n.pitch")


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey % 3 AS lane, o_orderkey % 10 AS v FROM orders), s AS (SELECT o_custkey AS c, list(o_orderstatus ORDER BY o_orderkey) AS x, list(CASE WHEN o_orderkey % 13 = 0 THEN 'Z' ELSE o_orderstatus END ORDER BY o_orderkey) AS y FROM orders GROUP BY 1)
SELECT c AS o_custkey, list_min([i for i in range(1, len(x) + 1) if x[i] <> y[i]])::INT AS first_mismatch FROM s""")
def route_mismatch(spark, sf_dir):
    """Where two routes of a score first differ."""
    step = F.struct("o_orderkey", F.col("o_orderstatus").alias("x"), F.when(F.col("o_orderkey") % 13 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("y"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(step)).alias("r"))
    return reports.route_mismatch(rows.select("o_custkey", F.col("r.x").alias("x"), F.col("r.y").alias("y")), "x", "y").select("o_custkey", "first_mismatch")


@query("""SELECT o_orderpriority AS score, count(*) AS measures, CAST(sum(o_orderkey % 5) AS BIGINT) AS predicted, CAST(sum(o_custkey % 5) AS BIGINT) AS truth, CAST(sum(least(o_orderkey % 5, o_custkey % 5)) AS BIGINT) AS capacity, CAST(grouping(o_orderpriority) AS INT) AS is_total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def pitch_summary(spark, sf_dir):
    """Totals and a row for each score."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("score"), (F.col("o_orderkey") % 5).alias("predicted"), (F.col("o_custkey") % 5).alias("truth"), F.lit(0).alias("matches"), F.lit(0).alias("edits"))
    return reports.pitch_summary(rows, "score").select("score", "measures", "predicted", "truth", "capacity", "is_total")


@query("""WITH b AS (SELECT p_partkey, p_size AS w, p_size % 7 + 2 AS h, p_partkey % 60 AS a FROM part) SELECT p_partkey, a >= 8 AND w >= 3 AND h >= 3 AND w <= 35 AND w <= 24 AND h <= 22 AND w / h BETWEEN 0.3 AND 3.3 AND a / (w * h) >= 0.16 AS shaped FROM b""")
def head_shapes(spark, sf_dir):
    """Which components could be note heads on a staff of ten pixels a space."""
    w, h, a = F.col("p_size"), F.col("p_size") % 7 + 2, F.col("p_partkey") % 60
    return table(spark, sf_dir, "part").select("p_partkey", views.head_shaped(w, h, a, F.lit(100), F.lit(10.0)).alias("shaped"))


@query("""WITH x AS (SELECT c_custkey AS w, c_mktsegment AS m FROM customer), c AS (SELECT w, CASE WHEN w % 3 = 0 THEN 'supplied_musicxml' WHEN w % 3 = 1 THEN 'automatic_ocr' ELSE 'none' END AS s FROM x) SELECT s AS chord_source, count(*) AS works, CAST(sum(CASE WHEN s = 'none' THEN 0 WHEN s = 'supplied_musicxml' THEN 2 ELSE 1 END) AS BIGINT) AS chords FROM c GROUP BY 1""")
def chord_sources(spark, sf_dir):
    """Written chords where there are any, else those that were read."""
    works = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("w"))
    chord = lambda df, n: df.select("w", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("measure"), F.lit(None).cast("double").alias("onset_beats"), F.lit("C").alias("symbol"))
    chosen, sources = views.choose_chords(chord(works.where("w % 3 = 0"), 2), chord(works.where("w % 3 < 2"), 1), works, "w")
    counts = sources.join(chosen.groupBy("w").agg(F.count("*").alias("n")), "w", "left")
    return counts.groupBy("chord_source").agg(F.count("*").alias("works"), F.coalesce(F.sum("n"), F.lit(0)).alias("chords"))


@query("""WITH u AS (SELECT n_nationkey AS id, 1 AS m, 0 AS i FROM nation UNION ALL SELECT n_nationkey, 0, 1 FROM nation UNION ALL SELECT c_nationkey, 1, 0 FROM customer WHERE c_custkey <= 3), s AS (SELECT id, sum(m) AS m, sum(i) AS i FROM u GROUP BY id)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN i = 0 THEN 'unknown' WHEN m = 0 THEN 'missing' ELSE 'repeated' END AS problem FROM s WHERE NOT (i > 0 AND m = 1)""")
def mapping_problems(spark, sf_dir):
    """Where a mapping of nations isn't one to one: every nation once, and three customers' again."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.lit(0).alias("g"))
    again = table(spark, sf_dir, "customer").where("c_custkey <= 3").select(F.col("c_nationkey").alias("a"), F.lit(0).alias("g"))
    mapping = nations.unionByName(again).withColumn("b", F.col("a"))
    out = views.mapping_problems(mapping, nations, nations.withColumn("b", F.col("a")), "a", "b", ["g"])
    return out.where("side = 'a'").select("id", "problem")


@query(f"""WITH {_EV}, m AS (SELECT user_id, min(s // 86400) AS lo, max(s // 86400) AS hi FROM ev GROUP BY 1) SELECT user_id, unnest(range(lo, hi + 1)) AS d FROM m""")
def dense_days(spark, sf_dir):
    """Every day between a user's first and last."""
    rows = events(spark, sf_dir).select("user_id", F.floor(F.col("s") / 86400).alias("d"))
    return timeline.dense_measures(rows, ["user_id"], "d")


@query("""SELECT doc_id, round(sqrt(pow((n_chars % 50) / 10.0, 2) + pow((doc_id % 30) / 20.0, 2)), 6) AS distance, round(1 / (1 + exp(-((n_chars % 50) / 10.0 - 2))), 6) AS squashed, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'x' || doc_id END AS told FROM documents""")
def scalar_functions(spark, sf_dir):
    """Distances in radii, sigmoids, optional texts."""
    x = (F.col("n_chars") % 50).cast("double")
    told = F.when(F.col("doc_id") % 4 == 0, F.lit(" None ")).otherwise(F.concat(F.lit(" x"), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.ellipse_distance(x, (F.col("doc_id") % 30).cast("double"), F.lit(10.0), F.lit(20.0)), 6).alias("distance"), F.round(C.sigmoid(x / 10 - 2), 6).alias("squashed"), C.optional_text(told).alias("told"))


@query(f"""WITH RECURSIVE {_EV}, o AS (SELECT user_id AS u, CAST(t AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM (SELECT DISTINCT user_id, s // 600 AS t FROM ev)), g AS (SELECT u, k, t, t AS total, 1 AS n, 0 AS c FROM o WHERE k = 1 UNION ALL
SELECT o.u, o.k, o.t, CASE WHEN abs(o.t - round(total / n, 3)) <= 30 THEN total + o.t ELSE o.t END, CASE WHEN abs(o.t - round(total / n, 3)) <= 30 THEN n + 1 ELSE 1 END, CASE WHEN abs(o.t - round(total / n, 3)) <= 30 THEN c ELSE c + 1 END FROM g JOIN o ON o.u = g.u AND o.k = g.k + 1)
SELECT u AS user_id, CAST(c AS INT) AS cluster, CAST(min(t) AS BIGINT) AS first_t, count(*) AS n FROM g GROUP BY u, c""")
def mean_clusters(spark, sf_dir):
    """Times within five hours of the mean of their cluster so far."""
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set(F.floor(F.col("s") / 600).cast("double"))).alias("t"))
    flat = rows.select("user_id", F.posexplode(sequences.mean_clusters(F.col("t"), 30.0)).alias("cluster", "c"))
    return flat.select("user_id", "cluster", F.array_min("c.members").cast("long").alias("first_t"), F.size("c.members").cast("long").alias("n"))


@query(f"""WITH {_LABELLED} SELECT p.doc_id AS positive, n.doc_id AS negative, CAST(p.words - n.words AS DOUBLE) AS words FROM d p JOIN d n ON p.doc_id % 40 = n.doc_id % 40 WHERE p.quality = 1 AND n.quality = 0""")
def label_pairs(spark, sf_dir):
    """Each positive with each negative of its unit, as a difference of features."""
    rows = _labelled(spark, sf_dir).withColumn("unit", F.col("doc_id") % 40)
    return models.label_pairs(rows, ["unit"], "doc_id", "quality", ["words"]).select("positive", "negative", "words")


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey % 15 - 7 AS INT) AS f FROM part), s AS (SELECT *, CAST(floor((40 - y) / 5 + 0.5) AS INT) + 30 AS k FROM p), l AS (SELECT *, strpos('FCGDAEB', substring('CDEFGAB', k % 7 + 1, 1)) AS o FROM s)
SELECT p_partkey, (k // 7 + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][k % 7 + 1] + CASE WHEN f > 0 AND o <= f THEN 1 WHEN f < 0 AND 8 - o <= -f THEN -1 ELSE 0 END AS pitch FROM l""")
def staff_pitches(spark, sf_dir):
    """Heights on a staff as pitches in all key signatures."""
    lines = F.array(*(F.lit(float(y)) for y in (0, 10, 20, 30, 40)))
    return table(spark, sf_dir, "part").select("p_partkey", C.staff_pitch(F.col("p_size").cast("double"), lines, (F.col("p_partkey") % 15 - 7).cast("int")).alias("pitch"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS told FROM events""")
def iso_times(spark, sf_dir):
    """Times as ISO text."""
    return table(spark, sf_dir, "events").select("event_id", C.iso_time(F.col("ts")).alias("told"))


@query("""WITH n AS (SELECT o_orderkey AS bar, l_linenumber % 3 AS a, CAST(l_quantity AS BIGINT) AS b, l_partkey % 12 AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT bar, sha256('[' || string_agg('[' || a || ',' || b || ',' || c || ',0,0]', ',' ORDER BY a, b, c) || ']') AS fingerprint FROM n GROUP BY bar""")
def note_fingerprints(spark, sf_dir):
    """The hash of a bar's bag of notes."""
    bars = _bars(spark, sf_dir, False).where(F.size("notes") > 0)
    return bars.select("bar", C.events_hash(editions.note_keys(F.col("notes"))).alias("fingerprint"))
