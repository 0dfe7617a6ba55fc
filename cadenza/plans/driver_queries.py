"""Queries over the driver's tables, one for each family of operators, each with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import events as views
from ..operators import integrity, metrics, models, reports, selection, sequences, spatial, timeline
from ..sources import notation
from ..streaming.sessions import sessions
from .registry import _EV, ORACLES, QUERIES, cents, events, query, seconds, table  # noqa: F401

@query("""SELECT 'with_orders' AS side, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'without', CAST(count(*) AS BIGINT), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def work_filter_semi_anti(spark, sf_dir):
    """Requested keys by semi join, missing ones by anti join."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    found, missing = views.requested(orders, table(spark, sf_dir, "customer"), "c_custkey")
    sums = [df.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.sum("c_custkey").alias("ids")) for df, side in ((found.distinct(), "with_orders"), (missing, "without"))]
    return sums[0].unionByName(sums[1])


@query("SELECT p_partkey, coalesce(nullif(trim(p_type), ''), nullif(trim(p_name), ''), 'none') AS rhythm, nullif(trim(p_brand), '') AS composer FROM part")
def metadata_alias_coalesce(spark, sf_dir):
    """Aliased optional fields: blank is null, the first one that isn't null counts."""
    blank = lambda c: C.blank_to_null(F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(blank("p_type"), blank("p_name"), F.lit("none")).alias("rhythm"), blank("p_brand").alias("composer"))


_SLUG = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9\\s_/-]', '', 'g'), '[\\s_/-]+', '-', 'g'), '-'), ''), 'untitled')"


@query(f"SELECT 'p' AS kind, p_partkey AS id, {_SLUG.format('p_name')} AS slug FROM part UNION ALL SELECT 'c', c_custkey, {_SLUG.format('c_name')} FROM customer UNION ALL SELECT 'd', doc_id, {_SLUG.format('text')} FROM documents")
def slugify_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.lit("p").alias("kind"), F.col("p_partkey").alias("id"), C.slugify(F.col("p_name")).alias("slug"))
    names = parts.unionByName(table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), C.slugify(F.col("c_name")).alias("slug")))
    return names.unionByName(table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), C.slugify(F.col("text")).alias("slug")))


_SYMBOLS = ["C", "E minor", "BΔ7", "F♯m7", "B♭ maj7", "g-", "A°", "Cø", "D/f#", "Eb major/G", "C7b9", "GM7", "aug", "N.C.", "Am6", "D+", "CM9", "CM6", "Emin/x", "AM", "Bb7/d/f", "E♭ minor / b♭", "Gsus4/", "unknown"]
_SYMBOL_CANON = ["C", "Em", "Bmaj7", "F#m7", "Bbmaj7", "Gm", "Adim", "Cm7b5", "D/F#", "Eb/G", "C7b9", "Gmaj7", "Aug", "N.C.", "Am6", "Daug", "CM9", "Cm6", "Em/x", "A", "Bb7/d/f", "Ebm/Bb", "Gsus4/", "unknown"]


@query("SELECT l_orderkey % 24 AS k, [{}][l_orderkey % 24 + 1] AS symbol, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL".format(", ".join(f"'{x}'" for x in _SYMBOL_CANON)))
def symbol_normalize(spark, sf_dir):
    """Chord symbols in many spellings, in their usual form."""
    raw = F.element_at(F.array(*map(F.lit, _SYMBOLS)), (F.col("l_orderkey") % 24 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 24).alias("k"), C.chord_symbol(raw).alias("symbol")).agg(F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT user_id, s // 3600 AS hour, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(CAST(floor(value) AS BIGINT))), ' ') AS pitches, min(event_type) = max(event_type) AS agree FROM ev GROUP BY user_id, s // 3600")
def simultaneity_groups(spark, sf_dir):
    """Events of one user and hour as one group with sorted members."""
    rows = events(spark, sf_dir).withColumn("hour", F.floor(F.col("s") / 3600)).withColumn("v", F.floor("value"))
    out = timeline.simultaneities(rows, ["user_id"], "hour", "v", "event_type")
    return out.select("user_id", "hour", F.size("pitches").cast("long").alias("n"), F.array_join(F.transform("pitches", lambda x: x.cast("string")), " ").alias("pitches"), "agree")


_DAY = "CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"
_SPANS = f"iv AS (SELECT o_custkey, o_orderkey, {_DAY} AS s, {_DAY} + 20 + o_orderkey % 40 AS e FROM orders)"


def order_intervals(spark, sf_dir) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 20 + F.col("o_orderkey") % 40).alias("e"))


@query(f"WITH {_SPANS}, w AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv) SELECT o_custkey, o_orderkey FROM w WHERE s < b")
def overlap_validation(spark, sf_dir):
    return timeline.overlaps(order_intervals(spark, sf_dir), ["o_custkey"], "s", "e", ["s", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"""WITH {_SPANS}, w AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv)
SELECT o_custkey, CAST(b AS BIGINT) AS gap_start, s AS gap_end FROM w WHERE b < s""")
def rest_gaps(spark, sf_dir):
    return timeline.gaps(order_intervals(spark, sf_dir), ["o_custkey"], "s", "e")


_RUNS = f"""{_EV}, f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM f)"""


@query(f"WITH {_RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, CAST(count(*) AS BIGINT) AS n, min(s) AS s FROM r GROUP BY user_id, run")
def type_runs(spark, sf_dir):
    """Consecutive events of one type made one."""
    rows = timeline.runs(events(spark, sf_dir), ["user_id"], ["s", "event_id"], "event_type")
    return rows.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("s").alias("s"))


@query(f"""WITH {_EV}, t AS (SELECT user_id, s * 1000000 + event_id AS p, CAST(floor(value) AS BIGINT) AS d, event_type IN ('click', 'view') AS starts, event_type IN ('view', 'purchase') AS stops FROM ev),
w AS (SELECT *, last_value(CASE WHEN starts OR stops THEN starts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM t),
n AS (SELECT *, CASE WHEN stops AND coalesce(open, false) THEN 0 ELSE 1 END AS new FROM w), c AS (SELECT *, sum(CASE WHEN starts OR stops THEN new ELSE 0 END) OVER (PARTITION BY user_id ORDER BY p) AS chain FROM n)
SELECT user_id, min(p) AS "at", CAST(sum(d) AS BIGINT) AS duration FROM c GROUP BY user_id, CASE WHEN starts OR stops THEN chain END, CASE WHEN starts OR stops THEN NULL ELSE p END""")
def tie_fold(spark, sf_dir):
    """Tied notes made one: clicks begin a tie, views go on, purchases end one."""
    at, kind = F.col("s") * 1_000_000 + F.col("event_id"), F.col("event_type")
    notes = events(spark, sf_dir).select("user_id", at.alias("at"), F.floor("value").alias("duration"), kind.isin("click", "view").alias("starts"), kind.isin("view", "purchase").alias("stops"))
    return timeline.fold_ties(notes, ["user_id"], "at", "duration", "starts", "stops")


@query(f"""WITH {_EV}, f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) >= 21600 THEN 1 ELSE 0 END AS new FROM ev),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id) AS c FROM f)
SELECT user_id, CAST(c AS BIGINT) AS cluster, min(s) AS first_s, max(s) AS last_s, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, c""")
def single_link_clusters(spark, sf_dir):
    rows = timeline.clusters(events(spark, sf_dir), ["user_id"], F.col("s"), ["s", "event_id"], 21600, "cluster")
    return rows.groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"), F.count("*").alias("n"))


_DAILY = f"{_EV}, daily AS (SELECT user_id, s // 86400 AS d, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL)"


def daily(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("s") / 86400).alias("d")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DAILY}, a AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM daily WHERE n >= 2),
runs AS (SELECT user_id, min(d) AS a, max(d) AS b FROM a GROUP BY user_id, g HAVING max(d) - min(d) + 1 >= 2),
m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a) - 1 <= 1 THEN 0 ELSE 1 END AS new FROM runs),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a) AS x FROM m)
SELECT user_id, min(a) AS "start", max(b) AS "end" FROM k GROUP BY user_id, x""")
def active_spans(spark, sf_dir):
    return timeline.spans_above(daily(spark, sf_dir), ["user_id"], "d", F.col("n") >= 2, 2, 1)


@query(f"WITH {_DAILY} SELECT user_id, d, n, CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM daily")
def prefix_offsets(spark, sf_dir):
    return timeline.exclusive_prefix(daily(spark, sf_dir), ["user_id"], ["d"], "n", "before")


@query(f"WITH {_DAILY} SELECT user_id, d, CAST(round(avg(n) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) * 1000) AS BIGINT) AS mean_milli FROM daily")
def moving_average(spark, sf_dir):
    rows = timeline.moving_average(daily(spark, sf_dir), ["user_id"], ["d"], "n", 2, "mean")
    return rows.select("user_id", "d", F.round(F.col("mean") * 1000).cast("long").alias("mean_milli"))


@query(f"""WITH {_EV}, e AS (SELECT user_id, s, max(event_id) AS event_id FROM ev WHERE event_type = 'error' GROUP BY ALL)
SELECT p.event_id, coalesce(e.event_id, -1) AS state FROM (SELECT * FROM ev WHERE event_type = 'purchase') p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.s >= e.s""")
def asof_lookup(spark, sf_dir):
    """The state in force at each probe: the latest error at or before a purchase."""
    rows = events(spark, sf_dir)
    states = rows.where("event_type = 'error'").groupBy("user_id", "s").agg(F.max("event_id").alias("state"))
    probes = rows.where("event_type = 'purchase'").select("event_id", "user_id", "s")
    return timeline.as_of(probes, states, ["user_id"], "s", "state", F.lit(-1)).select("event_id", "state")


_EDGES = [1000.0, 5000.0, 20000.0, 45000.0, 70000.0]


@query("SELECT CASE " + " ".join(f"WHEN l_extendedprice < {e} THEN {k + 1}" for k, e in enumerate(_EDGES)) + f" ELSE {len(_EDGES)} END AS bin, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1")
def range_bin(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(timeline.bin_of(F.col("l_extendedprice"), _EDGES).alias("bin")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


_KEYS = "p AS (SELECT {0}, CAST(l_orderkey % 7 = 0 AS INT) AS shift FROM lineitem), t AS (SELECT {0}, CAST(l_orderkey % 5 = 0 AS INT) AS shift FROM lineitem)"


def _sides(spark, sf_dir):
    """All rows twice, some with another key on one side (column shift)."""
    rows = table(spark, sf_dir, "lineitem")
    return tuple(rows.withColumn("shift", (F.col("l_orderkey") % n == 0).cast("int")) for n in (7, 5))


@query(f"""WITH {_KEYS.format("l_orderkey, l_linenumber")}, dp AS (SELECT DISTINCT * FROM p), dt AS (SELECT DISTINCT * FROM t),
c AS (SELECT (SELECT count(*) FROM p) AS pred_rows, (SELECT count(*) FROM t) AS truth_rows, (SELECT count(*) FROM (SELECT * FROM dp INTERSECT SELECT * FROM dt)) AS tp, (SELECT count(*) FROM (SELECT * FROM dp EXCEPT SELECT * FROM dt)) AS fp, (SELECT count(*) FROM (SELECT * FROM dt EXCEPT SELECT * FROM dp)) AS fn)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def set_f1(spark, sf_dir):
    return metrics.set_agreement(*_sides(spark, sf_dir), ["l_orderkey", "l_linenumber", "shift"])


@query(f"""WITH {_KEYS.format("l_partkey % 50 AS a, l_suppkey % 3 AS b")}, pc AS (SELECT a, b, shift, count(*) AS n FROM p GROUP BY ALL), tc AS (SELECT a, b, shift, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT CAST((SELECT sum(least(pc.n, tc.n)) FROM pc JOIN tc USING (a, b, shift)) AS BIGINT) AS matched, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM t) AS expected) SELECT *, round(2 * matched / (predicted + expected), 9) AS f1 FROM c""")
def multiset_f1(spark, sf_dir):
    """Repeats kept: the lesser of both counts of each key."""
    sides = [x.select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 3).alias("b"), "shift") for x in _sides(spark, sf_dir)]
    return metrics.multiset_agreement(*sides, ["a", "b", "shift"]).withColumn("f1", F.round("f1", 9))


@query("""SELECT count(*) AS works, count(o.k) AS with_orders, count(l.k) AS with_lines FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c_custkey = o.k
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey) l ON c_custkey = l.k""")
def coverage_report(spark, sf_dir):
    """How many works each stage still has. Lines reduce to order keys before the join."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    deep = orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return reports.drop_out(table(spark, sf_dir, "customer"), [("with_orders", orders), ("with_lines", deep)], "c_custkey")


@query(f"""WITH {_KEYS.format("l_partkey AS a")}, pc AS (SELECT a, shift, count(*) AS p FROM p GROUP BY ALL), tc AS (SELECT a, shift, count(*) AS t FROM t GROUP BY ALL), b AS (SELECT coalesce(p, 0) AS p, coalesce(t, 0) AS t FROM pc FULL JOIN tc USING (a, shift))
SELECT CAST(sum(least(p, t)) AS BIGINT) AS capacity, CAST(sum(greatest(p - t, 0)) AS BIGINT) AS surplus, CAST(sum(greatest(t - p, 0)) AS BIGINT) AS deficit FROM b""")
def count_capacity(spark, sf_dir):
    return metrics.count_capacity(*_sides(spark, sf_dir), ["l_partkey", "shift"])


@query(f"""WITH {_EV}, w AS (SELECT user_id, avg(s % 1000) FILTER (event_type = 'click') AS a, avg(s % 1000) FILTER (event_type = 'view') AS b FROM ev GROUP BY user_id)
SELECT user_id, round(b - a, 6) AS delta FROM w WHERE a IS NOT NULL AND b IS NOT NULL""")
def paired_deltas(spark, sf_dir):
    return metrics.paired_delta(events(spark, sf_dir), "user_id", "event_type", F.col("s") % 1000, "click", "view").select("user_id", F.round("delta", 6).alias("delta"))


@query(f"""WITH {_EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s, event_id) AS k FROM ev WHERE event_type IN ('click', 'view'))
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, a.event_id AS click_id, b.event_id AS view_id FROM (SELECT * FROM n WHERE event_type = 'click') a FULL JOIN (SELECT * FROM n WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.k = b.k""")
def ordered_zip(spark, sf_dir):
    """The n-th click with the n-th view."""
    rows = events(spark, sf_dir)
    pairs = reports.ordered_zip(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), ["user_id"], ["s", "event_id"], "event_id")
    return pairs.select("user_id", F.col("place").alias("k"), F.col("left").alias("click_id"), F.col("right").alias("view_id"))


@query("""WITH s AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b, count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders) SELECT n, d AS distinct_keys, b - a + 1 - d AS missing, n - d AS repeated FROM s""")
def bijection_check(spark, sf_dir):
    """Whether keys cover their range exactly once: how many are missing or repeated."""
    return reports.key_cover(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY text")
def dedupe_first(spark, sf_dir):
    """The first of each group of equal texts."""
    return reports.first_of_copies(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT doc_id, substring(sha256(text || chr(31) || lang || chr(31) || source), 1, 16) AS content_key FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.content_key(F.col("text"), F.col("lang"), F.col("source")).alias("content_key"))


_CODED = f"{_EV}, u AS (SELECT user_id, string_agg(substring(event_type, 1, 1), '' ORDER BY s, event_id) AS w FROM ev GROUP BY user_id)"


@query(f"WITH {_CODED}, p AS (SELECT user_id, w, lag(w) OVER (ORDER BY user_id) AS v FROM u) SELECT user_id, levenshtein(w, v) AS distance FROM p WHERE v IS NOT NULL")
def token_edit_distance(spark, sf_dir):
    """Edit distance of each user's events, as tokens, from those of the user before. Users are numbered by ranges, and meet by number."""
    words = sequences.gathered(events(spark, sf_dir).select("user_id", "s", "event_id", F.substring("event_type", 1, 1).alias("c")), ["user_id"], ["s", "event_id"])
    words = words.select("user_id", F.transform("items", lambda x: x["c"]).alias("w"))
    placed = selection.running_total(words.select("user_id", F.lit(1).cast("long").alias("one")), [], "user_id", ["one"])
    numbered = words.join(placed.select("user_id", F.col("one_total").alias("k")), "user_id")  # numbers fall as users rise
    pairs = numbered.join(numbered.select((F.col("k") - 1).alias("k"), F.col("w").alias("v")), "k")
    return sequences.edits(pairs.select("user_id", "w", "v"), "w", "v").select("user_id", sequences.edit_counts()[4].alias("distance"))


@query("""WITH d AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT CAST(n_chars AS DOUBLE) AS threshold, sum(quality) AS pos, count(*) AS n FROM d GROUP BY n_chars UNION ALL SELECT max(n_chars) + 1e-9, 0, 0 FROM d),
w AS (SELECT threshold, CAST(sum(pos) OVER o AS BIGINT) AS tp, CAST(sum(n) OVER o - sum(pos) OVER o AS BIGINT) AS fp, CAST(sum(pos) OVER () - sum(pos) OVER o AS BIGINT) AS fn, CAST(sum(n) OVER o AS BIGINT) AS kept FROM c WINDOW o AS (ORDER BY threshold DESC))
SELECT threshold, tp, fp, fn, kept, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM w""")
def threshold_sweep(spark, sf_dir):
    """Length as a score of quality, at every threshold and above all of them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return selection.label_sweep(rows, "n_chars", "quality")


@query(ORACLES["threshold_sweep"] + " ORDER BY f1 DESC, precision DESC, recall DESC, kept, threshold DESC LIMIT 1")
def best_threshold(spark, sf_dir):
    """The threshold that ranks first by F1, precision, recall, fewer kept, higher threshold."""
    return selection.best(threshold_sweep(spark, sf_dir))


@query("""WITH g AS (SELECT c_nationkey, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS s, count(*) AS n FROM customer GROUP BY 1)
SELECT c_nationkey, n, CAST(sum(n) OVER () - n AS BIGINT) AS n_others, CAST(round((sum(s) OVER () - s) / (sum(n) OVER () - n), 4) AS DOUBLE) AS mean_others FROM g""")
def logo_cv_means(spark, sf_dir):
    rows = metrics.leave_one_out_mean(table(spark, sf_dir, "customer"), "c_nationkey", cents("c_acctbal"))
    return rows.withColumn("mean_others", F.round("mean_others", 4))


@query("""WITH d AS (SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
m AS (SELECT avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality = 0) AS m0, (var_pop(n_chars) FILTER (quality = 1) * count(*) FILTER (quality = 1) + var_pop(n_chars) FILTER (quality = 0) * count(*) FILTER (quality = 0)) / (count(*) - 2) + 0.5 AS v FROM d)
SELECT doc_id, round((m1 - m0) / v * (n_chars - (m0 + m1) / 2), 6) AS score FROM d, m""")
def diag_lda(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return models.diagonal_discriminant(rows, "quality", ["n_chars"]).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_EV}, pairs AS (SELECT c.user_id, c.event_id AS l, p.event_id AS r, abs(c.s - p.s) AS d FROM ev c JOIN ev p ON c.user_id = p.user_id WHERE c.event_type = 'click' AND p.event_type = 'purchase' AND abs(c.s - p.s) <= 86400),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, l, r) AS k FROM pairs),
g AS (SELECT user_id, k, l, r, d, true AS keep, [l] AS ul, [r] AS ur FROM o WHERE k = 1 UNION ALL
SELECT o.user_id, o.k, o.l, o.r, o.d, NOT list_contains(ul, o.l) AND NOT list_contains(ur, o.r), CASE WHEN list_contains(ul, o.l) OR list_contains(ur, o.r) THEN ul ELSE list_append(ul, o.l) END, CASE WHEN list_contains(ul, o.l) OR list_contains(ur, o.r) THEN ur ELSE list_append(ur, o.r) END
FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1) SELECT user_id, l AS left_key, r AS right_key, CAST(d AS DOUBLE) AS distance FROM g WHERE keep""")
def greedy_match(spark, sf_dir):
    """Clicks and purchases of a user paired by time, the closest free pair first."""
    rows = events(spark, sf_dir)
    return spatial.match(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ["user_id"], "event_id", ["s"], 86400)


@query(f"""WITH RECURSIVE {_EV}, o AS (SELECT user_id, event_id, s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM ev),
k AS (SELECT user_id, r, event_id, true AS keep, [s] AS kept FROM o WHERE r = 1 UNION ALL
SELECT o.user_id, o.r, o.event_id, list_min([abs(x - o.s) FOR x IN k.kept]) >= 86400, CASE WHEN list_min([abs(x - o.s) FOR x IN k.kept]) >= 86400 THEN list_append(k.kept, o.s) ELSE k.kept END FROM k JOIN o ON o.user_id = k.user_id AND o.r = k.r + 1)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY r) AS INT) AS place FROM k WHERE keep""")
def nms_topk(spark, sf_dir):
    """Events of a user by value, none within a day of a better one."""
    return spatial.suppress(events(spark, sf_dir), ["user_id"], "event_id", ["s"], "value", 86400)


@query("""WITH q AS (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), m AS (SELECT min(q) AS mode FROM (SELECT q, count(*) AS n FROM q GROUP BY q QUALIFY n = max(n) OVER ()))
SELECT l_orderkey, q AS total, q = mode AS valid, q - mode AS excess FROM q, m""")
def meter_check(spark, sf_dir):
    """Each measure's sum against the usual one: the most frequent sum, the least if tied."""
    return reports.usual_total(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity"))


@query("""SELECT r_name, n_name, c_mktsegment, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def hierarchy_rollup(spark, sf_dir):
    """Totals by region, nation and segment. Customers are summed by nation before the join."""
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"), F.sum(cents("c_acctbal")).alias("cents"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sums.join(nations, "n_nationkey").rollup("r_name", "n_name", "c_mktsegment").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


@query("""SELECT o_custkey, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent,
CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) <= 100000000 AS within FROM orders""")
def decimal_ledger(spark, sf_dir):
    """Exact running charges against a budget."""
    rows = reports.running_budget(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], cents("o_totalprice"), 100_000_000)
    return rows.select("o_custkey", "o_orderkey", "spent", "within")


@query("SELECT s_suppkey, CAST(10000 // (SELECT count(*) FROM supplier) + CASE WHEN row_number() OVER (ORDER BY s_suppkey) <= 10000 % (SELECT count(*) FROM supplier) THEN 1 ELSE 0 END AS BIGINT) AS share FROM supplier")
def fair_share_split(spark, sf_dir):
    """10,000 cents in equal shares; the first ones take what is left over."""
    return reports.fair_shares(table(spark, sf_dir, "supplier"), "s_suppkey", 10_000)


@query(f"WITH {_SPANS}, m AS (SELECT unnest(range(0, 14000, 91)) AS t) SELECT t, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM m JOIN iv ON s <= t AND t < e GROUP BY t")
def interval_stab(spark, sf_dir):
    """Intervals open at given points."""
    points = spark.range(0, 14000, 91).select(F.col("id").alias("t"))
    hit = timeline.stab(points, order_intervals(spark, sf_dir), "t", "s", "e", cell=91)
    return hit.groupBy("t").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"""WITH {_EV}, sec AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY 1), r AS (SELECT unnest(['c', 'v', 'c', 'p', 's', 'e', 'v']) AS l, unnest(range(7)) AS place)
SELECT CAST(place AS INT) AS place, l AS section, n AS length, CAST(coalesce(sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM r JOIN sec ON l = substring(event_type, 1, 1)""")
def route_expand(spark, sf_dir):
    sections = events(spark, sf_dir).groupBy(F.substring("event_type", 1, 1).alias("section")).agg(F.count("*").alias("length"))
    return timeline.expand_route(sections, "cvcpsev", "section", "length").select("place", "section", "length", "start")


@query(f"""WITH {_RUNS}, x AS (SELECT *, s // 86400 AS d FROM r), g AS (SELECT user_id, run, d, min(event_type) AS event_type, min(s) AS s FROM x GROUP BY user_id, run, d)
SELECT user_id, event_type, s, least(coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, run), (d + 1) * 86400), (d + 1) * 86400) AS e FROM g""")
def span_until_change(spark, sf_dir):
    """Spans of one type, to the next change or the end of the day."""
    return timeline.state_spans(events(spark, sf_dir), ["user_id"], ["s", "event_id"], "s", "event_type", 86400).select("user_id", "event_type", "s", "e")


@query("SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n, CAST(grouping(s_nationkey) AS INT) AS is_total FROM supplier GROUP BY GROUPING SETS ((s_nationkey), ())")
def grouping_summary(spark, sf_dir):
    return table(spark, sf_dir, "supplier").rollup("s_nationkey").agg(F.count("*").alias("n"), F.grouping("s_nationkey").cast("int").alias("is_total"))


@query("""WITH a AS (SELECT o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1000000000 ELSE 0 END AS k, o_orderstatus AS v FROM orders), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 17 = 0 THEN 1000000000 ELSE 0 END AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders)
SELECT CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state, CAST(count(*) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS keys FROM a FULL JOIN b USING (k) GROUP BY 1""")
def lane_diff(spark, sf_dir):
    """Two versions of a table: what was added, removed or changed."""
    key = lambda n: (F.col("o_orderkey") + F.when(F.col("o_orderkey") % n == 0, 1_000_000_000).otherwise(0)).alias("k")
    orders = table(spark, sf_dir, "orders")
    a = orders.select(key(11), F.col("o_orderstatus").alias("v"))
    b = orders.select(key(17), F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return reports.lane_diff(a, b, ["k"], "v").groupBy("state").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


@query(f"""WITH {_EV}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS c FROM f) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts) + INTERVAL 6 HOUR) AS BIGINT) AS end_us, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, c""")
def session_stream(spark, sf_dir):
    """Sessions, by the operator that also runs on streams."""
    return sessions(table(spark, sf_dir, "events")).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""WITH l AS (SELECT l_orderkey, l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_returnflag, sum(n) AS s, count(*) AS k, max(n) AS m FROM l GROUP BY 1)
SELECT l_returnflag, CAST(s AS BIGINT) AS total, CAST(k AS BIGINT) AS groups, m AS most, rank() OVER (ORDER BY s DESC) AS leader FROM t""")
def model_summary(spark, sf_dir):
    """Totals, coverage and tie-aware rank of each arm."""
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    sums = each.groupBy("l_returnflag").agg(F.sum("n").alias("total"), F.count("*").alias("groups"), F.max("n").alias("most"))
    return sums.withColumn("leader", F.rank().over(W.orderBy(F.desc("total"))).cast("long"))


@query("SELECT p_brand, count(p_size) AS n, count(p_size) - count(DISTINCT p_size) AS repeats, max(p_size) - min(p_size) + 1 - count(DISTINCT p_size) AS missing FROM part GROUP BY p_brand HAVING count(p_size) > count(DISTINCT p_size) OR max(p_size) - min(p_size) + 1 > count(DISTINCT p_size)")
def catalog_cover(spark, sf_dir):
    """Brands whose sizes repeat or leave gaps, as a catalog's pages would."""
    return integrity.catalog_problems(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("""WITH r AS (SELECT p_partkey, p_size * 24 // gcd(p_size * 24, 384) AS a, 384 // gcd(p_size * 24, 384) AS b FROM part)
SELECT p_partkey, CASE WHEN a = 1 AND b = 1 THEN '' WHEN a = 1 THEN '/' || b WHEN b = 1 THEN a::VARCHAR ELSE a || '/' || b END AS length FROM r""")
def note_lengths(spark, sf_dir):
    """Sizes as sixteenths of a beat, written as ABC lengths."""
    return table(spark, sf_dir, "part").select("p_partkey", notation.duration_text((F.col("p_size") * 24).cast("long")).alias("length"))
