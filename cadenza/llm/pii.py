"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used. A pattern's matches come from regexp_extract_all, their places
from the lengths of what split() leaves between them; both run the same engine, so they agree.
Places are prefix sums, taken in chunks of `CHUNK` and over the chunks, and contexts are put together
from the matches and gaps nearby, so the time of a text with many findings grows little more than
in proportion to its length. Intermediate arrays are bound to lambda variables, as an expression
that stands in a lambda would be evaluated for each element.
Patterns are written so that Java's engine neither recurses nor rescans on long runs: possessive
repeats, and starts only where a run begins or the match before ended (\\G), which changes no match.

Kinds: email, ip (each part at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits),
iban (15 to 34 characters, mod 97). Scores are percent: what pattern and checksum alone give,
more if a word of the kind stands within 40 characters before or 20 after, less for a contrary one.

Defined results: null is the empty text and has no finding. Offsets are code points, ends
exclusive. Failing matches are dropped without another try. Repeated rows give repeated results,
an empty table none; texts of any length are read whole. Findings stand by kind, then place, and no two
of a kind start at the same place, so there are no ties. Only key and text are read, so other
columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER, NEAR, CHUNK = 40, 20, 25, 128

#: What the rules match.
PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b",
}


@dataclass(frozen=True)
class Kind:
    """java: the pattern for Java's engine; hint: a cheap test that every text with a match passes; score and words of the context."""

    name: str
    java: str
    hint: str
    score: int
    words: str
    against: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 90, "mail|contact|write", "example"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]", 60, "ip|address|host|server", "version|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", 80, "card|visa|credit|payment", "order|invoice|isbn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 70, "phone|call|tel|mobile|fax", "score|version"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 95, "iban|account|bank|transfer", "order|serial"),
)

FINDINGS = "array<struct<kind:string,start:int,end:int,value:string,score:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, start: Column) -> Column:
    """What comes before each value, summed up from `start`."""
    zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda s, x: F.struct((s.at + x).alias("at"), F.concat(s.out, F.array(s.at)).alias("out")), lambda s: s.out)


def running(values: Column) -> Column:
    """The sum of the values before each value of an array of ints that isn't empty."""

    def chunked(x: Column) -> Column:
        heads = F.sequence(F.lit(1), F.size(x), F.lit(CHUNK))
        sums = F.transform(heads, lambda h: F.aggregate(F.slice(x, h, F.lit(CHUNK)), F.lit(0), lambda a, b: a + b))
        return _let(_running(sums, F.lit(0)), lambda starts: F.flatten(F.transform(starts, lambda at, k: _running(F.slice(x, k * CHUNK + 1, F.lit(CHUNK)), at))))

    return _let(values, chunked)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def step(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, F.lit(1), F.lit(4)))

    def step(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(value, " ", "")
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    return F.lit(True)


def _near(kind: Kind, before: Column, after: Column) -> Column:
    """The score of a finding with this text before and after it."""
    near = lambda words: F.when(before.rlike(words) | after.rlike(words), NEAR).otherwise(0)
    score = kind.score + near(kind.words) - near(kind.against)
    return F.greatest(F.least(score, F.lit(100)), F.lit(0))


def _found(text: Column, kind: Kind) -> Column:
    """The confirmed findings of a kind. Pieces: the text as gap, match, gap, ..., gap."""

    def with_pieces(values: Column, gaps: Column) -> Column:
        pieces = F.flatten(F.transform(gaps, lambda g, k: F.when(k < F.size(values), F.array(g, F.get(values, k))).otherwise(F.array(g))))
        valid = F.filter(F.transform(values, lambda v, k: F.struct(k.alias("k"), v.alias("v"))), lambda x: _valid(kind.name, x.v))

        def told(p: Column) -> Column:
            # a match has two characters at least, so no more than BEFORE pieces lie within BEFORE characters
            tails = F.transform(p, lambda x: F.substring(x, -BEFORE, BEFORE))
            heads = F.transform(p, lambda x: F.substring(x, 1, AFTER))
            return _let(running(F.transform(p, lambda x: F.length(x))), lambda at: _let(tails, lambda t: _let(heads, lambda h: F.transform(valid, lambda x: one(x, at, t, h)))))

        def one(x: Column, at: Column, tails: Column, heads: Column) -> Column:
            here, start = x.k * 2 + 1, F.get(at, x.k * 2 + 1)
            first = F.greatest(here - BEFORE, F.lit(0))
            before = F.lower(F.substring(F.array_join(F.slice(tails, first + 1, here - first), ""), -BEFORE, BEFORE))
            after = F.lower(F.substring(F.array_join(F.slice(heads, here + 2, F.lit(AFTER + 1)), ""), 1, AFTER))
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x.v)).alias("end"), x.v.alias("value"), _near(kind, before, after).alias("score"))

        return _let(pieces, told)

    found = _let(F.regexp_extract_all(text, F.lit(kind.java), F.lit(0)), lambda v: F.when(F.size(v) > 0, _let(F.split(text, kind.java, -1), lambda g: with_pieces(v, g))))
    return F.coalesce(F.when(text.rlike(kind.hint), found), F.array().cast(FINDINGS)).cast(FINDINGS)


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key and findings (kind, start, end, value, score in percent), by kind, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), _let(t, lambda x: F.concat(*(_found(x, k) for k in KINDS))).alias("findings"))


def _is(name: str):
    return lambda kind: kind == name


def digest(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts by base kind, base_sha256 over the four base kinds, all spans, the count of account numbers, and all scores."""
    names = [k.name for k in KINDS]
    span = lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))
    f = F.col("findings")
    kinds = F.transform(f, lambda x: x.kind)
    *counts, more = [F.size(F.filter(kinds, _is(n))).cast("long").alias(f"n_{n}") for n in names]
    base = F.array_join(F.transform(F.filter(f, lambda x: x.kind != "iban"), span), ",")
    return found.select(F.col(key), *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform(f, span), ",").alias("spans"), more, F.array_join(F.transform(f, lambda x: x.score.cast("string")), ",").alias("scores"))


def _oracle() -> str:
    """The same in DuckDB SQL, with the patterns as they stand in PATTERN."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    every = " UNION ALL ".join(f"SELECT rid, t, {n} AS k, regexp_extract_all(t, {quote(PATTERN[k.name])}) AS ms, string_split_regex(t, {quote(PATTERN[k.name])}) AS gs FROM d" for n, k in enumerate(KINDS))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum([CASE WHEN (len({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INT) ELSE CAST({digits}[i] AS INT) * 2 - 9 * CAST(CAST({digits}[i] AS INT) > 4 AS INT) END for i in range(1, len({digits}) + 1)]) % 10 = 0"
    bare = "replace(v, ' ', '')"
    spelled = f"array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END for c in string_split({bare}[5:] || {bare}[:4], '')], '')"
    rest = f"list_reduce(list_prepend(0, [CAST(c AS INT) for c in string_split({spelled}, '')]), lambda a, b: (a * 10 + b) % 97)"
    near = lambda words: f"CASE WHEN regexp_matches(b, '{words}') OR regexp_matches(a, '{words}') THEN {NEAR} ELSE 0 END"
    score = "CASE k " + " ".join(f"WHEN {n} THEN {k.score} + {near(k.words)} - {near(k.against)}" for n, k in enumerate(KINDS)) + " END"
    names = "CASE k " + " ".join(f"WHEN {n} THEN '{k.name}'" for n, k in enumerate(KINDS)) + " END"
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{k.name}" for n, k in enumerate(KINDS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
every AS ({every}),
each AS (SELECT rid, t, k, i, ms[i] AS v, gs[i] AS g, coalesce(ms[i - 1], '') AS w FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM every)),
placed AS (SELECT *, CAST(sum(length(g) + length(w)) OVER (PARTITION BY rid, k ORDER BY i) AS BIGINT) AS s FROM each),
valid AS (SELECT *, s + length(v) AS e, lower(substring(t, greatest(s - {BEFORE}, 0) + 1, least(s, {BEFORE}))) AS b, lower(substring(t, s + length(v) + 1, {AFTER})) AS a
  FROM placed WHERE CASE k WHEN 1 THEN list_bool_and([length(ltrim(p, '0')) <= 3 AND CAST(right('000' || p, 3) AS INT) <= 255 for p in string_split(v, '.')])
    WHEN 2 THEN length({digits}) BETWEEN 13 AND 19 AND {luhn_sql} WHEN 3 THEN length({digits}) BETWEEN 9 AND 15
    WHEN 4 THEN length({bare}) BETWEEN 15 AND 34 AND {rest} = 1 ELSE true END),
told AS (SELECT rid, k, s, {names} || ':' || s || ':' || e AS x, greatest(least({score}, 100), 0) AS c FROM valid),
summed AS (SELECT rid, {counts}, string_agg(x, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(x, ',' ORDER BY k, s) AS spans, string_agg(CAST(c AS VARCHAR), ',' ORDER BY k, s) AS scores FROM told GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN summed USING (rid)"""


ORACLE = _oracle()
