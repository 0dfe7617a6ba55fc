"""Column functions, sequential rules and sources on small hand-made inputs."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pytest
from cadenza.functions import columns as C
from cadenza.operators import timeline
from cadenza.sources import scores
from pyspark.sql import functions as F


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_columns(spark):
    text = F.lit
    assert one(spark, C.slugify(text("  Años_de Él/Sol! ")), C.slugify(text("!!")), C.chord_symbol(text("E minor")), C.chord_symbol(text(None).cast("string")), C.chord_symbol(text("BM7/f#")), C.chord_symbol(text("C7b9"))) == ["anos-de-el-sol", "untitled", "Em", "", "Bmaj7/F#", "C7b9"]
    assert one(spark, C.pitch_to_midi(text("C"), text(4), text(1)), C.key_alteration(text("F"), text(1)), C.key_alteration(text("B"), text(-1)), C.key_alteration(text("C"), text(1))) == [61, 1, -1, 0]
    assert one(spark, C.midi_to_abc(text(60)), C.midi_to_abc(text(72)), C.midi_to_abc(text(84)), C.midi_to_abc(text(48))) == ["C", "c", "c'", "C,"]
    assert one(spark, C.chord_pitches(text("Am7/G")), C.chord_pitches(text("N.C.")), C.chord_pitches(text("Cweird"))) == [[43, 57, 60, 64, 67], [], []]
    assert one(spark, C.meter_ticks(text("3/4")), C.meter_ticks(text("C")), C.meter_ticks(text("6/8")), C.meter_ticks(text("x"))) == [1152, 1536, 1152, None]
    assert one(spark, C.ticks(text(0.5)), C.ticks(text(0.3333)), C.unit_interval(text("7")), C.unit_interval(text("x")), C.clock(text(125)), C.optional_text(text(" None "))) == [192, None, 1.0, 0.0, "2:05", None]
    assert one(spark, C.safe_ratio(text(1), text(0)), C.safe_ratio(text(1), text(0), None), C.safe_ratio(text(1), text(4))) == [0.0, None, 0.25]


def test_slugs_equal_their_definition(spark):
    """The rule written out: decompose, keep ASCII letters and digits, one hyphen for each run of separators."""

    def brute(text):
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
        out = []
        for c in plain:
            if c.isalnum():
                out.append(c)
            elif (c.isspace() or c in "-_/") and out and out[-1] != "-":
                out.append("-")
        return "".join(out).strip("-") or "untitled"

    texts = ["Ő Łódź ā", "½ ﬁne Ⅳ 𝐀bc ①", "  a--b__c/d  ", "ñandú—x", "", "日本", "a\x1cb\u00a0c", "Çédille ßtraße", "ÅngströM/Ωhm", "_-/", "e\u0301x"]
    texts += [f"x{chr(c)}y{chr(c)}" for c in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60)]]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", C.slugify(F.col("t")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: brute(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("raw", "usual"), [("CM9", "CM9"), ("CM6", "Cm6"), ("CM7", "Cmaj7"), ("CM", "C"), ("Emin/x", "Em/x"), ("E min / g#", "Em/G#"), ("BΔ7", "Bmaj7"), ("BΔ", "Bmaj7"), ("Bø", "Bm7b5"), ("hello", "hello"), ("Am/", "Am/"), ("Bb7/D/F", "Bb7/D/F"), ("f♯-", "F#m"), ("G–7", "G-7"), ("", ""), ("  ", ""), ("Dsus2", "Dsus2"), ("aMAJ7", "Amaj7"), ("A##m", "A##m")])
def test_chord_symbols(spark, raw, usual):
    assert one(spark, C.chord_symbol(F.lit(raw))) == [usual]


def test_harmonies(spark):
    null = F.lit(None).cast("string")
    call = lambda step, alter, text, kind, bass=None: C.harmony_symbol(F.lit(step), F.lit(alter), F.lit(text).cast("string"), F.lit(kind), F.lit(bass).cast("string"), F.lit(-1))
    assert one(spark, call("D", 0, "", "minor"), call("C", None, None, "major-seventh"), call("F", 1, "7", "dominant"), call("B", -1, " ", "major", "E"), call("H", 0, None, "major"), call("A", 0, None, None), null) == ["Dm", "Cmajor-seventh", "F#7", "Bb/Eb", None, None, None]


def test_staff_and_keys(spark):
    lines = F.array(*(F.lit(float(y)) for y in (0, 10, 20, 30, 40)))
    at = lambda y, k=0: C.staff_pitch(F.lit(float(y)), lines, F.lit(k))
    assert one(spark, at(40), at(35), at(0), at(0, 1), at(20, -1), at(45), C.staff_pitch(F.lit(-5.0), lines)) == [64, 65, 77, 78, 70, 62, 79]
    assert one(spark, C.key_map(F.lit(2)), C.key_map(F.lit(-3)), C.key_map(F.lit(0)), C.key_map(F.lit(8))) == [{"F": 1, "C": 1}, {"B": -1, "E": -1, "A": -1}, {}, None]


def test_hashes(spark):
    value = F.struct(F.lit(1).alias("a"), F.lit('é😀"\\x/').alias("b"), F.array(F.lit(2), F.lit(1)).alias("c"))
    expected = json.dumps({"a": 1, "b": 'é😀"\\x/', "c": [2, 1]}, sort_keys=True, separators=(",", ":"))
    assert one(spark, C.canonical_hash(value)) == [hashlib.sha256(expected.encode()).hexdigest()]
    bag = F.array(*(F.array(*map(F.lit, x)) for x in ((3, 1), (0, 2), (0, 2))))
    assert one(spark, C.events_hash(bag)) == [hashlib.sha256(b"[[0,2],[0,2],[3,1]]").hexdigest()]
    a, b = F.array(*map(F.lit, "aabc")), F.array(*map(F.lit, "abbd"))
    assert one(spark, C.common_count(a, b), C.same_bag(a, F.reverse(a)), C.same_bag(a, b), C.common_count(a, F.lit(None).cast("array<string>"))) == [2, True, False, 0]


def test_shift_tolerant_jaccard(spark):
    square = [0, 0b0110, 0b0110, 0]
    rows = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    moved, other, blank = [0b0110 << 1, 0b0110 << 1, 0, 0], [0b1111, 0b1111, 0b1111, 0b1111], [0, 0, 0, 0]
    assert one(spark, C.shift_jaccard(rows(square), rows(moved), 6), C.shift_jaccard(rows(square), rows(other), 6, 0, 0), C.shift_jaccard(rows(blank), rows(blank), 6), C.shift_jaccard(rows(square), rows(blank), 6)) == [1.0, 0.25, 1.0, 0.0]


def test_times_and_labels(spark):
    a, b = F.lit("2024-01-02 03:04:05.25").cast("timestamp"), F.lit("2024-01-02 03:04:05").cast("timestamp")
    assert one(spark, C.iso_time(a), C.iso_time(b), C.elapsed_seconds(b, a), C.elapsed_seconds(a, b)) == ["2024-01-02T03:04:05.250000Z", "2024-01-02T03:04:05Z", 0.25, 0.0]
    assert one(spark, C.without_labels(F.lit('"Am"A2 "x"B|')), C.plain_accidentals(F.lit(" B♭m/F♯ "))) == ["A2 B|", "Bbm/F#"]


def test_timeline(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 3, 7), (1, 9, 10), (1, 10, 12)], "g int, s int, e int")
    assert sorted(map(tuple, timeline.merged_intervals(rows, ["g"], "s", "e").collect())) == [(1, 0, 7), (1, 9, 12)]
    assert [tuple(r) for r in timeline.gaps(rows, ["g"], "s", "e").collect()] == [(1, 7, 9)]
    notes = spark.createDataFrame([(60, 0, 1.0, True, False), (60, 1, 1.0, False, True), (60, 2, 1.0, False, True)], "p int, at int, d double, starts boolean, stops boolean")
    assert sorted(tuple(r) for r in timeline.fold_ties(notes, ["p"], "at", "d", "starts", "stops").collect()) == [(60, 0, 2.0), (60, 2, 1.0)]
    between = spark.createDataFrame([(60, 0, 1.0, True, False), (60, 1, 1.0, False, False), (60, 2, 1.0, True, True), (60, 3, 1.0, False, True), (60, 4, 1.0, False, True)], notes.schema)
    assert sorted(tuple(r) for r in timeline.fold_ties(between, ["p"], "at", "d", "starts", "stops").collect()) == [(60, 0, 3.0), (60, 1, 1.0), (60, 4, 1.0)]
    x = [one(spark, timeline.bin_of(F.lit(v), [1.0, 2.0, 3.0]))[0] for v in (0.0, 1.0, 2.5, 9.0)]
    assert x == [1, 2, 3, 3]


SCORE = b"""<score-partwise><part id="P1"><measure number="1"><attributes><divisions>2</divisions><time><beats>3</beats><beat-type>4</beat-type></time></attributes>
<harmony><root><root-step>A</root-step></root><kind>minor</kind></harmony><note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><tie type="start"/></note>
<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration></note><note><rest/><duration>2</duration></note>
<note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><tie type="stop"/></note></measure></part></score-partwise>"""


def test_score_source(spark, tmp_path):
    (tmp_path / "a.musicxml").write_bytes(SCORE)
    rows = scores.musicxml(spark, str(tmp_path)).collect()
    assert [(r.kind, r.measure, r.onset, r.duration, r.pitch, r.symbol) for r in rows] == [("note", 1, 0.0, 2.0, 61, None), ("note", 1, 0.0, 1.0, 64, None), ("chord", 1, 0.0, None, None, "Am")]
    assert {r.time_signature for r in rows} == {"3/4"}


def test_scores_that_cannot_be_read():
    assert [e for e in scores.score_events(SCORE.replace(b"<kind>minor</kind>", b"<kind text=' '>major-seventh</kind>")) if e[0] == "chord"][0][6] == "Amajor-seventh"
    for old, new in ((b"<root-step>A</root-step>", b""), (b"<kind>minor</kind>", b""), (b"<time>", b"<x>"), (b"<part id=", b"<other id=")):
        with pytest.raises(ValueError):
            list(scores.score_events(SCORE.replace(old, new).replace(b"</time>", b"</x>" if new == b"<x>" else b"</time>").replace(b"</part>", b"</other>" if b"other" in new else b"</part>")))


def test_rectangles(spark, tmp_path):
    region = lambda name, x: {"shape_attributes": {"name": name, "x": x, "y": 1, "width": 4, "height": 9}}
    (tmp_path / "v.json").write_text(json.dumps({"a1": {"filename": "a.png", "size": 3, "regions": [region("rect", 10), region("circle", 5), region("rect", 2)]}}))
    got = scores.rectangles(spark, str(tmp_path / "v.json")).orderBy("x").collect()
    assert [(r.filename, r.x, r.x_center) for r in got] == [("a.png", 2.0, 4.0), ("a.png", 10.0, 12.0)]


def test_manifest_round_trip(spark, tmp_path):
    works = spark.createDataFrame([("a", "p/a.pdf", "A", "C", "Vals", None, "G", None)], "slug string, pdf_path string, title string, composer string, rhythm string, time_signature string, key_hint string, tempo_hint string")
    scores.write_manifest(works, str(tmp_path / "m"))
    assert [(r.slug, r.metadata.title, r.metadata.key_hint, r.metadata.tempo_hint) for r in scores.manifest(spark, str(tmp_path / "m")).collect()] == [("a", "A", "G", None)]


def test_metadata_source(spark, tmp_path):
    (tmp_path / "m.csv").write_text('title,genre,author,pdf_file\n"Uno, dos",Vals,Ana,a.pdf\nUno dos,Vals,,b.pdf\n')
    works, problems = scores.metadata_csv(spark, str(tmp_path / "m.csv"))
    assert [r.rhythm for r in works.collect()] == ["Vals", "Vals"]
    assert sorted(map(tuple, problems.collect())) == [("uno-dos", "duplicate slug"), ("uno-dos", "missing composer")]


def test_read_through(spark):
    asked, cache = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "old")], "k int, v string")
    every, fresh = scores.read_through(asked, cache, "k", lambda r: r.withColumn("v", F.lit("new")))
    assert sorted(map(tuple, every.collect())) == [(1, "old"), (2, "new")] and fresh.count() == 1
