"""Playback, the ABC reader, and what both say of the same tunes."""

from __future__ import annotations

import pytest
from cadenza.operators import editions, playback
from cadenza.sources import abc_reader, notation
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_section_plans(spark):
    orders = spark.createDataFrame([("a", " A B A "), ("b", "AC"), ("c", "A"), ("d", "Aa"), ("e", "A"), ("f", "AB")], "w string, parts string")
    labels = [("a", "A", 0), ("a", "B", 10), ("b", "A", 0), ("c", "A", 5), ("d", "A", 0), ("e", "A", 0), ("e", "A", 4), ("f", "A", 0), ("f", "B", 9)]
    ends = spark.createDataFrame([(k, 20 if k != "f" else 9) for k in "abcdef"], "w string, end int")
    sections, problems = playback.section_plan(orders, spark.createDataFrame(labels, "w string, name string, start int"), ends, "w")
    assert sorted((r.w, r.name, r.start, r.end, r.order) for r in sections.collect()) == [("a", "A", 0, 10, "ABA"), ("a", "B", 10, 20, "ABA")]
    assert {(r.w, r.problem) for r in problems.collect()} == {("b", "missing section"), ("c", "first section"), ("d", "order"), ("e", "labels"), ("f", "empty section")}


@given(st.lists(st.sampled_from(["|", "|:", ":|", "::", ":|:"]), max_size=8))
def test_repeat_rule(signs):
    """The rule of the column fold, written out, is what the reader of tunes uses."""
    opened = closed = unsafe = False
    for s in signs:
        if s.startswith(":"):
            unsafe |= closed and not opened
            if opened:
                opened, closed = False, True
        opened |= s.endswith(":")
    tune = "X:1\nM:1/4\nL:1/4\nK:C\n" + "".join(f"C {s} " for s in signs) + "C |]"
    read = abc_reader.read_tune(tune)
    assert read["valid"] and (read["route"] is None or not unsafe)


def test_unsafe_repeats(spark):
    tunes = {"a": ["|:", ":|", ":|"], "b": ["|:", ":|", "|:", ":|"], "c": [":|", ":|"], "d": ["|:", "::", ":|"], "e": []}
    df = spark.createDataFrame([(w, k, s) for w, x in tunes.items() for k, s in enumerate(x)], "w string, time int, bar_type string")
    assert {r.w: r.unsafe for r in playback.unsafe_repeats(df, "w").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_sections_are_played_in_order(spark):
    events = spark.createDataFrame([("a", 0, 0.0, 1.0, 60), ("a", 5, 1.0, 1.0, 62), ("a", 10, 2.0, 2.0, 64), ("b", 0, 0.0, 9.0, 60), ("b", 10, 2.0, 1.0, 62)], "w string, written int, start double, duration double, pitch int")
    sections = spark.createDataFrame([(w, "ABA", n, s, e) for w in "ab" for n, s, e in (("A", 0, 10), ("B", 10, 20))], "w string, order string, name string, start int, end int")
    played, problems = playback.play_sections(events, sections, "w")
    assert sorted((r.visit, r.performed, r.pitch) for r in played.collect()) == [(0, 0.0, 60), (0, 1.0, 62), (1, 2.0, 64), (2, 4.0, 60), (2, 5.0, 62)]
    assert [(r.w, r.problem) for r in problems.collect()] == [("b", "a held note crosses a section")]
    late = events.withColumn("written", F.col("written") + 1)
    assert "a section must begin with a note or rest" in {r.problem for r in playback.play_sections(late, sections, "w")[1].collect()}
    long = events.where("w = 'a'").withColumn("start", F.col("start") * 1000)
    assert "longer than the playback limit" in {r.problem for r in playback.play_sections(long, sections.where("w = 'a'"), "w")[1].collect()}


def test_tie_chains(spark):
    rows = [("a", 1, 2, None), ("a", 2, 3, 9), ("a", 3, None, None), ("a", 4, 5, 7), ("a", 5, None, 8), ("a", 6, 7, None), ("a", 7, 6, None), ("a", 8, None, None), ("b", 1, 2, None), ("b", 2, None, None)]
    rows += [("c", k, k + 1 if k < 99 else None, None) for k in range(100)]
    heads = spark.createDataFrame(rows, "w string, head long, tied_to long, given_id long")
    got = {(r.w, r.head): r.chain for r in playback.tie_chains(heads, "w").collect()}
    assert got == {("a", 1): 9, ("a", 2): 9, ("a", 3): 9, ("b", 1): 1, ("b", 2): 1} | {("c", k): 0 for k in range(100)}


def test_tempo_and_visits(spark):
    works = spark.createDataFrame([("a",), ("b",)], "w string")
    tempos = spark.createDataFrame([("a", 0, 90.0, 1), ("a", 0, -5.0, 2), ("a", 7, 200.0, 3), ("a", 0, float("nan"), 4)], "w string, at int, bpm double, place int")
    assert {r.w: r.bpm for r in playback.initial_tempo(tempos, works, "w").collect()} == {"a": 90.0, "b": 120.0}
    bars = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("b", 1, 0), ("b", 2, 9)], "w string, number int, index int")
    events = spark.createDataFrame([("a", 0, 0.0, 1), ("a", 0, 0.0, 2), ("a", 3, 0.5, 3), ("a", 5, 1.0, 4), ("a", 0, 2.0, 5), ("b", 0, 0.0, 1)], "w string, index int, start double, order int")
    assert {r.w: (r.route, r.route_status) for r in playback.visited_bars(events, bars, "w").collect()} == {"a": ([1, 2, 1], "resolved"), "b": (None, "unsupported")}


HEAD = "X:1\nT:t\nM:{m}\nL:1/4\nK:{k}\n"


def read(body, m="3/4", k="C"):
    return abc_reader.read_tune(HEAD.format(m=m, k=k) + body)


def pitches(tune):
    return [[n["pitch"] for n in b["notes"]] for b in tune["measures"]]


@pytest.mark.parametrize(("k", "expected"), [("C", [60, 65, 71]), ("G", [60, 66, 71]), ("Bb", [60, 65, 70]), ("F#m", [61, 66, 71]), ("D dor", [60, 65, 71]), ("Eb minor", [59, 65, 70]), ("E Mix", [61, 66, 71]), ("none", [60, 65, 71])])
def test_keys(k, expected):
    assert pitches(read("C F B |", k=k)) == [expected]


def test_notes_lengths_and_ties():
    assert pitches(read("^C C =C | C c' C, |")) == [[61, 61, 60], [60, 84, 48]]
    t = read("C/2D/E// F3/2- F/4 | [CE-G]3 | [CE]3 |")
    assert [(n["onset"], n["duration"]) for n in t["measures"][0]["notes"]] == [(0, 192), (192, 192), (384, 96), (480, 576), (1056, 96)]
    assert [(n["pitch"], n["tie_start"], n["tie_end"]) for n in t["measures"][1]["notes"]] == [(60, False, False), (64, True, False), (67, False, False)]
    assert [(n["pitch"], n["tie_end"]) for n in t["measures"][2]["notes"]] == [(60, False), (64, True)]
    b = read("C>D E | C<D E | (3CDE F |")
    assert [[n["duration"] for n in x["notes"]] for x in b["measures"]] == [[576, 192, 384], [192, 576, 384], [256, 256, 256, 384]]
    assert all(x["meter_valid"] for x in b["measures"])


def test_rests_symbols_and_meters():
    t = read('"Am"z "^text"x"G7"C | Z2 | [M:2/4] C2 | [K:G] F2 |')
    first = t["measures"][0]
    assert [(r["onset"], r["visible"]) for r in first["rests"]] == [(0, True), (384, False)] and [(c["onset"], c["symbol"]) for c in first["chords"]] == [(0, "Am"), (768, "G7")]
    assert [b["expected_ticks"] for b in t["measures"]] == [1152, 1152, 1152, 768, 768] and pitches(t)[-1] == [66]
    assert (t["counts"]["rests"], t["counts"]["chord_labels"], t["counts"]["measures"]) == (3, 2, 5)
    assert read("C4 |", m="C")["measures"][0]["meter_valid"] and read("C4 |", m="none")["measures"][0]["meter_valid"] is None


def test_pickups():
    reasons = lambda body: [(b["partial_reason"], b["meter_valid"]) for b in read(body)["measures"]]
    assert reasons("C | C3 | C2 |") == [("pickup", True), (None, True), ("pickup_complement", True)]
    assert reasons("C | C3 | C3 |") == [("pickup_candidate", None), (None, True), (None, True)]
    assert reasons("C2 |") == [("pickup_candidate", None)]


@pytest.mark.parametrize(("body", "route"), [("C3 | D3 |]", [1, 2]), ("|: C3 | D3 :| E3 |]", [1, 2, 1, 2, 3]), ("C3 | D3 :| E3 |]", [1, 2, 1, 2, 3]), ("|: C3 |1 D3 :|2 E3 |] F3 |]", [1, 2, 1, 3, 4]), ("|: C3 :: D3 :|", [1, 1, 2, 2]), ("|: C3 | [1 D3 :| [2 E3 :|", None)])
def test_routes(body, route):
    got = read(body)
    assert got["valid"]
    if route is not None:
        assert (got["route"], got["route_status"]) == (route, "resolved")


def test_section_orders_and_voices():
    order = "X:1\nM:1/4\nL:1/4\nP:{o}\nK:C\nP:A\nC | D |\nP:B\nE |\n"
    assert abc_reader.read_tune(order.format(o="ABBA"))["route"] == [1, 2, 3, 3, 1, 2]
    missing = abc_reader.read_tune(order.format(o="AC"))
    assert missing["valid"] and missing["route_status"] == "unsupported" and missing["warnings"]
    voices = "X:1\nM:2/4\nL:1/4\nK:C\nV:1\nC2 | D2 |\nV:2\n{b}\n"
    two = abc_reader.read_tune(voices.format(b="E, G, | z2 |"))
    assert [[(n["voice"], n["onset"], n["pitch"]) for n in b["notes"]] for b in two["measures"]] == [[("1", 0, 60), ("2", 0, 52), ("2", 384, 55)], [("1", 0, 62)]]
    assert not abc_reader.read_tune(voices.format(b="E, | G, | z2 |"))["valid"]


@pytest.mark.parametrize("text", [None, "", "X:1\nM:4/4\nK:C\nX:2\nC|", "X:1\nK:C\nC|", "X:1\nM:?\nK:C\nC|", "X:1\nM:4/4\nK:C\n%%beginsvg\nC|", "X:1\nM:4/4\nK:C\n<script>C|", "X:1\nM:4/4\nK:H\nC|", "X:1\nM:4/4\nK:C\nC $ D|", "X:1\nM:4/4\nK:C\n|", "X:1\nM:4/4\nL:1/1000\nK:C\nC|", "X:1\nM:4/4\nK:C\n[CQ]|"])
def test_tunes_that_are_not_read(text):
    got = abc_reader.read_tune(text)
    assert not got["valid"] and got["errors"] and got["measures"] == [] and got["route_status"] == "unavailable"


@given(st.text("ABCXMKLabcz|:[]()\"'^_=<>/0123456789 \n-", max_size=60))
def test_any_text_gives_bars_or_errors(body):
    got = abc_reader.read_tune("X:1\nM:4/4\nL:1/4\nK:C\n" + body)
    assert got["valid"] == (not got["errors"]) and bool(got["measures"]) == got["valid"]


def test_written_tunes_are_read_back_and_equal_themselves(spark):
    works = spark.createDataFrame([("a", "T", "C", "3/4", "C"), ("b", "T", "C", "4/4", "C")], "slug string, title string, composer string, time_signature string, key_hint string")
    notes = spark.createDataFrame([("a", 1, 0.0, 1.5, 60, None), ("a", 1, 1.5, 1.5, 66, 1), ("a", 2, 0.0, 3.0, 64, None), ("a", 2, 0.0, 3.0, 67, None), ("b", 1, 1.0, 3.0, 61, -1)], "slug string, measure int, onset_beats double, duration_beats double, pitch_midi int, accidental int")
    chords = spark.createDataFrame([("a", 1, 0.0, 0, "Am")], "slug string, measure int, onset_beats double, place int, symbol string")
    scores = abc_reader.read_abc(notation.abc(works, notes, chords))
    bars = abc_reader.bars_table(scores, "slug")
    got = sorted((r.slug, r.number, n.onset, n.duration, n.pitch) for r in bars.collect() for n in r.notes)
    assert got == [("a", 1, 0, 576, 60), ("a", 1, 576, 576, 66), ("a", 2, 0, 1152, 64), ("a", 2, 0, 1152, 67), ("b", 1, 384, 1152, 61)]
    side = scores.select(F.col("slug").alias("score"), "valid", "ticks_per_quarter", "route", "route_status")
    same = bars.withColumnRenamed("slug", "score")
    metrics, wrong = editions.compare_editions(same, same, side, side)
    assert {(r.score, r.edition_note_f1, r.edition_exact_bar_rate, r.form_exact_match) for r in metrics.collect()} == {("a", 1.0, 1.0, True), ("b", 1.0, 1.0, True)} and wrong.count() == 0
