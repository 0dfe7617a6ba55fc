"""The notation writer on small works with known texts, and the constraint queries."""

import pytest
from cadenza.operators import integrity
from cadenza.sources import notation
from pyspark.sql import functions as F

NOTE = "slug string, measure int, onset_beats double, duration_beats double, pitch_midi int, accidental int"
CHORD = "slug string, measure int, onset_beats double, place int, symbol string"
CASES = {
    # a symbol inside a note cuts and ties it; the rest fills the bar
    "cut": ("3/4", [(1, 0.0, 2.0, 60, None)], [(1, 0.0, 0, "Am"), (1, 1.0, 1, "E7")], '"Am"C- "E7"C z |'),
    # simultaneous notes over a barline, rests before and after
    "over": ("3/4", [(1, 2.0, 2.0, 64, None), (1, 2.0, 2.0, 60, None)], [], "z2 [CE]- | [CE] z2 |"),
    # a pickup ends with its notes; a bar without anything is a rest
    "pickup": ("4/4", [(0, 0.0, 1.0, 72, None), (2, 0.0, 4.0, 48, None)], [], "c | z4 | C,4 |"),
    # spelling by accidentals: flat, sharp, double sharp, natural, and one that leaves no step
    "names": ("5/4", [(1, 0.0, 1.0, 61, -1), (1, 1.0, 1.0, 61, 1), (1, 2.0, 1.0, 62, 2), (1, 3.0, 1.0, 60, 0), (1, 4.0, 1.0, 61, 0)], [], "_D ^C ^^C =C ^C |"),
    # parts of beats, and symbols in a rest; two symbols of an onset are joined
    "parts": ("2/4", [(1, 0.5, 0.25, 84, None)], [(1, 0.0, 0, "C"), (1, 1.5, 1, "G7"), (1, 1.5, 2, "N.C.")], '"C"z/2 c\'/4 z3/4 "G7 N.C."z/2 |'),
    "empty": (None, [], [], "C D E F |"),
    "lengths": ("4/4", [(1, 0.0, 1.0, 60, None), (1, 0.0, 2.0, 64, None)], [], None),
    "overlap": ("4/4", [(1, 0.0, 2.0, 60, None), (1, 1.0, 2.0, 64, None)], [], None),
    "nothing": ("4/4", [(1, 0.0, 0.0, 60, None)], [], None),
}


@pytest.fixture(scope="module")
def written(spark):
    works = spark.createDataFrame([(k, "A title", None, v[0], None) for k, v in CASES.items()], "slug string, title string, composer string, time_signature string, key_hint string")
    notes = spark.createDataFrame([(k, *n) for k, v in CASES.items() for n in v[1]], NOTE)
    chords = spark.createDataFrame([(k, *c) for k, v in CASES.items() for c in v[2]], CHORD)
    return {r.slug: r.abc for r in notation.abc(works, notes, chords).collect()}, {(r.slug, r.problem) for r in notation.problems(notes).collect()}


@pytest.mark.parametrize("name", CASES)
def test_text_of_a_work(written, name):
    meter, *_, body = CASES[name]
    assert written[0][name] == (body and f"X:1\nT:A title\nC:\nM:{meter or '4/4'}\nL:1/4\nK:C\n{body}\n")


def test_problems(written):
    assert written[1] == {("lengths", "lengths differ"), ("overlap", "overlap"), ("nothing", "not positive")}


def test_lengths_are_written_to_the_nearest_part(spark):
    got = [r.t for r in spark.createDataFrame([(384,), (768,), (192,), (576,), (128,), (1,)], "n long").select(notation.duration_text(F.col("n")).alias("t")).collect()]
    assert got == ["", "2", "/2", "3/2", "/3", "0"]


def test_frozen_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name, text in (("a", "1"), ("x/b", "2"), ("c", "3")):
        (tmp_path / name).write_text(text)
    frozen = spark.createDataFrame(integrity.file_manifest(spark, str(tmp_path)).collect(), "name string, bytes long, sha256 string")
    assert {r.name for r in frozen.collect()} == {"a", "x/b", "c"} and integrity.differences(frozen, frozen).isEmpty()
    (tmp_path / "a").write_text("other")
    (tmp_path / "c").rename(tmp_path / "d")
    assert sorted(map(tuple, integrity.differences(frozen, integrity.file_manifest(spark, str(tmp_path))).collect())) == [("a", "changed"), ("c", "missing"), ("d", "added")]


def test_chain_and_catalog(spark):
    chain = spark.createDataFrame([("w", 1, "h1", None), ("w", 2, "h2", "h1"), ("w", 3, "h3", "hx")], "w string, n int, own string, prev string")
    assert [r.n for r in integrity.broken_chain(chain, "w", "n", "own", "prev").collect()] == [3]
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3), ("b", 3)], "g string, p int")
    assert [tuple(r) for r in integrity.catalog_problems(pages, "g", "p").collect()] == [("b", 3, 1, 1)]
