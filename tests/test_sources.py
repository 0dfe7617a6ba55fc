"""Payloads, caches, snapshots, programs, streams and small models."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from cadenza.operators import models
from cadenza.sources import payloads as P
from cadenza.sources import scores
from cadenza.streaming.sessions import sessions
from pyspark.sql import functions as F

from .test_units import SCORE


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n  \n{"a": 2}\n')
    assert [tuple(r) for r in P.json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    df = spark.createDataFrame([(2, "y", None)], "z int, a string, m int").coalesce(1)
    P.write_json_lines(df, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    assert file.read_text() == '{"a":"y","m":null,"z":2}\n'
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception):
        P.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_answers(spark):
    item = {"symbol": " E minor ", "x_fraction": 1.7, "confidence": "high"}
    answers = spark.createDataFrame([(1, "```json\n" + json.dumps({"detections": [item, {"symbol": " "}, {"x_fraction": 1}]}) + "\n```"), (2, '{"detections": null}'), (3, "no json"), (4, None)], "k int, a string")
    assert [(r.k, r.place, r.symbol_raw, r.symbol, r.x_fraction, r.confidence, r.band) for r in P.detections(answers, "a", "above").collect()] == [(1, 0, "E minor", "Em", 1.0, 0.0, "above")]
    items = [{"kind": "NOTE", "pitch": "None", "duration": " ", "accidental": "Sharp", "confidence": 0.4, "staff_position": "3", "notehead_x_fraction": "x"}, {"kind": "clef"}]
    told = spark.createDataFrame([(1, "```\n" + json.dumps({"items": items, "comments": "c", "overall_confidence": "0.5", "uncertainties": ["a", "", None]}) + "```"), (2, "?")], "k int, a string")
    rows = {r.k: r for r in P.transcription(told, "a").collect()}
    first, second = rows[1]["items"]
    assert (first.kind, first.pitch, first.duration, first.accidental, first.staff_position, first.notehead_x_fraction) == ("note", None, "unknown", "sharp", 3, None)
    assert second.kind == "unknown" and rows[1].overall_confidence == 0.5 and rows[1].uncertainties == ["a"] and rows[2]["items"] is None


def test_replay_and_cache(spark, tmp_path):
    images = spark.createDataFrame([("p.png", bytearray(b"img")), ("q.png", bytearray(b"other"))], "path string, content binary")
    keys = {r.path: r for r in P.request_keys(images.select("path"), images, "v1", "m").collect()}
    assert keys["p.png"].key == hashlib.sha256(b"img\x1fv1\x1fm").hexdigest()[:16]
    answer = [("E-", "Em", 0.5, 0.9, "above")]
    recorded = spark.createDataFrame([(keys["p.png"].legacy_key, "v1", "fixture", "p.png", answer)], "key string, prompt_version string, model_id string, image_path string, detections array<struct<symbol_raw:string,symbol:string,x_fraction:double,confidence:double,band:string>>")
    P.write_recordings(recorded, str(tmp_path / "rec"))
    (tmp_path / "flat").mkdir()
    for file in (tmp_path / "rec").rglob("part-*"):
        (tmp_path / "flat" / f"{file.parent.name.split('=')[1]}.json").write_text(file.read_text())
    found, missing = P.replay(P.request_keys(images.select("path"), images, "v1", "m"), P.recordings(spark, str(tmp_path / "flat")))
    assert [(r.path, r.detections[0].symbol) for r in found.collect()] == [("p.png", "Em")] and [r.path for r in missing.collect()] == ["q.png"]
    calls = []

    def compute(rows):
        calls.append(sorted(r.k for r in rows.collect()))
        return rows.withColumn("v", F.col("k") * 10)

    asked = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    assert sorted(map(tuple, P.cached(asked(1, 2, 2), str(tmp_path / "cache"), "k", compute).collect())) == [(1, 10), (2, 20), (2, 20)]
    assert sorted(map(tuple, P.cached(asked(2, 3), str(tmp_path / "cache"), "k", compute).collect())) == [(2, 20), (3, 30)]
    assert calls == [[1, 2], [3]]


def test_snapshots_and_publishing(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a").write_bytes(b"1")
    (tmp_path / "d" / "sub" / "b").write_bytes(b"2")
    frozen = P.freeze(spark, str(tmp_path / "d"), str(tmp_path / "m"))
    assert {(r.name, r.bytes) for r in frozen.collect()} == {("a", 1), ("sub/b", 1)} and P.verify(spark, str(tmp_path / "d"), str(tmp_path / "m")).count() == 0
    (tmp_path / "d" / "a").write_bytes(b"x")
    (tmp_path / "d" / "c").write_bytes(b"3")
    assert {(r.name, r.problem) for r in P.verify(spark, str(tmp_path / "d"), str(tmp_path / "m")).collect()} == {("a", "changed"), ("c", "added")}
    with pytest.raises(Exception):
        P.freeze(spark, str(tmp_path / "d"), str(tmp_path / "m"))
    P.publish(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and not (tmp_path / "t.unpublished").exists()
    with pytest.raises(FileExistsError):
        P.publish(spark.range(9), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_programs_and_backends(spark):
    pages = spark.createDataFrame([(1, bytearray(b"hello")), (2, bytearray(b"fail")), (3, None)], "k int, content binary")
    script = 'grep -q fail "{input}" && exit 3; cp "{input}" "{folder}/out.txt"'
    rows = {r.k: r for r in P.external(pages, "content", ["sh", "-c", script], ".in", out_suffix=".txt").collect()}
    assert bytes(rows[1].output) == b"hello" and rows[1].error is None and rows[2].error == "exit 3, 0 outputs" and rows[3].error == "no input"

    def refuse(blob):
        raise ValueError("refused")

    assert P.external(pages.where("k = 1"), "content", ["sh", "-c", script], ".in", out_suffix=".txt", check=refuse).first().error == "refused"
    assert P.external(pages.where("k = 1"), "content", ["no-such-program"], ".in", out_suffix=".txt").first().error == "FileNotFoundError"
    assert P.external(pages.where("k = 1"), "content", ["sleep", "5"], ".in", out_suffix=".txt", timeout=0.2).first().error == "TimeoutExpired"
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "slug string")
    stored = spark.createDataFrame([("a", bytearray(SCORE)), ("b", bytearray(b"<x"))], "slug string, content binary")
    rows = {r.slug: r for r in P.backend("fixture")(asked, stored).collect()}
    assert bytes(rows["a"].output) == SCORE and rows["b"].output is None and rows["b"].error.startswith("ParseError") and "no stored score" in rows["c"].error
    with pytest.raises(ValueError):
        P.backend("other")


def test_records_catalogs_and_crops(spark, tmp_path):
    runs = spark.sql("SELECT 'a' AS w, 'ocr' AS stage, 'ok' AS status, TIMESTAMP '2024-01-01 00:00:00' AS started_at, TIMESTAMP '2024-01-01 00:00:01.5' AS ended_at, ' ' AS error UNION ALL SELECT 'b', 'ocr', 'failed', TIMESTAMP '2024-01-01 00:00:02', TIMESTAMP '2024-01-01 00:00:01', 'x'")
    rows = {r.w: (r.started_at, r.duration_seconds, r.error) for r in P.stage_records(runs).collect()}
    assert rows == {"a": ("2024-01-01T00:00:00Z", 1.5, None), "b": ("2024-01-01T00:00:02Z", 0.0, "x")}
    assert tuple(P.command_status(runs, "run").first()) == ("run", 2, 1, 1)
    P.append_records(P.stage_records(runs), str(tmp_path / "l"))
    P.append_records(P.stage_records(runs), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 4
    works = spark.createDataFrame([("b", "B|b", None, "Vals"), ("a", "A", "C", "Pasillo")], "slug string, title string, composer string, rhythm string")
    assert P.markdown_catalog(works).first().text.split("\n")[4:] == ["| A | C | Pasillo | `a` |", "| B\\|b |  | Vals | `b` |", ""]
    v = P.variants(spark.createDataFrame([("a", "read it")], "slug string, prompt string"), [{"variant": "plain"}, {"variant": "staff", "text": "by staff"}])
    assert sorted((r.variant, r.prompt) for r in v.collect()) == [("plain", "read it"), ("staff", "read it\nby staff")]
    systems = spark.createDataFrame([("a", 1, [0.0, 0.4, 1.0]), ("a", 2, [0.1, 1.0]), ("a", 3, [0.5])], "slug string, system_index int, edges array<double>")
    crops = [(r.system_index, r.system_measure_index, r.global_measure_index, r.left, r.right) for r in P.measure_crops(systems, ["slug"]).orderBy("global_measure_index").collect()]
    assert crops == [(1, 1, 1, 0.0, 0.4), (1, 2, 2, 0.4, 1.0), (2, 1, 3, 0.1, 1.0)]
    files = spark.createDataFrame([("/d/a.pdf", "a.pdf"), ("/d/b.pdf", "b.pdf"), ("/e/b.pdf", "b.pdf")], "path string, name string")
    good, bad = P.dataset(spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf"), ("c", "c.pdf")], "slug string, pdf_path string"), files)
    assert [(r.slug, r.path) for r in good.collect()] == [("a", "/d/a.pdf")] and {tuple(r) for r in bad.collect()} == {("b", "several files"), ("c", "missing file")}
    one = spark.range(1).select(P.resolved(F.lit("x/y"), "/r/"), P.resolved(F.lit("/x"), "/r"), P.relative(F.lit("/r/x/y"), "/r"), P.relative(F.lit("/q/x"), "/r")).first()
    assert tuple(one) == ("/r/x/y", "/x", "x/y", "/q/x")
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "n.txt").write_text("x")
    assert [r.name for r in P.existing_files(spark, str(tmp_path / "f")).collect()] == ["n.txt"]


def test_truth_documents(spark, tmp_path):
    (tmp_path / "a.musicxml").write_bytes(SCORE)
    (row,) = P.truth_documents(scores.musicxml(spark, str(tmp_path))).collect()
    told = json.loads(row.json)
    assert told["time_signature"] == "3/4" and told["notes"] == [{"measure": 1, "onset_beats": 0.0, "duration_beats": 2.0, "pitch_midi": 61, "accidental": 1}, {"measure": 1, "onset_beats": 0.0, "duration_beats": 1.0, "pitch_midi": 64}] and told["chords"] == [{"measure": 1, "onset_beats": 0.0, "symbol": "Am"}]


def test_sessions_of_a_stream_with_late_rows(spark, tmp_path):
    """A stream gives the batch's sessions; a row older than the watermark is left out."""
    schema = "user_id long, ts timestamp"
    batches = ([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 01:00:00")], [(1, "2024-01-01 08:00:00"), (1, "2024-01-03 00:00:00")], [(2, "2024-01-06 00:00:00")], [(2, "2024-01-01 02:00:00"), (9, "2024-01-20 00:00:00")])
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        next((tmp_path / f"b{k}").glob("part-*")).rename(source / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    query = sessions(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.user_id, str(r.start), r.n) for r in spark.table("told").collect()}
    every = {(r.user_id, str(r.start), r.n) for r in sessions(spark.read.schema(schema).parquet(str(source))).collect()}
    assert (1, "2024-01-01 00:00:00", 3) in got
    assert got - every == {(2, "2024-01-01 01:00:00", 1)} and every - got == {(2, "2024-01-01 01:00:00", 2), (9, "2024-01-20 00:00:00", 1)}


def test_logistic_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    rows = [("a" if k % 2 else "b", k % 10, k, float(a), float(b), int(a + 0.2 * b > 0)) for k, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "fold string, unit int, id int, x double, y double, label int")
    model = models.fit_logistic(df, ["fold"], "label", ["x", "y"])
    scored = models.score_logistic(df, model, ["fold"], ["x", "y"]).collect()
    assert np.mean([(r.score > 0.5) == (r.label == 1) for r in scored]) > 0.95
    pairs = models.label_pairs(df, ["fold", "unit"], "id", "label", ["x", "y"])
    assert pairs.count() == sum(sum(r[5] for r in rows if r[:2] == g) * sum(1 - r[5] for r in rows if r[:2] == g) for g in {r[:2] for r in rows})
    for r in models.fit_ranker(df, ["fold"], ["unit"], "id", "label", ["x", "y"]).collect():
        assert r.weights[0] > 0 and r.weights[0] > 2 * abs(r.weights[1])

    def slow(features, labels):  # the same steps, one number at a time
        w, b, n, pos = [0.0, 0.0], 0.0, len(labels), sum(labels)
        for it in range(30):
            g, gb = [0.0, 0.0], 0.0
            for f, label in zip(features, labels, strict=True):
                error = (1 / (1 + np.exp(-(b + w[0] * f[0] + w[1] * f[1]))) - label) * (n / (2 * pos) if label else n / (2 * (n - pos)))
                gb += error
                g = [g[k] + error * f[k] for k in (0, 1)]
            rate = 0.08 / (1 + it / 500)
            b -= rate * gb / n
            w = [w[k] - rate * (g[k] / n + w[k] / n) for k in (0, 1)]
        return [*w, b]

    labels = [r[5] for r in rows[:60]]
    assert models.logistic(x[:60], np.array(labels), steps=30) == pytest.approx(slow(x[:60].tolist(), labels))


def test_programs_with_several_files_and_previews(spark):
    pages = spark.createDataFrame([(1, bytearray(b"ab")), (2, None)], "k int, content binary")
    rows = {r.k: r for r in P.external_many(pages, "content", ["sh", "-c", 'for n in 2 1; do cp "{input}" "{folder}/p$n.txt"; done; touch "{folder}/x.log"'], ".in", out_suffix=".txt").collect()}
    assert [(o.name, bytes(o.content)) for o in rows[1].outputs] == [("p1.txt", b"ab"), ("p2.txt", b"ab")] and rows[2].error == "no input"
    assert P.external_many(pages.where("k = 1"), "content", ["no-such-program"], ".in", out_suffix=".txt").first().error == "FileNotFoundError"
    tunes = spark.createDataFrame([(1, "X:1\nT: A & <B>\nK:C\n"), (2, None)], "k int, abc string")
    got = {r.k: r for r in P.previews(tunes, programs=(("no-such-program", "{input}"),)).collect()}
    assert "A &amp; &lt;B>" in got[1].svg and not got[1].drawn and "untitled" in got[2].svg
    drawn = P.previews(tunes.where("k = 1"), programs=(("sh", "-c", 'echo "<svg/>" > "{folder}/o.svg"'),)).first()
    assert drawn.drawn and drawn.svg == "<svg/>\n"


def test_revisions_backups_and_pages(spark, tmp_path):
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    history = spark.createDataFrame([("a", 1, h("one"), None), ("a", 2, h("two"), h("one"))], "w string, revision int, sha256 string, previous_sha256 string")
    edits = spark.createDataFrame([("a", h("two"), "three", 5), ("a", h("two"), "other", 6), ("a", h("one"), "late", 1), ("b", None, "first", 1)], "w string, base_sha256 string, content string, edited_at int")
    new, conflicts = P.apply_revisions(history, edits, "w")
    assert {(r.w, r.revision, r.sha256, r.previous_sha256) for r in new.collect()} == {("a", 3, h("three"), h("two")), ("b", 1, h("first"), None)}
    assert {r.content for r in conflicts.collect()} == {"other", "late"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"1")
    P.backup(spark, str(tmp_path / "d"), str(tmp_path / "b"))
    assert P.backup_problems(spark, str(tmp_path / "d"), str(tmp_path / "b")).count() == 0
    (tmp_path / "d" / "a").write_bytes(b"2")
    assert [(r.name, r.problem) for r in P.backup_problems(spark, str(tmp_path / "d"), str(tmp_path / "b")).collect()] == [("a", "changed")]
    page = P.html_table(spark.createDataFrame([("<x>", 1), (None, 2)], "a string, b int"), "T & t")
    assert "<td>&lt;x&gt;</td><td>1</td>" in page and "<h1>T &amp; t</h1>" in page


def test_live_sources(spark):
    def connect():
        seen = {}

        def client(row):
            seen[row["k"]] = seen.get(row["k"], 0) + 1
            if row["k"] == 2 and seen[2] < 2 or row["k"] == 3:
                raise RuntimeError("busy")
            return f"answer {row['k']}"

        return client

    rows = {r.k: (r.answer, r.error, r.tries) for r in P.ask(spark.createDataFrame([(1,), (2,), (3,)], "k int").coalesce(1), connect).collect()}
    assert rows == {1: ("answer 1", None, 1), 2: ("answer 2", None, 2), 3: (None, "RuntimeError: busy", 3)}
