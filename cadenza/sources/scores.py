"""Sources and sinks: metadata CSV, manifest JSON lines, MusicXML scores, rectangle annotations, run caches."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ALTERATION, KIND_SYMBOL, STEPS, blank_to_null, slugify

MANIFEST = "slug string, pdf_path string, metadata struct<title:string, composer:string, rhythm:string, time_signature:string, key_hint:string, tempo_hint:string>"
EVENTS = "path string, kind string, measure int, onset double, duration double, pitch int, accidental int, symbol string, time_signature string"


def metadata_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Works and violations (missing title, composer, rhythm or file name; a slug used twice). genre and author stand in for rhythm and composer."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    col = lambda *names: F.coalesce(*(blank_to_null(F.col(n)) for n in names if n in raw.columns), F.lit(None).cast("string"))
    works = raw.select(slugify(col("title")).alias("slug"), col("title").alias("title"), col("composer", "author").alias("composer"), col("rhythm", "genre").alias("rhythm"), *(col(n).alias(n) for n in ("time_signature", "key_hint", "tempo_hint")), col("pdf_file", "pdf_path").alias("pdf_path"))
    missing = works.select("slug", F.explode(F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.concat(F.lit("missing "), F.lit(n))) for n in ("title", "composer", "rhythm", "pdf_path"))))).alias("problem"))
    twice = works.groupBy("slug").count().where("count > 1").select("slug", F.lit("duplicate slug").alias("problem"))
    return works, missing.unionByName(twice)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path).where("slug IS NOT NULL")


def write_manifest(works: DataFrame, path: str) -> None:
    works.select("slug", "pdf_path", F.struct("title", "composer", "rhythm", "time_signature", "key_hint", "tempo_hint").alias("metadata")).write.mode("errorifexists").json(path)


def _harmony(node: ET.Element) -> str:
    """Root, shown text (else the kind's sign, else the kind) and bass of a harmony."""

    def name(of: str) -> str:
        step = (node.findtext(f"{of}/{of}-step") or "").strip()
        return step + ALTERATION.get(int((node.findtext(f"{of}/{of}-alter") or "0").strip()), "") if step else ""

    root, kind = name("root"), node.find("kind")
    if root[:1] not in STEPS or not root:
        raise ValueError(f"a harmony needs a root, not {root!r}")
    if kind is None:
        raise ValueError("a harmony needs a kind")
    said = (kind.text or "").strip()
    bass = name("bass")
    return root + ((kind.get("text") or "").strip() or KIND_SYMBOL.get(said, said)) + (f"/{bass}" if bass else "")


def score_events(blob: bytes) -> Iterator[tuple]:
    """(kind, measure, onset, duration, pitch, accidental, symbol, time signature) of a one-part score, in document order.

    Ties are folded. A cursor follows durations, backups and forwards; notes of a chord share their first one's onset;
    notes without a duration are skipped. The signature is the last one seen. A score without one part or a signature,
    and a harmony without a readable root or a kind, is an error.
    """
    root = ET.fromstring(bytes(blob))
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    parts = root.findall("part")
    if len(parts) != 1:
        raise ValueError(f"a score with one part is needed, not {len(parts)}")
    divisions, signature, notes, chords, sounding = 1.0, None, [], [], {}
    for place, measure in enumerate(parts[0].findall("measure")):
        number = measure.get("number") or ""
        number, cursor, first = int(number) if number.isdigit() else place + 1, 0.0, 0.0
        for node in measure:
            length = float(node.findtext("duration") or 0) / divisions
            if node.tag == "attributes":
                divisions = float(node.findtext("divisions") or divisions)
                beats, unit = node.findtext("time/beats"), node.findtext("time/beat-type")
                signature = f"{beats.strip()}/{unit.strip()}" if beats and unit else signature
            elif node.tag in ("backup", "forward"):
                cursor += length if node.tag == "forward" else -length
            elif node.tag == "harmony":
                onset = cursor + float(node.findtext("offset") or 0) / divisions
                chords.append((number, round(onset, 4), _harmony(node)))
            elif node.tag == "note" and length > 0:
                onset = first if node.find("chord") is not None else cursor
                if node.find("chord") is None:
                    first, cursor = cursor, cursor + length
                if node.find("rest") is None and node.find("pitch") is not None:
                    alter = int(float(node.findtext("pitch/alter") or 0))
                    pitch = 12 * (int(node.findtext("pitch/octave")) + 1) + STEPS[node.findtext("pitch/step")] + alter
                    ties = {t.get("type") for t in (*node.findall("tie"), *node.findall("notations/tied"))}
                    if "stop" in ties and pitch in sounding:
                        sounding[pitch][2] = round(sounding[pitch][2] + round(length, 4), 4)
                        if "start" not in ties:
                            del sounding[pitch]
                    else:
                        natural = 0 if (node.findtext("accidental") or "").strip() == "natural" else None
                        notes.append([number, onset, round(length, 4), pitch, alter if node.find("pitch/alter") is not None else natural])
                        if "start" in ties:
                            sounding[pitch] = notes[-1]
    if signature is None:
        raise ValueError("a score needs a time signature")
    for number, onset, length, pitch, accidental in notes:
        yield "note", number, round(onset, 4), round(length, 4), pitch, accidental, None, signature
    for number, onset, symbol in chords:
        yield "chord", number, onset, None, None, None, symbol, signature


def musicxml(spark: SparkSession, path: str) -> DataFrame:
    """Events of all scores under a path, one row for each note and chord."""

    def run(batches):
        for files in batches:
            rows = [(p, *event) for p, blob in zip(files.path, files.content, strict=True) for event in score_events(blob)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, EVENTS)


def rectangles(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of annotation files that map a name to a file with regions: (filename, x, y, width, height, x_center)."""
    kind = "map<string, struct<filename:string, regions:array<struct<shape_attributes:struct<name:string,x:double,y:double,width:double,height:double>>>>>"
    texts = spark.read.text(path, wholetext=True)
    boxes = texts.select(F.explode(F.map_values(F.from_json("value", kind))).alias("f")).select("f.filename", F.explode("f.regions.shape_attributes").alias("b"))
    return boxes.where("b.name = 'rect'").select("filename", "b.x", "b.y", "b.width", "b.height", (F.col("b.x") + F.col("b.width") / 2).alias("x_center"))


def read_through(requests: DataFrame, cache: DataFrame, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(all results, new results): cached ones, and what `compute` gives for requests whose key the cache lacks."""
    fresh = compute(requests.join(cache, key, "left_anti"))
    return requests.select(key).join(cache, key).unionByName(fresh), fresh
