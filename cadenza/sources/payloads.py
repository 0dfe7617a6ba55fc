"""Sources and sinks of runs: recorded model answers, replay by content, caches, catalogs, stage records, variants, frozen snapshots."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.integrity import differences, file_manifest

DETECTION = "struct<symbol:string,x_fraction:string,confidence:string>"
DETECTIONS = f"struct<detections:array<{DETECTION}>>"
RECORDING = "struct<prompt_version:string,model_id:string,image_path:string,detections:array<struct<symbol_raw:string,symbol:string,x_fraction:double,confidence:double,band:string>>>"
ITEM = "struct<kind:string,pitch:string,duration:string,accidental:string,confidence:string,notehead_x_fraction:string,notehead_y_fraction:string,staff_position:string,evidence:string>"
TRANSCRIPTION = f"struct<items:array<{ITEM}>,comments:string,overall_confidence:string,uncertainties:array<string>>"
#: Fixed value: the model whose recordings stand in where the asked one has none.
LEGACY_MODEL = "fixture"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file by an explicit schema; blank lines are skipped, a line that can't be read is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.from_json("value", f"struct<{schema}>" if not schema.startswith("struct") else schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in alphabetical order, nulls written; the folder must not exist yet."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def fenced_json(text: Column) -> Column:
    """The JSON text of an answer, without the code fence that may stand around it."""
    plain = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(plain, r"^```(json)?\s*", ""), r"\s*```$", "")
    return F.when(F.startswith(plain, F.lit("```")), inner).otherwise(plain)


def detections(answers: DataFrame, text: str, band: str) -> DataFrame:
    """One row for each chord symbol of an answer, in order: blank symbols go, the symbol is put in its usual form, fractions lie within 0 and 1."""
    parsed = F.from_json(fenced_json(F.col(text)), DETECTIONS)
    rows = answers.select(*answers.columns, F.posexplode(F.coalesce(parsed["detections"], F.array().cast(f"array<{DETECTION}>"))).alias("place", "__d"))
    raw = F.trim("__d.symbol")
    out = rows.select(*answers.columns, "place", raw.alias("symbol_raw"), C.chord_symbol(raw).alias("symbol"), C.unit_interval(F.col("__d.x_fraction")).alias("x_fraction"), C.unit_interval(F.col("__d.confidence")).alias("confidence"), F.lit(band).alias("band"))
    return out.where("symbol_raw != '' AND symbol != ''")


def transcription(answers: DataFrame, text: str) -> DataFrame:
    """Answers with an array `items` (notes, rests and unknown kinds; optional values null where blank or unreadable), comments, overall_confidence and uncertainties; nulls if the answer isn't JSON."""
    parsed = F.from_json(fenced_json(F.col(text)), TRANSCRIPTION)

    def item(i: Column) -> Column:
        kind = F.lower(F.trim(i["kind"]))
        number = lambda c, t: F.trim(c).try_cast(t)
        return F.struct(
            F.when(kind.isin("note", "rest"), kind).otherwise("unknown").alias("kind"), C.optional_text(i["pitch"]).alias("pitch"), F.coalesce(C.blank_to_null(i["duration"]), F.lit("unknown")).alias("duration"),
            F.lower(C.optional_text(i["accidental"])).alias("accidental"), C.unit_interval(i["confidence"]).alias("confidence"),
            number(i["notehead_x_fraction"], "double").alias("notehead_x_fraction"), number(i["notehead_y_fraction"], "double").alias("notehead_y_fraction"), number(i["staff_position"], "int").alias("staff_position"), C.optional_text(i["evidence"]).alias("evidence"),
        )

    p = answers.withColumn("__p", F.when(F.get_json_object(fenced_json(F.col(text)), "$").isNotNull(), parsed))
    items = F.when(F.col("__p").isNotNull(), F.transform(F.coalesce("__p.items", F.array().cast(f"array<{ITEM}>")), item))
    return p.select(*answers.columns, items.alias("items"), F.coalesce("__p.comments", F.lit("")).alias("comments"), F.trim("__p.overall_confidence").try_cast("double").alias("overall_confidence"), F.filter(F.coalesce("__p.uncertainties", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "").alias("uncertainties"))


def request_keys(requests: DataFrame, images: DataFrame, prompt: str, model: str, path: str = "path") -> DataFrame:
    """Requests with the content key of their picture (path, content), prompt and model, and that of the legacy model."""
    key = lambda m: F.substring(F.sha2(F.concat("content", F.lit(f"\x1f{prompt}\x1f{m}").cast("binary")), 256), 1, 16)
    return requests.join(images.select(path, key(model).alias("key"), key(LEGACY_MODEL).alias("legacy_key")), path)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers under a path, named by their content key: (key, prompt_version, model_id, image_path, detections)."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("key"), F.from_json("value", RECORDING, {"mode": "FAILFAST"}).alias("r"))
    return files.select("key", "r.*")


def write_recordings(answers: DataFrame, folder: str) -> None:
    """Answers (key, prompt_version, model_id, image_path, detections) as text rows, one JSON document each, in folders by key."""
    body = F.to_json(F.struct("prompt_version", "model_id", "image_path", "detections"))
    answers.select("key", body.alias("value")).write.mode("errorifexists").partitionBy("key").text(folder)


def replay(requests: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their recorded detections, requests without any): by key, else by the legacy key."""
    own = recorded.select("key", F.col("detections").alias("__own"))
    old = recorded.select(F.col("key").alias("legacy_key"), F.col("detections").alias("__old"))
    rows = requests.join(own, "key", "left").join(old, "legacy_key", "left").withColumn("detections", F.coalesce("__own", "__old")).drop("__own", "__old")
    return rows.where("detections IS NOT NULL"), rows.where("detections IS NULL").drop("detections")


def cached(requests: DataFrame, folder: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A read-through cache of Parquet files: results for all requests, those that the folder lacks computed once and added to it. A lost task leaves nothing behind, as a write
    is committed whole; two runs at once may compute a key twice, so results are taken once a key."""
    spark = requests.sparkSession
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(folder)
    known = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    missing = requests.join(spark.read.parquet(folder).select(key), key, "left_anti") if known else requests
    compute(missing.dropDuplicates([key])).write.mode("append").parquet(folder)
    return requests.select(key).join(spark.read.parquet(folder).dropDuplicates([key]), key)


def truth_documents(events: DataFrame, by: str = "path") -> DataFrame:
    """(by, json): the truth document of each score, with its meter, notes (accidental only where there is one) and chords, in document order."""
    note = F.struct("measure", F.col("onset").alias("onset_beats"), F.col("duration").alias("duration_beats"), F.col("pitch").alias("pitch_midi"), "accidental")
    chord = F.struct("measure", F.col("onset").alias("onset_beats"), "symbol")
    placed = events.withColumn("__place", F.monotonically_increasing_id())
    ordered = lambda kind, one: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("__place", one.alias("e"))))), lambda x: x["e"])
    rows = placed.groupBy(by).agg(F.first("time_signature").alias("time_signature"), ordered("note", note).alias("notes"), ordered("chord", chord).alias("chords"))
    return rows.select(by, F.to_json(F.struct("time_signature", "notes", "chords")).alias("json"))


def existing_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name) of all files under a path, their contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def dataset(works: DataFrame, files: DataFrame, name: str = "pdf_path") -> tuple[DataFrame, DataFrame]:
    """(works with the path of their file, problems): works whose file isn't there, or is there more than once."""
    held = files.groupBy(F.col("name").alias(name)).agg(F.min("path").alias("path"), F.count("*").alias("__n"))
    rows = works.join(held, name, "left").withColumn("problem", F.when(F.col("path").isNull(), "missing file").when(F.col("__n") > 1, "several files"))
    return rows.where("problem IS NULL").drop("problem", "__n"), rows.where("problem IS NOT NULL").select("slug", "problem")


def resolved(paths: Column, root: str) -> Column:
    """Relative paths under a root, others as they are."""
    return F.when(F.startswith(paths, F.lit("/")) | paths.rlike("^[a-z0-9]+:/"), paths).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), paths))


def relative(paths: Column, root: str) -> Column:
    """Paths under a root told from there, others as they are."""
    head = root.rstrip("/") + "/"
    return F.when(F.startswith(paths, F.lit(head)), F.substring(paths, F.lit(len(head) + 1), F.length(paths))).otherwise(paths)


def markdown_catalog(works: DataFrame) -> DataFrame:
    """(text): a Markdown table of works (title, composer, rhythm, slug), one line a row, in order of title; signs that would break a table are escaped."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"([|\\])", r"\\$1")
    line = F.concat(F.lit("| "), cell("title"), F.lit(" | "), cell("composer"), F.lit(" | "), cell("rhythm"), F.lit(" | `"), F.col("slug"), F.lit("` |"))
    rows = works.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("title", "slug", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return rows.select(F.concat(F.lit("# Catalog\n\n| Title | Composer | Rhythm | Name |\n| --- | --- | --- | --- |\n"), "body", F.lit("\n")).alias("text"))


def stage_records(runs: DataFrame) -> DataFrame:
    """Records of stages (by work, stage, status, started_at, ended_at, error) with ISO times and their length; an empty error is none."""
    rows = runs.withColumn("duration_seconds", C.elapsed_seconds(F.col("started_at"), F.col("ended_at")))
    rows = rows.withColumn("error", C.blank_to_null(F.col("error")))
    return rows.withColumn("started_at", C.iso_time(F.col("started_at"))).withColumn("ended_at", C.iso_time(F.col("ended_at")))


def command_status(runs: DataFrame, command: str) -> DataFrame:
    """One row a command: how many works there were, succeeded and failed."""
    return runs.agg(F.lit(command).alias("command"), F.count("*").alias("total"), F.count(F.when(F.col("status") != "failed", 1)).alias("succeeded"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


def append_records(rows: DataFrame, path: str) -> None:
    """Add records to a lineage table of Parquet files."""
    rows.write.mode("append").parquet(path)


def variants(manifest: DataFrame, options: list[dict[str, str]], prompt: str = "prompt") -> DataFrame:
    """Every row of a manifest with every variant (a few), and its prompt with the variant's text after it."""
    spark = manifest.sparkSession
    some = spark.createDataFrame([(o["variant"], o.get("text", "")) for o in options], "variant string, __text string")
    rows = manifest.crossJoin(F.broadcast(some))
    return rows.select(*(c for c in manifest.columns if c != prompt), "variant", F.concat_ws("\n", prompt, C.blank_to_null(F.col("__text"))).alias(prompt))


def measure_crops(systems: DataFrame, by: list[str], edges: str = "edges") -> DataFrame:
    """(by, system_measure_index from 1, global_measure_index from 1, left, right): crops between the neighbouring edges (an array of fractions) of systems in order (column system_index)."""
    from pyspark.sql import Window as W

    counted = systems.withColumn("__n", F.greatest(F.size(edges) - 1, F.lit(0)))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("system_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = counted.withColumn("__before", before).select(*by, "system_index", "__before", F.posexplode(F.slice(edges, 1, F.col("__n").cast("int"))).alias("__k", "left"), F.col(edges).alias("__e"))
    return rows.select(*by, "system_index", (F.col("__k") + 1).alias("system_measure_index"), (F.col("__before") + F.col("__k") + 1).alias("global_measure_index"), "left", F.get("__e", F.col("__k") + 1).alias("right"))


def freeze(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """Write the manifest (name, bytes, sha256) of every file under a path; it must not exist yet."""
    file_manifest(spark, path).write.mode("errorifexists").parquet(manifest)
    return spark.read.parquet(manifest)


def verify(spark: SparkSession, path: str, manifest: str) -> DataFrame:
    """(name, problem) of files under a path that differ from a frozen manifest; empty if every byte is as it was."""
    return differences(spark.read.parquet(manifest), file_manifest(spark, path))


def publish(df: DataFrame, path: str) -> None:
    """Write a table where nothing is yet: first beside it, then moved in one step, so readers see all or nothing. A path that exists is an error."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".unpublished")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(beside.toString())
    if files.exists(target) or not files.rename(beside, target):
        raise FileExistsError(path)


def external(requests: DataFrame, content: str, command: list[str], suffix: str, *, out_suffix: str, timeout: float = 600.0, check: Callable[[bytes], None] | None = None) -> DataFrame:
    """Requests with the output of a program run on each row's content: `output` (bytes), or `error`. The command gets the input's path for {input} and an empty folder for
    {folder}; its output is the one file there that ends in `out_suffix`, which `check` may refuse by raising. Files are the task's own and gone when a row is done."""

    def once(blob: bytes) -> tuple[bytes | None, str | None]:
        with tempfile.TemporaryDirectory() as folder:  # private to this row, nothing else reads it
            source, target = os.path.join(folder, "input" + suffix), os.path.join(folder, "out")
            os.mkdir(target)
            with open(source, "wb") as file:
                file.write(blob)
            try:
                done = subprocess.run([x.format(input=source, folder=target) for x in command], capture_output=True, timeout=timeout, check=False)
            except (OSError, subprocess.TimeoutExpired) as failure:
                return None, type(failure).__name__
            made = sorted(os.path.join(d, f) for d, _, names in os.walk(target) for f in names if f.endswith(out_suffix))
            if done.returncode or len(made) != 1:
                return None, f"exit {done.returncode}, {len(made)} outputs"
            with open(made[0], "rb") as file:
                out = file.read()
            try:
                if check:
                    check(out)
            except ValueError as failure:
                return None, str(failure)
            return out, None

    def run(batches):
        for batch in batches:
            results = [once(bytes(x)) if x is not None else (None, "no input") for x in batch.column(batch.schema.get_field_index(content)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in results], pa.binary()), pa.array([r[1] for r in results], pa.string())], names=[*batch.schema.names, "output", "error"])

    return requests.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", output binary, error string")


def score_backend(requests: DataFrame, fixtures: DataFrame, key: str = "slug") -> DataFrame:
    """The replaying backend: requests with the stored score of their key as `output` if it can be read, else an `error`."""
    from .scores import score_events

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for blob in batch.column(batch.schema.get_field_index("content")).to_pylist():
                try:
                    if blob is None:
                        raise ValueError("no stored score")
                    list(score_events(bytes(blob)))
                    out.append(bytes(blob))
                    errors.append(None)
                except Exception as failure:  # noqa: BLE001 - whatever is wrong with a file is that row's error
                    out.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "content"), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[*(n for n in batch.schema.names if n != "content"), "output", "error"])

    rows = requests.join(fixtures.select(key, "content"), key, "left")
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "content") + ", output binary, error string")


def external_many(requests: DataFrame, content: str, command: list[str], suffix: str, *, out_suffix: str, timeout: float = 600.0) -> DataFrame:
    """The same for a program that writes several files: `outputs` (name, content) in order of name, or `error`."""

    def once(blob: bytes) -> tuple[list[dict] | None, str | None]:
        with tempfile.TemporaryDirectory() as folder:
            source, target = os.path.join(folder, "input" + suffix), os.path.join(folder, "out")
            os.mkdir(target)
            with open(source, "wb") as file:
                file.write(blob)
            try:
                done = subprocess.run([x.format(input=source, folder=target) for x in command], capture_output=True, timeout=timeout, check=False)
            except (OSError, subprocess.TimeoutExpired) as failure:
                return None, type(failure).__name__
            if done.returncode:
                return None, f"exit {done.returncode}"
            out = []
            for name in sorted(n for n in os.listdir(target) if n.endswith(out_suffix)):
                with open(os.path.join(target, name), "rb") as file:
                    out.append({"name": name, "content": file.read()})
            return out, None

    def run(batches):
        kind = pa.list_(pa.struct([("name", pa.string()), ("content", pa.binary())]))
        for batch in batches:
            results = [once(bytes(x)) if x is not None else (None, "no input") for x in batch.column(batch.schema.get_field_index(content)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r[0] for r in results], kind), pa.array([r[1] for r in results], pa.string())], names=[*batch.schema.names, "outputs", "error"])

    return requests.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", outputs array<struct<name:string,content:binary>>, error string")


def render_pages(documents: DataFrame, dpi: int = 300, **options) -> DataFrame:
    """PDF documents (column content) with their pages as grey pictures, by the program pdftoppm on every machine."""
    return external_many(documents, "content", ["pdftoppm", "-gray", "-r", str(dpi), "{input}", "{folder}/page"], ".pdf", out_suffix=".pgm", **options)


def split_pages(documents: DataFrame, **options) -> DataFrame:
    """PDF documents (column content) with one PDF for each page, by the program pdfseparate on every machine."""
    return external_many(documents, "content", ["pdfseparate", "{input}", "{folder}/page-%05d.pdf"], ".pdf", out_suffix=".pdf", **options)


def previews(tunes: DataFrame, text: str = "abc", programs: tuple[tuple[str, ...], ...] = (("abcm2ps", "-g", "-O", "{folder}/out.svg", "{input}"),)) -> DataFrame:
    """Tunes with a picture in SVG: of the first program that can draw them, else a plain one with their title."""
    rows = tunes.withColumn("__blob", F.col(text).cast("binary")).withColumn("svg", F.lit(None).cast("string"))
    for command in programs:
        rows = external(rows, "__blob", list(command), ".abc", out_suffix=".svg", timeout=60.0)
        rows = rows.withColumn("svg", F.coalesce("svg", F.col("output").cast("string"))).drop("output", "error")
    title = F.regexp_replace(F.regexp_replace(F.coalesce(C.blank_to_null(F.regexp_extract(text, "(?m)^T:[ \t]*(.*)$", 1)), F.lit("untitled")), "&", "&amp;"), "<", "&lt;")
    plain = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="600" height="60"><text x="10" y="35">'), title, F.lit("</text></svg>"))
    return rows.withColumn("drawn", F.col("svg").isNotNull()).withColumn("svg", F.coalesce("svg", plain)).drop("__blob")


def html_table(df: DataFrame, title: str) -> str:
    """A page with a table of a report's rows (a few, as reports are aggregates), in order of its columns."""
    from html import escape

    rows = df.orderBy(*df.columns).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a page is for reports of at most 10,000 rows")
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table>{cells('th', df.columns)}{''.join(cells('td', r) for r in rows)}</table>"


def apply_revisions(history: DataFrame, edits: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(new revisions, conflicts) of edits (by, base_sha256, content, edited_at) on a history (by, revision, sha256, previous_sha256): an edit counts if it was made on the latest revision, of several
    the first; the others must look at what changed. Work without history starts at revision 1 on no base."""
    from pyspark.sql import Window as W

    latest = history.groupBy(by).agg(F.max_by(F.struct("revision", "sha256"), "revision").alias("__l"))
    first = F.row_number().over(W.partitionBy(by, "base_sha256").orderBy("edited_at", F.sha2("content", 256)))
    rows = edits.withColumn("__k", first).join(latest, by, "left")
    good = F.col("base_sha256").eqNullSafe(F.col("__l.sha256")) & (F.col("__k") == 1)
    new = rows.where(good).select(by, (F.coalesce("__l.revision", F.lit(0)) + 1).alias("revision"), F.sha2("content", 256).alias("sha256"), F.col("__l.sha256").alias("previous_sha256"), "content")
    return new, rows.where(~good).select(*edits.columns)


def backup(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Every file under a path with its name, content and hash as one table, which must not exist yet."""
    root = path.split("://", 1)[-1].rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files.select(F.substring_index("path", root, -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content").write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def backup_problems(spark: SparkSession, path: str, target: str) -> DataFrame:
    """(name, problem): contents of a backup that don't have their hash, and files under the path that it lacks or holds otherwise."""
    held = spark.read.parquet(target)
    broken = held.where(F.sha2("content", 256) != F.col("sha256")).select("name", F.lit("broken in the backup").alias("problem"))
    return broken.unionByName(differences(held.select("name", "bytes", "sha256"), file_manifest(spark, path)))


#: Ways of getting a score from a page: a stored one, or a program on every machine.
BACKENDS: dict[str, Callable[..., DataFrame]] = {
    "fixture": score_backend,
    "homr": lambda pages, **options: external(pages, "content", ["homr", "{input}", "-o", "{folder}"], ".png", out_suffix=".musicxml", **options),
    "audiveris": lambda pages, **options: external(pages, "content", ["audiveris", "-batch", "-export", "-output", "{folder}", "{input}"], ".png", out_suffix=".mxl", **options),
}


def backend(name: str) -> Callable[..., DataFrame]:
    """A backend by name; an unknown one is an error."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}, known are {', '.join(BACKENDS)}")
    return BACKENDS[name]


def canonical_json(value: object) -> str:
    """Compact JSON with sorted keys, ASCII only, without NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def ask(requests: DataFrame, connect: Callable[[], Callable[[dict], str]], *, retries: int = 2) -> DataFrame:
    """Requests with a live source's `answer`, or its `error` after some tries, and how many `tries` it took. `connect` makes a client once in a task: a function from a request's columns to the
    text of its answer. What a source may cost is for it, or for a ledger of the requests, to bound; answers are kept by a read-through cache."""

    def run(batches):
        client = connect()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                answer = error = None
                for tries in range(1, retries + 2):
                    try:
                        answer, error = client(row), None
                        break
                    except Exception as failure:  # noqa: BLE001 - whatever a source says is that row's error
                        error = f"{type(failure).__name__}: {failure}"
                out.append((answer, error, tries))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int32())], names=[*batch.schema.names, "answer", "error", "tries"])

    return requests.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", answer string, error string, tries int")
