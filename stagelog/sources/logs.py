"""Reading logs, position maps, backlash logs and image metadata (A1–A5, A10).

Logs are split by lines or by closing braces, so even one huge array or object
file is read by many tasks.  Nothing relies on schema inference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stagelog.functions.rows import normalise_steps
from stagelog.functions.units import with_filename
from stagelog.operators.ordered import dense_position
from stagelog.schema import BACKLASH_FLAT, BACKLASH_NESTED, POSITION_VALUE, RAW_STEP, STREAM_STEP
from stagelog.session import cut_lineage
from stagelog.sources.folders import folder_pieces


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")


def _pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """Text pieces with their file, its block and their order inside the block."""
    found = folder_pieces(spark, path, separator)
    return found if found is not None else (
        spark.read.option("lineSep", separator).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"))
        .withColumn("piece", F.monotonically_increasing_id()))


def detect_layout(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A1: the format of every file: ``empty``, ``json-array``, ``json-object`` or ``jsonl``."""
    lines = _pieces(spark, path, "\n").withColumn("text", F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", ""))
    full = F.col("text") != ""
    stats = lines.groupBy("file").agg(
        F.count_if(full).alias("lines"), F.count_if(F.col("text").startswith("{")).alias("opening"),
        F.min_by("text", F.when(full, F.struct("block", "piece"))).alias("first"))
    first = F.col("first")
    layout = (
        F.when(F.col("lines") == 0, "empty").when(first.startswith("["), "json-array")
        .when((F.col("lines") == 1) & first.startswith("{"), "json-object")
        .when(first.endswith("}") | (F.col("opening") > 1) | ~first.startswith("{"), "jsonl")
        .otherwise("json-object"))
    return stats.select("file", layout.alias("layout"))


def _parse(pieces: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Records and malformed pieces; ``strict`` fails on the first malformed piece."""
    field = "__bad"
    schema = T.StructType([*RAW_STEP.fields, T.StructField(field, T.StringType())])
    parsed = pieces.withColumn("r", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": field}))
    # The layout takes part in the test so that no check runs before files are told apart.
    wrong = (F.col("layout") != "") & (
        F.col(f"r.{field}").isNotNull() | F.col("r").isNull() | ~F.col("text").startswith("{"))
    if mode == "strict":  # checked where the record is made: a filter would parse it once more for every mention
        message = F.concat(F.lit("malformed record in "), F.col("file"), F.lit(": "), F.col("text"))
        parsed = parsed.withColumn("r", F.when(wrong, F.raise_error(message)).otherwise(F.col("r")))
        return parsed, pieces.limit(0).select("file", "text")
    if mode != "permissive":
        raise ValueError(f"unknown mode {mode!r}")
    return parsed.where(~wrong), parsed.where(wrong).select("file", "text")


def _records(spark: SparkSession, files: DataFrame | None, path, separator: str) -> DataFrame:
    pieces = _pieces(spark, path, separator)
    if files is not None:
        pieces = pieces.join(files, "file")
    else:
        pieces = pieces.withColumn("layout", F.col("file"))
    if separator == "\n":
        bare = F.col("value").startswith("{") & F.col("value").endswith("}")
        text = F.when(bare, F.col("value")).otherwise(F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", ""))
        return pieces.where(F.col("value").rlike(r"[^\s\x{FEFF}]")).withColumn("text", text)
    body = F.regexp_replace("value", r"^[\s\x{FEFF},\[]+", "")
    closed = ~body.rlike(r"^[\s\]]*$")
    return pieces.where(closed).withColumn("text", F.concat(body, F.lit("}")))


def read_steps(
    spark: SparkSession, path: str | list[str], mode: str = "strict", layout: str = "auto",
    run_from: str = "file",
) -> DataFrame:
    """A1, A2, B1, B2: measurement logs as rows, ``run_id`` from the file name.

    With ``run_from="folder"`` the files of one folder, in name order, are one
    run, named by the folder (the part after ``=``).

    ``layout`` skips detection when every file is known to be ``jsonl`` or
    ``json`` (arrays or objects of flat records, split at closing braces).
    ``permissive`` skips malformed records: see :func:`skipped_records`.
    """
    # a position is counted and then scanned: files are opened once, the records they gave are read twice
    good = cut_lineage(_read(spark, path, mode, layout)[0].withColumn("run_id", _run_of(F.col("file"), run_from)).select("run_id", "file", "block", "piece", "r"))
    keys = ["run_id"] if run_from == "folder" else ["run_id", "file"]
    rows = dense_position(good, keys, "piece", "source_index", chunk=F.struct("file", "block"))
    rows = rows.select("run_id", "source_index",
                       *[F.col(f"r.{n}").alias(n) for n in RAW_STEP.fieldNames()])
    rows = rows.withColumns({
        "step_text": F.col("step"), "confidence_text": F.col("confidence"),
        "event_time": F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint"))})
    return with_filename(normalise_steps(rows))


def read_segment_lines(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The lines that ``write_segments`` wrote, as ``schema`` with ``run_id`` and ``segment_file``."""
    keys = ("run_id", "segment_file")
    lines = folder_pieces(spark, out + "/*/*/*.json", "\n", keys)
    if lines is None:
        return spark.read.schema(", ".join([schema, *[f"{k} string" for k in keys]])).json(out)
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return lines.where(F.trim("value") != "").select(row.alias("r"), *keys).select("r.*", *keys)


def skipped_records(spark: SparkSession, path: str | list[str], layout: str = "auto") -> DataFrame:
    """A2: the malformed records a permissive read leaves out, with their file."""
    return _read(spark, path, "permissive", layout)[1]


def _run_of(file: Column, run_from: str) -> Column:
    if run_from == "folder":
        return F.substring_index(F.substring_index(F.substring_index(file, "/", -2), "/", 1), "=", -1)
    return _stem(file)


def _read(spark, path, mode, layout) -> tuple[DataFrame, DataFrame]:
    if layout == "auto":
        kinds = detect_layout(spark, path)
        lines = _parse(_records(spark, kinds.where("layout = 'jsonl'"), path, "\n"), mode)
        whole = _parse(_records(spark, kinds.where("layout LIKE 'json-%'"), path, "}"), mode)
        good, bad = lines[0].unionByName(whole[0]), lines[1].unionByName(whole[1])
    elif layout in ("jsonl", "json"):
        good, bad = _parse(_records(spark, None, path, "\n" if layout == "jsonl" else "}"), mode)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return good, bad


def read_positions(spark: SparkSession, path: str | list[str], run_from: str = "file") -> DataFrame:
    """A3: position entries keyed by file name; anything but an object of objects is an error.

    ``entry`` follows the order in the file, so the last of two equal names can win; with ``run_from="folder"``
    it goes on from file to file of the folder, in name order.
    """
    blank = F.col("value").rlike(r"^[\s\x{FEFF}]*\{?\s*$")
    pieces = _pieces(spark, path, "}").where(~blank)
    head = F.regexp_extract("value", r'^[\s\x{FEFF}]*[{,]\s*"(?:[^"\\]++|\\.)*+"\s*:\s*(?=\{)', 0)
    rows = pieces.withColumn("head", head)
    value = F.from_json(F.concat(F.col("value").substr(F.length("head") + 1, F.length("value")), F.lit("}")), POSITION_VALUE)
    strange = F.raise_error(F.concat(F.lit("not a positions object: "), F.col("file")))
    quoted = F.regexp_extract("head", r'(?s)"(.*)"', 1)
    rows = rows.withColumns({"p": F.when(F.col("head") == "", strange).otherwise(value), "quoted": quoted})
    bare = F.raise_error(F.concat(F.lit("no numeric confidence: "), F.col("value")))
    name = F.when(F.col("quoted").rlike(r"[\\\x00-\x1f]"), F.from_json(F.concat(F.lit('{"k":"'), F.col("quoted"), F.lit('"}')), "k string")["k"]).otherwise(F.col("quoted"))
    # checked where the values are made: a filter would make them once more for every mention
    rows = cut_lineage(rows.select(
        _run_of(F.col("file"), run_from).alias("run_id"), name.alias("filename"), "file", "block", "piece",
        F.when(F.col("p.confidence").isNull(), bare).otherwise(F.col("p")).alias("p")))
    keys = ["run_id"] if run_from == "folder" else ["run_id", "file"]
    rows = dense_position(rows, keys, "piece", "entry", chunk=F.struct("file", "block"))
    return rows.select("run_id", "filename", "entry", "p.*")


def read_backlash(spark: SparkSession, path: str | list[str], layout: str = "flat") -> DataFrame:
    """A4: flat backlash lines, or nested pretty-printed objects with one row per sub-step."""
    run = _stem(F.col("_metadata.file_path")).alias("run_id")
    if layout == "flat":
        out = spark.read.schema(BACKLASH_FLAT).json(path, mode="FAILFAST").select(run, "*")
        return out.withColumn("conf", F.col("conf").try_cast("double"))
    if layout != "nested":
        raise ValueError(f"unknown layout {layout!r}")
    objects = spark.read.option("lineSep", "\n}").text(path).select(run, "value")
    task = F.when(~F.col("value").rlike(r"^\s*$"), F.from_json(
        F.concat("value", F.lit("\n}")), BACKLASH_NESTED, {"mode": "FAILFAST"}))
    tasks = objects.select("run_id", task.alias("t")).where("t IS NOT NULL").select("run_id", "t.*")
    outer = [F.col(c).alias(f"task_{c}" if c not in ("task_id", "total_tasks", "steps") else c)
             for c in tasks.columns if c not in ("run_id", "sub_history")]
    rows = tasks.select("run_id", *outer, F.posexplode("sub_history").alias("seq", "s")).select(
        "run_id", *[c for c in tasks.columns if c in ("task_id", "total_tasks", "steps")],
        "task_x_target", "task_y_target", "task_r_target", "task_move", "seq", "s.*")
    return rows.withColumns({
        "is_final": F.col("step") == "final", "step": F.col("step").try_cast("int"),
        "conf": F.col("conf").try_cast("double")})


def read_image_meta(spark: SparkSession, path: str | list[str], glob: str = "*.txt") -> DataFrame:
    """A5: pixel size and frame size from UTF-16 key/value sidecars."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path)
    return image_meta(files.select("path", F.decode("content", "UTF-16").alias("text")))


def image_meta(texts: DataFrame) -> DataFrame:
    """A5: typed values from sidecar texts (``path``, ``text``)."""
    section = F.regexp_extract("text", r"(?s)\[SemImageFile\]\s*(.*?)(?=\n\s*\[|$)", 1)

    def value(key: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(section, rf"(?mi)^\s*{key}\s*[=:]\s*{pattern}", 1), F.lit(""))

    return texts.select(
        "path", value("PixelSize", r"([0-9.eE+-]+)").try_cast("double").alias("pixel_size"),
        value("DataSize", r"(\d+)\s*x").try_cast("int").alias("width"),
        value("DataSize", r"\d+\s*x\s*(\d+)").try_cast("int").alias("height"))


def read_steps_stream(spark: SparkSession, path: str, max_files: int = 1, schema=None) -> DataFrame:
    """A10: the append-only log as a stream, a bounded number of files per trigger."""
    return spark.readStream.schema(schema or STREAM_STEP).option("maxFilesPerTrigger", max_files).json(path)
