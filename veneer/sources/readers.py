"""Readers with declared schemas and required-column checks."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.functions.text import strip
from veneer.operators.merge import first_positions
from veneer.operators.ordering import global_rank
from veneer.operators.reshape import require_columns

PAIR_COLUMNS = ("Type", "Category", "Question", "Best Answer", "Best Incorrect Answer")
PREDICTION_COLUMNS = ("model_name", "pair_id", "correct")
EXAMPLE_FILE = "example_model_predictions.csv"
_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
_INDEX = "__file", "__start", "__row"


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def path_below(root: str) -> Column:
    """Path of the source file below the fixed part of a glob: files of equal names in different folders stay apart."""
    fixed = []
    for part in root.split("://")[-1].split("/")[:-1]:
        if any(c in part for c in "*?[{"):
            break
        fixed.append(part)
    folder = "/".join(fixed) + "/"
    path = F.url_decode(F.regexp_replace("_metadata.file_path", "[+]", "%2B"))
    return F.regexp_replace(path, f"^.*?{re.escape(folder)}", "")


def _with_source_order(reader_df: DataFrame) -> DataFrame:
    """File, block and position of every row, as the source delivered it.

    Position inside one task is the only order text files have; block starts order the
    tasks of a split file.
    """
    return (reader_df.withColumn("__file", F.col("_metadata.file_path"))
            .withColumn("__start", F.col("_metadata.file_block_start"))
            .withColumn("__row", F.monotonically_increasing_id()))


def _numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Dense 0-based positions of rows in source order, given their file, block and place in the task.

    A block's rows are next to each other in the task that read it. Rows are counted per block, the counts are summed up
    over the blocks before, and every row adds its place: one number per block travels, never a row.
    """
    key = F.xxhash64("__file").alias("__f")
    blocks = ordered.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    shifts = blocks.select(key, F.col("__start"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    # three numbers per block of a file, whatever its rows
    placed = ordered.withColumn("__f", key).join(F.broadcast(shifts), ["__f", "__start"])
    return placed.withColumn(name, F.col("__row") + F.col("__shift")).drop("__f", "__shift", *_INDEX)


def with_row_ids(df: DataFrame, name: str = "pair_id") -> DataFrame:
    """Dense 0-based row positions in source order, assigned where the rows are read."""
    return _numbered(_with_source_order(df), name)


def read_pairs(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """Pair table from CSV with the known columns kept; ids from a column or the row position."""
    raw = spark.read.options(**_CSV).csv(path)
    kept = [c for c in PAIR_COLUMNS if c in raw.columns]
    require_columns(raw, ("Question", "Best Answer"), "pair table")
    if id_column:
        return raw.select(F.col(id_column).cast("long").alias("pair_id"), *[F.col(f"`{c}`") for c in kept])
    ided = with_row_ids(raw.select("*", "_metadata"))
    return ided.select("pair_id", *[F.col(f"`{c}`") for c in kept])


def first_existing(spark: SparkSession, paths) -> str:
    """First path that exists on its file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_labelled(spark: SparkSession, paths, required, schema: str | None = None) -> DataFrame:
    """Parquet, JSON array, JSON lines or CSV by suffix; the first existing candidate wins."""
    path = first_existing(spark, [paths] if isinstance(paths, str) else paths)
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema and suffix != "parquet" else spark.read
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix == "json":
        df = reader.json(path, multiLine=True)
    elif suffix in ("jsonl", "ndjson"):
        df = reader.json(path)
    elif suffix == "csv":
        df = reader.options(**_CSV).csv(path)
    else:
        raise ValueError(f"unknown file type: {path}")
    return require_columns(df, required, path)


# fixed values: class names of the claim files
CLAIM_CLASSES = {"SUPPORTS": 1, "SUPPORTED": 1, "REFUTES": 0, "REFUTED": 0}


def read_claims(spark: SparkSession, path: str, dedup: bool = True) -> DataFrame:
    """(row_id, claim_text, label) from JSON lines; first-seen claims only, ids dense afterwards.

    With ``dedup`` the texts are compared by digests that carry positions; the ids are ranks of the positions that stay.
    """
    raw = spark.read.schema("claim string, label string").json(path).select("*", "_metadata")
    name = F.upper(strip(F.coalesce("label", F.lit(""))))
    table = F.create_map(*[F.lit(x) for kv in CLAIM_CLASSES.items() for x in kv])
    rows = raw.select(strip(F.coalesce("claim", F.lit(""))).alias("claim_text"), F.try_element_at(table, name).alias("label"), "_metadata")
    rows = _with_source_order(rows.filter(F.col("label").isNotNull() & (F.col("claim_text") != "")))
    if not dedup:
        return _numbered(rows, "row_id").select("row_id", "claim_text", "label")
    placed = _numbered(rows, "__at")
    first = first_positions(placed, "claim_text", "__at")
    ids = global_rank(first, ["__at"], name="__i")
    return placed.join(ids, "__at").select((F.col("__i") - 1).alias("row_id"), "claim_text", "label")


def read_records(spark: SparkSession, path: str, key: str, schema: str, expect: int | None = None,
                 lines: bool = False) -> DataFrame:
    """Records of JSON arrays (or JSON lines); the count must be ``expect`` and ids unique."""
    df = spark.read.schema(schema).json(path, multiLine=not lines)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids")).first()
    if expect is not None and stats["n"] != expect:
        raise ValueError(f"{path}: expected {expect} records, got {stats['n']}")
    if stats["ids"] != stats["n"]:
        raise ValueError(f"{path}: {key} is not unique")
    return df


# fixed values: nested layout of bilateral pair files
BILATERAL_SCHEMA = (
    "pair_id long, "
    "A_side struct<statement string, truth_label string, surface_profile string, topic string, "
    "judge_agrees_true boolean, judge_confidence double>, "
    "B_side struct<statement string, truth_label string, surface_profile string, topic string, "
    "judged_false boolean, judge_confidence double, judge_disagreement_flag boolean>, "
    "pair_constraints struct<word_count_delta_B_minus_A int, delta_ok_ge_8 boolean, same_topic boolean>")


def read_jsonl(spark: SparkSession, path: str, schema: str = BILATERAL_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_predictions(spark: SparkSession, glob: str, fallback: str | None = None,
                     exclude: str = EXAMPLE_FILE) -> DataFrame:
    """(source_file, row_no, model_name, pair_id, correct) of all matching files but the example.

    `source_file` is the path below the glob's fixed folder.
    """
    def load(pattern: str) -> DataFrame:
        raw = spark.read.options(header=True).csv(pattern)
        require_columns(raw, PREDICTION_COLUMNS, pattern)
        return (raw.select(*PREDICTION_COLUMNS, "_metadata")
                .select(path_below(pattern).alias("source_file"), file_name().alias("__name"),
                        F.struct(F.col("_metadata.file_block_start").alias("block"),
                                 F.monotonically_increasing_id().alias("row")).alias("row_no"),
                        "model_name", F.col("pair_id").cast("long").alias("pair_id"),
                        F.col("correct").cast("int").alias("correct"))
                .filter(F.col("__name") != exclude).drop("__name"))
    try:
        found = load(glob)
        if fallback is None or not found.isEmpty():
            return found
    except Exception as error:  # a glob without files
        if fallback is None or "PATH_NOT_FOUND" not in str(error):
            raise
    return load(fallback)


def first_lines(spark: SparkSession, paths: list[str], n: int = 2, readers: int = 16) -> list[tuple]:
    """(path, line 1, ... line n) of each file, None where it has fewer; the rest of a file is never read.

    Files are opened through the file system of their path, several at a time.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def head(path: str) -> tuple:
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        stream = p.getFileSystem(conf).open(p)
        try:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"), 4096)
            return (path, *[lines.readLine() for _ in range(n)])
        finally:
            stream.close()

    with ThreadPoolExecutor(readers) as pool:
        return list(pool.map(head, paths))


def discover_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(path, model_name, is_prediction) of every CSV below a folder, by its header line.

    Only the first two lines of a file are read, however long it is; empty files have no header and are left out.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).inputFiles()
    found = [r for r in first_lines(spark, files) if r[1] is not None]  # two lines per file
    lines = spark.createDataFrame(found, "path string, header string, first_row string")
    fields = F.transform(F.split("header", ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    position = F.array_position(fields, F.lit("model_name")).cast("int")
    cells = F.split("first_row", ",")
    return lines.select(
        "path", (F.size(F.array_intersect(fields, F.array(*[F.lit(c) for c in PREDICTION_COLUMNS]))) == 3).alias("is_prediction"),
        F.when(position > 0, F.try_element_at(cells, position)).alias("model_name"))


def slug(text: Column) -> Column:
    """File-name form: white space and other characters become one underscore, none at the ends."""
    dashed = F.regexp_replace(strip(text), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(dashed, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def seed_of(path: Column) -> Column:
    """Digits after the word seed, else the first standalone number of 2 to 4 digits, else NULL."""
    named = F.regexp_extract(path, r"(?:seed|SEED)(\d+)", 1)
    alone = F.regexp_extract(path, r"(?<![\p{L}\p{N}_])(\d{2,4})(?![\p{L}\p{N}_])", 1)
    text = F.when(named != "", named).when(alone != "", alone)
    return text.cast("long")


def run_tag(path: Column, model: Column) -> Column:
    """Name under which a discovered prediction file is imported."""
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("run"))
    seed = seed_of(path)
    part = F.when(seed.isNotNull(), F.concat(F.lit("_seed"), seed.cast("string"))).otherwise("")
    return F.concat(F.lit("model_predictions_"), slug(model), part, F.lit("_"), slug(folder), F.lit(".csv"))


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """(subset_file, pair_id) from id lists: a bare JSON array or an object with ``pair_ids``."""
    docs = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(file_name(), "\\.json$", "").alias("subset_file"), strip(F.col("value")).alias("doc"))
    listed = F.when(F.startswith("doc", F.lit("[")), F.from_json("doc", T.ArrayType(T.LongType()))).otherwise(
        F.from_json("doc", "pair_ids array<bigint>")["pair_ids"])
    return docs.select("subset_file", F.explode(listed).alias("pair_id"))


_SIZE_COLUMNS = ("retained_pairs", "pruned_pair_count", "target_kept_count")
_AUC_COLUMNS = ("mean_heldout_auc", "grouped_cv_oof_auc")
_ACC_COLUMNS = ("grouped_cv_oof_accuracy",)


def read_manifest(spark: SparkSession, paths, families: dict[str, str] | None = None) -> DataFrame:
    """Subset manifests with differing columns on one shape; blank cells fall through, bad numbers are NULL."""
    frame = None
    for path in paths:
        part = spark.read.options(header=True).csv(path).withColumn("manifest_path", F.lit(path))
        frame = part if frame is None else frame.unionByName(part, allowMissingColumns=True)

    def number(names):
        found = [F.nullif(F.trim(n), F.lit("")).try_cast("double") for n in names if n in frame.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("double")
    name, target = F.trim("subset_name"), F.trim("canonical_json")
    return (frame.select(name.alias("subset_name"), subset_family(name, families or {}).alias("subset_family"),
                         "manifest_path", target.alias("canonical_json"),
                         number(_SIZE_COLUMNS).cast("long").alias("retained_pairs"),
                         number(_AUC_COLUMNS).alias("grouped_cv_auc"), number(_ACC_COLUMNS).alias("grouped_cv_accuracy"))
            .filter((F.coalesce("subset_name", F.lit("")) != "") & (F.coalesce("canonical_json", F.lit("")) != "")))


def subset_family(name: Column, prefixes: dict[str, str]) -> Column:
    """Family by the first matching name prefix, else other."""
    out = None
    for prefix, family in prefixes.items():
        cond = F.startswith(name, F.lit(prefix))
        out = F.when(cond, family) if out is None else out.when(cond, family)
    return F.lit("other") if out is None else out.otherwise("other")


def read_commented_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a preamble of # lines."""
    reader = spark.read.options(header=True, comment="#")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_vectors(spark: SparkSession, path: str, vector: str = "embedding") -> DataFrame:
    df = require_columns(spark.read.parquet(path), (vector,), path)
    kind = df.schema[vector].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{vector} is {kind.simpleString()}, expected an array")
    return df
