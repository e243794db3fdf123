"""Sinks: feature tables, metric tables, subsets with metadata, guarded and resumable writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.operators.merge import unmatched


def write_features(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_table_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_subset_ids(members: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(subset_name, pair_id) as one folder per subset; ids of a large subset stay in many files."""
    members.select("subset_name", "pair_id").write.mode(mode).partitionBy("subset_name").json(path)


def subset_documents(members: DataFrame, metadata: DataFrame | None = None, max_ids: int = 1_000_000) -> DataFrame:
    """One JSON document per subset with its sorted ids and metadata.

    A document is one row, so it is refused for subsets above ``max_ids``; `write_subset_documents` writes the same
    documents of any size.
    """
    sizes = members.groupBy("subset_name").agg(F.count(F.lit(1)).alias("n_pairs"))
    widest = sizes.agg(F.max("n_pairs")).first()[0] or 0
    if widest > max_ids:
        raise ValueError(f"a subset holds {widest} ids; write it with write_subset_documents")
    docs = members.groupBy("subset_name").agg(F.array_sort(F.collect_list("pair_id")).alias("pair_ids"))
    out = docs.join(sizes, "subset_name")
    if metadata is not None:
        out = out.join(metadata, "subset_name", "left")
    fields = [c for c in out.columns if c != "subset_name"]
    return out.select("subset_name", F.to_json(F.struct(*fields)).alias("document"))


def _write_lines(lines: DataFrame, folder: str, order: list[str], path: str, mode: str) -> None:
    """Text files, one per value of ``folder``, with their lines in order. A task streams a file's lines, which are sorted
    on disk where they are many; it never holds a file."""
    ordered = lines.repartition(folder).sortWithinPartitions(folder, *order).select(folder, "value")
    ordered.write.mode(mode).partitionBy(folder).text(path)


def write_subset_documents(members: DataFrame, path: str, metadata: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """One JSON document per subset, as `subset_documents` has them, for subsets of any size: a line per id."""
    ids = members.select("subset_name", "pair_id").distinct()
    sizes = ids.groupBy("subset_name").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("pair_id").alias("__last"))
    named = sizes if metadata is None else sizes.join(metadata, "subset_name", "left")
    fields = [c for c in named.columns if c not in ("subset_name", "__last")]
    line = lambda df, part, at, value: df.select("subset_name", F.lit(part).alias("part"), at.cast("long").alias("at"), value.alias("value"))
    head = F.concat(F.regexp_replace(F.to_json(F.struct(*fields)), "[}]$", ""), F.lit(',"pair_ids":['))
    comma = F.when(F.col("pair_id") < F.col("__last"), ",").otherwise("")
    lines = (line(named, 0, F.lit(0), head)
             .unionByName(line(ids.join(sizes, "subset_name"), 1, F.col("pair_id"), F.concat(F.col("pair_id").cast("string"), comma)))
             .unionByName(line(sizes, 2, F.lit(0), F.lit("]}"))))
    _write_lines(lines, "subset_name", ["part", "at"], path, mode)


def write_json_arrays(df: DataFrame, path: str, key: str, files: int = 8, mode: str = "errorifexists") -> None:
    """Rows as JSON arrays in ``files`` files below ``path``, for readers that take arrays only; ``key`` is unique."""
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(files)).cast("int").alias("file"), F.col(key).alias("at"), F.to_json(F.struct(*df.columns)).alias("json"))
    last = rows.groupBy("file").agg(F.max("at").alias("__last"))  # a row per file
    comma = F.when(F.col("at") < F.col("__last"), ",").otherwise("")
    line = lambda d, part, value: d.select("file", F.lit(part).alias("part"), F.col("at"), value.alias("value"))
    ends = last.withColumn("at", F.col("__last"))
    lines = (line(ends, 0, F.lit("[")).unionByName(line(rows.join(F.broadcast(last), "file"), 1, F.concat("json", comma)))
             .unionByName(line(ends, 2, F.lit("]"))))
    _write_lines(lines, "file", ["part", "at"], path, mode)


def export_subset(pairs: DataFrame, flags: DataFrame, members: DataFrame) -> DataFrame:
    """Rows to publish: pair columns, style_violation, subset_name."""
    return (members.select("subset_name", "pair_id").join(pairs, "pair_id")
            .join(flags.select("pair_id", "style_violation"), "pair_id")
            .select(*pairs.columns, "style_violation", "subset_name"))


def filled_by_people(df: DataFrame, columns: list[str]) -> Column:
    return sum((F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0) for c in columns), F.lit(0)) > 0


def write_guarded(df: DataFrame, path: str, human_columns: list[str], overwrite: bool = False) -> str:
    """CSV write that never destroys work: refuses when a human column of the old file holds text."""
    from veneer.sources.readers import first_existing
    try:
        first_existing(df.sparkSession, [path])
    except FileNotFoundError:
        write_table_csv(df, path)
        return "written"
    old = df.sparkSession.read.options(header=True, multiLine=True, escape='"').csv(path)
    present = [c for c in human_columns if c in old.columns]
    if present and not old.filter(filled_by_people(old, present)).isEmpty():
        raise FileExistsError(f"{path} holds human input in {present}")
    if not overwrite:
        return "skipped"
    write_table_csv(df, path, "overwrite")
    return "overwritten"


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows left to process when an output already exists."""
    return unmatched(df, done, key)
