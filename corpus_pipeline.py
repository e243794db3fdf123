"""Corpus pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veneer.llm import op3_decontaminate, op7_bpe, op8_jaccard, op9_quality, op10_lines
from veneer.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base test and the rules' posterior accept."""
    return op9_quality.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document that loses its last word goes. n_chars follows the text."""
    out = op10_lines.dedup_lines(docs)
    emptied = (F.size("removed") > 0) & ~F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    new = {"text": F.col("kept_text"),
           "n_chars": F.when(F.size("removed") > 0, F.length("kept_text")).otherwise(F.col("doc.n_chars"))}
    return out.filter(~F.coalesce(emptied, F.lit(False))).select(
        *[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of links: that of the least id, null ids last.

    An id with two texts is two documents; of rows that repeat id and text one stays. Null and empty texts link with
    nothing; of those that share an id (or have none) one of each stays.
    """
    nodes = op8_jaccard.jaccard_nodes(docs)
    gone = nodes.filter("NOT keep").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    row = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_th": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = row.join(gone, F.col("_id").eqNullSafe(F.col("gone_id")) & (F.col("_th") == F.col("gone_th")), "left_anti")
    return kept.dropDuplicates(["_id", "_th"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; others stay, whatever id they share with one of these.

    Null and empty texts hold none.
    """
    hit = op3_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")
    hit = hit.select(F.col("doc_id").alias("hit_id"), "row_hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("row_hash"))
    return docs.join(hit, same, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with the digests of the ids and of what they decode to."""
    return op7_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each is written as Parquet below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Byte-level BPE has no SQL form; tests/llm compares the rows with a brute-force run of all stages.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
