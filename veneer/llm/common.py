"""What several operators share: row identity, materialised columns, shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veneer.session import cut_lineage, scratch_path

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator needs, under fixed names; other columns, whatever they are called, are pruned."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def materialised(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Adds columns that later expressions may read many times without being computed again.

    A generator over a one-element array is a fence the optimizer doesn't inline expressions across.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select(*keep, made).select(*keep, *[F.col("_made")[n].alias(n) for n in columns])


def crc_of_id(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary"))


__all__ = ["SPACE_CLASS", "crc_of_id", "cut_lineage", "materialised", "scratch_path", "table", "texts", "words_of"]
