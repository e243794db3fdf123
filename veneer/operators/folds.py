"""Fold assignment as a row property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions.draws import draw_word
from veneer.operators.ordering import global_rank


def dense_fold(key: str, k: int = 5) -> Column:
    """Round-robin fold of an id that already runs 0..N-1: no shuffle at all."""
    return F.pmod(F.col(key), F.lit(k)).cast("int")


def hashed_fold(key: str, k: int = 5, seed: int = 0) -> Column:
    """Fold from the group's hash: no shuffle, sizes equal only on average."""
    return F.pmod(draw_word(seed, "fold", key), F.lit(k)).cast("int")


def grouped_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Round-robin over the ordered distinct groups: sizes differ by at most one group."""
    ranked = global_rank(df.select(group).distinct(), [group], name="__g")
    folds = ranked.select(group, F.pmod(F.col("__g") - 1, F.lit(k)).cast("int").alias("fold"))
    return df.join(folds, group)


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Shuffled round-robin inside each label."""
    shuffled = df.withColumn("__draw", draw_word(seed, "fold", key))
    ranked = global_rank(shuffled, ["__draw", key], by=[label], name="__r")
    return ranked.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r", "__draw")
