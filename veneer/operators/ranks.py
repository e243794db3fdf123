"""Rank agreement between model accuracies on the full set and on subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _average_rank(by: list[str], value: str):
    order, ties = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2


def concordance(table: DataFrame, by: list[str], full: str, sub: str) -> DataFrame:
    """(by..., balance): concordant minus discordant item couples, without forming couples.

    Items get a dense rank by ``full``. Two different ranks first differ at exactly one bit,
    so at every bit level the items that share the higher bits are split into a lower and an
    upper half, and each upper item counts the lower items below and above it in ``sub``.
    That is n log n rows instead of n squared.
    """
    dense = F.dense_rank().over(Window.partitionBy(*by).orderBy(full)) - 1
    ranked = (table.select(*by, F.col(sub).alias("__s"), dense.alias("__d"))
              .withColumn("__top", F.max("__d").over(Window.partitionBy(*by))))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest("__top", F.lit(1)))).cast("int"))
    split = (ranked.withColumn("__level", F.explode(levels))
             .withColumn("__half", F.expr("shiftright(__d, __level + 1)"))
             .withColumn("__low", 1 - F.expr("shiftright(__d, __level) & 1")))
    group = [*by, "__level", "__half"]
    low = F.sum("__low")
    upto = low.over(Window.partitionBy(*group).orderBy("__s"))  # ties of __s included
    same = low.over(Window.partitionBy(*group, "__s"))
    every = low.over(Window.partitionBy(*group))
    # below minus above
    balance = F.when(F.col("__low") == 0, (upto - same) - (every - upto)).otherwise(0)
    return split.withColumn("__b", balance).groupBy(*by).agg(F.sum("__b").alias("balance"))


def rank_agreement(table: DataFrame, by: list[str], full: str = "acc_full", sub: str = "acc_sub") -> DataFrame:
    """Spearman and Kendall tau-b per group; NULL below two items or without variation."""
    tied = lambda c: (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2
    ranked = table.select(*by, _average_rank(by, full).alias("__rf"), _average_rank(by, sub).alias("__rs"),
                          tied(full).alias("__tf"), tied(sub).alias("__ts"))
    n = F.count(F.lit(1)).cast("double")
    # not corr(): without variation it divides by zero, which is an error in ANSI mode
    rho = F.try_divide(F.covar_pop("__rf", "__rs"), F.stddev_pop("__rf") * F.stddev_pop("__rs"))
    couples = n * (n - 1) / 2
    facts = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_models"), rho.alias("spearman"),
        F.sqrt((couples - F.sum("__tf")) * (couples - F.sum("__ts"))).alias("__scale"))
    tau = F.try_divide(F.col("balance"), F.col("__scale"))
    two = F.col("n_models") >= 2
    return (facts.join(concordance(table, by, full, sub), by)
            .select(*by, "n_models", F.when(two, F.col("spearman")).alias("spearman"),
                    F.when(two, tau).alias("kendall")))
