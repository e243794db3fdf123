"""Do subsets keep the ranking of models?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.operators import merge
from veneer.operators.ranks import rank_agreement
from veneer.operators.single import attach
from veneer.session import cut_lineage


def subset_accuracies(merged: DataFrame, common: DataFrame, members: DataFrame) -> DataFrame:
    """(subset_name, model_name, acc_full, acc_sub, eval_pairs) on pairs every model answered."""
    right = (F.col("correct") == 1).cast("double")
    scored = merged.join(common, "pair_id", "left_semi").select("model_name", "pair_id", right.alias("right"))
    full = scored.groupBy("model_name").agg(F.avg("right").alias("acc_full"))
    sub = (scored.join(members.select("subset_name", "pair_id").distinct(), "pair_id")
           .groupBy("subset_name", "model_name")
           .agg(F.avg("right").alias("acc_sub"), F.count(F.lit(1)).alias("eval_pairs")))
    return sub.join(full, "model_name")


def rank_report(preds: DataFrame, members: DataFrame, n_pairs: int | Column, manifest: DataFrame | None = None,
                within_file: str = "first") -> DataFrame:
    """One row per subset; a subset without common pairs keeps its row with an error text."""
    merged = merge.merge_predictions(merge.bounded_ids(preds, n_pairs), within_file, "last")
    common = merge.common_pairs(merged)
    # one row per (subset, model), read by three aggregations: computed from the predictions once
    table = cut_lineage(subset_accuracies(merged, common, members))
    agreement = rank_agreement(table, ["subset_name"])
    pairs = table.groupBy("subset_name").agg(F.max("eval_pairs").alias("eval_pair_count"))
    sizes = members.groupBy("subset_name").agg(F.count_distinct("pair_id").alias("retained_pairs"))
    facts = common.agg(F.count(F.lit(1)).alias("intersection_n"))
    out = (sizes.join(agreement, "subset_name", "left").join(pairs, "subset_name", "left"))
    total = F.lit(n_pairs) if not isinstance(n_pairs, Column) else n_pairs
    out = (attach(out, facts)
           .withColumn("retained_fraction", F.try_divide(F.col("retained_pairs"), total))
           .withColumn("eval_pair_count", F.coalesce("eval_pair_count", F.lit(0)))
           .withColumn("error", F.when(F.col("eval_pair_count") == 0, "no pairs after intersection").otherwise("")))
    return out if manifest is None else manifest.join(out.drop("retained_pairs"), "subset_name", "left")


def model_breakdown(preds: DataFrame, members: DataFrame, n_pairs: int | Column,
                    within_file: str = "first") -> DataFrame:
    merged = merge.merge_predictions(merge.bounded_ids(preds, n_pairs), within_file, "last")
    return subset_accuracies(merged, merge.common_pairs(merged), members).withColumn(
        "accuracy_shift", F.col("acc_sub") - F.col("acc_full"))


def best_subset(report: DataFrame) -> DataFrame:
    """Highest Spearman, then Kendall, then size, then name."""
    ok = report.filter(F.col("spearman").isNotNull())
    order = F.struct(-F.col("spearman"), -F.coalesce(F.col("kendall"), F.lit(-2.0)), -F.col("retained_pairs"), F.col("subset_name"))
    cols = report.columns
    return ok.agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
