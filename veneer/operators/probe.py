"""Forced-choice and one-sided statistics of probe scores.

Score rows: (pair_id, family, variant, p_a, p_b) with variant full or cleaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions.stats import binomial_two_sided_p, mcnemar_p, wilson_interval
from veneer.operators.metrics import midranks
from veneer.operators.single import attach

FULL, CLEANED = "full", "cleaned"


def _choice_aggs() -> list[Column]:
    win, tie = F.col("p_a") > F.col("p_b"), F.col("p_a") == F.col("p_b")
    return [F.count(F.lit(1)).alias("n"), F.count_if(win).alias("n_correct"), F.count_if(tie).alias("ties"),
            F.avg(win.cast("double")).alias("pair_accuracy"), F.avg(F.col("p_a") - F.col("p_b")).alias("mean_gap"),
            F.avg("p_a").alias("mean_p_a"), F.avg("p_b").alias("mean_p_b")]


def forced_choice(scores: DataFrame, by: tuple = ("family", "variant"), with_tests: bool = False) -> DataFrame:
    """A tie counts as wrong and is also counted apart."""
    out = scores.groupBy(*by).agg(*_choice_aggs())
    if not with_tests:
        return out
    low, high = wilson_interval(F.col("n_correct").cast("double"), F.col("n").cast("double"))
    return (out.withColumn("wilson_low", low).withColumn("wilson_high", high)
            .withColumn("p_vs_chance", binomial_two_sided_p(F.col("n_correct"), F.col("n"))))


def full_vs_cleaned(scores: DataFrame, by: tuple = ("family",)) -> DataFrame:
    """Accuracy and gap under both variants with the drop full - cleaned, in one aggregation."""
    win, gap = (F.col("p_a") > F.col("p_b")).cast("double"), F.col("p_a") - F.col("p_b")
    at = lambda v, c: F.avg(F.when(F.col("variant") == v, c))
    return (scores.groupBy(*by).agg(
        F.count_if(F.col("variant") == FULL).alias("n_full"), F.count_if(F.col("variant") == CLEANED).alias("n_cleaned"),
        at(FULL, win).alias("acc_full"), at(CLEANED, win).alias("acc_cleaned"),
        at(FULL, gap).alias("gap_full"), at(CLEANED, gap).alias("gap_cleaned"))
        .withColumn("drop", F.col("acc_full") - F.col("acc_cleaned"))
        .withColumn("gap_drop", F.col("gap_full") - F.col("gap_cleaned")))


def mcnemar(scores: DataFrame, by: tuple = ("family",), key: str = "pair_id", with_p: bool = True) -> DataFrame:
    """Pick flips between full and cleaned over pairs that have both."""
    pick = (F.col("p_a") > F.col("p_b")).cast("int")
    per_pair = scores.groupBy(*by, key).agg(
        F.max(F.when(F.col("variant") == FULL, pick)).alias("f"),
        F.max(F.when(F.col("variant") == CLEANED, pick)).alias("c"))
    out = per_pair.filter(F.col("f").isNotNull() & F.col("c").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("f") == 0) & (F.col("c") == 1)).alias("flips_to_right"),
        F.count_if((F.col("f") == 1) & (F.col("c") == 0)).alias("flips_to_wrong"))
    out = out.withColumn("net_flip", F.col("flips_to_right") - F.col("flips_to_wrong"))
    return out.withColumn("mcnemar_p", mcnemar_p(F.col("flips_to_right"), F.col("flips_to_wrong"))) if with_p else out


def paired_aggregate(scores: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Per (family, variant) and per (family, variant, strategy) at once; strategy NULL is the total."""
    return (scores.groupingSets([["family", "variant"], ["family", "variant", strategy]],
                                "family", "variant", strategy)
            .agg(*_choice_aggs()))


def cleaning_effect(aggregate: DataFrame, by: tuple = ("family",)) -> DataFrame:
    """cleaned - full for accuracy and gap of an aggregate table."""
    at = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return (aggregate.groupBy(*by).agg(
        *[at(v, c).alias(f"{c}_{v}") for v in (FULL, CLEANED) for c in ("pair_accuracy", "mean_gap")])
        .select(*by, (F.col("pair_accuracy_cleaned") - F.col("pair_accuracy_full")).alias("accuracy_change"),
                (F.col("mean_gap_cleaned") - F.col("mean_gap_full")).alias("gap_change")))


def unilateral(scores: DataFrame, by: tuple = ("family", "variant"), p: str = "p") -> DataFrame:
    return scores.groupBy(*by).agg(F.count(p).alias("n"), F.avg(p).alias("mean_p"),
                                   F.avg((F.col(p) > 0.5).cast("double")).alias("share_above_half"))


def bilateral_same_index(scores: DataFrame, by: tuple = ("family", "variant")) -> DataFrame:
    fooled = (F.col("p_b") > F.col("p_a")).cast("double")
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(fooled).alias("fool_rate"),
                                   F.avg("p_a").alias("mean_p_a"), F.avg("p_b").alias("mean_p_b"),
                                   F.avg(F.col("p_b") - F.col("p_a")).alias("mean_gap"))


def bilateral_all_pairs(a: DataFrame, b: DataFrame, by: tuple = ("family", "variant"), p: str = "p") -> DataFrame:
    """Share of all (A, B) combinations with P_B > P_A, counted by rank instead of pairing.

    A values strictly below each B value: the rank among both sides minus the rank among B,
    corrected for ties. Rows are first reduced to one per distinct value.
    """
    by = list(by)
    sided = (a.select(*by, F.col(p).alias("p"), F.lit(1).alias("na"), F.lit(0).alias("nb"))
             .unionByName(b.select(*by, F.col(p).alias("p"), F.lit(0).alias("na"), F.lit(1).alias("nb"))))
    counts = sided.groupBy(*by, "p").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    ranked = midranks(counts, "p", "na", by, "__r")
    below = F.col("__r") - (F.col("na") + 1) / 2  # A values strictly below p
    return ranked.groupBy(*by).agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"),
        F.try_divide(F.try_divide(F.sum(F.col("nb") * below), F.sum("na").cast("double")),
                     F.sum("nb").cast("double")).alias("fool_rate"))


def multi_seed_summary(effects: DataFrame, by: tuple = ("family",),
                       values: tuple = ("accuracy_change", "gap_change")) -> DataFrame:
    """Mean and sample std over seeds, undefined values left out, std NULL below two seeds."""
    aggs = [F.countDistinct("seed").alias("n_seeds")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return effects.groupBy(*by).agg(*aggs)


def seed_columns(effects: DataFrame, seeds: list[int], value: str, by: str = "family") -> DataFrame:
    """One column per seed."""
    return effects.groupBy(by).pivot("seed", seeds).agg(F.first(value))


def experiment_delta(left: DataFrame, right: DataFrame, by: tuple = ("family", "variant"),
                     value: str = "pair_accuracy") -> DataFrame:
    """right - left per (family, variant); NULL when either side has no pairs."""
    a = left.select(*by, F.col(value).alias("left_value"))
    b = right.select(*by, F.col(value).alias("right_value"))
    return a.join(b, list(by), "full_outer").withColumn("delta", F.col("right_value") - F.col("left_value"))


def family_bundle(scores: DataFrame, passed: str = "judge_pass") -> DataFrame:
    """Unilateral, same-index and all-pairs statistics for all items and judge-passed ones."""
    scope = F.explode(F.when(F.col(passed), F.array(F.lit("all"), F.lit("passed"))).otherwise(F.array(F.lit("all"))))
    scoped = scores.withColumn("scope", scope)
    by = ("scope", "family", "variant")
    same = bilateral_same_index(scoped, by).withColumnRenamed("fool_rate", "same_index_fool_rate")
    one = scoped.groupBy(*by).agg(F.avg((F.col("p_a") > 0.5).cast("double")).alias("a_above_half"),
                                  F.avg((F.col("p_b") > 0.5).cast("double")).alias("b_above_half"))
    every = bilateral_all_pairs(scoped.select(*by, F.col("p_a").alias("p")),
                                scoped.select(*by, F.col("p_b").alias("p")), by)
    return (same.join(one, list(by)).join(
        every.select(*by, F.col("fool_rate").alias("all_pairs_fool_rate")), list(by)))


def cue_usage(df: DataFrame, hits: Column, limit: int = 2) -> DataFrame:
    """Uses per cue and whether the limit is reached."""
    return (df.select(F.explode(hits).alias("cue")).groupBy("cue").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("at_limit", F.col("n") >= limit))


def corpus_summary(pairs: DataFrame, side_a: str = "wc_a", side_b: str = "wc_b",
                   zero_counts: tuple = ()) -> DataFrame:
    """Length ranges and means per side, delta statistics, all-zero flags of cue counts."""
    delta = F.col(side_b) - F.col(side_a)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *[f(c).alias(f"{name}_{c}") for c in (side_a, side_b)
          for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"), F.avg(delta).alias("mean_delta"),
        F.every(delta >= 8).alias("all_delta_ok"),
        *[F.every(F.col(z) == 0).alias(f"all_{z}_zero") for z in zero_counts])


def decision_gates(judge: DataFrame, scores: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """One row: counts, means and PASS/FAIL per gate, flags, and PROCEED or PAUSE.

    Minimum counts are shares of the items, so the gates scale with the set.
    """
    # fixed values: 18 and 2 and 12 of 20 items, mean 0.55, directional gap 0.05
    t = {"false_share": 18 / 20, "disagree_share": 2 / 20, "mean_min": 0.55, "fooled_share": 12 / 20,
         "gap_min": 0.05, **(thresholds or {})}
    j = judge.agg(F.count(F.lit(1)).alias("n_judged"), F.count_if("judged_false").alias("n_judged_false"),
                  F.count_if("judge_disagreement_flag").alias("n_disagree"))
    s = scores.agg(F.count(F.lit(1)).alias("n_scored"), F.avg("p_full").alias("mean_full"),
                   F.count_if(F.col("p_full") > 0.5).alias("n_fooled"),
                   (F.avg("p_full") - F.avg("p_cleaned")).alias("gap"))
    word = lambda c: F.when(c, "PASS").otherwise("FAIL")
    out = attach(j, s)
    c3 = ((F.col("n_judged_false") >= F.col("n_judged") * t["false_share"])
          & (F.col("n_disagree") <= F.col("n_judged") * t["disagree_share"]))
    c4 = F.col("mean_full") >= t["mean_min"]
    c5 = F.col("n_fooled") >= F.col("n_scored") * t["fooled_share"]
    return (out.withColumn("judge_gate", word(c3)).withColumn("mean_gate", word(c4))
            .withColumn("fooled_gate", word(c5)).withColumn("gap_flag", word(F.col("gap") >= t["gap_min"]))
            .withColumn("human_gate", F.lit("PENDING"))
            .withColumn("decision", F.when(c3 & c4 & c5, "PROCEED").otherwise("PAUSE")))
