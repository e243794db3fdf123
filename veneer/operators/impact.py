"""Benchmark impact: accuracy on clean and confounded pairs, stability, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions.stats import correlation_p
from veneer.operators import merge, trial_labels
from veneer.operators.metrics import midranks
from veneer.operators.ordering import before_cut, hash_cuts
from veneer.operators.reshape import style_violation
from veneer.operators.selection import quantiles
from veneer.operators.single import attach
from veneer.session import cut_lineage

# fixed values: (variant, length gap, hedge gap, authority gap)
THRESHOLD_VARIANTS = (
    ("Strict", 0.15, 0.03, 0.02), ("Default", 0.20, 0.02, 0.01), ("Lenient", 0.25, 0.01, 0.005),
)


def with_flags(preds: DataFrame, flags: DataFrame) -> DataFrame:
    """Predictions of known pairs with their style flag.

    The flag table grows with the benchmark, so the join strategy is left to the planner,
    which broadcasts only below its size limit.
    """
    return preds.join(flags.select("pair_id", "style_violation"), "pair_id")


def accuracy_by_split(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and counts on all, clean and confounded pairs in one aggregation."""
    right = (F.col("correct") == 1).cast("double")
    clean, conf = F.col("style_violation") == 0, F.col("style_violation") == 1
    return (flagged.groupBy(*by).agg(
        F.avg(right).alias("acc_all"), F.avg(F.when(clean, right)).alias("acc_clean"),
        F.avg(F.when(conf, right)).alias("acc_confounded"), F.count(F.lit(1)).alias("n_all"),
        F.count_if(clean).alias("n_clean"), F.count_if(conf).alias("n_confounded"))
        .withColumn("delta_conf_clean", F.col("acc_confounded") - F.col("acc_clean")))


def accuracy_grouping_sets(flagged: DataFrame) -> DataFrame:
    """Long form of the same table by grouping sets; split is all, clean or confounded."""
    cube = flagged.groupingSets(
        [["source_file", "model_name", "style_violation"], ["source_file", "model_name"]],
        "source_file", "model_name", "style_violation").agg(
        F.avg((F.col("correct") == 1).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    split = (F.when(F.col("style_violation").isNull(), "all")
             .when(F.col("style_violation") == 1, "confounded").otherwise("clean"))
    return cube.select("source_file", "model_name", split.alias("split"), "accuracy", "n")


def impact_by_file(preds: DataFrame, flags: DataFrame, within_file: str = "first") -> DataFrame:
    runs = merge.merge_predictions(preds, within_file, "keep")
    return accuracy_by_split(with_flags(runs, flags), ["source_file", "model_name"])


def impact_by_model(preds: DataFrame, flags: DataFrame, within_file: str = "last") -> DataFrame:
    merged = merge.merge_predictions(preds, within_file, "last")
    return accuracy_by_split(with_flags(merged, flags), ["model_name"]).orderBy(
        F.col("acc_all").desc(), "model_name")


def seed_summary(by_file: DataFrame) -> DataFrame:
    delta = F.col("delta_conf_clean")
    return by_file.groupBy("model_name").agg(
        F.count(delta).alias("n_runs"), F.avg(delta).alias("delta_mean"),
        F.stddev_samp(delta).alias("delta_std"),
        F.avg((F.coalesce(delta, F.lit(0.0)) > 0).cast("double")).alias("sign_frac_pos"),
        F.avg("acc_all").alias("acc_all_mean"))


def threshold_sensitivity(audit: DataFrame, variants=THRESHOLD_VARIANTS) -> DataFrame:
    """Share of confounded pairs per threshold variant, one pass."""
    flags = [F.struct(F.lit(name).alias("variant"), style_violation(a, b, c).alias("flag"))
             for name, a, b, c in variants]
    return (audit.select(F.explode(F.array(*flags)).alias("v")).groupBy("v.variant")
            .agg((100.0 * F.avg("v.flag")).alias("pct_confounded"), F.count(F.lit(1)).alias("n_pairs")))


def heuristic_confound(features: DataFrame, question_form: bool = False) -> DataFrame:
    """confounded 0/1 for labelled texts: cues, plus length tails or the question cue."""
    cue = (F.col("neg_lead") == 1) | (F.col("neg_cnt") >= 2) | (F.col("neg_bigram_refutes") >= 1)
    if question_form:
        return features.withColumn("confounded", (cue | (F.col("question_neg") >= 1)).cast("int"))
    low, high = quantiles(features, "word_count", [0.2, 0.8])
    outer = (F.col("word_count") <= low) | (F.col("word_count") >= high)
    return features.withColumn("confounded", (cue | outer).cast("int"))


def coverage_by_label(answers: DataFrame, feature: str, label: str = "label") -> DataFrame:
    """Rows, rows with the cue, share and mean per label."""
    v = F.col(feature)
    return answers.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(v > 0).alias("n_with_cue"),
                                      F.avg((v > 0).cast("double")).alias("share_with_cue"), F.avg(v).alias("mean_value"))


def complete_runs(runs: DataFrame, flags: DataFrame) -> DataFrame:
    """Runs (file, model) that answer every pair of the flag table."""
    n = flags.agg(F.count(F.lit(1))).scalar()
    known = runs.join(flags.select("pair_id"), "pair_id", "left_semi")
    full = (known.groupBy("source_file", "model_name").agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") == n).select("source_file", "model_name"))
    return known.join(full, ["source_file", "model_name"], "left_semi")


def permuted_flags(flags: DataFrame, seeds: list[int]) -> DataFrame:
    """(pair_id, words): bit words with a bit per shuffle in which the pair is flagged; the number flagged is kept."""
    total, flagged = flags.agg(F.count(F.lit(1)), F.sum("style_violation")).first()
    ids = flags.select("pair_id")
    cuts = cut_lineage(hash_cuts(ids, "pair_id", seeds, [int(flagged or 0)] * len(seeds), total, stream="flag"))
    dealt = before_cut(F.col("cuts"), "pair_id", seeds, stream="flag")
    return attach(ids, cuts).select("pair_id", trial_labels.packed(dealt, len(seeds)).alias("words"))


def _hits(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """(source_file, model_name, seed, __hit) from (source_file, model_name, right, words): the runs' correctness times
    the shuffles' flag bits. A task adds up a row of counts per run; no row stands for a run, pair and shuffle."""
    n = len(seeds)
    which = np.arange(n)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                bits = trial_labels.bit(trial_labels.matrix(part.column("words"), part.num_rows), which)
                bits = bits * part.column("right").to_numpy(zero_copy_only=False)[:, None]
                names = list(zip(part.column("source_file").to_pylist(), part.column("model_name").to_pylist()))
                runs = {name: k for k, name in enumerate(dict.fromkeys(names))}
                code = np.array([runs[x] for x in names])
                order = np.argsort(code, kind="stable")
                starts = np.searchsorted(code[order], np.arange(len(runs)))
                for name, found in zip(runs, np.add.reduceat(bits[order], starts, axis=0)):
                    sums[name] = sums.get(name, 0) + found
        for (file, model), found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([model] * n, pa.string()), pa.array(seeds, pa.int32()),
                                              pa.array(found.astype(np.int64))], ["source_file", "model_name", "seed", "hit"])

    counts = rows.mapInArrow(run, "source_file string, model_name string, seed int, hit long")
    return counts.groupBy("source_file", "model_name", "seed").agg(F.sum("hit").alias("__hit"))


def permutation_calibration(preds: DataFrame, flags: DataFrame, shuffles: int = 300, first_seed: int = 0,
                            min_runs: int = 3) -> DataFrame:
    """Observed mean delta per model against shuffles of the style flag.

    Each pair carries its flags of all shuffles as bits; the clean side follows from run totals.
    Fewer than ``min_runs`` complete runs give an empty result.
    """
    runs = complete_runs(merge.merge_predictions(preds, "last", "keep"), flags)
    right = (F.col("correct") == 1).cast("int")
    sizes = flags.agg(F.count(F.lit(1)).alias("__pairs"), F.sum("style_violation").alias("__flagged"))
    totals = runs.groupBy("source_file", "model_name").agg(F.sum(right).alias("__right"))
    observed = (with_flags(runs, flags).filter("style_violation = 1").groupBy("source_file", "model_name")
                .agg(F.sum(right).alias("__hit")).withColumn("seed", F.lit(-1)))
    seeds = list(range(first_seed, first_seed + shuffles))
    flagged = runs.join(permuted_flags(flags, seeds), "pair_id").select("source_file", "model_name", right.cast("long").alias("right"), "words")
    every = observed.unionByName(_hits(flagged, seeds).select("source_file", "model_name", "__hit", "seed")).join(totals, ["source_file", "model_name"])
    # no flagged or no clean pairs: undefined
    delta = (F.try_divide(F.col("__hit"), F.col("__flagged"))
             - F.try_divide(F.col("__right") - F.col("__hit"), F.col("__pairs") - F.col("__flagged")))
    per_model = (attach(every, sizes).withColumn("__delta", delta).groupBy("model_name", "seed")
                 .agg(F.avg("__delta").alias("__delta"), F.count(F.lit(1)).alias("n_runs")))
    seen = per_model.filter("seed = -1").select("model_name", F.col("__delta").alias("delta_mean_observed"), "n_runs")
    null = per_model.filter("seed >= 0").join(seen.drop("n_runs"), "model_name")
    # sums of equal terms may differ in the last bit, so a tie counts as reached
    reached = F.col("__delta") >= F.col("delta_mean_observed") - 1e-12
    summary = null.groupBy("model_name").agg(
        F.avg("__delta").alias("null_mean"), F.stddev_pop("__delta").alias("null_std"),
        F.avg(reached.cast("double")).alias("p_value_one_sided_ge"),
        F.percentile("__delta", 0.90).alias("null_p90"), F.percentile("__delta", 0.95).alias("null_p95"))
    enough = totals.agg(F.count(F.lit(1)).alias("__runs"))
    return (attach(seen.join(summary, "model_name"), enough)
            .filter(F.col("__runs") >= min_runs).drop("__runs"))


def surface_bridge(merged: DataFrame, scores: DataFrame, score: str = "surface_score",
                   with_p: bool = True) -> DataFrame:
    """Spearman between correctness and a per-pair surface score, per model.

    Scores are ranked inside each model's pairs. Ranks come from counts per distinct value
    and value range, so no window spans a whole model.
    """
    joined = merged.select("model_name", "pair_id", F.col("correct").cast("double").alias("correct")).join(
        scores.select("pair_id", score), "pair_id")
    per_value = joined.groupBy("model_name", score).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("hits"))
    ranked = midranks(per_value, score, "n", ["model_name"], "r")
    # correctness has two values, so its ranks are a linear map of 0/1: correlate ranks with 0/1
    n, r, h = F.col("n").cast("double"), F.col("r"), F.col("hits")
    s = ranked.groupBy("model_name").agg(
        F.sum("n").alias("n_pairs"), F.sum(n * r).alias("sr"), F.sum(n * r * r).alias("srr"),
        F.sum(h).alias("sh"), F.sum(h * r).alias("shr"))
    k = F.col("n_pairs").cast("double")
    cov = F.col("shr") / k - F.col("sr") / k * F.col("sh") / k
    var_r = F.col("srr") / k - (F.col("sr") / k) * (F.col("sr") / k)
    var_h = F.col("sh") / k * (1 - F.col("sh") / k)
    rho = F.when((var_r > 0) & (var_h > 0), cov / F.sqrt(var_r * var_h))
    out = s.select("model_name", rho.alias("spearman_r"), "n_pairs")
    return out.withColumn("p_value", correlation_p(F.col("spearman_r"), F.col("n_pairs"))) if with_p else out
