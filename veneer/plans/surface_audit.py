"""End-to-end surface audits: out-of-fold AUC with interval, null, ablations, summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions.draws import WORD_BITS, draw_word
from veneer.functions.text import CLAIM_FEATURES, PAIR_FEATURES
from veneer.operators import audit, metrics, trial_labels
from veneer.operators.impact import heuristic_confound
from veneer.operators.ordering import before_cut, hash_cuts
from veneer.operators.single import attach
from veneer.session import cut_lineage

# fixed values: ablation groups of the labelled-claim audit
CLAIM_ABLATIONS = {
    "No negation": ("neg_lead", "neg_cnt", "neg_bigram_refutes", "neg_bigram_supports", "question_neg"),
    "No length": ("word_count", "char_count", "avg_word_len"),
    "No hedging": ("hedge_rate",),
    "No authority": ("auth_rate",),
    "No specificity/mutation": ("specificity_score", "superlative", "generalization_proxy"),
}
PAIR_ABLATIONS = {
    "No negation": ("neg_lead", "neg_cnt"),
    "No length gap": ("len_gap",),
    "No hedging": ("hedge_rate",),
    "No authority": ("auth_rate",),
}
FULL_MODEL = "None (full model)"
MIN_PAIRS = 5


def swapped_words(n: int, seed: int, pair: str = "pair_id", label: str = "label") -> Column:
    """Bit words of n null labels: the two answers of a pair trade labels on a fair coin. One md5 feeds a word."""
    words = [draw_word(seed, block, pair) for block in range(max(1, -(-n // WORD_BITS)))]
    return F.array(*[F.when(F.col(label) == 1, F.bitwise_not(w).bitwiseAND(F.lit((1 << WORD_BITS) - 1))).otherwise(w) for w in words])


def shuffled_labels(df: DataFrame, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """Add ``null_words``: bit words of labels re-dealt over all rows, keeping the number of ones."""
    total, ones = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    seeds = [seed + i for i in range(n)]
    cuts = cut_lineage(hash_cuts(df.select(key), key, seeds, [int(ones or 0)] * n, total, stream="label"))
    dealt = before_cut(F.col("cuts"), key, seeds, stream="label")
    return attach(df, cuts).withColumn("null_words", trial_labels.packed(dealt, n)).drop("cuts")


def null_labels(df: DataFrame, key: str, group: str | None, n: int, seed: int, mode: str) -> DataFrame:
    """Add ``null_words`` in one of the two null modes, written once: no trial draws a label again."""
    if mode == "within_group":
        return cut_lineage(df.withColumn("null_words", swapped_words(n, seed, group or key)), every_core=True)
    if mode == "global":
        return cut_lineage(shuffled_labels(df, key, n, seed), every_core=True)
    raise ValueError(f"null mode {mode!r}: expected global or within_group")


def _mask(features, dropped) -> np.ndarray:
    return np.array([f not in dropped for f in features])


def observed(df: DataFrame, features, keys: list[str], n_folds: int = 5, l2: float = 1.0) -> audit.Audit:
    return audit.run_audit(df, features, keys, F.array("label"), 1, n_folds, None, l2)


def audit_with_null(df: DataFrame, features=PAIR_FEATURES, key: str = "row_id", group: str | None = "pair_id",
                    n_null: int = 100, n_boot: int = 500, seed: int = 42, mode: str = "within_group",
                    n_folds: int = 5) -> DataFrame:
    """One row: auc, accuracy, ci_lo, ci_hi, null_mean, null_std, p_value, n_rows."""
    spark = df.sparkSession
    run = observed(df, features, list(dict.fromkeys([key, group or key])), n_folds)
    scored = run.long()
    point = metrics.auc(scored, "logit", cut=0.0)
    ci = metrics.interval(metrics.bootstrap_auc(scored, group or key, n_boot, seed, "logit"))
    labelled = null_labels(df, key, group, n_null, seed, mode)
    nulls = audit.trial_metrics(labelled, features, trial_labels.words("null_words", n_null), n_folds, plane=np.arange(1, n_null + 1))
    table = spark.createDataFrame([(r["trial"], r["auc"]) for r in nulls], "run int, auc double")  # n_null rows
    seen = attach(table, point.select(F.col("auc").alias("__seen")))
    null = seen.agg(F.avg("auc").alias("null_mean"), F.stddev_pop("auc").alias("null_std"),
                    F.avg((F.col("auc") >= F.col("__seen")).cast("double")).alias("p_value"))
    return attach(attach(point, ci), null)


def random_label_control(df: DataFrame, features, key: str, runs: int, seed: int = 0,
                         n_folds: int = 5) -> DataFrame:
    """(run, auc) under global label shuffles: the floor without signal."""
    labelled = null_labels(df, key, None, runs, seed, "global")
    rows = audit.trial_metrics(labelled, features, trial_labels.words("null_words", runs), n_folds, plane=np.arange(1, runs + 1))
    return df.sparkSession.createDataFrame([(r["trial"], r["auc"]) for r in rows], "run int, auc double")


def control_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("n_runs"))


def ablation(df: DataFrame, features, groups: dict[str, tuple], key: str = "row_id", group: str | None = "pair_id",
             n_null: int = 0, seed: int = 42, mode: str = "within_group", n_folds: int = 5) -> DataFrame:
    """(ablation, auc, accuracy, null_mean): each group dropped in turn, all trials in shared passes."""
    names = [FULL_MODEL] + [n for n, cols in groups.items() if set(features) - set(cols)]
    masks = [_mask(features, groups.get(n, ())) for n in names]
    labelled = null_labels(df, key, group, n_null, seed, mode) if n_null else df.withColumn("null_words", F.array(F.lit(0).cast("long")))
    planes = n_null + 1  # the row's own label and the nulls; every mask uses the same ones
    rows = audit.trial_metrics(labelled, features, trial_labels.words("null_words", n_null), n_folds, np.repeat(masks, planes, axis=0),
                               plane=np.tile(np.arange(planes), len(names)))
    out = []
    for i, name in enumerate(names):
        block = rows[i * planes:(i + 1) * planes]
        nulls = [r["auc"] for r in block[1:] if r["auc"] is not None]
        out.append((i, name, block[0]["auc"], block[0]["accuracy"], float(np.mean(nulls)) if nulls else None))
    return df.sparkSession.createDataFrame(
        out, "position int, ablation string, auc double, accuracy double, null_mean double")


def zeroed(df: DataFrame, columns) -> DataFrame:
    """Ablation that keeps the width: the columns become constant zero."""
    return df.withColumns({c: F.lit(0.0) for c in columns})


def dominant_group(ablations: DataFrame) -> DataFrame:
    """Group whose removal costs most AUC; none when no removal costs anything."""
    full = ablations.filter(F.col("ablation") == FULL_MODEL).select(F.col("auc").alias("__full"))
    drops = attach(ablations.filter(F.col("ablation") != FULL_MODEL), full).withColumn(
        "__drop", F.col("__full") - F.col("auc"))
    best = drops.agg(F.max("__drop").alias("auc_drop"),
                     F.max_by("ablation", F.struct(F.col("__drop"), -F.col("position"))).alias("__name"))
    label = F.initcap(F.split(F.replace(F.col("__name"), F.lit("No "), F.lit("")), " \\(")[0])
    plain = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1000)))
    return best.select(F.when(F.col("auc_drop") > 0, plain).otherwise("None identified").alias("dominant"), "auc_drop")


def full_fit(df: DataFrame, features, n_folds: int = 5) -> tuple[DataFrame, dict]:
    """Model table of the fit on all rows and the training facts a scorer needs."""
    run = audit.run_audit(df, features, [], F.array("label"), 1, n_folds)
    facts = df.agg(F.avg("len_gap") if "len_gap" in df.columns else F.lit(None).cast("double"),
                   F.count(F.lit(1)), F.sum("label")).first()
    run.release()
    return (audit.model_table(df.sparkSession, run.fit),
            {"mean_len_gap": facts[0], "n_rows": facts[1], "n_positive": facts[2]})


def claim_summary(df: DataFrame, name: str, features=CLAIM_FEATURES, key: str = "row_id", group: str | None = None,
                  question_form: bool = False, n_null: int = 20, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """Cross-dataset report row: size, AUC, interval, null, p, dominant group, confounded share."""
    core = audit_with_null(df, features, key, group, n_null, n_boot, seed, "global")
    dominant = dominant_group(ablation(df, features, CLAIM_ABLATIONS, key, group))
    share = heuristic_confound(df, question_form).agg((100.0 * F.avg("confounded")).alias("confound_pct"))
    return attach(attach(core, dominant), share).withColumn("dataset", F.lit(name))


def baseline_gate(value: float, expected: float, tolerance: float, what: str = "AUC") -> float:
    if value is None or abs(value - expected) > tolerance:
        raise ValueError(f"{what} {value} is off the baseline {expected} by more than {tolerance}")
    return value


def anchor_audit(answers: DataFrame, anchors: DataFrame, features, controls: int = 10, seed: int = 0,
                 key: str = "pair_id", n_folds: int = 5) -> DataFrame:
    """Audit of all pairs, the anchor pairs and random controls of the anchors' size, in one batch."""
    pairs = answers.select(key).distinct()
    size, total = anchors.count(), pairs.count()
    seeds = [seed + i for i in range(controls)]
    cuts = cut_lineage(hash_cuts(pairs, key, seeds, [size] * controls, total, stream="control"))
    marked = attach(answers.join(anchors.select(key).withColumn("__anchor", F.lit(1)), key, "left"), cuts)
    inside = F.concat(F.array(F.lit(1), F.coalesce("__anchor", F.lit(0))), before_cut(F.col("cuts"), key, seeds, stream="control"))
    rows = audit.trial_metrics(marked, features, trial_labels.members(trial_labels.packed(inside, controls + 2), controls + 2), n_folds)
    names = ["full", "anchors"] + [f"control_{s}" for s in seeds]
    return answers.sparkSession.createDataFrame(
        [(n, r["auc"], r["accuracy"], r["n_rows"] // 2) for n, r in zip(names, rows)],
        "subset string, auc double, accuracy double, n_pairs int")


def anchor_summary(rows: DataFrame) -> DataFrame:
    """Controls as mean and sample std next to the anchor set."""
    control = F.startswith("subset", F.lit("control_"))
    kind = F.when(control, "random_controls").otherwise(F.col("subset"))
    return rows.groupBy(kind.alias("subset")).agg(
        F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_std"),
        F.count(F.lit(1)).alias("n_sets"))
