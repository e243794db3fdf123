"""Model-based audits and searches. Newton fits have no SQL form: these are checked against numpy
in the tests and registered for rows here, except where the metric part can be restated."""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.functions.text import CLAIM_FEATURES, claim_features
from veneer.operators import audit, folds, reshape, scoring
from veneer.operators import ordering as od
from veneer.operators.metrics import auc
from veneer.plans import pruning, subset_search as ss, surface_audit as sa
from workload.common import CLAIM_CUES, FEATURES, answers, audit_table, documents, rounded, table

QUERIES, ORACLES = {}, {}


def folded(spark, sf):
    """Answer rows with dense folds; features are computed once and reused by every Newton step."""
    a = answers(spark, sf).select("doc_id", "pair_id", "label", *FEATURES).withColumn("fold", folds.dense_fold("pair_id"))
    return a.withColumnRenamed("doc_id", "row_id")


def stored(df):
    """Features written once: later passes read numbers, not texts."""
    from veneer.session import cut_lineage
    return cut_lineage(df)


QUERIES["audit_oof_metrics"] = lambda spark, sf: rounded(
    sa.observed(folded(spark, sf), FEATURES, ["row_id"]).metrics(), ["auc", "accuracy"])
QUERIES["audit_oof_probabilities"] = lambda spark, sf: rounded(
    sa.observed(folded(spark, sf), FEATURES, ["row_id"]).long(), ["score"])


def _vector_rows(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), "embedding")
    return e.withColumn("fold", folds.dense_fold("vec_id"))


def _vector_audit(spark, sf):
    """All rows and the rows of a subset (half of the label classes) side by side."""
    rows = _vector_rows(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cls")), "vec_id")
    trials = F.array(F.col("label"), F.when(F.col("cls") < 6, F.col("label")).otherwise(audit.ABSENT))
    return rounded(audit.run_vector_audit(rows, "embedding", 64, ["vec_id"], trials, 2).metrics(), ["auc", "accuracy"])


QUERIES["vector_probe_audit"] = _vector_audit
QUERIES["audit_with_null_and_interval"] = lambda spark, sf: rounded(
    sa.audit_with_null(stored(folded(spark, sf)), n_null=100, n_boot=500),
    ["auc", "accuracy", "ci_lo", "ci_hi", "null_mean", "null_std", "p_value"])


def _claims(spark, sf):
    d = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), "text")
    # texts become numbers once, where they are read; the ranks behind the folds move only these
    return folds.stratified_folds(stored(claim_features(d, "text", CLAIM_CUES).drop("text")), "row_id", "label", seed=42)


QUERIES["claim_audit_summary"] = lambda spark, sf: rounded(
    sa.claim_summary(stored(_claims(spark, sf)), "documents by quality", n_null=100, n_boot=1000),
    ["auc", "accuracy", "ci_lo", "ci_hi", "null_mean", "null_std", "p_value", "auc_drop", "confound_pct"])
QUERIES["random_label_control"] = lambda spark, sf: rounded(sa.control_summary(
    sa.random_label_control(stored(_claims(spark, sf)), CLAIM_FEATURES, "row_id", 101)), ["mean_auc", "std_auc"])
QUERIES["ablation_by_dropping"] = lambda spark, sf: rounded(
    sa.ablation(stored(folded(spark, sf)), FEATURES, sa.PAIR_ABLATIONS, n_null=100), ["auc", "accuracy", "null_mean"])


def _zeroed(spark, sf):
    rows = stored(folded(spark, sf))
    a = sa.observed(sa.zeroed(rows, ["neg_lead", "neg_cnt"]), FEATURES, ["row_id"]).metrics()
    return rounded(a, ["auc", "accuracy"])


QUERIES["ablation_by_zeroing"] = _zeroed


def _dominant(spark, sf):
    """Group whose removal costs most, over a metric table derived from the orders."""
    o = table(spark, sf, "orders")
    rows = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("auc"))
    return rounded(sa.dominant_group(rows.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", sa.FULL_MODEL).otherwise(F.concat(F.lit("No "), F.lower("o_orderpriority"))).alias("ablation"),
        "auc", F.substring("o_orderpriority", 1, 1).cast("int").alias("position"))), ["auc_drop"], 4)


QUERIES["dominant_feature_group"] = _dominant
ORACLES["dominant_feature_group"] = """WITH g AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS auc FROM orders GROUP BY 1),
d AS (SELECT p, (SELECT auc FROM g WHERE p = '1-URGENT') - auc AS dr FROM g WHERE p <> '1-URGENT')
SELECT CASE WHEN max(dr) > 0 THEN lower(arg_max(p, dr)) ELSE 'None identified' END AS dominant, round(max(dr), 4) AS auc_drop FROM d"""


def _model(spark, sf):
    model, _ = sa.full_fit(folded(spark, sf), FEATURES)
    return rounded(model, ["mean", "scale", "coefficient", "raw_weight"])


QUERIES["full_fit_model_table"] = _model
QUERIES["feature_importance"] = lambda spark, sf: rounded(
    audit.importance(sa.full_fit(folded(spark, sf), FEATURES)[0]), ["coefficient", "importance"])


def _refit_scores(spark, sf):
    rows = stored(folded(spark, sf))
    model, _ = sa.full_fit(rows, FEATURES)
    return rounded(auc(scoring.score_features(rows, model, FEATURES, "score")), ["auc"])


QUERIES["refit_and_score_texts"] = _refit_scores


def _anchors(spark, sf):
    rows = stored(folded(spark, sf))
    anchors = table(spark, sf, "labels").filter("quality = 1").select(F.expr("doc_id div 2").alias("pair_id")).distinct()
    return rounded(sa.anchor_summary(sa.anchor_audit(rows, anchors, FEATURES, controls=10)),
                   ["auc_mean", "auc_std", "accuracy_mean", "accuracy_std"])


QUERIES["anchor_subset_audit"] = _anchors


# --- searches -------------------------------------------------------------------------
def _search_inputs(spark, sf):
    w = stored(audit_table(spark, sf))
    rows = reshape.to_answers(w).withColumn("fold", folds.dense_fold("pair_id"))
    return stored(reshape.candidates(w)), stored(rows)


SEARCHED = ["search_time_auc", "heldout_auc", "optimism_gap", "confounded_fraction", "negation_rate", "length_gap_mean",
            "hedge_diff_mean", "authority_diff_mean", "imbalance_penalty", "objective_score"]


def _search(spark, sf):
    c, a = _search_inputs(spark, sf)
    n = c.count()
    best = ss.best_by_method(ss.search(c, a, list(range(42, 52)), n // 2))
    return rounded(best, SEARCHED)


QUERIES["multi_seed_subset_search"] = _search


def _fixed(spark, sf):
    c, a = _search_inputs(spark, sf)
    n = c.count()
    rows = ss.fixed_kept(c, a, [42, 43], [n // 2, (3 * n) // 4])
    out = ss.fixed_kept_summary(rows)
    return rounded(out, [x for x in out.columns if x.startswith(("mean_", "std_"))])


QUERIES["fixed_size_subset_search"] = _fixed


def _scan(spark, sf):
    """Prefixes of the balanced order audited together; thresholds read the same table."""
    c, a = _search_inputs(spark, sf)
    n = c.count()
    orders = {"feature_balanced/all": ss.order_definitions()["feature_balanced/all_features"]}
    prepared = ss.prepare(c, a, [42], orders)
    scan = ss.prefix_scan(prepared, "feature_balanced/all", od.prefix_sizes(n, n // 4, 0.75))
    return od.largest_feasible(scan.withColumn("order", F.lit("feature_balanced")), ["order"], "keep_n", "auc", [0.5, 0.52, 0.55, 0.6])


QUERIES["largest_prefix_under_threshold"] = _scan


def _near_random(spark, sf):
    c, a = _search_inputs(spark, sf)
    n = c.count()
    orders = ss.near_random_orders()
    prepared = stored(ss.prepare(c, a, [42], orders))
    out = None
    for name in orders:
        part = ss.near_random_grid(ss.prefix_scan(prepared, name, [n // 4, n // 2, (3 * n) // 4])).withColumn("order", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["auc", "accuracy", "distance_to_chance"])


QUERIES["near_random_grid"] = _near_random


def _prune(spark, sf):
    """Three strategies pruned together to the threshold or the floor; batches of a twentieth of the pairs."""
    _, a = _search_inputs(spark, sf)
    n = a.count() // 2
    trials = [pruning.PruneTrial("confidence", 0.45), pruning.PruneTrial("imbalance", 0.45),
              pruning.PruneTrial("hybrid", 0.45, alpha=0.5, pool=2 * (n // 20), seed=7)]
    result = pruning.prune(a, trials, batch=max(1, n // 20))
    return rounded(result.trajectory, ["auc", "accuracy"])


QUERIES["greedy_prune_trajectories"] = _prune


def _refine(spark, sf):
    """Prune to the floor, then add back and swap while the accuracy limit holds: the ids each stage keeps."""
    _, a = _search_inputs(spark, sf)
    n = a.count() // 2
    trial = pruning.PruneTrial("imbalance", 0.0, "accuracy")
    result = pruning.prune(a, [trial], batch=max(1, n // 100), start=pruning.random_kick(a, 0.02, 9))
    kept = result.kept(a, 0)
    back = pruning.add_back(a, kept, 0.52, "accuracy")
    swapped = pruning.swap_refine(a, back, 0.52, trial)
    out = None
    for stage, ids in (("pruned", kept), ("added_back", back), ("swapped", swapped)):
        part = ids.select(F.lit(stage).alias("stage"), "pair_id")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["prune_add_back_and_swap"] = _refine
