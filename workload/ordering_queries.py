"""Orders, ranks, samples, splits, feasibility and Pareto reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.functions.draws import coin_flips, uniform
from veneer.operators import folds, metrics, reshape, scoring
from veneer.operators import ordering as od
from veneer.plans import subset_search as ss
from workload.common import (FEATURES, audit_table, answers, auc_sql, r6, rounded, sql_answers, sql_audit, sql_candidates,
                             sql_draw, table)

QUERIES, ORACLES = {}, {}
C = f"WITH {sql_candidates()} "


def cands(spark, sf):
    return reshape.candidates(audit_table(spark, sf))


CAND_COLS = ["length_gap", "hedge_diff", "authority_diff"]
QUERIES["search_candidates"] = lambda spark, sf: rounded(cands(spark, sf), CAND_COLS)
ORACLES["search_candidates"] = C + """SELECT example_id, neg_lead_true, neg_lead_false, neg_cnt_true, neg_cnt_false, negation_flag,
  round(length_gap, 6) AS length_gap, round(hedge_diff, 6) AS hedge_diff, round(authority_diff, 6) AS authority_diff, confounded_flag FROM c"""

PRIO = {
    "negation_only": "10.0 * negation_flag + neg_cnt_true + neg_cnt_false", "length_only": "length_gap",
    "neg_len": "8.0 * negation_flag + 4.0 * length_gap",
    "all_features": "10.0 * confounded_flag + 8.0 * negation_flag + 4.0 * length_gap + 2.0 * hedge_diff + 2.0 * authority_diff",
    "negation_first": "10.0 * negation_flag + neg_cnt_true + neg_cnt_false + 0.25 * length_gap"}


def _priorities(spark, sf):
    return rounded(cands(spark, sf).select("example_id", *[od.priority(m).alias(m) for m in od.PRIORITY_MODES]), od.PRIORITY_MODES)


QUERIES["priority_scores"] = _priorities
ORACLES["priority_scores"] = C + "SELECT example_id, " + ", ".join(f"round(({e})::DOUBLE, 6) AS {m}" for m, e in PRIO.items()) + " FROM c"


def _ranked(mode):
    return (lambda spark, sf: od.priority_order(cands(spark, sf), mode).select("example_id", "rank"),
            C + f"SELECT example_id, row_number() OVER (ORDER BY {PRIO[mode]}, example_id) AS rank FROM c")


for _m in ("length_only", "negation_only"):
    QUERIES[f"order_{_m}"], ORACLES[f"order_{_m}"] = _ranked(_m)

QUERIES["order_feature_balanced"] = lambda spark, sf: od.feature_balanced_order(cands(spark, sf)).select("example_id", "rank")
ORACLES["order_feature_balanced"] = C + "SELECT example_id, row_number() OVER (ORDER BY negation_flag, length_gap, example_id) AS rank FROM c"

BIN_SQL = """(length_gap > quantile_cont(length_gap, 0.25) OVER ())::INT + (length_gap > quantile_cont(length_gap, 0.5) OVER ())::INT
  + (length_gap > quantile_cont(length_gap, 0.75) OVER ())::INT"""
QUERIES["quantile_bins"] = lambda spark, sf: od.quantile_bin(cands(spark, sf), "length_gap").groupBy("bin").agg(
    F.count(F.lit(1)).alias("n"), r6(F.max("length_gap")).alias("top"))
ORACLES["quantile_bins"] = C + f"SELECT bin, count(*) AS n, round(max(length_gap), 6) AS top FROM (SELECT length_gap, {BIN_SQL} AS bin FROM c) GROUP BY 1"
QUERIES["order_feature_balanced_bins"] = lambda spark, sf: od.feature_balanced_order(cands(spark, sf), by_bin=True).select("example_id", "rank")
ORACLES["order_feature_balanced_bins"] = C + f"""SELECT example_id, row_number() OVER (ORDER BY bin, negation_flag, length_gap, example_id) AS rank
FROM (SELECT *, {BIN_SQL} AS bin FROM c)"""


def _multi_start(spark, sf):
    return od.priority_order(cands(spark, sf), "length_only", seed=7, noise=0.5).select("example_id", "rank")


QUERIES["order_multi_start"] = _multi_start
ORACLES["order_multi_start"] = C + f"""SELECT example_id, row_number() OVER (ORDER BY
  length_gap + 0.5 * ({sql_draw("'7'", "'start'", "example_id")} / {float(1 << 52)}::DOUBLE - 0.5), example_id) AS rank FROM c"""


def _global_rank(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    ranked = od.global_rank(li, ["qty", "l_orderkey"])
    return ranked.select("l_orderkey", "rank")


QUERIES["global_rank_orders"] = _global_rank
ORACLES["global_rank_orders"] = """SELECT l_orderkey, row_number() OVER (ORDER BY qty, l_orderkey) AS rank
FROM (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)"""


def _rank_within(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return od.global_rank(o, ["o_totalprice", "o_orderkey"], by=["o_orderstatus"]).select("o_orderkey", "rank")


QUERIES["global_rank_within_groups"] = _rank_within
ORACLES["global_rank_within_groups"] = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank FROM orders"""


def _prefixes(spark, sf):
    ranked = od.feature_balanced_order(cands(spark, sf))
    n = ranked.count()
    sizes = od.prefix_sizes(n, n // 4, 0.5, steps=10)
    return rounded(scoring.imbalance_penalty(od.prefix_members(ranked, sizes), cands(spark, sf), ["keep_n"]),
                   ["confounded_fraction", "negation_rate", "length_gap_mean", "hedge_diff_mean", "authority_diff_mean", "imbalance_penalty"])


QUERIES["prefix_grid_profiles"] = _prefixes
ORACLES["prefix_grid_profiles"] = C + """, k AS (SELECT *, row_number() OVER (ORDER BY negation_flag, length_gap, example_id) AS rank FROM c),
n AS (SELECT count(*) AS n, least(greatest(6, count(*) // 4, ceil(count(*) * 0.5)::BIGINT), count(*)) AS lo FROM c),
sizes AS (SELECT n - i * greatest(1, (n - lo) // 10) AS keep_n FROM n, range(1000000) t(i) WHERE n - i * greatest(1, (n - lo) // 10) >= lo),
g AS (SELECT avg(confounded_flag) AS fc, avg(negation_flag) AS fn, avg(length_gap) AS fl, count(*) AS n_full FROM c)
SELECT keep_n, count(*) AS retained_count, round(avg(confounded_flag), 6) AS confounded_fraction, round(avg(negation_flag), 6) AS negation_rate,
  round(avg(length_gap), 6) AS length_gap_mean, round(avg(hedge_diff), 6) AS hedge_diff_mean, round(avg(authority_diff), 6) AS authority_diff_mean,
  any_value(n_full) AS n_full,
  round(abs(avg(confounded_flag) - any_value(fc)) + abs(avg(negation_flag) - any_value(fn)) + abs(avg(length_gap) - any_value(fl)), 6) AS imbalance_penalty
FROM sizes JOIN k ON rank <= keep_n, g GROUP BY 1"""


# --- draws, samples, splits -----------------------------------------------------------
def _presentation(spark, sf):
    return reshape.assign_order(answers(spark, sf).select("pair_id").distinct(), 42).select("pair_id", "true_is_a")


QUERIES["presentation_order"] = _presentation
ORACLES["presentation_order"] = f"""SELECT DISTINCT doc_id // 2 AS pair_id, ({sql_draw("'42'", "'order'", "(doc_id // 2)")} / {float(1 << 52)}::DOUBLE < 0.5)::INT AS true_is_a
FROM documents"""


def _random_subsets(spark, sf):
    k = cands(spark, sf).agg(F.floor(F.count(F.lit(1)) / 5)).scalar()
    return od.hash_sample(cands(spark, sf).select("example_id"), "example_id", list(range(5)), k).select("seed", "example_id")


QUERIES["random_subset_controls"] = _random_subsets
ORACLES["random_subset_controls"] = f"""WITH i AS (SELECT DISTINCT doc_id // 2 AS example_id FROM documents)
SELECT seed, example_id FROM (SELECT seed, example_id, row_number() OVER (PARTITION BY seed ORDER BY {sql_draw("seed", "'sample'", "example_id")}, example_id) AS rn
  FROM i, range(5) t(seed)) WHERE rn <= (SELECT count(*) // 5 FROM i)"""


def _sample_lines(spark, sf):
    o = table(spark, sf, "orders")
    n = o.agg(F.floor(F.count(F.lit(1)) * 0.4)).scalar()
    s = od.hash_sample(o.select("o_orderkey", "o_totalprice"), "o_orderkey", [3, 4], n)
    return s.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


QUERIES["exact_hash_sample"] = _sample_lines
ORACLES["exact_hash_sample"] = f"""SELECT seed, count(*) AS n, sum(o_orderkey) AS key_sum FROM (
  SELECT seed, o_orderkey, row_number() OVER (PARTITION BY seed ORDER BY {sql_draw("seed", "'sample'", "o_orderkey")}, o_orderkey) AS rn
  FROM orders, (VALUES (3), (4)) t(seed)) WHERE rn <= (SELECT floor(count(*) * 0.4) FROM orders) GROUP BY 1"""


def _holdout(spark, sf):
    return od.holdout_split(cands(spark, sf), "example_id", [42, 43, 44])


QUERIES["group_holdout_split"] = _holdout
ORACLES["group_holdout_split"] = f"""WITH i AS (SELECT DISTINCT doc_id // 2 AS example_id FROM documents)
SELECT seed, example_id FROM (SELECT seed, example_id, row_number() OVER (PARTITION BY seed ORDER BY {sql_draw("seed", "'holdout'", "example_id")}, example_id) AS rn
  FROM i, (VALUES (42), (43), (44)) t(seed)) WHERE rn <= (SELECT ceil(count(*) * 0.25) FROM i)"""


def _anchored(spark, sf):
    pool = reshape.sampling_pool(audit_table(spark, sf).withColumns({"t": F.lit(""), "f": F.lit("")}), "t", "f")
    blocked = table(spark, sf, "labels").filter("toxic = 1").select(F.expr("doc_id div 2").alias("pair_id"))
    anchor = table(spark, sf, "labels").filter("quality = 0").select(F.expr("doc_id div 2").alias("pair_id"))
    n = pool.count() // 2
    return od.sample_with_anchor(pool, "pair_id", n, 42, blocked, anchor)


QUERIES["anchored_sample"] = _anchored
ORACLES["anchored_sample"] = f"""WITH {sql_audit()}, po AS (SELECT pair_id FROM w WHERE (neg_lead_true = 1 OR neg_lead_false = 1 OR len_gap > 0.20
  OR abs(hedge_rate_true - hedge_rate_false) > 0.02 OR abs(auth_rate_true - auth_rate_false) > 0.01) AND word_count_true >= 5 AND word_count_false >= 5),
cl AS (SELECT pair_id FROM po WHERE pair_id NOT IN (SELECT doc_id // 2 FROM labels WHERE toxic = 1)),
an AS (SELECT pair_id FROM cl WHERE pair_id IN (SELECT doc_id // 2 FROM labels WHERE quality = 0)),
re AS (SELECT pair_id, row_number() OVER (ORDER BY {sql_draw("'42'", "'sample'", "pair_id")}, pair_id) AS rn FROM cl WHERE pair_id NOT IN (SELECT pair_id FROM an))
SELECT pair_id, 'anchor' AS origin FROM an UNION ALL
SELECT pair_id, 'draw' FROM re WHERE rn <= greatest(0, (SELECT count(*) // 2 FROM po) - (SELECT count(*) FROM an))"""

QUERIES["hash_ordered_quota"] = lambda spark, sf: od.quota_labels(
    cands(spark, sf).select("example_id"), "example_id", "v5", [("negation_opener", 7), ("hedging", 7), ("authority", 6)])
ORACLES["hash_ordered_quota"] = """SELECT example_id, CASE WHEN rn <= 7 THEN 'negation_opener' WHEN rn <= 14 THEN 'hedging' WHEN rn <= 20 THEN 'authority' END AS strategy
FROM (SELECT example_id, row_number() OVER (ORDER BY sha256('v5:' || example_id)) AS rn FROM (SELECT DISTINCT doc_id // 2 AS example_id FROM documents))"""


def _flips(spark, sf):
    p = answers(spark, sf).select("pair_id", "label")
    flips = coin_flips(11, 60, "pair_id")
    return p.select("pair_id", "label", F.posexplode(flips).alias("run", "bit")).groupBy("run").agg(
        F.sum(F.when(F.col("bit") == 1, 1 - F.col("label")).otherwise(F.col("label")) * F.col("pair_id")).alias("ones_sum"),
        F.sum("bit").alias("flipped_rows"))


QUERIES["within_pair_swaps"] = _flips
ORACLES["within_pair_swaps"] = f"""SELECT run, sum((CASE WHEN bit = 1 THEN 1 - label ELSE label END) * pair_id) AS ones_sum, sum(bit) AS flipped_rows FROM (
  SELECT run, pair_id, label, (({sql_draw("'11'", "(run // 52)", "pair_id")} >> (run % 52)) & 1)::BIGINT AS bit
  FROM (SELECT doc_id // 2 AS pair_id, 1 - doc_id % 2 AS label FROM documents), range(60) t(run)) GROUP BY 1"""


def _folds(spark, sf):
    a = answers(spark, sf).select("pair_id", "doc_id", "label")
    return folds.grouped_folds(a, "pair_id").select("doc_id", "fold", folds.dense_fold("pair_id").alias("dense"),
                                                   folds.hashed_fold("pair_id", seed=3).alias("hashed"))


QUERIES["grouped_folds"] = _folds
ORACLES["grouped_folds"] = f"""SELECT doc_id, (dense_rank() OVER (ORDER BY doc_id // 2) - 1) % 5 AS fold, (doc_id // 2) % 5 AS dense,
  {sql_draw("'3'", "'fold'", "(doc_id // 2)")} % 5 AS hashed FROM documents"""

QUERIES["stratified_folds"] = lambda spark, sf: folds.stratified_folds(
    table(spark, sf, "labels"), "doc_id", "quality", seed=42).select("doc_id", "fold")
ORACLES["stratified_folds"] = f"""SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {sql_draw("'42'", "'fold'", "doc_id")}, doc_id) - 1) % 5 AS fold FROM labels"""


# --- picks over metric tables (orders stand for trials) -------------------------------
def trials(spark, sf):
    """One row per order: method, target, size, and three metrics derived from its columns."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("target"),
        (F.col("o_custkey") % 700).alias("size"), F.round(F.col("o_totalprice") % 1.0, 4).alias("auc"),
        F.round((F.col("o_totalprice") * 7) % 1.0, 4).alias("acc"), (F.col("o_custkey") % 10).alias("seed"))


T = """t AS (SELECT o_orderkey AS trial, o_orderpriority AS method, o_orderstatus AS target, o_custkey % 700 AS size,
  round(o_totalprice % 1.0, 4) AS auc, round((o_totalprice * 7) % 1.0, 4) AS acc, o_custkey % 10 AS seed FROM orders)"""


def _t(name, fn, sql):
    QUERIES[name] = lambda spark, sf: fn(trials(spark, sf))
    ORACLES[name] = f"WITH {T} {sql}"


_t("best_trial_per_method", lambda t: od.best_row(t, ["method"], ["auc", "trial"]).select("method", "trial", "auc"),
   "SELECT method, trial, auc FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY auc, trial) AS rn FROM t) WHERE rn = 1")
_t("best_feasible_under_cap", lambda t: od.best_row(t.filter("acc <= 0.55"), ["target"], [("size", True), "auc", "trial"]).select("target", "trial", "size", "auc"),
   "SELECT target, trial, size, auc FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY size DESC, auc, trial) AS rn FROM t WHERE acc <= 0.55) WHERE rn = 1")
_t("candidate_order_near_threshold", lambda t: od.top_k(t.withColumn("gap", F.abs(F.col("acc") - 0.5)), 3,
   [F.col("size").desc(), F.col("gap"), F.col("auc"), F.col("trial")], by=["target"], salt_on="trial").select("target", "trial", "rank"),
   "SELECT target, trial, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY size DESC, abs(acc - 0.5), auc, trial) AS rn FROM t) WHERE rn <= 3")
_t("largest_feasible_prefix", lambda t: od.largest_feasible(t, ["method"], "size", "auc", [0.0005, 0.002, 0.6]),
   "SELECT method, tau, max(size) FILTER (auc <= tau + 1e-9) AS best_size FROM t, (VALUES (0.0005::DOUBLE), (0.002), (0.6)) x(tau) GROUP BY 1, 2")
_t("first_feasible_step", lambda t: od.first_feasible(t, ["method"], "trial", "acc", [0.001, 0.01, 0.2]),
   "SELECT method, tau, min(trial) FILTER (acc <= tau + 1e-9) AS first_step FROM t, (VALUES (0.001::DOUBLE), (0.01), (0.2)) x(tau) GROUP BY 1, 2")
_t("remove_highest_score", lambda t: od.max_score_row(t, ["method"], "size", "trial").select("method", "trial", "size"),
   "SELECT method, trial, size FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY size DESC, trial) AS rn FROM t) WHERE rn = 1")
_t("pick_among_top_scores", lambda t: od.pick_among_top(t, ["method"], "size", "trial", 5, 42).select("method", "trial"),
   f"""SELECT method, trial FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY {sql_draw("'42'", "'pick'", "method || ':' || trial")}, trial) AS pick FROM (
   SELECT *, row_number() OVER (PARTITION BY method ORDER BY size DESC, trial) AS rn FROM t) WHERE rn <= 5) WHERE pick = 1""")
_t("hybrid_scores", lambda t: rounded(od.hybrid_score(t, ["method"], 0.3, "auc", "size").select("trial", "hybrid"), ["hybrid"]),
   """SELECT trial, round(0.3 * (auc - min(auc) OVER m) / (max(auc) OVER m - min(auc) OVER m)
   + 0.7 * (size - min(size) OVER m) / (max(size) OVER m - min(size) OVER m), 6) AS hybrid FROM t WINDOW m AS (PARTITION BY method)""")
_t("min_max_scaled", lambda t: rounded(od.min_max_scaled(t.withColumn("flat", F.lit(1.0)), [], ["acc", "flat"]).select("trial", "acc_scaled", "flat_scaled"), ["acc_scaled", "flat_scaled"]),
   "SELECT trial, round((acc - min(acc) OVER ()) / (max(acc) OVER () - min(acc) OVER ()), 6) AS acc_scaled, 0.0::DOUBLE AS flat_scaled FROM t")
_t("pareto_front", lambda t: od.pareto_front(t.select("trial", "auc", "size"), "auc", "size"),
   "SELECT trial, auc, size FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.size >= t.size AND u.auc <= t.auc AND (u.size > t.size OR u.auc < t.auc))")
_t("search_objective", lambda t: rounded(t.select("trial", scoring.search_objective(
    F.when(F.col("seed") > 0, F.col("auc")), F.col("size"), F.lit(700), F.col("acc"), 400, 1.0, 2.0, 0.5).alias("objective")), ["objective"]),
   """SELECT trial, round(CASE WHEN seed = 0 THEN 1e9 ELSE abs(auc - 0.5) + 2.0 * CASE WHEN size >= 400 THEN 0 ELSE (400 - size) / 700.0::DOUBLE END + 0.5 * acc END, 6) AS objective FROM t""")
_t("dominance_flags", lambda t: t.select("trial", F.coalesce(ss.dominance(F.col("size"), F.col("auc"), F.when(F.col("seed") > 1, F.lit(300)), F.col("acc"), F.lit(0.6)), F.lit(False)).alias("dominates")),
   "SELECT trial, seed > 1 AND size > 300 AND auc <= 0.6 + 1e-9 AND acc <= 0.6 + 1e-9 AS dominates FROM t")
_t("near_random_distance", lambda t: rounded(ss.near_random_grid(t.select("trial", "auc")), ["distance_to_chance"]),
   "SELECT trial, auc, round(abs(auc - 0.5), 6) AS distance_to_chance FROM t")


def _fixed(t):
    rows = t.select(F.col("target").alias("target_kept"), "method", F.col("size").alias("keep_n"), F.col("auc").alias("heldout_auc"),
                    F.col("acc").alias("search_time_auc"), (F.col("acc") - F.col("auc")).alias("optimism_gap"),
                    F.col("auc").alias("confounded_fraction"), F.col("acc").alias("negation_rate"),
                    F.col("size").alias("train_pairs"), F.col("size").alias("hold_pairs"), "seed")
    out = ss.fixed_kept_summary(rows)
    return rounded(out, [c for c in out.columns if c.startswith(("mean_", "std_"))])


_t("fixed_kept_summary", _fixed, """SELECT target AS target_kept, method, round(avg(size), 6) AS mean_actual_kept, round(avg(auc), 6) AS mean_heldout_auc,
  round(stddev_samp(auc), 6) AS std_heldout_auc, round(avg(acc), 6) AS mean_search_time_auc, round(avg(acc - auc), 6) AS mean_optimism_gap,
  round(avg(auc), 6) AS mean_confounded_fraction, round(avg(acc), 6) AS mean_negation_rate, round(avg(size), 6) AS mean_train_pairs,
  round(avg(size), 6) AS mean_hold_pairs, count(seed) AS num_seeds FROM t GROUP BY 1, 2""")


def _stability(t):
    best = od.best_row(t, ["seed", "method"], ["acc", "trial"]).select(
        "seed", "method", F.col("auc").alias("heldout_auc"), F.col("size").alias("keep_n"), F.col("acc").alias("search_time_auc"),
        (F.col("acc") - F.col("auc")).alias("optimism_gap"))
    out = ss.method_stability(best)
    return rounded(out, [c for c in out.columns if c.startswith(("mean_", "std_"))])


_t("method_stability", _stability, """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, method ORDER BY acc, trial) AS rn FROM t) WHERE rn = 1),
  win AS (SELECT method, count(*) AS wins FROM (SELECT method, row_number() OVER (PARTITION BY seed ORDER BY auc, method) AS r FROM b) WHERE r = 1 GROUP BY 1)
SELECT method, round(avg(auc), 6) AS mean_heldout_auc, round(coalesce(stddev_samp(auc), 0), 6) AS std_heldout_auc, round(avg(size), 6) AS mean_kept_count,
  round(coalesce(stddev_samp(size), 0), 6) AS std_kept_count, round(avg(acc), 6) AS mean_search_time_auc, round(avg(acc - auc), 6) AS mean_optimism_gap,
  count(*) AS num_seeds, coalesce(any_value(wins), 0) AS num_seeds_where_best FROM b LEFT JOIN win USING (method) GROUP BY 1""")


def _slots(spark, sf):
    plan = table(spark, sf, "part").groupBy("p_brand").agg((F.count(F.lit(1)) % 7).alias("n"))
    return od.expand_slots(plan, "p_brand", "p_brand", "n")


QUERIES["topic_slots"] = _slots
ORACLES["topic_slots"] = """WITH p AS (SELECT p_brand, count(*) % 7 AS n FROM part GROUP BY 1)
SELECT row_number() OVER (ORDER BY p_brand, i) AS slot_id, p_brand FROM p, range(7) t(i) WHERE i < n"""


# --- scored rows ----------------------------------------------------------------------
LINES = "(SELECT l_linestatus AS g, (l_returnflag = 'R')::INT AS y, l_quantity * l_discount + l_tax AS s FROM lineitem)"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") * F.col("l_discount") + F.col("l_tax")).alias("score"))


QUERIES["auc_with_ties"] = lambda spark, sf: rounded(metrics.auc(lines(spark, sf)), ["auc"])
ORACLES["auc_with_ties"] = f"SELECT round(auc, 6) AS auc, n_pos, n_neg FROM ({auc_sql(LINES, 's', 'y')})"
QUERIES["auc_by_group"] = lambda spark, sf: rounded(metrics.auc(lines(spark, sf), by=["g"]), ["auc"])
ORACLES["auc_by_group"] = f"SELECT g, round(auc, 6) AS auc, n_pos, n_neg FROM ({auc_sql(LINES, 's', 'y', 'g')})"

SCORED = f"WITH {sql_answers()}, sc AS (SELECT pair_id, label, lang, source, 1 / (1 + exp(-(0.02 * word_count - 0.1 * neg_cnt))) AS s FROM a)"


def scored(spark, sf):
    return answers(spark, sf).withColumn("score", 1.0 / (1.0 + F.exp(-(0.02 * F.col("word_count") - 0.1 * F.col("neg_cnt")))))


def _by_category(spark, sf):
    cat = audit_table(spark, sf).select("pair_id", "category")
    return rounded(metrics.auc(scored(spark, sf).join(cat, "pair_id"), by=["category"]), ["auc"])


QUERIES["auc_by_category"] = _by_category
ORACLES["auc_by_category"] = SCORED + f""", cat AS (SELECT doc_id // 2 AS pair_id, lang AS category FROM documents WHERE doc_id % 2 = 0),
x AS (SELECT * FROM sc JOIN cat USING (pair_id)) SELECT category, round(auc, 6) AS auc, n_pos, n_neg FROM ({auc_sql('x', 's', 'label', 'category')})"""


def _by_flag(spark, sf):
    flag = audit_table(spark, sf).select("pair_id", reshape.style_violation().alias("style_violation"))
    return rounded(metrics.auc(scored(spark, sf).join(flag, "pair_id"), by=["style_violation"]), ["auc"])


QUERIES["auc_clean_and_confounded"] = _by_flag
ORACLES["auc_clean_and_confounded"] = f"""WITH {sql_audit()}, sc AS (SELECT pair_id, label, 1 / (1 + exp(-(0.02 * word_count - 0.1 * neg_cnt))) AS s FROM a),
x AS (SELECT sc.*, (neg_lead_true = 1 OR neg_lead_false = 1 OR len_gap > 0.20 OR abs(hedge_rate_true - hedge_rate_false) > 0.02
  OR abs(auth_rate_true - auth_rate_false) > 0.01)::INT AS style_violation FROM sc JOIN w USING (pair_id))
SELECT style_violation, round(auc, 6) AS auc, n_pos, n_neg FROM ({auc_sql('x', 's', 'label', 'style_violation')})"""

QUERIES["confusion_report"] = lambda spark, sf: rounded(metrics.confusion_report(lines(spark, sf), by=["g"], cut=1.0), ["precision", "recall", "f1"])
ORACLES["confusion_report"] = f"""WITH x AS (SELECT g, y, (s >= 1.0)::INT AS p FROM {LINES}),
k AS (SELECT g, c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (p = c) AS predicted, count(*) FILTER (y = c AND p = c) AS hits
  FROM x, (VALUES (0), (1)) v(c) GROUP BY 1, 2)
SELECT *, round(hits / predicted, 6) AS precision, round(hits / support, 6) AS recall, round(2.0 * hits / (support + predicted), 6) AS f1 FROM k"""

REPLICATES = 30


def _bootstrap(spark, sf):
    return rounded(metrics.bootstrap_auc(scored(spark, sf), "pair_id", REPLICATES, 42), ["auc"])


STEPS = (24109, 48219, 60274, 64292, 65296, 65497, 65531, 65535)
_boot_sql = SCORED + f""", bw AS (SELECT pair_id, rep, (({sql_draw("'42'", "(rep // 3)", "pair_id")} >> (16 * (rep % 3))) & 65535) AS u
  FROM (SELECT DISTINCT pair_id FROM sc), range({REPLICATES}) t(rep)),
wt AS (SELECT pair_id, rep, {' + '.join(f'(u >= {s})::INT' for s in STEPS)} AS k FROM bw),
g AS (SELECT rep, s, sum(k) FILTER (label = 1) AS p, sum(k) FILTER (label = 0) AS n FROM sc JOIN wt USING (pair_id) WHERE k > 0 GROUP BY 1, 2),
h AS (SELECT rep, coalesce(p, 0) AS p, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
ba AS (SELECT rep AS replicate, sum(p * (below + n / 2.0)) / sum(p) / sum(n) AS auc FROM h GROUP BY 1)"""
QUERIES["bootstrap_auc"] = _bootstrap
ORACLES["bootstrap_auc"] = _boot_sql + " SELECT replicate, round(auc, 6) AS auc FROM ba"
QUERIES["bootstrap_interval"] = lambda spark, sf: rounded(metrics.interval(
    metrics.bootstrap_auc(scored(spark, sf), "pair_id", REPLICATES, 42)), ["ci_lo", "ci_hi"])
ORACLES["bootstrap_interval"] = _boot_sql + """ SELECT round(quantile_cont(auc, 0.025), 6) AS ci_lo, round(quantile_cont(auc, 0.975), 6) AS ci_hi,
  count(*) AS n_replicates FROM ba"""

for _n, _name, _pick in ((500, "auc", None), (1000, "interval", ["ci_lo", "ci_hi"])):
    def _many(spark, sf, n=_n, pick=_pick):
        drawn = metrics.bootstrap_auc(scored(spark, sf), "pair_id", n, 42)
        return rounded(metrics.interval(drawn), pick) if pick else rounded(drawn, ["auc"])
    QUERIES[f"bootstrap_{_name}_{_n}"] = _many
    ORACLES[f"bootstrap_{_name}_{_n}"] = ORACLES[f"bootstrap_{_name}"].replace(f"range({REPLICATES})", f"range({_n})")


# --- pair scores ----------------------------------------------------------------------
QUERIES["pair_deltas"] = lambda spark, sf: rounded(reshape.to_pairs(answers(spark, sf), FEATURES), [f"d_{f}" for f in FEATURES])
ORACLES["pair_deltas"] = f"WITH {sql_answers()} SELECT pair_id, " + ", ".join(
    f"round(max({f}) FILTER (label = 1) - max({f}) FILTER (label = 0), 6) AS d_{f}" for f in FEATURES) + " FROM a GROUP BY 1"

_imb_sql = f"""WITH {sql_answers()}, dl AS (SELECT pair_id, """ + ", ".join(
    f"max({f}) FILTER (label = 1) - max({f}) FILTER (label = 0) AS d_{f}" for f in FEATURES) + """ FROM a GROUP BY 1),
gp AS (SELECT """ + ", ".join(f"avg({f}) FILTER (label = 1) - avg({f}) FILTER (label = 0) AS g_{f}" for f in FEATURES) + """ FROM a)
SELECT pair_id, round(""" + " + ".join(f"CASE WHEN d_{f} * g_{f} > 0 THEN abs(d_{f}) ELSE 0 END" for f in FEATURES) + ", 6) AS imbalance FROM dl, gp"
QUERIES["pair_imbalance_scores"] = lambda spark, sf: rounded(
    scoring.pair_imbalance_wide(reshape.to_pairs(answers(spark, sf), FEATURES), FEATURES), ["imbalance"])
ORACLES["pair_imbalance_scores"] = _imb_sql
QUERIES["pair_imbalance_long_form"] = lambda spark, sf: rounded(scoring.pair_imbalance(answers(spark, sf), FEATURES), ["imbalance"])
ORACLES["pair_imbalance_long_form"] = _imb_sql

QUERIES["pair_confidence_scores"] = lambda spark, sf: rounded(scoring.pair_confidence(scored(spark, sf), ["pair_id"], "score"), ["confidence"])
ORACLES["pair_confidence_scores"] = SCORED + " SELECT pair_id, round(abs(max(s) FILTER (label = 1) - max(s) FILTER (label = 0)), 6) AS confidence FROM sc GROUP BY 1"
QUERIES["pair_separability"] = lambda spark, sf: rounded(scoring.pair_separability(scored(spark, sf), ["pair_id"]), ["separability"])
ORACLES["pair_separability"] = SCORED + " SELECT pair_id, round(avg(abs(s - 0.5)), 6) AS separability FROM sc GROUP BY 1"


# --- reshapes -------------------------------------------------------------------------
def _answers13(spark, sf):
    audit = audit_table(spark, sf).withColumn("temporal_fragile", (F.col("pair_id") % 2).cast("int"))
    out = reshape.to_answers(audit, profile="expanded13", meta=("category",))
    return rounded(out, [c for c in out.columns if c not in ("pair_id", "label", "category")])


QUERIES["answers_surface13"] = _answers13
_named = [f for f in FEATURES if f != "len_gap"]
ORACLES["answers_surface13"] = f"WITH {sql_audit()} " + " UNION ALL ".join(
    f"""SELECT pair_id, category, {v} AS label, {', '.join(f'round({f}_{s}, 6) AS {f}' for f in _named)}, round(len_gap, 6) AS len_gap,
  (pair_id % 2)::DOUBLE AS temporal_fragile, round(hedge_rate_true - hedge_rate_false, 6) AS hedge_pair_diff,
  round(auth_rate_true - auth_rate_false, 6) AS auth_pair_diff FROM w""" for v, s in ((1, "true"), (0, "false")))


def _stub(spark, sf):
    return rounded(reshape.to_stub_answers(cands(spark, sf)), ["hedge_rate", "auth_rate", "len_gap"])


QUERIES["answers_stub_profile"] = _stub
ORACLES["answers_stub_profile"] = C + " UNION ALL ".join(
    f"""SELECT example_id AS pair_id, {v} AS label, neg_lead_{s} AS neg_lead, neg_cnt_{s} AS neg_cnt, round(hedge_diff * {k}, 6) AS hedge_rate,
  round(authority_diff * {k}, 6) AS auth_rate, round(length_gap, 6) AS len_gap, 10.0::DOUBLE AS word_count, 1.0::DOUBLE AS sent_count,
  4.0::DOUBLE AS avg_token_len, 1.0::DOUBLE AS type_token, 0.0::DOUBLE AS punc_rate FROM c""" for v, s, k in ((1, "true", 0.5), (0, "false", 0.0)))


def _two_answers(spark, sf):
    d = table(spark, sf, "documents")
    half = F.when(F.col("lang") == "es", F.lit("  ")).otherwise(F.concat(F.lit(" "), "source"))
    out = reshape.split_two_answers(d.select("doc_id", F.col("lang").alias("right_answer"), half.alias("hallucinated_answer")),
                                    "doc_id", "right_answer", "hallucinated_answer")
    return out


QUERIES["two_answer_split"] = _two_answers
ORACLES["two_answer_split"] = """WITH k AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pair_id, lang, source FROM documents WHERE lang <> 'es')
SELECT pair_id, lang AS claim_text, 1 AS label FROM k UNION ALL SELECT pair_id, source, 0 FROM k"""

def _two_texts(spark, sf):
    """Texts of even and odd ids as the two answers; digests of the claims."""
    d = table(spark, sf, "documents").groupBy(F.expr("doc_id div 2").alias("k")).agg(
        F.max(F.when(F.col("doc_id") % 2 == 0, F.col("text"))).alias("right_answer"), F.max(F.when(F.col("doc_id") % 2 == 1, F.col("text"))).alias("hallucinated_answer"))
    out = reshape.split_two_answers(d, "k", "right_answer", "hallucinated_answer")
    return out.select("pair_id", F.md5(F.col("claim_text").cast("binary")).alias("claim_md5"), "label")


QUERIES["two_answer_split_texts"] = _two_texts
ORACLES["two_answer_split_texts"] = r"""WITH t AS (SELECT doc_id, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS c FROM documents),
p AS (SELECT doc_id // 2 AS k, max(c) FILTER (doc_id % 2 = 0) AS r, max(c) FILTER (doc_id % 2 = 1) AS w FROM t GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY k) - 1 AS pair_id, r, w FROM p WHERE r <> '' AND w <> '')
SELECT pair_id, md5(r) AS claim_md5, 1 AS label FROM k UNION ALL SELECT pair_id, md5(w), 0 FROM k"""

QUERIES["label_mapping"] = lambda spark, sf: reshape.map_labels(
    table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label")), "label", {"EN": 1, "FR": 0}).select("doc_id", "label")
ORACLES["label_mapping"] = "SELECT doc_id, (lang = 'en')::INT AS label FROM documents WHERE lang IN ('en', 'fr')"

QUERIES["row_window"] = lambda spark, sf: reshape.slice_rows(
    cands(spark, sf).select(F.col("example_id").alias("pair_id")), 10).agg(F.count(F.lit(1)).alias("n"), F.min("pair_id").alias("first"))
ORACLES["row_window"] = "SELECT count(*) AS n, min(pair_id) AS first FROM (SELECT DISTINCT doc_id // 2 AS pair_id FROM documents) WHERE pair_id >= 10"


def _nulls(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("quality").cast("double").alias("quality"), "toxic")
    return reshape.null_counts(d, ["doc_id", "quality", "toxic"]).unionByName(
        reshape.null_counts(reshape.fill_features(d, ["quality"]), ["quality"]).withColumn("column", F.lit("quality_filled")))


QUERIES["null_counts_and_fill"] = _nulls
ORACLES["null_counts_and_fill"] = """WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS n_null FROM j UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM j
UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM j UNION ALL SELECT 'quality_filled', 0 FROM j GROUP BY 1"""

QUERIES["constraint_pool"] = lambda spark, sf: reshape.sampling_pool(
    audit_table(spark, sf).join(table(spark, sf, "documents").select(F.expr("doc_id div 2").alias("pair_id"), "text").groupBy("pair_id").agg(
        F.min("text").alias("t"), F.max("text").alias("f")), "pair_id"), "t", "f").select("pair_id")
ORACLES["constraint_pool"] = f"""WITH {sql_audit()}, tx AS (SELECT doc_id // 2 AS pair_id, bool_or(starts_with(lower(text), 'i have no comment')) AS no_comment FROM documents GROUP BY 1)
SELECT pair_id FROM w JOIN tx USING (pair_id) WHERE NOT no_comment AND word_count_true >= 5 AND word_count_false >= 5 AND
  (neg_lead_true = 1 OR neg_lead_false = 1 OR len_gap > 0.20 OR abs(hedge_rate_true - hedge_rate_false) > 0.02 OR abs(auth_rate_true - auth_rate_false) > 0.01)"""


def _uniform(spark, sf):
    return table(spark, sf, "orders").select(F.floor(uniform(5, "check", "o_orderkey") * 10).alias("decile")).groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"))


QUERIES["uniform_draw_deciles"] = _uniform
ORACLES["uniform_draw_deciles"] = f"""SELECT floor({sql_draw("'5'", "'check'", "o_orderkey")} / {float(1 << 52)}::DOUBLE * 10)::BIGINT AS decile, count(*) AS n FROM orders GROUP BY 1"""
