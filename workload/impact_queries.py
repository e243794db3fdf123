"""Prediction files: merges, impact tables, calibration, rank preservation."""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.operators import impact, merge, reshape
from veneer.operators.ordering import best_row
from veneer.plans import rank_preservation as rp
from workload.common import (PREDICTIONS_SQL, WIDE_RUNS_SQL, answers, audit_table, predictions, r6, rounded,
                             sql_audit, sql_draw, sql_violation, table, wide_runs)

QUERIES, ORACLES = {}, {}
COLS = "source_file, row_no, model_name, pair_id, correct"
P = f"WITH {PREDICTIONS_SQL} "


def _merge(name, fn, sql):
    QUERIES[name] = lambda spark, sf: fn(predictions(spark, sf))
    ORACLES[name] = P + sql


def _pick(part, order):
    return f"""SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rn FROM p) WHERE rn = 1"""


_merge("predictions_first_in_file", merge.first_in_file, _pick("source_file, model_name, pair_id", "row_no"))
_merge("predictions_last_in_file", merge.last_in_file, _pick("source_file, model_name, pair_id", "row_no DESC"))
_merge("predictions_last_wins", merge.last_wins, _pick("model_name, pair_id", "source_file DESC, row_no DESC"))
_merge("predictions_first_in_file_last_file", merge.first_in_file_last_file,
       _pick("model_name, pair_id", "source_file DESC, row_no"))
_merge("predictions_duplicate_report", merge.duplicate_report, """
SELECT count(*) AS rows_read, count(DISTINCT (source_file, model_name, pair_id)) AS rows_per_file,
  count(DISTINCT (model_name, pair_id)) AS rows_merged, count(*) - count(DISTINCT (model_name, pair_id)) AS rows_dropped FROM p""")
_merge("pairs_common_to_models", lambda p: merge.common_pairs(merge.last_wins(p)), """
SELECT pair_id FROM p GROUP BY 1 HAVING count(DISTINCT model_name) = (SELECT count(DISTINCT model_name) FROM p)""")
_merge("predictions_bounded_ids", lambda p: merge.bounded_ids(p, p.agg(F.floor(F.max("pair_id") / 2)).scalar()).groupBy(
    "model_name").agg(F.count(F.lit(1)).alias("n_rows"), F.max("pair_id").alias("max_pair")), """
SELECT model_name, count(*) AS n_rows, max(pair_id) AS max_pair FROM p
WHERE pair_id >= 0 AND pair_id < (SELECT floor(max(pair_id) / 2) FROM p) GROUP BY 1""")


# --- impact ---------------------------------------------------------------------------
FLAGS = f"{sql_audit()}, fl AS (SELECT pair_id, {sql_violation()} AS style_violation FROM w)"
SPLITS = """round(avg((correct = 1)::INT), 6) AS acc_all,
  round(avg((correct = 1)::INT) FILTER (style_violation = 0), 6) AS acc_clean,
  round(avg((correct = 1)::INT) FILTER (style_violation = 1), 6) AS acc_confounded, count(*) AS n_all,
  count(*) FILTER (style_violation = 0) AS n_clean, count(*) FILTER (style_violation = 1) AS n_confounded,
  round(avg((correct = 1)::INT) FILTER (style_violation = 1) - avg((correct = 1)::INT) FILTER (style_violation = 0), 6) AS delta_conf_clean"""
METRICS = ["acc_all", "acc_clean", "acc_confounded", "delta_conf_clean"]


def flags(spark, sf):
    return audit_table(spark, sf).select("pair_id", reshape.style_violation().alias("style_violation"))


def _by_file(spark, sf):
    return rounded(impact.impact_by_file(predictions(spark, sf), flags(spark, sf)), METRICS)


FIRST_FILE = _pick("source_file, model_name, pair_id", "row_no")
LAST_FILE = _pick("source_file, model_name, pair_id", "row_no DESC")
LAST = _pick("model_name, pair_id", "source_file DESC, row_no DESC")
QUERIES["impact_by_file"] = _by_file
ORACLES["impact_by_file"] = f"""WITH {FLAGS}, {PREDICTIONS_SQL}, m AS ({FIRST_FILE})
SELECT source_file, model_name, {SPLITS} FROM m JOIN fl USING (pair_id) GROUP BY 1, 2"""

QUERIES["impact_by_model"] = lambda spark, sf: rounded(
    impact.impact_by_model(predictions(spark, sf), flags(spark, sf)), METRICS)
ORACLES["impact_by_model"] = f"""WITH {FLAGS}, {PREDICTIONS_SQL}, m AS ({LAST})
SELECT model_name, {SPLITS} FROM m JOIN fl USING (pair_id) GROUP BY 1 ORDER BY acc_all DESC, model_name"""


def _grouping_sets(spark, sf):
    runs = merge.merge_predictions(wide_runs(spark, sf), "first", "keep")
    return rounded(impact.accuracy_grouping_sets(impact.with_flags(runs, flags(spark, sf))), ["accuracy"])


QUERIES["impact_grouping_sets"] = _grouping_sets
ORACLES["impact_grouping_sets"] = f"""WITH {FLAGS}, {WIDE_RUNS_SQL}, m AS ({FIRST_FILE})
SELECT source_file, model_name, CASE WHEN style_violation IS NULL THEN 'all' WHEN style_violation = 1 THEN 'confounded' ELSE 'clean' END AS split,
  round(avg((correct = 1)::INT), 6) AS accuracy, count(*) AS n
FROM m JOIN fl USING (pair_id) GROUP BY GROUPING SETS ((source_file, model_name, style_violation), (source_file, model_name))"""

QUERIES["seed_summary"] = lambda spark, sf: rounded(impact.seed_summary(
    impact.impact_by_file(predictions(spark, sf), flags(spark, sf), "last")),
    ["delta_mean", "delta_std", "sign_frac_pos", "acc_all_mean"])
ORACLES["seed_summary"] = f"""WITH {FLAGS}, {PREDICTIONS_SQL}, m AS ({LAST_FILE}),
b AS (SELECT source_file, model_name, avg((correct = 1)::INT) AS acc_all,
  avg((correct = 1)::INT) FILTER (style_violation = 1) - avg((correct = 1)::INT) FILTER (style_violation = 0) AS delta
  FROM m JOIN fl USING (pair_id) GROUP BY 1, 2)
SELECT model_name, count(delta) AS n_runs, round(avg(delta), 6) AS delta_mean, round(stddev_samp(delta), 6) AS delta_std,
  round(avg((coalesce(delta, 0) > 0)::INT), 6) AS sign_frac_pos, round(avg(acc_all), 6) AS acc_all_mean FROM b GROUP BY 1"""


def run_flags(spark, sf):
    """Flags of the pairs that occur in the prediction table, written once: every later step reads them."""
    from veneer.session import cut_lineage
    return cut_lineage(_run_flags(spark, sf))


def _run_flags(spark, sf):
    return reshape.take_pairs(flags(spark, sf), table(spark, sf, "events").select(F.col("user_id").alias("pair_id")))


def single_runs(spark, sf):
    return predictions(spark, sf).withColumn("source_file", F.lit("all.csv"))


SINGLE_SQL = """p AS (SELECT 'all.csv' AS source_file, event_id AS row_no, event_type AS model_name, user_id AS pair_id,
  (value > 10)::INT AS correct FROM events)"""
RUN_FLAGS = f"{FLAGS}, rf AS (SELECT * FROM fl WHERE pair_id IN (SELECT user_id FROM events))"


def _complete(spark, sf):
    runs = merge.merge_predictions(wide_runs(spark, sf), "last", "keep")
    return impact.complete_runs(runs, run_flags(spark, sf)).groupBy("source_file", "model_name").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("correct").alias("n_right"))


QUERIES["complete_runs"] = _complete
ORACLES["complete_runs"] = f"""WITH {RUN_FLAGS}, {WIDE_RUNS_SQL}, m AS ({LAST_FILE})
SELECT source_file, model_name, count(*) AS n_pairs, sum(correct) AS n_right FROM m JOIN rf USING (pair_id)
GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM rf)"""

SHUFFLES = 60
CALIBRATION = ["delta_mean_observed", "null_mean", "null_std", "p_value_one_sided_ge", "null_p90", "null_p95"]


def _calibration(shuffles):
    return lambda spark, sf: rounded(impact.permutation_calibration(single_runs(spark, sf), run_flags(spark, sf), shuffles), CALIBRATION)


QUERIES["permutation_calibration"] = _calibration(SHUFFLES)
ORACLES["permutation_calibration"] = f"""WITH {RUN_FLAGS}, {SINGLE_SQL}, m AS ({LAST_FILE}),
k AS (SELECT m.* FROM m JOIN rf USING (pair_id)),
full_runs AS (SELECT source_file, model_name FROM k GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM rf)),
c AS (SELECT k.* FROM k JOIN full_runs USING (source_file, model_name)),
sh AS (SELECT seed, pair_id, (row_number() OVER (PARTITION BY seed ORDER BY h, pair_id) <= (SELECT sum(style_violation) FROM rf))::INT AS style_violation
  FROM (SELECT seed, pair_id, {sql_draw("seed", "'flag'", "pair_id")} AS h FROM rf, range({SHUFFLES}) t(seed))
  UNION ALL SELECT -1, pair_id, style_violation FROM rf),
dd AS (SELECT source_file, model_name, seed, avg(correct) FILTER (style_violation = 1) - avg(correct) FILTER (style_violation = 0) AS delta
  FROM c JOIN sh USING (pair_id) GROUP BY 1, 2, 3),
g AS (SELECT model_name, seed, avg(delta) AS delta, count(*) AS n_runs FROM dd GROUP BY 1, 2),
o AS (SELECT model_name, delta AS obs, n_runs FROM g WHERE seed = -1)
SELECT model_name, any_value(n_runs_o) AS n_runs, round(any_value(obs), 6) AS delta_mean_observed, round(avg(delta), 6) AS null_mean,
  round(stddev_pop(delta), 6) AS null_std, round(avg((delta >= obs - 1e-12)::INT), 6) AS p_value_one_sided_ge,
  round(quantile_cont(delta, 0.90), 6) AS null_p90, round(quantile_cont(delta, 0.95), 6) AS null_p95
FROM g JOIN (SELECT model_name, obs, n_runs AS n_runs_o FROM o) USING (model_name)
WHERE seed >= 0 AND (SELECT count(*) FROM full_runs) >= 3 GROUP BY 1"""


QUERIES["permutation_calibration_300"] = _calibration(300)
ORACLES["permutation_calibration_300"] = ORACLES["permutation_calibration"].replace(f"range({SHUFFLES})", "range(300)")


def _report(spark, sf, shuffles=20):
    """Impact, seed stability and calibration side by side for reporting."""
    f = run_flags(spark, sf)
    main = impact.impact_by_model(single_runs(spark, sf), f).select("model_name", "acc_all", "delta_conf_clean")
    seeds = impact.seed_summary(impact.impact_by_file(wide_runs(spark, sf), f, "last")).select("model_name", "n_runs", "delta_std")
    cal = impact.permutation_calibration(single_runs(spark, sf), f, shuffles).select("model_name", "p_value_one_sided_ge")
    out = main.join(cal, "model_name", "left").join(seeds, "model_name", "left")
    label = F.when(F.col("p_value_one_sided_ge") <= 0.05, "beyond null").otherwise("within null")
    return rounded(out.withColumn("verdict", label).withColumn("label", reshape.short_label(F.concat(F.lit("hub/"), "model_name"))),
                   ["acc_all", "delta_conf_clean", "delta_std", "p_value_one_sided_ge"])


QUERIES["impact_report"] = _report
ORACLES["impact_report"] = ORACLES["permutation_calibration"].split("SELECT model_name, any_value")[0].replace(
    f"range({SHUFFLES})", "range(20)") + f""", cal AS (SELECT g.model_name, avg((delta >= obs - 1e-12)::INT) AS p
  FROM g JOIN o USING (model_name) WHERE seed >= 0 GROUP BY 1),
main AS (SELECT model_name, avg(correct) AS acc_all, avg(correct) FILTER (style_violation = 1) - avg(correct) FILTER (style_violation = 0) AS delta
  FROM m JOIN rf USING (pair_id) GROUP BY 1),
wr AS (SELECT CASE WHEN hour(ts) < 12 THEN 'a.csv' ELSE 'b.csv' END AS source_file, event_id AS row_no, event_type AS model_name,
  user_id AS pair_id, (value > 10)::INT AS correct FROM events),
wm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, model_name, pair_id ORDER BY row_no DESC) AS rn FROM wr) WHERE rn = 1),
wf AS (SELECT source_file, model_name, avg(correct) FILTER (style_violation = 1) - avg(correct) FILTER (style_violation = 0) AS delta
  FROM wm JOIN rf USING (pair_id) GROUP BY 1, 2),
ws AS (SELECT model_name, count(delta) AS n_runs, stddev_samp(delta) AS delta_std FROM wf GROUP BY 1)
SELECT model_name, round(acc_all, 6) AS acc_all, round(main.delta, 6) AS delta_conf_clean, round(p, 6) AS p_value_one_sided_ge,
  n_runs, round(delta_std, 6) AS delta_std, CASE WHEN p <= 0.05 THEN 'beyond null' ELSE 'within null' END AS verdict, model_name AS label
FROM main LEFT JOIN cal USING (model_name) LEFT JOIN ws USING (model_name)"""
QUERIES["impact_report_300"] = lambda spark, sf: _report(spark, sf, 300)
ORACLES["impact_report_300"] = ORACLES["impact_report"].replace("range(20)", "range(300)")


# --- rank preservation ----------------------------------------------------------------
def subsets(spark, sf):
    """Named id sets: one per text source, plus one without any answered pair."""
    d = answers(spark, sf).filter("label = 1")
    named = d.select(F.concat(F.lit("subset_"), "source").alias("subset_name"), "pair_id")
    far = d.select(F.lit("subset_empty").alias("subset_name"), (F.col("pair_id") + 1_000_000_000).alias("pair_id"))
    return named.unionByName(far)


def n_pairs(spark, sf):
    return answers(spark, sf).agg(F.max("pair_id") + 1).scalar()


SUBSETS_SQL = """sub AS (SELECT 'subset_' || source AS subset_name, doc_id // 2 AS pair_id FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'subset_empty', doc_id // 2 + 1000000000 FROM documents WHERE doc_id % 2 = 0)"""
RANK_SQL = f"""WITH {PREDICTIONS_SQL}, {SUBSETS_SQL}, np AS (SELECT max(doc_id // 2) + 1 AS n FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT p.* FROM p, np WHERE pair_id >= 0 AND pair_id < n),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, pair_id ORDER BY source_file DESC, row_no) AS rn FROM b) WHERE rn = 1),
com AS (SELECT pair_id FROM m GROUP BY 1 HAVING count(DISTINCT model_name) = (SELECT count(DISTINCT model_name) FROM m)),
sc AS (SELECT model_name, pair_id, correct FROM m WHERE pair_id IN (SELECT pair_id FROM com)),
fa AS (SELECT model_name, avg(correct) AS acc_full FROM sc GROUP BY 1),
su AS (SELECT subset_name, model_name, avg(correct) AS acc_sub, count(*) AS eval_pairs FROM sc JOIN sub USING (pair_id) GROUP BY 1, 2),
t AS (SELECT * FROM su JOIN fa USING (model_name)),
rk AS (SELECT *, rank() OVER (PARTITION BY subset_name ORDER BY acc_full) + (count(*) OVER (PARTITION BY subset_name, acc_full) - 1) / 2.0 AS rf,
  rank() OVER (PARTITION BY subset_name ORDER BY acc_sub) + (count(*) OVER (PARTITION BY subset_name, acc_sub) - 1) / 2.0 AS rs FROM t),
sp AS (SELECT subset_name, count(*) AS n_models, max(eval_pairs) AS eval_pair_count,
  CASE WHEN count(*) >= 2 AND stddev_pop(rf) > 0 AND stddev_pop(rs) > 0 THEN corr(rf, rs) END AS spearman FROM rk GROUP BY 1),
kd AS (SELECT a.subset_name, sum(sign(a.acc_full - b.acc_full) * sign(a.acc_sub - b.acc_sub)) AS c,
  sum(abs(sign(a.acc_full - b.acc_full))) AS nf, sum(abs(sign(a.acc_sub - b.acc_sub))) AS ns
  FROM t a JOIN t b ON a.subset_name = b.subset_name AND a.model_name < b.model_name GROUP BY 1),
rep AS (SELECT z.subset_name, z.retained_pairs, n_models, spearman, CASE WHEN nf > 0 AND ns > 0 THEN c / sqrt(nf * ns) END AS kendall,
  coalesce(eval_pair_count, 0) AS eval_pair_count, (SELECT count(*) FROM com) AS intersection_n,
  z.retained_pairs / (SELECT n FROM np)::DOUBLE AS retained_fraction,
  CASE WHEN coalesce(eval_pair_count, 0) = 0 THEN 'no pairs after intersection' ELSE '' END AS error
  FROM (SELECT subset_name, count(DISTINCT pair_id) AS retained_pairs FROM sub GROUP BY 1) z LEFT JOIN sp USING (subset_name) LEFT JOIN kd USING (subset_name))
"""


def _rank(spark, sf):
    return rp.rank_report(predictions(spark, sf), subsets(spark, sf), n_pairs(spark, sf))


RANKED = ["spearman", "kendall", "retained_fraction"]
QUERIES["rank_preservation_report"] = lambda spark, sf: rounded(_rank(spark, sf), RANKED)
ORACLES["rank_preservation_report"] = RANK_SQL + """SELECT subset_name, retained_pairs, n_models, round(spearman, 6) AS spearman,
  round(kendall, 6) AS kendall, eval_pair_count, intersection_n, round(retained_fraction, 6) AS retained_fraction, error FROM rep"""

QUERIES["rank_preservation_by_model"] = lambda spark, sf: rounded(
    rp.model_breakdown(predictions(spark, sf), subsets(spark, sf), n_pairs(spark, sf)), ["acc_full", "acc_sub", "accuracy_shift"])
ORACLES["rank_preservation_by_model"] = RANK_SQL + """SELECT subset_name, model_name, round(acc_full, 6) AS acc_full,
  round(acc_sub, 6) AS acc_sub, eval_pairs, round(acc_sub - acc_full, 6) AS accuracy_shift FROM t"""


def _best(spark, sf):
    report = _rank(spark, sf).withColumns({c: F.round(c, 9) for c in ("spearman", "kendall")})
    return rounded(rp.best_subset(report).select("subset_name", "spearman", "kendall", "retained_pairs"), ["spearman", "kendall"])


QUERIES["rank_preservation_best_subset"] = _best
ORACLES["rank_preservation_best_subset"] = RANK_SQL + """SELECT subset_name, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall, retained_pairs
FROM rep WHERE spearman IS NOT NULL ORDER BY round(spearman, 9) DESC, round(coalesce(kendall, -2), 9) DESC, retained_pairs DESC, subset_name LIMIT 1"""


def _bridge(spark, sf, with_p=False):
    scores = answers(spark, sf).filter("label = 1").select("pair_id", F.col("len_gap").alias("surface_score"))
    return rounded(impact.surface_bridge(merge.last_wins(predictions(spark, sf)), scores, with_p=with_p),
                   ["spearman_r"] + (["p_value"] if with_p else []))


QUERIES["surface_bridge_spearman"] = _bridge
ORACLES["surface_bridge_spearman"] = f"""WITH {sql_audit()}, {PREDICTIONS_SQL}, m AS ({LAST}),
j AS (SELECT model_name, correct, len_gap FROM m JOIN w USING (pair_id)),
k AS (SELECT model_name, rank() OVER (PARTITION BY model_name ORDER BY correct) + (count(*) OVER (PARTITION BY model_name, correct) - 1) / 2.0 AS rc,
  rank() OVER (PARTITION BY model_name ORDER BY len_gap) + (count(*) OVER (PARTITION BY model_name, len_gap) - 1) / 2.0 AS rl FROM j)
SELECT model_name, round(corr(rc, rl), 6) AS spearman_r, count(*) AS n_pairs FROM k GROUP BY 1"""
QUERIES["surface_bridge_p_values"] = lambda spark, sf: _bridge(spark, sf, True)


# --- joins, sets, merges --------------------------------------------------------------
def _orders_keys(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


def _line_keys(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))


QUERIES["id_coverage"] = lambda spark, sf: merge.coverage(_orders_keys(spark, sf), _line_keys(spark, sf), "id")
ORACLES["id_coverage"] = """WITH l AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), o AS (SELECT DISTINCT o_orderkey AS id FROM orders)
SELECT count(*) FILTER (l.id IS NOT NULL AND o.id IS NOT NULL) AS n_both, count(*) FILTER (l.id IS NULL) AS n_missing,
  count(*) FILTER (o.id IS NULL) AS n_extra FROM o FULL JOIN l ON o.id = l.id"""

QUERIES["covering_join"] = lambda spark, sf: merge.join_covering(
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"),
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id").groupBy("o_orderstatus").agg(
    F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
ORACLES["covering_join"] = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"

QUERIES["left_join_with_defaults"] = lambda spark, sf: merge.left_with_defaults(
    table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id",
    {"quality": -1, "toxic": 0})
ORACLES["left_join_with_defaults"] = """SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)"""

QUERIES["set_equality"] = lambda spark, sf: merge.set_difference_report(_orders_keys(spark, sf), _line_keys(spark, sf), "id")
ORACLES["set_equality"] = """WITH r AS (""" + ORACLES["id_coverage"] + """)
SELECT n_missing AS only_left, n_extra AS only_right, n_both AS in_both, n_missing = 0 AND n_extra = 0 AS equal FROM r"""

QUERIES["id_containment"] = lambda spark, sf: merge.containment(_line_keys(spark, sf), _orders_keys(spark, sf), "id")
ORACLES["id_containment"] = """SELECT count(*) FILTER (id IN (SELECT o_orderkey FROM orders)) AS n_overlap,
  count(*) FILTER (id NOT IN (SELECT o_orderkey FROM orders)) AS n_outside,
  count(*) FILTER (id NOT IN (SELECT o_orderkey FROM orders)) = 0 AS contained FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem)"""

QUERIES["subset_semi_join"] = lambda spark, sf: reshape.take_pairs(
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"), "o_orderstatus"),
    _line_keys(spark, sf).withColumnRenamed("id", "pair_id")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
ORACLES["subset_semi_join"] = """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"""

QUERIES["pending_anti_join"] = lambda spark, sf: merge.unmatched(
    table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id").groupBy("source").agg(
    F.count(F.lit(1)).alias("n_pending"))
ORACLES["pending_anti_join"] = """SELECT source, count(*) AS n_pending FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"""


def _first_seen(spark, sf):
    return merge.first_seen(table(spark, sf, "documents").select("text", "doc_id"), "text", "doc_id").select("doc_id")


QUERIES["first_seen_texts"] = _first_seen
ORACLES["first_seen_texts"] = "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"


def _case_distinct(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(
        "text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("word"))
    return merge.distinct_ignoring_case(words.withColumn("at", F.struct("doc_id", "word")), "word", "at").select("word")


QUERIES["distinct_ignoring_case"] = _case_distinct
ORACLES["distinct_ignoring_case"] = """SELECT arg_min(word, (doc_id, encode(word))) AS word FROM (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents) GROUP BY lower(word)"""


def _prioritized(spark, sf):
    r = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("priority"), (F.col("l_quantity") > 30).alias("passes"))
    best = merge.prioritized_merge(r.distinct(), "id", "priority", "passes")
    return merge.source_distribution(best, "priority")


QUERIES["prioritized_source_merge"] = _prioritized
ORACLES["prioritized_source_merge"] = """SELECT priority, count(*) AS n FROM (
  SELECT l_partkey AS id, l_linenumber AS priority, l_quantity > 30 AS passes,
    row_number() OVER (PARTITION BY l_partkey ORDER BY (NOT (l_quantity > 30))::INT, l_linenumber) AS rn FROM lineitem)
WHERE rn = 1 AND passes GROUP BY 1"""


def _match_status(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(
        F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("matched_id"))
    return merge.match_status(o, "row_id", "matched_id").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("row_sum"))


QUERIES["match_status"] = _match_status
ORACLES["match_status"] = """SELECT status, count(*) AS n, sum(row_id) AS row_sum FROM (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 'unmatched'
    WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'F' ORDER BY o_orderkey) = 1 THEN 'matched' ELSE 'duplicate_pair_id_skipped' END AS status
  FROM orders) GROUP BY 1"""


def _anchors(spark, sf):
    from veneer.functions.text import normalized_text
    d = table(spark, sf, "documents")
    key = normalized_text(F.col("text"))
    pairs_ = d.select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("q_key"), F.col("source").alias("a_key"),
                      F.md5(key).alias("incorrect_key"))
    queries = d.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("q_key"), F.col("source").alias("a_key"),
                       F.array(F.md5(key), F.lit("none")).alias("wrongs"))
    return merge.match_anchors(queries, pairs_)


QUERIES["anchor_matching"] = _anchors
ORACLES["anchor_matching"] = r"""WITH n AS (SELECT doc_id, lang, source, regexp_replace(replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'),
  '\s+', ' ', 'g'), ' in the california', ' in california'), '\.+$', '') AS key FROM documents),
f AS (SELECT doc_id AS row_id, min(doc_id) OVER (PARTITION BY lang, source, key) AS pair_id FROM n)
SELECT row_id, pair_id, CASE WHEN row_number() OVER (PARTITION BY pair_id ORDER BY row_id) = 1 THEN 'matched' ELSE 'duplicate_pair_id_skipped' END AS status FROM f"""


def _fingerprint(spark, sf):
    li = table(spark, sf, "lineitem")
    # dealt anew into more parts than it is read in, so that no task takes more as the table grows
    whole, again = merge.fingerprint(li), merge.fingerprint(li.repartition(max(5, 2 * li.rdd.getNumPartitions() + 1)))
    return whole.select("n_rows", "low_sum", "high_sum").unionByName(again).distinct().agg(
        F.count(F.lit(1)).alias("n_fingerprints"), F.max("n_rows").alias("n_rows"))


QUERIES["table_fingerprint"] = _fingerprint
ORACLES["table_fingerprint"] = "SELECT 1::BIGINT AS n_fingerprints, count(*) AS n_rows FROM lineitem"


def _compare(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    b = a.withColumn("o_totalprice", F.round("o_totalprice", 1))
    return rounded(merge.compare_tables(a, b, "o_orderkey", ["o_totalprice"], 0.02), ["max_abs_diff"])


QUERIES["table_compare"] = _compare
ORACLES["table_compare"] = """SELECT 'o_totalprice' AS "column", count(*) AS n, round(max(abs(o_totalprice - round(o_totalprice, 1))), 6) AS max_abs_diff,
  count(*) FILTER (abs(o_totalprice - round(o_totalprice, 1)) > 0.02) AS n_over FROM orders"""


def _status(spark, sf):
    from workload.common import probe_scores
    s = probe_scores(spark, sf).filter("variant = 'full'").select("pair_id", "family")
    expected = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("pair_id"))
    families = s.select("family").distinct().unionByName(spark.range(1).select(F.lit("absent").alias("family")))
    return merge.source_status(expected, families, s).select("family", "status", "n_present", "n_missing",
                                                             F.concat_ws(",", F.transform("first_missing", lambda x: x.cast("string"))).alias("first_ids"))


QUERIES["source_status"] = _status
ORACLES["source_status"] = """WITH e AS (SELECT o_orderkey AS pair_id FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT DISTINCT o_orderkey AS pair_id, o_orderpriority AS family FROM orders),
fam AS (SELECT DISTINCT family FROM s UNION SELECT 'absent'),
x AS (SELECT fam.family, e.pair_id, s.pair_id IS NOT NULL AS have FROM fam CROSS JOIN e LEFT JOIN s ON s.family = fam.family AND s.pair_id = e.pair_id)
SELECT family, CASE WHEN family NOT IN (SELECT family FROM s) THEN 'missing' WHEN count(*) FILTER (have) < count(*) THEN 'incomplete' ELSE 'ok' END AS status,
  count(*) FILTER (have) AS n_present, count(*) FILTER (NOT have) AS n_missing,
  coalesce(array_to_string(list_sort(list(pair_id) FILTER (NOT have))[1:5], ','), '') AS first_ids FROM x GROUP BY 1"""


def _mismatch(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("doc_id", F.col("text").alias("x"))
    b = d.select("doc_id", F.when(F.col("lang") == "en", F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(F.lower("text")).alias("y"))
    return merge.text_mismatches(a, b, "doc_id", "x", "y").select("doc_id")


QUERIES["text_cross_check"] = _mismatch
ORACLES["text_cross_check"] = "SELECT doc_id FROM documents WHERE lang <> 'en' AND trim(text, ' ') <> trim(lower(text), ' ')"


def _union(spark, sf):
    parts = {s: predictions(spark, sf).filter(F.col("model_name") == s).select("pair_id", "correct") for s in ("click", "view", "error")}
    return merge.source_distribution(merge.union_sources(parts))


QUERIES["union_with_source"] = _union
ORACLES["union_with_source"] = "SELECT event_type AS source, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1"


def _union_all(spark, sf):
    p = predictions(spark, sf)
    names = [r[0] for r in p.select("model_name").distinct().orderBy("model_name").collect()]  # one row per event type
    return merge.source_distribution(merge.union_sources({s: p.filter(F.col("model_name") == s).select("pair_id", "correct") for s in names}))


QUERIES["union_with_source_all"] = _union_all
ORACLES["union_with_source_all"] = "SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1"


def _aligned(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    f = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    return reshape.align_by_position(d, f).groupBy("lang").agg(F.sum("n_chars").alias("chars"))


QUERIES["align_by_position"] = _aligned
ORACLES["align_by_position"] = "SELECT lang, sum(n_chars) AS chars FROM documents GROUP BY 1"
