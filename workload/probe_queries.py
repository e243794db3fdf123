"""Forced-choice statistics, one-sided probes, vectors and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.functions.stats import p_text, significance_label, wilson_interval
from veneer.operators import probe, reshape, scoring
from workload.common import FEATURES, SCORES_SQL, answers, probe_scores, rounded, sql_answers, table

QUERIES, ORACLES = {}, {}
S = f"WITH {SCORES_SQL} "
CHOICE = """count(*) AS n, count(*) FILTER (p_a > p_b) AS n_correct, count(*) FILTER (p_a = p_b) AS ties,
  round(avg((p_a > p_b)::INT), 6) AS pair_accuracy, round(avg(p_a - p_b), 6) AS mean_gap, round(avg(p_a), 6) AS mean_p_a, round(avg(p_b), 6) AS mean_p_b"""
CHOICE_COLS = ["pair_accuracy", "mean_gap", "mean_p_a", "mean_p_b"]


def _q(name, fn, sql, columns=()):
    QUERIES[name] = lambda spark, sf: rounded(fn(probe_scores(spark, sf)), columns)
    if sql:
        ORACLES[name] = S + sql


_q("forced_choice", probe.forced_choice, f"SELECT family, variant, {CHOICE} FROM s GROUP BY 1, 2", CHOICE_COLS)
_q("forced_choice_judge_passed", lambda s: probe.forced_choice(s.filter("judge_pass")),
   f"SELECT family, variant, {CHOICE} FROM s WHERE judge_pass GROUP BY 1, 2", CHOICE_COLS)
_q("full_vs_cleaned_drop", probe.full_vs_cleaned, """SELECT family, count(*) FILTER (variant = 'full') AS n_full, count(*) FILTER (variant = 'cleaned') AS n_cleaned,
  round(avg((p_a > p_b)::INT) FILTER (variant = 'full'), 6) AS acc_full, round(avg((p_a > p_b)::INT) FILTER (variant = 'cleaned'), 6) AS acc_cleaned,
  round(avg(p_a - p_b) FILTER (variant = 'full'), 6) AS gap_full, round(avg(p_a - p_b) FILTER (variant = 'cleaned'), 6) AS gap_cleaned,
  round(avg((p_a > p_b)::INT) FILTER (variant = 'full') - avg((p_a > p_b)::INT) FILTER (variant = 'cleaned'), 6) AS drop,
  round(avg(p_a - p_b) FILTER (variant = 'full') - avg(p_a - p_b) FILTER (variant = 'cleaned'), 6) AS gap_drop FROM s GROUP BY 1""",
   ["acc_full", "acc_cleaned", "gap_full", "gap_cleaned", "drop", "gap_drop"])
_q("paired_aggregate_by_strategy", probe.paired_aggregate,
   f"SELECT family, variant, strategy, {CHOICE} FROM s GROUP BY GROUPING SETS ((family, variant), (family, variant, strategy))", CHOICE_COLS)
_q("cleaning_effect", lambda s: probe.cleaning_effect(probe.forced_choice(s)), """SELECT family,
  round(avg((p_a > p_b)::INT) FILTER (variant = 'cleaned') - avg((p_a > p_b)::INT) FILTER (variant = 'full'), 6) AS accuracy_change,
  round(avg(p_a - p_b) FILTER (variant = 'cleaned') - avg(p_a - p_b) FILTER (variant = 'full'), 6) AS gap_change FROM s GROUP BY 1""",
   ["accuracy_change", "gap_change"])

MC = """, k AS (SELECT family, pair_id, max((p_a > p_b)::INT) FILTER (variant = 'full') AS f, max((p_a > p_b)::INT) FILTER (variant = 'cleaned') AS c FROM s GROUP BY 1, 2),
m AS (SELECT family, count(*) AS n, count(*) FILTER (f = 0 AND c = 1) AS b, count(*) FILTER (f = 1 AND c = 0) AS c FROM k GROUP BY 1)"""
_q("mcnemar_flips", lambda s: probe.mcnemar(s, with_p=False),
   MC + " SELECT family, n, b AS flips_to_right, c AS flips_to_wrong, b - c AS net_flip FROM m")
# two-sided exact binomial in log space: the doubled near tail
BINOM = """least(1.0, CASE WHEN {k} * 2 = {n} THEN 1.0 ELSE 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1),
  lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + {n} * ln(0.5)))) END)"""
_q("mcnemar_exact_p", lambda s: probe.mcnemar(s).select("family", "mcnemar_p"),
   MC + f" SELECT family, round({BINOM.format(k='least(b, c)', n='(b + c)')}, 6) AS mcnemar_p FROM m", ["mcnemar_p"])


def _wilson(s):
    low, high = wilson_interval(F.col("n_correct").cast("double"), F.col("n").cast("double"))
    return probe.forced_choice(s).select("family", "variant", low.alias("wilson_low"), high.alias("wilson_high"))


_q("wilson_intervals", _wilson, """, g AS (SELECT family, variant, count(*)::DOUBLE AS n, avg((p_a > p_b)::INT) AS p FROM s GROUP BY 1, 2)
SELECT family, variant, round(greatest(0, ((p + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS wilson_low,
  round(least(1, ((p + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS wilson_high FROM g""",
   ["wilson_low", "wilson_high"])


def _binomial(s):
    out = probe.forced_choice(s, ("family", "variant", "strategy"), with_tests=True)
    return out.select("family", "variant", "strategy", "p_vs_chance", significance_label(F.col("p_vs_chance")).alias("stars"),
                      p_text(F.col("p_vs_chance")).alias("shown"))


_q("binomial_tests_and_labels", _binomial, f""", g AS (SELECT family, variant, strategy, count(*) AS n, count(*) FILTER (p_a > p_b) AS k FROM s GROUP BY 1, 2, 3),
h AS (SELECT family, variant, strategy, {BINOM.format(k='k', n='n')} AS p FROM g)
SELECT family, variant, strategy, round(p, 6) AS p_vs_chance, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.10 THEN '.' ELSE '' END AS stars,
  CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS shown FROM h""", ["p_vs_chance"])
_q("unilateral_scores", lambda s: probe.unilateral(s.withColumnRenamed("p_a", "p")), """SELECT family, variant, count(p_a) AS n, round(avg(p_a), 6) AS mean_p,
  round(avg((p_a > 0.5)::INT), 6) AS share_above_half FROM s GROUP BY 1, 2""", ["mean_p", "share_above_half"])
SAME = """count(*) AS n, round(avg((p_b > p_a)::INT), 6) AS {0}, round(avg(p_a), 6) AS mean_p_a, round(avg(p_b), 6) AS mean_p_b, round(avg(p_b - p_a), 6) AS mean_gap"""
_q("bilateral_same_index", probe.bilateral_same_index, f"SELECT family, variant, {SAME.format('fool_rate')} FROM s GROUP BY 1, 2",
   ["fool_rate", "mean_p_a", "mean_p_b", "mean_gap"])
ALL = """SELECT {by}, sum(na) AS n_a, sum(nb) AS n_b, round(sum(nb * below) / sum(na) / sum(nb), 6) AS {name} FROM (
  SELECT *, coalesce(sum(na) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT {by}, p, sum(na)::DOUBLE AS na, sum(nb)::DOUBLE AS nb FROM (SELECT {by}, p_a AS p, 1 AS na, 0 AS nb FROM {src} UNION ALL SELECT {by}, p_b, 0, 1 FROM {src}) GROUP BY ALL)) GROUP BY ALL"""
_q("bilateral_all_pairs", lambda s: probe.bilateral_all_pairs(s.withColumnRenamed("p_a", "p"), s.withColumnRenamed("p_b", "p")),
   ALL.format(by="family, variant", name="fool_rate", src="s"), ["fool_rate", "n_a", "n_b"])
_q("family_bundle", probe.family_bundle, f""", x AS (SELECT 'all' AS scope, * FROM s UNION ALL SELECT 'passed', * FROM s WHERE judge_pass),
u AS (SELECT scope, family, variant, {SAME.format('same_index_fool_rate')}, round(avg((p_a > 0.5)::INT), 6) AS a_above_half, round(avg((p_b > 0.5)::INT), 6) AS b_above_half FROM x GROUP BY 1, 2, 3),
v AS ({ALL.format(by='scope, family, variant', name='all_pairs_fool_rate', src='x')}) SELECT u.*, all_pairs_fool_rate FROM u JOIN v USING (scope, family, variant)""",
   ["same_index_fool_rate", "mean_p_a", "mean_p_b", "mean_gap", "a_above_half", "b_above_half", "all_pairs_fool_rate"])


def _effects(s):
    """One cleaning effect per (family, seed); the seed is the order status."""
    return probe.cleaning_effect(probe.forced_choice(s, ("family", "variant", "strategy")), ("family", "strategy")).withColumnRenamed("strategy", "seed")


EFF = """, e AS (SELECT family, strategy AS seed, avg((p_a > p_b)::INT) FILTER (variant = 'cleaned') - avg((p_a > p_b)::INT) FILTER (variant = 'full') AS a,
  avg(p_a - p_b) FILTER (variant = 'cleaned') - avg(p_a - p_b) FILTER (variant = 'full') AS g FROM s GROUP BY 1, 2)"""
_q("multi_seed_summary", lambda s: probe.multi_seed_summary(_effects(s)), EFF + """ SELECT family, count(DISTINCT seed) AS n_seeds, round(avg(a), 6) AS accuracy_change_mean,
  round(stddev_samp(a), 6) AS accuracy_change_std, round(avg(g), 6) AS gap_change_mean, round(stddev_samp(g), 6) AS gap_change_std FROM e GROUP BY 1""",
   ["accuracy_change_mean", "accuracy_change_std", "gap_change_mean", "gap_change_std"])
_q("effects_by_seed", lambda s: probe.seed_columns(_effects(s), ["F", "O", "P"], "accuracy_change"), EFF + """ SELECT family,
  round(max(a) FILTER (seed = 'F'), 6) AS F, round(max(a) FILTER (seed = 'O'), 6) AS O, round(max(a) FILTER (seed = 'P'), 6) AS P FROM e GROUP BY 1""", ["F", "O", "P"])
_q("experiment_vs_experiment", lambda s: probe.experiment_delta(
    probe.forced_choice(s.filter("strategy = 'F'")), probe.forced_choice(s.filter("strategy = 'O' AND family <> '5-LOW'"))), """,
l AS (SELECT family, variant, avg((p_a > p_b)::INT) AS v FROM s WHERE strategy = 'F' GROUP BY 1, 2),
r AS (SELECT family, variant, avg((p_a > p_b)::INT) AS v FROM s WHERE strategy = 'O' AND family <> '5-LOW' GROUP BY 1, 2)
SELECT family, variant, round(l.v, 6) AS left_value, round(r.v, 6) AS right_value, round(r.v - l.v, 6) AS delta FROM l FULL JOIN r USING (family, variant)""",
   ["left_value", "right_value", "delta"])

# --- score shapes ---------------------------------------------------------------------
FAMILIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
ALL_FAMILIES = FAMILIES + ["4-NOT SPECIFIED", "5-LOW"]


def _pivot(s, families=FAMILIES):
    out = reshape.pivot_scores(s.withColumn("family", F.lower(F.replace("family", F.lit("-"), F.lit("")))), [f.lower().replace("-", "") for f in families])
    return rounded(out, [c for c in out.columns if c != "pair_id"])


_q("pivot_scores_all_families", lambda s: _pivot(s, ALL_FAMILIES), "SELECT pair_id, " + ", ".join(
    f"round(max({side}) FILTER (family = '{f}' AND variant = '{v}'), 6) AS \"{f.lower().replace('-', '')}_{v}_{side}\""
    for f in ALL_FAMILIES for v in ("full", "cleaned") for side in ("p_a", "p_b")) + " FROM s GROUP BY 1")
_q("pivot_scores", _pivot, "SELECT pair_id, " + ", ".join(
    f"round(max({side}) FILTER (family = '{f}' AND variant = '{v}'), 6) AS \"{f.lower().replace('-', '')}_{v}_{side}\""
    for f in FAMILIES for v in ("full", "cleaned") for side in ("p_a", "p_b")) + " FROM s GROUP BY 1")


def _nested(s):
    """Scores folded into a map per pair and opened again."""
    entry = F.struct(F.concat_ws("_", "family", "variant").alias("k"), F.struct(F.col("p_a").alias("P_A"), F.col("p_b").alias("P_B")).alias("v"))
    nested = s.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(entry)).alias("scores"))
    return reshape.explode_scores(nested)


_q("explode_nested_scores", _nested, "SELECT pair_id, family, variant, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b FROM s", ["p_a", "p_b"])


def _flat(s):
    wide = s.groupBy("pair_id").agg(*[F.max(F.when(F.col("variant") == v, F.col(f"p_{x.lower()}"))).alias(f"P_{x}_truthful_{v}")
                                      for x in "AB" for v in ("full", "cleaned")])
    return reshape.flat_scores(wide, "stored")


_q("flat_family_scores", _flat, "SELECT pair_id, 'stored' AS family, variant, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b FROM s", ["p_a", "p_b"])


def _sheet(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("statement"))
    verdicts = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("pair_id"), (F.col("o_orderstatus") == "F").alias("judged_false"))
    s = probe_scores(spark, sf).filter("variant = 'full' AND judge_pass").select("pair_id", F.col("p_a").alias("p_full"))
    return reshape.review_sheet(items, verdicts, s, "pair_id", ["p_full"])


QUERIES["review_sheet"] = _sheet
ORACLES["review_sheet"] = S + """SELECT o_orderkey AS pair_id, o_orderpriority AS statement, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS judged_false,
  coalesce(printf('%.4f', p_a), '') AS p_full, '' AS my_check, '' AS my_notes
FROM orders LEFT JOIN (SELECT pair_id, p_a FROM s WHERE variant = 'full' AND judge_pass) x ON x.pair_id = o_orderkey"""

QUERIES["short_labels"] = lambda spark, sf: table(spark, sf, "part").select("p_partkey", reshape.short_label(
    F.concat_ws("/", "p_brand", "p_type"), {"Brand#11/STANDARD": "std"}).alias("label"))
ORACLES["short_labels"] = "SELECT p_partkey, CASE WHEN p_brand || '/' || p_type = 'Brand#11/STANDARD' THEN 'std' ELSE split_part(p_brand || '/' || p_type, '/', -1) END AS label FROM part"

# --- vectors --------------------------------------------------------------------------


def _pooled(spark, sf):
    """Vectors of one label act as the tokens of one text."""
    e = table(spark, sf, "embeddings").withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    return rounded(scoring.mean_pool(e, "label", "embedding", "mask"), ["value"], 5)


QUERIES["masked_mean_pooling"] = _pooled
ORACLES["masked_mean_pooling"] = """SELECT label, position, round(avg(v::DOUBLE), 5) AS value FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings WHERE vec_id % 3 > 0) GROUP BY 1, 2"""


def _unit(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", scoring.l2_normalized("embedding").alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"),
                    F.round(F.element_at("u", 1), 5).alias("first"))


QUERIES["l2_normalized_vectors"] = _unit
ORACLES["l2_normalized_vectors"] = """SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings"""



def _whole_unit(spark, sf):
    """Every entry tells: the sum of the entries times their place beside the norm."""
    e = table(spark, sf, "embeddings").select("vec_id", scoring.l2_normalized("embedding").alias("u"))
    placed = F.aggregate(F.transform("u", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(placed, 4).alias("placed"))


QUERIES["l2_normalized_vectors_whole"] = _whole_unit
ORACLES["l2_normalized_vectors_whole"] = """SELECT vec_id, 1.0::DOUBLE AS norm, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i))
  / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS placed FROM embeddings"""

# --- scoring with a stored model ------------------------------------------------------
WEIGHTS = {"intercept": -0.4, "neg_lead": 0.5, "neg_cnt": 0.02, "hedge_rate": 3.0, "auth_rate": -2.0, "len_gap": 0.3,
           "word_count": 0.001, "sent_count": -0.01, "avg_token_len": 0.2, "type_token": -0.8, "punc_rate": 1.5}


def model(spark):
    return spark.createDataFrame([(k, v) for k, v in WEIGHTS.items()], "feature string, raw_weight double")


def _eta(gap):
    terms = [f"{w} * {gap if f == 'len_gap' else f}" for f, w in WEIGHTS.items() if f != "intercept"]
    return f"1 / (1 + exp(-({WEIGHTS['intercept']} + {' + '.join(terms)})))"


QUERIES["score_pairs_with_model"] = lambda spark, sf: rounded(scoring.score_features(
    answers(spark, sf), model(spark), FEATURES).select("doc_id", "p"), ["p"])
ORACLES["score_pairs_with_model"] = f"WITH {sql_answers()} SELECT doc_id, round({_eta('len_gap')}, 6) AS p FROM a"


def _single(spark, sf):
    a = answers(spark, sf)
    return rounded(scoring.score_single_texts(a.drop("len_gap"), model(spark), FEATURES, a).select("doc_id", "p"), ["p"])


QUERIES["score_single_texts_with_model"] = _single
ORACLES["score_single_texts_with_model"] = f"WITH {sql_answers()}, g AS (SELECT avg(len_gap) AS mg FROM a) SELECT doc_id, round({_eta('mg')}, 6) AS p FROM a, g"
