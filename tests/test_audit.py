"""The batched audit against plain numpy, and its edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import numpy_twins as ref
from veneer.functions.draws import WORD_BITS, coin_flips
from veneer.operators import audit, folds, logistic, metrics, ordering, scoring, trial_labels
from veneer.operators.single import attach
from veneer.plans import surface_audit as sa

NAMES = list("abcd")


@pytest.fixture(scope="module")
def data(spark):
    x, y, pair = ref.toy(60, seed=1)
    pdf = pd.DataFrame(x, columns=NAMES).assign(pair_id=pair, label=y, row_id=np.arange(len(y)))
    df = spark.createDataFrame(pdf).withColumn("fold", folds.dense_fold("pair_id"))
    return x, y, pair, df.cache()


def scores(run, trial=0):
    rows = run.long().filter(F.col("trial") == trial).orderBy("row_id").collect()
    return np.array([r["score"] for r in rows])


def test_oof_probabilities_match_numpy(data):
    x, y, pair, df = data
    run = audit.run_audit(df, NAMES, ["row_id"], F.array("label", 1 - F.col("label")), 2)
    assert np.abs(scores(run) - ref.oof(x, y, pair % 5)).max() < 1e-8
    assert np.abs(scores(run, 1) - ref.oof(x, 1 - y, pair % 5)).max() < 1e-8
    got = {r["trial"]: r for r in run.metrics().collect()}
    assert got[0]["auc"] == pytest.approx(ref.auc(y, ref.oof(x, y, pair % 5)), abs=1e-9)


def test_partitioning_does_not_matter(data):
    _, _, _, df = data
    few = audit.run_audit(df.repartition(2), NAMES, ["row_id"], F.array("label"), 1).metrics().first()
    many = audit.run_audit(df.repartition(13), NAMES, ["row_id"], F.array("label"), 1).metrics().first()
    assert few["auc"] == many["auc"] and few["accuracy"] == many["accuracy"]


def test_masks_equal_dropping_and_zeroing(data):
    x, y, pair, df = data
    mask = np.array([[True, False, True, True]])
    masked = audit.trial_metrics(df, NAMES, [F.col("label")], masks=mask)[0]["auc"]
    dropped = audit.trial_metrics(df, ["a", "c", "d"], [F.col("label")])[0]["auc"]
    zeroed = audit.trial_metrics(sa.zeroed(df, ["b"]), NAMES, [F.col("label")])[0]["auc"]
    assert masked == pytest.approx(dropped, abs=1e-12) and zeroed == pytest.approx(dropped, abs=1e-12)
    assert dropped == pytest.approx(ref.auc(y, ref.oof(x[:, [0, 2, 3]], y, pair % 5)), abs=1e-9)


def test_subset_trials(data):
    x, y, pair, df = data
    got = audit.trial_metrics(df, NAMES, [F.when(F.col("pair_id") < 30, F.col("label")).otherwise(-1),
                                          F.when(F.col("pair_id") < 3, F.col("label")).otherwise(-1)])
    keep = pair < 30
    assert got[0]["auc"] == pytest.approx(ref.auc(y[keep], ref.oof(x[keep], y[keep], pair[keep] % 5)), abs=1e-9)
    assert got[1]["auc"] is None  # fewer than five pairs


def test_single_class_is_undefined(data):
    _, _, _, df = data
    run = audit.run_audit(df, NAMES, ["row_id"], F.array(F.lit(1)), 1)
    assert run.metrics().count() == 0 or run.metrics().first()["auc"] is None


def test_model_table_round_trip(data):
    x, y, _, df = data
    model, _ = sa.full_fit(df, NAMES)
    got = np.array([r["p"] for r in scoring.score_features(df, model, NAMES).orderBy("row_id").collect()])
    assert np.abs(got - ref.fit_predict(x, y, x)).max() < 1e-8


def test_wide_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 40))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(int)
    pdf = pd.DataFrame({"row_id": np.arange(200), "label": y, "embedding": list(x.astype("float32"))})
    df = spark.createDataFrame(pdf, "row_id long, label int, embedding array<float>").withColumn("fold", folds.dense_fold("row_id"))
    run = audit.run_vector_audit(df, "embedding", 40, ["row_id"], F.array("label"))
    assert np.abs(scores(run) - ref.oof(x.astype("float32").astype(float), y, np.arange(200) % 5)).max() < 1e-7


def unpacked(df, n, *keys):
    """(keys..., run, y) rows of null words."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(
        F.element_at("null_words", F.floor(i / WORD_BITS).cast("int") + 1), (i % WORD_BITS).cast("int")).cast("int"))
    return df.select(*keys, F.posexplode(bits).alias("run", "y"))


@pytest.mark.parametrize("n", [1, 9, 52, 53, 130])
def test_null_labels_keep_structure(data, n):
    _, _, _, df = data
    swapped = unpacked(sa.null_labels(df, "row_id", "pair_id", n, 5, "within_group"), n, "pair_id")
    assert swapped.groupBy("run", "pair_id").agg(F.sum("y").alias("s")).filter("s <> 1").count() == 0
    flips = df.filter("label = 1").select("pair_id", F.posexplode(coin_flips(5, n, "pair_id")).alias("run", "flip"))
    ones = unpacked(sa.null_labels(df.filter("label = 1"), "row_id", "pair_id", n, 5, "within_group"), n, "pair_id")
    assert ones.join(flips, ["pair_id", "run"]).filter("y <> 1 - flip").count() == 0
    dealt = unpacked(sa.null_labels(df, "row_id", None, n, 5, "global"), n, "row_id").cache()
    assert {r["s"] for r in dealt.groupBy("run").agg(F.sum("y").alias("s")).collect()} == {60}
    drawn = ordering.hash_sample(df.select("row_id"), "row_id", [5 + i for i in range(n)], F.lit(60), stream="label")
    assert {(r["row_id"], r["seed"] - 5) for r in drawn.collect()} == {(r["row_id"], r["run"]) for r in dealt.filter("y = 1").collect()}


@pytest.mark.parametrize("size", [0, 1, 7, 59, 60, 200])
def test_cuts_are_exact_samples(spark, size):
    df = spark.range(60).withColumnRenamed("id", "k")
    cuts = ordering.hash_cuts(df, "k", [3, 4], [size, min(size, 5)], 60)
    got = attach(df, cuts).select("k", ordering.before_cut(F.col("cuts"), "k", [3, 4]).alias("in")).collect()
    for i, n in ((0, size), (1, min(size, 5))):
        want = {r["k"] for r in ordering.hash_sample(df, "k", [3 + i], F.lit(n)).collect()}
        assert {r["k"] for r in got if r["in"][i]} == want and len(want) == min(n, 60)


def test_far_scores_keep_their_order(spark):
    """Logits of 31 to 136: probabilities are all 1, ranks are not."""
    logits = np.array([136.0, 31.0, 90.0, 36.9, 50.0, 120.0, -80.0, -790.0])
    label = np.array([1, 0, 1, 0, 0, 1, 1, 0])
    rows = spark.createDataFrame([(i, float(x), int(y)) for i, (x, y) in enumerate(zip(logits, label))], "row_id long, a double, label int")
    labels = trial_labels.stored(F.array("label"), 1)
    fitted = logistic.Fit(("a",), 2, np.tile([0.0, 1.0], (1, 2, 1)), None, None, None, np.ones((1, 2), bool))
    run = audit.Audit(rows.select("row_id", F.lit(0).alias("fold"), F.array("a").alias("x"), F.array("label").alias("y")), fitted, ["row_id"], labels, np.array([0]))
    pos, neg = logits[label == 1], logits[label == 0]
    assert run.metrics().first()["auc"] == (pos[:, None] > neg).mean() < 1
    assert metrics.auc(run.long(), "logit", cut=0.0).first()["auc"] == (pos[:, None] > neg).mean()
    pairs = run.long().withColumn("pair_id", F.floor(F.col("row_id") / 2))
    got = {r["pair_id"]: r["confidence"] for r in scoring.pair_confidence(pairs, ["pair_id"]).collect()}
    for i in range(4):
        hi, lo = max(logits[2 * i:2 * i + 2]), min(logits[2 * i:2 * i + 2])
        want = np.exp(-lo) / (1 + np.exp(-lo)) / (1 + np.exp(-hi)) * -np.expm1(lo - hi) if lo > -700 else 1 / (1 + np.exp(-hi))
        assert got[i] == pytest.approx(want, rel=1e-12)
    assert got[0] < 1e-12 and got[0] > 0 and got[1] != got[0]


def test_active_models_leave_the_passes(data, monkeypatch):
    """Passes shrink as models converge, and a start from known weights saves passes."""
    _, _, _, df = data
    sizes = []
    plain = logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda rows, models, *rest: (sizes.append(len(models.fold)), plain(rows, models, *rest))[1])
    labels = [F.col("label"), F.when(F.col("pair_id") < 30, F.col("label")).otherwise(-1), F.lit(1)]
    first = audit.run_audit(df, NAMES, ["row_id"], F.array(*labels), 3)
    assert sizes[0] == 18 and sizes[1] == 12 and sizes == sorted(sizes, reverse=True)  # the third has one class
    cold = len(sizes)
    again = audit.run_audit(df, NAMES, ["row_id"], F.array(*labels), 3, start=first.fit.weights)
    assert len(sizes) - cold <= 3 < cold
    assert np.abs(again.fit.weights[:2] - first.fit.weights[:2]).max() < 1e-9


def test_quasi_newton_equals_the_dense_fit(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64)) @ rng.normal(size=(64, 64)) / 8
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    pdf = pd.DataFrame({"row_id": np.arange(400), "label": y, "v": list(x)})
    df = spark.createDataFrame(pdf, "row_id long, label int, v array<double>").withColumn("fold", folds.dense_fold("row_id")).coalesce(4)
    dense, light = (audit.run_vector_audit(df, "v", 64, ["row_id"], F.array("label"), method=m) for m in ("newton", "quasi-newton"))
    assert light.fit.valid.all() and np.abs(dense.fit.z_weights - light.fit.z_weights).max() < 1e-6
    assert np.abs(scores(dense) - scores(light)).max() < 1e-6


def test_auc_brute_force(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "score": np.round(rng.normal(size=500), 1), "label": rng.integers(0, 2, 500)})
    got = {r["g"]: r for r in metrics.auc(spark.createDataFrame(pdf), by=["g"], cut=0.3).collect()}
    for g, part in pdf.groupby("g"):
        pos, neg = part[part.label == 1].score.to_numpy(), part[part.label == 0].score.to_numpy()
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
        assert got[g]["auc"] == pytest.approx(want, abs=1e-12)
        assert got[g]["accuracy"] == pytest.approx(((part.score >= 0.3) == (part.label == 1)).mean())


def test_auc_edges(spark):
    tied = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "score double, label int")
    assert metrics.auc(tied).first()["auc"] == 0.5
    assert metrics.auc(tied.filter("label = 1")).first()["auc"] is None


def test_audit_with_null_row(data):
    _, _, _, df = data
    r = sa.audit_with_null(df, NAMES, n_null=8, n_boot=40).first()
    assert r["ci_lo"] < r["auc"] < r["ci_hi"] and 0 <= r["p_value"] <= 1 and abs(r["null_mean"] - 0.5) < 0.15


def test_ablation_and_dominant_group(data):
    _, _, _, df = data
    table = sa.ablation(df, NAMES, {"No first": ("a",), "No second": ("b",)})
    assert table.filter("ablation = 'No first'").first()["auc"] < table.filter(F.col("ablation") == sa.FULL_MODEL).first()["auc"]
    assert sa.dominant_group(table).first()["dominant"] == "First"


def test_anchor_audit(data):
    _, _, pair, df = data
    rows = sa.anchor_audit(df, df.filter("pair_id % 3 = 0").select("pair_id").distinct(), NAMES, controls=3)
    sizes = {r["subset"]: r["n_pairs"] for r in rows.collect()}
    assert sizes == {"full": 60, "anchors": 20, "control_0": 20, "control_1": 20, "control_2": 20}


def test_baseline_gate():
    assert sa.baseline_gate(0.716, 0.7159, 0.001) == 0.716
    with pytest.raises(ValueError):
        sa.baseline_gate(0.70, 0.716, 0.001)


def test_metrics_are_put_together_from_ranges(spark, monkeypatch):
    """Few rows of a trial meet in one task however many the trial has, ties of several tasks among them; no row is sent alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)).round(1)
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(row_id=range(900), label=y, fold=np.arange(900) % 5, half=(np.arange(900) % 2))
    df = spark.createDataFrame(pdf).repartition(6)
    labels = F.array("label", F.when(F.col("half") == 1, F.col("label")).otherwise(audit.ABSENT))
    run = audit.run_audit(df, ["a", "b"], ["row_id"], labels, 2)
    whole = {r["trial"]: tuple(r) for r in run.metrics().collect()}
    monkeypatch.setattr(audit, "RANGE", 100)
    assert run._edges().shape == (2, 8)
    parts = {r["trial"]: tuple(r) for r in run.metrics().collect()}
    scored = run.long().toPandas()
    run.release()
    assert whole.keys() == parts.keys() == {0, 1}
    for t in (0, 1):
        own = scored[scored.trial == t]
        pos, neg = own.logit[own.label == 1].to_numpy(), own.logit[own.label == 0].to_numpy()
        gap = pos[:, None] - neg[None, :]
        want = (t, ((gap > 0) + (gap == 0) / 2).mean(), ((own.logit >= 0) == (own.label == 1)).mean(), len(own))
        assert whole[t] == pytest.approx(want, abs=1e-12) and parts[t] == pytest.approx(want, abs=1e-12)
