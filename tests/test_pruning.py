"""Greedy search against one-at-a-time loops in numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import numpy_twins as ref
from veneer.operators import folds
from veneer.plans import pruning
from workload import audit_queries

NAMES = list("abcd")


@pytest.fixture(scope="module")
def data(spark):
    x, y, pair = ref.toy(18, seed=4)
    pdf = pd.DataFrame(x, columns=NAMES).assign(pair_id=pair, label=y)
    return x, y, pair, spark.createDataFrame(pdf).withColumn("fold", folds.dense_fold("pair_id")).coalesce(2).cache()


def imbalance(x, y, pair, ids):
    keep = np.isin(pair, list(ids))
    gap = x[keep & (y == 1)].mean(0) - x[keep & (y == 0)].mean(0)
    out = {}
    for i in ids:
        d = x[(pair == i) & (y == 1)][0] - x[(pair == i) & (y == 0)][0]
        out[i] = float(np.abs(d)[d * gap > 0].sum())
    return out


def greedy(x, y, pair, tau, strategy, rounds):
    ids, removed = set(range(18)), []
    for _ in range(rounds):
        auc, _, conf = ref.evaluate(x, y, pair, ids)
        if auc <= tau + 1e-9:
            break
        scores = conf if strategy == "confidence" else imbalance(x, y, pair, ids)
        worst = min(ids, key=lambda i: (-round(scores[i], 10), i))
        ids.remove(worst)
        removed.append(worst)
    return ids, removed


def test_prune_one_at_a_time(data):
    x, y, pair, df = data
    trials = [pruning.PruneTrial("confidence", 0.60), pruning.PruneTrial("imbalance", 0.60)]
    result = pruning.prune(df, trials, NAMES, batch=1, max_rounds=5)
    steps = {t: [r["pair_id"] for r in result.removed.filter(F.col("trial") == t).orderBy("step").collect()] for t in (0, 1)}
    assert steps[0] == greedy(x, y, pair, 0.60, "confidence", 4)[1]
    assert steps[1] == greedy(x, y, pair, 0.60, "imbalance", 4)[1]
    first = result.trajectory.filter("trial = 0 AND step = 0").first()
    assert first["auc"] == pytest.approx(ref.evaluate(x, y, pair, set(range(18)))[0], abs=1e-9)


def test_add_back_is_the_sequential_result(spark, data):
    x, y, pair, df = data
    start = set(range(18)) - {0, 2, 5, 9, 11, 14, 16}
    tau = ref.evaluate(x, y, pair, start)[0] + 0.01
    want, rest = set(start), set(range(18)) - start
    for p in sorted(rest):  # one pass
        if ref.evaluate(x, y, pair, want | {p})[0] <= tau + 1e-9:
            want.add(p)
    kept = spark.createDataFrame([(i,) for i in sorted(start)], "pair_id long")
    got = pruning.add_back(df, kept, tau, "auc", NAMES, block=3, max_passes=1)
    assert {r["pair_id"] for r in got.collect()} == want


def test_swap_takes_the_first_improvement(spark, data):
    x, y, pair, df = data
    start = set(range(18)) - {1, 3, 7}
    base_auc, _, conf = ref.evaluate(x, y, pair, start)
    leaders = sorted(start, key=lambda i: (-round(conf[i], 10), i))[:4]
    want = set(start)
    for r in [1, 3, 7]:
        hit = next((q for q in leaders if (m := ref.evaluate(x, y, pair, (start - {q}) | {r}))[1] <= 1.0 and m[0] + 1e-12 < base_auc), None)
        if hit is not None:
            want = (start - {hit}) | {r}
            break
    kept = spark.createDataFrame([(i,) for i in sorted(start)], "pair_id long")
    got = pruning.swap_refine(df, kept, 1.0, pruning.PruneTrial("confidence", 1.0, "accuracy"), NAMES, rounds=1, probe=4)
    assert {r["pair_id"] for r in got.collect()} == want


def test_registered_loops_have_no_caps(spark, data, monkeypatch):
    """The registered calls leave rounds and passes to the operators; the refinement returns the kept ids."""
    df = data[3]
    calls = {}

    def recorded(name, result):
        def run(*args, **kwargs):
            calls.setdefault(name, []).append((len(args), set(kwargs)))
            return result
        monkeypatch.setattr(pruning, name, run)
    some, more = (spark.createDataFrame([(i,) for i in ids], "pair_id long") for ids in ([1, 2], [1, 2, 5]))
    none = spark.createDataFrame([], "trial int, step int, pair_id long")
    recorded("prune", pruning.PruneResult([], spark.createDataFrame([(0, 0.5, 0.5)], "trial int, auc double, accuracy double"), none))
    recorded("add_back", some)
    recorded("swap_refine", more)
    monkeypatch.setattr(audit_queries, "_search_inputs", lambda spark, sf: (df, df))
    audit_queries.QUERIES["greedy_prune_trajectories"](spark, "")
    rows = audit_queries.QUERIES["prune_add_back_and_swap"](spark, "").collect()
    assert calls["prune"] == [(2, {"batch"}), (2, {"batch", "start"})]
    assert calls["add_back"] == [(4, set())] and calls["swap_refine"] == [(4, set())]
    kept = {s: sorted(r["pair_id"] for r in rows if r["stage"] == s) for s in ("pruned", "added_back", "swapped")}
    assert kept == {"pruned": list(range(18)), "added_back": [1, 2], "swapped": [1, 2, 5]}


def test_a_round_computes_shared_scores_once(spark, data, monkeypatch):
    """Imbalance and confidence of a round serve all strategies; a hybrid of one side alone is that side's order."""
    df = data[3]
    calls = []
    for name in ("imbalance_scores", "pair_confidence"):
        def counted(*args, _run=getattr(pruning, name), _name=name):
            calls.append(_name)
            return _run(*args)
        monkeypatch.setattr(pruning, name, counted)
    trials = [pruning.PruneTrial("confidence", 0.0), pruning.PruneTrial("imbalance", 0.0), pruning.PruneTrial("hybrid", 0.0, alpha=1.0),
              pruning.PruneTrial("hybrid", 0.0, alpha=0.0)]
    removed = pruning.prune(df, trials, NAMES, batch=3, max_rounds=3).removed.collect()
    assert sorted(calls) == ["imbalance_scores"] * 2 + ["pair_confidence"] * 2  # two rounds
    gone = [sorted((r["step"], r["pair_id"]) for r in removed if r["trial"] == t) for t in range(4)]
    assert gone[0] == gone[2] and gone[1] == gone[3] and len(gone[0]) == 6
