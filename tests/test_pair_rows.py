"""Pruning over blocks of whole pairs: edges, removals, few jobs a round, add-back and swaps without bounds."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import numpy_twins as ref
from veneer.operators import audit, blocks, folds, pair_rows, trial_labels
from veneer.plans import pruning

NAMES = list("abcd")


def _answers(spark, n, seed):
    x, y, pair = ref.toy(n, seed=seed)
    pdf = pd.DataFrame(x, columns=NAMES).assign(pair_id=pair, label=y)
    return x, y, pair, spark.createDataFrame(pdf).withColumn("fold", folds.dense_fold("pair_id")).cache()


class Given:
    """Scores that are written on the rows, for one trial."""

    def of_pairs(self, pairs):
        return {0: pairs.batch.column("s").to_numpy(zero_copy_only=False)[pairs.first]}


@pytest.mark.parametrize("sent", [4, 64, 1 << 12])
def test_edge_is_that_of_the_sorted_scores(spark, monkeypatch, sent):
    rng = np.random.default_rng(sent)
    score = np.round(rng.random(700), 1)  # many ties
    score[rng.random(700) < 0.1] = np.nan
    ids = rng.permutation(2000)[:700]
    df = spark.createDataFrame([(int(i), float(s)) for i, s in zip(ids, score)], "pair_id long, s double").repartition(5)
    rows = blocks.Blocks.of(df, 700)
    known = sorted((-s, i) for i, s in zip(ids.tolist(), score.tolist()) if s == s)
    monkeypatch.setattr(pair_rows, "SENT", sent)
    for k in (1, 2, 99, 350, len(known)):
        edge = pair_rows.kth_highest(rows, Given(), {0: k})[0]
        assert (-edge[0], edge[1]) == known[k - 1]
    assert pair_rows.kth_highest(rows, Given(), {0: len(known) + 1})[0][0] == -np.inf
    rows.release()


def test_batches_end_with_pairs():
    ids = pa.array([None, None, 1, 1, 2, 2, 2, 3, 7, 7, 7, 7])
    whole = pa.RecordBatch.from_arrays([ids, pa.array(range(12))], ["pair_id", "at"])
    for size in (1, 2, 3, 5, 12):
        cut = list(pair_rows.whole_pairs(whole.slice(a, size) for a in range(0, 12, size)))
        assert pa.Table.from_batches(cut).column("at").to_pylist() == list(range(12))
        named = [set(b.column("pair_id").to_pylist()) for b in cut]
        assert sum(len(n) for n in named) == len(set().union(*named))


def test_a_round_is_a_few_jobs(spark):
    df = _answers(spark, 60, seed=3)[3]
    trials = [pruning.PruneTrial("confidence", 0.0), pruning.PruneTrial("imbalance", 0.0), pruning.PruneTrial("hybrid", 0.0, pool=6, seed=7)]
    jobs = []
    for rounds in (2, 6):
        spark.sparkContext.setJobGroup(f"prune {rounds}", "")
        pruning.prune(df, trials, NAMES, batch=3, max_rounds=rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"prune {rounds}")))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] - jobs[0] <= 4 * 14


def test_pool_draws_and_missing_ids(spark):
    """The least md5 draws among the pool go; a pair without an id takes a place in the order but never goes."""
    x, y, pair, df = _answers(spark, 20, seed=6)
    lost = df.filter("pair_id = 3").withColumn("pair_id", F.lit(None).cast("long")).withColumn("a", F.col("a") + F.col("label") * 50.0)
    trial = pruning.PruneTrial("imbalance", 0.0, pool=8, seed=5)
    out = pruning.prune(df.filter("pair_id <> 3").unionByName(lost), [trial], NAMES, batch=3, max_rounds=2)
    gap = np.array([x[2 * i] - x[2 * i + 1] for i in range(20)])
    gap[3, 0] += 50.0
    score = np.where(gap * gap.mean(0) > 0, np.abs(gap), 0.0).sum(1)
    pool = sorted(range(20), key=lambda i: (-score[i], i))[:8]
    assert 3 in pool
    draw = lambda i: int(hashlib.md5(f"5:prune.1{'' if i == 3 else f':{i}'}".encode()).hexdigest()[:13], 16)
    want = set(sorted(pool, key=draw)[:3]) - {3}
    assert {r["pair_id"] for r in out.removed.collect()} == want


def test_metrics_of_blocks_are_those_of_rows(spark, monkeypatch):
    df = _answers(spark, 300, seed=8)[3]
    rows = pair_rows.paired(df, NAMES, 1, spark.createDataFrame([], "trial int, pair_id long"))
    spread = audit.common_scale(rows, 4)
    want = audit.run_audit(df, NAMES, [], trial_labels.stored([F.col("label")]), full=False, spread=spread).metrics().first()
    for direct, length in ((1 << 18, 1 << 18), (0, 1 << 18), (0, 100)):
        monkeypatch.setattr(audit, "DIRECT", direct)
        monkeypatch.setattr(audit, "RANGE", length)
        (got,) = audit.run_on(rows, NAMES, [], trial_labels.Steps(), [0], spread).measured()
        assert (got["n_rows"], got["trial"]) == (600, 0)
        assert got["auc"] == pytest.approx(want["auc"], abs=1e-12) and got["accuracy"] == pytest.approx(want["accuracy"], abs=1e-12)
    rows.release()


def test_more_models_than_lines_are_added_up_by_tasks(spark):
    df = _answers(spark, 60, seed=9)[3]
    df = df.unionByName(df.withColumn("pair_id", F.col("pair_id") + 60))
    rows = pair_rows.paired(df, NAMES, 60, spark.createDataFrame([], "trial int, pair_id long"))
    spread = audit.common_scale(rows, 4)
    many = audit.run_on(rows, NAMES, [], trial_labels.Steps(), list(range(60)), spread).fit.weights
    one = audit.run_on(rows, NAMES, [], trial_labels.Steps(), [0], spread).fit.weights
    assert np.allclose(many, one, rtol=1e-9, atol=1e-9)
    rows.release()


def test_swaps_go_on_until_none_improves(spark):
    """Beyond two rounds and beyond the 24 first candidates; a bound on either is the caller's."""
    x, y, pair, df = _answers(spark, 31, seed=9)
    start = set(range(26, 31))

    def swapped(rounds=1000, probe=1000):
        ids, auc, conf = set(start), *ref.evaluate(x, y, pair, start)[::2]
        tried, done = 0, 0
        while done < rounds:
            members = sorted(ids, key=lambda i: (-round(conf[i], 10), i))[:probe]
            for r, q in ((r, q) for r in sorted(set(range(31)) - ids)[:probe] for q in members):
                tried = max(tried, sorted(set(range(31)) - ids).index(r))
                m = ref.evaluate(x, y, pair, (ids - {q}) | {r})
                if m[1] <= 1.0 and m[0] + 1e-12 < auc:
                    ids, auc, conf = (ids - {q}) | {r}, m[0], m[2]
                    break
            else:
                break
            done += 1
        return ids, done, tried

    want, rounds, tried = swapped()
    bounded = swapped(2, 24)[0]
    assert rounds > 2 and tried >= 24 and want != bounded
    kept = spark.createDataFrame([(i,) for i in start], "pair_id long")
    trial = pruning.PruneTrial("confidence", 1.0, "accuracy")
    assert {r["pair_id"] for r in pruning.swap_refine(df, kept, 1.0, trial, NAMES).collect()} == want
    assert {r["pair_id"] for r in pruning.swap_refine(df, kept, 1.0, trial, NAMES, rounds=2, probe=24).collect()} == bounded


def test_nothing_is_tried_where_no_pair_can_be_audited(spark, monkeypatch):
    df = _answers(spark, 30, seed=2)[3]
    kept = spark.createDataFrame([(i,) for i in (4, 9, 17)], "pair_id long")  # 4 pairs are 8 rows, an audit needs 10
    monkeypatch.setattr(audit, "trial_metrics", lambda *args, **kwargs: pytest.fail("an audit of too few rows"))
    assert {r["pair_id"] for r in pruning.add_back(df, kept, 1.0, "accuracy", NAMES).collect()} == {4, 9, 17}


def test_blocks_that_grow_keep_the_order(spark, monkeypatch):
    """Runs of acceptances and of rejections, past several sizes of a block, with ids that are no dense range."""
    x, y, pair, df = _answers(spark, 36, seed=7)
    start = {30, 31, 32, 33, 34, 35}
    tau = ref.evaluate(x, y, pair, start)[1] + 0.02
    want = set(start)
    for p in range(30):
        m = ref.evaluate(x, y, pair, want | {p})
        if m[1] <= tau + 1e-9:
            want.add(p)
    sizes = []
    listed = pair_rows.next_left_out
    monkeypatch.setattr(pair_rows, "next_left_out", lambda *args: (sizes.append(args[2]), listed(*args))[1])
    kept = spark.createDataFrame([(i * 1000,) for i in start], "pair_id long")
    wide = df.withColumn("pair_id", F.col("pair_id") * 1000)
    got = pruning.add_back(wide, kept, tau, "accuracy", NAMES, block=2, max_passes=1)
    assert {r["pair_id"] // 1000 for r in got.collect()} == want and start < want < set(range(36))
    assert {2, 4, 8} >= set(sizes) > {2}
