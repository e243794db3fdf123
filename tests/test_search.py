"""Fits of nested trials: the same sums and metrics as of trials fitted one by one from zeros, with less work."""

import numpy as np
import pyarrow as pa
import pytest

from veneer.operators import audit, logistic, trial_labels
from veneer.plans import subset_search as ss


class Plain:
    """The labels of prefixes without what is known of their nesting."""

    def __init__(self, reader):
        self.take = reader.take


def _batch(n, orders, splits, rng):
    lists = lambda m, kind: pa.array(m.tolist(), pa.list_(kind))
    ranks = np.stack([rng.permutation(2 * n)[:n] for _ in range(orders)], axis=1)  # rank 0: in no order
    held = ((rng.random((n, splits)) < 0.25) @ (1 << np.arange(splits)))[:, None]
    return pa.RecordBatch.from_arrays(
        [lists(rng.normal(size=(n, 3)), pa.float64()), pa.array(rng.integers(0, 3, n), pa.int32()), pa.array(rng.integers(-1, 2, n), pa.int8()),
         lists(ranks, pa.int32()), lists(held, pa.int64())], ["x", "fold", "y", "ranks", "held"])


@pytest.mark.parametrize("kind", ["first newton", "newton", "first gradient", "gradient"])
def test_nested_sums_are_those_of_all_cells(kind):
    rng, n = np.random.default_rng(3), 3000
    batch = _batch(n, 2, 3, rng)
    cases = [(o, k, s, h) for o in range(2) for k in (0, 5, *range(n, 2 * n + 1, 40)) for s in (-1, 0, 1, 2) for h in (False, True)]
    reader = trial_labels.Prefixes(*(np.array(c) for c in zip(*cases)))
    plane = rng.permutation(np.repeat(np.arange(len(cases)), 4))[:1500]
    models = logistic.Models(rng.normal(size=(len(plane), 4)), plane, rng.integers(0, 4, len(plane)))  # fold 3: nothing left out
    center, scale = np.array([0.1, -0.2, 0.0]), np.array([1.0, 2.0, 0.5])

    def sums(by):
        out = next(logistic._add_up(models, by, center, scale, kind)(iter([batch.slice(0, 900), batch.slice(900, 0), batch.slice(900)])))
        lines = out.num_rows // len(plane)
        out = np.stack([out.column(f"c{j}").to_numpy() for j in range(logistic._LINE)], axis=1).reshape(len(plane), -1)
        return lines, out

    (lines, got), (same, want) = sums(reader), sums(Plain(reader))
    assert lines == same and np.allclose(got[:, :5], want[:, :5], rtol=1e-10, atol=1e-10)
    at = 5 if kind.startswith("first") else 7  # rows and positives are read from a first pass
    assert np.allclose(got[:, at:], want[:, at:], rtol=1e-10, atol=1e-10)


def test_few_cells_are_left_out_of_blocks():
    rng, n = np.random.default_rng(4), 4000
    batch = _batch(n, 1, 1, rng)
    reader = trial_labels.Prefixes(np.zeros(80, int), np.tile(np.arange(n, 2 * n, n // 40), 2), np.zeros(80, int), np.arange(80) < 40)
    models = logistic.Models(np.zeros((160, 4)), np.tile(np.arange(80), 2), np.repeat([0, 1], 80))
    members = (reader.take(batch, models.plane) >= 0).sum()
    cells = sum(len(x) * len(at) for x, _, _, _, at in logistic._nested_blocks(batch, reader, models, np.zeros(3), np.ones(3), None))
    assert cells < members < 0.5 * n * 160  # all rows and models before


def _trials(sizes, others=()):
    return [ss.Trial(o, k, s, side) for s in (1, 2) for o, ks in (("prefix_grid/a", sizes), *others) for k in ks for side in ("train", "hold")]


@pytest.mark.parametrize("sizes", [range(300, 149, -2), [300, 300, 200], [7]])
def test_leads_cover_all_and_go_forward(sizes):
    trials = _trials(sizes, [("multi_start/1.0", [300, 270, 150])])
    done = set()
    for lead in ss.leads(trials):
        for i, below, above, share in zip(*(c.tolist() for c in (lead.trials, lead.below, lead.above, lead.share))):
            assert i not in done and 0.0 <= share <= 1.0
            if below >= 0:
                assert {below, above} <= done
                assert {(trials[j].seed, trials[j].side) for j in (i, below, above)} == {(trials[i].seed, trials[i].side)}
        done |= set(lead.trials.tolist())
    assert done == set(range(len(trials)))


def test_search_fits_are_those_from_zeros(spark, monkeypatch):
    rng, n = np.random.default_rng(5), 400
    gap, noise = rng.random(n), rng.normal(size=(n, 2, 2))
    cands = spark.createDataFrame([(i, float(gap[i])) for i in range(n)], "example_id long, length_gap double")
    answers = spark.createDataFrame(
        [(i, label, i % 5, float(noise[i, label, 0] + label * gap[i]), float(noise[i, label, 1])) for i in range(n) for label in (0, 1)],
        "pair_id long, label int, fold int, a double, b double")
    orders = {"prefix_grid/gap": ss._keys("length_gap"), "few/id": ss._keys("example_id")}
    prepared = ss.prepare(cands, answers, [1, 2], orders)
    plan = [(o, k, s) for s in (1, 2) for o, ks in (("prefix_grid/gap", range(n, n // 2, -4)), ("few/id", (n, n - 40, n // 2))) for k in ks]
    trials = [ss.Trial(o, k, s, side) for o, k, s in plan for side in ("train", "hold")]
    labels = ss.prefix_labels(trials)
    fitted, plain = [], logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda rows, models, *rest: (fitted.append(len(models.fold)), plain(rows, models, *rest))[1])
    got = ss.evaluate(prepared, plan, ["a", "b"]).collect()
    led, fitted[:] = sum(fitted), []
    want = audit.trial_metrics(prepared, ["a", "b"], trial_labels.Labels(labels.columns, Plain(labels.reader), labels.n), ss.FOLDS, min_rows=10)
    assert led < 0.85 * sum(fitted)  # fits in all passes; from zeros these easy ones take four
    for r, train, hold, (order, k, seed) in zip(got, want[::2], want[1::2], plan):
        assert (f"{r['method']}/{r['mode']}", r["keep_n"], r["seed"]) == (order, k, seed)
        assert (r["train_pairs"], r["hold_pairs"]) == (train["n_rows"] // 2, hold["n_rows"] // 2)
        assert r["search_time_auc"] == pytest.approx(train["auc"], abs=1e-9) and r["heldout_auc"] == pytest.approx(hold["auc"], abs=1e-9)
