"""Steps near the optimum take gradients alone and end where full steps end; sums of turned rows."""

import numpy as np
import pyarrow as pa
import pytest

from veneer.operators import blocks, logistic, trial_labels


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 3)) * [1.0, 40.0, 0.01]
    y = rng.random(600) < 1 / (1 + np.exp(-x @ [0.8, 0.01, 30.0]))
    data = [(x[i].tolist(), i % 5, [int(y[i])]) for i in range(600)]
    return blocks.Blocks.of(spark.createDataFrame(data, "x array<double>, fold int, y array<tinyint>").repartition(3), 600)


def test_last_passes_are_gradients(rows, monkeypatch):
    kinds, plain = [], logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda *args: (kinds.append(args[-1]), plain(*args))[1])
    fit = lambda start=None: logistic.fit(rows, list("abc"), trial_labels.Stored(), np.array([0]), scale=np.array([1.0, 40.0, 0.01]), start=start)
    monkeypatch.setattr(logistic, "_NEAR", 0.0)
    want = fit()
    assert set(kinds) == {"first newton", "newton"} and want.valid.all()
    monkeypatch.setattr(logistic, "_NEAR", 5e-5)
    kinds.clear()
    got = fit(want.weights * (1.0 + 1e-5))
    assert kinds[0] == "first newton" and set(kinds[1:]) == {"gradient"}
    assert got.valid.all() and np.allclose(got.z_weights, want.z_weights, rtol=0, atol=1e-11)


@pytest.mark.parametrize("kind", ["first newton", "gradient"])
def test_sums_are_those_of_the_formulas(kind):
    rng = np.random.default_rng(2)
    n, planes = 1500, 3
    x, fold, y = rng.normal(size=(n, 2)) * 30.0, rng.integers(0, 4, n), rng.integers(-1, 2, (n, planes))
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(fold, pa.int32()), pa.array(y.tolist(), pa.list_(pa.int8()))], ["x", "fold", "y"])
    models = logistic.Models(rng.normal(size=(6, 3)), np.array([0, 1, 2, 0, 1, 2]), np.array([0, 1, 2, 3, 4, 0]))
    out = next(logistic._add_up(models, trial_labels.Stored(), np.zeros(2), np.ones(2), kind)(iter([batch])))
    lines = out.num_rows // 6
    out = np.stack([out.column(f"c{j}").to_numpy() for j in range(logistic._LINE)], axis=1).reshape(6, lines * logistic._LINE)
    z = np.hstack([np.ones((n, 1)), x])
    for m in range(6):
        label = y[:, models.plane[m]]
        at = (label >= 0) & (fold != models.fold[m])
        eta, own = z[at] @ models.weights[m], label[at]
        p = 1 / (1 + np.exp(-eta))
        assert np.allclose(out[m, :3], z[at].T @ (own - p), rtol=1e-9, atol=1e-9)
        assert out[m, 3] == pytest.approx((np.logaddexp(0.0, eta) - own * eta).sum(), rel=1e-12)
        if kind == "first newton":
            curve = (z[at].T * (p * (1 - p))) @ z[at]
            assert out[m, 4:6].tolist() == [at.sum(), own.sum()]
            assert np.allclose(out[m, 6:12], curve[np.triu_indices(3)], rtol=1e-6, atol=1e-9)
            assert np.allclose(out[m, 12:18], [*z[at].sum(0), *(z[at] ** 2).sum(0)], rtol=1e-12)
