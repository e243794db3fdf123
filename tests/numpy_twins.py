"""Plain numpy twins used only to check results on small data."""

import numpy as np


def toy(n_pairs, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(2 * n_pairs, 4))
    y = np.tile([1, 0], n_pairs)
    x[:, 0] += 0.7 * y
    x[:, 1] = 300 + 40 * x[:, 1]
    x[:, 3] = 2.0  # constant
    return x, y, np.repeat(np.arange(n_pairs), 2)


def fit_predict(x, y, x_new):
    mu, sd = x.mean(0), x.std(0)
    sd[sd < 1e-12] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mu) / sd])
    ridge = np.eye(z.shape[1])
    ridge[0, 0] = 0
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
    return 1 / (1 + np.exp(-np.hstack([np.ones((len(x_new), 1)), (x_new - mu) / sd]) @ w))


def oof(x, y, fold):
    p = np.zeros(len(y))
    for k in np.unique(fold):
        p[fold == k] = fit_predict(x[fold != k], y[fold != k], x[fold == k])
    return p


def auc(y, p):
    p = np.round(p, 12)
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)


def evaluate(x, y, pair, ids):
    keep = np.isin(pair, list(ids))
    p = oof(x[keep], y[keep], pair[keep] % 5)
    return auc(y[keep], p), float(((p >= 0.5) == y[keep]).mean()), dict_scores(y[keep], pair[keep], p)


def dict_scores(y, pair, p):
    return {int(i): abs(p[(pair == i) & (y == 1)][0] - p[(pair == i) & (y == 0)][0]) for i in np.unique(pair)}
