"""L2 logistic fits of many (trial, fold) models in shared passes over distributed rows.

Each pass is one Spark aggregation: a task adds up what every unfinished model needs from its rows, Spark adds up the
tasks, the driver takes a step per model. Models that are done leave the pass. Newton steps need a matrix per model;
many features take a limited-memory quasi-Newton method, whose passes and state are linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veneer.operators.blocks import Blocks
from veneer.operators.trial_labels import matrix

#: Sums of a model travel in rows of so many columns.
_LINE = 16
#: A task's lines are added up by the driver, without a shuffle, if there are no more: 64 kB a task.
_DIRECT = 512
#: Entries of a task's (rows x models) arrays.
_CELLS = 1 << 21
#: The same, and models side by side, where trials are nested: little is left out of a part, and it stays in the cache.
_NESTED_CELLS, _BAND = 1 << 15, 16
#: More features than this are fitted without matrices.
DENSE = 256
_MEMORY, _SMALL_STEP = 12, 1e-6
#: After a Newton step below this a model's matrix is good for its next steps.
_NEAR = 5e-5


@dataclass
class Fit:
    """Fitted weights on raw features, index [trial, fold]; fold ``n_folds`` is the fit on all rows, if asked for."""

    features: tuple
    n_folds: int
    weights: np.ndarray          # trials x models x (1 + d), raw-feature scale
    z_weights: np.ndarray        # same, on standardised features
    means: np.ndarray
    scales: np.ndarray
    valid: np.ndarray            # trials x models
    iterations: int = 0
    n_rows: np.ndarray = field(default=None)


@dataclass
class Models:
    """The unfinished models of a pass: weights, label plane and left-out fold of each."""

    weights: np.ndarray
    plane: np.ndarray
    fold: np.ndarray


def _blocks(batch: pa.RecordBatch, reader, models: Models, center, scale):
    planes, at = np.unique(models.plane, return_inverse=True)
    size = max(64, _CELLS // len(models.fold))
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        n = part.num_rows
        x = np.hstack([np.ones((n, 1)), (matrix(part.column("x"), n) - center) / scale])
        labels = reader.take(part, planes)[:, at]
        fold = part.column("fold").to_numpy(zero_copy_only=False)
        yield x, None, labels, (labels >= 0) & (fold[:, None] != models.fold[None, :]), slice(None)


def _nested_blocks(batch: pa.RecordBatch, reader, models: Models, center, scale, products):
    """The same for trials that are prefixes of orders: rows by rank and models by size, so that most cells of a block count.

    Rows that all models of a block have come without a member array.
    """
    n = batch.num_rows
    if not n:
        return
    x = np.hstack([np.ones((n, 1)), (matrix(batch.column("x"), n) - center) / scale])
    xx = x[:, products[0]] * x[:, products[1]] if products else None
    read, fold = reader.read(batch), batch.column("fold").to_numpy(zero_copy_only=False)
    for left_out in np.unique(models.fold):
        mine = np.flatnonzero(models.fold == left_out)
        for rows, at, ends in reader.nested(read, np.flatnonzero((fold != left_out) & (read[0] >= 0)), models.plane[mine]):
            own_x, own_xx, y = x.take(rows, axis=0), None if xx is None else xx.take(rows, axis=0), read[0][rows, None]
            common = ends[0]
            bands = [(0, common, slice(0, len(at)))] + [(common, ends[k:k + _BAND][-1], slice(k, k + _BAND)) for k in range(0, len(at), _BAND)]
            for first, last, band in bands:
                size = max(64, _NESTED_CELLS // len(at[band]))
                for a in range(first, last, size):
                    b = min(a + size, last)
                    member = None if last == common else np.arange(a, b)[:, None] < ends[None, band]
                    yield own_x[a:b], None if xx is None else own_xx[a:b], y[a:b], member, mine[at[band]]


def _add_up(models: Models, reader, center, scale, kind: str):
    """Task body: the sums of each model in lines of `_LINE` cells.

    `kind` is gradient or newton (with the upper half of the Hessian); "first " before it adds the moments of the rows.
    """
    width = models.weights.shape[1]
    first, second = np.triu_indices(width)
    count = len(models.fold)
    moments, newton = kind.startswith("first"), kind.endswith("newton")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, tail = np.zeros((width, count)), np.zeros((3, count))
        curves, sums = np.zeros((len(first) if newton else 0, count)), np.zeros((2 * width if moments else 0, count))
        seen = False
        nested = hasattr(reader, "nested")
        for batch in batches:
            blocks = _nested_blocks(batch, reader, models, center, scale, (first, second) if newton else None) if nested else _blocks(
                batch, reader, models, center, scale)
            for x, xx, labels, member, at in blocks:
                seen = True
                n, y = len(x), np.maximum(labels, 0)
                if moments:
                    if member is None:
                        tail[1:, at] += np.array([[n], [y.sum()]])
                        sums[:, at] += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)])[:, None]
                    elif nested:  # a model has the first rows of a block
                        had = member.sum(axis=0)
                        so_far = np.cumsum(np.hstack([x, x * x, y]), axis=0)
                        so_far = np.vstack([np.zeros(2 * width + 1), so_far])[had]
                        tail[1, at] += had
                        tail[2, at] += so_far[:, -1]
                        sums[:, at] += so_far[:, :-1].T
                    else:
                        ones = member.astype(float)
                        tail[1, at] += ones.sum(axis=0)
                        tail[2, at] += (ones * y).sum(axis=0)
                        sums[:width, at] += x.T @ ones
                        sums[width:, at] += (x * x).T @ ones
                # the logit of the wrong answer: with rows turned round by their labels, residuals are its probabilities
                turn = 1.0 - 2.0 * y
                turned = x * turn if turn.shape[1] == 1 else None
                z = turn * (x @ models.weights[at].T) if turned is None else turned @ models.weights[at].T
                if member is not None:
                    np.copyto(z, -np.inf, where=~member)  # what a model does not have adds nothing below
                small = np.exp(-np.abs(z))  # of the likelier answer 1 / (1 + small), of the other small / (1 + small)
                whole = 1.0 + small
                rest = small / whole
                q = np.where(z >= 0, 1.0 / whole, rest)
                one[:, at] -= x.T @ (turn * q) if turned is None else turned.T @ q
                # a logarithm per some rows: products of 512 numbers between 1 and 2 are finite
                tail[0, at] += np.log(np.multiply.reduceat(whole, np.arange(0, n, 512), axis=0)).sum(axis=0) + np.maximum(z, 0.0, out=z).sum(axis=0)
                if newton:
                    rest /= whole
                    curves[:, at] += (x[:, first] * x[:, second] if xx is None else xx).T @ rest
        if not seen:
            return
        cells = np.vstack([one, tail, curves, sums]).T
        lines = -(-cells.shape[1] // _LINE)
        cells = np.pad(cells, ((0, 0), (0, lines * _LINE - cells.shape[1]))).reshape(count * lines, _LINE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(count, dtype=np.int32), lines)), pa.array(np.tile(np.arange(lines, dtype=np.int32), count)),
             *[pa.array(np.ascontiguousarray(cells[:, j])) for j in range(_LINE)]], ["model", "line", *[f"c{j}" for j in range(_LINE)]])

    return run


def _both(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
    """The sums of two tasks, whose lines are the same."""
    cells = [pa.array(a.column(f"c{j}").to_numpy() + b.column(f"c{j}").to_numpy()) for j in range(_LINE)]
    return pa.RecordBatch.from_arrays([a.column("model"), a.column("line"), *cells], a.schema.names)


def _sums(rows: DataFrame | Blocks, models: Models, reader, center, scale, kind: str):
    """(gradient, tail of loss and, in a first pass, rows and positives, Hessian, moments) per model."""
    count, width = models.weights.shape
    schema = "model int, line int, " + ", ".join(f"c{j} double" for j in range(_LINE))
    body = _add_up(models, reader, center, scale, kind)
    curves = width * (width + 1) // 2 if kind.endswith("newton") else 0
    size = width + 3 + curves + (2 * width if kind.startswith("first") else 0)
    lines = -(-size // _LINE)
    out = np.zeros((count, lines, _LINE))
    many = count * lines > _DIRECT
    if isinstance(rows, Blocks):
        found = rows.added(body, _both) if many else rows.passed(body)
    else:
        total = rows.mapInArrow(body, schema)
        if many:
            total = total.groupBy("model", "line").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(_LINE)])
        found = total.toArrow()
    if found is not None:  # a few small rows per model, and per task if there are few models
        np.add.at(out, (found.column("model").to_numpy(), found.column("line").to_numpy()), np.stack([found.column(f"c{j}").to_numpy() for j in range(_LINE)], axis=1))
    out = out.reshape(count, lines * _LINE)
    return out[:, :width], out[:, width:width + 3], out[:, width + 3:width + 3 + curves], out[:, width + 3 + curves:size]


def to_raw(w: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Weights on unstandardised features."""
    raw = w.copy()
    raw[..., 1:] = w[..., 1:] / std
    raw[..., 0] = w[..., 0] - (w[..., 1:] * mean / std).sum(-1)
    return raw


class _State:
    """What the driver keeps of all models between passes.

    The first pass is at given raw weights (zeros, or those of a similar fit) and also gives the moments by which each
    model is standardised, so a good start is not a pass more but several less.
    """

    def __init__(self, rows, reader, plane, fold, masks, center, scale, l2, raw, kind):
        self.rows, self.reader, self.plane, self.fold = rows, reader, plane, fold
        self.center, self.scale, self.l2 = center, scale, l2
        count, width = raw.shape
        raw = np.where(np.concatenate([np.ones((count, 1), bool), masks], axis=1), raw, 0.0)
        one, tail, two, sums = _sums(rows, Models(raw, plane, fold), reader, center, scale, f"first {kind}")
        self.n_rows = tail[:, 1]
        safe = np.maximum(self.n_rows, 1.0)[:, None]
        self.mean = sums[:, 1:width] / safe
        var = sums[:, width + 1:] / safe - self.mean ** 2
        flat = var <= 1e-12 * (1.0 + self.mean ** 2)
        self.std = np.sqrt(np.where(flat, 1.0, var))
        self.use = np.concatenate([np.ones((count, 1), bool), masks & ~flat], axis=1)
        self.valid = (tail[:, 1] > 0) & (tail[:, 2] > 0) & (tail[:, 2] < tail[:, 1])
        self.start = np.concatenate([raw[:, :1] + (raw[:, 1:] * self.mean).sum(-1, keepdims=True), raw[:, 1:] * self.std], axis=1)
        # weights of features that turned out constant are part of the first pass, but not of the model: begin anew there
        moved = (flat & (raw[:, 1:] != 0)).any(axis=1)
        self.start[moved] = 0.0
        self.first = {m: k for k, m in enumerate(np.flatnonzero(~moved).tolist())}
        keep = np.flatnonzero(~moved)
        self.sums = one[keep], tail[keep], two[keep]
        self.passes = 1

    def loss_and_slope(self, which, w, kind):
        """Penalised loss, its gradient (downhill positive) and what the pass gave of second order, at weights w."""
        if self.first and all(m in self.first for m in which.tolist()):
            at = [self.first[m] for m in which.tolist()]
            one, tail, two = (x[at] for x in self.sums)
        else:
            raw = to_raw(w, self.mean[which], self.std[which])
            one, tail, two, _ = _sums(self.rows, Models(raw, self.plane[which], self.fold[which]), self.reader, self.center, self.scale, kind)
            self.passes += 1
        self.first = {}
        slope = one.copy()
        slope[:, 1:] = (one[:, 1:] - self.mean[which] * one[:, :1]) / self.std[which]
        slope[:, 1:] -= self.l2 * w[:, 1:]
        loss = tail[:, 0] + 0.5 * self.l2 * (w[:, 1:] ** 2).sum(-1)
        return loss, np.where(self.use[which], slope, 0.0), two


def _newton(state: _State, w: np.ndarray, max_iter: int) -> np.ndarray:
    """Steps to the optimum, halved where the loss rose; returns which models got there.

    Once all that are left are near it, they go on with gradients alone, which cost half a pass.
    """
    count, width = w.shape
    first, second = np.triu_indices(width)
    diag = np.arange(width)
    best, step = np.full(count, np.inf), np.zeros((count, width))
    done, near = ~state.valid, np.zeros(count, bool)
    matrices, changed = np.zeros((count, width, width)), np.full(count, np.inf)
    for _ in range(max_iter):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        kind = "gradient" if near[at].all() else "newton"
        loss, slope, two = state.loss_and_slope(at, w[at], kind)
        if kind == "newton":
            curve = np.zeros((len(at), width, width))
            curve[:, first, second] = two
            curve[:, second, first] = two
            shift = np.zeros((len(at), width, width))
            shift[:, 0, 0] = 1.0
            shift[:, 1:, 0] = -state.mean[at] / state.std[at]
            shift[:, diag[1:], diag[1:]] = 1.0 / state.std[at]
            use = state.use[at]
            h = np.where(use[:, :, None] & use[:, None, :], shift @ curve @ np.swapaxes(shift, 1, 2), 0.0)
            ridge = np.full(width, state.l2)
            ridge[0] = 0.0
            h[:, diag, diag] += np.where(use, ridge + 1e-12, 1.0)
            matrices[at] = h
        move = np.linalg.solve(matrices[at], slope[..., None])[..., 0]
        rose = loss > best[at] + 1e-9 * (1.0 + np.abs(best[at]))
        # a step that raised the loss is taken back by half instead of being followed
        move = np.where(rose[:, None], -0.5 * step[at], move)
        step[at] = np.where(rose[:, None], 0.5 * step[at], move)
        best[at] = np.where(rose, best[at], loss)
        w[at] += move
        size = np.abs(move).max(axis=1)
        if kind == "newton":
            changed[at] = size
        # the error after a step is of the order of its square, with an older matrix of the product with the step since
        done[at] = ~rose & (size * changed[at] < _SMALL_STEP ** 2)
        near[at] = ~rose & (changed[at] < _NEAR)
    return done


def _quasi_newton(state: _State, w: np.ndarray, max_iter: int, tol: float = 1e-10) -> np.ndarray:
    """Limited-memory steps; each model has a memory and a step length of its own, all share the passes."""
    count, _ = w.shape
    memory: list[list] = [[] for _ in range(count)]
    done = ~state.valid
    loss, slope = np.full(count, np.inf), np.zeros_like(w)
    ahead, length = np.zeros_like(w), np.ones(count)
    at = np.flatnonzero(~done)
    if len(at):
        loss[at], slope[at], _ = state.loss_and_slope(at, w[at], "gradient")
    bound = 1.0 / (state.n_rows / 4 + state.l2)  # the Hessian of standardised features is of this order

    def direction(m):
        q, kept = slope[m].copy(), []
        for s, y, r in reversed(memory[m]):
            a = r * (s @ q)
            q -= a * y
            kept.append(a)
        q *= 1.0 / (memory[m][-1][2] * (memory[m][-1][1] @ memory[m][-1][1])) if memory[m] else bound[m]
        for (s, y, r), a in zip(memory[m], reversed(kept)):
            q += (a - r * (y @ q)) * s
        return q

    for m in at:
        ahead[m] = direction(m)
    for _ in range(max_iter):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        tried = w[at] + length[at, None] * ahead[at]
        new_loss, new_slope, _ = state.loss_and_slope(at, tried, "gradient")
        for k, m in enumerate(at):
            gain = length[m] * (slope[m] @ ahead[m])
            if new_loss[k] > loss[m] - 1e-4 * gain + 1e-12 * abs(loss[m]):
                length[m] *= 0.5
                done[m] = length[m] < 1e-12
                continue
            s, y = tried[k] - w[m], slope[m] - new_slope[k]
            if s @ y > 1e-14 * (y @ y) * bound[m]:
                memory[m] = [*memory[m], (s, y, 1.0 / (s @ y))][-_MEMORY:]
            w[m], loss[m], slope[m], length[m] = tried[k], new_loss[k], new_slope[k], 1.0
            done[m] = np.abs(slope[m]).max() * bound[m] < tol
            if not done[m]:
                ahead[m] = direction(m)
    return done


def fit(rows: DataFrame, features, reader, plane: np.ndarray, n_folds: int = 5, masks: np.ndarray | None = None, l2: float = 1.0,
        max_iter: int = 100, center=None, scale=None, full: bool = True, start: np.ndarray | None = None, method: str | None = None) -> Fit:
    """Fits every trial without each fold, and on all rows if ``full``, over ``rows(x, fold, and what the reader reads)``.

    ``plane`` has the label plane of each trial, ``masks`` its features. ``start`` (trials x models x (1 + d), raw
    weights, NaN: none) saves steps where a similar fit is known. A (trial, fold) that has not converged after
    ``max_iter`` passes counts as not valid: it gets no metrics.
    """
    d, n_trials = len(features), len(plane)
    if d < 1:
        raise ValueError("at least one feature is needed")
    models = n_folds + (1 if full else 0)
    masks = np.ones((n_trials, d), bool) if masks is None else np.asarray(masks, bool)
    center = np.zeros(d) if center is None else np.asarray(center, float)
    scale = np.ones(d) if scale is None else np.asarray(scale, float)
    dense = (method or ("newton" if d <= DENSE else "quasi-newton")) == "newton"
    begin = np.zeros((n_trials * models, d + 1))
    if start is not None:
        begin = np.array(start, float).reshape(begin.shape)
        begin[~np.isfinite(begin).all(-1)] = 0.0
        begin[:, 0] += begin[:, 1:] @ center
        begin[:, 1:] *= scale
    state = _State(rows, reader, np.repeat(np.asarray(plane), models), np.tile(np.arange(models), n_trials),
                   np.repeat(masks, models, axis=0), center, scale, l2, begin, "newton" if dense else "gradient")
    w = np.where(state.valid[:, None], state.start, 0.0)
    done = (_newton if dense else _quasi_newton)(state, w, max_iter if dense else 20 * max_iter)
    raw = to_raw(w, state.mean, state.std)
    # fold centring and scaling into the reported raw-feature weights
    out = raw.copy()
    out[:, 1:] = raw[:, 1:] / scale
    out[:, 0] = raw[:, 0] - (raw[:, 1:] * center / scale).sum(-1)
    shape = (n_trials, models)
    return Fit(tuple(features), n_folds, out.reshape(*shape, -1), w.reshape(*shape, -1), (state.mean * scale + center).reshape(*shape, -1),
               (state.std * scale).reshape(*shape, -1), (state.valid & done).reshape(shape), state.passes, state.n_rows.reshape(shape))
