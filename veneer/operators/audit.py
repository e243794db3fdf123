"""Batched out-of-fold logistic audit.

Many trials (label shuffles, feature masks, row subsets) are fitted together. A row holds its features once and what
its labels follow from in a compact form, so trials never multiply the rows. Row data stays on the executors; scores
are logits, which keep far rows apart where probabilities would all be 0 or 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.operators import logistic, metrics, trial_labels
from veneer.operators.blocks import Blocks
from veneer.operators.scoring import sigmoid
from veneer.operators.trial_labels import ABSENT, Labels, matrix

#: Trials that share the passes.
CHUNK = 512
#: Rows of a trial whose logits are put in order as one array.
RANGE = 1 << 18
#: Logits of all trials that are put in order by the driver, without a shuffle, if there are no more: 4 MB.
DIRECT = 1 << 18


def feature_vector(features) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


def logits(batch: pa.RecordBatch, weights: np.ndarray, valid: np.ndarray, n_folds: int) -> np.ndarray:
    """Rows x trials, each row by the models that were fitted without its fold; NaN where there is none.

    Added up feature by feature, so that equal rows get equal bits wherever they stand.
    """
    n = batch.num_rows
    x = matrix(batch.column("x"), n)
    fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(int)
    out = np.full((n, len(weights)), np.nan)
    for f in range(n_folds):
        rows = np.flatnonzero(fold == f)
        if not len(rows):
            continue
        eta = np.repeat(weights[None, :, f, 0], len(rows), axis=0)
        for j in range(x.shape[1]):
            eta += x[rows, j:j + 1] * weights[None, :, f, j + 1]
        out[rows] = np.where(valid[None, :, f], eta, np.nan)
    return out


def _tied(value: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted values once each, with what they count in all."""
    new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    return value[new], np.add.reduceat(pos, new, dtype=np.int64), np.add.reduceat(neg, new, dtype=np.int64)


def _range_sums(parts: list[tuple[bytes, bytes, bytes]]) -> tuple[float, int, int, int]:
    """Positives above negatives, positives, negatives and right answers of a range, from sorted arrays of its logits."""
    value, pos, neg = [], [], []
    for v, p, n in parts:
        value.append(np.frombuffer(v))
        kind = np.uint8 if len(p) == len(v) // 8 else np.int64
        pos.append(np.frombuffer(p, kind))
        neg.append(np.frombuffer(n, kind))
    value = np.concatenate(value)
    order = np.argsort(value, kind="stable")  # merges what is sorted
    value, pos, neg = _tied(value[order], np.concatenate(pos)[order], np.concatenate(neg)[order])
    # negatives below a positive count 1, tied negatives 1/2
    u = (pos * (np.cumsum(neg) - neg + neg / 2)).sum()
    return float(u), int(pos.sum()), int(neg.sum()), int(np.where(value >= 0.0, pos, neg).sum())


@dataclass
class Lead:
    """Trials to fit together; each starts between the weights of two fitted before (-1: from zeros), `share` of them `above`'s."""

    trials: np.ndarray
    below: np.ndarray
    above: np.ndarray
    share: np.ndarray

    def start(self, weights: np.ndarray) -> np.ndarray:
        share = self.share[:, None, None]
        between = (1.0 - share) * weights[self.below] + share * weights[self.above]
        return np.where((self.below < 0)[:, None, None], np.nan, between)

    def split(self, size: int) -> list[Lead]:
        return [Lead(self.trials[a:a + size], self.below[a:a + size], self.above[a:a + size], self.share[a:a + size])
                for a in range(0, len(self.trials), size)]


@dataclass
class Audit:
    """A fitted batch of trials over stored rows: key columns, fold, x and what the labels are read from."""

    rows: DataFrame
    fit: logistic.Fit
    keys: list
    labels: Labels
    plane: np.ndarray
    cached: DataFrame | None = None
    names: np.ndarray | None = None  # what the trials are called in results, if not 0, 1, 2...

    def _scored(self, schema: T.StructType, make) -> DataFrame:
        """`make(batch, rows, trials, labels, logits)` of the scored (row, trial) couples, some thousand rows at a time."""
        fit, reader, plane = self.fit, self.labels.reader, self.plane
        names = np.arange(len(plane)) if self.names is None else np.asarray(self.names)
        weights, valid, n_folds = fit.weights, fit.valid, fit.n_folds
        size = max(64, (1 << 20) // len(plane))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    batch = whole.slice(at, size)
                    logit, y = logits(batch, weights, valid, n_folds), reader.take(batch, plane)
                    row, trial = np.nonzero((y >= 0) & ~np.isnan(logit))
                    yield make(batch, row, names[trial], y[row, trial], logit[row, trial])

        return self.rows.mapInArrow(run, schema)

    def long(self) -> DataFrame:
        """(keys..., trial, label, logit, score): one row per trial the row belongs to; score is the probability."""
        keys = list(self.keys)
        names = [*keys, "trial", "label", "logit"]
        schema = T.StructType([self.rows.schema[k] for k in keys] + [
            T.StructField("trial", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("logit", T.DoubleType())])

        def make(batch, row, trial, y, logit):
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], pa.array(trial.astype(np.int32)),
                                               pa.array(y.astype(np.int32)), pa.array(logit)], names)

        return self._scored(schema, make).withColumn("score", sigmoid(F.col("logit")))

    def _count(self) -> int:
        return self.rows.n_rows if isinstance(self.rows, Blocks) else self.rows.count()

    def _sampled(self, share: float) -> pa.Table | None:
        def some(batches):
            for batch in batches:
                at = np.flatnonzero(np.random.default_rng(batch.num_rows).random(batch.num_rows) < share)
                yield batch.select(["x", "fold"]).take(pa.array(at))

        return self.rows.passed(some)

    def _edges(self) -> np.ndarray:
        """Per trial the logits at which it is cut into ranges of some `RANGE` rows; none if one range holds them all.

        They come from a few hundred sampled rows per range. Any edges give the same metrics, these give ranges of a size.
        """
        folds = self.fit.n_folds
        seen = self.fit.n_rows  # a row is in all fits but one
        most = self._count() if seen is None else seen[:, :folds].sum(axis=1).max(initial=0.0) / max(1, folds - 1)
        ranges = max(1, -int(-most // RANGE))
        if ranges > 1:
            share = min(1.0, 256.0 * ranges / self._count())  # 256 rows per range
            rows = self._sampled(share) if isinstance(self.rows, Blocks) else self.rows.select("x", "fold").sample(share, 1).toArrow()
            if rows is not None and rows.num_rows:
                found = logits(rows.combine_chunks().to_batches()[0], self.fit.weights, self.fit.valid, folds)
                found = np.sort(found, axis=0)  # what is not fitted comes last
                known = np.maximum((~np.isnan(found)).sum(axis=0), 1)
                place = (np.arange(1, ranges)[:, None] * known[None, :]) // ranges
                return np.take_along_axis(found, place, axis=0).T
        return np.zeros((len(self.plane), 0))

    def _sender(self, edges: np.ndarray):
        """Task body: the logits of a trial's range as one sorted array, some thousand rows at a time, with the positives and
        negatives of each."""
        ranges = edges.shape[1] + 1
        fit, reader, plane = self.fit, self.labels.reader, self.plane
        names = np.arange(len(plane)) if self.names is None else np.asarray(self.names)
        weights, valid, n_folds = fit.weights, fit.valid, fit.n_folds
        size = max(64, (1 << 20) // min(len(plane), CHUNK))

        def sorted_parts(batch):
            for start in range(0, len(plane), CHUNK):
                some = slice(start, start + CHUNK)
                logit, y = logits(batch, weights[some], valid[some], n_folds), reader.take(batch, plane[some])
                inside = (y >= 0) & ~np.isnan(logit)
                for t in range(logit.shape[1]):
                    at = np.flatnonzero(inside[:, t])
                    if not len(at):
                        continue
                    at = at[np.argsort(logit[at, t])]
                    value, pos, neg = _tied(logit[at, t], y[at, t] == 1, y[at, t] == 0)
                    cuts = [0, *np.searchsorted(value, edges[start + t], "left"), len(value)]
                    for r in range(ranges):
                        a, b = cuts[r], cuts[r + 1]
                        if a < b:
                            kind = np.uint8 if max(pos[a:b].max(), neg[a:b].max()) < 256 else np.int64
                            yield (int(names[start + t]), r, value[a:b].tobytes(), pos[a:b].astype(kind).tobytes(), neg[a:b].astype(kind).tobytes())

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            for whole in batches:
                for at in range(0, whole.num_rows, size):
                    parts = list(zip(*sorted_parts(whole.slice(at, size))))
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds)], ["trial", "range", "logit", "pos", "neg"])

        return send

    def metrics(self) -> DataFrame:
        """(trial, auc, accuracy, n_rows). A range of a trial is put together from the tasks' arrays and summed up as an array."""
        edges = self._edges()

        def add_up(found: pa.Table) -> pa.Table:
            u, p, n, hits = _range_sums(list(zip(*[found.column(c).to_pylist() for c in ("logit", "pos", "neg")])))
            return pa.table({"trial": found.column("trial")[:1], "__range": found.column("range")[:1], "__u": [u], "__p": [p], "__n": [n], "__hits": [hits]})

        sent = self.rows.mapInArrow(self._sender(edges), "trial int, range int, logit binary, pos binary, neg binary")
        per_range = sent.groupBy("trial", "range").applyInArrow(add_up, "trial int, __range int, __u double, __p long, __n long, __hits long")
        return metrics.auc_of_ranges(per_range, ["trial"], edges.shape[1] > 0).select("trial", "auc", "accuracy", "n_rows")

    def measured(self) -> list[dict]:
        """The same as a list: a row per trial."""
        if not isinstance(self.rows, Blocks):
            return [r.asDict() for r in self.metrics().collect()]
        edges, groups = self._edges(), {}
        if self.rows.n_rows * len(self.plane) <= DIRECT:
            sent = self.rows.passed(self._sender(edges))
            for trial, r, *part in zip(*[c.to_pylist() for c in sent.columns]) if sent else ():
                groups.setdefault((trial, r), []).append(part)
            found = [(*k, *_range_sums(parts)) for k, parts in groups.items()]
        else:
            found = self.rows.grouped(self._sender(edges), 2, _range_sums, edges.size + len(edges))  # a row per trial and range
        out = {}
        for trial, _, u, p, n, hits in sorted(found):
            sums = out.setdefault(trial, [0.0, 0, 0, 0])
            sums[0] += u + p * sums[2]
            sums[1:] = sums[1] + p, sums[2] + n, sums[3] + hits
        return [{"trial": t, "auc": u / float(p) / float(n) if p and n else None, "accuracy": hits / (p + n), "n_rows": p + n}
                for t, (u, p, n, hits) in out.items()]

    def release(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()


def _prepared(df: DataFrame, x: Column, labels: Labels, keys: list[str], persist: bool) -> DataFrame:
    rows = df.select(*keys, F.col("fold").cast("int").alias("fold"), x.alias("x"), *[c.alias(n) for n, c in labels.columns.items()])
    # re-read in each pass; lost blocks are recomputed from the source
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if persist else rows


def common_scale(rows: DataFrame | Blocks, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of all rows, for numerical ease; models are standardised on their own rows afterwards."""
    def run(batches):
        n, one, two = 0, np.zeros(d), np.zeros(d)
        for batch in batches:
            x = matrix(batch.column("x"), batch.num_rows)
            if not len(x):
                continue
            own, spread, m = x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0), len(x)
            two += spread + (own - one) ** 2 * n * m / (n + m)
            one += (own - one) * m / (n + m)
            n += m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([one.tolist()], pa.list_(pa.float64())), pa.array([two.tolist()], pa.list_(pa.float64()))],
                                             ["n", "mean", "spread"])

    if isinstance(rows, Blocks):
        found = rows.passed(run)
        found = found.to_pylist() if found else []
    else:
        found = rows.select("x").mapInArrow(run, "n long, mean array<double>, spread array<double>").collect()  # a row per task
    if not found:
        return np.zeros(d), np.ones(d)
    n = np.array([r["n"] for r in found], float)
    mean, spread = np.array([r["mean"] for r in found]), np.array([r["spread"] for r in found])
    center = (mean * n[:, None]).sum(0) / n.sum()
    std = np.sqrt((spread + (mean - center) ** 2 * n[:, None]).sum(0) / n.sum())
    return center, np.where(std > 1e-12 * (1.0 + np.abs(center)), std, 1.0)


def _fitted(rows, features, keys, labels, plane, n_folds, masks, l2, persist, full, start, center, scale, method=None, names=None) -> Audit:
    fitted = logistic.fit(rows, features, labels.reader, plane, n_folds, masks, l2, center=center, scale=scale, full=full, start=start, method=method)
    return Audit(rows, fitted, list(keys), labels, plane, rows if persist else None, names)


def spread_of(df: DataFrame, features) -> tuple[np.ndarray, np.ndarray]:
    """Means and scales of the features of all rows, for audits of many parts of them."""
    return common_scale(df.select(feature_vector(features).alias("x")), len(features))


def run_audit(df: DataFrame, features, keys: list[str], trials: Column | Labels, n_trials: int | None = None, n_folds: int = 5, masks=None,
              l2: float = 1.0, persist: bool = True, full: bool = True, start: np.ndarray | None = None, plane: list[int] | None = None,
              spread: tuple | None = None) -> Audit:
    """Fit and score many trials at once.

    ``df`` needs the feature columns, ``fold`` and ``keys``; ``trials`` is a Labels, or an ARRAY column with the row's
    label (0/1) per trial or -1. ``start`` are weights of a similar audit, ``spread`` the means and scales of its rows
    (numerical ease only). ``plane`` picks some of the trials.
    """
    labels = trials if isinstance(trials, Labels) else trial_labels.stored(trials, n_trials)
    rows = _prepared(df, feature_vector(features), labels, keys, persist)
    center, scale = spread or common_scale(rows, len(features))
    picked = np.arange(labels.n) if plane is None else np.asarray(plane)
    return _fitted(rows, features, keys, labels, picked, n_folds, masks, l2, persist, full, start, center, scale, names=picked)


def run_on(rows: DataFrame | Blocks, features, keys: list[str], reader, plane: list[int], spread: tuple, n_folds: int = 5, l2: float = 1.0,
           start: np.ndarray | None = None) -> Audit:
    """The same on rows that have keys, fold, x and what the reader reads, as the caller keeps them."""
    picked = np.asarray(plane)
    return _fitted(rows, features, keys, Labels({}, reader, len(picked)), picked, n_folds, None, l2, False, False, start, *spread, names=picked)


def run_vector_audit(df: DataFrame, vector: str, dim: int, keys: list[str], trials: Column, n_trials: int = 1, n_folds: int = 5,
                     l2: float = 1.0, method: str | None = None) -> Audit:
    """The same audit on stored vectors (ARRAY of floats with ``dim`` entries)."""
    labels = trial_labels.stored(trials, n_trials)
    rows = _prepared(df, F.transform(vector, lambda v: v.cast("double")), labels, keys, True)
    center, scale = common_scale(rows, dim)
    return _fitted(rows, [f"v{i}" for i in range(dim)], keys, labels, np.arange(n_trials), n_folds, None, l2, True, False, None, center, scale, method)


def trial_metrics(df: DataFrame | Blocks, features, labels: Labels | list[Column], n_folds: int = 5, masks=None, l2: float = 1.0,
                  chunk: int = CHUNK, min_rows: int = 10, plane: np.ndarray | None = None, start: np.ndarray | None = None,
                  spread: tuple | None = None, leads: list[Lead] | None = None) -> list[dict]:
    """Metrics of any number of trials over rows that are stored once: one dict per trial, with its weights.

    ``plane`` names the labels each trial uses (default: its own); ``start`` has weights to begin all trials from, ``leads``
    the trials to begin each from, if some are fitted before others. A trial with fewer than ``min_rows`` rows has no metrics.
    Blocks have fold, x and what the labels are read from.
    """
    labels = labels if isinstance(labels, Labels) else trial_labels.stored(labels)
    plane = np.arange(labels.n) if plane is None else np.asarray(plane)
    rows = df if isinstance(df, Blocks) else _prepared(df, feature_vector(features), labels, [], True)
    center, scale = spread or common_scale(rows, len(features))
    out, weights = [None] * len(plane), np.full((len(plane), n_folds, len(features) + 1), np.nan)
    alone = np.full(len(plane), -1)
    for lead in leads or [Lead(np.arange(len(plane)), alone, alone, np.zeros(len(plane)))]:
        for some in lead.split(chunk):
            part = plane[some.trials]
            mask = None if masks is None else np.asarray(masks)[some.trials]
            begin = some.start(weights) if leads else None if start is None else np.repeat(start[None], len(part), axis=0)
            audit = _fitted(rows, features, [], labels, part, n_folds, mask, l2, False, False, begin, center, scale)
            weights[some.trials] = np.where(audit.fit.valid[:, :, None], audit.fit.weights, np.nan)
            found = {r["trial"]: r for r in audit.measured()}  # at most `chunk` rows
            for t, trial in enumerate(some.trials.tolist()):
                r = found.get(t)
                n = int(r["n_rows"]) if r else 0
                good = r is not None and n >= min_rows and r["auc"] is not None
                out[trial] = {"trial": trial, "auc": float(r["auc"]) if good else None, "accuracy": float(r["accuracy"]) if good else None,
                              "n_rows": n, "weights": audit.fit.weights[t]}
    if rows is not df:
        rows.unpersist()
    return out


def model_table(spark, fitted: logistic.Fit, trial: int = 0, fold: int | None = None) -> DataFrame:
    """(feature, position, mean, scale, coefficient, raw_weight); position 0 is the intercept."""
    k = fitted.n_folds if fold is None else fold
    rows = [("intercept", 0, 0.0, 1.0, float(fitted.z_weights[trial, k, 0]),
             float(fitted.weights[trial, k, 0]))]
    for i, f in enumerate(fitted.features):
        rows.append((f, i + 1, float(fitted.means[trial, k, i]), float(fitted.scales[trial, k, i]),
                     float(fitted.z_weights[trial, k, i + 1]), float(fitted.weights[trial, k, i + 1])))
    return spark.createDataFrame(
        rows, "feature string, position int, mean double, scale double, coefficient double, raw_weight double")


def importance(model: DataFrame) -> DataFrame:
    """Signed coefficients by absolute size."""
    return (model.filter("position > 0")
            .select("feature", "coefficient", F.abs("coefficient").alias("importance"))
            .orderBy(F.col("importance").desc(), "feature"))
