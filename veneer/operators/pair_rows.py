"""Answer rows that keep a pair's rows side by side, and what loops over pairs ask of them.

A partition holds whole pairs in order of their ids, so a score of pairs, the place of an edge among the scores and the
mark of a removal are each one pass without a shuffle. A row says at which step each trial removed its pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veneer.operators.audit import feature_vector
from veneer.operators.blocks import Blocks, tasks
from veneer.operators.ordering import global_rank
from veneer.operators.trial_labels import matrix

#: A trial's scores that a task sends at once, as they are or thinned out: 64 kB.
SENT = 1 << 12
_NO_ID = np.iinfo(np.int64).min  # stands for a missing id: before all others
#: Step of a pair that was put back.
BACK = -2
_TURN = np.array([1.0, -1.0, 1.0, -1.0])


def paired(answers: DataFrame, features, trials: int, gone: DataFrame) -> Blocks:
    """Blocks of whole pairs with (pair_id, fold, x, y, d, gone): d has the differences of the pair's sides, NULL where a side has no value; gone the
    step at which each trial removed the pair, below 0 for none. ``gone`` (trial, pair_id) is what was removed at step 0."""
    removed = gone.groupBy("pair_id").agg(F.collect_set(F.col("trial").cast("int")).alias("__by"))  # at most `trials`
    pair = Window.partitionBy("pair_id")
    side = lambda f, v: F.max(F.when(F.col("label") == v, F.col(f))).over(pair)
    steps = [F.when(F.array_contains("__by", F.lit(t)), F.lit(0)).otherwise(F.lit(-1)) for t in range(trials)]
    n = answers.count()
    rows = answers.join(removed, "pair_id", "left").repartition(tasks(n), "pair_id").select(
        F.col("pair_id").cast("long").alias("pair_id"), F.col("fold").cast("int").alias("fold"), feature_vector(features).alias("x"),
        F.col("label").cast("tinyint").alias("y"), F.array(*[(side(f, 1) - side(f, 0)).cast("double") for f in features]).alias("d"),
        F.array(*steps).alias("gone"))
    return Blocks.of(rows, n, whole_pairs)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("pair_id").fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)


def whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a pair ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = _ids(batch)
        new = np.flatnonzero(np.append(bool(held) and _ids(held[-1])[-1] != ids[0], ids[1:] != ids[:-1]))
        if not len(new):
            held.append(batch)
            continue
        yield from _joined([*held, batch.slice(0, new[-1])])
        held = [batch.slice(new[-1])]
    yield from _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [p for p in parts if p.num_rows]
    if parts:
        yield parts[0] if len(parts) == 1 else pa.concat_batches(parts)


class Pairs:
    """The pairs of a batch: ids, where each starts, and which rows are theirs."""

    def __init__(self, batch: pa.RecordBatch):
        ids = _ids(batch)
        self.batch, self.first = batch, np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        self.ids = ids[self.first]
        self.sizes = np.diff(np.append(self.first, len(ids)))

    def present(self, trials) -> np.ndarray:
        """Pairs x trials."""
        return matrix(self.batch.column("gone"), self.batch.num_rows)[self.first][:, trials] < 0

    def differences(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs x features, and which of them are known."""
        cells = self.batch.column("d").flatten()
        shape = (self.batch.num_rows, -1)
        known = cells.is_valid().to_numpy(zero_copy_only=False).reshape(shape)[self.first]
        return np.where(known, cells.to_numpy(zero_copy_only=False).reshape(shape)[self.first], 0.0), known

    def highest(self, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Per pair and column the highest value of the rows (rows x columns) that count; NaN if none does."""
        best = np.maximum.reduceat(np.where(rows, value, -np.inf), self.first, axis=0)
        return np.where(np.logical_or.reduceat(rows, self.first, axis=0), best, np.nan)


def gaps(rows: Blocks, trials: list[int], d: int) -> np.ndarray:
    """Trials x features: the mean difference of the pairs that a trial still has; NaN if none is known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(trials), d)), np.zeros((len(trials), d))
        for batch in batches:
            pairs = Pairs(batch)
            inside = pairs.present(trials).T.astype(float)
            value, known = pairs.differences()
            if np.isfinite(value).all():
                total += inside @ value
            else:  # a product would carry a pair's NaN to trials that do not have it
                total += np.where(inside[:, :, None] > 0, value[None], 0.0).sum(axis=1)
            count += inside @ known
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["total", "count"])

    found = rows.passed(run)  # a row per task
    add = lambda name: sum((np.frombuffer(c).reshape(len(trials), d) for c in found.column(name).to_pylist()), np.zeros((len(trials), d)))
    total, count = add("total"), add("count")
    return np.where(count > 0, total / np.maximum(count, 1.0), np.nan)


def probability_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|P(a) - P(b)| of two logits, to full precision where both probabilities are all but 0 or 1."""
    high, low = np.maximum(a, b), np.minimum(a, b)
    with np.errstate(over="ignore", invalid="ignore"):
        return 1.0 / (1.0 + np.exp(-high)) * (1.0 / (1.0 + np.exp(low))) * -np.expm1(low - high)


@dataclass
class Imbalance:
    """Summed differences of the sides that agree with the trial's gaps."""

    trials: list[int]
    gaps: np.ndarray

    def score(self, pairs: Pairs, trial: int) -> np.ndarray:
        value, known = pairs.differences()
        total = np.zeros(len(pairs.ids))
        for j, g in enumerate(self.gaps[self.trials.index(trial)]):
            with np.errstate(invalid="ignore"):
                along = value[:, j] * g
                total += np.where(known[:, j] & ~np.isnan(g) & ((along > 0) | np.isnan(along)), np.abs(value[:, j]), 0.0)
        return total


@dataclass
class Confidence:
    """How far apart the held-out probabilities of a pair's sides are."""

    trials: list[int]
    logits: object  # of a batch: rows x trials, NaN where there is none

    def score(self, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
        """Pairs x trials (NaN: a side is missing), and which pairs have a scored row."""
        logit = self.logits(pairs.batch)
        y = pairs.batch.column("y").to_numpy(zero_copy_only=False)[:, None]
        known = ~np.isnan(logit)
        scored = np.logical_or.reduceat(known & (y >= 0), pairs.first, axis=0)
        return probability_gap(pairs.highest(logit, known & (y == 1)), pairs.highest(logit, known & (y == 0))), scored


def scaled(value: np.ndarray, low: float, high: float) -> np.ndarray:
    """Between 0 and 1; a flat column becomes 0."""
    if high <= low + 1e-15:
        return np.zeros(len(value))
    return (value - low) / (high - low)


@dataclass
class Scores:
    """Scores of pairs by each trial's strategy; NaN where a trial doesn't have the pair or can't score it."""

    of: dict[int, tuple[str, float]]  # strategy and alpha of the trials
    imbalance: Imbalance | None
    confidence: Confidence | None
    limits: dict[int, tuple] = field(default_factory=dict)  # of hybrid trials: least and highest of both scores

    def parts(self, pairs: Pairs):
        """Per trial: (confidence, imbalance) of the pairs that it has and scores."""
        present = pairs.present(list(self.of))
        conf, scored = self.confidence.score(pairs) if self.confidence else (None, None)
        for k, (t, (strategy, _)) in enumerate(self.of.items()):
            inside, c, i = present[:, k], None, None
            if strategy != "imbalance":
                at = self.confidence.trials.index(t)
                c, inside = conf[:, at], inside & scored[:, at]
            if strategy != "confidence":
                i = self.imbalance.score(pairs, t)
            yield t, inside, c, i

    def of_pairs(self, pairs: Pairs) -> dict[int, np.ndarray]:
        out = {}
        for t, inside, c, i in self.parts(pairs):
            if c is not None and i is not None:
                alpha, (c_low, c_high, i_low, i_high) = self.of[t][1], self.limits[t]
                value = alpha * scaled(c, c_low, c_high) + (1.0 - alpha) * scaled(i, i_low, i_high)
            else:
                value = i if c is None else c
            out[t] = np.where(inside, value, np.nan)
        return out


def limits(rows: Blocks, scores: Scores, trials: list[int]) -> dict[int, tuple]:
    """Least and highest confidence and imbalance of the pairs that a trial has and scores."""
    part = Scores({t: scores.of[t] for t in trials}, scores.imbalance, scores.confidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.full((len(trials), 4), np.nan)
        for batch in batches:
            for k, (_, inside, c, i) in enumerate(part.parts(Pairs(batch))):
                if inside.any():
                    c, i = c[inside], i[inside]
                    found[k] = np.fmin(found[k] * _TURN, np.array([np.fmin.reduce(c), -np.fmax.reduce(c), np.fmin.reduce(i), -np.fmax.reduce(i)])) * _TURN
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["found"])

    sent = rows.passed(run).column("found").to_pylist()  # a row per task
    both = np.stack([np.frombuffer(s).reshape(len(trials), 4) for s in sent]) if sent else np.full((1, len(trials), 4), np.nan)
    edges = np.fmin.reduce(both * _TURN, axis=0) * _TURN
    return {t: tuple(edges[k].tolist()) for k, t in enumerate(trials)}


@dataclass
class Draws:
    """Hashed draws among the pairs that some trials' edges let in: the least draw has the highest score."""

    scores: object
    edges: dict[int, tuple[float, int]]
    seeds: dict[int, int]
    stream: str

    def of_pairs(self, pairs: Pairs) -> dict[int, np.ndarray]:
        out = self.scores.of_pairs(pairs)
        for t, seed in self.seeds.items():
            drawn = np.full(len(pairs.ids), np.nan)
            for at in np.flatnonzero(not_after(out[t], pairs.ids, self.edges[t])):
                parts = [str(seed), self.stream] + ([] if pairs.ids[at] == _NO_ID else [str(pairs.ids[at])])
                # words of 52 bits are exact as doubles
                drawn[at] = -float(int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16))
            out[t] = drawn
        return out


def not_after(score: np.ndarray, ids: np.ndarray, edge: tuple[float, int]) -> np.ndarray:
    """Pairs that stand at an edge (score, id) or before it in descending order; ties by small id, NaN never."""
    with np.errstate(invalid="ignore"):
        return (score > edge[0]) | ((score == edge[0]) & (ids <= edge[1]))


def _order(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -score))


def kth_highest(rows: Blocks, scores, wanted: dict[int, int]) -> dict[int, tuple[float, int]]:
    """Per trial the (score, id) of the k-th pair in descending order, or one after all pairs where there are fewer.

    A task sends its scores, or every g-th of them if there are many. What these leave open lies between two scores, in
    which the next pass looks. At most `SENT` scores a task and trial are sent, whatever the size of the table or of k.
    """
    everything = (-np.inf, np.iinfo(np.int64).max)
    between: dict[int, tuple] = {t: (None, everything) for t in wanted}  # after the first, up to the second
    found: dict[int, tuple[float, int]] = {}
    while open_ := [t for t in wanted if t not in found]:
        ranges = {t: between[t] for t in open_}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {t: [] for t in ranges}
            before = dict.fromkeys(ranges, 0)
            for batch in batches:
                pairs = Pairs(batch)
                of = scores.of_pairs(pairs)
                for t, (first, last) in ranges.items():
                    inside = not_after(of[t], pairs.ids, last)
                    if first is not None:
                        sure = not_after(of[t], pairs.ids, first)
                        before[t] += int(sure.sum())
                        inside &= ~sure
                    held[t].append((of[t][inside], pairs.ids[inside]))
            sent = []
            for t, parts in held.items():
                score, ids = (np.concatenate([np.empty(0, k), *c]) for k, c in zip((float, np.int64), zip(*parts))) if parts else (np.empty(0), np.empty(0, np.int64))
                order = _order(score, ids)
                step = max(1, -(-len(order) // SENT))
                ends = np.append(np.arange(step, len(order), step), len(order))[:len(order)]  # how many stand at each or before it
                at = order[ends - 1]
                sent.append((t, before[t], step, score[at].tobytes(), ids[at].tobytes(), np.diff(np.append(0, ends)).astype(np.int64).tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent), kinds)], ["trial", "before", "step", "score", "id", "n"])

        parts = rows.passed(run).to_pylist()
        for t in open_:
            own = [p for p in parts if p["trial"] == t]
            score, ids, n = (np.concatenate([np.frombuffer(p[c], k) for p in own] or [np.empty(0, k)]) for c, k in (("score", float), ("id", np.int64), ("n", np.int64)))
            order = _order(score, ids)
            score, ids, at_least = score[order], ids[order], np.cumsum(n[order])
            k = wanted[t] - sum(p["before"] for p in own)
            loose = sum(p["step"] - 1 for p in own)
            if not len(order) or at_least[-1] < k:
                found[t] = everything
                continue
            upper = int(np.searchsorted(at_least, k))
            if not loose:
                found[t] = (float(score[upper]), int(ids[upper]))
                continue
            lower = int(np.searchsorted(at_least + loose, k)) - 1  # the last point that is surely before the k-th pair
            first = (float(score[lower]), int(ids[lower])) if lower >= 0 else between[t][0]
            between[t] = (first, (float(score[upper]), int(ids[upper])))
    return found


def mark(rows: Blocks, scores, edges: dict[int, tuple[float, int]], step: int, cut: bool = False) -> Blocks:
    """The rows with the step at pairs up to each trial's edge. A pair without an id is never removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = Pairs(batch)
            gone = np.array(matrix(batch.column("gone"), batch.num_rows), np.int32)
            for t, score in scores.of_pairs(pairs).items():
                taken = not_after(score, pairs.ids, edges[t]) & (pairs.ids != _NO_ID)
                gone[np.repeat(taken, pairs.sizes), t] = step
            yield with_lists(batch, "gone", gone)

    return rows.changed(run, cut)


def with_lists(batch: pa.RecordBatch, name: str, cells: np.ndarray) -> pa.RecordBatch:
    """The batch with rows of these cells as one of its columns."""
    starts = pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32))
    column = pa.ListArray.from_arrays(starts, pa.array(cells.reshape(-1)))
    return pa.RecordBatch.from_arrays([column if n == name else batch.column(n) for n in batch.schema.names], batch.schema.names)


def kept_and_left_out(rows: Blocks) -> tuple[int, int]:
    """Rows of the pairs that are there, and the most rows of a pair that is not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, most = 0, 0
        for batch in batches:
            pairs = Pairs(batch)
            there = pairs.present([0])[:, 0] & (pairs.ids != _NO_ID)
            kept, most = kept + int(pairs.sizes[there].sum()), max(most, int(pairs.sizes[~there].max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([kept]), pa.array([most])], ["kept", "most"])

    found = rows.passed(run)
    return sum(found.column("kept").to_pylist()), max(found.column("most").to_pylist())


def next_left_out(rows: Blocks, after: int | None, n: int) -> list[int]:
    """The n least ids above one of pairs that are not there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.empty(0, np.int64)
        for batch in batches:
            pairs = Pairs(batch)
            ids = pairs.ids[~pairs.present([0])[:, 0] & (pairs.ids > (_NO_ID if after is None else after))]
            least = np.sort(np.append(least, ids))[:n]
        yield pa.RecordBatch.from_arrays([pa.array(least)], ["pair_id"])

    return np.sort(rows.passed(run).column("pair_id").to_numpy())[:n].tolist()


def with_candidates(rows: Blocks, ids: list[int]) -> Blocks:
    """(fold, x, y, base, spot) of the pairs that are there (base 1) and of the candidates, with their places in the list."""
    ids = np.asarray(ids, np.int64)  # ascending

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _ids(batch)
            base = (matrix(batch.column("gone"), batch.num_rows)[:, 0] < 0) & (own != _NO_ID)
            place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            spot = np.where(~base & (ids[place] == own), place, -1)
            inside = np.flatnonzero(base | (spot >= 0))
            if len(inside):
                part = batch.select(["fold", "x", "y"]).take(pa.array(inside))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base[inside].astype(np.int8)), pa.array(spot[inside])], ["fold", "x", "y", "base", "spot"])

    return rows.changed(run)


def put_back(rows: Blocks, ids: list[int], cut: bool = False) -> Blocks:
    """The rows with these pairs there again: their step is `BACK`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = np.array(matrix(batch.column("gone"), batch.num_rows), np.int32)
            gone[np.isin(_ids(batch), ids)] = BACK
            yield with_lists(batch, "gone", gone)

    return rows.changed(run, cut)


def came_back(rows: Blocks) -> DataFrame:
    """(pair_id) of the pairs that were put back."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = Pairs(batch)
            back = matrix(batch.column("gone"), batch.num_rows)[pairs.first, 0] == BACK
            yield from ((int(i),) for i in pairs.ids[back])

    return SparkSession.active().createDataFrame(rows.rdd.mapPartitions(run), "pair_id long")


def orders(rows: Blocks, scores: Scores) -> DataFrame:
    """(pair_id, inside, at): places from 0, of the pairs that are there by descending score (0 where there is none), of the others
    by id."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = Pairs(batch)
            score, there = np.nan_to_num(scores.of_pairs(pairs)[0], nan=0.0), pairs.present([0])[:, 0]
            yield from ((int(i), bool(t), -float(s) if t else 0.0) for i, t, s in zip(pairs.ids, there, score) if i != _NO_ID)

    keys = SparkSession.active().createDataFrame(rows.rdd.mapPartitions(run), "pair_id long, inside boolean, key double")
    ranked = global_rank(keys, ["key", "pair_id"], by=["inside"])
    return ranked.select("pair_id", "inside", (F.col("rank") - 1).alias("at"))


def with_orders(answers: DataFrame, places: DataFrame, features) -> Blocks:
    """(pair_id, fold, x, y, base, spot, lead): base and lead of the pairs that are there, spot of the others; -1 for none."""
    rows = answers.join(places, "pair_id").select(
        "pair_id", F.col("fold").cast("int").alias("fold"), feature_vector(features).alias("x"), F.col("label").cast("tinyint").alias("y"),
        F.col("inside").cast("tinyint").alias("base"), F.when(F.col("inside"), -1).otherwise(F.col("at")).alias("spot"),
        F.when(F.col("inside"), F.col("at")).otherwise(-1).alias("lead"))
    n = answers.count()
    return Blocks.of(rows.repartition(tasks(n), "pair_id"), n)


def swapped(rows: Blocks, first: int, last: int) -> Blocks:
    """Of `with_orders` the pairs that are there and those at some places of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("base", "spot"))
            inside = np.flatnonzero((base == 1) | ((spot >= first) & (spot <= last)))
            if len(inside):
                yield batch.select(["fold", "x", "y", "base", "spot", "lead"]).take(pa.array(inside))

    return rows.changed(run)


def ids_at(rows: Blocks, spot: int, lead: int) -> tuple[int, int]:
    """The pairs at a place of the others and at one of those that are there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("spot", "lead")]
            hit = np.flatnonzero((at[0] == spot) | (at[1] == lead))
            yield batch.select(["pair_id", "spot"]).take(pa.array(hit))

    found = {r["spot"] >= 0: r["pair_id"] for r in rows.passed(run).to_pylist()}  # the rows of two pairs
    return found[True], found[False]


def removals(rows: Blocks) -> DataFrame:
    """(trial, step, pair_id) of all removals after step 0."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pairs = Pairs(batch)
            gone = matrix(batch.column("gone"), batch.num_rows)[pairs.first]
            for at, trial in zip(*np.nonzero(gone > 0)):
                yield int(trial), int(gone[at, trial]), int(pairs.ids[at])

    return SparkSession.active().createDataFrame(rows.rdd.mapPartitions(run), "trial int, step int, pair_id long")
