"""Metrics over scored rows: rank AUC, accuracy, confusion, effect sizes, bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veneer.functions.draws import POISSON_STEPS, draw_word
from veneer.functions.stats import student_two_sided_p
from veneer.operators.single import attach
from veneer.operators.trial_labels import matrix

#: Scores are cut into 2**8 ranges at least, 2**13 at most.
_LEVELS = 8, 13


def _levels(df: DataFrame) -> int:
    """Bits of the number of ranges: several per shuffle partition, so ranges shrink as a job is given more partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max((4 * partitions - 1).bit_length(), _LEVELS[0]), _LEVELS[1])


def _range_of(score: Column, edges: Column, levels: int) -> Column:
    """Number of edges at or below the score, by binary search over the sorted edges."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.try_element_at(edges, at + step) <= score, at + step).otherwise(at))


def _in_ranges(df: DataFrame, value: str) -> DataFrame:
    """Add ``__range``: the position of ``value`` among common quantile edges (one-row side)."""
    levels = _levels(df)
    probs = F.array(*[F.lit(i / (1 << levels)) for i in range(1, 1 << levels)])
    # reading every column on both sides keeps the two plans equal below this point, so
    # Spark computes the aggregation underneath once and reuses its shuffle; which rows make
    # up the edges does not touch the result
    whole = df.filter(F.xxhash64(*df.columns) != 0)
    edges = whole.agg(F.percentile_approx(value, probs, F.lit(8 << levels)).alias("__edges"))
    return attach(df, edges).withColumn("__range", _range_of(F.col(value), F.col("__edges"), levels)).drop("__edges")


def midranks(counts: DataFrame, value: str, n: str, by: list[str], name: str) -> DataFrame:
    """Tie-averaged rank of each distinct value, given rows (by..., value, n) of counts."""
    ranged = _in_ranges(counts, value)
    inside = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range and group
    offsets = (ranged.groupBy(*by, "__range").agg(F.sum(n).alias("__n"))
               .withColumn("__lower", F.coalesce(F.sum("__n").over(lower), F.lit(0))).drop("__n"))
    rank = F.col("__lower") + F.coalesce(F.sum(n).over(inside), F.lit(0)) + (F.col(n) + 1) / 2
    return ranged.join(offsets, [*by, "__range"]).withColumn(name, rank).drop("__range", "__lower")


def auc(df: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None,
        weight: Column | None = None, cut: float | None = None) -> DataFrame:
    """Rank AUC with ties per group: (by..., auc, n_pos, n_neg); NULL for a single class.

    Rows are first reduced to one per (group, score). Scores are then cut at common
    quantile edges, so a running sum only ever covers one range of one group, and ranges
    are joined by the totals of the ranges below. Exact for any choice of edges.
    With ``cut`` the accuracy at that score and the row count come from the same counts.
    """
    w = weight if weight is not None else F.lit(1)
    one = F.col(label) == 1
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *(by or []), score, F.when(one, w).otherwise(0).alias("__pos"), F.when(one, 0).otherwise(w).alias("__neg"))
    return auc_of_counts(counts, score, "__pos", "__neg", by, 0.5 if cut is None else cut).select(
        *(by or []), "auc", "n_pos", "n_neg", *([] if cut is None else ["accuracy", "n_rows"]))


def auc_of_counts(df: DataFrame, score: str, pos: str, neg: str, by: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """The same from rows that count positives and negatives of a score: adds accuracy at ``cut`` and n_rows."""
    by = by or []
    tied = df.groupBy(*by, F.col(score).alias("__s")).agg(F.sum(pos).alias("__pos"), F.sum(neg).alias("__neg"))
    ranged = _in_ranges(tied, "__s")
    inside = (Window.partitionBy(*by, "__range").orderBy("__s")
              .rowsBetween(Window.unboundedPreceding, -1))
    hit = F.when(F.col("__s") >= cut, F.col("__pos")).otherwise(F.col("__neg"))
    # negatives below a positive count 1, tied negatives 1/2
    per_range = (ranged.withColumn("__below", F.coalesce(F.sum("__neg").over(inside), F.lit(0)))
                 .groupBy(*by, "__range")
                 .agg(F.sum(F.col("__pos") * (F.col("__below") + F.col("__neg") / 2)).alias("__u"),
                      F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n"), F.sum(hit).alias("__hits")))
    return auc_of_ranges(per_range, by)


def auc_of_ranges(per_range: DataFrame, by: list[str], many: bool = True) -> DataFrame:
    """The same from a row per range of scores: its own share __u of positives above negatives, positives __p, negatives
    __n and right answers __hits. Without ``many`` there is one row per group."""
    if many:
        lower = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        joined = per_range.withColumn("__lower", F.coalesce(F.sum("__n").over(lower), F.lit(0)))
        out = joined.groupBy(*by).agg(
            F.sum(F.col("__u") + F.col("__p") * F.col("__lower")).alias("__u"),
            F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"), F.sum("__hits").alias("__hits"))
    else:
        out = per_range.withColumnsRenamed({"__p": "n_pos", "__n": "n_neg"})
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    # factors are divided apart: their product can pass the integer range
    value = F.when(both, F.col("__u") / F.col("n_pos").cast("double") / F.col("n_neg").cast("double"))
    rows = F.col("n_pos") + F.col("n_neg")
    return out.select(*by, value.alias("auc"), "n_pos", "n_neg", F.try_divide("__hits", rows).alias("accuracy"), rows.alias("n_rows"))


def accuracy(df: DataFrame, score: str = "score", label: str = "label",
             by: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    hit = ((F.col(score) >= cut).cast("int") == F.col(label)).cast("double")
    aggs = [F.avg(hit).alias("accuracy"), F.count(score).alias("n_rows")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def confusion_report(df: DataFrame, score: str = "score", label: str = "label",
                     by: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """One row per class: support, predicted, hits, precision, recall, f1."""
    by = by or []
    pred = (F.col(score) >= cut).cast("int")
    cells = df.groupBy(*by, F.col(label).cast("int").alias("label"), pred.alias("pred")).count()
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("pred"), F.col("count")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("count").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")))).alias("r"))
    agg = sides.groupBy(*by, F.col("r.class").alias("class")).agg(
        F.sum("r.support").alias("support"), F.sum("r.predicted").alias("predicted"),
        F.sum("r.hits").alias("hits"))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted"))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support"))
    return agg.select("*", precision.alias("precision"), recall.alias("recall"),
                      F.when(F.col("support") + F.col("predicted") > 0,
                             2.0 * F.col("hits") / (F.col("support") + F.col("predicted"))).alias("f1"))


def long_features(answers: DataFrame, features, keep: list[str]) -> DataFrame:
    """(keep..., feature, value) rows by one pass over the answers."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                        for f in features])
    return answers.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.feature", "e.value")


def class_means(answers: DataFrame, features, label: str = "label") -> DataFrame:
    return (long_features(answers, features, [label]).groupBy("feature")
            .agg(F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("mean_true"),
                 F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("mean_false")))


def describe_features(answers: DataFrame, features, label: str = "label",
                      with_p: bool = True) -> DataFrame:
    """Means by side, pooled Cohen's d, Welch t with its degrees of freedom and p."""
    one, zero = F.col(label) == 1, F.col(label) == 0
    v = F.col("value")
    agg = long_features(answers, features, [label]).groupBy("feature").agg(
        F.avg(F.when(one, v)).alias("mean_true"), F.avg(F.when(zero, v)).alias("mean_false"),
        F.var_samp(F.when(one, v)).alias("v1"), F.var_samp(F.when(zero, v)).alias("v0"),
        F.sum(F.when(one, 1).otherwise(0)).alias("n1"), F.sum(F.when(zero, 1).otherwise(0)).alias("n0"))
    div = F.try_divide
    pooled = F.sqrt(div((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"),
                        F.col("n1") + F.col("n0") - 2))
    diff = F.col("mean_true") - F.col("mean_false")
    e1, e0 = div(F.col("v1"), F.col("n1")), div(F.col("v0"), F.col("n0"))
    df = div((e1 + e0) * (e1 + e0), div(e1 * e1, F.col("n1") - 1) + div(e0 * e0, F.col("n0") - 1))
    spread = (e1 + e0) > 0
    out = agg.select("feature", "mean_true", "mean_false",
                     (diff / (pooled + 1e-10)).alias("cohens_d"),
                     F.when(spread, diff / F.sqrt(e1 + e0)).alias("welch_t"),
                     F.when(spread, df).alias("welch_df"))
    if not with_p:
        return out
    p = student_two_sided_p("welch_t", "welch_df")
    return out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)


def _weighted_segments(replicates: int):
    """Task body over rows (at: score, label, words) in order of score: what each replicate's AUC needs of them.

    A task gives its first and its last score apart (kind 0: positives p, negatives n), as their ties may go on in other
    tasks, and what lies between as one piece (kind 1: u is its own share of positives above negatives).
    """
    steps = np.array(POISSON_STEPS)

    def counts(part):
        words = matrix(part.column("words"), part.num_rows)
        pieces = np.stack([(words >> (16 * slot)) & 65535 for slot in range(3)], axis=2).reshape(part.num_rows, -1)[:, :replicates]
        weight = np.searchsorted(steps, pieces, "right")
        positive = (part.column("label").to_numpy(zero_copy_only=False) == 1)[:, None]
        score = part.column("at").to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        return score[new], np.add.reduceat(weight * positive, new, axis=0), np.add.reduceat(weight * ~positive, new, axis=0)

    def rows(at, kind, u, p, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(replicates, dtype=np.int32)), pa.array(np.full(replicates, at)), pa.array(np.full(replicates, kind, np.int32)),
             pa.array(u.astype(float)), pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], ["replicate", "at", "kind", "u", "p", "n"])

    def run(batches):
        first = last = None  # (score, positives, negatives)
        u, p, n = np.zeros(replicates), np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                score, pos, neg = counts(batch.slice(start, 1024))
                if last is not None and last[0] == score[0]:
                    pos[0] += last[1]
                    neg[0] += last[2]
                elif last is not None:
                    score, pos, neg = np.append(last[0], score), np.vstack([last[1], pos]), np.vstack([last[2], neg])
                if first is None and len(score) > 1:
                    first = score[0], pos[0], neg[0]
                    score, pos, neg = score[1:], pos[1:], neg[1:]
                last = score[-1], pos[-1], neg[-1]
                pos, neg = pos[:-1], neg[:-1]
                u += (pos * (n + np.cumsum(neg, axis=0) - neg + neg / 2)).sum(axis=0)
                p += pos.sum(axis=0)
                n += neg.sum(axis=0)
        zero = np.zeros(replicates)
        if first is not None:
            yield rows(first[0], 0, zero, first[1], first[2])
            yield rows(first[0], 1, u, p, n)
        if last is not None:
            yield rows(last[0], 0, zero, last[1], last[2])

    return run


def bootstrap_auc(df: DataFrame, unit: str, replicates: int, seed: int, score: str = "score",
                  label: str = "label") -> DataFrame:
    """(replicate, auc): every unit (row or pair) enters with a hashed Poisson(1) weight.

    One md5 feeds three replicates. Rows are put in order of score once, for all replicates; a task then adds up their
    weights and sends a few numbers per replicate, so no row stands for a row and a replicate.
    """
    blocks = (replicates + 2) // 3
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(unit, F.col(score).cast("double").alias("at"), F.col(label).cast("int").alias("label"))
    ordered = known.repartitionByRange("at", F.xxhash64(unit)).sortWithinPartitions("at")
    words = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: draw_word(seed, b, unit))
    found = ordered.select("at", "label", words.alias("words")).mapInArrow(_weighted_segments(replicates), "replicate int, at double, kind int, u double, p long, n long")
    met = found.groupBy("replicate", "at", "kind").agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    # three pieces per task and replicate
    below = F.coalesce(F.sum("n").over(Window.partitionBy("replicate").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.col("kind") == 0, F.col("p") * F.col("n") / 2).otherwise(F.col("u"))
    sums = met.withColumn("w", own + F.col("p") * below).groupBy("replicate").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return (sums.filter((F.col("p") > 0) & (F.col("n") > 0))
            .select("replicate", (F.col("w") / F.col("p").cast("double") / F.col("n").cast("double")).alias("auc")))


def interval(replicates: DataFrame, value: str = "auc", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return replicates.agg(F.percentile(value, tail).alias("ci_lo"),
                          F.percentile(value, 1 - tail).alias("ci_hi"),
                          F.count(value).alias("n_replicates"))


def null_summary(null: DataFrame, observed: Column, value: str = "auc") -> DataFrame:
    """Mean, population std and share of null values at or above the observed one."""
    return null.agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("null_std"),
                    F.avg((F.col(value) >= observed).cast("double")).alias("p_value"),
                    F.count(value).alias("n_null"))
