"""Scores from stored model tables and per-pair scores for the searches."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.operators.metrics import class_means, long_features
from veneer.operators.single import attach


def sigmoid(x: Column) -> Column:
    """Logistic function; far below 0 the exponential is infinite and the result 0, nothing is cut off."""
    return 1.0 / (1.0 + F.exp(-x))


def probability_gap(a: Column, b: Column) -> Column:
    """|P(a) - P(b)| of two logits, to full precision where both probabilities are all but 0 or 1."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), sigmoid(high) * sigmoid(-low) * -F.expm1(low - high))


def model_row(model: DataFrame, features) -> DataFrame:
    """A model table as one row: intercept and one raw weight per feature."""
    pick = lambda name: F.max(F.when(F.col("feature") == name, F.col("raw_weight")))
    return model.agg(pick("intercept").alias("__w"), *[pick(f).alias(f"__w_{f}") for f in features])


def score_features(df: DataFrame, model: DataFrame, features, name: str = "p", logit: str | None = None) -> DataFrame:
    """P(label 1) from feature columns and a model table (features + 1 rows). ``logit`` names a column for what the
    probability comes from: it ranks rows whose probabilities are all 1."""
    joined = attach(df, model_row(model, features))
    eta = F.col("__w")
    for f in features:
        eta = eta + F.col(f"__w_{f}") * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    if logit:
        joined = joined.withColumn(logit, eta)
    return joined.withColumn(name, sigmoid(eta)).drop("__w", *[f"__w_{f}" for f in features])


def mean_length_gap(answers: DataFrame) -> DataFrame:
    """One row: the training mean of len_gap, used for texts that have no partner."""
    return answers.agg(F.avg("len_gap").alias("len_gap"))


def score_single_texts(features: DataFrame, model: DataFrame, names, training: DataFrame) -> DataFrame:
    """Score texts without a partner; len_gap is imputed with the training mean."""
    return score_features(attach(features, mean_length_gap(training)), model, names)


def pair_imbalance(answers: DataFrame, features, key: str = "pair_id", label: str = "label") -> DataFrame:
    """Per pair: summed absolute differences whose direction agrees with the class means."""
    gaps = class_means(answers, features, label)
    side = lambda v: F.max(F.when(F.col(label) == v, F.col("value")))
    deltas = long_features(answers, features, [key, label]).groupBy(key, "feature").agg(
        (side(1) - side(0)).alias("d"))
    # one row per feature
    joined = deltas.join(F.broadcast(gaps.select("feature", (F.col("mean_true") - F.col("mean_false")).alias("g"))), "feature")
    return joined.groupBy(key).agg(
        F.sum(F.when(F.col("d") * F.col("g") > 0, F.abs("d")).otherwise(0.0)).alias("imbalance"))


def pair_imbalance_wide(pairs: DataFrame, features, key: str = "pair_id") -> DataFrame:
    """The same from a delta table (d_<feature> per pair): no shuffle beyond one global mean row.

    The class-mean gap equals the mean of the pair differences when both sides are present.
    """
    gaps = pairs.agg(*[F.avg(f"d_{f}").alias(f"__g_{f}") for f in features])
    joined = attach(pairs, gaps)
    total = sum((F.when(F.col(f"d_{f}") * F.col(f"__g_{f}") > 0, F.abs(F.col(f"d_{f}"))).otherwise(0.0)
                 for f in features), F.lit(0.0))
    return joined.select(key, total.alias("imbalance"))


def pair_confidence(scored: DataFrame, by: list[str], score: str | None = None, label: str = "label", logit: str = "logit") -> DataFrame:
    """|p(true answer) - p(false answer)| per pair, from logits, or from a column of probabilities where only these are left."""
    side = lambda v: F.max(F.when(F.col(label) == v, F.col(score or logit)))
    gap = F.abs(side(1) - side(0)) if score else probability_gap(side(1), side(0))
    return scored.groupBy(*by).agg(gap.alias("confidence"))


def pair_separability(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean |p - 1/2| over the answers of a pair."""
    return scored.groupBy(*by).agg(F.avg(F.abs(F.col(score) - 0.5)).alias("separability"))


def retained_profile(kept: DataFrame, by: list[str]) -> DataFrame:
    return kept.groupBy(*by).agg(
        F.count(F.lit(1)).alias("retained_count"), F.avg("confounded_flag").alias("confounded_fraction"),
        F.avg("negation_flag").alias("negation_rate"), F.avg("length_gap").alias("length_gap_mean"),
        F.avg("hedge_diff").alias("hedge_diff_mean"), F.avg("authority_diff").alias("authority_diff_mean"))


def imbalance_penalty(kept: DataFrame, full: DataFrame, by: list[str]) -> DataFrame:
    """Retained profile plus the summed distance of its three rates to the full table."""
    whole = full.agg(F.count(F.lit(1)).alias("n_full"), F.avg("confounded_flag").alias("__c"),
                     F.avg("negation_flag").alias("__n"), F.avg("length_gap").alias("__l"))
    out = attach(retained_profile(kept, by), whole)
    penalty = (F.abs(F.col("confounded_fraction") - F.col("__c")) + F.abs(F.col("negation_rate") - F.col("__n"))
               + F.abs(F.col("length_gap_mean") - F.col("__l")))
    return out.withColumn("imbalance_penalty", penalty).drop("__c", "__n", "__l")


def search_objective(heldout: Column, keep_n: Column, n_full: Column, penalty: Column, min_keep: int,
                     w_heldout: float = 1.0, w_size: float = 1.0, w_imbalance: float = 1.0) -> Column:
    """Weighted distance to chance, size shortfall and imbalance; undefined AUC costs 1e9."""
    short = F.when(keep_n >= min_keep, F.lit(0.0)).otherwise(
        (F.lit(min_keep) - keep_n) / F.greatest(F.lit(1), n_full))
    value = w_heldout * F.abs(heldout - 0.5) + w_size * short + w_imbalance * penalty
    return F.when(heldout.isNull() | F.isnan(heldout), F.lit(1e9)).otherwise(value)


def mean_pool(token_vectors: DataFrame, key: str, vector: str = "embedding", mask: str | None = None) -> DataFrame:
    """Masked mean of token vectors per key as (key, position, value).

    The mean is an aggregate of whole vectors: a key's running sum is all that a partition sends on.
    """
    rows = token_vectors.filter(F.col(mask) == 1) if mask else token_vectors
    number = array_to_vector(F.transform(vector, lambda x: x.cast("double")))
    pooled = rows.filter(F.col(vector).isNotNull()).groupBy(key).agg(Summarizer.mean(number).alias("__mean"))
    return pooled.select(key, F.posexplode(vector_to_array("__mean")).alias("position", "value"))


def to_vector(pooled: DataFrame, key: str) -> DataFrame:
    """(key, vector) from (key, position, value): as many entries as the vector has dimensions."""
    cells = F.array_sort(F.collect_list(F.struct("position", "value")))
    return pooled.groupBy(key).agg(F.transform(cells, lambda c: c["value"]).alias("vector"))


def l2_normalized(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    # bound once through a one-element array, so the norm is not recomputed per entry
    scaled = F.transform(F.array(F.when(norm > 0, norm).otherwise(F.lit(1.0))),
                         lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return F.element_at(scaled, 1)
