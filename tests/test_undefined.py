"""Undefined metrics, file identity, far logits and long series."""

import math

import pytest
from pyspark.sql import functions as F

from veneer.functions.stats import _binomial
from veneer.operators import merge, ordering
from veneer.operators.scoring import sigmoid
from veneer.sources.readers import read_predictions


def test_undefined_metrics_never_win(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0.5), ("a", 3, 0.4), ("a", 4, math.nan), ("b", 5, None)], "g string, k long, m double")
    assert {r["k"] for r in ordering.best_row(df, ["g"], ["m"]).collect()} == {3, 5}
    assert {r["k"] for r in ordering.max_score_row(df, ["g"], "m", "k").collect()} == {2, 5}


def test_equal_file_names_in_two_folders(spark, tmp_path):
    for folder, correct in (("run1", 1), ("run2", 0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "preds.csv").write_text(f"model_name,pair_id,correct\nm,7,{correct}\n")
        (tmp_path / folder / "example_model_predictions.csv").write_text("model_name,pair_id,correct\nm,1,1\n")
    got = read_predictions(spark, f"{tmp_path}/*/*.csv")
    assert {r["source_file"] for r in got.collect()} == {"run1/preds.csv", "run2/preds.csv"}
    assert merge.first_in_file(got).count() == 2


def test_far_logits_keep_their_order(spark):
    df = spark.createDataFrame([(-700.0,), (-40.0,), (-31.0,), (0.0,), (31.0,), (35.0,)], "x double").select("x", sigmoid(F.col("x")).alias("p"))
    rows = df.orderBy("x").collect()
    assert all(a["p"] < b["p"] for a, b in zip(rows, rows[1:])) and rows[3]["p"] == 0.5
    assert spark.range(1).select(sigmoid(F.lit(-800.0)).alias("p")).first()["p"] == 0.0


def test_long_series(spark):
    n = 10 ** 10
    assert _binomial(n / 2 - math.sqrt(n) / 2, n) == pytest.approx(0.31731, abs=1e-4)
