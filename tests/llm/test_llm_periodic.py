"""Texts that repeat themselves, and pairs that share a history."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute
from veneer.llm import op2_suffix_dedup, op5_preference

ROWS = [(1, "a" * 3000), (2, "-=" * 900), (3, "x" + "-=" * 700 + "y"), (4, "abc" * 500 + "tail" * 30), (5, "a" * 64), (6, "a" * 65), (7, "-=" * 32),
        (8, "".join(chr(97 + i * i % 23) for i in range(500))), (9, "q" * 70 + "w" * 200 + "q" * 70), (None, "abc" * 40), (None, None), (4, "zz")]


@pytest.mark.parametrize("length,group", [(64, 1000), (64, 1), (400, 1000)])
def test_periodic_texts(spark, length, group):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = op2_suffix_dedup.suffix_dedup(df, length, group_pieces=group)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()) == Counter(brute.suffix_dedup(ROWS, length))


@pytest.mark.parametrize("text", ["a" * 1_000_000, "-=" * 100_000, "abcdefg" * 30_000])
def test_a_periodic_text_is_a_handful_of_pieces(spark, text):
    docs = spark.createDataFrame([(1, 2, text)], "id long, th long, text string")
    assert op2_suffix_dedup._pieces(docs, 400).count() <= 20
    row = op2_suffix_dedup.suffix_dedup(docs.select(F.col("id").alias("doc_id"), "text")).first()
    assert (row["n_removed"], row["n_spans"]) == (len(text), 1)


def test_chains_of_equal_pieces():
    c = np.array([7, 7, 9, 7, 7])
    own, times, reach = op2_suffix_dedup.chained(c, c, np.array([0, 5, 6, 10, 30]), 10)
    assert sorted(zip(own.tolist(), times.tolist(), reach.tolist())) == [(0, 3, 10), (2, 1, 0), (4, 1, 0)]


def test_histories_become_prompts(spark):
    rows = op5_preference.query(spark, SF)
    parts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    pairs = rows.select("pair_id").distinct().count()
    assert parts["prompt"] > pairs and parts["chosen"] == parts["rejected"] > 0
    talk = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "so?"), (0, 3, "assistant", "good"), (0, 4, "user", "bye"),
            (1, 0, "user", "x"), (1, 1, "assistant", "bad"), (2, 0, "user", "no reply"), (3, 0, "assistant", None), (4, 2, "assistant", "z"),
            (None, 0, "assistant", "q"), (5, None, "assistant", "q"), (0, 3, "assistant", "good")]
    df = spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").withColumn("end", F.lit(1)).withColumn("other", F.lit(2))
    got = {r["pair_id"]: r for r in op5_preference.preference_examples(op5_preference.alternative_replies(df)).collect()}
    assert set(got) == {0, 3}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[0]["prompt"] == say("user", "hi") + say("assistant", "yes") + say("user", "so?")
    assert (got[0]["chosen"], got[0]["rejected"]) == (say("assistant", "good"), say("assistant", "bad"))
    assert (got[3]["prompt"], got[3]["chosen"]) == ("", say("assistant", ""))
    assert op5_preference.alternative_replies(df.limit(0)).collect() == []
