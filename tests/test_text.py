"""Hand vectors and edge rows for the text features, with the real lexicons."""

import pytest
from pyspark.sql import functions as F

from veneer.functions import text as tx
from veneer.functions.lexicons import PairLexicon, sensitivity_variants

# text, neg_lead, neg_cnt, hedge_rate, auth_rate, words, sents, avg_token_len, type_token, punc per char, punc per token, tokens
VECTORS = [
    ("Not all swans are white, according to ornithologists.", 1, 1, 0, 0.125, 8, 1, 5.5, 1, 0.018868, 0.125, 8),
    ("The Great Wall of China is visible from low Earth orbit.", 0, 0, 0, 0, 11, 1, 4.090909, 1, 0, 0, 11),
    ('"None of the listed options are correct."', 0, 1, 0, 0, 7, 2, 4.571429, 1, 0, 0, 7),
    ("Nothing in particular happens if you break a mirror.", 1, 1, 0, 0, 9, 1, 4.777778, 1, 0, 0, 9),
    ("", 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0),
    ("No, it usually isn't; experts say it may rain!  Really?", 1, 1, 0.2, 0.1, 10, 2, 4.1, 0.9, 0.054545, 0.3, 10),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "id int, text string")


def test_hand_vectors(texts):
    by_text = {r["id"]: r for r in tx.pair_features(texts, "text").collect()}
    by_token = {r["id"]: r for r in tx.pair_features(texts, "text", "surface10_audit").collect()}
    for i, v in enumerate(VECTORS):
        got = by_text[i]
        want = dict(zip(("neg_lead", "neg_cnt", "hedge_rate", "auth_rate", "word_count", "sent_count", "avg_token_len",
                         "type_token", "punc_rate"), v[1:10]))
        for name, value in want.items():
            assert got[name] == pytest.approx(value, abs=1e-6), (i, name)
        assert by_token[i]["punc_rate"] == pytest.approx(v[10], abs=1e-6)
        assert by_token[i]["word_count"] == v[11]


def test_null_and_blank_texts(spark):
    df = spark.createDataFrame([(None,), ("   \n\t",), (" ",)], "text string")
    for r in tx.pair_features(df, "text").collect():
        assert (r["neg_lead"], r["neg_cnt"], r["word_count"], r["sent_count"], r["type_token"]) == (0, 0, 0, 1, 0)
    for r in tx.claim_features(df, "text").collect():
        assert r["word_count"] == 0 and r["neg_lead"] == 0


def test_boundaries_are_unicode(spark):
    df = spark.createDataFrame([("éno no noé no",), ("no_no no-no",)], "text string")
    assert [r["neg_cnt"] for r in tx.pair_features(df, "text").collect()] == [2.0, 2.0]


def test_overlapping_terms_count_separately(spark):
    df = spark.createDataFrame([("It wasn't so, it wasn so.",)], "text string")
    # the short form also matches inside the contraction
    assert tx.claim_features(df, "text").first()["neg_cnt"] == 3.0


def test_adjacent_hits_all_count(spark):
    df = spark.createDataFrame([("no no no never",)], "text string")
    assert tx.pair_features(df, "text").first()["neg_cnt"] == 4.0


def test_question_negation_after_first_word(spark):
    rows = [("Isn't it true?", 0), ("Is it true you can’t swim?", 1), ("Why don't birds fall?", 1), ("Why xdon't", 0), ("Can't", 0)]
    df = spark.createDataFrame(rows, "text string, want int")
    for r in tx.claim_features(df, "text").collect():
        assert r["question_neg"] == r["want"], r["text"]


def test_claim_lead_needs_blank_or_end(spark):
    rows = [("Not here", 1), ("Not, here", 0), ("failed", 1), ("nothing", 0), ("Unable to go", 1)]
    for r in tx.claim_features(spark.createDataFrame(rows, "text string, want int"), "text").collect():
        assert r["neg_lead"] == r["want"], r["text"]


def test_wide_white_space_splits_words(spark):
    df = spark.createDataFrame([("a b　c d\te",)], "text string")
    r = df.select(tx.whitespace_words(F.col("text")).alias("n"), tx.strip(F.lit("  x 　")).alias("s")).first()
    assert (r["n"], r["s"]) == (5, "x")


def test_sensitivity_variants(spark):
    df = spark.createDataFrame([("Without proof it hardly works and fails.",)], "text string")
    got = {r["variant"]: (r["neg_lead"], r["neg_cnt"]) for r in tx.negation_variants(df, "text", sensitivity_variants()).collect()}
    assert got == {"A": (0, 0), "B": (1, 2), "C": (1, 3)}


def test_temporal_and_gap(spark):
    df = spark.createDataFrame([("Who is president now?", "as of", "abcd")], "q string, a string, b string")
    r = df.select(tx.temporal_fragile([F.lower("q"), F.lower("a")], PairLexicon().temporal).alias("t"),
                  tx.relative_length_gap(F.length("a"), F.length("b")).alias("g")).first()
    assert r["t"] == 1 and r["g"] == pytest.approx(0.2)


def test_normalized_text(spark):
    got = spark.range(1).select(tx.normalized_text(F.lit("  In the  California desert in the California.. ")).alias("k")).first()["k"]
    assert got == "in the california desert in california"
