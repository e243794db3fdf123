"""Cue detectors and rule sets with the real cue lists."""

import pytest
from pyspark.sql import functions as F

from veneer.functions import cues
from veneer.operators import reshape, rules


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [
    ("No, humans do not.", "No"), ("Note this.", None), ("Northern lights", None), ("not", "Not"), ("Contrary to belief", "Contrary to"),
    ("There is no proof", "There is no"), ("No'thing", None), ("  Nothing works", "Nothing")])
def test_opener(spark, text, want):
    assert one(spark, cues.opener, text) == want


def test_unwrapped_and_longest(spark):
    assert one(spark, lambda c: cues.unwrapped_start(c, ("Not", "No")), ' ("Notable') == "Not"
    assert one(spark, cues.longest_opener, '"There is no moon') == "There is no "
    assert one(spark, cues.longest_opener, "Nothing") is None


def test_tokens_and_breaks(spark):
    assert one(spark, lambda c: cues.first_token_hit(c, ("not", "n't")), "It can't be") is None
    assert one(spark, lambda c: cues.first_word_hit(c, ("may", "can")), "They CAN, may") == "may"
    assert one(spark, cues.authority_after_break, "The sky, studies show, is blue") == "studies show"
    assert one(spark, cues.authority_after_break, "Studies show the sky") is None
    assert one(spark, cues.joining_conjunction, "But it is; however it rains") == "but"


def test_strategy_and_class(spark):
    for text, want in [("No, it often rains", "negation_and_hedging"), ("Never again", "negation_opener"), ("It may rain", "hedging"),
                       ("According to all", "authority"), ("Plain", "none")]:
        assert one(spark, cues.surface_strategy, text) == want
    for text, want in [("No one came", "negation_led"), ("It isn’t so", "negation_led"), ("Yes it is", "positive_assertion"), ("", "positive_assertion")]:
        assert one(spark, cues.incorrect_class, text) == want


def test_length_drift(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 30), "one two"), (" ".join(["w"] * 17), "one two")], "a string, b string")
    assert [r["d"] for r in df.select(cues.length_drift(F.col("a"), F.col("b")).alias("d")).collect()] == [28, None]


@pytest.mark.parametrize("text,want", [
    ("Not everyone sees the Great Wall of China from space", "Great Wall of China"),
    ("Nothing about vitamin pills cures colds fast", "about vitamin pills"),
    ('"No Einstein failed math', "Einstein failed math"), ("It is the", "It is the")])
def test_subject_hint(spark, text, want):
    assert one(spark, cues.subject_hint, text) == want


@pytest.mark.parametrize("text,want", [("The answer is B.", "B"), ("because A", "A"), ("cab", "A"), ("xyz", None), ("", None), ("(b)", "B")])
def test_answer_letter(spark, text, want):
    assert one(spark, cues.answer_letter, text) == want


PAIR = "a_side string, b_side string, b_cue_strategy string, generator_confidence string, a_side_truth_rationale string, b_side_truth_rationale string"


def check(spark, validate, rows, schema):
    return [(r["ok"], r["reason"], r["warnings"]) for r in validate(spark.createDataFrame(rows, schema).coalesce(1)).collect()]


def test_fresh_pair(spark):
    got = check(spark, rules.validate_fresh_pair, [
        ("Cats sleep all day.", "No cats often bark.", "", "0.9", "", ""),
        ("Not a cat.", "No cats bark.", "", "0.9", "", ""),
        ("Cats lack wings.", "No cats bark.", "", "0.9", "", ""),
        ("Cats sleep.", "Cats bark.", "", "0.9", "", ""),
        ("Cats sleep.", "No cats bark but dogs do.", "", "0.9", "", ""),
        ("Cats sleep.", "No cats bark.", "", "0.5", "", ""),
        ("Cats sleep.", "Nothing barks.", "", "high", "", ""),
        ("Actually cats sleep.", "No cats bark.", "", "0.9", "", ""),
        ("  ", "No cats bark.", "", "0.9", "", "")], PAIR)
    assert got[0] == (True, None, [])
    assert [g[1] for g in got[1:]] == [
        "A starts with opener 'Not'", "A contains negation token 'lack'", "B starts with no required opener",
        "B contains contrast word 'but'", "confidence below minimum: 0.5", "confidence is not a number",
        "A starts with authority phrase 'actually'", "a_side empty"]
    assert got[5][2] == ["B has no hedge"]


def test_single_cue_pair(spark):
    ok = ("Cats sleep.", "Nothing barks here.", "negation_opener", "0.9", "fine", "fine")
    rows = [ok, ("Cats sleep.", "It usually barks.", "hedging", "0.9", "fine", "fine"),
            ("Cats sleep.", "Studies show that it barks.", "authority", "0.9", "fine", "fine"),
            ("Cats sleep.", "It barks.", "hedging", "0.9", "fine", "fine"),
            ("Cats sleep.", "No it often barks.", "negation_opener", "0.9", "fine", "fine"),
            ("Cats sleep.", "It often sometimes barks.", "hedging", "0.9", "fine", "fine"),
            ("Cats sleep.", "Nothing barks.", "negation_opener", "0.9", "as an AI", "fine"),
            ("Cats sleep.", "Nothing barks.", "mixed", "0.9", "fine", "fine")]
    got = check(spark, rules.validate_single_cue_pair, rows, PAIR)
    assert [g[0] for g in got] == [True, True, True, False, False, False, False, False]
    assert [g[1] for g in got[3:]] == [
        "B needs exactly one hedge, has 0", "B has banned hedges: often", "B needs exactly one hedge, has 2",
        "A rationale has red flag 'as an ai'", "invalid strategy: mixed"]
    short = check(spark, rules.validate_short_single_cue_pair, [ok], PAIR)
    assert short[0][1] == "wc_violation:A:2"


def test_plain_statement(spark):
    schema = "statement string, topic string, generator_confidence string, generator_truth_rationale string"
    text = "Water boils at one hundred degrees"
    rows = [(text, "Science", "0.9", "known"), (text, "Cooking", "0.9", "known"), ("Too short", "Science", "0.9", "known"),
            ("Water does not boil at ten degrees", "Science", "0.9", "x"), (text + " while hot", "Science", "0.9", "x"),
            (text, "Science", "0.9", "this is false"), ("Neither water nor oil boils here today", "Science", "0.9", "x")]
    got = check(spark, rules.validate_plain_statement, rows, schema)
    assert [g[1] for g in got] == [None, "invalid topic: Cooking", "wc_violation:2", "contains negation token 'not'",
                                   "contains contrast word 'while'", "rationale has red flag 'is false'", "starts with opener 'Neither'"]
    long = check(spark, lambda d: rules.validate_plain_statement(d, words=(22, 26)), rows[:1], schema)
    assert long[0][1] == "wc_violation:6"


def test_paraphrase(spark):
    schema = ("a_side_rewritten string, b_side_rewritten string, a_side_faithful string, b_side_faithful string, "
              "original_incorrect_classification string, generator_confidence_in_faithfulness double, original_correct string, original_incorrect string")
    good = "it keeps the same claim"
    rows = [("Cats sleep.", "Not a cat barks.", good, good, "negation_led", 0.9, "Cats sleep", "No cat barks"),
            ("Cats sleep.", "A cat barks.", good, good, "negation_led", 0.9, "x", "y"),
            ("Cats sleep.", "A cat may bark.", good, good, "positive_assertion", 0.9, "x", "y"),
            ("Cats sleep.", "A cat barks.", good, good, "positive_assertion", 0.9, "x", "y"),
            ("Cats sleep, studies show.", "A cat may bark.", good, good, "positive_assertion", 0.9, "x", "y"),
            ("Cats sleep.", "A cat may bark.", "short", good, "positive_assertion", 0.9, "x", "y"),
            ("Cats sleep.", "A cat may bark.", good, "this is a different fact", "positive_assertion", 0.9, "x", "y"),
            ("w " * 30, "A cat may bark.", good, good, "positive_assertion", 0.9, "x", "y")]
    got = check(spark, rules.validate_paraphrase, rows, schema)
    assert [g[1] for g in got] == [
        None, "B starts with no required opener", None, "B has neither hedge nor authority start",
        "A has authority cue 'studies show' after a break", "A self-check too short", "B self-check has red flag 'different fact'", None]
    assert got[7][2] == ["A length drift: 29"]


def test_single_statement(spark):
    rows = [(0.9, "fine"), (0.5, "fine"), (0.9, "this is actually true"), (None, "fine")]
    got = check(spark, rules.validate_single_statement, rows, "generator_confidence_in_falsity double, generator_rationale string")
    assert [g[0] for g in got] == [True, False, False, False]


def test_parse_replies(spark):
    rows = [('ok {"id": 3, "confidence": 0.5, "cues": ["a","b"]} bye',), ("no json",), ('{"id": "x", "confidence": "high"}',), ('{"confidence": 1}',)]
    df = spark.createDataFrame(rows, "reply string").coalesce(1)
    got = reshape.parse_replies(df, "id int, confidence double, cues array<string>", required=("id",), numeric=("confidence",)).collect()
    assert [r["parse_error"] for r in got] == [None, "no json object", "confidence is not a number", "missing field: id"]
    assert (got[0]["id"], got[0]["confidence"], got[0]["cues"]) == (3, 0.5, ["a", "b"])
