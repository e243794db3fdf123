"""Validation of probe records by ordered rule lists.

A rule is (condition, reason). A rule set yields ``ok``, ``reason`` (the first rule that
fires, list order) and ``warnings``. Everything is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions import cues
from veneer.functions import lexicons as lx
from veneer.functions.text import strip, text_or_blank, whitespace_words

CONFIDENCE_MIN = 0.70
STRATEGIES = ("negation_opener", "hedging", "authority")


def apply_rules(df: DataFrame, rules: list[tuple[Column | None, Column]],
                warnings: list[tuple[Column | None, Column]] = ()) -> DataFrame:
    """Append ok, reason, warnings. A rule without condition fires when its reason is not NULL."""
    fire = lambda cond, why: why if cond is None else F.when(cond, why)
    reason = F.coalesce(*[fire(cond, why) for cond, why in rules])
    warn = (F.array_compact(F.array(*[fire(cond, why) for cond, why in warnings]))
            if warnings else F.array().cast("array<string>"))
    return (df.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
              .withColumn("warnings", warn))


def _stripped(df: DataFrame, **texts: str) -> DataFrame:
    """Stripped texts as columns, so the dozens of conditions below do not strip again."""
    return df.withColumns({f"__{name}": strip(text_or_blank(c)) for name, c in texts.items()})


def _hit(found: Column, template: str) -> tuple[Column | None, Column]:
    """Rule that fires when a detector found something; ``{}`` takes the finding."""
    head, tail = template.split("{}")
    return None, F.concat(F.lit(head), found, F.lit(tail))  # NULL when nothing is found


def _low_confidence(value: Column) -> list[tuple[Column, Column]]:
    number = value.try_cast("double")
    return [(number.isNull(), F.lit("confidence is not a number")),
            (number < CONFIDENCE_MIN, F.concat(F.lit("confidence below minimum: "), number.cast("string")))]


def _blank(text: Column, name: str) -> tuple[Column, Column]:
    return strip(text) == "", F.lit(f"{name} empty")


def _word_band(text: Column, side: str, low: int, high: int) -> tuple[Column, Column]:
    n = whitespace_words(text)
    return (n < low) | (n > high), F.concat(F.lit(f"wc_violation:{side}" if side else "wc_violation"),
                                            F.lit(":"), n.cast("string"))


@dataclass(frozen=True)
class PairCues:
    """Word lists of the two-sided rule sets."""

    openers: tuple = lx.OPENERS
    negations: tuple = lx.FRESH_NEGATIONS
    hedges: tuple = lx.FRESH_HEDGES
    strict_hedges: tuple = lx.SINGLE_CUE_HEDGES
    banned_hedges: tuple = lx.SINGLE_CUE_BANNED_HEDGES
    authority_starts: tuple = lx.FRESH_AUTHORITY_STARTS
    contrasts: tuple = lx.FRESH_CONTRASTS
    red_flags: tuple = lx.SINGLE_CUE_RED_FLAGS


SINGLE_CUE = PairCues(authority_starts=lx.SINGLE_CUE_AUTHORITY_STARTS, contrasts=lx.SINGLE_CUE_CONTRASTS)


def validate_fresh_pair(df: DataFrame, a: str = "a_side", b: str = "b_side",
                        confidence: str = "generator_confidence", c: PairCues = PairCues()) -> DataFrame:
    """Fresh two-sided answers: plain A side, cue-led B side."""
    ready, ta, tb = _stripped(df, a=a, b=b), F.col("__a"), F.col("__b")
    rules = [
        _blank(ta, "a_side"), _blank(tb, "b_side"),
        _hit(cues.opener(ta, c.openers), "A starts with opener '{}'"),
        _hit(cues.first_word_hit(ta, c.negations), "A contains negation token '{}'"),
        _hit(cues.first_word_hit(ta, c.hedges), "A contains hedge '{}'"),
        _hit(cues.start_phrase(ta, c.authority_starts), "A starts with authority phrase '{}'"),
        (cues.opener(tb, c.openers).isNull(), F.lit("B starts with no required opener")),
        _hit(cues.first_word_hit(ta, c.contrasts), "A contains contrast word '{}'"),
        _hit(cues.first_word_hit(tb, c.contrasts), "B contains contrast word '{}'"),
        *_low_confidence(F.col(confidence)),
    ]
    return apply_rules(ready, rules, [(cues.first_word_hit(tb, c.hedges).isNull(), F.lit("B has no hedge"))]).drop("__a", "__b")


def validate_single_cue_pair(df: DataFrame, a: str = "a_side", b: str = "b_side",
                             strategy: str = "b_cue_strategy", confidence: str = "generator_confidence",
                             rationales: tuple = ("a_side_truth_rationale", "b_side_truth_rationale"),
                             strategies: tuple = STRATEGIES, words: tuple | None = None,
                             c: PairCues = SINGLE_CUE) -> DataFrame:
    """Exactly one observed cue on B, equal to the assigned strategy; ``words`` adds length bands."""
    ready = _stripped(df, a=a, b=b, plan=strategy)
    ta, tb, plan = F.col("__a"), F.col("__b"), F.col("__plan")
    # detectors that several rules read
    ready = ready.withColumns({
        "__seen": cues.observed_cues(tb, c.openers, c.strict_hedges, c.authority_starts),
        "__banned": cues.distinct_word_hits(tb, c.banned_hedges),
        "__strict": F.size(cues.distinct_word_hits(tb, c.strict_hedges)),
        "__opens": cues.unwrapped_start(tb, c.openers).isNotNull(),
        "__auth": cues.unwrapped_start(tb, c.authority_starts).isNotNull()})
    opens, auth, strict, banned, seen = (F.col(f"__{n}") for n in ("opens", "auth", "strict", "banned", "seen"))
    by_neg, by_hedge, by_auth = plan == "negation_opener", plan == "hedging", plan == "authority"
    rules = [
        _blank(ta, "a_side"), _blank(tb, "b_side"),
        (~plan.isin(*strategies), F.concat(F.lit("invalid strategy: "), plan)),
        *([_word_band(ta, "A", *words), _word_band(tb, "B", *words)] if words else []),
        _hit(cues.unwrapped_start(ta, c.openers), "A starts with opener '{}'"),
        _hit(cues.first_word_hit(ta, c.contrasts), "A contains contrast word '{}'"),
        _hit(cues.first_word_hit(tb, c.contrasts), "B contains contrast word '{}'"),
        (by_neg & ~opens, F.lit("B must start with an opener")),
        (by_neg & (F.size(banned) > 0), F.concat(F.lit("B has banned hedges: "), F.array_join(banned, ","))),
        (by_neg & auth, F.lit("B must not start with an authority phrase")),
        (by_hedge & opens, F.lit("B must not start with an opener")),
        (by_hedge & auth, F.lit("B must not start with an authority phrase")),
        (by_hedge & (strict != 1), F.concat(F.lit("B needs exactly one hedge, has "), strict.cast("string"))),
        (by_auth & ~auth, F.lit("B must start with an authority phrase")),
        (by_auth & opens, F.lit("B must not start with an opener")),
        (by_auth & (F.size(banned) > 0), F.concat(F.lit("B has banned hedges: "), F.array_join(banned, ","))),
        *_low_confidence(F.col(confidence)),
        *[_hit(cues.first_substring(F.col(r), c.red_flags), f"{side} rationale has red flag '{{}}'")
          for side, r in zip("AB", rationales)],
        (F.size(seen) != 1, F.concat(F.lit("observed cues: "), F.array_join(seen, ","))),
        (F.try_element_at(seen, F.lit(1)) != plan, F.lit("observed cue differs from strategy")),
    ]
    return apply_rules(ready, rules).drop("__a", "__b", "__plan", "__seen", "__banned", "__strict", "__opens", "__auth")


def validate_short_single_cue_pair(df: DataFrame, **names) -> DataFrame:
    """Single-cue rules with two strategies and 5 to 20 words on both sides."""
    return validate_single_cue_pair(df, strategies=STRATEGIES[:2], words=(5, 20), **names)


@dataclass(frozen=True)
class PlainCues:
    """Word lists of the one-statement rule set."""

    topics: tuple = lx.PLAIN_TOPICS
    openers: tuple = lx.PLAIN_OPENERS
    negations: tuple = lx.PLAIN_NEGATIONS
    authority_starts: tuple = lx.PLAIN_AUTHORITY_STARTS
    authority: tuple = lx.PLAIN_AUTHORITY
    hedges: tuple = lx.PLAIN_HEDGES
    contrasts: tuple = lx.PLAIN_CONTRASTS
    red_flags: tuple = lx.PLAIN_RED_FLAGS


def validate_plain_statement(df: DataFrame, statement: str = "statement", topic: str = "topic",
                             confidence: str = "generator_confidence",
                             rationale: str = "generator_truth_rationale",
                             words: tuple = (5, 15), c: PlainCues = PlainCues()) -> DataFrame:
    """A statement stripped of every cue; the long variant passes words=(22, 26)."""
    ready, t, kind = _stripped(df, t=statement, kind=topic), F.col("__t"), F.col("__kind")
    rules = [
        _blank(t, "statement"),
        (~kind.isin(*c.topics), F.concat(F.lit("invalid topic: "), kind)),
        _word_band(t, "", *words),
        _hit(cues.unwrapped_start(t, c.openers), "starts with opener '{}'"),
        _hit(cues.first_token_hit(t, c.negations), "contains negation token '{}'"),
        _hit(cues.unwrapped_start(t, c.authority_starts), "starts with authority phrase '{}'"),
        _hit(cues.first_substring(t, c.authority), "contains authority phrase '{}'"),
        _hit(cues.first_token_hit(t, c.hedges), "contains hedge '{}'"),
        _hit(cues.first_token_hit(t, c.contrasts), "contains contrast word '{}'"),
        *_low_confidence(F.col(confidence)),
        _hit(cues.first_substring(F.col(rationale), c.red_flags), "rationale has red flag '{}'"),
    ]
    return apply_rules(ready, rules).drop("__t", "__kind")


@dataclass(frozen=True)
class ParaphraseCues:
    openers: tuple = lx.OPENERS
    hedges: tuple = lx.PARAPHRASE_HEDGES
    authority: tuple = lx.PARAPHRASE_AUTHORITY
    authority_starts: tuple = lx.PARAPHRASE_AUTHORITY_STARTS
    conjunctions: tuple = lx.PARAPHRASE_CONJUNCTIONS
    red_flags: tuple = lx.PARAPHRASE_RED_FLAGS
    self_check_min: int = 15


def validate_paraphrase(df: DataFrame, a: str = "a_side_rewritten", b: str = "b_side_rewritten",
                        a_check: str = "a_side_faithful", b_check: str = "b_side_faithful",
                        route: str = "original_incorrect_classification",
                        confidence: str = "generator_confidence_in_faithfulness",
                        originals: tuple | None = ("original_correct", "original_incorrect"),
                        c: ParaphraseCues = ParaphraseCues()) -> DataFrame:
    """Paraphrased pair; the B rule depends on how the original incorrect answer reads."""
    ready = _stripped(df, a=a, b=b, fa=a_check, fb=b_check)
    ta, tb, fa, fb = (F.col(f"__{n}") for n in ("a", "b", "fa", "fb"))
    way = F.col(route)
    cue = (cues.first_word_hit(tb, c.hedges).isNotNull() | cues.start_phrase(tb, c.authority_starts).isNotNull())
    rules = [
        ((ta == "") | (tb == ""), F.lit("a side is empty")),
        _hit(cues.opener(ta, c.openers), "A starts with opener '{}'"),
        ((way == "negation_led") & cues.opener(tb, c.openers).isNull(), F.lit("B starts with no required opener")),
        ((way == "positive_assertion") & ~cue, F.lit("B has neither hedge nor authority start")),
        (~way.isin("negation_led", "positive_assertion") | way.isNull(), F.lit("unknown classification")),
        _hit(cues.first_word_hit(ta, c.hedges), "A contains hedge '{}'"),
        *[_hit(found, reason) for side, t in (("A", ta), ("B", tb)) for found, reason in (
            (cues.joining_conjunction(t, c.conjunctions), f"{side} contains conjunction '{{}}'"),
            (cues.authority_after_break(t, c.authority), f"{side} has authority cue '{{}}' after a break"))],
        (F.length(fa) < c.self_check_min, F.lit("A self-check too short")),
        (F.length(fb) < c.self_check_min, F.lit("B self-check too short")),
        _hit(cues.first_substring(fa, c.red_flags), "A self-check has red flag '{}'"),
        _hit(cues.first_substring(fb, c.red_flags), "B self-check has red flag '{}'"),
        *_low_confidence(F.col(confidence)),
    ]
    warnings = []
    if originals:
        for side, t, original in zip("AB", (ta, tb), originals):
            drift = cues.length_drift(t, F.col(original))
            warnings.append((None, F.concat(F.lit(f"{side} length drift: "), drift.cast("string"))))
    return apply_rules(ready, rules, warnings).drop("__a", "__b", "__fa", "__fb")


def validate_single_statement(df: DataFrame, confidence: str = "generator_confidence_in_falsity",
                              rationale: str = "generator_rationale",
                              red_flags: tuple = lx.SINGLE_STATEMENT_RED_FLAGS) -> DataFrame:
    value = F.coalesce(F.col(confidence).cast("string"), F.lit("0.0"))
    return apply_rules(df, [*_low_confidence(value),
                            _hit(cues.first_substring(F.col(rationale), red_flags), "rationale admits '{}'")])


# --- inverted-cue profiles ------------------------------------------------------------
def inverted_a_failures() -> Column:
    """All failures of the cue-free side (columns of inverted_cue_counts)."""
    n = F.col("word_count")
    parts = [F.when(~n.between(5, 15), F.concat(F.lit("word_count="), n.cast("string"))),
             F.when(F.col("neg_lead") == 1, F.lit("neg_lead"))]
    parts += [F.when(F.col(x) > 0, F.concat(F.lit(f"{x}="), F.col(x).cast("string")))
              for x in ("neg_cnt", "hedge_cnt", "auth_cnt", "contrast_cnt")]
    parts.append(F.when(~F.col("sent_count").between(1, 3),
                        F.concat(F.lit("sent_count="), F.col("sent_count").cast("string"))))
    return F.array_compact(F.array(*parts))


def inverted_b_failures() -> Column:
    """All failures of the cue-rich side."""
    n = F.col("word_count")
    none = (F.col("neg_cnt") == 0) & (F.col("hedge_cnt") == 0) & (F.col("neg_lead") == 0)
    return F.array_compact(F.array(
        F.when(~n.between(18, 29), F.concat(F.lit("word_count="), n.cast("string"))),
        F.when(none, F.lit("no cue present"))))


def length_delta_pairs(a: DataFrame, b: DataFrame, key: str, minimum: int = 8) -> DataFrame:
    """(key, wc_a, wc_b, delta, delta_ok, usable) of two checked sides (columns failures, word_count)."""
    left = a.select(key, F.col("word_count").alias("wc_a"), (F.size("failures") == 0).alias("a_ok"))
    right = b.select(key, F.col("word_count").alias("wc_b"), (F.size("failures") == 0).alias("b_ok"))
    out = left.join(right, key).withColumn("delta", F.col("wc_b") - F.col("wc_a"))
    out = out.withColumn("delta_ok", F.col("delta") >= minimum)
    return out.withColumn("usable", F.col("a_ok") & F.col("delta_ok"))


def length_delta_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("a_ok")).alias("a_fails"),
                     F.count_if(~F.col("b_ok")).alias("b_fails"), F.count_if(~F.col("delta_ok")).alias("delta_fails"),
                     F.count_if("usable").alias("usable_n"))


# --- judge verdicts -------------------------------------------------------------------
def judge_precondition(df: DataFrame, a_true: str, b_false: str, b_flag: str) -> DataFrame:
    bad_a = ~F.coalesce(F.col(a_true), F.lit(False))
    bad_b = ~F.coalesce(F.col(b_false), F.lit(False)) | F.coalesce(F.col(b_flag), F.lit(False))
    return df.withColumn("issue", F.when(bad_a, "A not judged true").when(bad_b, "B not judged false or flagged"))


def disagreement_flag(generator: Column, judged_false: Column, judge: Column) -> Column:
    return (generator > 0.9) & ~judged_false & (judge < 0.6)


def pair_passes(a_correct: Column, b_correct: Column) -> Column:
    return a_correct & ~b_correct


def pair_faithful(a_same: Column, b_same: Column) -> Column:
    return a_same & b_same
