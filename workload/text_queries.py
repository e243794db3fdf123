"""Text features and what is measured from them directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.functions import text as tx
from veneer.functions.lexicons import INVERTED_AUTHORITY, sensitivity_variants
from veneer.operators import impact, metrics, reshape
from workload.common import (CLAIM_CUES, FEATURES, PAIR_CUES, TOKENS_SQL, answers, audit_table, documents, pairs, q, r6,
                             rounded, sql_answers, sql_audit, sql_doc_features, sql_has, sql_patterns, sql_plain,
                             sql_violation, sql_words, table)

QUERIES, ORACLES = {}, {}
NUMERIC = [f for f in FEATURES if f != "len_gap"]


def _features(profile):
    def run(spark, sf):
        df = tx.pair_features(documents(spark, sf), "text", profile, PAIR_CUES)
        return rounded(df.select("doc_id", *NUMERIC), NUMERIC)
    sql = f"WITH {sql_doc_features(profile)} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in NUMERIC)} FROM f"
    return run, sql


for _p in ("surface10_text", "surface10_audit"):
    QUERIES[f"features_{_p}"], ORACLES[f"features_{_p}"] = _features(_p)


def _tokens(spark, sf):
    t = tx.text_or_blank("text")
    toks = tx.tokens(t)
    return table(spark, sf, "documents").select(
        "doc_id", F.size(toks).alias("n_tokens"), tx.whitespace_words(t).alias("n_words"),
        tx.dashed_words(t).alias("n_dashed"), F.length(t).alias("n_characters"),
        tx.sentence_count(t).alias("n_sentences"))


QUERIES["token_and_word_counts"] = _tokens
ORACLES["token_and_word_counts"] = rf"""
SELECT doc_id, len({TOKENS_SQL}) AS n_tokens, len(regexp_extract_all(text, '[^\s]+')) AS n_words,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''\-]*[\p{{L}}\p{{N}}_])?')) AS n_dashed,
  length(text) AS n_characters, greatest(1, len(regexp_extract_all(text, '[^.!?\s][^.!?]*'))) AS n_sentences
FROM documents"""


def _claims(question):
    names = tx.CLAIM_FEATURES if question else tx.CLAIM_FEATURES_NO_QUESTION

    def run(spark, sf):
        df = tx.claim_features(documents(spark, sf), "text", CLAIM_CUES, question)
        return rounded(df.select("doc_id", *names), names)
    lex = CLAIM_CUES
    lead = "^(?:" + "|".join(lex.leads) + ")(?: |$)"
    phrase = lambda ps: " + ".join(f"(length(l) - length(replace(l, {q(p)}, ''))) // {len(p)}" for p in ps)
    cols = {
        "neg_lead": rf"regexp_matches(regexp_replace(lo, '^\s+|\s+$', '', 'g'), {q(lead)})::INT",
        "neg_cnt": sql_words("lo", lex.negations), "neg_bigram_refutes": phrase(lex.refutes),
        "neg_bigram_supports": phrase(lex.supports),
        "hedge_rate": f"{sql_words('lo', lex.hedges)} / greatest(1, n)::DOUBLE", "word_count": "n",
        "char_count": "length(l)",
        "avg_word_len": "CASE WHEN n > 0 THEN length(array_to_string(tok, '')) / n::DOUBLE ELSE 0 END",
        "type_token_ratio": "len(list_distinct(tok)) / greatest(1, n)::DOUBLE",
        "has_number": r"regexp_matches(l, '\d')::INT",
        "specificity_score": "len(list_filter(tok, lambda x: length(x) > 6)) / greatest(1, n)::DOUBLE",
        "superlative": sql_has("lo", lex.superlatives), "generalization_proxy": sql_has("lo", lex.generalizations),
        "auth_rate": f"{sql_patterns('lo', lex.authority)} / greatest(1, n)::DOUBLE",
        "question_neg": r"regexp_matches(regexp_extract(trim(l), '(?s)^\S+\s+(.+)$', 1), "
                        + q("(?:^|[^a-z0-9])(?:" + "|".join(lex.contractions) + ")(?:[^a-z0-9]|$)") + ")::INT"}
    sql = (f"WITH d AS (SELECT doc_id, lower(text) AS l, {sql_plain('text')} AS lo, {TOKENS_SQL} AS tok FROM documents), "
           f"e AS (SELECT *, len(tok) AS n FROM d) SELECT doc_id, "
           + ", ".join(f"round(({cols[c]})::DOUBLE, 6) AS {c}" for c in names) + " FROM e")
    return run, sql


QUERIES["features_claims_15"], ORACLES["features_claims_15"] = _claims(True)
QUERIES["features_claims_14"], ORACLES["features_claims_14"] = _claims(False)


def _wide(spark, sf):
    """Both texts in one row: features, length gap and fragility without a further shuffle."""
    w = reshape.wide_audit(pairs(spark, sf), "true_text", "false_text", "question", "surface10_text", PAIR_CUES)
    w = w.withColumn("style_violation", reshape.style_violation())
    keep = ["neg_lead_true", "neg_lead_false", "neg_cnt_true", "neg_cnt_false", "hedge_rate_true", "auth_rate_false",
            "word_count_true", "punc_rate_false", "len_gap"]
    return rounded(w.select("pair_id", "category", "temporal_fragile", "style_violation", *keep), keep)


QUERIES["wide_audit_table"] = _wide
ORACLES["wide_audit_table"] = f"""WITH {sql_audit()},
t AS (SELECT doc_id // 2 AS pair_id, max({sql_has(sql_plain('text'), PAIR_CUES.temporal)}) AS by_text FROM documents GROUP BY 1),
s AS (SELECT doc_id // 2 AS pair_id, {sql_has('lower(source)', PAIR_CUES.temporal)} AS by_question FROM documents WHERE doc_id % 2 = 0)
SELECT pair_id, category, greatest(by_text, by_question) AS temporal_fragile, {sql_violation()} AS style_violation,
  neg_lead_true, neg_lead_false, neg_cnt_true, neg_cnt_false, round(hedge_rate_true, 6) AS hedge_rate_true,
  round(auth_rate_false, 6) AS auth_rate_false, word_count_true, round(punc_rate_false, 6) AS punc_rate_false,
  round(len_gap, 6) AS len_gap
FROM w JOIN t USING (pair_id) JOIN s USING (pair_id)"""


def _variants(spark, sf):
    df = tx.negation_variants(documents(spark, sf), "text", sensitivity_variants(PAIR_CUES))
    return df.select("doc_id", "variant", "neg_lead", "neg_cnt")


_V = sensitivity_variants(PAIR_CUES)
QUERIES["lexicon_variants"] = _variants
ORACLES["lexicon_variants"] = f"WITH {sql_doc_features()} " + " UNION ALL ".join(
    rf"""SELECT doc_id, '{name}' AS variant,
    regexp_matches(regexp_replace(lo, '^\s+', ''), {q('^(?:' + '|'.join(lex.leads) + ')' + chr(92) + 'b')})::INT::DOUBLE AS neg_lead,
    {sql_words('lo', lex.negations)}::DOUBLE AS neg_cnt FROM d""" for name, lex in _V.items())


def _inverted(spark, sf):
    return tx.inverted_cue_counts(documents(spark, sf), "text", PAIR_CUES.negations, PAIR_CUES.hedges,
                                  INVERTED_AUTHORITY + PAIR_CUES.authority, ("but", "los", "und"), PAIR_CUES.leads
                                  ).select("doc_id", "word_count", "neg_lead", "neg_cnt", "hedge_cnt", "auth_cnt",
                                           "contrast_cnt", "sent_count")


QUERIES["inverted_cue_counts"] = _inverted
ORACLES["inverted_cue_counts"] = rf"""WITH {sql_doc_features()}
SELECT doc_id, wc AS word_count,
  regexp_matches(regexp_replace(lo, '^\s+', ''), {q('^(?:' + '|'.join(PAIR_CUES.leads) + ')' + chr(92) + 'b')})::INT AS neg_lead,
  {sql_words('lo', PAIR_CUES.negations)} AS neg_cnt, {sql_words('lo', PAIR_CUES.hedges)} AS hedge_cnt,
  {sql_patterns('lo', INVERTED_AUTHORITY + PAIR_CUES.authority)} AS auth_cnt,
  {sql_words('lo', ('but', 'los', 'und'))} AS contrast_cnt,
  greatest(1, len(regexp_extract_all(t, '[^.!?\s][^.!?]*'))) AS sent_count FROM f0"""


def _normalized(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.normalized_text(F.col("text")).alias("key"))


QUERIES["normalized_text_keys"] = _normalized
ORACLES["normalized_text_keys"] = r"""
SELECT conv_id, turn, regexp_replace(replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'),
  ' in the california', ' in california'), '\.+$', '') AS key FROM conversations"""


# --- measured from features -----------------------------------------------------------
def _class_means(spark, sf):
    return rounded(metrics.class_means(answers(spark, sf), FEATURES), ["mean_true", "mean_false"])


QUERIES["class_means"] = _class_means
_long = " UNION ALL ".join(f"SELECT pair_id, label, '{f}' AS feature, {f} AS value FROM a" for f in FEATURES)
ORACLES["class_means"] = f"""WITH {sql_answers()}, l AS ({_long})
SELECT feature, round(avg(value) FILTER (label = 1), 6) AS mean_true, round(avg(value) FILTER (label = 0), 6) AS mean_false
FROM l GROUP BY 1"""


def _describe(spark, sf):
    d = metrics.describe_features(answers(spark, sf), FEATURES, with_p=False)
    return rounded(d, ["mean_true", "mean_false", "cohens_d", "welch_t", "welch_df"], 5)


QUERIES["feature_effect_sizes"] = _describe
ORACLES["feature_effect_sizes"] = f"""WITH {sql_answers()}, l AS ({_long}),
g AS (SELECT feature, avg(value) FILTER (label = 1) AS m1, avg(value) FILTER (label = 0) AS m0,
  var_samp(value) FILTER (label = 1) AS v1, var_samp(value) FILTER (label = 0) AS v0,
  count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM l GROUP BY 1)
SELECT feature, round(m1, 5) AS mean_true, round(m0, 5) AS mean_false,
  round((m1 - m0) / (sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) + 1e-10), 5) AS cohens_d,
  CASE WHEN v1 / n1 + v0 / n0 > 0 THEN round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) END AS welch_t,
  CASE WHEN v1 / n1 + v0 / n0 > 0 THEN round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 5) END AS welch_df
FROM g"""


def _describe_p(spark, sf):
    d = metrics.describe_features(answers(spark, sf), FEATURES)
    return rounded(d.select("feature", "welch_t", "p_value", "significant"), ["welch_t", "p_value"])


QUERIES["feature_welch_p_values"] = _describe_p


def _sensitivity(spark, sf):
    return rounded(impact.threshold_sensitivity(audit_table(spark, sf)), ["pct_confounded"])


QUERIES["threshold_sensitivity"] = _sensitivity
ORACLES["threshold_sensitivity"] = f"WITH {sql_audit()} " + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, round(100.0 * avg({sql_violation(a, b, c)}), 6) AS pct_confounded, count(*) AS n_pairs FROM w"
    for n, a, b, c in impact.THRESHOLD_VARIANTS)


def _violation(spark, sf):
    return audit_table(spark, sf).select("pair_id", reshape.style_violation().alias("style_violation"))


QUERIES["style_violation"] = _violation
ORACLES["style_violation"] = f"WITH {sql_audit()} SELECT pair_id, {sql_violation()} AS style_violation FROM w"


def _confound(question_form):
    def run(spark, sf):
        f = tx.claim_features(documents(spark, sf), "text", CLAIM_CUES)
        return impact.heuristic_confound(f, question_form).select("doc_id", "confounded")
    inner = ORACLES["features_claims_15"]
    cue = "neg_lead = 1 OR neg_cnt >= 2 OR neg_bigram_refutes >= 1"
    tail = ("question_neg >= 1" if question_form else
            "word_count <= (SELECT quantile_cont(word_count, 0.2) FROM z) OR word_count >= (SELECT quantile_cont(word_count, 0.8) FROM z)")
    return run, f"WITH z AS ({inner}) SELECT doc_id, ({cue} OR {tail})::INT AS confounded FROM z"


QUERIES["heuristic_confound_claims"], ORACLES["heuristic_confound_claims"] = _confound(False)
QUERIES["heuristic_confound_questions"], ORACLES["heuristic_confound_questions"] = _confound(True)


def _coverage(spark, sf):
    return rounded(impact.coverage_by_label(answers(spark, sf), "neg_cnt"), ["share_with_cue", "mean_value"])


QUERIES["cue_coverage_by_label"] = _coverage
ORACLES["cue_coverage_by_label"] = f"""WITH {sql_answers()}
SELECT label, count(*) AS n_rows, count(*) FILTER (neg_cnt > 0) AS n_with_cue,
  round(avg((neg_cnt > 0)::INT), 6) AS share_with_cue, round(avg(neg_cnt), 6) AS mean_value FROM a GROUP BY 1"""


def _relative_gap(spark, sf):
    return answers(spark, sf).filter("label = 1").select("pair_id", r6("len_gap").alias("len_gap"))


QUERIES["relative_length_gap"] = _relative_gap
ORACLES["relative_length_gap"] = f"WITH {sql_answers()} SELECT pair_id, round(len_gap, 6) AS len_gap FROM a WHERE label = 1"
