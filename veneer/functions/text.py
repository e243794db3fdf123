"""Surface-form features as JVM-side column expressions (no Python UDF).

Word boundaries are written as explicit look-arounds over letters, digits and the
underscore, so results do not depend on the JDK's reading of ``\\b``. Every regular
expression over a whole text is guarded by a plain substring test: most cue words are
absent from most texts, and the substring scan is far cheaper than the regex engine.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions.lexicons import ClaimLexicon, PairLexicon

WORD = r"[\p{L}\p{N}_]"
# single Latin-1 characters are one table lookup per character in the regex engine
NARROW_SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0"
SPACE = NARROW_SPACE + r"\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
# ASCII letters and digits with at most one inner apostrophe part; possessive, as no match needs backtracking
TOKEN = r"\p{Alnum}++(?:'\p{Alnum}++)?+"

PAIR_FEATURES = (
    "neg_lead", "neg_cnt", "hedge_rate", "auth_rate", "len_gap", "word_count",
    "sent_count", "avg_token_len", "type_token", "punc_rate",
)
PAIR_FEATURES_WIDE = PAIR_FEATURES + ("temporal_fragile", "hedge_pair_diff", "auth_pair_diff")
CLAIM_FEATURES = (
    "neg_lead", "neg_cnt", "neg_bigram_refutes", "neg_bigram_supports", "hedge_rate",
    "word_count", "char_count", "avg_word_len", "type_token_ratio", "has_number",
    "specificity_score", "superlative", "generalization_proxy", "auth_rate",
    "question_neg",
)
CLAIM_FEATURES_NO_QUESTION = tuple(c for c in CLAIM_FEATURES if c != "question_neg")


def quote(term: str) -> str:
    """Escape a plain term for use inside a Java regular expression."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def whole_word(term: str, before: str = WORD) -> str:
    """Pattern of a plain term as a whole word.

    The literal comes first and the look-behind spans it, so the engine only looks around
    where the literal already matched.
    """
    t = quote(term)
    return f"{t}(?<!{before}{t})(?!{WORD})"


def bounded(pattern: str) -> str:
    return f"(?<!{WORD})(?:{pattern})(?!{WORD})"


def any_of(terms, escape: bool = True) -> str:
    return "|".join(quote(t) if escape else t for t in terms)


def text_or_blank(col) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(text: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _literal_core(pattern: str) -> str:
    """Longest run of plain characters a match of ``pattern`` must contain."""
    cleaned = re.sub(r"\[[^\]]*\][?*+]?|.[?*]", "\0", pattern)
    return max(re.split(r"[\0\\.^$|?*+()\[\]{}]", cleaned), key=len)


def _guarded_count(lowered: Column, core: str, pattern: str) -> Column:
    found = F.regexp_count(lowered, F.lit(pattern))
    return F.when(F.contains(lowered, F.lit(core)), found).otherwise(F.lit(0)) if core else found


def count_words(lowered: Column, terms) -> Column:
    """Sum over terms of whole-word occurrences; overlapping terms count separately."""
    return reduce(add, [_guarded_count(lowered, t, whole_word(t)) for t in terms], F.lit(0))


def count_patterns(lowered: Column, patterns) -> Column:
    """Sum over raw patterns of their matches (no word boundary)."""
    return reduce(add, [_guarded_count(lowered, _literal_core(p), p) for p in patterns], F.lit(0))


def count_phrases(lowered: Column, phrases) -> Column:
    """Non-overlapping substring occurrences, summed over phrases."""
    n = F.length(lowered)
    parts = [((n - F.length(F.replace(lowered, F.lit(p), F.lit("")))) / F.lit(len(p))).cast("int")
             for p in phrases]
    return reduce(add, parts, F.lit(0))


def has_word(lowered: Column, term: str, before: str = WORD) -> Column:
    return F.contains(lowered, F.lit(term)) & F.rlike(lowered, F.lit(whole_word(term, before)))


def has_any_word(lowered: Column, terms) -> Column:
    return reduce(or_, [has_word(lowered, t) for t in terms]).cast("int")


def leads_with(stripped_lower: Column, terms) -> Column:
    """1 when the text starts with one of the phrases, ending on a word boundary."""
    return F.rlike(stripped_lower, F.lit(f"^(?:{any_of(terms)})(?!{WORD})")).cast("int")


def leads_with_word(stripped_lower: Column, terms) -> Column:
    """1 when the text equals a term or starts with the term and one blank."""
    return F.rlike(stripped_lower, F.lit(f"^(?:{any_of(terms)})(?: |\\z)")).cast("int")


def whitespace_words(text: Column) -> Column:
    """Runs without white space; only texts with characters from U+1680 on need the wide class."""
    wide = (F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit(r"[\u1680-\u3000]"))
    return F.when(wide, F.regexp_count(text, F.lit(f"[^{SPACE}]++"))).otherwise(
        F.regexp_count(text, F.lit(f"[^{NARROW_SPACE}]++")))


def dashed_words(text: Column) -> Column:
    """Words that may hold apostrophes and dashes."""
    return F.regexp_count(text, F.lit(rf"(?<!{WORD}){WORD}(?:[\p{{L}}\p{{N}}_\-']*{WORD})?(?!{WORD})"))


def sentence_count(text: Column) -> Column:
    """Segments between runs of ``. ! ?`` that hold something but white space; at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(f"[^.!?{SPACE}][^.!?]*+")))


def mean_token_length(token_array: Column) -> Column:
    n = F.size(token_array)
    return F.when(n > 0, F.length(F.array_join(token_array, "")) / n).otherwise(F.lit(0.0))


def type_token(token_array: Column) -> Column:
    return F.size(F.array_distinct(token_array)) / F.greatest(F.lit(1), F.size(token_array))


def punctuation_count(text: Column, marks: str) -> Column:
    return count_phrases(text, tuple(marks))


def rate(count: Column, total: Column) -> Column:
    return count / F.greatest(F.lit(1), total)


def relative_length_gap(a: Column, b: Column) -> Column:
    """|a - b| / max(a, b, 1) over two lengths."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def temporal_fragile(lowered_texts, terms) -> Column:
    return F.greatest(*[has_any_word(t, terms) for t in lowered_texts])


def question_negation(text: Column, contractions) -> Column:
    """A contraction anywhere after the first word; typographic apostrophes count."""
    plain = F.translate(strip(F.lower(text)), "’‘ʼ", "'''")
    tail = F.regexp_extract(plain, f"(?s)^[^{SPACE}]+[{SPACE}]+(.+)\\z", 1)
    return F.rlike(tail, F.lit(f"(?<![a-z0-9])(?:{any_of(contractions)})(?![a-z0-9])")).cast("int")


def normalized_text(text: Column, rewrite=(" in the california", " in california")) -> Column:
    """Key for matching texts across releases: trimmed, lower, single blanks, no final dots."""
    squeezed = F.regexp_replace(strip(F.lower(text)), f"[{SPACE}]+", " ")
    return F.regexp_replace(F.replace(squeezed, F.lit(rewrite[0]), F.lit(rewrite[1])), "\\.+\\z", "")


# --- feature sets ---------------------------------------------------------------------
_TEXT, _LOWER, _STRIPPED, _TOKENS = "__text", "__lower", "__stripped", "__tokens"


def _with_parts(df: DataFrame, text: str) -> DataFrame:
    """Shared intermediates as columns, so no feature lower-cases or tokenises again."""
    return (df.withColumn(_TEXT, text_or_blank(text))
              .withColumn(_LOWER, F.lower(_TEXT))
              .withColumn(_STRIPPED, strip(F.col(_LOWER)))
              .withColumn(_TOKENS, F.regexp_extract_all(F.col(_LOWER), F.lit(TOKEN), F.lit(0))))


def pair_features(df: DataFrame, text: str, profile: str = "surface10_text",
                  lexicon: PairLexicon | None = None, keep_length: bool = False) -> DataFrame:
    """Append the nine per-text features of the answer-pair profile (len_gap is pair-level).

    ``surface10_text`` counts words by white space and punctuation per character;
    ``surface10_audit`` counts tokens and takes punctuation per token.
    """
    if profile not in ("surface10_text", "surface10_audit"):
        raise ValueError(f"unknown profile {profile!r}")
    lex = lexicon or PairLexicon()
    by_text = profile == "surface10_text"
    txt, low, toks = F.col(_TEXT), F.col(_LOWER), F.col(_TOKENS)
    words = whitespace_words(txt) if by_text else F.size(toks)
    base = _with_parts(df, text).withColumn("word_count", words.cast("double"))
    span = F.length(txt) if by_text else F.size(toks)
    out = base.select(
        *[F.col(f"`{c}`") for c in df.columns],
        leads_with(F.col(_STRIPPED), lex.leads).cast("double").alias("neg_lead"),
        count_words(low, lex.negations).cast("double").alias("neg_cnt"),
        rate(count_words(low, lex.hedges), F.col("word_count")).alias("hedge_rate"),
        rate(count_patterns(low, lex.authority), F.col("word_count")).alias("auth_rate"),
        F.col("word_count"),
        sentence_count(txt).cast("double").alias("sent_count"),
        mean_token_length(toks).alias("avg_token_len"),
        type_token(toks).alias("type_token"),
        rate(punctuation_count(txt, lex.punctuation), span).alias("punc_rate"),
        F.length(txt).alias("n_chars_text"),
    )
    return out if keep_length else out.drop("n_chars_text")


def negation_variants(df: DataFrame, text: str, variants: dict[str, PairLexicon]) -> DataFrame:
    """One row per (row, variant) with the negation features recomputed under that lexicon."""
    base = _with_parts(df, text)
    entry = [F.struct(F.lit(name).alias("variant"),
                      leads_with(F.col(_STRIPPED), lex.leads).cast("double").alias("neg_lead"),
                      count_words(F.col(_LOWER), lex.negations).cast("double").alias("neg_cnt"))
             for name, lex in variants.items()]
    return (base.select(*df.columns, F.explode(F.array(*entry)).alias("v"))
                .select(*df.columns, "v.variant", "v.neg_lead", "v.neg_cnt"))


def claim_features(df: DataFrame, text: str, lexicon: ClaimLexicon | None = None,
                   question: bool = True) -> DataFrame:
    """Append the labelled-claim features (15, or 14 without the question feature)."""
    lex = lexicon or ClaimLexicon()
    txt, low, toks = F.col(_TEXT), F.col(_LOWER), F.col(_TOKENS)
    n = F.size(toks)
    long_tokens = F.size(F.filter(toks, lambda t: F.length(t) > 6))
    feats = {
        "neg_lead": leads_with_word(F.col(_STRIPPED), lex.leads),
        "neg_cnt": count_words(low, lex.negations),
        "neg_bigram_refutes": count_phrases(low, lex.refutes),
        "neg_bigram_supports": count_phrases(low, lex.supports),
        "hedge_rate": rate(count_words(low, lex.hedges), n),
        "word_count": n,
        "char_count": F.length(txt),
        "avg_word_len": mean_token_length(toks),
        "type_token_ratio": type_token(toks),
        "has_number": F.rlike(txt, F.lit(r"\p{Nd}")).cast("int"),
        "specificity_score": rate(long_tokens, n),
        "superlative": has_any_word(low, lex.superlatives),
        "generalization_proxy": has_any_word(low, lex.generalizations),
        "auth_rate": rate(count_patterns(low, lex.authority), n),
        "question_neg": question_negation(txt, lex.contractions),
    }
    names = CLAIM_FEATURES if question else CLAIM_FEATURES_NO_QUESTION
    return _with_parts(df, text).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[feats[name].cast("double").alias(name) for name in names])


def inverted_cue_counts(df: DataFrame, text: str, negations, hedges, authority, contrasts,
                        leads) -> DataFrame:
    """Cue counts used by the inverted-cue checks."""
    base = _with_parts(df, text)
    low = F.col(_LOWER)
    return base.select(
        *[F.col(f"`{c}`") for c in df.columns],
        whitespace_words(F.col(_TEXT)).alias("word_count"),
        leads_with(F.col(_STRIPPED), leads).alias("neg_lead"),
        count_words(low, negations).alias("neg_cnt"),
        count_words(low, hedges).alias("hedge_cnt"),
        count_patterns(low, authority).alias("auth_cnt"),
        count_words(low, contrasts).alias("contrast_cnt"),
        sentence_count(F.col(_TEXT)).alias("sent_count"))
