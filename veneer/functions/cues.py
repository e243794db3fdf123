"""Cue detectors over probe texts: openers, tokens, phrases, strategies, subjects.

Each returns a column. "first" detectors give the first phrase of the list that is
present (list order), or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veneer.functions import lexicons as lx
from veneer.functions.text import (SPACE, SPACE_CHARS, WORD, any_of, bounded, dashed_words, has_word, quote,
                                   strip, text_or_blank)

LENGTH_DRIFT_PAD, LENGTH_DRIFT_RATIO = 15, 1.5


def _lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


def _first(terms, condition) -> Column:
    """First term (in list order) whose condition holds."""
    return F.coalesce(*[F.when(condition(t), F.lit(t)) for t in terms])


def opener(text: Column, openers=lx.OPENERS) -> Column:
    """First opener the text starts with; the next character may be no letter or apostrophe."""
    head = _lstrip(text_or_blank(text))
    return _first(openers, lambda t: F.rlike(head, F.lit(f"(?i)\\A{quote(t)}(?![\\p{{L}}'])")))


def start_phrase(text: Column, phrases) -> Column:
    """First phrase the text starts with; the next character may be no letter."""
    head = F.lower(_lstrip(text_or_blank(text)))
    return _first(phrases, lambda t: F.rlike(head, F.lit(f"\\A{quote(t.lower())}(?!\\p{{L}})")))


def unwrapped_start(text: Column, phrases) -> Column:
    """First phrase the text starts with after leading quotes and brackets are dropped."""
    bare = F.lower(F.ltrim(text_or_blank(text), F.lit(SPACE_CHARS + "\"'`([{")))
    return _first(phrases, lambda t: F.startswith(bare, F.lit(t.lower())))


def longest_opener(text: Column, openers=lx.OPENERS) -> Column:
    """Opener (with its blank) after leading quotes, longest first."""
    bare = F.lower(_lstrip(F.ltrim(F.ltrim(text_or_blank(text), F.lit('"')), F.lit("'"))))
    ordered = sorted((o + " " for o in openers), key=len, reverse=True)
    return _first(ordered, lambda t: F.startswith(bare, F.lit(t.lower())))


def first_word_hit(text: Column, terms) -> Column:
    """First whole word present, ignoring case."""
    low = F.lower(text_or_blank(text))
    return _first(terms, lambda t: has_word(low, t.lower()))


def first_token_hit(text: Column, terms) -> Column:
    """As first_word_hit, but an apostrophe before the token also blocks it."""
    low = F.lower(text_or_blank(text))
    return _first(terms, lambda t: has_word(low, t.lower(), "[\\p{L}\\p{N}_']"))


def first_substring(text: Column, phrases) -> Column:
    low = F.lower(text_or_blank(text))
    return _first(phrases, lambda t: F.contains(low, F.lit(t.lower())))


def distinct_word_hits(text: Column, terms) -> Column:
    """ARRAY of the listed words that occur at least once, in list order."""
    low = F.lower(text_or_blank(text))
    return F.array_compact(F.array(*[
        F.when(has_word(low, t), F.lit(t)) for t in terms]))


def substring_hits(text: Column, phrases) -> Column:
    low = F.lower(text_or_blank(text))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def joining_conjunction(text: Column, words=lx.PARAPHRASE_CONJUNCTIONS) -> Column:
    """First conjunction used as a clause joiner: between blanks, with or without , or ; before."""
    padded = F.concat(F.lit(" "), F.lower(text_or_blank(text)), F.lit(" "))
    return _first(words, lambda w: F.contains(padded, F.lit(f" {w} ")))


def authority_after_break(text: Column, phrases=lx.PARAPHRASE_AUTHORITY) -> Column:
    """First authority phrase that opens the text right after , ; : dashes or brackets."""
    tails = F.slice(F.split(F.lower(strip(text_or_blank(text))), "[,;:—–()]"), 2, 1 << 30)
    trimmed = F.transform(tails, strip)
    per_tail = F.transform(trimmed, lambda s: F.coalesce(
        *[F.when(F.startswith(s, F.lit(p)), F.lit(p)) for p in phrases]))
    return F.try_element_at(F.array_compact(per_tail), F.lit(1))


def surface_strategy(text: Column, openers=lx.OPENERS, hedges=lx.PARAPHRASE_HEDGES,
                     authority=lx.PARAPHRASE_AUTHORITY_STARTS) -> Column:
    neg = opener(text, openers).isNotNull()
    hedge = first_word_hit(text, hedges).isNotNull()
    auth = start_phrase(text, authority).isNotNull()
    return (F.when(neg & hedge, "negation_and_hedging").when(neg, "negation_opener")
             .when(hedge, "hedging").when(auth, "authority").otherwise("none"))


def incorrect_class(text: Column, prefixes=lx.DENIAL_PREFIXES,
                    contractions=lx.DENIAL_CONTRACTIONS) -> Column:
    """negation_led when the text opens with a denial or holds a denial contraction."""
    low = F.lower(strip(text_or_blank(text)))
    led = F.rlike(low, F.lit(f"\\A(?:{any_of(prefixes)})"))
    denies = F.rlike(low, F.lit(bounded(any_of(contractions, escape=False))))
    return F.when(led | denies, "negation_led").otherwise("positive_assertion")


def observed_cues(text: Column, openers=lx.OPENERS, hedges=lx.SINGLE_CUE_HEDGES,
                  authority=lx.SINGLE_CUE_AUTHORITY_STARTS) -> Column:
    return F.array_compact(F.array(
        F.when(unwrapped_start(text, openers).isNotNull(), F.lit("negation_opener")),
        F.when(first_word_hit(text, hedges).isNotNull(), F.lit("hedging")),
        F.when(unwrapped_start(text, authority).isNotNull(), F.lit("authority"))))


def length_drift(rewritten: Column, original: Column) -> Column:
    """Words gained or lost when beyond the allowance, else NULL."""
    new, old = dashed_words(text_or_blank(rewritten)), dashed_words(text_or_blank(original))
    limit = F.greatest(F.lit(LENGTH_DRIFT_PAD), F.floor(F.lit(LENGTH_DRIFT_RATIO) * old))
    return F.when(F.abs(new - old) > limit, F.abs(new - old))


def subject_hint(text: Column, openers=lx.OPENERS, joiners=lx.SUBJECT_JOINERS,
                 stop_words=lx.SUBJECT_STOP_WORDS, max_tokens: int | None = 20) -> Column:
    """Longest capitalised run of two or more tokens, else the first three content words.

    The first ``max_tokens`` tokens are read, 20 by the published definition; None reads the whole text.
    """
    base = _lstrip(F.regexp_replace(strip(text_or_blank(text)), "\\A\"+", ""))
    ordered = sorted((o + " " for o in openers), key=len, reverse=True)
    body = F.regexp_replace(base, f"(?i)\\A(?:{any_of(ordered)})", "")
    body = F.regexp_replace(body, f"\\A[,;:{SPACE}]+", "")
    toks = F.regexp_extract_all(body, F.lit("[A-Za-z][A-Za-z'-]*"), F.lit(0))
    toks = toks if max_tokens is None else F.slice(toks, 1, max_tokens)
    run = (f"(?<![^ ])[A-Z][^ ]*(?: (?:[A-Z][^ ]*|(?:{any_of(joiners)})(?= [A-Z])))*")
    runs = F.regexp_extract_all(F.array_join(toks, " "), F.lit(run), F.lit(0))
    best = F.aggregate(runs, F.lit(""), lambda acc, r: F.when(
        F.size(F.split(r, " ")) > F.when(acc == "", 0).otherwise(F.size(F.split(acc, " "))), r
    ).otherwise(acc))
    content = F.filter(toks, lambda t: ~F.lower(t).isin(*stop_words))
    fallback = F.when(F.size(content) > 0, F.slice(content, 1, 3)).otherwise(F.slice(toks, 1, 3))
    return F.when(F.contains(best, F.lit(" ")), best).otherwise(F.array_join(fallback, " "))


def answer_letter(reply: Column) -> Column:
    """A or B from a completion: a letter standing alone first, else the first a or b, else NULL."""
    t = text_or_blank(reply)
    alone = F.regexp_extract(t, "(?<![A-Za-z])([ABab])(?![A-Za-z])", 1)
    any_ab = F.regexp_extract(t, "[ABab]", 0)
    letter = F.upper(F.when(alone != "", alone).otherwise(any_ab))
    return F.when(letter != "", letter)
