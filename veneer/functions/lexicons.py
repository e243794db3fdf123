"""Cue lexicons. They must equal the published audit's lists.

Terms are plain phrases; the matching kind (whole word, sentence lead, raw pattern,
substring) is decided by the expression that uses them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- fixed values: answer-pair audit --------------------------------------------------
PAIR_LEADS = (
    "no", "not", "there is no", "there are no", "there's no",
    "none", "never", "nothing", "nobody",
)
PAIR_NEGATIONS = (
    "no", "not", "never", "none", "nothing", "nobody", "cannot", "can't",
    "don't", "doesn't", "didn't", "won't", "wasn't", "weren't",
)
PAIR_HEDGES = (
    "might", "could", "may", "generally", "typically", "often", "usually",
    "sometimes", "likely", "probably", "possibly", "appears to", "seems",
    "suggests", "roughly", "approximately", "are expected to",
)
PAIR_AUTHORITY = (
    "according to", "experts say", "scientists say", "peer[- ]?reviewed", "study shows",
)
TEMPORAL_TERMS = (
    "current", "now", "today", "this year", "latest", "president", "gdp",
    "population", "law", "regulation", "since", "as of",
)
PUNCTUATION = "?!,"

# --- fixed values: lexicon sensitivity variants ---------------------------------------
SYNONYM_NEGATIONS = (
    "zero", "incapable", "unaffected", "fails", "fail", "lacks", "without",
    "unable", "impossible",
)
ADVERB_NEGATIONS = ("hardly", "scarcely", "barely", "rarely", "seldom")

# --- fixed values: labelled-claim audit -----------------------------------------------
CLAIM_LEADS = (
    "not", "never", "no", "nor", "isn't", "aren't", "wasn't", "won't", "can't",
    "couldn't", "wouldn't", "didn't", "doesn't", "don't", "haven't", "hasn't",
    "failed", "refused", "unable",
)
CLAIM_NEGATIONS = (
    "not", "never", "no", "nor", "didn't", "doesn't", "wasn't", "wasn",
    "won't", "can't", "cannot", "none",
)
CLAIM_REFUTE_PHRASES = (
    "did not", "does not", "was not", "yet to", "refused to", "failed to",
    "unable to", "not have", "never been",
)
CLAIM_SUPPORT_PHRASES = (
    "at least", "least one", "won award", "american actor", "starred in",
)
CLAIM_HEDGES = (
    "might", "may", "possibly", "allegedly", "reportedly", "supposedly",
    "perhaps", "probably",
)
CLAIM_AUTHORITY = (
    "according to", "as stated", "reported by", "experts say", "study shows",
)
CLAIM_SUPERLATIVES = (
    "most", "first", "best", "worst", "largest", "highest", "lowest", "greatest",
)
CLAIM_GENERALIZATIONS = (
    "some", "many", "often", "usually", "generally", "typically", "sometimes",
)
QUESTION_CONTRACTIONS = (
    "isn't", "aren't", "wasn't", "won't", "can't", "couldn't", "wouldn't",
    "didn't", "doesn't", "don't", "haven't", "hasn't",
)

# --- fixed values: inverted-cue probe -------------------------------------------------
INVERTED_LEADS = PAIR_LEADS + ("neither", "contrary to", "it is not the case that")
INVERTED_NEGATIONS = (
    "no", "not", "never", "none", "nothing", "nobody", "neither", "cannot",
    "can't", "don't", "doesn't", "didn't", "won't", "wasn't", "weren't",
)
INVERTED_HEDGES = (
    "might", "could", "may", "generally", "typically", "often", "usually",
    "sometimes", "likely", "probably", "possibly", "appears to", "seems",
    "suggests", "roughly", "approximately", "perhaps", "maybe", "reportedly",
    "allegedly",
)
INVERTED_AUTHORITY = (
    "according to", "experts say", "scientists say", "scientists have confirmed",
    "researchers say", "peer[- ]?reviewed", "study shows", "studies show",
    "research indicates", "historians note", "records show", "it is well known",
    "as reported by",
)
INVERTED_CONTRASTS = (
    "but", "however", "although", "though", "yet", "whereas", "while",
    "nevertheless", "nonetheless",
)

# --- fixed values: paired and single probes -------------------------------------------
OPENERS = (
    "Not", "Never", "No", "Contrary to", "It is not the case that",
    "There is no", "Nothing",
)
FRESH_NEGATIONS = (
    "no", "not", "never", "none", "nothing", "nobody", "cannot", "can't",
    "don't", "doesn't", "didn't", "won't", "wasn't", "weren't",
    "isn't", "aren't", "hasn't", "haven't", "hadn't", "wouldn't", "couldn't",
    "shouldn't",
    "can’t", "don’t", "doesn’t", "didn’t", "won’t",
    "wasn’t", "weren’t", "isn’t", "aren’t", "hasn’t",
    "haven’t", "hadn’t", "wouldn’t", "couldn’t", "shouldn’t",
    "zero", "incapable", "unaffected", "fails", "fail", "lacks", "lack",
    "without", "unable", "impossible",
)
FRESH_HEDGES = (
    "typically", "often", "usually", "sometimes", "can", "may", "might", "generally",
)
FRESH_AUTHORITY_STARTS = (
    "according to", "studies show", "experts say", "scientists say",
    "research shows", "researchers say", "records show", "in fact", "actually",
    "historians note", "it is well known", "as reported by", "study shows",
)
FRESH_CONTRASTS = (
    "yet", "but", "however", "although", "though", "while", "whereas", "nevertheless",
)
SINGLE_CUE_HEDGES = ("typically", "often", "usually", "sometimes", "generally")
SINGLE_CUE_BANNED_HEDGES = SINGLE_CUE_HEDGES + ("may", "might", "can")
SINGLE_CUE_AUTHORITY_STARTS = (
    "According to experts,", "Studies show that", "Research indicates that",
    "Scientists have confirmed that",
)
SINGLE_CUE_CONTRASTS = ("yet", "but", "however", "although")
SINGLE_CUE_RED_FLAGS = (
    "i am not sure", "i'm not sure", "uncertain", "unknown", "cannot verify",
    "can't verify", "as an ai", "made up", "fictional",
)
PLAIN_OPENERS = (
    "Not", "Never", "No", "Nothing", "Nobody", "None", "Neither", "Contrary to",
    "It is not the case that", "There is no", "There are no",
)
PLAIN_NEGATIONS = (
    "not", "no", "never", "nothing", "nobody", "none", "neither", "n't", "cannot",
)
PLAIN_HEDGES = (
    "typically", "often", "usually", "sometimes", "generally", "may", "might",
    "can", "could", "possibly", "reportedly", "allegedly", "perhaps", "likely",
    "maybe",
)
PLAIN_AUTHORITY_STARTS = (
    "According to experts", "Studies show", "Research indicates",
    "Scientists have confirmed", "As reported by", "It is well known",
    "Historians note", "Experts say", "Scientists say", "Researchers say",
    "Records show", "In fact", "Actually",
)
PLAIN_AUTHORITY = (
    "according to experts", "studies show", "research indicates",
    "scientists have confirmed", "as reported by", "it is well known",
    "historians note", "experts say", "scientists say", "researchers say",
    "records show",
)
PLAIN_CONTRASTS = (
    "yet", "but", "however", "although", "though", "while", "whereas",
    "nevertheless", "still", "rather",
)
PLAIN_TOPICS = (
    "Misconceptions", "Law", "Health", "Science", "Nutrition", "Finance",
    "History", "Paranormal", "Sociology", "Economics",
)
PLAIN_RED_FLAGS = SINGLE_CUE_RED_FLAGS + (
    "actually false", "is false", "statement is false", "this is false",
    "i cannot confirm",
)
PARAPHRASE_HEDGES = (
    "often", "typically", "generally", "sometimes", "usually", "may", "might", "can",
)
PARAPHRASE_CONJUNCTIONS = PLAIN_CONTRASTS
PARAPHRASE_AUTHORITY = (
    "according to", "studies show", "experts say", "scientists say",
    "research shows", "researchers say", "records show", "in fact", "actually",
    "historians note", "it is well known", "as reported by",
)
PARAPHRASE_AUTHORITY_STARTS = (
    "According to", "Experts say", "Scientists say", "Studies show", "Study shows",
)
PARAPHRASE_RED_FLAGS = (
    "actually wrong", "changed the claim", "different proposition", "not the same",
    "altered the meaning", "added a claim", "invented", "made up", "different fact",
)
DENIAL_PREFIXES = (
    "no ", "not ", "never ", "nothing ", "none ", "nobody ",
    "no,", "not,", "never,", "nothing,", "none,", "nobody,",
    "there is no", "there are no", "there's no",
    "contrary to", "it is not the case that",
)
DENIAL_CONTRACTIONS = (
    "isn['’]t", "wasn['’]t", "aren['’]t", "weren['’]t",
    "doesn['’]t", "don['’]t", "didn['’]t", "hasn['’]t",
    "haven['’]t", "hadn['’]t", "won['’]t", "wouldn['’]t",
    "couldn['’]t", "shouldn['’]t", "can['’]t", "cannot",
)


@dataclass(frozen=True)
class PairLexicon:
    """Word lists behind the answer-pair profile."""

    leads: tuple = PAIR_LEADS
    negations: tuple = PAIR_NEGATIONS
    hedges: tuple = PAIR_HEDGES
    authority: tuple = PAIR_AUTHORITY
    temporal: tuple = TEMPORAL_TERMS
    punctuation: str = PUNCTUATION

    def widened(self, extra: tuple) -> "PairLexicon":
        return replace(self, leads=self.leads + extra, negations=self.negations + extra)


@dataclass(frozen=True)
class ClaimLexicon:
    """Word lists behind the labelled-claim profile."""

    leads: tuple = CLAIM_LEADS
    negations: tuple = CLAIM_NEGATIONS
    refutes: tuple = CLAIM_REFUTE_PHRASES
    supports: tuple = CLAIM_SUPPORT_PHRASES
    hedges: tuple = CLAIM_HEDGES
    authority: tuple = CLAIM_AUTHORITY
    superlatives: tuple = CLAIM_SUPERLATIVES
    generalizations: tuple = CLAIM_GENERALIZATIONS
    contractions: tuple = QUESTION_CONTRACTIONS


def sensitivity_variants(base: PairLexicon | None = None) -> dict[str, PairLexicon]:
    """Variant A is the base; B adds synonym negations; C adds adverbs on top of B."""
    base = base or PairLexicon()
    return {
        "A": base,
        "B": base.widened(SYNONYM_NEGATIONS),
        "C": base.widened(SYNONYM_NEGATIONS + ADVERB_NEGATIONS),
    }

# --- fixed values: single-statement generator -----------------------------------------
AUTHORITY_USAGE_CUES = ("according to experts", "studies show", "as reported by")
HEDGE_USAGE_CUES = ("possibly", "reportedly", "allegedly", "some researchers suggest")
SUBJECT_JOINERS = ("of", "the", "and", "de", "la", "du", "von", "van", "di")
SUBJECT_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "of", "in", "on", "at", "to", "by", "for", "from", "with",
    "that", "this", "these", "those", "it", "its", "they", "their", "them",
    "any", "all", "some", "every", "single",
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "does", "do", "did", "has", "have", "had",
    "can", "cannot", "will", "would", "might", "may", "could", "should", "shall", "must",
    "as", "so", "such", "than", "then",
    "more", "less", "most", "least", "very", "only", "just",
    "always", "often", "usually", "rarely", "sometimes",
    "popular", "belief", "case", "scientific", "evidence", "reports", "reportedly",
    "according", "expert", "experts", "study", "studies", "show",
    "not", "no", "never", "nothing", "nobody",
)
SINGLE_STATEMENT_RED_FLAGS = (
    "actually true", "is true rather", "is actually true", "fails the requirement",
    "must revise", "let me reconsider", "this is true", "statement is true",
    "this claim is accurate", "this is factually correct",
)
