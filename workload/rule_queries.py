"""Cue detectors, rule sets, judge verdicts and raw replies over the prose tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veneer.functions import cues
from veneer.functions.lexicons import PLAIN_TOPICS
from veneer.functions.text import inverted_cue_counts
from veneer.operators import probe, reshape, rules
from veneer.session import cut_lineage
from workload.common import PAIR_CUES, documents, q, rounded, spread, sql_plain, sql_words, table

QUERIES, ORACLES = {}, {}

# frequent words of the test prose in the roles of the cue lists
OPENERS = ("The", "Of the", "De la", "Der", "It", "Un")
NEGS = ("no", "und", "que")
HEDGES = ("this", "mit", "pour", "with")
STARTS = ("that is", "la", "and the", "en")
CONTRASTS = ("but", "los", "by")
FLAGS = ("auf", "du ")
B, S, D = chr(92) + "b", chr(92) + "s", chr(92)


def statements(spark, sf):
    """One row per sentence of the documents, in reading order, with the next sentence beside it."""
    d = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    cut = d.select("doc_id", "lang", "source", F.explode(F.array(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+"), F.lit(0)))).alias("parts"))
    beside = F.transform("parts", lambda x, i: F.struct(x.alias("statement"), F.get("parts", i + 1).alias("next")))
    return cut.select("doc_id", "lang", "source", F.posexplode(beside).alias("pos", "s")).select("doc_id", "lang", "source", "pos", "s.*")


STATEMENTS_SQL = r"""st0 AS (SELECT doc_id, lang, source, unnest(parts) AS statement, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[^.!?\n]+') AS parts FROM documents)),
st AS (SELECT *, lead(statement) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM st0)"""


def first_sql(terms, cond) -> str:
    """First term of the list whose condition holds; cond maps the term to SQL."""
    return "CASE " + " ".join(f"WHEN {cond(t)} THEN {q(t)}" for t in terms) + " END"


def lstrip(x):
    return f"regexp_replace({x}, {q('^' + S + '+')}, '')"


def strip_sql(x):
    return f"regexp_replace({x}, {q('^' + S + '+|' + S + '+$')}, '', 'g')"


def opener_sql(x, terms=OPENERS):
    return first_sql(terms, lambda t: f"regexp_matches({lstrip(x)}, {q('^(?i:' + t + ')(?:[^' + D + 'p{L}' + chr(39) + ']|$)')})")


def start_sql(x, terms=STARTS):
    return first_sql(terms, lambda t: f"regexp_matches(lower({lstrip(x)}), {q('^' + t.lower() + '(?:[^' + D + 'p{L}]|$)')})")


def unwrapped_sql(x, terms=OPENERS):
    bare = f"lower(regexp_replace({x}, {q('^[' + S + chr(34) + chr(39) + '`(' + D + '[{]+')}, ''))"
    return first_sql(terms, lambda t: f"starts_with({bare}, {q(t.lower())})")


def word_sql(x, terms):
    return first_sql(terms, lambda t: f"regexp_matches({sql_plain(x)}, {q(B + t + B)})")


def token_sql(x, terms):
    return first_sql(terms, lambda t: f"regexp_matches({sql_plain(x)}, {q('(?:^|[^' + D + 'w' + chr(39) + '])' + t + B)})")


def substr_sql(x, terms):
    return first_sql(terms, lambda t: f"contains(lower({x}), {q(t)})")


def _cols(name, cols):
    """Register a projection over statements: column -> (Spark expression, SQL expression)."""
    def run(spark, sf):
        return statements(spark, sf).select("doc_id", "pos", *[e().alias(c) for c, (e, _) in cols.items()])
    QUERIES[name] = run
    ORACLES[name] = f"WITH {STATEMENTS_SQL} SELECT doc_id, pos, " + ", ".join(f"{s} AS {c}" for c, (_, s) in cols.items()) + " FROM st"


_longest = sorted((o + " " for o in OPENERS), key=len, reverse=True)
_cols("opener_detectors", {
    "opener": (lambda: cues.opener(F.col("statement"), OPENERS), opener_sql("statement")),
    "start_phrase": (lambda: cues.start_phrase(F.col("statement"), STARTS), start_sql("statement")),
    "unwrapped": (lambda: cues.unwrapped_start(F.col("statement"), OPENERS), unwrapped_sql("statement")),
    "longest": (lambda: cues.longest_opener(F.col("statement"), OPENERS), first_sql(_longest, lambda t: f"starts_with(lower({lstrip('statement')}), {q(t.lower())})")),
})
_cols("token_detectors", {
    "first_word": (lambda: cues.first_word_hit(F.col("statement"), NEGS), word_sql("statement", NEGS)),
    "first_token": (lambda: cues.first_token_hit(F.col("statement"), NEGS), token_sql("statement", NEGS)),
    "first_substring": (lambda: cues.first_substring(F.col("statement"), FLAGS), substr_sql("statement", FLAGS)),
    "n_words_hit": (lambda: F.size(cues.distinct_word_hits(F.col("statement"), HEDGES)), "(" + " + ".join(
        f"regexp_matches({sql_plain('statement')}, {q(B + t + B)})::INT" for t in HEDGES) + ")"),
    "words_hit": (lambda: F.array_join(cues.distinct_word_hits(F.col("statement"), HEDGES), ","), "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches({sql_plain('statement')}, {q(B + t + B)}) THEN {q(t)} END" for t in HEDGES) + "], lambda x: x IS NOT NULL), ',')"),
    "conjunction": (lambda: cues.joining_conjunction(F.col("statement"), CONTRASTS), first_sql(CONTRASTS, lambda t: f"contains(' ' || lower(statement) || ' ', {q(' ' + t + ' ')})")),
    "after_break": (lambda: cues.authority_after_break(F.col("statement"), STARTS), "list_filter(list_transform(string_split_regex(lower("
        + strip_sql("statement") + "), '[,;:—–()]')[2:], lambda v: " + first_sql(STARTS, lambda t: f"starts_with({strip_sql('v')}, {q(t)})")
        + "), lambda v: v IS NOT NULL)[1]"),
})
_STRAT = (f"CASE WHEN {opener_sql('statement')} IS NOT NULL AND {word_sql('statement', HEDGES)} IS NOT NULL THEN 'negation_and_hedging' "
          f"WHEN {opener_sql('statement')} IS NOT NULL THEN 'negation_opener' WHEN {word_sql('statement', HEDGES)} IS NOT NULL THEN 'hedging' "
          f"WHEN {start_sql('statement')} IS NOT NULL THEN 'authority' ELSE 'none' END")
_DENY = ("the ", "of the", "la ")


def observed_sql(x):
    return ("list_filter([CASE WHEN " + unwrapped_sql(x) + " IS NOT NULL THEN 'negation_opener' END, CASE WHEN " + word_sql(x, HEDGES)
            + " IS NOT NULL THEN 'hedging' END, CASE WHEN " + unwrapped_sql(x, STARTS) + " IS NOT NULL THEN 'authority' END], lambda v: v IS NOT NULL)")


DASHED = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_''\\-]*[\\p{{L}}\\p{{N}}_])?'))"
_delta = f"abs({DASHED.format('statement')} - {DASHED.format('coalesce(next, ' + chr(39) * 2 + ')')})"
_cols("strategy_and_drift", {
    "strategy": (lambda: cues.surface_strategy(F.col("statement"), OPENERS, HEDGES, STARTS), _STRAT),
    "incorrect_class": (lambda: cues.incorrect_class(F.col("statement"), _DENY, ("ha", "nd")), "CASE WHEN " + " OR ".join(
        f"starts_with(lower({strip_sql('statement')}), {q(t)})" for t in _DENY)
        + f" OR regexp_matches({sql_plain('statement')}, {q(B + '(?:ha|nd)' + B)}) THEN 'negation_led' ELSE 'positive_assertion' END"),
    "observed": (lambda: F.array_join(cues.observed_cues(F.col("statement"), OPENERS, HEDGES, STARTS), ","), f"array_to_string({observed_sql('statement')}, ',')"),
    "drift": (lambda: cues.length_drift(F.col("statement"), F.col("next")), f"CASE WHEN {_delta} > greatest(15, floor(1.5 * {DASHED.format('coalesce(next, ' + chr(39) * 2 + ')')})) THEN {_delta} END"),
})

_STOP = ("the", "of", "and", "to", "in", "is", "that", "it", "de", "la", "der", "die", "und", "en", "le")
_base = f"regexp_replace({strip_sql('statement')}, '^\"+', '')"
_body = (f"regexp_replace(regexp_replace({_base}, {q('^(?i:' + '|'.join(_longest) + ')')}, ''), {q('^[,;:' + S + ']+')}, '')")
_RUN = "[A-Z][^ ]*(?: (?:[A-Z][^ ]*|(?:of|the|de|la|und) [A-Z][^ ]*))*"
QUERIES["subject_hints"] = lambda spark, sf: statements(spark, sf).select(
    "doc_id", "pos", cues.subject_hint(F.col("statement"), OPENERS, ("of", "the", "de", "la", "und"), _STOP).alias("subject"))
ORACLES["subject_hints"] = f"""WITH {STATEMENTS_SQL}, tk AS (SELECT doc_id, pos, regexp_extract_all({_body}, '[A-Za-z][A-Za-z''-]*')[1:20] AS toks FROM st),
rn AS (SELECT doc_id, pos, toks, list_filter(regexp_extract_all(' ' || array_to_string(toks, ' '), {q(' ' + _RUN)}), lambda r: true) AS runs FROM tk),
be AS (SELECT *, list_transform(runs, lambda r: trim(r)) AS rr, list_transform(runs, lambda r: len(string_split(trim(r), ' '))) AS nn,
  list_filter(toks, lambda t: NOT list_contains([{', '.join(q(w) for w in _STOP)}], lower(t))) AS content FROM rn)
SELECT doc_id, pos, CASE WHEN len(nn) > 0 AND list_max(nn) >= 2 THEN rr[list_position(nn, list_max(nn))]
  ELSE array_to_string(CASE WHEN len(content) > 0 THEN content[1:3] ELSE toks[1:3] END, ' ') END AS subject FROM be"""


QUERIES["subject_hints_whole"] = lambda spark, sf: statements(spark, sf).select(
    "doc_id", "pos", cues.subject_hint(F.col("statement"), OPENERS, ("of", "the", "de", "la", "und"), _STOP, None).alias("subject"))
ORACLES["subject_hints_whole"] = ORACLES["subject_hints"].replace("[1:20] AS toks", " AS toks")


def _usage(spark, sf):
    return probe.cue_usage(statements(spark, sf), cues.substring_hits(F.col("statement"), FLAGS + STARTS), 3000)


QUERIES["cue_usage_counts"] = _usage
ORACLES["cue_usage_counts"] = f"WITH {STATEMENTS_SQL}, u AS (" + " UNION ALL ".join(
    f"SELECT {q(t)} AS cue FROM st WHERE contains(lower(statement), {q(t)})" for t in FLAGS + STARTS) + ") SELECT cue, count(*) AS n, count(*) >= 3000 AS at_limit FROM u GROUP BY 1"


# --- rule sets ------------------------------------------------------------------------
def rule_sql(rules_):
    return "CASE " + " ".join(f"WHEN {c} THEN {why}" for c, why in rules_) + " END"


def hit(expr, head, tail="'"):
    return f"({expr}) IS NOT NULL", f"{q(head)} || ({expr}) || {q(tail)}"


def _summary(df):
    """Whole-table result: counts per reason (and warnings), with a checksum over the row ids."""
    return df.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), F.size("warnings").alias("n_warnings")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id") * 1000 + F.col("pos")).alias("checksum"))


def _register(name, validate, rules_, warnings="0", prepare=lambda s: s, with_=STATEMENTS_SQL, source="st"):
    QUERIES[name] = lambda spark, sf: _summary(validate(prepare(statements(spark, sf))))
    ORACLES[name] = (f"WITH {with_}, r AS (SELECT doc_id, pos, {rule_sql(rules_)} AS reason, {warnings} AS n_warnings FROM {source}) "
                     "SELECT coalesce(reason, 'ok') AS reason, n_warnings::INT AS n_warnings, count(*) AS n, sum(doc_id * 1000 + pos) AS checksum FROM r GROUP BY 1, 2")


A_, B_ = strip_sql("statement"), strip_sql("coalesce(next, '')")
CONF = "(0.6 + (doc_id % 9) * 0.05)::DOUBLE"


def confident(s):
    return s.withColumn("confidence", 0.6 + (F.col("doc_id") % 9) * 0.05)


LOW = [(f"{CONF} < 0.7", f"'confidence below minimum: ' || {CONF}::VARCHAR")]
PAIRS = rules.PairCues(openers=OPENERS, negations=NEGS, hedges=HEDGES, strict_hedges=HEDGES, banned_hedges=HEDGES + ("sich",),
                       authority_starts=STARTS, contrasts=CONTRASTS, red_flags=FLAGS)
_register("rules_fresh_pair", lambda s: rules.validate_fresh_pair(s, "statement", "next", "confidence", PAIRS), [
    (f"{A_} = ''", "'a_side empty'"), (f"{B_} = ''", "'b_side empty'"),
    hit(opener_sql(A_), "A starts with opener '"), hit(word_sql(A_, NEGS), "A contains negation token '"),
    hit(word_sql(A_, HEDGES), "A contains hedge '"), hit(start_sql(A_), "A starts with authority phrase '"),
    (f"({opener_sql(B_)}) IS NULL", "'B starts with no required opener'"),
    hit(word_sql(A_, CONTRASTS), "A contains contrast word '"), hit(word_sql(B_, CONTRASTS), "B contains contrast word '"),
    (LOW[0][0], "'confidence below minimum: ' || round(" + CONF + ", 2)::VARCHAR")],
    f"(({word_sql(B_, HEDGES)}) IS NULL)::INT", lambda s: s.withColumn("confidence", F.round(0.6 + (F.col("doc_id") % 9) * 0.05, 2)))


def _single_cue_rules(strategies, words=None):
    wc = lambda x: f"len(regexp_extract_all({x}, '[^{S}]+'))"
    opens, auth = f"({unwrapped_sql(B_)}) IS NOT NULL", f"({unwrapped_sql(B_, STARTS)}) IS NOT NULL"
    strict = "(" + " + ".join(f"regexp_matches({sql_plain(B_)}, {q(B + t + B)})::INT" for t in HEDGES) + ")"
    banned = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({sql_plain(B_)}, {q(B + t + B)}) THEN {q(t)} END"
                                         for t in HEDGES + ("sich",)) + "], lambda x: x IS NOT NULL)"
    seen = observed_sql(B_)
    bands = [] if not words else [
        (f"{wc(x)} < {words[0]} OR {wc(x)} > {words[1]}", f"'wc_violation:{side}:' || {wc(x)}") for side, x in (("A", A_), ("B", B_))]
    return [
        (f"{A_} = ''", "'a_side empty'"), (f"{B_} = ''", "'b_side empty'"),
        ("plan NOT IN (" + ", ".join(q(s) for s in strategies) + ")", "'invalid strategy: ' || plan"), *bands,
        hit(unwrapped_sql(A_), "A starts with opener '"), hit(word_sql(A_, CONTRASTS), "A contains contrast word '"),
        hit(word_sql(B_, CONTRASTS), "B contains contrast word '"),
        (f"plan = 'negation_opener' AND NOT ({opens})", "'B must start with an opener'"),
        (f"plan = 'negation_opener' AND len({banned}) > 0", f"'B has banned hedges: ' || array_to_string({banned}, ',')"),
        (f"plan = 'negation_opener' AND {auth}", "'B must not start with an authority phrase'"),
        (f"plan = 'hedging' AND {opens}", "'B must not start with an opener'"),
        (f"plan = 'hedging' AND {auth}", "'B must not start with an authority phrase'"),
        (f"plan = 'hedging' AND {strict} <> 1", f"'B needs exactly one hedge, has ' || {strict}"),
        (f"plan = 'authority' AND NOT ({auth})", "'B must start with an authority phrase'"),
        (f"plan = 'authority' AND {opens}", "'B must not start with an opener'"),
        (f"plan = 'authority' AND len({banned}) > 0", f"'B has banned hedges: ' || array_to_string({banned}, ',')"),
        hit(substr_sql("statement", FLAGS), "A rationale has red flag '"), hit(substr_sql("coalesce(next, '')", FLAGS), "B rationale has red flag '"),
        (f"len({seen}) <> 1", f"'observed cues: ' || array_to_string({seen}, ',')"),
        (f"{seen}[1] <> plan", "'observed cue differs from strategy'")]


PLANS = ("negation_opener", "hedging", "authority", "mixed")
PLAN_SQL = STATEMENTS_SQL + ", sp AS (SELECT *, [" + ", ".join(q(p) for p in PLANS) + "][(doc_id + pos) % 4 + 1] AS plan FROM st)"


def planned(s):
    return s.withColumns({"plan": F.element_at(F.array(*[F.lit(p) for p in PLANS]), ((F.col("doc_id") + F.col("pos")) % 4 + 1).cast("int")),
                          "confidence": F.lit(0.9)})


_names = dict(a="statement", b="next", strategy="plan", confidence="confidence", rationales=("statement", "next"), c=PAIRS)
_register("rules_single_cue_pair", lambda s: rules.validate_single_cue_pair(s, **_names), _single_cue_rules(PLANS[:3]),
          prepare=planned, with_=PLAN_SQL, source="sp")
_register("rules_short_single_cue_pair", lambda s: rules.validate_short_single_cue_pair(s, **_names),
          _single_cue_rules(PLANS[:2], (5, 20)), prepare=planned, with_=PLAN_SQL, source="sp")

PLAIN = rules.PlainCues(topics=PLAIN_TOPICS + ("en", "fr", "de"), openers=OPENERS, negations=NEGS, authority_starts=STARTS,
                        authority=("of the", "et la"), hedges=HEDGES, contrasts=CONTRASTS, red_flags=FLAGS)


def _plain(low, high):
    wc = f"len(regexp_extract_all({A_}, '[^{S}]+'))"
    return [(f"{A_} = ''", "'statement empty'"), ("lang NOT IN ('en', 'fr', 'de')", "'invalid topic: ' || lang"),
            (f"{wc} < {low} OR {wc} > {high}", f"'wc_violation:' || {wc}"),
            hit(unwrapped_sql(A_), "starts with opener '"), hit(token_sql(A_, NEGS), "contains negation token '"),
            hit(unwrapped_sql(A_, STARTS), "starts with authority phrase '"), hit(substr_sql(A_, ("of the", "et la")), "contains authority phrase '"),
            hit(token_sql(A_, HEDGES), "contains hedge '"), hit(token_sql(A_, CONTRASTS), "contains contrast word '"),
            hit(substr_sql("coalesce(next, '')", FLAGS), "rationale has red flag '")]


for _name, _band in (("rules_plain_statement", (5, 15)), ("rules_plain_statement_long", (22, 26))):
    _register(_name, lambda s, band=_band: rules.validate_plain_statement(s, "statement", "lang", "confidence", "next", band, PLAIN),
              _plain(*_band), prepare=lambda s: s.withColumn("confidence", F.lit("0.8")))

PARA = rules.ParaphraseCues(openers=OPENERS, hedges=HEDGES, authority=STARTS, authority_starts=STARTS, conjunctions=CONTRASTS,
                            red_flags=FLAGS)
_conj = lambda x: first_sql(CONTRASTS, lambda t: f"contains(' ' || lower({x}) || ' ', {q(' ' + t + ' ')})")
_brk = lambda x: ("list_filter(list_transform(string_split_regex(lower(" + x + "), '[,;:—–()]')[2:], lambda v: "
                  + first_sql(STARTS, lambda t: f"starts_with({strip_sql('v')}, {q(t)})") + "), lambda v: v IS NOT NULL)[1]")
_cls = ("CASE WHEN " + " OR ".join(f"starts_with(lower({B_}), {q(t)})" for t in _DENY)
        + f" OR regexp_matches({sql_plain(B_)}, {q(B + '(?:ha|nd)' + B)}) THEN 'negation_led' ELSE 'positive_assertion' END")
_register("rules_paraphrase", lambda s: rules.validate_paraphrase(
    s, "statement", "next", "statement", "next", "route", "confidence", ("next", "statement"), PARA), [
    (f"{A_} = '' OR {B_} = ''", "'a side is empty'"), hit(opener_sql(A_), "A starts with opener '"),
    (f"{_cls} = 'negation_led' AND ({opener_sql(B_)}) IS NULL", "'B starts with no required opener'"),
    (f"{_cls} = 'positive_assertion' AND ({word_sql(B_, HEDGES)}) IS NULL AND ({start_sql(B_)}) IS NULL", "'B has neither hedge nor authority start'"),
    hit(word_sql(A_, HEDGES), "A contains hedge '"),
    hit(_conj(A_), "A contains conjunction '"), hit(_brk(A_), "A has authority cue '", "' after a break"),
    hit(_conj(B_), "B contains conjunction '"), hit(_brk(B_), "B has authority cue '", "' after a break"),
    (f"length({A_}) < 15", "'A self-check too short'"), (f"length({B_}) < 15", "'B self-check too short'"),
    hit(substr_sql(A_, FLAGS), "A self-check has red flag '"), hit(substr_sql(B_, FLAGS), "B self-check has red flag '")],
    f"((abs({DASHED.format(A_)} - {DASHED.format(B_)}) > greatest(15, floor(1.5 * {DASHED.format(B_)})))::INT"
    f" + (abs({DASHED.format(A_)} - {DASHED.format(B_)}) > greatest(15, floor(1.5 * {DASHED.format(A_)})))::INT)",
    lambda s: s.withColumns({"route": cues.incorrect_class(F.col("next"), _DENY, ("ha", "nd")), "confidence": F.lit(0.75)}))

_register("rules_single_statement", lambda s: rules.validate_single_statement(s, "confidence", "statement", FLAGS), [
    ("lang = 'es'", "'confidence is not a number'"), ("lang = 'fr'", "'confidence below minimum: 0.5'"),
    hit(substr_sql("statement", FLAGS), "rationale admits '")],
    prepare=lambda s: s.withColumn("confidence", F.when(F.col("lang") == "es", "high").when(F.col("lang") == "fr", "0.5").otherwise("0.9")))


# --- inverted profiles ----------------------------------------------------------------
def _counts(s, col):
    return inverted_cue_counts(s.select("doc_id", "pos", F.coalesce(F.col(col), F.lit("")).alias(col)), col, NEGS, HEDGES, ("of the", "et la"), CONTRASTS,
                               ("the", "der", "it"))


def _inv_sql(x, prefix):
    return (f"SELECT doc_id, pos, len(regexp_extract_all({x}, '[^{S}]+')) AS wc, regexp_matches({strip_sql(sql_plain(x))}, {q('^(?:the|der|it)' + B)})::INT AS nl, "
            f"{sql_words(sql_plain(x), NEGS)} AS nc, {sql_words(sql_plain(x), HEDGES)} AS hc, len(regexp_extract_all(lower({x}), 'of the')) + len(regexp_extract_all(lower({x}), 'et la')) AS ac, "
            f"{sql_words(sql_plain(x), CONTRASTS)} AS cc FROM st")


def _inverted(spark, sf):
    """One pass over the texts; a sentence's successor is found among the numbers, and has none of anything at the end."""
    counted = cut_lineage(_counts(statements(spark, sf), "statement").drop("statement"))
    after = Window.partitionBy("doc_id").orderBy("pos")
    numbers = [c for c in counted.columns if c not in ("doc_id", "pos")]
    a = counted.withColumn("failures", rules.inverted_a_failures())
    b = counted.select("doc_id", "pos", *[F.coalesce(F.lead(c).over(after), F.lit(0)).alias(c) for c in numbers]).withColumn("failures", rules.inverted_b_failures())
    key = lambda d: d.withColumn("id", F.struct("doc_id", "pos"))
    out = rules.length_delta_pairs(key(a), key(b), "id")
    return a, b, out


_INV = f"WITH {STATEMENTS_SQL}, ia AS ({_inv_sql('statement', 'a')}), ib AS ({_inv_sql('coalesce(next, ' + chr(39) * 2 + ')', 'b')})"
_AOK = "(a.wc BETWEEN 5 AND 15 AND a.nl = 0 AND a.nc = 0 AND a.hc = 0 AND a.ac = 0 AND a.cc = 0)"
_BOK = "(b.wc BETWEEN 18 AND 29 AND NOT (b.nc = 0 AND b.hc = 0 AND b.nl = 0))"
QUERIES["inverted_profile_a"] = lambda spark, sf: _inverted(spark, sf)[0].select("doc_id", "pos", F.array_join("failures", ",").alias("failures"))
ORACLES["inverted_profile_a"] = _INV + """ SELECT doc_id, pos, array_to_string(list_filter([CASE WHEN wc NOT BETWEEN 5 AND 15 THEN 'word_count=' || wc END,
  CASE WHEN nl = 1 THEN 'neg_lead' END, CASE WHEN nc > 0 THEN 'neg_cnt=' || nc END, CASE WHEN hc > 0 THEN 'hedge_cnt=' || hc END,
  CASE WHEN ac > 0 THEN 'auth_cnt=' || ac END, CASE WHEN cc > 0 THEN 'contrast_cnt=' || cc END], lambda v: v IS NOT NULL), ',') AS failures FROM ia"""
QUERIES["inverted_profile_b"] = lambda spark, sf: _inverted(spark, sf)[1].select("doc_id", "pos", F.array_join("failures", ",").alias("failures"))
ORACLES["inverted_profile_b"] = _INV + """ SELECT doc_id, pos, array_to_string(list_filter([CASE WHEN wc NOT BETWEEN 18 AND 29 THEN 'word_count=' || wc END,
  CASE WHEN nc = 0 AND hc = 0 AND nl = 0 THEN 'no cue present' END], lambda v: v IS NOT NULL), ',') AS failures FROM ib"""
QUERIES["inverted_length_delta"] = lambda spark, sf: rules.length_delta_summary(_inverted(spark, sf)[2])
ORACLES["inverted_length_delta"] = _INV + f""" SELECT count(*) AS n_pairs, count(*) FILTER (NOT {_AOK}) AS a_fails, count(*) FILTER (NOT {_BOK}) AS b_fails,
  count(*) FILTER (b.wc - a.wc < 8) AS delta_fails, count(*) FILTER ({_AOK} AND b.wc - a.wc >= 8) AS usable_n FROM ia a JOIN ib b USING (doc_id, pos)"""
QUERIES["bilateral_corpus_summary"] = lambda spark, sf: rounded(probe.corpus_summary(_inverted(spark, sf)[2]), ["mean_wc_a", "mean_wc_b", "mean_delta"])
ORACLES["bilateral_corpus_summary"] = _INV + """ SELECT count(*) AS n_pairs, min(a.wc) AS min_wc_a, max(a.wc) AS max_wc_a, round(avg(a.wc), 6) AS mean_wc_a,
  min(b.wc) AS min_wc_b, max(b.wc) AS max_wc_b, round(avg(b.wc), 6) AS mean_wc_b, min(b.wc - a.wc) AS min_delta, max(b.wc - a.wc) AS max_delta,
  round(avg(b.wc - a.wc), 6) AS mean_delta, bool_and(b.wc - a.wc >= 8) AS all_delta_ok FROM ia a JOIN ib b USING (doc_id, pos)"""


# --- judges ---------------------------------------------------------------------------
def judged(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("a_true"), (F.col("o_orderpriority") != "5-LOW").alias("b_false"),
        F.round(F.col("o_totalprice") % 1.0, 4).alias("generator"), F.round((F.col("o_totalprice") * 7) % 1.0, 4).alias("judge"))


J = """j AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS a_true, o_orderpriority <> '5-LOW' AS b_false,
  round(o_totalprice % 1.0, 4) AS generator, round((o_totalprice * 7) % 1.0, 4) AS judge FROM orders)"""


def _judges(spark, sf):
    j = judged(spark, sf).withColumn("flag", rules.disagreement_flag(F.col("generator"), F.col("b_false"), F.col("judge")))
    j = rules.judge_precondition(j, "a_true", "b_false", "flag")
    return j.select("id", "flag", "issue", rules.pair_passes(F.col("a_true"), F.col("b_false")).alias("passes"),
                    rules.pair_faithful(F.col("a_true"), F.col("b_false")).alias("faithful"))


QUERIES["judge_verdicts"] = _judges
ORACLES["judge_verdicts"] = f"""WITH {J}, k AS (SELECT *, generator > 0.9 AND NOT b_false AND judge < 0.6 AS flag FROM j)
SELECT id, flag, CASE WHEN NOT a_true THEN 'A not judged true' WHEN NOT b_false OR flag THEN 'B not judged false or flagged' END AS issue,
  a_true AND NOT b_false AS passes, a_true AND b_false AS faithful FROM k"""


def _gates(spark, sf):
    j = judged(spark, sf).withColumn("flag", rules.disagreement_flag(F.col("generator"), F.col("b_false"), F.col("judge")))
    return rounded(probe.decision_gates(
        j.select(F.col("b_false").alias("judged_false"), F.col("flag").alias("judge_disagreement_flag")),
        j.select(F.col("generator").alias("p_full"), F.col("judge").alias("p_cleaned"))), ["mean_full", "gap"])


QUERIES["decision_gates"] = _gates
ORACLES["decision_gates"] = f"""WITH {J}, k AS (SELECT *, generator > 0.9 AND NOT b_false AND judge < 0.6 AS flag FROM j),
g AS (SELECT count(*) AS n_judged, count(*) FILTER (b_false) AS n_judged_false, count(*) FILTER (flag) AS n_disagree, count(*) AS n_scored,
  avg(generator) AS mean_full, count(*) FILTER (generator > 0.5) AS n_fooled, avg(generator) - avg(judge) AS gap FROM k),
v AS (SELECT *, n_judged_false >= n_judged * 0.9 AND n_disagree <= n_judged * 0.1 AS c3, mean_full >= 0.55 AS c4, n_fooled >= n_scored * 0.6 AS c5 FROM g)
SELECT n_judged, n_judged_false, n_disagree, n_scored, round(mean_full, 6) AS mean_full, n_fooled, round(gap, 6) AS gap,
  CASE WHEN c3 THEN 'PASS' ELSE 'FAIL' END AS judge_gate, CASE WHEN c4 THEN 'PASS' ELSE 'FAIL' END AS mean_gate, CASE WHEN c5 THEN 'PASS' ELSE 'FAIL' END AS fooled_gate,
  CASE WHEN gap >= 0.05 THEN 'PASS' ELSE 'FAIL' END AS gap_flag, 'PENDING' AS human_gate, CASE WHEN c3 AND c4 AND c5 THEN 'PROCEED' ELSE 'PAUSE' END AS decision FROM v"""


# --- raw replies ----------------------------------------------------------------------
def replies(spark, sf):
    """Assistant turns wrapped as model replies: some valid, some with a bad number, some without JSON."""
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    body = F.concat(F.lit('Sure: {"statement": "'), F.regexp_replace("text", '[\\n"\\\\]', " "),
                    F.lit('", "confidence": '), F.when(F.col("conv_id") % 3 == 0, F.lit('"high"')).otherwise(F.lit("0.8")), F.lit(', "ok": true} done'))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, F.col("text")).otherwise(body).alias("reply"))


def _parsed(spark, sf):
    out = reshape.parse_replies(replies(spark, sf), "statement string, confidence double, ok boolean", required=("statement", "confidence"), numeric=("confidence",))
    return out.select("conv_id", "turn", F.length("statement").alias("n_statement"), "confidence", "ok", "parse_error")


QUERIES["parse_raw_replies"] = _parsed
ORACLES["parse_raw_replies"] = """SELECT conv_id, turn, CASE WHEN conv_id % 5 <> 0 THEN length(text) END AS n_statement,
  CASE WHEN conv_id % 5 <> 0 AND conv_id % 3 <> 0 THEN 0.8::DOUBLE END AS confidence, CASE WHEN conv_id % 5 <> 0 THEN true END AS ok,
  CASE WHEN conv_id % 5 = 0 THEN 'no json object' WHEN conv_id % 3 = 0 THEN 'confidence is not a number' END AS parse_error
FROM conversations WHERE role = 'assistant'"""


def _completions(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("conv_id").alias("pair_id"), F.col("text").alias("reply"))
    return reshape.score_completions(reshape.assign_order(c, 42)).select("conv_id", "turn", "choice", "correct")


QUERIES["score_completions"] = _completions
from workload.common import sql_draw  # noqa: E402

ORACLES["score_completions"] = f"""WITH c AS (SELECT conv_id, turn, nullif(upper(CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z])[ABab](?:[^A-Za-z]|$)')
  THEN regexp_extract(text, '(?:^|[^A-Za-z])([ABab])(?:[^A-Za-z]|$)', 1) ELSE regexp_extract(text, '[ABab]') END), '') AS choice,
  {sql_draw("'42'", "'order'", "conv_id")} / {float(1 << 52)}::DOUBLE < 0.5 AS true_is_a FROM conversations)
SELECT conv_id, turn, choice, coalesce((choice = CASE WHEN true_is_a THEN 'A' ELSE 'B' END)::INT, 0) AS correct FROM c"""


def _choices(text):
    def run(spark, sf):
        d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
            "doc_id", F.struct(F.array("lang", "source", text()).alias("choices"),
                               F.array(F.lit(1), "toxic", F.lit(0)).alias("labels")).alias("mc1_targets"))
        out = reshape.parse_choices(d)
        return out.select("doc_id", "correct_norm", F.array_join("wrong_norm", "|").alias("wrong"), "choice_error")
    return run


QUERIES["parse_choice_targets"] = _choices(lambda: F.substring_index("text", " ", 3))
QUERIES["parse_choice_targets_whole"] = _choices(lambda: F.col("text"))
ORACLES["parse_choice_targets"] = r"""WITH n AS (SELECT doc_id, toxic, lang, source, regexp_replace(replace(regexp_replace(regexp_replace(lower(
  array_to_string(string_split(text, ' ')[1:3], ' ')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), ' in the california', ' in california'), '\.+$', '') AS k
  FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 0 THEN lang END AS correct_norm, CASE WHEN toxic = 0 THEN source || '|' || k ELSE k END AS wrong,
  CASE WHEN toxic = 1 THEN 'multiple correct labels' END AS choice_error FROM n"""
ORACLES["parse_choice_targets_whole"] = ORACLES["parse_choice_targets"].replace("array_to_string(string_split(text, ' ')[1:3], ' ')", "text")
