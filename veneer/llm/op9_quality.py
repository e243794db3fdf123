"""Quality by weak supervision: rules vote or abstain, expectation-maximisation learns how far each can be trusted.

Columns only: one narrow pass over the texts makes counts, the counts make votes, and the votes shrink to one row per
vote pattern (at most 3^rules), over which the model is fitted. No text is shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veneer.llm.common import cut_lineage, materialised, table, texts, words_of

#: Characters that count as symbols.
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def _without(text: Column, characters) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), characters, text)


def _symbol_count(text: Column) -> Column:
    bare = _without(text, SYMBOLS)
    return F.when(text.rlike("[#*$%&|<>]"), F.length(text) - F.length(bare)).otherwise(F.lit(0))


def base_metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text; null text counts as empty, where every count is 0. Rows are kept one to one.

    `keep` names further input columns to carry along. Repeated words are those in 5-word windows that occur twice or
    more in the text: windows are hashed within the row, and only rows with a repeated hash sort theirs.
    """
    base = df.select(F.struct(*[F.col(c) for c in keep]).alias("_keep") if keep else F.lit(None).alias("_keep"),
                     F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, words = F.col("text"), F.col("words")
    whole = ["_keep", "doc_id"]
    base = materialised(base, [*whole, "text"], words=words_of(text), lines=F.split(text, "\n"))
    filled = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = materialised(
        base, whole, n_words=F.size(words).cast("long"), word_chars=F.length(_without(text, SPACES)).cast("long"),
        n_symbols=_symbol_count(text).cast("long"), filled=filled,
        n_distinct=F.size(F.array_distinct(words)).cast("long"),
        n_exclaims=(F.length(text) - F.length(_without(text, ("!",)))).cast("long"),
        n_upper=F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        hashes=F.transform(words, lambda w: F.xxhash64(w)))
    plain = [*whole, "n_words", "word_chars", "n_symbols", "n_distinct", "n_exclaims", "n_upper", "n_lines", "n_dup_lines"]
    counted = counted.withColumns({
        "n_lines": F.size("filled").cast("long"),
        "n_dup_lines": (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long")})
    at = lambda k: F.get(F.col("hashes"), k)
    windows = F.when(F.size("hashes") < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)])))
    shingled = materialised(counted, plain, windows=windows)
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_rows = materialised(shingled, plain, ordered=ordered)
    hash_at = lambda i: F.get(F.col("ordered"), i)["h"]
    twice = F.filter("ordered", lambda x, i: F.coalesce(hash_at(i - 1) == x["h"], F.lit(False))
                     | F.coalesce(hash_at(i + 1) == x["h"], F.lit(False)))
    placed = materialised(sorted_rows, plain, places=F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(
        F.get(F.col("places"), i + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    carried = [F.col("_keep")[c].alias(c) for c in keep]
    return placed.select(*carried, *([] if id_col in keep else [F.col("doc_id")]), *plain[2:],
                         covered.alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def default_rules() -> dict[str, Column]:
    """Votes on the counts: 1 speaks for the text, -1 against it, 0 abstains. A text without words gets no vote."""
    n, chars = F.col("n_words"), F.col("word_chars")
    some = n > 0
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c).cast("double"), of), F.lit(0.0))
    return {
        "length": _vote(n >= 30, n < MIN_WORDS),
        "symbols": _vote(some & (share("n_symbols", n) < 0.05), share("n_symbols", n) > 0.2),
        "repetition": _vote(some & (share("n_repeat_words", n) < 0.05), share("n_repeat_words", n) > 0.2),
        "lines": _vote(some & (share("n_dup_lines", F.col("n_lines")) < 0.1), share("n_dup_lines", F.col("n_lines")) > 0.4),
        "shouting": _vote(some & (share("n_exclaims", n) < 0.1), share("n_exclaims", n) > 0.3),
        "capitals": _vote(some & (share("n_upper", chars) < 0.2), share("n_upper", chars) > 0.4),
        "word_length": _vote(share("word_chars", n).between(3.0, 10.0), some & ~share("word_chars", n).between(1.5, 20.0)),
        "variety": _vote((n >= 50) & (share("n_distinct", n) > 0.3), (n >= 50) & (share("n_distinct", n) < 0.1)),
    }


class LabelModel:
    """Prior of good texts and, per rule and class, the chance that its vote (when cast) is right.

    Votes are independent given the class; an abstention says nothing. Every chance is a smoothed ratio of expected
    counts, so a rule that never votes against anything stays harmless. Rules are written with wide margins, so one
    bound is known beforehand: a good text meets a vote against it from one rule in a thousand cases at most
    (`least_right_if_good`). Without it the fit would take the largest family of like rules for the class itself.
    """

    least_right_if_good = 0.999

    def __init__(self, rules: list[str], prior: float = 0.8):
        self.rules, self.prior = rules, prior
        self.right_if_good = dict.fromkeys(rules, self.least_right_if_good)
        self.right_if_bad = dict.fromkeys(rules, 0.3)
        self.iterations, self.converged = 0, False

    def posterior(self) -> Column:
        """Posterior of a vote pattern. What the votes weigh is one array, which the generated code refers to: numbers
        written into the expression would have new code compiled and kept for every step of the fit."""
        weights, prior = [], math.log(self.prior / (1 - self.prior))
        for r in self.rules:
            g, b = self.right_if_good[r], self.right_if_bad[r]
            weights += [prior + x for x in (math.log((1 - g) / b), 0.0, math.log(g / (1 - b)))]
            prior = 0.0  # counted once
        place = lambda r, k: F.when(F.col(r) == 1, 3 * k + 2).when(F.col(r) == -1, 3 * k).otherwise(3 * k + 1)
        terms = [F.get(F.array(*[F.lit(w) for w in weights]), place(r, k)) for k, r in enumerate(self.rules)]
        return 1.0 / (1.0 + F.exp(-sum(terms[1:], terms[0]))) if terms else F.lit(1.0 / (1.0 + math.exp(-prior)))


def fit(patterns: DataFrame, rules: list[str], max_iter: int = 100, tolerance: float = 1e-4) -> LabelModel:
    """Expectation-maximisation over (votes..., n) rows. Each step is one aggregate that returns 2 + 4 x rules sums.

    `model.converged` tells whether the largest change fell below `tolerance` within `max_iter` steps; no rows give
    the starting values.
    """
    model = LabelModel(rules)
    sums = ["sum(n) n", "sum(n * good) good"]
    for r in rules:
        for vote, name in ((1, "p"), (-1, "m")):
            sums += [f"sum(if({r} = {vote}, n, 0)) {r}_{name}", f"sum(if({r} = {vote}, n * good, 0D)) {r}_{name}g"]
    for step in range(max_iter):
        row = patterns.withColumn("good", model.posterior()).selectExpr(*sums).first()
        if not row["n"]:
            model.converged = True
            return model
        ratio = lambda a, b: (a + 0.5) / (b + 1.0)  # noqa: E731  half a vote either way
        prior, new = ratio(row["good"], row["n"]), {}
        for r in rules:
            pg, mg, p, m = row[f"{r}_pg"], row[f"{r}_mg"], row[f"{r}_p"], row[f"{r}_m"]
            new[r] = max(ratio(pg, pg + mg), model.least_right_if_good), ratio(m - mg, p + m - pg - mg)
        change = max([abs(prior - model.prior)] + [max(abs(new[r][0] - model.right_if_good[r]),
                                                       abs(new[r][1] - model.right_if_bad[r])) for r in rules])
        model.prior, model.iterations = prior, step + 1
        model.right_if_good = {r: x[0] for r, x in new.items()}
        model.right_if_bad = {r: x[1] for r, x in new.items()}
        if change < tolerance:
            model.converged = True
            break
    return model


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def votes(metrics: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    return metrics.withColumns({f"vote_{r}": c for r, c in (default_rules() if rules is None else rules).items()})


def learn(voted: DataFrame) -> LabelModel:
    """Fits the model to the vote patterns of all texts that pass the base test; one row per pattern leaves the scan."""
    names = [c for c in voted.columns if c.startswith("vote_")]
    # texts that fail the base test are decided already and would only teach the model that test
    patterns = cut_lineage(voted.filter(~base_failed()).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    return fit(patterns, names)


def verdicts(voted: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    return (voted.withColumn("quality", model.posterior()).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Column] | None = None,
            threshold: float = 0.5) -> DataFrame:
    """One row per input row: counts, votes, their posterior `quality`, `base_failed` and `kept`.

    A text fails the base test with fewer than 10 words or more than 20 % repeated words; others are kept when the
    posterior reaches `threshold`. Null and empty texts fail the base test. Nothing here depends on the id, so null
    or repeated ids and repeated rows keep their own rows. An empty table gives no rows.
    """
    # the counts are read by the fit and by the verdicts: they are written once, without texts
    voted = cut_lineage(votes(base_metrics(df, id_col, text_col), rules))
    return verdicts(voted, learn(voted), threshold)


def quality_filter(df: DataFrame, text_col: str = "text", rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """The input's kept rows, whole, in its own columns. The texts are read twice and never shuffled or stored.

    Column names of the input can't clash with the counts: rows travel as one struct.
    """
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), df[text_col].alias("text"))
    model = learn(votes(base_metrics(whole.select(F.lit(None).alias("doc_id"), "text")), rules))
    voted = votes(base_metrics(whole.withColumn("doc_id", F.lit(None)), keep=("doc",)), rules)
    return verdicts(voted, model, threshold).filter("kept").select("doc.*")


def query(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {"op9_quality_rules": query}
ORACLES: dict[str, str] = {}
