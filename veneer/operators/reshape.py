"""Projections and reshapes between pair tables, answer rows, scores and review sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.functions import cues
from veneer.functions.draws import uniform
from veneer.functions.lexicons import PairLexicon
from veneer.functions.text import (PAIR_FEATURES, PAIR_FEATURES_WIDE, normalized_text, pair_features,
                                   relative_length_gap, strip, temporal_fragile, text_or_blank)
from veneer.operators.ordering import global_rank

SIDED = tuple(f for f in PAIR_FEATURES if f != "len_gap")
LEN_GAP_MAX, HEDGE_GAP_MAX, AUTH_GAP_MAX = 0.20, 0.02, 0.01
NO_COMMENT = "i have no comment"


def require_columns(df: DataFrame, names, what: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def normalize_profile(name: str) -> str:
    known = {"surface10": "surface10", "paper10": "surface10",
             "surface13": "surface13", "expanded13": "surface13"}
    if name not in known:
        raise ValueError(f"unknown audit profile {name!r}; expected one of {sorted(known)}")
    return known[name]


# --- pair tables ----------------------------------------------------------------------
def first_present(df: DataFrame, *names: str) -> Column:
    """First non-null of the columns that exist."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    if not found:
        raise ValueError(f"none of the columns {list(names)} is present")
    return F.coalesce(*found)


def coalesce_incorrect(df: DataFrame) -> DataFrame:
    """(pair_id, question, best_answer, best_incorrect) from any release of the pair table."""
    direct = [n for n in ("Best Incorrect Answer", "Best incorrect answer") if n in df.columns]
    if direct:
        incorrect = F.coalesce(*[F.col(f"`{n}`") for n in direct])
    else:
        every = first_present(df, "Incorrect Answers", "Incorrect answers")
        chunks = F.when(F.contains(every, F.lit(";")), F.split(every, ";")).otherwise(F.split(every, "\n"))
        incorrect = F.try_element_at(F.filter(F.transform(chunks, strip), lambda x: x != ""), F.lit(1))
    return df.select("pair_id", first_present(df, "Question", "question").alias("question"),
                     first_present(df, "Best Answer", "Best answer", "BestAnswer").alias("best_answer"),
                     incorrect.alias("best_incorrect"))


def wide_audit(pairs: DataFrame, true_text: str, false_text: str, question: str | None = None,
               profile: str = "surface10_audit", lexicon: PairLexicon | None = None,
               drop_texts: bool = True) -> DataFrame:
    """One row per pair with every feature on both sides; no shuffle when both texts are in the row."""
    lex = lexicon or PairLexicon()
    out = pairs
    for side, text in (("true", true_text), ("false", false_text)):
        out = pair_features(out, text, profile, lex, keep_length=True)
        for f in (*SIDED, "n_chars_text"):
            out = out.withColumnRenamed(f, f"{f}_{side}")
    lowered = [F.lower(text_or_blank(c)) for c in (question, true_text, false_text) if c]
    out = (out.withColumn("len_gap", relative_length_gap(F.col("n_chars_text_true"), F.col("n_chars_text_false")))
              .withColumn("temporal_fragile", temporal_fragile(lowered, lex.temporal))
              .drop("n_chars_text_true", "n_chars_text_false"))
    return out.drop(true_text, false_text) if drop_texts else out


def style_violation(len_max: Column | float = LEN_GAP_MAX, hedge_max: Column | float = HEDGE_GAP_MAX,
                    auth_max: Column | float = AUTH_GAP_MAX) -> Column:
    """1 when either side leads with a negation or any gap passes its limit."""
    flagged = ((F.col("neg_lead_true") == 1) | (F.col("neg_lead_false") == 1)
               | (F.col("len_gap") > len_max)
               | (F.abs(F.col("hedge_rate_true") - F.col("hedge_rate_false")) > hedge_max)
               | (F.abs(F.col("auth_rate_true") - F.col("auth_rate_false")) > auth_max))
    return flagged.cast("int")


def to_answers(audit: DataFrame, key: str = "pair_id", profile: str = "surface10",
               meta: tuple = ()) -> DataFrame:
    """Two labelled rows per pair in one pass (no union of two scans)."""
    profile = normalize_profile(profile)
    shared = ["len_gap"]
    extra = []
    if profile == "surface13":
        fragile = F.col("temporal_fragile") if "temporal_fragile" in audit.columns else F.lit(0)
        extra = [F.coalesce(fragile, F.lit(0)).cast("double").alias("temporal_fragile"),
                 (F.col("hedge_rate_true") - F.col("hedge_rate_false")).alias("hedge_pair_diff"),
                 (F.col("auth_rate_true") - F.col("auth_rate_false")).alias("auth_pair_diff")]
    names = PAIR_FEATURES_WIDE if profile == "surface13" else PAIR_FEATURES
    side = [F.struct(F.lit(label).alias("label"), *[F.col(f"{f}_{s}").cast("double").alias(f) for f in SIDED])
            for label, s in ((1, "true"), (0, "false"))]
    return (audit.select(key, *meta, *shared, *extra, F.explode(F.array(*side)).alias("a"))
            .select(key, *meta, "a.label", *[f"a.{f}" if f in SIDED else f for f in names]))


def to_stub_answers(cands: DataFrame, key: str = "example_id") -> DataFrame:
    """Legacy search frame: halved rate differences on the true side, constants elsewhere."""
    def side(label, suffix, share):
        return F.struct(F.lit(label).alias("label"),
                        F.col(f"neg_lead_{suffix}").cast("double").alias("neg_lead"),
                        F.col(f"neg_cnt_{suffix}").cast("double").alias("neg_cnt"),
                        (F.col("hedge_diff") * share).alias("hedge_rate"),
                        (F.col("authority_diff") * share).alias("auth_rate"))
    constants = {"word_count": 10.0, "sent_count": 1.0, "avg_token_len": 4.0, "type_token": 1.0,
                 "punc_rate": 0.0}
    return (cands.select(F.col(key).alias("pair_id"), F.col("length_gap").alias("len_gap"),
                         F.explode(F.array(side(1, "true", 0.5), side(0, "false", 0.0))).alias("a"))
            .select("pair_id", "a.*", "len_gap", *[F.lit(v).alias(k) for k, v in constants.items()]))


def to_pairs(answers: DataFrame, features, key: str = "pair_id", label: str = "label") -> DataFrame:
    """Feature differences true minus false per pair."""
    side = lambda f, v: F.max(F.when(F.col(label) == v, F.col(f)))
    return answers.groupBy(key).agg(*[(side(f, 1) - side(f, 0)).alias(f"d_{f}") for f in features])


def candidates(audit: DataFrame, key: str = "pair_id", meta: tuple = ()) -> DataFrame:
    """Search frame of one row per pair."""
    negs = sum((F.col(c) for c in ("neg_lead_true", "neg_lead_false", "neg_cnt_true", "neg_cnt_false")), F.lit(0))
    return audit.select(
        F.col(key).alias("example_id"), *meta,
        *[F.col(c).cast("double").alias(c) for c in
          ("neg_lead_true", "neg_lead_false", "neg_cnt_true", "neg_cnt_false")],
        (negs > 0).cast("int").alias("negation_flag"),
        F.col("len_gap").alias("length_gap"),
        F.abs(F.col("hedge_rate_true") - F.col("hedge_rate_false")).alias("hedge_diff"),
        F.abs(F.col("auth_rate_true") - F.col("auth_rate_false")).alias("authority_diff"),
        style_violation().alias("confounded_flag"))


def sampling_pool(audit: DataFrame, true_text: str, false_text: str, min_words: int = 5) -> DataFrame:
    """Confounded pairs with enough words on both sides and no refusal to comment."""
    plain = [~F.startswith(F.lower(text_or_blank(c)), F.lit(NO_COMMENT)) for c in (true_text, false_text)]
    return audit.filter((style_violation() == 1) & (F.col("word_count_true") >= min_words)
                        & (F.col("word_count_false") >= min_words) & plain[0] & plain[1])


def take_pairs(df: DataFrame, ids: DataFrame, key: str = "pair_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def slice_rows(df: DataFrame, start: int = 0, limit: int | None = None, key: str = "pair_id") -> DataFrame:
    """Rows whose dense id lies in [start, start + limit)."""
    low = max(0, start)
    kept = df.filter(F.col(key) >= low)
    return kept if limit is None else kept.filter(F.col(key) < low + limit)


def fill_features(df: DataFrame, features) -> DataFrame:
    return df.na.fill(0.0, list(features))


def null_counts(df: DataFrame, columns) -> DataFrame:
    """(column, n_null): nulls and NaNs per column in one pass."""
    types = dict(df.dtypes)
    missing = lambda c: (F.col(c).isNull() | F.isnan(c)) if types[c] in ("double", "float") else F.col(c).isNull()
    one = df.agg(*[F.count_if(missing(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"))
                                          for c in columns])).alias("r")).select("r.*")


def assert_no_nulls(df: DataFrame, columns) -> DataFrame:
    bad = {r["column"]: r["n_null"] for r in null_counts(df, columns).collect() if r["n_null"]}
    if bad:
        raise ValueError(f"missing values: {bad}")
    return df


def align_by_position(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Row-by-row join of two tables with an explicit dense row id; unequal lengths are an error."""
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        raise ValueError(f"tables differ in length: {n_left} and {n_right}")
    return left.join(right, key)


# --- labelled texts -------------------------------------------------------------------
def split_two_answers(df: DataFrame, order: str, right: str, wrong: str) -> DataFrame:
    """(pair_id, claim_text, label) with blank sides dropped and ids dense after the drop.

    Only the order's key is sorted; the texts join its ranks.
    """
    clean = df.select(order, strip(text_or_blank(right)).alias("__r"), strip(text_or_blank(wrong)).alias("__w"))
    clean = clean.filter((F.col("__r") != "") & (F.col("__w") != ""))
    kept = clean.join(global_rank(clean.select(order), [order], name="__i"), order)
    rows = F.array(F.struct(F.col("__r").alias("claim_text"), F.lit(1).alias("label")),
                   F.struct(F.col("__w").alias("claim_text"), F.lit(0).alias("label")))
    return kept.select((F.col("__i") - 1).alias("pair_id"), F.explode(rows).alias("a")).select("pair_id", "a.*")


def map_labels(df: DataFrame, label: str, mapping: dict[str, int]) -> DataFrame:
    """Upper-cased class names to 1/0; rows of other classes are dropped."""
    up = F.upper(strip(F.col(label).cast("string")))
    value = None
    for name, v in mapping.items():
        value = F.when(up == name, v) if value is None else value.when(up == name, v)
    return df.withColumn("label", value.cast("int")).filter(F.col("label").isNotNull())


def parse_choices(df: DataFrame, targets: str = "mc1_targets") -> DataFrame:
    """Normalised correct answer and wrong list; ``choice_error`` names a bad target."""
    zipped = F.arrays_zip(F.col(f"{targets}.choices").alias("choices"), F.col(f"{targets}.labels").alias("labels"))
    right = F.filter(zipped, lambda x: x["labels"] == 1)
    wrong = F.filter(zipped, lambda x: x["labels"] != 1)
    n = F.size(right)
    return (df.withColumn("correct_norm", F.when(n == 1, normalized_text(F.try_element_at(right, F.lit(1))["choices"])))
              .withColumn("wrong_norm", F.transform(wrong, lambda x: normalized_text(x["choices"])))
              .withColumn("choice_error", F.when(n > 1, "multiple correct labels").when(n == 0, "no correct label")))


# --- completions and replies ----------------------------------------------------------
def assign_order(pairs: DataFrame, seed: int, key: str = "pair_id") -> DataFrame:
    """1 when the true answer is shown as A."""
    return pairs.withColumn("true_is_a", (uniform(seed, "order", key) < 0.5).cast("int"))


def score_completions(df: DataFrame, reply: str = "reply", order: str = "true_is_a") -> DataFrame:
    """Answer letter and correctness; a reply with no letter counts as wrong."""
    letter = cues.answer_letter(F.col(reply))
    right = F.when(F.col(order) == 1, "A").otherwise("B")
    return df.withColumn("choice", letter).withColumn(
        "correct", F.coalesce((F.col("choice") == right).cast("int"), F.lit(0)))


def parse_replies(df: DataFrame, schema: str | T.StructType, reply: str = "reply",
                  required: tuple = (), numeric: tuple = ()) -> DataFrame:
    """First {...} blob of a raw reply as typed columns, with the reason when it fails.

    The blob is read as a string map first, so a bad number becomes a reason, not a lost row.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    blob = F.regexp_extract(text_or_blank(reply), "(?s)\\{.*\\}", 0)
    fields = F.from_json(blob, T.MapType(T.StringType(), T.StringType()))
    out = df.withColumn("__blob", blob).withColumn("__map", fields)
    value = {f.name: F.try_element_at("__map", F.lit(f.name)) for f in struct.fields}
    reason = F.when(F.col("__blob") == "", "no json object").when(F.col("__map").isNull(), "json parse failure")
    for name in required:
        reason = reason.when(value[name].isNull(), f"missing field: {name}")
    for name in numeric:
        reason = reason.when(value[name].isNotNull() & value[name].try_cast("double").isNull(),
                             f"{name} is not a number")
    typed = [value[f.name].try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.ArrayType)
             else F.from_json(value[f.name], f.dataType).alias(f.name) for f in struct.fields]
    return out.select(*df.columns, *typed, reason.alias("parse_error"))


# --- scores ---------------------------------------------------------------------------
def explode_scores(df: DataFrame, scores: str = "scores", key: str = "pair_id") -> DataFrame:
    """Nested {"family_variant": {P_A, P_B}} maps to (pair_id, family, variant, p_a, p_b)."""
    cut = lambda pos: F.regexp_extract("name", "^(.*)_([^_]+)$", pos)
    return (df.select(key, F.explode(scores).alias("name", "s"))
            .select(key, cut(1).alias("family"), cut(2).alias("variant"),
                    F.col("s.P_A").alias("p_a"), F.col("s.P_B").alias("p_b")))


def flat_scores(df: DataFrame, family: str, key: str = "pair_id") -> DataFrame:
    """Flat per-family score files to the same long form."""
    side = [F.struct(F.lit(v).alias("variant"), F.col(f"P_A_truthful_{v}").alias("p_a"),
                     F.col(f"P_B_truthful_{v}").alias("p_b")) for v in ("full", "cleaned")]
    return (df.select(key, F.explode(F.array(*side)).alias("s"))
            .select(key, F.lit(family).alias("family"), "s.*"))


def pivot_scores(scores: DataFrame, families: list[str], variants: list[str] = ("full", "cleaned"),
                 key: str = "pair_id") -> DataFrame:
    """Two columns per (family, variant); missing combinations stay NULL."""
    def pick(side, f, v):
        here = (F.col("family") == f) & (F.col("variant") == v)
        return F.max(F.when(here, F.col(side))).alias(f"{f}_{v}_{side}")
    return scores.groupBy(key).agg(*[pick(s, f, v) for f in families for v in variants for s in ("p_a", "p_b")])


def review_sheet(items: DataFrame, verdicts: DataFrame, scores: DataFrame, key: str,
                 probabilities: list[str], blanks: tuple = ("my_check", "my_notes")) -> DataFrame:
    """Items with verdicts and scores for people to fill in: probabilities as text with 4 decimals."""
    joined = items.join(verdicts, key, "left").join(scores, key, "left")
    shown = {p: F.coalesce(F.format_string("%.4f", F.col(p)), F.lit("")) for p in probabilities}
    shown = {p: F.when(F.col(p).isNull(), "").otherwise(c) for p, c in shown.items()}
    return joined.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in joined.columns],
                         *[F.lit("").alias(b) for b in blanks])


def short_label(name: Column, mapping: dict[str, str] | None = None) -> Column:
    """Label from a mapping, else the part after the last slash."""
    trimmed = strip(name)
    label = F.substring_index(trimmed, "/", -1)
    if mapping:
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        label = F.coalesce(F.try_element_at(table, trimmed), label)
    return label
