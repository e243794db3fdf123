"""How the driver tables stand in for benchmark tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veneer.functions.lexicons import ClaimLexicon, PairLexicon
from veneer.functions.text import PAIR_FEATURES, pair_features, relative_length_gap

# The texts are invented prose, so the cue lists here are frequent words of that prose; the
# operators and their real lexicons are the same (see tests for the real lists).
PAIR_CUES = PairLexicon(
    leads=("the", "it", "la", "der", "that is", "of the"),
    negations=("no", "was", "und", "est", "del", "que"),
    hedges=("this", "mit", "pour", "are the"),
    authority=("of the", "to the", "de l[ae]"),
    temporal=("from", "sich", "une"),
)
CLAIM_CUES = ClaimLexicon(
    leads=("the", "it", "la", "der"), negations=("no", "was", "und", "est", "wasn"),
    refutes=("of the", "to the", "is and"), supports=("in the", "for the"),
    hedges=("this", "mit", "pour"), authority=("of the", "de l[ae]"),
    superlatives=("from", "das", "sur"), generalizations=("with", "los", "auf"),
    contractions=("ha", "nd", "th"))

FEATURES = PAIR_FEATURES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(col) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# --- documents as pairs ---------------------------------------------------------------
def spread(df: DataFrame) -> DataFrame:
    """Give a file with fewer row groups than cores to all cores.

    Text work per row is far dearer than moving the row, but a well-split input is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text")).select(
        "doc_id", "lang", "source", "text", F.expr("doc_id div 2").alias("pair_id"),
        (1 - F.col("doc_id") % 2).cast("int").alias("label"))


def pairs(spark, sf) -> DataFrame:
    """Pair table: even document is the true side, odd one the false side."""
    d = documents(spark, sf)
    side = lambda c, v: F.max(F.when(F.col("label") == v, F.col(c)))
    return d.groupBy("pair_id").agg(side("lang", 1).alias("category"), side("source", 1).alias("question"),
                                    side("text", 1).alias("true_text"), side("text", 0).alias("false_text"))


def doc_features(spark, sf, profile: str = "surface10_text") -> DataFrame:
    """Features before any shuffle: only numbers travel afterwards."""
    return pair_features(documents(spark, sf), "text", profile, PAIR_CUES, keep_length=True).drop("text")


def answers(spark, sf, profile: str = "surface10_text") -> DataFrame:
    """Answer rows (pair_id, label, ten features, lang, source, doc_id)."""
    pair = Window.partitionBy("pair_id")
    n = lambda v: F.max(F.when(F.col("label") == v, F.col("n_chars_text"))).over(pair)
    return (doc_features(spark, sf, profile)
            .withColumn("len_gap", relative_length_gap(F.coalesce(n(1), F.lit(0)), F.coalesce(n(0), F.lit(0))))
            .drop("n_chars_text"))


def audit_table(spark, sf) -> DataFrame:
    """Wide audit table from answer rows: pair_id, category, <feature>_true/_false, len_gap."""
    a = answers(spark, sf)
    side = lambda c, v: F.max(F.when(F.col("label") == v, F.col(c)))
    feats = [f for f in FEATURES if f != "len_gap"]
    return a.groupBy("pair_id").agg(side("lang", 1).alias("category"), F.max("len_gap").alias("len_gap"),
                                    *[side(f, v).alias(f"{f}_{s}") for f in feats for v, s in ((1, "true"), (0, "false"))])


# --- events as predictions ------------------------------------------------------------
def predictions(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat(F.lit("model_predictions_"), F.date_format("ts", "HH"), F.lit(".csv")).alias("source_file"),
        F.col("event_id").alias("row_no"), F.col("event_type").alias("model_name"),
        F.col("user_id").alias("pair_id"), (F.col("value") > 10).cast("int").alias("correct"))


def wide_runs(spark, sf) -> DataFrame:
    """Predictions as one file per half of the day, so that runs cover most pairs."""
    half = F.when(F.hour("ts") < 12, "a.csv").otherwise("b.csv")
    return table(spark, sf, "events").select(
        half.alias("source_file"), F.col("event_id").alias("row_no"), F.col("event_type").alias("model_name"),
        F.col("user_id").alias("pair_id"), (F.col("value") > 10).cast("int").alias("correct"))


# --- orders as probe scores -----------------------------------------------------------
def probe_scores(spark, sf) -> DataFrame:
    """(pair_id, family, variant, strategy, judge_pass, p_a, p_b): two variants per order."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("family"),
        F.col("o_orderstatus").alias("strategy"), (F.col("o_custkey") % 4 != 0).alias("judge_pass"),
        (cents % 101).alias("a"), (F.expr("cast(round(o_totalprice * 100) as bigint) div 101") % 101).alias("b"),
        (F.col("o_custkey") % 41).alias("c"))
    side = F.array(
        F.struct(F.lit("full").alias("variant"), (F.col("a") / 103.0).alias("p_a"), (F.col("b") / 103.0).alias("p_b")),
        F.struct(F.lit("cleaned").alias("variant"), ((F.col("a") + F.col("c")) / 141.0).alias("p_a"),
                 (F.col("b") / 103.0).alias("p_b")))
    return o.select("pair_id", "family", "strategy", "judge_pass", F.explode(side).alias("s")).select(
        "pair_id", "family", "strategy", "judge_pass", "s.*")


# --- SQL twins ------------------------------------------------------------------------
ACCENTS = "[À-ÖØ-öø-ÿ]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_plain(expr: str) -> str:
    """Lower-cased text whose accented letters are ASCII, so \\b means the same in both engines."""
    return f"regexp_replace(lower({expr}), '{ACCENTS}', 'x', 'g')"


def sql_words(col: str, terms) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({col}, {q(chr(92) + 'b' + t + chr(92) + 'b')}))" for t in terms) + ")"


def sql_patterns(col: str, patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({col}, {q(p)}))" for p in patterns) + ")"


def sql_has(col: str, terms) -> str:
    return f"regexp_matches({col}, {q(chr(92) + 'b(?:' + '|'.join(terms) + ')' + chr(92) + 'b')})::INT"


TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')"


def sql_doc_features(profile: str = "surface10_text", lex: PairLexicon = PAIR_CUES) -> str:
    """CTEs d (texts) and f (features per document)."""
    by_text = profile == "surface10_text"
    words = r"len(regexp_extract_all(t, '[^\s]+'))" if by_text else "len(tok)"
    span = "length(t)" if by_text else "len(tok)"
    leads = "^(?:" + "|".join(lex.leads) + r")\b"
    return rf"""d AS (
  SELECT doc_id, lang, source, doc_id // 2 AS pair_id, (1 - doc_id % 2)::INT AS label,
         coalesce(text, '') AS t, {sql_plain("coalesce(text, '')")} AS lo, {TOKENS_SQL} AS tok
  FROM documents),
f0 AS (SELECT *, {words} AS wc FROM d),
f AS (
  SELECT doc_id, lang, source, pair_id, label,
    regexp_matches(regexp_replace(lo, '^\s+', ''), {q(leads)})::INT::DOUBLE AS neg_lead,
    {sql_words('lo', lex.negations)}::DOUBLE AS neg_cnt,
    {sql_words('lo', lex.hedges)} / greatest(1, wc)::DOUBLE AS hedge_rate,
    {sql_patterns('lo', lex.authority)} / greatest(1, wc)::DOUBLE AS auth_rate,
    wc::DOUBLE AS word_count,
    greatest(1, len(regexp_extract_all(t, '[^.!?\s][^.!?]*')))::DOUBLE AS sent_count,
    CASE WHEN len(tok) > 0 THEN length(array_to_string(tok, '')) / len(tok)::DOUBLE ELSE 0 END AS avg_token_len,
    len(list_distinct(tok)) / greatest(1, len(tok))::DOUBLE AS type_token,
    (length(t) - length(translate(t, '?!,', ''))) / greatest(1, {span})::DOUBLE AS punc_rate,
    length(t) AS n_chars
  FROM f0)"""


def sql_answers(profile: str = "surface10_text") -> str:
    """CTE a: answer rows with len_gap."""
    return sql_doc_features(profile) + """,
a AS (
  SELECT f.*, abs(coalesce(n1, 0) - coalesce(n0, 0)) / greatest(coalesce(n1, 0), coalesce(n0, 0), 1)::DOUBLE AS len_gap
  FROM f JOIN (SELECT pair_id, max(n_chars) FILTER (label = 1) n1, max(n_chars) FILTER (label = 0) n0
               FROM f GROUP BY 1) g USING (pair_id))"""


def sql_audit() -> str:
    """CTE w: wide audit table."""
    feats = [f for f in FEATURES if f != "len_gap"]
    sides = ", ".join(f"max({f}) FILTER (label = {v}) AS {f}_{s}" for f in feats for v, s in ((1, "true"), (0, "false")))
    return sql_answers() + f""",
w AS (SELECT pair_id, max(lang) FILTER (label = 1) AS category, max(len_gap) AS len_gap, {sides} FROM a GROUP BY 1)"""


VIOLATION_SQL = """(neg_lead_true = 1 OR neg_lead_false = 1 OR len_gap > {0}
  OR abs(hedge_rate_true - hedge_rate_false) > {1} OR abs(auth_rate_true - auth_rate_false) > {2})::INT"""


def sql_violation(a=0.20, b=0.02, c=0.01) -> str:
    return VIOLATION_SQL.format(a, b, c)


def sql_candidates() -> str:
    """CTE c: search candidates."""
    return sql_audit() + f""",
c AS (
  SELECT pair_id AS example_id, neg_lead_true, neg_lead_false, neg_cnt_true, neg_cnt_false,
    (neg_lead_true + neg_lead_false + neg_cnt_true + neg_cnt_false > 0)::INT AS negation_flag,
    len_gap AS length_gap, abs(hedge_rate_true - hedge_rate_false) AS hedge_diff,
    abs(auth_rate_true - auth_rate_false) AS authority_diff, {sql_violation()} AS confounded_flag
  FROM w)"""


PREDICTIONS_SQL = """p AS (
  SELECT 'model_predictions_' || strftime(ts, '%H') || '.csv' AS source_file, event_id AS row_no,
         event_type AS model_name, user_id AS pair_id, (value > 10)::INT AS correct
  FROM events)"""
WIDE_RUNS_SQL = """p AS (
  SELECT CASE WHEN hour(ts) < 12 THEN 'a.csv' ELSE 'b.csv' END AS source_file, event_id AS row_no,
         event_type AS model_name, user_id AS pair_id, (value > 10)::INT AS correct
  FROM events)"""
SCORES_SQL = """s AS (
  WITH o AS (SELECT o_orderkey AS pair_id, o_orderpriority AS family, o_orderstatus AS strategy,
                    o_custkey % 4 <> 0 AS judge_pass, round(o_totalprice * 100)::BIGINT % 101 AS a,
                    (round(o_totalprice * 100)::BIGINT // 101) % 101 AS b, o_custkey % 41 AS c FROM orders)
  SELECT pair_id, family, strategy, judge_pass, 'full' AS variant, a / 103.0::DOUBLE AS p_a, b / 103.0::DOUBLE AS p_b FROM o
  UNION ALL
  SELECT pair_id, family, strategy, judge_pass, 'cleaned', (a + c) / 141.0::DOUBLE, b / 103.0::DOUBLE FROM o)"""


def sql_draw(seed: str, stream: str, key: str) -> str:
    """52-bit draw; arguments are SQL expressions of text type."""
    return f"('0x' || substr(md5({seed} || ':' || {stream} || ':' || {key}), 1, 13))::BIGINT"


def auc_sql(source: str, score: str, label: str, by: str = "") -> str:
    """Rank AUC per group from tie-averaged ranks."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    cols = f"{by}," if by else ""
    return f"""SELECT {cols} CASE WHEN min(np) > 0 AND min(nn) > 0 THEN
  (sum(rk) FILTER (y = 1) - min(np) * (min(np) + 1) / 2.0) / min(np) / min(nn) END AS auc,
  min(np) AS n_pos, min(nn) AS n_neg
FROM (SELECT {cols} {label} AS y,
        rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {cols} {score}) - 1) / 2.0 AS rk,
        count(*) FILTER ({label} = 1) OVER ({part}) AS np, count(*) FILTER ({label} = 0) OVER ({part}) AS nn
      FROM {source}) {group}"""
