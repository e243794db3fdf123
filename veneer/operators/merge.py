"""De-duplication, merges, joins with coverage checks, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.operators.ordering import top_k

PREDICTION_KEY = ("model_name", "pair_id")


def _keep(df: DataFrame, by: list[str], order: Column, last: bool) -> DataFrame:
    """First or last row per key as a map-side combining aggregate (no window).

    Numbers are kept one by one: such state has a fixed width, so it is hashed, while a struct's would be sorted with all
    rows of a task. Each number follows the same order and so comes from the same row.
    """
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if last else F.min_by
    kinds = dict(df.select(*rest, order.alias("__o")).dtypes)
    if set(kinds.values()) <= {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}:
        return df.groupBy(*by).agg(*[pick(F.col(c), order).alias(c) for c in rest]).select(*df.columns)
    return df.groupBy(*by).agg(pick(F.struct(*rest), order).alias("__r")).select(*by, "__r.*").select(*df.columns)


def bounded_ids(df: DataFrame, n: int | Column, key: str = "pair_id") -> DataFrame:
    return df.filter((F.col(key) >= 0) & (F.col(key) < n))


def first_in_file(preds: DataFrame) -> DataFrame:
    return _keep(preds, ["source_file", *PREDICTION_KEY], F.col("row_no"), last=False)


def last_in_file(preds: DataFrame) -> DataFrame:
    return _keep(preds, ["source_file", *PREDICTION_KEY], F.col("row_no"), last=True)


def last_wins(preds: DataFrame) -> DataFrame:
    """Last row of the last file (by name) per (model, pair)."""
    return _keep(preds, list(PREDICTION_KEY), F.struct("source_file", "row_no"), last=True)


def first_in_file_last_file(preds: DataFrame) -> DataFrame:
    """First row inside each file, then the last file; one aggregate for numeric row numbers."""
    if dict(preds.dtypes)["row_no"] not in ("int", "bigint"):
        return _keep(first_in_file(preds), list(PREDICTION_KEY), F.col("source_file"), last=True)
    best = F.max_by(F.struct("source_file", "row_no", "correct"), F.struct(F.col("source_file"), -F.col("row_no")))
    return (preds.groupBy(*PREDICTION_KEY).agg(best.alias("__r"))
            .select(*PREDICTION_KEY, "__r.*").select(*preds.columns))


def merge_predictions(preds: DataFrame, within_file: str = "last", across_files: str = "last") -> DataFrame:
    """One row per (model, pair), or per (file, model, pair) with ``across_files='keep'``."""
    if within_file not in ("first", "last") or across_files not in ("last", "keep"):
        raise ValueError("within_file is first|last, across_files is last|keep")
    if across_files == "keep":
        return first_in_file(preds) if within_file == "first" else last_in_file(preds)
    return first_in_file_last_file(preds) if within_file == "first" else last_wins(preds)


def duplicate_report(preds: DataFrame) -> DataFrame:
    """Rows read, kept per (file, model, pair), kept per (model, pair) and dropped."""
    per_file = preds.groupBy("source_file", *PREDICTION_KEY).agg(F.count(F.lit(1)).alias("n"))
    per_key = per_file.groupBy(*PREDICTION_KEY).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))
    return per_key.agg(F.sum("n").alias("rows_read"), F.sum("files").alias("rows_per_file"),
                       F.count(F.lit(1)).alias("rows_merged"),
                       (F.sum("n") - F.count(F.lit(1))).alias("rows_dropped"))


def first_positions(df: DataFrame, text: str, order: str) -> DataFrame:
    """The least ``order`` of every distinct text; texts meet by their 256-bit digests, not by themselves."""
    digest = F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("__d")
    return df.groupBy(digest).agg(F.min(order).alias(order)).select(order)


def first_seen(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of every distinct text (NULL is one); ``order`` is unique."""
    return df.join(first_positions(df, text, order), order, "left_semi").select(*df.columns)


def distinct_ignoring_case(df: DataFrame, text: str, order: str) -> DataFrame:
    """First written form of every text, compared without case; blanks dropped."""
    keyed = df.filter(F.col(text) != "").select(F.lower(text).alias("__k"), text, order)
    return _keep(keyed, ["__k"], F.col(order), last=False).drop("__k")


def common_pairs(merged: DataFrame) -> DataFrame:
    """Pairs that every model answered."""
    models = merged.agg(F.count_distinct("model_name")).scalar()
    per_pair = merged.groupBy("pair_id").agg(F.count_distinct("model_name").alias("__m"))
    return per_pair.filter(F.col("__m") == models).select("pair_id")


def prioritized_merge(records: DataFrame, key: str, priority: str, passes: str) -> DataFrame:
    """Earlier source wins unless only a later one passes; ids that never pass are dropped."""
    best = _keep(records, [key], F.struct((~F.col(passes)).cast("int"), F.col(priority)), last=False)
    return best.filter(F.col(passes))


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def match_status(matches: DataFrame, row: str, matched: str) -> DataFrame:
    """matched for the first row of an id, duplicate_pair_id_skipped for later ones, else unmatched."""
    first = matches.filter(F.col(matched).isNotNull()).groupBy(matched).agg(F.min(row).alias("__first"))
    return (matches.join(first, matched, "left")
            .withColumn("status", F.when(F.col(matched).isNull(), "unmatched")
                        .when(F.col(row) == F.col("__first"), "matched")
                        .otherwise("duplicate_pair_id_skipped"))
            .drop("__first").select(*matches.columns, "status"))


def match_anchors(queries: DataFrame, pairs: DataFrame, row: str = "row_id") -> DataFrame:
    """First pair with equal question and answer keys whose incorrect answer is in the wrong list.

    queries(row, q_key, a_key, wrongs), pairs(pair_id, q_key, a_key, incorrect_key). The wrong answers are postings:
    each meets the one least pair of its three keys, so no row is made that doesn't fit, however common a question is.
    """
    least = pairs.groupBy("q_key", "a_key", "incorrect_key").agg(F.min("pair_id").alias("pair_id"))
    postings = queries.select(row, "q_key", "a_key", F.explode(F.array_distinct("wrongs")).alias("incorrect_key"))
    first = postings.join(least, ["q_key", "a_key", "incorrect_key"]).groupBy(row).agg(F.min("pair_id").alias("pair_id"))
    return match_status(queries.select(row).join(first, row, "left"), row, "pair_id")


# --- coverage -------------------------------------------------------------------------
def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of ids on both sides, missing on the right, extra on the right."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("n_both"),
                    F.count_if(F.col("__r").isNull()).alias("n_missing"),
                    F.count_if(F.col("__l").isNull()).alias("n_extra"))


def join_covering(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that demands equal id sets on both sides."""
    c = coverage(left, right, key).first()
    if c["n_missing"] or c["n_extra"]:
        raise ValueError(f"id sets differ on {key}: {c['n_missing']} missing, {c['n_extra']} extra")
    return left.join(right, key)


def left_with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    return left.join(right, key, "left").na.fill(defaults)


def source_status(expected: DataFrame, families: DataFrame, scores: DataFrame, key: str = "pair_id",
                  first: int = 5) -> DataFrame:
    """Per family: ok, missing (no rows at all) or incomplete, with the first missing ids.

    Missing ids come from counts and an anti join against the expected ids per family.
    """
    have = scores.join(expected.select(key), key, "left_semi").select("family", key).distinct()
    counts = have.groupBy("family").agg(F.count(F.lit(1)).alias("n_present"))
    listed = scores.select("family").distinct().withColumn("__any", F.lit(True))
    names = [r["family"] for r in families.select("family").distinct().collect()]  # one row per model family
    wanted = expected.select(key).withColumn("family", F.explode(F.array(*[F.lit(n) for n in sorted(names)])))
    absent = wanted.join(have, ["family", key], "left_anti")
    leading = (top_k(absent, first, [F.col(key)], by=["family"], salt_on=key)
               .groupBy("family").agg(F.array_sort(F.collect_list(key)).alias("first_missing")))  # at most `first`
    missing = absent.groupBy("family").agg(F.count(F.lit(1)).alias("n_missing")).join(leading, "family")
    total = expected.agg(F.count(F.lit(1))).scalar()
    return (families.select("family").distinct().join(counts, "family", "left")
            .join(listed, "family", "left").join(missing, "family", "left")
            .select("family",
                    F.when(F.col("__any").isNull(), "missing")
                     .when(F.coalesce("n_present", F.lit(0)) < total, "incomplete").otherwise("ok").alias("status"),
                    F.coalesce("n_present", F.lit(0)).alias("n_present"),
                    F.coalesce("n_missing", F.lit(0)).alias("n_missing"), "first_missing"))


def set_difference_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids only in a, only in b, in both, and whether the sets are equal."""
    c = coverage(a, b, key)
    return c.select(F.col("n_missing").alias("only_left"), F.col("n_extra").alias("only_right"),
                    F.col("n_both").alias("in_both"),
                    ((F.col("n_missing") == 0) & (F.col("n_extra") == 0)).alias("equal"))


def containment(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """How many ids of ``inner`` lie in ``outer`` (overlap) and how many do not (outside)."""
    seen = outer.select(key).distinct().withColumn("__in", F.lit(1))
    return (inner.select(key).distinct().join(seen, key, "left")
            .agg(F.count("__in").alias("n_overlap"), F.count_if(F.col("__in").isNull()).alias("n_outside"))
            .withColumn("contained", F.col("n_outside") == 0))


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """(column, n, max_abs_diff, n_over) of two tables joined on a key."""
    right = b.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    gaps = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.col(c) - F.col(f"__{c}")).alias("gap"))
                     for c in columns])
    return (a.join(right, key).select(F.explode(gaps).alias("g")).groupBy("g.column")
            .agg(F.count("g.gap").alias("n"), F.max("g.gap").alias("max_abs_diff"),
                 F.count_if(F.col("g.gap") > tolerance).alias("n_over")))


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-free content fingerprint: row count and two sums over 32-bit halves of row hashes."""
    h = F.xxhash64(*(columns or sorted(df.columns)))
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low_sum"),
                  F.sum(F.shiftrightunsigned(h, 32)).alias("high_sum"))


def unmatched(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def union_sources(frames: dict[str, DataFrame], name: str = "source") -> DataFrame:
    out = None
    for source, frame in frames.items():
        tagged = frame.withColumn(name, F.lit(source))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def text_mismatches(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Rows of two sources whose texts differ after trimming."""
    return (a.select(key, F.trim(left).alias("left_text"))
            .join(b.select(key, F.trim(right).alias("right_text")), key)
            .filter(~F.col("left_text").eqNullSafe(F.col("right_text"))))
