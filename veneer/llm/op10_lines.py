"""Deletes later copies of line runs, found in the suffix array of line ids by prefix doubling.

A suffix starts at every line. After round k suffixes that agree in their first 2^k lines share a class, an interval of
the suffix array with a common prefix of that length; it is named by its first member in (id, line) order. Only classes
with two members or more go on, so lines that occur once drop out before the first round. A run of `min_words` words or
more that occurs earlier is a chain of least such windows, and two overlapping intervals of the doubling name a window
of any length. Everything is DataFrame columns; texts are read, hashed by line and never shuffled until the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veneer.llm.common import cut_lineage, table, texts, words_of

MIN_WORDS = 50
_DOC = ["id", "th"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line: two hashes name it, so that equal names mean equal lines at any corpus size."""
    return (docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .select("id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
                    F.size(words_of(F.col("line"))).cast("long").alias("nw")))


def _place(pos: str = "pos") -> Column:
    """Position in the corpus; null ids come first."""
    return F.struct("id", "th", F.col(pos).alias("pos"))


def _repeated(lines: DataFrame) -> DataFrame:
    """Lines that occur twice or more, each with the first place of its class."""
    classes = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # as a table of its own, so that the join can split the partitions of lines that are very common
    classes = cut_lineage(classes.drop("n"))
    return (lines.join(classes, ["h1", "h2"]).select("id", "th", "pos", "nw", "name")
            .repartition(*_DOC).dropDuplicates([*_DOC, "pos"]))  # rows given twice are one document


def _least_windows(active: DataFrame, min_words: int) -> DataFrame:
    """From every line on, and up to every line, the least run of repeated lines with `min_words` words: id, th, start, len."""
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    run = Window.partitionBy(*_DOC, "run")
    rows = (active.withColumn("run", F.col("pos") - F.row_number().over(doc))
            .withColumn("words_to", F.sum("nw").over(run.orderBy("pos")))
            .withColumn("total", F.max("words_to").over(run)).withColumn("last", F.max("pos").over(run))
            .filter(F.col("total") >= min_words))
    before = F.col("words_to") - F.col("nw")
    mark = lambda value, kind, at: F.struct(value.alias("value"), F.lit(kind).alias("kind"), at.alias("at"))
    marks = F.array(mark(before, 0, F.col("pos")), mark(before + min_words, 1, F.col("pos")),
                    mark(F.col("words_to") - min_words, 2, F.col("pos") + 1))
    end = F.when(F.col("pos") == F.col("last"), F.array(mark(F.col("total"), 0, F.col("pos") + 1)))
    points = rows.select(*_DOC, "run", F.explode(F.concat(marks, F.coalesce(end, F.array().cast(
        "array<struct<value:bigint,kind:int,at:int>>")))).alias("m")).select(*_DOC, "run", "m.*")
    bound = F.when(F.col("kind") == 0, F.col("at"))
    up = run.orderBy(F.col("value").desc(), "kind", F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = run.orderBy("value", "kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumns({"above": F.last(bound, True).over(up), "below": F.last(bound, True).over(down)})
    ends = found.select(*_DOC, F.when(F.col("kind") == 1, F.col("at")).otherwise(F.col("below")).alias("start"),
                        F.when(F.col("kind") == 1, F.col("above")).otherwise(F.col("at")).alias("stop"), "kind")
    return (ends.filter("kind > 0 AND start IS NOT NULL AND stop IS NOT NULL")
            .select(*_DOC, "start", (F.col("stop") - F.col("start")).alias("len")).dropDuplicates())


def _doubled(names: DataFrame, step: int) -> DataFrame:
    """Classes of prefixes twice as long, without those of one member."""
    ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(step, step)
    pairs = names.withColumn("next", F.first("name").over(ahead)).filter(F.col("next").isNotNull())
    classes = pairs.groupBy("name", "next").agg(F.min(_place()).alias("joint"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (pairs.join(classes.drop("n"), ["name", "next"])
            .select("id", "th", "pos", F.col("joint").alias("name")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, th, start, len: the least windows that occur at an earlier place of the corpus. `docs` has id, th, text."""
    spark = docs.sparkSession
    active = cut_lineage(_repeated(_lines(docs)))
    windows = cut_lineage(_least_windows(active, min_words))
    longest = windows.agg(F.max("len")).first()[0]
    if longest is None:
        return windows
    level, step, names = active.select("id", "th", "pos", "name"), 1, None
    while True:
        tagged = level.withColumn("step", F.lit(step))
        names = tagged if names is None else names.unionByName(tagged)
        if 2 * step > longest:
            break
        level = cut_lineage(_doubled(level, step))
        step *= 2
    # a window of any length is two overlapping prefixes of the largest power of two in it
    size = F.pow(F.lit(2), F.floor(F.log2("len"))).cast("int")
    windows = windows.withColumn("step", size).withColumn("tail", (F.col("start") + F.col("len") - F.col("step")))
    head = names.select(*_DOC, "step", F.col("pos").alias("start"), F.col("name").alias("head"))
    tail = names.select(*_DOC, "step", F.col("pos").alias("tail"), F.col("name").alias("end"))
    same = lambda a, b, *keys: a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    named = same(windows.alias("a"), head.alias("b"), *_DOC, "step", "start").select("a.*", "b.head")
    named = same(named.alias("a"), tail.alias("b"), *_DOC, "step", "tail").select("a.id", "a.th", "a.start", "a.len", "a.head", "b.end")
    named = cut_lineage(named)
    first = named.groupBy("len", "head", "end").agg(F.min(_place("start")).alias("first"))
    return (named.join(first, ["len", "head", "end"])
            .filter((F.col("first.pos") != F.col("start")) | ~F.col("first.id").eqNullSafe(F.col("id")) | (F.col("first.th") != F.col("th")))
            .select("id", "th", "start", "len"))


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (struct of all input columns), n_lines, removed (line numbers from 0, ascending), kept_text; one row per row.

    A line goes if it lies in a run of whole lines with at least `min_words` words that occurs at an earlier place (by
    id, then line); the first copy stays. In a text that repeats itself a later copy may overlap the first: the shared
    lines go. Null texts stay null and empty ones empty. Rows of equal id and text are one document and get equal
    results; null ids come first in the order, with the text's hash to tell them apart. An empty table gives no rows.
    Other input columns, whatever they are called, only travel inside `doc`.
    """
    docs = texts(df, id_col, text_col).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    later = repeated_runs(docs, min_words)
    lines = F.flatten(F.transform(F.collect_list(F.struct("start", "len")),
                                  lambda w: F.sequence(w["start"], w["start"] + w["len"] - 1)))
    gone = later.groupBy("id", "th").agg(F.array_sort(F.array_distinct(lines)).alias("removed"))
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), F.col(text_col).alias("text"),
                      F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_th"))
    joined = whole.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")), "left")
    split, removed = F.split("text", "\n"), F.col("removed")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(removed, i)), "\n")
    return joined.select(
        "doc", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"),
        F.coalesce(removed, F.array().cast("array<int>")).alias("removed"),
        F.when(removed.isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
                      F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": query}

#: The same windows by running sums, each written out as its text.
SQL = """
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
     w AS (SELECT doc_id, i, a[i] AS line, len(list_filter(string_split_regex(a[i], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS nw FROM l),
     c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
     f AS (SELECT s.doc_id, s.i AS a, min(e.i) AS b FROM c s JOIN c e ON s.doc_id = e.doc_id AND e.i >= s.i AND e.upto >= s.upto - s.nw + 50 GROUP BY ALL
           UNION
           SELECT e.doc_id, max(s.i), e.i FROM c s JOIN c e ON s.doc_id = e.doc_id AND e.i >= s.i AND e.upto >= s.upto - s.nw + 50 GROUP BY ALL),
     t AS (SELECT f.doc_id, a, b, (SELECT string_agg(line, chr(10) ORDER BY i) FROM c WHERE c.doc_id = f.doc_id AND c.i BETWEEN a AND b) AS body FROM f),
     g AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS k FROM t),
     gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM g WHERE k > 1)
SELECT w.doc_id, count(*)::BIGINT AS n_lines, count(gone.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY w.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id
"""
ORACLES = {"op10_line_dedup": SQL}
