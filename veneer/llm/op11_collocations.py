"""Phrases of two and three words that hold together, from depth-truncated suffix trees by vertical partitioning.

The prefixes of suffixes are counted by word: one word first, then two, and only prefixes that reach `min_count` go on.
Prefixes of two words are dealt into groups of at most `budget` suffixes, by ranges of their hashes; a prefix with more
suffixes than that is extended by its third word and spread over several groups. Every suffix below such a prefix goes
to its group, cut off after three words, and each group's subtree is built by itself: its leaves are the runs of equal
suffixes in sorted order, and a leaf's total is the count of its phrase. Equal suffixes of a task travel as one row with
a count, so a phrase that fills a third of all texts is a few rows.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veneer.llm.common import scratch_path, table
from veneer.llm.id_filter import IdFilter
from veneer.llm.shingles import mixed
from veneer.llm.word_arrays import LOWER, byte_strings, counted, joined, parts, span_hashes, spans, word_bytes

# fixed values: what ends a piece, what separates the words of a piece
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_WORD = word_bytes(BREAKS + BLANKS)
_BREAK = ~word_bytes(BREAKS)
#: Words (or n-grams) that a task counts before it sends them on.
HELD = 1 << 20
#: Suffixes of a group.
BUDGET = 1 << 20


def _salt(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def _words(batch):
    """(bytes, starts, ends, hashes salted with the language, piece numbers, languages by row, rows) of parts of a batch."""
    langs = batch.column("lang").to_pylist()
    salts = {x: _salt(x) for x in set(langs)}
    for at, end, raw, bounds in parts(batch.column("text")):
        raw = LOWER[raw]
        starts, ends, row = spans(_WORD[raw], bounds)
        salt = np.array([salts[x] for x in langs[at:end]], np.uint64)
        yield raw, starts, ends, mixed(span_hashes(raw, starts, ends) + salt[row]), np.cumsum(_BREAK[raw])[starts] + row, langs[at:end], row


def _saved(df: DataFrame, name: str) -> DataFrame:
    """A written table in the shared folder, so that later steps never go back to the texts."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, h, n of every word."""
    def merged(held):
        h, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        at, n = counted([h], n)
        langs, words = (pa.concat_arrays([x[k] for x in held]).take(pa.array(at)) for k in (2, 3))
        return pa.RecordBatch.from_arrays([langs, words, pa.array(h[at].view(np.int64)), pa.array(n, pa.int64())], ["lang", "word", "h", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for raw, starts, ends, h, _, langs, row in _words(batch):
                at, n = counted([h])
                held.append((h[at], n, pa.array(langs).take(pa.array(row[at])), byte_strings(raw, starts[at], ends[at])))
                size += len(at)
                if size >= HELD // 2:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    rows = docs.mapInArrow(run, "lang string, word string, h long, n long")
    return rows.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class _Counter:
    """Distinct rows with counts of what a task has read so far; full ones are given back."""

    def __init__(self, width: int):
        self.width, self.rows, self.held = width, [], 0

    def add(self, columns: list[np.ndarray]) -> np.ndarray | None:
        self.rows.append(columns)
        self.held += len(columns[0])
        return self.take() if self.held >= HELD else None

    def take(self):
        columns = [np.concatenate([r[k] for r in self.rows]) if self.rows else np.zeros(0, np.uint64) for k in range(self.width)]
        self.rows, self.held = [], 0
        at, n = counted(columns)
        return [c[at] for c in columns], n


def _chains(batch, known: IdFilter):
    """Hashes of the words of a batch, and where a word and its successor in the same piece are both known."""
    for _, _, _, h, piece, _, _ in _words(batch):
        sure = known.passing(h.view(np.int64))
        yield h, (piece[1:] == piece[:-1]) & sure[1:] & sure[:-1]


def _pair_counts(docs: DataFrame, words: DataFrame) -> DataFrame:
    """h1, h2, n of neighbours in a piece; most with rare words are left out."""
    known = docs.sparkSession.sparkContext.broadcast(IdFilter.of(words, "h"))

    def rows(found):
        (h1, h2), n = found
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n, pa.int64())], ["h1", "h2", "n"])

    def run(batches):
        held = _Counter(2)
        for batch in batches:
            for h, chained in _chains(batch, known.value):
                at = np.flatnonzero(chained)
                if full := held.add([h[at], h[at + 1]]):
                    yield rows(full)
        yield rows(held.take())

    return docs.mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def prefix_groups(prefixes: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First hashes of the groups' ranges, hashes of the prefixes that are too large for a group, and into how many
    groups each of these is spread. `prefixes` has k and n; all three are as long as sum(n) / budget."""
    ranged = _saved(prefixes.repartitionByRange("k").select("k", "n", F.spark_partition_id().alias("part")), "prefix-ranges")
    sums = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row per partition
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]
    offset = reduce(lambda c, p: c.when(F.col("part") == p, before[p]), before, F.when(F.lit(False), 0))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    groups = ranged.withColumn("g", F.floor((F.coalesce(upto, F.lit(0)) + offset) / budget)).groupBy("g").agg(F.min("k").alias("k"))
    bounds = np.sort(np.array([r["k"] for r in groups.select("k").collect()], np.int64))
    large = sorted((r["k"], -(-r["n"] // budget)) for r in ranged.filter(F.col("n") > budget).select("k", "n").collect())
    return bounds, np.array([k for k, _ in large], np.int64), np.array([n for _, n in large], np.int64)


class Groups:
    """The group of each suffix."""

    def __init__(self, bounds: np.ndarray, large: np.ndarray, spread: np.ndarray):
        self.bounds, self.large, self.spread = bounds, large, spread
        self.first = len(bounds) + np.cumsum(spread) - spread

    def of(self, prefix: np.ndarray, third: np.ndarray) -> np.ndarray:
        group = np.maximum(np.searchsorted(self.bounds, prefix, "right") - 1, 0)
        if len(self.large):
            at = np.minimum(np.searchsorted(self.large, prefix), len(self.large) - 1)
            split = self.large[at] == prefix
            part = (mixed(third[split]) % self.spread[at[split]].astype(np.uint64)).astype(np.int64)
            group[split] = self.first[at[split]] + part
        return group


def subtree_leaves(suffixes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Leaves of the subtree of a group, in order, and their totals: sorted suffixes of one kind are one leaf."""
    order = np.lexsort(suffixes[::-1])
    columns = [c[order] for c in suffixes]
    new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at)


def _triple_counts(docs: DataFrame, pairs: DataFrame, min_count: int, budget: int) -> DataFrame:
    """h1, h2, h3, n of phrases of three words with `min_count` occurrences: leaf totals of the groups' subtrees."""
    def hashed(batches):
        for batch in batches:
            k = joined(batch.column("h1").to_numpy().view(np.uint64), batch.column("h2").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column("n")], ["k", "n"])

    spark = docs.sparkSession
    prefixes = _saved(pairs.select("h1", "h2", "n").mapInArrow(hashed, "k long, n long"), "prefixes")
    groups = spark.sparkContext.broadcast(Groups(*prefix_groups(prefixes, budget)))
    known = spark.sparkContext.broadcast(IdFilter.of(prefixes, "k"))
    names = ["g", "h1", "h2", "h3", "n"]

    def rows(found):
        (h1, h2, h3), n = found
        own = groups.value.of(joined(h1, h2).view(np.int64), h3)
        return pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(h.view(np.int64)) for h in (h1, h2, h3)], pa.array(n, pa.int64())], names)

    def suffixes(batches):
        held = _Counter(3)
        for batch in batches:
            for _, _, _, h, piece, _, _ in _words(batch):
                same = np.flatnonzero(piece[1:] == piece[:-1])
                ok = np.zeros(len(h) + 1, bool)
                ok[same] = known.value.passing(joined(h[same], h[same + 1]).view(np.int64))
                at = np.flatnonzero(ok[:-1] & ok[1:])
                if full := held.add([h[at], h[at + 1], h[at + 2]]):
                    yield rows(full)
        yield rows(held.take())

    def leaves(held):
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in names]
        found, total = subtree_leaves(columns[1:4], columns[4])
        keep = total >= min_count
        return pa.RecordBatch.from_arrays([*[pa.array(c[keep]) for c in found], pa.array(total[keep])], names[1:])

    def subtrees(batches):
        held: list = []  # rows of one group, which is as large as the budget at most
        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if held and held[0].column("g")[0].as_py() != g[a]:
                    yield leaves(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield leaves(held)

    sent = docs.mapInArrow(suffixes, "g long, h1 long, h2 long, h3 long, n long")
    return sent.repartition("g").sortWithinPartitions("g").mapInArrow(subtrees, "h1 long, h2 long, h3 long, n long")


def _score(a, left, right):
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  exact up to 10^15 occurrences
    return (F.call_function("div", (wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"),
                            (wide(left) * wide(right)).cast("decimal(38,0)")))


def collocations(df: DataFrame, min_count: int = 10, top: int = 2000, percent: int = 50, budget: int = BUDGET,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score, count and bytes.

    `a` counts the phrase, `l` and `r` the two parts of its weakest cut, `n` all words of the language; score is
    floor(1,000,000 a^2 / (l r)). Phrases of two words go if a phrase of three words around them has `percent` % of
    their occurrences. Null and empty texts have no words; a null language is `und`; rows given twice count twice; tied
    cuts are decided by the shorter first part. Other columns are ignored; no rows give no rows.
    """
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = _saved(_word_counts(docs), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))  # a row per language
    one = _saved(words.filter(F.col("n") >= min_count).select("lang", "word", "h", F.col("n").alias("f")), "frequent-words")
    if not one.groupBy("h").count().filter("count > 1").isEmpty():
        raise ValueError("two words have the same hash")
    two = _saved(_pair_counts(docs, one).filter(F.col("n") >= min_count), "pairs")
    three = _saved(_triple_counts(docs, two, min_count, budget), "triples")

    word = lambda k: one.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    pair = lambda i, k: two.select(F.col("h1").alias(f"h{i}"), F.col("h2").alias(f"h{k}"), F.col("n").alias(f"f{i}{k}"))
    inside = three.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "n")
    longest = inside.groupBy("p.h1", "p.h2").agg(F.max("n").alias("longer"))
    pairs = (two.withColumnRenamed("n", "a").join(longest, ["h1", "h2"], "left")
             .filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
             .join(word(1), "h1").join(word(2), "h2").join(one.select(F.col("h").alias("h1"), "lang"), "h1")
             .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
             .withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))))
    triples = (three.withColumnRenamed("n", "a").join(pair(1, 2), ["h1", "h2"]).join(pair(2, 3), ["h2", "h3"])
               .join(word(1), "h1").join(word(2), "h2").join(word(3), "h3").join(one.select(F.col("h").alias("h1"), "lang"), "h1"))
    cut = lambda k, left, right: F.struct(_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"),
                                          F.col(left).alias("l"), F.col(right).alias("r"))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                             F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = pairs.unionByName(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first in shares of a language, then among the firsts of all its shares
    found = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    firsts = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return (ranked.join(F.broadcast(sizes), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))


QUERIES = {"op11_phrase_collocations": query}

#: Every run of up to three words written out and counted; products in 128 bits.
SQL = r"""
WITH p AS (SELECT coalesce(CAST(lang AS VARCHAR), 'und') AS lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
     g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM s),
     f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
     f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
     f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
     n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
     longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
     c2 AS (SELECT a.lang, a.w1 || ' ' || a.w2 AS phrase, a.f AS a, x.f AS l, y.f AS r, 1 AS k
            FROM f2 a JOIN f1 x ON a.lang = x.lang AND a.w1 = x.w1 JOIN f1 y ON a.lang = y.lang AND a.w2 = y.w1
                 LEFT JOIN longer b ON a.lang = b.lang AND a.w1 = b.w1 AND a.w2 = b.w2
            WHERE a.f >= 10 AND NOT coalesce(100 * b.f >= 50 * a.f, false)),
     c3 AS (SELECT a.lang, a.w1 || ' ' || a.w2 || ' ' || a.w3 AS phrase, a.f AS a, unnest([x.f, p.f]) AS l, unnest([q.f, z.f]) AS r, unnest([1, 2]) AS k
            FROM f3 a JOIN f1 x ON a.lang = x.lang AND a.w1 = x.w1 JOIN f1 z ON a.lang = z.lang AND a.w3 = z.w1
                 JOIN f2 p ON a.lang = p.lang AND a.w1 = p.w1 AND a.w2 = p.w2 JOIN f2 q ON a.lang = q.lang AND a.w2 = q.w1 AND a.w3 = q.w2),
     c AS (SELECT *, (1000000 * a::HUGEINT * a) // (l::HUGEINT * r) AS score FROM (SELECT * FROM c2 UNION ALL SELECT * FROM c3)),
     weakest AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
ORACLES = {"op11_phrase_collocations": SQL}
