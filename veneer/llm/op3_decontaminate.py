"""Benchmark decontamination by Wu-Manber search over words.

All windows of equal length are searched together: a table over blocks of words tells how far the search may jump, the
block that ends a window selects the few windows to test, and a direct comparison confirms them. Texts stay where they
are read; only the windows travel, in blocks of a fixed number of windows, one pass over the texts per block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.llm.common import table

#: Word bytes: 0-9, a-z and everything from 0x80 on; A-Z are lower-cased first, the rest separates words.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def windows(text: bytes | None, size: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of `size` words; a shorter text with words is one window, a text without words none."""
    w = words(text)
    if w:
        for i in range(max(1, len(w) - size + 1)):
            yield tuple(w[i:i + size])


class WuManber:
    """Multi-pattern search for word tuples of one common length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = len(next(iter(patterns)))
        self.block = min(3, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = pattern[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
            self.buckets[pattern[self.length - self.block:]].append((list(pattern), items))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(end, items) of every occurrence."""
        m, b, shift, jump = self.length, self.block, self.shift, self.jump
        end, n = m, len(w)
        while end <= n:
            key = tuple(w[end - b:end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            for pattern, items in self.buckets[key]:
                if w[end - m:end] == pattern:
                    yield end, items
            end += 1


def _searchers(rows: Iterable[tuple[str, list[bytes]]]) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, pattern in rows:
        by_length[len(pattern)][tuple(pattern)].add(item)
    return [WuManber(p) for _, p in sorted(by_length.items())]


def _hits(w: list[bytes], searchers: list[WuManber]) -> tuple[list[int], set[str]]:
    """Merged [start, end, start, end...] of the hit words, and the items."""
    found, items = [], set()
    for s in searchers:
        for end, names in s.search(w):
            found.append((end - s.length, end))
            items |= names
    return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan(docs: DataFrame, rows: list[tuple[str, list[bytes]]]) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row_hash", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def scan(batches):
        searchers = _searchers(shared.value)
        for batch in batches:
            n, spans, items = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                w = words(text.as_py())
                s, i = _hits(w, searchers)
                n.append(len(w))
                spans.append(s)
                items.append(sorted(i))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()),
                 pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "row_hash", "n_words", "spans", "items"])

    return docs.select("doc_id", "row_hash", "text").mapInArrow(scan, schema)


def _window_rows(benchmark: DataFrame, size: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            rows = [(i.as_py(), list(w)) for i, t in zip(batch.column("item"), batch.column("text").cast(pa.binary()))
                    for w in windows(t.as_py(), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["item", "words"])

    return benchmark.mapInArrow(cut, "item string, words array<binary>").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = 50_000,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """doc_id, row_hash (of the text), n_words, spans (merged [start, end) word positions, flat), n_hit, items,
    contaminated; one row per row.

    Null and empty texts have no words and no hits; items without words have no windows; a null item id is listed as
    "null"; no benchmark at all leaves everything clean. Repeated rows get one result each. At most `block_windows`
    windows are held at once: a larger benchmark takes one more pass over the texts for each further block, and what
    the passes found is merged by document.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("row_hash", F.xxhash64("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text_col).alias("text"))
    found = _window_rows(items, window)
    blocks = max(1, math.ceil(found.count() / block_windows))
    blocked = found.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    held = lambda k: [(r["item"], [bytes(x) for x in r["words"]])  # noqa: E731  about block_windows rows
                      for r in blocked.filter(F.col("block") == k).select("item", "words").collect()]
    result = _scan(base, held(0))
    if blocks > 1:
        more = [_scan(base, held(k)).filter(F.size("spans") > 0) for k in range(1, blocks)]
        rest = more[0]
        for m in more[1:]:
            rest = rest.unionByName(m)
        pair = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1),
                                     lambda i: F.struct(F.get(F.col(c), 2 * i).alias("s"), F.get(F.col(c), 2 * i + 1).alias("e")))
        rest = (rest.withColumn("pairs", pair("spans")).groupBy("doc_id", "row_hash")
                .agg(F.flatten(F.collect_set("pairs")).alias("more_pairs"), F.flatten(F.collect_set("items")).alias("more_items")))
        own = F.when(F.size("spans") > 0, pair("spans")).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        left = result.alias("l").join(rest.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
                                      & F.col("l.row_hash").eqNullSafe(F.col("r.row_hash")), "left")
        pairs = F.array_sort(F.concat(own, F.coalesce("more_pairs", F.array().cast("array<struct<s:int,e:int>>"))))
        joined = F.aggregate(pairs, F.array().cast("array<int>"), lambda a, x: F.when(
            (F.size(a) > 0) & (x["s"] <= F.element_at(F.concat(F.array(F.lit(-1)), a), -1)),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(F.element_at(F.concat(F.array(F.lit(-1)), a), -1), x["e"]))))
            .otherwise(F.concat(a, F.array(x["s"], x["e"]))))
        result = left.select(F.col("l.doc_id").alias("doc_id"), F.col("l.row_hash").alias("row_hash"), "n_words", joined.alias("spans"),
                             F.array_distinct(F.concat("items", F.coalesce("more_items", F.array().cast("array<string>")))).alias("items"))
    length = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, b: a + b)
    return result.select("doc_id", "row_hash", "n_words", "spans", length.cast("long").alias("n_hit"),
                         F.array_sort("items").alias("items"), (F.size("spans") > 0).alias("contaminated"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op3_decontamination": query}

#: Windows by list slices and equality of their joined words.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
           FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
     spot AS (SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
            FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
     hit AS (SELECT spot.r, spot.i, spot.m, p.item_id FROM spot JOIN p ON spot.m = p.m AND spot.s = p.s),
     pos AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hit) GROUP BY r),
     it AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
            FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'null') AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
ORACLES = {"op3_decontamination": SQL}
