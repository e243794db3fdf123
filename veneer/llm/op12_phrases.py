"""Removes passages that a document of smaller id holds too, located by sharded Aho-Corasick automata.

Equal windows must meet in one shard. The window's gram of least hash is its anchor; neighbouring windows of one anchor
are a stretch of text, and only stretches whose anchor occurs in two documents travel. Equal stretches are one row with
the least id that holds them, so a passage that fills a third of all documents is a few rows. A shard holds whole groups
of stretches with one anchor. Their windows are compiled into one automaton over words, each with the least id it starts
in, and all stretches are streamed through it: a match that has a smaller id is a later copy. A group with too many
different stretches is not held by a task; its windows meet one by one instead, by two hashes.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.llm.common import scratch_path, table
from veneer.llm.id_filter import IdFilter, likely
from veneer.llm.word_arrays import byte_strings, counted, joined, least_of, parts, run_hashes, span_hashes, spans, word_bytes

WINDOW, GRAM = 13, 4
#: Most different stretches of one group that are compiled together; bytes of a shard.
GROUP_STRETCHES, SHARD_BYTES = 1000, 1 << 20
_WORD = word_bytes(b" \t\n\x0b\x0c\r")
_KEY = ["g", "c1", "c2"]


def _words(batch):
    """(first row, bytes, starts, ends, rows, hashes) of parts of a batch."""
    for at, _, raw, bounds in parts(batch.column("text")):
        starts, ends, row = spans(_WORD[raw], bounds)
        yield at, raw, starts, ends, row, span_hashes(raw, starts, ends)


def stretches(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of each stretch: neighbouring windows of a row whose least gram is the same."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    grams = joined(*[h[k:len(h) - GRAM + 1 + k] for k in range(GRAM)])
    anchor = least_of(grams, window - GRAM + 1)
    whole = row[:n] == row[window - 1:]
    edge = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]), [True]))
    first, last = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
    keep = whole[first]
    return anchor[first][keep], first[keep], last[keep]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _in_two(lo: str = "lo", hi: str = "hi", unnamed: str = "unnamed") -> Column:
    """Held by documents of two ids; a null id comes after all others and is not smaller than another null."""
    return F.col(lo).isNotNull() & ((F.col(lo) < F.col(hi)) | F.col(unnamed))


def _least_ids() -> list[Column]:
    return [F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("unnamed")]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """g: anchors of documents with two ids or more."""
    def run(batches):
        for batch in batches:
            for at, _, _, _, row, h in _words(batch):
                g, first, _ = stretches(h, row, window)
                own, _ = counted([g, row[first].astype(np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(g[own].view(np.int64)), batch.column("id").take(pa.array(at + row[first[own]]))], ["g", "id"])

    schema = T.StructType([T.StructField("g", T.LongType()), docs.schema["id"]])
    return docs.select("id", "text").mapInArrow(run, schema).groupBy("g").agg(*_least_ids()).filter(_in_two()).select("g")


def _shared_stretches(docs: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """g, c1, c2 (anchor, content), id, th, start, n (windows), data: stretches that may have a shared anchor.

    A task gives the text of equal stretches once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(IdFilter.of(anchors, "g"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in _KEY] + [docs.schema["id"], T.StructField("th", T.LongType())]
                          + [T.StructField(c, T.IntegerType()) for c in ("start", "n")] + [T.StructField("data", T.StringType())])

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at, raw, starts, ends, row, h in _words(batch):
                g, first, last = stretches(h, row, window)
                keep = shared.value.passing(g.view(np.int64))
                g, first, last = g[keep], first[keep], last[keep]
                if not len(g):
                    continue
                c1, c2 = run_hashes(h, first, last + window)
                names = list(zip(c1.tolist(), c2.tolist()))
                fresh = np.zeros(len(g), bool)
                for i, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                data = byte_strings(raw, starts[first[fresh]], ends[last[fresh] + window - 1])
                which = pa.array(np.cumsum(fresh) - 1, mask=~fresh)
                take = pa.array(at + row[first])
                begin = np.searchsorted(row, row[first])  # the first word of the same row
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x.view(np.int64)) for x in (g, c1, c2)], batch.column("id").take(take), batch.column("th").take(take),
                     pa.array((first - begin).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), data.take(which)], schema.names)

    return docs.mapInArrow(run, schema)


def later_windows(held: list[tuple], window: int) -> list[list[int]]:
    """For each (least id, words) the windows [first, end), flat, that start in another of them with a smaller id.

    Windows found twice are confirmed as recurring and compiled into one automaton over words, which are letters of an
    alphabet made for the occasion; all texts are streamed through it.
    """
    letters: dict[bytes, str] = {}
    texts = []
    for _, words in held:
        for w in words:
            if w not in letters:
                k = len(letters)
                letters[w] = chr(k if k < 0xD800 else k + 0x800)
        texts.append("".join([letters[w] for w in words]))
    automaton = ahocorasick.Automaton()
    first: dict[str, int] = {}
    # from the least id up, so that the least one is found first; null comes last
    for i in sorted(range(len(held)), key=lambda i: (held[i][0] is None, held[i][0] if held[i][0] is not None else 0)):
        text = texts[i]
        for k in range(len(text) - window + 1):
            passage = text[k:k + window]
            if (known := first.setdefault(passage, i)) != i:
                automaton.add_word(passage, known)
    if not len(automaton):
        return [[] for _ in held]
    automaton.make_automaton()
    found = []
    for (own, _), text in zip(held, texts):
        runs: list[int] = []
        for end, i in automaton.iter(text):
            other = held[i][0]
            if other is None or not (own is None or other < own):
                continue
            first = end - window + 1
            if runs and runs[-1] == first:
                runs[-1] = first + 1
            else:
                runs += [first, first + 1]
        found.append(runs)
    return found


def _located(kinds: DataFrame, window: int) -> DataFrame:
    """g, c1, c2, lo, later: windows [first, end), flat, of each stretch that start in a document of smaller id."""
    schema = T.StructType([*[kinds.schema[c] for c in (*_KEY, "lo")], T.StructField("later", T.ArrayType(T.IntegerType()))])
    ordered = kinds.select(*_KEY, "lo", "copied", "data").repartition("g").sortWithinPartitions("g")

    def solve(shard, id_type):
        found = later_windows([(r[3], r[5].encode().split()) for r in shard], window)
        kept = [(r, f) for r, f in zip(shard, found) if f or r[4]]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([r[k] for r, _ in kept], pa.int64()) for k in range(3)], pa.array([r[3] for r, _ in kept], id_type),
             pa.array([f for _, f in kept], pa.list_(pa.int32()))], schema.names)

    def run(batches):
        shard, group, size, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field("lo").type
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if group and group[-1][0] != row[0]:
                    shard += group
                    group = []
                    if size > SHARD_BYTES:
                        yield solve(shard, id_type)
                        shard, size = [], 0
                group.append(row)
                size += len(row[5])
        if group:
            yield solve(shard + group, id_type)

    return ordered.mapInArrow(run, schema)


def _located_one_by_one(kinds: DataFrame, window: int) -> DataFrame:
    """The same for groups that no task holds: every window is a row, and equal ones meet by two hashes."""
    schema = T.StructType([*[kinds.schema[c] for c in (*_KEY, "lo", "copied")], *[T.StructField(c, T.LongType()) for c in ("w1", "w2")],
                           T.StructField("at", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for first, _, raw, bounds in parts(batch.column("data")):
                starts, ends, row = spans(_WORD[raw], bounds)
                h = span_hashes(raw, starts, ends)
                n = len(h) - window + 1
                at = np.flatnonzero(row[:n] == row[window - 1:]) if n > 0 else np.zeros(0, np.int64)
                w1, w2 = run_hashes(h, at, at + window)
                take = pa.array(first + row[at])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in (*_KEY, "lo", "copied")], pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)),
                     pa.array((at - np.searchsorted(row, row[at])).astype(np.int32))], schema.names)

    windows = _written(kinds.mapInArrow(run, schema), "windows")
    firsts = windows.groupBy("w1", "w2").agg(F.min("lo").alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    later = windows.join(_written(firsts, "first-windows"), ["w1", "w2"]).filter("first IS NOT NULL AND (lo IS NULL OR first < lo)")
    found = later.groupBy(*_KEY).agg(F.flatten(F.collect_list(F.array("at", F.col("at") + 1))).alias("later"))
    rows = kinds.select(*_KEY, "lo", "copied").join(found, _KEY, "left")
    return (rows.filter("copied OR later IS NOT NULL")
            .select(*_KEY, "lo", F.coalesce("later", F.array().cast("array<int>")).alias("later")))


def phrase_dedup(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                 group_stretches: int = GROUP_STRETCHES) -> DataFrame:
    """doc_id, n_words, removed (word positions [first, end), flat), n_removed, kept_text, kept_sha256; one row per row.

    A word goes if it lies in a run of `window` words that also starts in a document of smaller id; all is judged on the
    input. Null and empty texts have no words. Rows of one id are no copies of each other, whatever their texts; a null
    id comes after all others. Ids are of any type with an order. Other columns are ignored; no rows give no rows.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be {2 * GRAM} words at least")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("th"), "text")
    anchors = _written(_anchors(docs, window), "anchors")
    met = _written(_shared_stretches(docs, anchors, window), "stretches")
    kinds = met.groupBy(*_KEY).agg(*_least_ids(), F.max("data").alias("data"))
    kinds = _written(kinds.select(*_KEY, "lo", _in_two().alias("copied"), "data"), "kinds")
    large = _written(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_stretches).select("g"), "large-groups")
    if large.isEmpty():
        found = _located(kinds, window)
    else:
        found = _located(kinds.join(large, "g", "left_anti"), window).unionByName(
            _located_one_by_one(kinds.join(large, "g", "left_semi"), window))
    found = _written(found, "located")
    # the document of least id has its later windows only, any other holder of a stretch loses all of it
    runs = F.when(F.col("id").eqNullSafe(F.col("lo")), F.transform("later", lambda x: x + F.col("start"))).otherwise(
        F.array(F.col("start"), F.col("start") + F.col("n")))
    hits = (met.drop("data").join(found, _KEY).withColumn("runs", runs).filter(F.size("runs") > 0)
            .groupBy("id", "th").agg(F.flatten(F.collect_set("runs")).alias("runs")))
    hits = _written(hits, "later-copies")

    def finished(batch, runs_of):
        n, removed, gone, kept, digest = [], [], [], [], []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), runs_of):
            words = text.split()
            if runs:
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, runs[::2], 1)
                np.add.at(mark, np.array(runs[1::2]) + window - 1, -1)
                out = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                text = b" ".join([w for w, x in zip(words, out.tolist()) if not x])
            else:
                edge, out = np.zeros(0, np.int64), np.zeros(0, bool)
                text = b" ".join(words)
            n.append(len(words))
            removed.append(edge.astype(np.int32))
            gone.append(int(out.sum()))
            kept.append(text.decode())
            digest.append(hashlib.sha256(text).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(gone, pa.int64()),
             pa.array(kept, pa.string()), pa.array(digest, pa.string())], schema.names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("removed", T.ArrayType(T.IntegerType())), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    hit_texts = df.sparkSession.sparkContext.broadcast(IdFilter.of(hits, "th"))

    def finish_untouched(batches):
        for batch in batches:
            kept = batch.filter(pa.array(~hit_texts.value.passing(batch.column("th").to_numpy())))
            yield finished(kept, [None] * kept.num_rows)

    def finish(batches):
        for batch in batches:
            yield finished(batch, batch.column("runs").to_pylist())

    # texts that surely lose nothing are finished where they are read
    touched = likely(docs, hits, "th").alias("d").join(
        hits.alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.th") == F.col("h.th")), "left").select("d.id", "d.text", "runs")
    return docs.mapInArrow(finish_untouched, schema).unionByName(touched.mapInArrow(finish, schema))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_dedup(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op12_phrase_dedup": query}

#: Every window written out; its least id decides.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS body
           FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
     f AS (SELECT r, i, doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AND min(doc_id) OVER (PARTITION BY body) IS NOT NULL AS later FROM s),
     gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM f WHERE later),
     x AS (SELECT d.r, d.doc_id, u.k, w[u.k] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(k)),
     kept AS (SELECT x.r, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (WHERE gone.k IS NULL) AS body
              FROM x LEFT JOIN gone ON x.r = gone.r AND x.k = gone.k GROUP BY x.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
ORACLES = {"op12_phrase_dedup": SQL}
