"""Removes bytes covered by strings of a given length that start anywhere else too, by suffix sorting in bounded blocks.

Equal strings must meet in one block. Every string of `length` bytes chooses the gram of least hash among those it
holds, so equal strings choose equal grams: strings are grouped by that anchor. Neighbouring strings of a text with the
same anchor form one piece; equal pieces are counted where they are read, and anchors that occur once go no further.
Equal pieces of one text that overlap or touch, as in rules and blank runs, are one row: their copies cover one stretch.
The distinct pieces of a group are then suffix-sorted in two stages and adjacent common prefixes show what repeats.
A group too large for a block is cut anew by longer keys, first the bytes that all strings at like distance of the
anchor share, in the end the strings themselves, so no group has to fit into one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veneer.llm.common import cut_lineage, table
from veneer.llm.id_filter import IdFilter, likely
from veneer.llm.shingles import Powers, mixed
from veneer.llm.suffixes import repeated_starts

GRAM = 32
#: Most pieces of one group that are sorted as they are; most bytes of one block.
GROUP_PIECES, BLOCK_BYTES = 1000, 256 * 1024
_POS_BITS = np.uint64(30)
_powers = Powers()


def _prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours: running minima from the left and from the right of blocks that long."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


class Cut:
    """Hashes of one text for cutting it into pieces."""

    def __init__(self, data: bytes, gram: int):
        self.raw = np.frombuffer(data, np.uint8)
        self.sums, self.down = _prefix_sums(self.raw)
        n = len(self.raw) - gram + 1
        self.grams = mixed((self.sums[gram:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)
        self.gram_sums = np.zeros(len(self.grams) + 1, np.uint64)
        np.cumsum(mixed(self.grams), out=self.gram_sums[1:])
        self.gram = gram

    def pieces(self, length: int) -> tuple[np.ndarray, ...]:
        """First and last string start, and anchor place, of each piece."""
        if len(self.raw) < length:
            return (np.zeros(0, np.int64),) * 3
        place = np.arange(len(self.grams), dtype=np.uint64)
        ranked = (self.grams >> _POS_BITS << _POS_BITS) | place
        chosen = (_window_minimum(ranked, length - self.gram + 1) & ((np.uint64(1) << _POS_BITS) - np.uint64(1))).astype(np.int64)
        edge = np.flatnonzero(chosen[1:] != chosen[:-1])
        return np.append(0, edge + 1), np.append(edge, len(chosen) - 1), chosen[np.append(0, edge + 1)]

    def content(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of bytes [start, end)."""
        one = mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
        two = mixed(self.gram_sums[end - self.gram + 1] - self.gram_sums[start] + mixed((end - start).astype(np.uint64)))
        return one.view(np.int64), two.view(np.int64)


def chained(c1: np.ndarray, c2: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that stand for a chain of equal ones, each at most `length` bytes after the one before; how many there are
    in the chain, and how far the last is from the first. Strings of a chain cover all bytes between."""
    order = np.lexsort((first, c2, c1))
    a, b, at = c1[order], c2[order], first[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(at) > length))[:len(at)]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(at))[:len(start)] - 1
    return order[start], end - start + 1, at[end] - at[start]


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """g, c1, c2 (anchor and content), id, th, start, stop (of string starts), anchor (relative to start), and of the
    chain that a piece begins: times, reach (start of its last piece less its own)."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("g", "c1", "c2")] + [docs.schema["id"], T.StructField("th", T.LongType())]
                          + [T.StructField(c, T.IntegerType()) for c in ("start", "stop", "anchor", "times", "reach")])

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(9)]
            for text in batch.column("text").cast(pa.binary()):
                cut = Cut(text.as_buffer(), GRAM)
                first, last, anchor = cut.pieces(length)
                c1, c2 = cut.content(first, last + length) if len(first) else (first, first)
                own, times, reach = chained(c1, c2, first, length)
                first, last, anchor = first[own], last[own], anchor[own]
                for out, x in zip(rows, (cut.grams[anchor].view(np.int64), c1[own], c2[own], first, last, anchor - first, times, reach,
                                         np.array([len(first)]))):
                    out.append(x)
            if not rows[0]:
                continue
            which = np.repeat(np.arange(batch.num_rows), np.concatenate(rows[8]))
            g, c1, c2, first, last, anchor, times, reach = (np.concatenate(x) for x in rows[:8])
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(c1), pa.array(c2), batch.column("id").take(take), batch.column("th").take(take),
                 *[pa.array(x.astype(np.int32)) for x in (first, last, anchor, times, reach)]], schema.names)

    return docs.mapInArrow(run, schema)


_SPANS = "g long, c1 long, c2 long, spans array<int>"


def _sorted_groups(pieces: DataFrame, length: int) -> DataFrame:
    """g, c1, c2, spans: runs [first, last] of string starts in the piece that occur elsewhere, flat. Whole groups fill each block."""
    ordered = pieces.select("g", "c1", "c2", "twice", "data").repartition("g").sortWithinPartitions("g", "c1", "c2")

    def solve(rows):
        starts = repeated_starts([r[3] for r in rows], length)
        # a piece read twice or more has copies of all its strings
        starts = [np.arange(len(r[3]) - length + 1) if r[4] else s for r, s in zip(rows, starts)]
        spans = []
        for s in starts:
            edge = np.flatnonzero(np.diff(s) > 1)
            spans.append(np.stack((s[np.append(0, edge + 1)], s[np.append(edge, len(s) - 1)]), 1).ravel() if len(s) else s)
        found = [(r, s) for r, s in zip(rows, spans) if len(s)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r, _ in found], pa.int64()) for k in range(3)]
            + [pa.array([s.astype(np.int32) for _, s in found], pa.list_(pa.int32()))], ["g", "c1", "c2", "spans"])

    def run(batches):
        block, group, held = [], [], 0
        for batch in batches:
            for g, c1, c2, twice, data in zip(*[batch.column(c).to_pylist() for c in ("g", "c1", "c2", "twice", "data")]):
                if group and group[-1][:3] == (g, c1, c2):
                    continue  # read from a row given twice
                if group and group[-1][0] != g:
                    block += group
                    group = []
                    if held > BLOCK_BYTES:
                        yield solve(block)
                        block, held = [], 0
                group.append((g, c1, c2, data, twice))
                held += len(data)
        if block or group:
            yield solve(block + group)

    return ordered.mapInArrow(run, _SPANS)


def _finer(pieces: DataFrame, length: int, width: int) -> DataFrame:
    """Cuts pieces so that those of one group share `length` - `width` + 1 bytes or more: parent key, offset, new piece."""
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for g, c1, c2, twice, anchor, data in zip(*[batch.column(c).to_pylist() for c in ("g", "c1", "c2", "twice", "anchor", "data")]):
                cut, last = Cut(data, GRAM), len(data) - length
                # strings by their distance to the anchor, in classes of `width` distances
                klass = (anchor - np.arange(last + 1)) // width
                edge = np.flatnonzero(np.diff(klass))
                first, final = np.append(0, edge + 1), np.append(edge, last)
                core = anchor - klass[first] * width  # the class's last start: all its strings hold what follows, so far
                k1, k2 = cut.content(core, core - width + 1 + length)
                n1, n2 = cut.content(first, final + length)
                new_g = mixed(k1.view(np.uint64) ^ mixed(k2.view(np.uint64)) + klass[first].astype(np.uint64)).view(np.int64)
                for i in range(len(first)):
                    for o, x in zip(out, (g, c1, c2, int(first[i]), int(new_g[i]), int(n1[i]), int(n2[i]),
                                          (twice, int(anchor - first[i]), data[first[i]:final[i] + length]))):
                        o.append(x)
            extra = out.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in out] + [pa.array([e[0] for e in extra], pa.bool_()),
                 pa.array([e[1] for e in extra], pa.int32()), pa.array([e[2] for e in extra], pa.binary())],
                ["pg", "pc1", "pc2", "at", "g", "c1", "c2", "twice", "anchor", "data"])

    return pieces.mapInArrow(run, "pg long, pc1 long, pc2 long, at long, g long, c1 long, c2 long, twice boolean, anchor int, data binary")


def _solve(pieces: DataFrame, length: int, widths: tuple[int, ...], group_pieces: int) -> DataFrame:
    """Spans of all pieces of all groups (g, c1, c2, twice, anchor, data; distinct by the first three)."""
    sizes = pieces.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.filter(F.col("n") > group_pieces).select("g"))
    if not widths or large.isEmpty():
        return _sorted_groups(pieces, length)
    small = _sorted_groups(pieces.join(large, "g", "left_anti"), length)
    return small.unionByName(_solve_finer(pieces.join(large, "g", "left_semi"), length, widths, group_pieces))


def _solve_finer(pieces: DataFrame, length: int, widths: tuple[int, ...], group_pieces: int) -> DataFrame:
    """Spans of pieces of groups that are too large for a block: cut anew, solved, and put back together."""
    finer = cut_lineage(_finer(pieces, length, widths[0]))
    distinct = cut_lineage(finer.groupBy("g", "c1", "c2").agg(
        (F.max("twice") | (F.count(F.lit(1)) > 1)).alias("twice"), F.min("anchor").alias("anchor"), F.min("data").alias("data")))
    found = _solve(distinct, length, widths[1:], group_pieces)
    back = finer.select("pg", "pc1", "pc2", "at", "g", "c1", "c2").join(found, ["g", "c1", "c2"])
    return back.groupBy(F.col("pg").alias("g"), F.col("pc1").alias("c1"), F.col("pc2").alias("c2")).agg(
        F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("at").cast("int")))).alias("spans"))


def suffix_dedup(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                 group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (flat [start, end) of removed bytes), kept_sha256; one row per row.

    A byte goes if a string of `length` bytes around it also starts anywhere else, in this text or another; all copies
    go, and all are judged on the input. Null counts as empty, shorter texts keep all. Rows given twice are copies of
    each other. Ids may be null or repeated; other columns are ignored; no rows give no rows.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} bytes at least")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("id", F.xxhash64("text").alias("th"), "text")
    long_docs = docs.filter(F.octet_length("text") >= length)
    pieces = _pieces(long_docs, length)
    anchors = pieces.groupBy("g").agg(F.sum("times").alias("n")).filter("n > 1").select("g")
    # a table of its own, so that the join can split the partitions of anchors that are very common
    shared = cut_lineage(pieces.join(cut_lineage(anchors), "g"))
    kinds = shared.groupBy("g", "c1", "c2").agg((F.sum("times") > 1).alias("twice"),
                                               F.min(F.struct("id", "th", "start", "stop", "anchor")).alias("at"))
    kinds = cut_lineage(kinds.select("g", "c1", "c2", "twice", "at.*"))
    sizes = kinds.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # a group of one kind of piece needs no order: the piece was read twice, so all its strings have copies
    ranked = kinds.join(sizes.filter("n > 1"), "g")
    alone = kinds.join(sizes.filter("n = 1"), "g").select(
        "g", "c1", "c2", F.array(F.lit(0), F.col("stop") - F.col("start")).alias("spans"))

    def with_bytes(wanted: DataFrame) -> DataFrame:
        """Pieces with their bytes, from one example of each; only texts that hold one are moved."""
        own = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("g", "c1", "c2", "twice", "start", "stop", "anchor")).alias("own"))
        held = (likely(long_docs, own, "th").alias("d")
                .join(own.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.th") == F.col("w.th")))
                .select(F.col("d.text").cast("binary").alias("bytes"), F.inline("w.own")))
        return held.select("g", "c1", "c2", "twice", "anchor",
                           F.substring(F.col("bytes"), F.col("start") + 1, F.col("stop") - F.col("start") + length).alias("data"))

    found = alone.unionByName(_sorted_groups(with_bytes(ranked.filter(F.col("n") <= group_pieces)), length))
    large = cut_lineage(ranked.filter(F.col("n") > group_pieces))
    if not large.isEmpty():
        found = found.unionByName(_solve_finer(with_bytes(large), length, (max(1, length // 8), 1), group_pieces))
    hits = shared.join(found, ["g", "c1", "c2"]).groupBy("id", "th").agg(F.flatten(F.collect_set(
        F.transform("spans", lambda x, i: x + F.col("start") + F.when(i % 2 == 1, F.col("reach")).otherwise(0)))).alias("starts"))
    hits = cut_lineage(hits)
    moved = likely(docs, hits, "th").alias("d").join(hits.alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.th") == F.col("h.th")), "left")
    rows = moved.select(F.col("d.id").alias("doc_id"), "text", "starts")
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("kept_sha256", T.StringType())])

    def finished(batch, starts_of):
        out: list[list] = [[] for _ in range(5)]
        for text, starts in zip(batch.column("text").cast(pa.binary()), starts_of):
            data = text.as_buffer()
            spans = merged_spans(np.array(starts or [], np.int64), length)
            digest, at, view = hashlib.sha256(), 0, memoryview(data)
            for a, b in spans.tolist():
                digest.update(view[at:a])
                at = b
            digest.update(view[at:])
            for o, x in zip(out, (len(view), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), spans.ravel().astype(np.int32), digest.hexdigest())):
                o.append(x)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.list_(pa.int32())),
             pa.array(out[4], pa.string())], schema.names)

    def finish(batches):
        for batch in batches:
            yield finished(batch, (s.as_py() for s in batch.column("starts")))

    # texts that surely have no hit are finished where they are read
    table_of_hits = df.sparkSession.sparkContext.broadcast(IdFilter.of(hits, "th"))

    def finish_untouched(batches):
        for batch in batches:
            kept = batch.filter(pa.array(~table_of_hits.value.passing(batch.column("th").to_numpy())))
            yield finished(kept, [None] * kept.num_rows)

    untouched = docs.select(F.col("id").alias("doc_id"), "th", "text").mapInArrow(finish_untouched, schema)
    return rows.mapInArrow(finish, schema).unionByName(untouched)


def merged_spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal [start, end) runs of bytes covered by strings that start in the given [first, last] runs (flat)."""
    runs = starts.reshape(-1, 2)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    if not len(runs):
        return runs
    end = np.maximum.accumulate(runs[:, 1] + length)
    new = np.flatnonzero(np.append(True, runs[1:, 0] > end[:-1]))
    return np.stack((runs[new, 0], np.append(end[new[1:] - 1], end[-1])), 1)


def query(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op2_suffix_dedup": query}
ORACLES: dict[str, str] = {}
