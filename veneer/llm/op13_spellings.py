"""Groups spelling variants: near words by sorted permuterm rotations, and the common form each word leads to.

A word marked with a terminator has a rotation for each place it may be cut at. Leave out the last character of a
rotation and every word that differs in that character alone has the same rest: a range of rotations with one prefix
that skips the edited character. A word that lacks the character has the prefix as a whole rotation. Prefixes are sorted
and scanned range by range. Words of one range differ in a single character, so a range is never larger than the
alphabet, whatever the number of words; each member emits what it found there (a count and its best neighbour), not pairs.
Rotations of very long words are named by two hashes each, so that a word takes room in proportion to its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veneer.llm.common import scratch_path, table
from veneer.llm.shingles import Powers, mixed
from veneer.llm.word_arrays import LOWER, byte_strings, counted, parts, span_hashes, spans

# fixed values: which runs lose a code point, least length and count of a word, how much commoner its form is
DELETE_EVERY, LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 31, 7, 2, 10
#: Ends a word in its rotations; it's in no run of letters.
END = "$"
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF; what follows it is one of them
#: Words from this length on have their rotations hashed instead of written out.
HASHED = 256
#: Runs that a task counts before it sends them on; bytes from which on a run's checksum is taken by itself.
HELD, LONG = 1 << 20, 64


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1).astype(np.uint32)
    return rows


_CRC = _crc_table()


def checksums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of runs of bytes, each going on from a checksum: all runs together, byte by byte."""
    out = begun ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(1, LONG + 1), "right")  # runs with so many bytes
    for k in range(LONG):
        now = order[:alive[k]]
        if not len(now):
            break
        out[now] = _CRC[(out[now] ^ raw[starts[now] + k]) & np.uint32(255)] ^ (out[now] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[:np.searchsorted(-size[order], -LONG, "left")].tolist():
        out[i] = zlib.crc32(raw[starts[i] + LONG:ends[i]].tobytes(), int(out[i]))
    return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, some of which have lost a code point, of `LEAST_LENGTH` code points or more."""
    def one_part(raw, bounds, begun):
        raw = LOWER[raw]
        letter = _ASCII[raw] | (raw == _LEAD)
        letter[1:] |= raw[:-1] == _LEAD
        starts, ends, row = spans(letter, bounds)
        wide = np.concatenate(([0], np.cumsum(raw == _LEAD)))
        length = ends - starts - (wide[ends] - wide[starts])
        keep = length >= LEAST_LENGTH
        starts, ends, row, length = starts[keep], ends[keep], row[keep], length[keep]
        crc = checksums(raw, starts, ends, begun[row])
        cut = crc % DELETE_EVERY == 0
        shorter = []
        for i in np.flatnonzero(cut & (length > LEAST_LENGTH)).tolist():
            run = raw[starts[i]:ends[i]].tobytes().decode()
            at = int(crc[i]) % len(run)
            shorter.append(run[:at] + run[at + 1:])
        starts, ends = starts[~cut], ends[~cut]
        at, n = counted([span_hashes(raw, starts, ends)])
        return pa.concat_arrays([byte_strings(raw, starts[at], ends[at]), pa.array(shorter, pa.string())]), np.append(n, np.ones(len(shorter), np.int64))

    def merged(held):
        words = pa.chunked_array([w for w, _ in held]).combine_chunks().dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in held]), len(words.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], ["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            begun = np.array([zlib.crc32(f"{x}:".encode()) for x in batch.column("id").to_pylist()], np.uint32)
            for at, end, raw, bounds in parts(batch.column("text")):
                held.append(one_part(raw, bounds, begun[at:end]))
                size += len(held[-1][1])
                if size >= HELD:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(word: str) -> list[tuple[str, str]]:
    """(prefix, skipped character) of a word: rotations without their last letter, and whole ones (nothing skipped)."""
    whole = [(word[i:] + END + word[:i], "") for i in range(len(word) + 1)]
    return whole + [(word[i + 1:] + END + word[:i], word[i]) for i in range(len(word))]


def _word(prefix: str, skipped: str) -> str:
    tail, head = prefix.split(END)
    return head + skipped + tail


def range_neighbours(prefix: str, members: list[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
    """(word, near words, n of the best, the best) for each member of a range that has near words there.

    A letter that equals the one before it may be left out for that one too: only the first of a run counts, so that no
    pair of words is met twice.
    """
    head = prefix.split(END)[1]
    rows = sorted(((n, _word(prefix, c), c) for c, n in members if c), key=lambda r: (-r[0], r[1]))
    whole = next(((n, _word(prefix, "")) for c, n in members if not c), None)
    out, first_of_run = [], []
    for k, (_, word, c) in enumerate(rows):
        near = len(rows) - 1
        best = [rows[1 if k == 0 else 0][:2]] if near else []
        if not head.endswith(c):
            first_of_run.append((rows[k][0], word))
            if whole:
                near += 1
                best.append(whole)
        if near:
            n, form = min(best, key=lambda r: (-r[0], r[1]))
            out.append((word, near, n, form))
    if whole and first_of_run:
        out.append((whole[1], len(first_of_run), *first_of_run[0]))
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: number of words that differ by one insertion, deletion or replacement, and of these
    the one of greatest n (ties: smallest). `words` has word, n; words without near words are left out."""
    def turned(batches):
        for batch in batches:
            prefixes, skipped, n = [], [], []
            for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                own = rotations(word)
                prefixes += [p for p, _ in own]
                skipped += [c for _, c in own]
                n += [count] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.string()), pa.array(skipped, pa.string()), pa.array(n, pa.int64())], ["prefix", "skipped", "n"])

    def scan(batches):
        last, members = None, []
        for batch in batches:
            out = []
            prefix = batch.column("prefix")
            same = np.zeros(len(prefix) + 1, bool)  # as the row before
            same[1:-1] = prefix[1:].to_numpy(zero_copy_only=False) == prefix[:-1].to_numpy(zero_copy_only=False)
            # a row on its own in the midst of a batch is a range without neighbours
            alone = ~same[:-1] & ~same[1:]
            alone[:1] = alone[-1:] = False
            for p, c, n in zip(*[x.to_pylist() for x in batch.filter(pa.array(~alone)).columns]):
                if p != last:
                    if len(members) > 1:
                        out += range_neighbours(last, members)
                    last, members = p, []
                members.append((c, n))
            yield rows(out)
        if len(members) > 1:
            yield rows(range_neighbours(last, members))

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                          ["word", "n_near", "best_n", "best"])

    short = words.filter(F.length("word") <= HASHED).select("word", "n")
    sorted_rotations = short.mapInArrow(turned, "prefix string, skipped string, n long").repartition("prefix").sortWithinPartitions("prefix")
    found = sorted_rotations.mapInArrow(scan, "word string, n_near long, best_n long, best string")
    # words of the border length meet shorter ones and their like above, longer ones below
    long = words.filter(F.length("word") >= HASHED)
    if not long.isEmpty():
        found = found.unionByName(_near_long_words(long))
    best = F.min(F.struct((-F.col("best_n")).alias("down"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("first.down")).alias("best_n"), "first.best")


_powers = Powers()


def hashed_rotations(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each prefix, its skipped code point (-1: nothing) and whether that one begins a run of equal ones."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    n = len(points)
    cut = np.concatenate((np.arange(n + 1), np.arange(n)))       # letters before the cut
    rest = np.concatenate((np.arange(n + 1), np.arange(1, n + 1)))  # where the letters after it begin
    up, down = _powers.to(n + 2)
    keys = []
    for salt in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(salt)) * up[:n], out=sums[1:])
        tail = (sums[n] - sums[rest]) * down[rest]
        keys.append(mixed(tail + np.uint64(salt ^ 0xFF) * up[n - rest] + sums[cut] * up[n - rest + 1] + (cut + n - rest).astype(np.uint64)))
    skipped = np.concatenate((np.full(n + 1, -1), points.astype(np.int64)))
    begins = np.concatenate((np.ones(n + 2, bool), points[1:] != points[:-1]))
    return keys[0], keys[1], skipped, begins


def _near_long_words(words: DataFrame) -> DataFrame:
    """The same as `near_words`, a row or more per word, for words from the border length on (those of just that length
    only as far as longer ones are concerned)."""
    named = _written(words.select("word", "n", F.xxhash64("word").alias("i1"), F.xxhash64(F.lit(1), "word").alias("i2")), "long-words")
    fields = "k1 long, k2 long, skipped long, begins boolean, i1 long, i2 long, n long"

    def turned(batches):
        for batch in batches:
            for word, n, i1, i2 in zip(*[batch.column(c).to_pylist() for c in ("word", "n", "i1", "i2")]):
                k1, k2, skipped, begins = (x[:len(word) + 1] if len(word) == HASHED else x for x in hashed_rotations(word))
                same = [pa.array(np.full(len(k1), x, np.int64)) for x in (i1, i2, n)]
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(skipped), pa.array(begins), *same],
                                                 [f.split()[0] for f in fields.split(", ")])

    ranges = (named.mapInArrow(turned, fields).groupBy("k1", "k2")  # no larger than the alphabet
              .agg(F.collect_list(F.struct("skipped", "begins", "n", "i1", "i2")).alias("members")).filter(F.size("members") > 1).select("members"))

    def scan(batches):
        for batch in batches:
            out = []
            for members in batch.column("members").to_pylist():
                for one in members:
                    near = [x for x in members if x["skipped"] != one["skipped"]
                            and (one["begins"] or x["skipped"] >= 0) and (x["begins"] or one["skipped"] >= 0)]
                    if near:
                        most = max(x["n"] for x in near)
                        out.append((one["i1"], one["i2"], len(near), most, [{"i1": x["i1"], "i2": x["i2"]} for x in near if x["n"] == most]))
            ties = pa.list_(pa.struct([("i1", pa.int64()), ("i2", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], ties if k == 4 else pa.int64()) for k in range(5)],
                                             ["i1", "i2", "n_near", "best_n", "ties"])

    found = _written(ranges.mapInArrow(scan, "i1 long, i2 long, n_near long, best_n long, ties array<struct<i1: long, i2: long>>"), "long-ranges")
    sums = found.groupBy("i1", "i2").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"))
    tied = found.select("i1", "i2", "best_n", F.explode("ties").alias("tie")).join(sums, ["i1", "i2", "best_n"])
    text = named.select("i1", "i2", "word")
    best = (tied.join(text.select(F.struct("i1", "i2").alias("tie"), F.col("word").alias("best")), "tie")
            .groupBy("i1", "i2", "n_near", "best_n").agg(F.min("best").alias("best")))
    return best.join(text, ["i1", "i2"]).select("word", "n_near", "best_n", "best")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spelling_variants(df: DataFrame, ratio: int = FORM_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word.

    Words are the runs of letters (A-Z lower-cased) of all texts, with a code point deleted where the checksum of
    `<id>:<run>` says so, that have 7 code points and occur twice. A form is the commonest near word, if it is `ratio`
    times as common; equally common ones are decided by the smallest. Following forms ends, as counts rise at each
    step; the last is the root. Null and empty texts have no runs, a null id is written `None`; rows given twice count
    twice; other columns are ignored; no rows give no words.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = _written(_word_counts(docs).filter(F.col("n") >= LEAST_COUNT), "words")
    joined = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    rows = _written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                                  F.when(is_form, F.col("best_n")).alias("form_n")), "near-words")
    # every step doubles the number of forms followed; counts rise `ratio`-fold with each form, so there are few
    steps = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = _written(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                    F.col("next").isNotNull().alias("moved")), "roots")
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return (rows.join(steps.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"))


QUERIES = {"op13_spelling_variants": query}

#: Checksums by a table; near words by the words with one letter left open or out.
SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
                       FROM range(0, 256) AS r(i)),
     runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'None') AS id, unnest(regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
     kinds AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS x FROM runs WHERE length(w) >= 7 GROUP BY ALL),
     sums AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                  lambda a, b: xor(t[1 + xor(a, b) % 256], a >> 8))) AS h FROM kinds, crc),
     cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM sums),
     words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     p AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
     skips AS (SELECT word, n, i, left(word, i::BIGINT) AS a, substr(word, i + 2) AS b FROM p),
     gaps AS (SELECT word, n, left(word, i::BIGINT) AS a, substr(word, i + 1) AS b FROM p UNION ALL SELECT word, n, word, '' FROM words),
     pairs AS (SELECT DISTINCT * FROM (
                   SELECT x.word, y.word AS near, y.n FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
                   UNION ALL SELECT x.word, y.word, y.n FROM skips x JOIN gaps y ON x.a = y.a AND x.b = y.b
                   UNION ALL SELECT y.word, x.word, x.n FROM skips x JOIN gaps y ON x.a = y.a AND x.b = y.b)),
     best AS (SELECT word, count(*)::BIGINT AS n_near, arg_min(struct_pack(near, n), (-n, near)) AS b FROM pairs GROUP BY word),
     forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * words.n THEN b.near END AS form,
                      CASE WHEN b.n >= 10 * words.n THEN b.n END AS form_n FROM words LEFT JOIN best USING (word)),
     walk AS (SELECT word, form AS spot, 1 AS k FROM forms WHERE form IS NOT NULL
              UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON walk.spot = forms.word WHERE forms.form IS NOT NULL),
     roots AS (SELECT word, arg_max(spot, k) AS root FROM walk GROUP BY word)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""
ORACLES = {"op13_spelling_variants": SQL}
