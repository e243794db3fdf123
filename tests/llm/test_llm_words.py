"""Collocations, passages and spellings against brute force: nulls, empty and long texts, ties, repeated rows, no rows,
extra columns with clashing names, string and null ids, hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veneer.llm import op11_collocations, op12_phrases, op13_spellings, word_arrays
from veneer.llm.id_filter import IdFilter

rng = random.Random(5)
VOCABULARY = ["of", "the", "a", "New", "new", "York", "über", "état", "don't", "x1", "the-end", "ß"]
PHRASES = ["New York of the", "the état a x1 of", "a a a a a a", "über the-end", "of the, of the. a"]
PASSAGES = [" ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 60)) for _ in range(n)) for n in (12, 13, 14, 30, 60)]
SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _text():
    out = []
    for _ in range(rng.randint(1, 12)):
        out.append(rng.choice(PHRASES) if rng.random() < 0.5 else " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 6))))
        out.append(rng.choice([" ", "\t", ". ", "\n", "\r\n", "; ", "\x0b"]))
    return "".join(out)


CORPUS = [(i, _text(), rng.choice(["en", "fr", None, "und"])) for i in range(160)]
CORPUS += [(900, None, "en"), (901, "", "en"), (902, " .,;\n", None), (None, "of the of the", "de"), (903, "of " * 3000, "de"), (3, CORPUS[3][1], CORPUS[3][2])]


def with_clashes(df):
    return df.select("*", *[F.lit(7).alias(c) for c in ("id", "th", "g", "h", "n", "word", "lo", "runs", "prefix", "phrase", "a")])


@pytest.fixture(scope="module")
def corpus(spark):
    return with_clashes(spark.createDataFrame(CORPUS, "doc_id long, text string, lang string").repartition(6))


def brute_collocations(rows, least, top):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = []
        for p, a in c.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in c.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("least,top,budget", [(10, 2000, 1 << 20), (2, 2000, 50), (2, 7, 300)])
def test_collocations(corpus, least, top, budget):
    got = op11_collocations.collocations(corpus, least, top, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(CORPUS, least, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 4


def test_collocations_of_nothing(corpus):
    assert op11_collocations.collocations(corpus.limit(0)).collect() == []
    assert op11_collocations.collocations(corpus.filter("doc_id in (900, 901, 902)")).collect() == []


def test_score_is_exact_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 10**14 + 99, 10**14 + 9
    got = spark.range(1).select(op11_collocations._score(F.lit(a), F.lit(left), F.lit(right))).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_groups_hold_their_budget(spark):
    counts = [(int(k), int(n)) for k, n in zip(np.random.default_rng(1).integers(-2**62, 2**62, 500), [3] * 490 + [400] * 10)]
    bounds, large, spread = op11_collocations.prefix_groups(spark.createDataFrame(counts, "k long, n long"), 100)
    assert len(large) == 10 and set(spread) == {4}
    groups = op11_collocations.Groups(bounds, large, spread)
    sizes = Counter()
    for k, n in counts:
        third = np.random.default_rng(k % 1000).integers(0, 2**63, n).astype(np.uint64)
        sizes.update(groups.of(np.full(n, k, np.int64), third).tolist())
    assert sum(sizes.values()) == sum(n for _, n in counts) and max(sizes.values()) < 250


def brute_phrases(rows, window):
    words = [re.findall(SPACE, t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            if i is not None:
                first[x] = min(i, first.get(x, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            own = first.get(tuple(w[k:k + window]))
            if own is not None and (i is None or own < i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def _passage_text(i):
    out = []
    for _ in range(rng.randint(1, 4)):
        x = rng.random()
        out.append(rng.choice(PASSAGES) if x < 0.6 else f"own{i} " * rng.randint(1, 40) if x < 0.7 else " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 25))))
    return rng.choice([" ", "\n", " \t"]).join(out)


PHRASE_ROWS = [(i, _passage_text(i)) for i in range(120)]
PHRASE_ROWS += [(500, None), (501, ""), (502, " \n "), (503, "same " * 5000), (504, "same " * 4000), (505, "a b " * 300), (506, "b a " * 300)]
PHRASE_ROWS += [(7, PHRASE_ROWS[9][1]), (7, PHRASE_ROWS[7][1]), (None, PHRASE_ROWS[9][1]), (None, None), (None, "z " * 20), (None, "z " * 20)]
PHRASE_ROWS += [(1000 + i, f"w{i} v{i} " + PASSAGES[3] + f" q{i}") for i in range(60)]  # one passage, a context for each


@pytest.mark.parametrize("window,most", [(13, 1000), (13, 8), (9, 3)])
def test_phrase_dedup(spark, window, most):
    df = with_clashes(spark.createDataFrame(PHRASE_ROWS, "doc_id long, text string").repartition(5))
    got = op12_phrases.phrase_dedup(df, window, group_stretches=most)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect()) == brute_phrases(PHRASE_ROWS, window)
    assert all(sum(b - a for a, b in zip(r.removed[::2], r.removed[1::2])) == r.n_removed for r in got.collect())


def test_phrase_dedup_of_string_ids_and_of_nothing(spark):
    rows = [(None if i is None else f"{i:05d}", t) for i, t in PHRASE_ROWS]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = op12_phrases.phrase_dedup(df)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect()) == brute_phrases(rows, 13)
    assert op12_phrases.phrase_dedup(df.limit(0)).collect() == []


def test_a_periodic_text_is_few_stretches():
    h = np.tile(np.array([11, 12, 13], np.uint64), 50_000)
    anchor, _, _ = op12_phrases.stretches(h, np.zeros(len(h), np.int64), 13)
    assert len(anchor) == 1


STEMS = ["understand", "recurrent", "état", "élémentaire", "running", "banana", "aaaaaaa", "letters", "Größenordnung"]


def _misspelt(word):
    k, x = rng.randrange(len(word)), rng.random()
    return word[:k] + word[k + 1:] if x < 0.3 else word[:k] + rng.choice("aeßÀx") + word[k + (x < 0.7):]


SPELL_ROWS = [(i, " ".join(rng.choice(STEMS) if rng.random() < 0.8 else _misspelt(_misspelt(rng.choice(STEMS))) if rng.random() < 0.3
                           else _misspelt(rng.choice(STEMS)) for _ in range(120))) for i in range(60)]
SPELL_ROWS += [(800, None), (801, ""), (802, "12 3 ."), (None, "understand underztand"), (803, "running×running÷letters"), (804, "q" * 100_000 + " " + "q" * 100_000),
               (5, SPELL_ROWS[5][1]), (805, "misstep misstep missteps missteps isstep mistep mistep"), (806, "É" * 70 + " " + "É" * 70)]
LONG_WORD = "".join(rng.choice("abcé") for _ in range(255))
SPELL_ROWS += [(900 + k, " ".join([LONG_WORD[:255 - k] + "z" * j + LONG_WORD[255 - k:]] * (1 + 13 * j))) for k in (0, 3, 3, 9, 9) for j in (0, 1, 1, 2, 3)]
SPELL_ROWS += [(950, (LONG_WORD + "zy ") * 14 + (LONG_WORD + "zx ") * 14 + (LONG_WORD + "z0 ") * 14)]


def brute_spellings(rows, ratio=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(u, v):
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) - len(u) == 1 and any(v[:k] + v[k + 1:] == u for k in range(len(v)))

    found = {w: sorted((-n[v], v) for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)) for w in n}
    form = {w: x[0][1] for w, x in found.items() if x and -x[0][0] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(found[w]), n.get(form.get(w))) for w in n)


@pytest.mark.parametrize("ratio", [10, 2])
def test_spelling_variants(spark, ratio):
    df = with_clashes(spark.createDataFrame(SPELL_ROWS, "doc_id long, text string").repartition(4))
    got = op13_spellings.spelling_variants(df, ratio)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_spellings(SPELL_ROWS, ratio)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] is not None for r in want) > 5 and (ratio == 10 or any(r[1] is not None and r[1] != r[2] for r in want))


def test_spelling_variants_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op13_spellings.spelling_variants(df).collect() == []


def test_checksums_of_long_and_short_runs():
    texts = [b"", b"a", b"abc" * 30, bytes(range(200)) * 9]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begun = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    got = op13_spellings.checksums(raw, ends - [len(t) for t in texts], ends, begun)
    assert got.tolist() == [zlib.crc32(b"7:" + t) for t in texts]


def test_words_longer_than_a_part():
    text = b"x" * (3 << 20) + b" " + b"y" * (3 << 20) + b" x"
    column = pa.array([text, b"", text], pa.binary())
    found = []
    for at, _, raw, bounds in word_arrays.parts(column):
        starts, ends, row = word_arrays.spans(word_arrays.word_bytes(b" ")[raw], bounds)
        found += list(zip((row + at).tolist(), word_arrays.span_hashes(raw, starts, ends).tolist()))
    assert [r for r, _ in found] == [0, 0, 0, 2, 2, 2] and [h for _, h in found[:3]] == [h for _, h in found[3:]] and len({h for _, h in found}) == 3


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(word_arrays, "joined", lambda *c: np.zeros(len(c[0]), np.uint64))
    a, b = np.array([1, 1, 2, 1], np.uint64), np.array([5, 6, 5, 5], np.uint64)
    at, n = word_arrays.counted([a, b])
    assert {(int(a[i]), int(b[i])): int(k) for i, k in zip(at, n)} == {(1, 5): 2, (1, 6): 1, (2, 5): 1}


def test_id_filter_grows_with_the_ids(spark):
    for n in (10, 200_000):
        found = IdFilter.of(spark.range(n).select(F.xxhash64("id").alias("rid")))
        held = np.array([r[0] for r in spark.range(n).select(F.xxhash64("id")).collect()], np.int64)
        other = np.random.default_rng(3).integers(-2**63, 2**63 - 1, 50_000)
        assert found.passing(held).all() and found.passing(other).mean() < 0.02
