"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows, no rows and
extra columns with clashing names; its registered query on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm import brute
from veneer.llm import (op1_toxicity, op2_suffix_dedup, op3_decontaminate, op4_sharding, op5_preference, op6_language, op7_bpe,
                        op8_jaccard, op9_quality, op10_lines, suffixes)

random.seed(11)
WORDS = [f"word{i}" for i in range(150)]
PASSAGES = [" ".join(random.choice(WORDS) for _ in range(n)) for n in (8, 14, 30, 60, 90)]


def _text():
    parts = []
    for _ in range(random.randint(1, 4)):
        kind = random.random()
        parts.append(random.choice(PASSAGES) if kind < 0.5 else random.choice("aé") * random.randint(1, 150) if kind < 0.6
                     else " ".join(random.choice(WORDS) for _ in range(random.randint(1, 30))))
    return random.choice(["\n", " "]).join(parts)


ROWS = ([(i, _text()) for i in range(90)]
        + [(200, None), (201, ""), (202, " \n\t "), (203, "A b"), (204, "a  B"), (205, "x\n" * 50), (206, " ".join(WORDS * 40))])
ROWS += [(300, ROWS[3][1]), (3, ROWS[3][1]), (None, ROWS[5][1]), (None, None)]
UNIQUE = [r for r in ROWS[:97]]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry names that operators use inside."""
    clash = ["id", "th", "rid", "spans", "name", "run", "shard", "n", "key", "doc"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    return df.select("*", *[F.lit(7).alias(c) for c in clash])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("length,group", [(64, 1000), (64, 2), (100, 1)])
def test_suffix_dedup(docs, length, group):
    got = rows(op2_suffix_dedup.suffix_dedup(docs, length, group_pieces=group), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter(brute.suffix_dedup(ROWS, length))


def test_two_stage_sort():
    for _ in range(300):
        strings = [bytes(random.choice(b"abc\xc3"[:random.choice((1, 2, 4))]) for _ in range(random.randint(8, 50))) for _ in range(3)]
        block = b"\xff".join(strings) + b"\xff"
        order = suffixes.suffix_array(block, len(block))
        assert order.tolist() == sorted(range(len(block)), key=lambda i: block[i:])
        prefix = suffixes.common_prefixes(block, order, 16)
        for a, b, p in zip(order, order[1:], prefix):
            x, y = block[a:a + 16] + bytes(16), block[b:b + 16] + bytes(16)
            assert p >= next((k for k in range(16) if x[k] != y[k]), 16)


@pytest.mark.parametrize("block", [50_000, 7])
def test_decontaminate(spark, docs, block):
    items = [(1, PASSAGES[1]), (2, PASSAGES[2].upper()), (3, "word1"), (4, None), (5, ""), (None, PASSAGES[0]), (2, PASSAGES[2])]
    found = op3_decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found.collect())
    want = Counter((i, n, h, tuple(x), h > 0) for i, (n, h, x) in ((i, brute.contaminated(t, items)) for i, t in ROWS))
    assert got == want


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(docs, shards):
    out = op4_sharding.shard(docs, shards, nodes=16).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").encode()) + 16) for i, t in ROWS)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))


def test_sharding_moves_little(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = ({r["doc_id"]: r["shard"] for r in op4_sharding.shard(df, n).collect()} for n in (20, 21))
    assert np.mean([one[k] != two[k] for k in one]) < 0.15


def test_preference(spark):
    turns = [(0, True, 0, "user", "hi"), (0, True, 1, "assistant", "a"), (0, True, 2, "user", None), (0, False, 0, "user", "hi"),
             (0, False, 1, "assistant", "b"), (0, False, 1, "assistant", "b"), (1, True, 0, "user", "q"), (2, True, 5, None, ""),
             (2, False, 5, "user", ""), (None, True, 0, "user", "x"), (3, None, 0, "user", "x"), (3, True, None, "user", "x")]
    df = spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string").withColumn("end", F.lit(1))
    got = {(r["pair_id"], r["part"], r["turn"]): r for r in op5_preference.preference_turns(df).collect()}
    assert set(got) == {(0, "prompt", 0), (0, "chosen", 1), (0, "chosen", 2), (0, "rejected", 1), (1, "chosen", 0), (2, "prompt", 5)}
    chosen = got[0, "chosen", 1]
    assert chosen["rendered"][chosen["train_from"]:chosen["train_to"]] == "a<|end|>\n" and got[0, "prompt", 0]["train_from"] is None
    assert got[0, "chosen", 2]["starts_at"] == len(chosen["rendered"])
    whole = {r["pair_id"]: r for r in op5_preference.preference_examples(df).collect()}[0]
    spans = [whole["rejected"][s["start"]:s["end"]] for s in whole["rejected_mask"]]
    assert whole["prompt"] == "<|user|>\nhi<|end|>\n" and spans == ["b<|end|>\n"]
    assert op5_preference.preference_turns(df.limit(0)).count() == 0


def test_long_conversation_offsets(spark):
    df = spark.range(1500).select(F.lit(1).alias("pair_id"), F.lit(True).alias("chosen"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                  F.repeat(F.lit("y"), (F.col("id") % 7).cast("int")).alias("text"))
    at = 0
    for r in sorted(op5_preference.preference_turns(df).collect(), key=lambda r: r["turn"]):
        assert r["starts_at"] == at
        at += len(r["rendered"])


def test_bpe_matches_the_library(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = op7_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = op7_bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want
    assert op7_bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("leaf", [4, 16])
def test_bpe_joins(monkeypatch, leaf):
    for name in ("LEAF_CHARS", "LEAF_BYTES", "LEAF_IDS"):
        monkeypatch.setattr(op7_bpe, name, leaf)
    ranks = op7_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = op7_bpe.Codec(ranks, public_tokenizers.PATTERN, remembered=50)
    for _ in range(1500):
        s = "".join(random.choice("ab 're's\n\t  12é漢.!?-\xa0x") for _ in range(random.randint(0, 60)))
        s += random.choice(["a", "aaab", " ", "!", ""]) * random.randint(1, 60)
        ids = codec.encode(s)
        assert ids == library.encode_ordinary(s) and codec.decode(ids).decode() == s


@pytest.mark.parametrize("batch", [10_000, 5])
def test_jaccard(spark, batch):
    more = []
    for _ in range(60):
        base = [random.choice(WORDS) for _ in range(random.choice([1, 4, 5, 6, 9, 12, 16, 20, 22, 28, 40, 100]))]
        for _ in range(random.randint(1, 5)):
            x = list(base)
            for _ in range(random.randint(0, max(1, len(x) // 25))):
                x[random.randrange(len(x))] = random.choice(WORDS)
            more.append((1000 + len(more), " ".join(x)))
    data = UNIQUE + more
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumn("rid", F.lit(1)).withColumn("n", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert rows(op8_jaccard.jaccard_join(df), "doc_id", "n_shingles", "component_id") == Counter(brute.components(data))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jaccard_null_and_repeated_ids(docs, nothing):
    out = op8_jaccard.jaccard_join(docs).collect()
    assert len(out) == len(ROWS)
    by_id = {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None}
    assert by_id[300] == by_id[3] and by_id[204] == by_id[203]
    assert {r["component_id"] for r in out if r["doc_id"] is None} >= {by_id[5], None}
    assert op8_jaccard.jaccard_join(nothing).count() == 0


def test_quality_counts(docs, nothing):
    out = op9_quality.quality(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert got == Counter((i, *brute.base_metrics(t)) for i, t in ROWS)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1
    assert op9_quality.quality(nothing).count() == 0
    kept = op9_quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)


def test_label_model_finds_junk(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in op9_quality.query(spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in out if labels[r["doc_id"]]]
    junk = [r["kept"] for r in out if not labels[r["doc_id"]]]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.15


def test_line_dedup(spark, docs, nothing):
    data = [r for r in UNIQUE]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5).withColumn("removed", F.lit(1))
    got = {r["doc"]["doc_id"]: r["kept_text"] or "" for r in op10_lines.dedup_lines(df, 12).collect()}
    assert got == dict(zip([i for i, _ in data], brute.kept_lines(data, 12)))
    out = op10_lines.dedup_lines(docs, 12)
    assert out.count() == len(ROWS) and set(docs.columns) == set(out.schema["doc"].dataType.names)
    assert op10_lines.dedup_lines(nothing).count() == 0


def test_language(spark, docs, nothing):
    out = op6_language.query(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out if r["held_out"]]) > 0.97
    model = op6_language.train(spark.createDataFrame([(1, "the cat sat", "en"), (2, "die katze", "de")], "doc_id long, text string, lang string"))
    found = Counter((r["lang_pred"], r["score"]) for r in op6_language.identify(docs, model).collect() if r["doc_id"] in (200, 201, 202))
    assert found == {("und", 0.0): 3}
    assert model.classify("katzen")[0] == "de" and model.classify("cats")[0] == "en" and model.classify("12 34") == ("und", 0.0)
    none = op6_language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert none.classify("word") == ("und", 0.0) and op6_language.identify(nothing, none).count() == 0


def test_toxicity(spark, docs, nothing):
    sf = "/root/testdata/sf0.1"
    out = {r["doc_id"]: r for r in op1_toxicity.query(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if out[r["doc_id"]]["held_out"]]
    s, y = np.array([out[r["doc_id"]]["score"] for r in labels]), np.array([r["toxic"] for r in labels])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.93 and abs(s.mean() - y.mean()) < 0.05
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    untaught = op1_toxicity.train(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in op1_toxicity.score(docs, untaught).collect()} == {untaught.empty}
    assert op1_toxicity.score(nothing, untaught).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(400):
        terms = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(terms))
        vectors.append((terms, w / np.linalg.norm(w)))
    index = op1_toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((400, 60))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[::7]:
        q = np.zeros(60)
        q[t] = w
        cosine = dense @ q
        found, got = index.search(t, w, 10)
        assert np.allclose(got, np.sort(cosine)[::-1][:10]) and np.allclose(cosine[found], got)


def test_toxicity_uses_words_of_few_examples(spark):
    texts = [(i, f"plain talk about item{chr(97 + i % 26)} and weather") for i in range(60)]
    texts += [(60, "you blorp plain talk"), (61, "what a blorp again weather"), (70, "blorp"), (71, "talk")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = op1_toxicity.train(docs, spark.createDataFrame([(i, int(i >= 60)) for i in range(62)], "doc_id long, label int"))
    assert set(model.place) == {w for i, t in texts[:62] for w in op1_toxicity.words(t)}
    out = {r["doc_id"]: r for r in op1_toxicity.score(docs, model, evidence=2).collect()}
    assert {e["doc_id"] for e in out[70]["evidence"]} == {60, 61} and all(r["evidence"] for r in out.values())
    assert out[70]["score"] > out[71]["score"]


def test_block_max_index_is_exact_with_common_words():
    rng = np.random.default_rng(5)
    dense = np.zeros((700, 300))
    for row in dense:
        terms = np.unique(np.append(rng.zipf(1.3, 25) % 300, rng.integers(0, 300, 4)))
        row[terms] = rng.random(len(terms))
        row /= np.linalg.norm(row)
    vectors = [(np.flatnonzero(row), row[row > 0]) for row in dense]
    index = op1_toxicity.BlockMaxIndex(vectors, 300)
    assert 0 < len(index.most) < 300
    for t, w in vectors[::7] + [(np.array([1]), np.ones(1)), (np.array([1, 2, 3]), np.full(3, 3 ** -0.5))]:
        cosine = dense[:, t] @ w
        found, got = index.search(t, w, 10)
        assert np.allclose(got, np.sort(cosine)[::-1][:10]) and np.allclose(cosine[found], got)


def test_registered(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op") and "_" in n and n[2:n.index("_")].isdigit()]
    assert sorted(int(n[2:n.index("_")]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_block_max_index_sums_few_entries(monkeypatch):
    """Grouped bounds leave few entries to be summed up, and a batch of searches finds what single ones find."""
    rng = np.random.default_rng(8)
    dense = np.zeros((4000, 600))
    for row in dense:
        terms = np.unique(rng.integers(0, 600, 40))
        row[terms] = rng.random(len(terms)) ** 4
        row /= np.linalg.norm(row)
    vectors = [(np.flatnonzero(row), row[row > 0]) for row in dense]
    index = op1_toxicity.BlockMaxIndex(vectors, 600)
    assert len(index.group) > len(index.most) == op1_toxicity.GROUPS
    summed, plain = [], op1_toxicity.BlockMaxIndex._with_common
    monkeypatch.setattr(op1_toxicity.BlockMaxIndex, "_with_common", lambda self, score, found, *query: summed.append(len(found)) or plain(self, score, found, *query))
    queries = vectors[::37] + [(np.zeros(0, np.int64), np.zeros(0))]
    for (t, w), (found, got) in zip(queries, index.search_many(queries, 10), strict=True):
        cosine = dense[:, t] @ w
        assert np.allclose(got, np.sort(cosine)[::-1][:10] if len(t) else []) and np.allclose(cosine[found], got)
    assert sum(summed) < 0.1 * index.size * len(queries)


def test_words_of_any_characters():
    for text in ("", None, "Ab c_d3e", "Éa²b ªxº Straße\xa0ÿ", "naïve — “Ünder” İx", "".join(map(chr, range(1, 700)))):
        assert op1_toxicity.words(text) == (op1_toxicity._LETTERS.findall(text.lower()) if text else [])


def test_agreeing_neighbours():
    """Couples of suffixes that share long prefixes are put in order word by word; which share `length` bytes is asked once."""
    for _ in range(60):
        base = bytes(random.choice(b"ab\x00\xc3") for _ in range(90))
        block = b"\xff".join([base, base[:70] + b"z" * random.randint(0, 30), base[40:]]) + b"\xff"
        order = suffixes.suffix_array(block, 64)
        assert [block[i:i + 64] for i in order] == sorted(block[i:i + 64] for i in range(len(block)))
        for length in (20, 33, 64, 500):
            want = [k for k, (a, b) in enumerate(zip(order, order[1:])) if len(block[max(a, b):]) >= length and block[a:a + length] == block[b:b + length]]
            assert suffixes.agreeing(block, order, length).tolist() == want


def test_label_model_steps_share_their_code(spark):
    """What a step of the fit learns travels as data: no number of the model is written into the expressions."""
    model = op9_quality.LabelModel(["r0", "r1"], 0.7)
    votes = spark.createDataFrame([(a, b) for a in (-1, 0, 1, None) for b in (-1, 0, 1, 2)], "r0 int, r1 int")
    plain = (f"(1D / (1D + exp(-cast({math.log(0.7 / (1 - 0.7))!r} + CASE r0 WHEN 1 THEN {math.log(0.999 / 0.7)!r} WHEN -1 THEN {math.log((1 - 0.999) / 0.3)!r} ELSE 0D END"
             f" + CASE r1 WHEN 1 THEN {math.log(0.999 / 0.7)!r} WHEN -1 THEN {math.log((1 - 0.999) / 0.3)!r} ELSE 0D END AS double))))")
    assert all(r[0] == r[1] for r in votes.select(model.posterior(), F.expr(plain)).collect())

    def code(prior):
        plan = votes.select(op9_quality.LabelModel(["r0", "r1"], prior).posterior())._jdf.queryExecution()
        return re.sub(r"#\d+L?|references\[\d+\] \S+.*|/\*.*?\*/", "", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan()).split("Generated code:")[1])

    assert code(0.7) == code(0.6)
