"""Counting selections, positions, matches and sums against plain Python; the plans that make them scale."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veneer.functions.draws import draw_word, poisson_weight
from veneer.operators import impact, merge, metrics, reshape, scoring, selection
from veneer.sources import readers

rng = random.Random(3)
VALUES = ([rng.gauss(0, 1) for _ in range(3000)] + [0.0, -0.0, 1e-300, -1e300, 5e-324, math.inf, -math.inf] + [0.25] * 4000
          + [rng.choice([1.0, 2.0, 3.0]) for _ in range(3000)])


def exchanges_of(df, column):
    """Shuffles whose rows have a column of this name."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    out = []
    for k, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            below = next((x for x in lines[k + 1:] if "Project" in x or "Scan" in x or "Aggregate" in x), "")
            if f"{column}#" in below.split("functions")[0]:
                out.append(line)
    return out


def test_order_statistics_of_any_doubles(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 16)  # so that several passes are needed
    df = spark.createDataFrame([(v,) for v in VALUES + [None, math.nan]], "v double").repartition(7)
    want = sorted(VALUES)
    places = [0, 1, 17, len(want) // 2, len(want) - 2, len(want) - 1, 5000, 5001]
    assert selection.order_statistics(df, "v", places) == [want[p] for p in places]
    with pytest.raises(ValueError):
        selection.order_statistics(df, "v", [len(want)])


def test_quantiles_equal_the_engines_percentile(spark):
    df = spark.createDataFrame([(v,) for v in VALUES if math.isfinite(v) and abs(v) < 100], "v double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.7501, 1.0]
    want = df.agg(*[F.percentile("v", s) for s in shares]).first()
    assert selection.quantiles(df, "v", shares) == list(want)
    assert selection.quantiles(df.filter("v > 1e9"), "v", shares) == [None] * 6


@pytest.mark.parametrize("k", [1, 40, 900, 4000])
@pytest.mark.parametrize("few", [8, 4096])
def test_select_highest_of_groups(spark, monkeypatch, k, few):
    monkeypatch.setattr(selection, "FEW", few)
    rows = [(rng.choice([0, 1, 7]), i, rng.choice([0.5, 0.25, rng.random(), -rng.random(), None, math.nan])) for i in range(3000)]
    df = spark.createDataFrame(rows, "trial int, pair_id long, score double").repartition(5)
    got = {(r["trial"], r["pair_id"]) for r in selection.select_highest(df, k, "score", "pair_id", "trial").collect()}
    want = set()
    for t in (0, 1, 7):
        own = sorted((-s, i) for g, i, s in rows if g == t and s is not None and not math.isnan(s))
        want |= {(t, i) for _, i in own[:k]}
    assert got == want


def test_positions_do_not_move_rows(spark, tmp_path):
    for name, n in (("b.csv", 400), ("a.csv", 3), ("c.csv", 250)):
        body = "".join(f'"{name} {i}\nmore",x\n' for i in range(n))
        (tmp_path / name).write_text("Question,Best Answer\n" + body)
    df = readers.read_pairs(spark, str(tmp_path / "*.csv"))
    got = {r["pair_id"]: r["Question"].split("\n")[0] for r in df.collect()}
    want = [f"{n} {i}" for n, k in (("a.csv", 3), ("b.csv", 400), ("c.csv", 250)) for i in range(k)]
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
    assert exchanges_of(df, "Question") == []


def test_claim_positions_over_split_files(spark, tmp_path):
    path = tmp_path / "claims.jsonl"
    texts = [f"claim {i % 700}" for i in range(3000)]
    path.write_text("".join(f'{{"claim": "{t}", "label": "{"SUPPORTS" if i % 3 else "NONE"}"}}\n' for i, t in enumerate(texts)))
    kept = [t for i, t in enumerate(texts) if i % 3]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        every = readers.read_claims(spark, str(path), dedup=False)
        assert every.rdd.getNumPartitions() > 3 and exchanges_of(every, "claim") == []
        assert [r["claim_text"] for r in every.orderBy("row_id").collect()] == kept
        first = readers.read_claims(spark, str(path)).orderBy("row_id").collect()
        assert [r["claim_text"] for r in first] == list(dict.fromkeys(kept)) and [r["row_id"] for r in first] == list(range(len(first)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_lines_read_no_more(spark, tmp_path):
    big = tmp_path / "big file.csv"
    big.write_text("model_name,pair_id,correct\nm,1,1\n" + "m,2,0\n" * 500_000)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "one.csv").write_text("a,b")
    stats = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    before = stats()
    found = {r["path"].rsplit("/", 1)[1]: r for r in readers.discover_predictions(spark, str(tmp_path)).collect()}
    assert stats() - before < 500_000 < big.stat().st_size
    assert set(found) == {"big%20file.csv", "one.csv"} and found["big%20file.csv"]["is_prediction"] and found["big%20file.csv"]["model_name"] == "m"


def test_first_seen_moves_digests(spark):
    rows = [(i, rng.choice(["a", "b", "", None, "c"])) for i in range(50)]
    df = spark.createDataFrame(rows, "at long, text string")
    got = merge.first_seen(df, "text", "at")
    want = {t: min(i for i, x in rows if x == t) for t in {x for _, x in rows}}
    assert {r["text"]: r["at"] for r in got.collect()} == want
    keys = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert not any("text#" in x.split("hashpartitioning")[1].split(")")[0] for x in keys)


def test_anchor_match_makes_no_row_that_does_not_fit(spark):
    """One question held by all: as many rows as postings, not as couples."""
    queries = [(i, "q", "a", [f"w{i % 7}", f"w{i % 7}", "none", None]) for i in range(300)] + [(900, "q", "b", ["w1"]), (901, None, "a", ["w1"]), (902, "q", "a", None)]
    pairs = [(i, "q", "a", f"w{i % 9}") for i in range(300)] + [(400, "q", "b", "w1"), (401, "q", "a", None)]
    q = spark.createDataFrame(queries, "row_id long, q_key string, a_key string, wrongs array<string>")
    p = spark.createDataFrame(pairs, "pair_id long, q_key string, a_key string, incorrect_key string")
    got = {r["row_id"]: r["pair_id"] for r in merge.match_anchors(q, p).collect()}
    for i, qk, ak, wrongs in queries:
        fits = [j for j, a, b, w in pairs if (a, b) == (qk, ak) and w is not None and w in (wrongs or [])]
        assert got[i] == (min(fits) if fits else None)


def test_flag_bits_count_like_rows(spark):
    flags = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "pair_id long, style_violation int")
    words = impact.permuted_flags(flags, list(range(5, 75)))
    runs = spark.createDataFrame([(f"f{k}", f"m{k % 2}", i, (i * k) % 3 == 0) for k in range(4) for i in range(80)],
                                 "source_file string, model_name string, pair_id long, ok boolean")
    joined = runs.join(words, "pair_id").select("source_file", "model_name", F.col("ok").cast("long").alias("right"), "words")
    got = {(r["source_file"], r["seed"]): r["__hit"] for r in impact._hits(joined.repartition(3), list(range(5, 75))).collect()}
    from veneer.operators.ordering import hash_sample
    drawn = hash_sample(flags.select("pair_id"), "pair_id", list(range(5, 75)), F.lit(20), stream="flag").collect()
    want = {(f"f{k}", s): 0 for k in range(4) for s in range(5, 75)}
    for r in drawn:
        for k in range(4):
            want[(f"f{k}", r["seed"])] += (r["pair_id"] * k) % 3 == 0
    assert got == want


def test_pooled_vectors_send_one_row_per_key_and_partition(spark):
    rows = [(i % 3, [float(rng.random()) for _ in range(6)], int(i % 5 > 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v array<double>, mask int").repartition(4)
    pooled = scoring.mean_pool(df, "k", "v", "mask")
    got = {(r["k"], r["position"]): r["value"] for r in pooled.collect()}
    for k in range(3):
        mean = np.mean([v for key, v, m in rows if key == k and m], axis=0)
        assert np.allclose([got[(k, j)] for j in range(6)], mean, atol=1e-12)
    plan = pooled._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("ObjectHashAggregate")  # entries are taken apart after the sums


def test_ranges_follow_the_partitions(spark):
    rows = [(rng.random(), rng.random() < 0.5) for _ in range(2000)]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "score double, label int")
    want = metrics.auc(df).first()["auc"]
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        assert metrics._levels(df) == 10 and metrics.auc(df).first()["auc"] == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_two_answer_texts_join_ranks(spark):
    df = spark.createDataFrame([(5, "r5", "w5"), (2, " ", "w2"), (9, "r9", "w9"), (1, "r1", None), (3, "r3", "w3")], "at long, r string, w string")
    got = sorted((r["pair_id"], r["claim_text"], r["label"]) for r in reshape.split_two_answers(df, "at", "r", "w").collect())
    assert got == [(0, "r3", 1), (0, "w3", 0), (1, "r5", 1), (1, "w5", 0), (2, "r9", 1), (2, "w9", 0)]


@pytest.mark.parametrize("parts", ["1", "9"])
def test_bootstrap_with_ties_over_many_tasks(spark, parts):
    """A third of all rows share a score, so their ties go over several tasks."""
    rows = [(i % 150, 0.5 if i % 3 == 0 else round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(900)]
    df = spark.createDataFrame(rows, "pair_id long, score double, label int")
    weights = df.select("pair_id").distinct().select("pair_id", *[poisson_weight(draw_word(7, r // 3, "pair_id"), r % 3).alias(f"w{r}") for r in range(5)])
    by_pair = {w["pair_id"]: [w[f"w{r}"] for r in range(5)] for w in weights.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["replicate"]: r["auc"] for r in metrics.bootstrap_auc(df, "pair_id", 5, 7).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for r in range(5):
        pos, neg = ([(s, by_pair[i][r]) for i, s, y in rows if y == side] for side in (1, 0))
        above = sum(w * v * (1.0 if s > t else 0.5 if s == t else 0.0) for s, w in pos for t, v in neg)
        assert got[r] == pytest.approx(above / sum(w for _, w in pos) / sum(v for _, v in neg), abs=1e-12)


def test_fingerprint_deals_a_table_into_parts_that_grow_with_it(spark, tmp_path):
    from workload.impact_queries import QUERIES
    spark.range(4000).select("id", (F.col("id") % 7).alias("v")).repartition(12).write.parquet(str(tmp_path / "lineitem.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions()
        got = QUERIES["table_fingerprint"](spark, str(tmp_path))
        assert parts >= 12 and f"RoundRobinPartitioning({2 * parts + 1})" in got._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in got.collect()] == [(1, 4000)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_last_rows_are_kept_without_sorting_a_task(spark):
    rows = [(f"f{i % 2}", i % 50, "m" if i % 3 else "n", (i * 7) % 40, i % 2) for i in range(3000)] + [("f0", None, "m", 3, 1), ("f9", 7, "m", 5, None)]
    df = spark.createDataFrame(rows, "source_file string, row_no long, model_name string, pair_id long, correct int").repartition(5)
    for got, better in ((merge.last_in_file(df), max), (merge.first_in_file(df), min)):
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
        known: dict = {}
        for file, no, model, pair, _ in rows:
            if no is not None:
                known[file, model, pair] = better(no, known.get((file, model, pair), no))
        found = {(r["source_file"], r["model_name"], r["pair_id"]): (r["row_no"], r["correct"]) for r in got.collect()}
        assert {k: v[0] for k, v in found.items() if v[0] is not None} == known
        assert all((f, v[0], m, p, v[1]) in set(rows) for (f, m, p), v in found.items() if v[0] is not None)
