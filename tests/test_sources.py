"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from veneer.operators import reshape
from veneer.session import scratch_path
from veneer.sources import readers, writers


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_read_pairs_multiline(spark, tmp_path):
    path = write(tmp_path, "p.csv", 'Type,Category,Question,Best Answer,Best Incorrect Answer,Extra\nA,C,"Is ""it""\nso?",yes,no,x\nA,D,q2,a2,b2,y\n')
    rows = readers.read_pairs(spark, path).orderBy("pair_id").collect()
    assert [r["pair_id"] for r in rows] == [0, 1] and rows[0]["Question"] == 'Is "it"\nso?' and "Extra" not in rows[0].asDict()


def test_incorrect_answer_fallbacks(spark):
    df = spark.createDataFrame([(0, "q", "a", " ; first ;second"), (1, "q", "a", "only\nmore"), (2, "q", "a", "single")],
                               "pair_id int, Question string, `Best answer` string, `Incorrect Answers` string")
    assert [r["best_incorrect"] for r in reshape.coalesce_incorrect(df).orderBy("pair_id").collect()] == ["first", "only", "single"]
    with pytest.raises(ValueError):
        reshape.coalesce_incorrect(df.drop("Incorrect Answers"))


def test_labelled_suffixes(spark, tmp_path):
    write(tmp_path, "x.json", json.dumps([{"claim": "a", "label": "S"}, {"claim": "b", "label": "R"}]))
    df = readers.read_labelled(spark, [str(tmp_path / "x.parquet"), str(tmp_path / "x.json")], ("claim", "label"))
    assert df.count() == 2
    with pytest.raises(ValueError, match="case_id"):
        readers.read_labelled(spark, str(tmp_path / "x.json"), ("claim", "case_id"))
    with pytest.raises(FileNotFoundError):
        readers.read_labelled(spark, str(tmp_path / "none.csv"), ())


def test_claims(spark, tmp_path):
    lines = [("b", "SUPPORTS"), ("a", "REFUTED"), ("b", "REFUTES"), ("", "SUPPORTS"), ("c", "NOT ENOUGH INFO"), ("d", "supported")]
    path = write(tmp_path, "c.jsonl", "\n".join(json.dumps({"claim": c, "label": label}) for c, label in lines))
    assert [(r["row_id"], r["claim_text"], r["label"]) for r in readers.read_claims(spark, path).orderBy("row_id").collect()] == [
        (0, "b", 1), (1, "a", 0), (2, "d", 1)]
    assert readers.read_claims(spark, path, dedup=False).count() == 4


def test_predictions_and_discovery(spark, tmp_path):
    head = "model_name,pair_id,correct\n"
    write(tmp_path, "model_predictions_b.csv", head + "org/m,0,1\norg/m,0,0\n")
    write(tmp_path, "model_predictions_a.csv", head + "org/m,1,1\n")
    write(tmp_path, "example_model_predictions.csv", head + "demo,0,1\n")
    df = readers.read_predictions(spark, str(tmp_path / "*model_predictions*.csv"))
    assert {r["source_file"] for r in df.select("source_file").distinct().collect()} == {"model_predictions_a.csv", "model_predictions_b.csv"}
    from veneer.operators.merge import first_in_file_last_file, last_wins
    assert last_wins(df).filter("pair_id = 0").first()["correct"] == 0
    assert first_in_file_last_file(df).filter("pair_id = 0").first()["correct"] == 1
    write(tmp_path, "deep/run seed12/out.csv", head + "org/m x,3,1\n")
    write(tmp_path, "deep/other.csv", "a,b\n1,2\n")
    found = readers.discover_predictions(spark, str(tmp_path / "deep"))
    tags = found.filter("is_prediction").select(readers.run_tag(F.regexp_replace("path", "%20", " "), F.col("model_name")).alias("t")).collect()
    assert [t["t"] for t in tags] == ["model_predictions_org_m_x_seed12_run_seed12.csv"]
    fallback = readers.read_predictions(spark, str(tmp_path / "none*.csv"), str(tmp_path / "model_predictions_a.csv"))
    assert fallback.count() == 1


@pytest.mark.parametrize("path,want", [("a/seed7/x.csv", 7), ("a/SEED12", 12), ("runs/042/x", 42), ("runs/v1x", None), ("y/12345", None)])
def test_seed_of(spark, path, want):
    assert spark.range(1).select(readers.seed_of(F.lit(path)).alias("s")).first()["s"] == want


def test_subset_json_both_forms(spark, tmp_path):
    write(tmp_path, "one.json", "[3, 1]")
    write(tmp_path, "two.json", json.dumps({"n_pairs": 2, "pair_ids": [5, 6], "comparison": {"x": 1}}, indent=1))
    got = {(r["subset_file"], r["pair_id"]) for r in readers.read_subset(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("one", 3), ("one", 1), ("two", 5), ("two", 6)}


def test_subset_documents_round_trip(spark):
    members = spark.createDataFrame([("s", 3), ("s", 1), ("t", 9)], "subset_name string, pair_id long")
    docs = {r["subset_name"]: json.loads(r["document"]) for r in writers.subset_documents(members).collect()}
    assert docs["s"] == {"pair_ids": [1, 3], "n_pairs": 2}
    with pytest.raises(ValueError):
        writers.subset_documents(members, max_ids=1)


def test_documents_of_any_size(spark, tmp_path):
    members = spark.createDataFrame([("s", 3), ("s", 1), ("t", 9), ("s", 3), ("wide", 0)] + [("wide", i) for i in range(5000)], "subset_name string, pair_id long")
    meta = spark.createDataFrame([("s", "a {b}"), ("t", None)], "subset_name string, note string")
    writers.write_subset_documents(members.repartition(6), str(tmp_path / "docs"), meta)
    found = {p.parent.name.split("=")[1]: json.loads(p.read_text()) for p in (tmp_path / "docs").rglob("part-*.txt")}
    assert found["s"] == {"n_pairs": 2, "note": "a {b}", "pair_ids": [1, 3]} and found["t"]["pair_ids"] == [9]
    assert found["wide"]["pair_ids"] == list(range(5000))
    rows = spark.createDataFrame([(i, f'x "{i}"\n') for i in range(40)], "id long, text string")
    writers.write_json_arrays(rows, str(tmp_path / "rows.json"), "id", files=3)
    back = readers.read_labelled(spark, str(tmp_path / "rows.json"), ("id", "text"), "id long, text string")
    assert sorted((r["id"], r["text"]) for r in back.collect()) == [(i, f'x "{i}"\n') for i in range(40)]


def test_commented_csv_and_manifest(spark, tmp_path):
    path = write(tmp_path, "m.csv", "# note\n# more\nsubset_name,canonical_json,retained_pairs,target_kept_count\nFx_1,a.json, ,350\n,b.json,1,2\nother,c.json,n/a,7\n")
    assert readers.read_commented_csv(spark, path).count() == 3
    plain = write(tmp_path, "n.csv", (tmp_path / "m.csv").read_text().split("more\n")[1])
    rows = {r["subset_name"]: r for r in readers.read_manifest(spark, [plain], {"Fx_": "fixed_prefix"}).collect()}
    assert set(rows) == {"Fx_1", "other"}
    assert (rows["Fx_1"]["retained_pairs"], rows["Fx_1"]["subset_family"], rows["other"]["retained_pairs"], rows["other"]["subset_family"]) == (
        350, "fixed_prefix", 7, "other")


def test_records_checks(spark, tmp_path):
    path = write(tmp_path, "r.json", json.dumps([{"id": 1, "t": "x"}, {"id": 2, "t": "y"}]))
    assert readers.read_records(spark, path, "id", "id int, t string", 2).count() == 2
    with pytest.raises(ValueError, match="expected 3"):
        readers.read_records(spark, path, "id", "id int, t string", 3)
    with pytest.raises(ValueError, match="not unique"):
        readers.read_records(spark, write(tmp_path, "d.json", '[{"id": 1}, {"id": 1}]'), "id", "id int")


def test_guarded_write(spark):
    path = scratch_path(spark, "sheet")
    blank = spark.createDataFrame([(1, "")], "id int, notes string")
    assert writers.write_guarded(blank, path, ["notes"]) == "written"
    assert writers.write_guarded(blank, path, ["notes"]) == "skipped"
    filled = scratch_path(spark, "sheet")
    writers.write_table_csv(spark.createDataFrame([(1, "seen")], "id int, notes string"), filled)
    with pytest.raises(FileExistsError):
        writers.write_guarded(blank, filled, ["notes"], overwrite=True)


def test_required_columns(spark):
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        reshape.require_columns(spark.range(1).withColumnRenamed("id", "a"), ("a", "c", "b"))


def test_profile_names():
    assert reshape.normalize_profile("paper10") == "surface10" and reshape.normalize_profile("expanded13") == "surface13"
    with pytest.raises(ValueError):
        reshape.normalize_profile("surface99")


def test_align_needs_equal_lengths(spark):
    a = spark.range(3).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError):
        reshape.align_by_position(a, a.filter("row_id < 2"))


def test_parse_choices(spark):
    df = spark.createDataFrame([(("Yes.", "No", "Maybe"), (1, 0, 0)), (("a", "b"), (1, 1)), (("a", "b"), (0, 0))],
                               "c array<string>, l array<int>").select(F.struct(F.col("c").alias("choices"), F.col("l").alias("labels")).alias("mc1_targets")).coalesce(1)
    rows = reshape.parse_choices(df).collect()
    assert rows[0]["correct_norm"] == "yes" and rows[0]["wrong_norm"] == ["no", "maybe"]
    assert [r["choice_error"] for r in rows] == [None, "multiple correct labels", "no correct label"]


def test_streamed_files_of_one_name(spark, tmp_path):
    """Files of equal names in two folders stay apart, the last path wins, and so does the last row of a split file."""
    from veneer.streaming import predictions as stream
    head = "model_name,pair_id,correct\n"
    write(tmp_path, "in/a/run.csv", head + "m,1,1\nm,2,1\n")
    write(tmp_path, "in/b/run.csv", head + "m,1,0\n" + "n,7,0\n" * 2000 + "n,7,1\n")
    write(tmp_path, "in/b/example_model_predictions.csv", head + "m,2,0\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        stream.start_ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "log"), str(tmp_path / "at")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    rows = {(r["model_name"], r["pair_id"]): (r["source_file"], r["correct"]) for r in stream.merged_view(spark, str(tmp_path / "log")).collect()}
    assert rows == {("m", 1): ("b/run.csv", 0), ("m", 2): ("a/run.csv", 1), ("n", 7): ("b/run.csv", 1)}
