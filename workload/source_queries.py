"""Readers and writers: tables are written in the reader's format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.operators import impact, merge, reshape
from veneer.session import scratch_path
from veneer.sources import readers, writers
from veneer.streaming import predictions as stream
from workload.common import PREDICTIONS_SQL, documents, pairs, predictions, spread, table
from workload.impact_queries import FLAGS, LAST, METRICS, SPLITS, flags, subsets
from workload.common import rounded

QUERIES, ORACLES = {}, {}
PAIR_NAMES = {"category": "Category", "question": "Question", "true_text": "Best Answer", "false_text": "Best Incorrect Answer"}
MD5S = "md5(doc1) AS best_md5, md5(doc0) AS incorrect_md5"
PAIR_DOCS = """pd AS (SELECT doc_id // 2 AS pair_id, max(lang) FILTER (doc_id % 2 = 0) AS category, max(source) FILTER (doc_id % 2 = 0) AS question,
  max(text) FILTER (doc_id % 2 = 0) AS doc1, max(text) FILTER (doc_id % 2 = 1) AS doc0 FROM documents GROUP BY 1)"""


def digest(*columns):
    return [F.md5(F.col(f"`{c}`").cast("binary")).alias(a) for c, a in columns]


def _pair_csv(spark, sf):
    path = scratch_path(spark, "pairs")
    p = pairs(spark, sf).withColumn("Type", F.lit("Adversarial"))
    for old, new in PAIR_NAMES.items():
        p = p.withColumnRenamed(old, new)
    writers.write_table_csv(p.withColumnRenamed("pair_id", "id"), path)
    back = readers.read_pairs(spark, path, id_column="id")
    return back.select("pair_id", F.col("Category").alias("category"), F.col("Question").alias("question"),
                       *digest(("Best Answer", "best_md5"), ("Best Incorrect Answer", "incorrect_md5")))


QUERIES["pair_table_csv"] = _pair_csv
ORACLES["pair_table_csv"] = f"WITH {PAIR_DOCS} SELECT pair_id, category, question, {MD5S} FROM pd"


def _pair_positions(spark, sf):
    """Row positions when the file has no id column: dense, in file order."""
    path = scratch_path(spark, "pairs")
    p = pairs(spark, sf).select("pair_id", F.col("question").alias("Question"), F.col("category").alias("Best Answer"),
                                F.col("pair_id").cast("string").alias("Best Incorrect Answer"))
    writers.write_table_csv(p.orderBy("pair_id").drop("pair_id"), path)
    back = readers.read_pairs(spark, path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.min("pair_id").alias("low"), F.max("pair_id").alias("high"),
                    F.count_distinct("pair_id").alias("n_ids"),
                    F.count_if(F.col("pair_id").cast("string") == F.col("Best Incorrect Answer")).alias("in_order"))


QUERIES["pair_table_row_positions"] = _pair_positions
ORACLES["pair_table_row_positions"] = f"WITH {PAIR_DOCS} SELECT count(*) AS n, 0 AS low, count(*) - 1 AS high, count(*) AS n_ids, count(*) AS in_order FROM pd"


def _legacy(spark, sf):
    d = documents(spark, sf)
    legacy = d.select(F.col("doc_id").alias("pair_id"), F.col("source").alias("question"), F.col("lang").alias("BestAnswer"),
                      F.concat(F.lit(" ; "), F.col("source"), F.lit(" ;"), F.col("lang")).alias("Incorrect Answers"))
    return reshape.coalesce_incorrect(legacy)


QUERIES["pair_column_fallbacks"] = _legacy
ORACLES["pair_column_fallbacks"] = "SELECT doc_id AS pair_id, source AS question, lang AS best_answer, source AS best_incorrect FROM documents"


def _labelled(kind):
    def run(spark, sf):
        d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
            F.col("doc_id").alias("case_id"), F.col("text").alias("claim"), (F.col("quality") == 1).alias("answer"))
        path = scratch_path(spark, "labelled") + "." + kind
        if kind == "parquet":
            d.write.parquet(path)
        elif kind == "csv":
            writers.write_table_csv(d, path)
        elif kind == "json":
            writers.write_json_arrays(d, path, "case_id")
        else:
            d.write.json(path)
        back = readers.read_labelled(spark, [path + ".absent", path], ("claim", "answer", "case_id"),
                                     None if kind == "parquet" else "case_id long, claim string, answer boolean")
        return back.select("case_id", F.md5(F.col("claim").cast("binary")).alias("claim_md5"), F.col("answer").cast("int").alias("label"))
    return run


for _k in ("parquet", "csv", "jsonl", "json"):
    QUERIES[f"labelled_text_{_k}"] = _labelled(_k)
    ORACLES[f"labelled_text_{_k}"] = "SELECT doc_id AS case_id, md5(text) AS claim_md5, (quality = 1)::INT AS label FROM documents JOIN labels USING (doc_id)"


def _claims(dedup):
    def run(spark, sf):
        path = scratch_path(spark, "claims")
        name = (F.when(F.col("lang") == "en", "SUPPORTS").when(F.col("lang") == "fr", "refuted")
                .when(F.col("lang") == "de", "NOT ENOUGH INFO").otherwise("REFUTES"))
        table(spark, sf, "documents").select("doc_id", F.col("text").alias("claim"), name.alias("label")).orderBy("doc_id").drop(
            "doc_id").write.json(path)
        back = readers.read_claims(spark, path, dedup)
        return back.select("row_id", F.md5(F.col("claim_text").cast("binary")).alias("claim_md5"), "label")
    return run


_strip = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_CL = f"""WITH c AS (SELECT doc_id, {_strip} AS claim, (lang = 'en')::INT AS label FROM documents WHERE lang <> 'de' AND {_strip} <> '')"""
QUERIES["claims_jsonl_first_seen"] = _claims(True)
ORACLES["claims_jsonl_first_seen"] = _CL + """, f AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY doc_id) AS rn FROM c)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, md5(claim) AS claim_md5, label FROM f WHERE rn = 1"""
QUERIES["claims_jsonl_all"] = _claims(False)
ORACLES["claims_jsonl_all"] = _CL + " SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, md5(claim) AS claim_md5, label FROM c"


def _records(spark, sf):
    """Records of a JSON file with count and id checks; the generation record has a cue list."""
    path = scratch_path(spark, "records")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("topic"),
                                             F.array("lang", "source").alias("intended_cues"), (F.col("n_chars") / 100.0).alias("confidence"))
    # arrays of at most 10,000 records, one per file
    docs = d.groupBy(F.expr("id div 10000").alias("part")).agg(F.to_json(F.collect_list(F.struct(*d.columns))).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(path)
    back = readers.read_records(spark, path + "/*/*.txt", "id", "id long, topic string, intended_cues array<string>, confidence double", d.count())
    return back.select("id", "topic", F.array_join("intended_cues", "|").alias("cues"), F.round("confidence", 6).alias("confidence"))


QUERIES["generation_records_json"] = _records
ORACLES["generation_records_json"] = "SELECT doc_id AS id, source AS topic, lang || '|' || source AS cues, round(n_chars / 100.0::DOUBLE, 6) AS confidence FROM documents"


def _bilateral(spark, sf):
    path = scratch_path(spark, "bilateral")
    p = pairs(spark, sf)
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    delta = words("false_text") - words("true_text")
    p.select("pair_id", F.struct(F.col("true_text").alias("statement"), F.lit("TRUE").alias("truth_label"), F.col("category").alias("topic"),
                                 F.lit(True).alias("judge_agrees_true")).alias("A_side"),
             F.struct(F.col("false_text").alias("statement"), F.lit("FALSE").alias("truth_label"), F.col("category").alias("topic"),
                      F.lit(True).alias("judged_false")).alias("B_side"),
             F.struct(delta.alias("word_count_delta_B_minus_A"), (delta >= 8).alias("delta_ok_ge_8"), F.lit(True).alias("same_topic")
                      ).alias("pair_constraints")).write.json(path)
    back = readers.read_jsonl(spark, path)
    return back.select("pair_id", *digest(), F.md5(F.col("A_side.statement").cast("binary")).alias("a_md5"), "A_side.truth_label",
                       "B_side.judged_false", F.col("pair_constraints.delta_ok_ge_8").alias("delta_ok"))


QUERIES["bilateral_jsonl"] = _bilateral
ORACLES["bilateral_jsonl"] = rf"""WITH {PAIR_DOCS} SELECT pair_id, md5(doc1) AS a_md5, 'TRUE' AS truth_label, true AS judged_false,
  len(string_split_regex(trim(doc0, ' '), '\s+')) - len(string_split_regex(trim(doc1, ' '), '\s+')) >= 8 AS delta_ok FROM pd"""


def prediction_files(spark, sf) -> str:
    """One CSV folder per model and hour, as runs are delivered."""
    path = scratch_path(spark, "runs")
    p = predictions(spark, sf)
    (p.withColumn("seed", F.concat(F.lit("seed"), F.substring("source_file", 19, 2))).repartition("model_name", "seed")
     .sortWithinPartitions("model_name", "seed", "row_no").withColumn("run", F.col("model_name"))
     .select("run", "seed", "model_name", "pair_id", "correct").write.option("header", True).partitionBy("run", "seed").csv(path))
    return path


def _pred_scan(spark, sf):
    """Run folders read with one glob; the example file never matches."""
    got = readers.read_predictions(spark, prediction_files(spark, sf) + "/*/*/*.csv")
    return got.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"), F.sum("pair_id").alias("pair_sum"), F.sum("correct").alias("n_right"))


QUERIES["prediction_file_scan"] = _pred_scan
ORACLES["prediction_file_scan"] = f"WITH {PREDICTIONS_SQL} SELECT model_name, count(*) AS n, sum(pair_id) AS pair_sum, sum(correct) AS n_right FROM p GROUP BY 1"


def _discover(spark, sf):
    path = prediction_files(spark, sf)
    writers.write_table_csv(table(spark, sf, "nation"), path + "/other")
    found = readers.discover_predictions(spark, path)
    tag = readers.run_tag(F.regexp_replace("path", ".*/run=", "run="), F.col("model_name"))
    return found.filter("is_prediction").select("model_name", tag.alias("tag")).distinct()


QUERIES["discover_prediction_files"] = _discover
ORACLES["discover_prediction_files"] = f"""WITH {PREDICTIONS_SQL}, h AS (SELECT DISTINCT model_name, substr(source_file, 19, 2) AS hh FROM p)
SELECT model_name, 'model_predictions_' || model_name || '_seed' || hh::INT || '_seed_seed' || hh || '.csv' AS tag FROM h"""


def _tags(spark, sf):
    d = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return d.select("page_id", readers.slug(F.col("url")).alias("slug"), readers.seed_of(F.col("url")).alias("seed"))


QUERIES["run_tags_and_seeds"] = _tags
ORACLES["run_tags_and_seeds"] = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '\s+', '_', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  CASE WHEN regexp_matches(url, '(?:seed|SEED)\d+') THEN regexp_extract(url, '(?:seed|SEED)(\d+)', 1)::BIGINT
    WHEN regexp_matches(url, '\b\d{2,4}\b') THEN regexp_extract(url, '\b(\d{2,4})\b', 1)::BIGINT END AS seed FROM pages"""


def _subset_json(spark, sf):
    """Subsets with metadata written as one document each and read back."""
    path = scratch_path(spark, "subsets")
    meta = subsets(spark, sf).groupBy("subset_name").agg(F.lit("prefix").alias("selection_method"), F.max("pair_id").alias("largest_id"))
    docs = writers.subset_documents(subsets(spark, sf), meta)
    docs.select("subset_name", F.col("document").alias("value")).repartition("subset_name").write.partitionBy("subset_name").text(path)
    back = readers.read_subset(spark, path + "/*/*.txt")
    return back.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_subsets"))


QUERIES["subset_json_documents"] = _subset_json
ORACLES["subset_json_documents"] = """SELECT doc_id // 2 AS pair_id, count(*) AS n_subsets FROM documents WHERE doc_id % 2 = 0 GROUP BY 1
UNION ALL SELECT doc_id // 2 + 1000000000, count(*) FROM documents WHERE doc_id % 2 = 0 GROUP BY 1"""


def _subset_lines(spark, sf):
    """The same documents, written a line per id, so that no row holds a subset."""
    path = scratch_path(spark, "subsets")
    meta = subsets(spark, sf).groupBy("subset_name").agg(F.lit("prefix").alias("selection_method"), F.max("pair_id").alias("largest_id"))
    writers.write_subset_documents(subsets(spark, sf), path, meta)
    back = readers.read_subset(spark, path + "/*/*.txt")
    return back.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_subsets"))


QUERIES["subset_json_lines"] = _subset_lines
ORACLES["subset_json_lines"] = ORACLES["subset_json_documents"]


def _manifest(spark, sf):
    """Two manifests with different columns on one shape."""
    a, b = scratch_path(spark, "manifest"), scratch_path(spark, "manifest")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    one, two = o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'")
    name = lambda p: F.concat(F.lit(p), "o_orderkey").alias("subset_name")
    js = F.when(F.col("o_custkey") % 10 > 0, F.concat(F.lit("ids/"), "o_orderkey", F.lit(".json"))).alias("canonical_json")
    writers.write_table_csv(one.select(name("Fixed_"), js, F.lit(" ").alias("retained_pairs"), F.col("o_custkey").alias("target_kept_count"),
                                       F.col("o_totalprice").alias("mean_heldout_auc")), a)
    writers.write_table_csv(two.select(name("Pruned_"), js, (F.col("o_custkey") + 0.0).alias("pruned_pair_count"), F.lit("n/a").alias("grouped_cv_oof_auc"),
                                       F.col("o_totalprice").alias("grouped_cv_oof_accuracy")), b)
    m = readers.read_manifest(spark, [a, b], {"Fixed_": "fixed_prefix", "Pruned_": "audit_prune"})
    return rounded(m.drop("manifest_path"), ["grouped_cv_auc", "grouped_cv_accuracy"])


QUERIES["subset_manifests"] = _manifest
ORACLES["subset_manifests"] = """SELECT CASE WHEN o_orderstatus = 'F' THEN 'Fixed_' ELSE 'Pruned_' END || o_orderkey AS subset_name,
  CASE WHEN o_orderstatus = 'F' THEN 'fixed_prefix' ELSE 'audit_prune' END AS subset_family, 'ids/' || o_orderkey || '.json' AS canonical_json, o_custkey AS retained_pairs,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS grouped_cv_auc, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS grouped_cv_accuracy
FROM orders WHERE o_custkey % 10 > 0"""


def _commented(spark, sf):
    path = scratch_path(spark, "commented")
    d = table(spark, sf, "supplier").select(F.concat_ws(",", "s_suppkey", "s_nationkey").alias("value"), F.lit(2).alias("o"))
    head = spark.range(3).select(F.element_at(F.array(F.lit("# frozen rows"), F.lit("# second note"), F.lit("suppkey,nationkey")),
                                              (F.col("id") + 1).cast("int")).alias("value"), F.when(F.col("id") < 2, 0).otherwise(1).alias("o"))
    head.unionByName(d).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return readers.read_commented_csv(spark, path).select(F.col("suppkey").cast("long").alias("suppkey"), F.col("nationkey").cast("int").alias("nationkey"))


QUERIES["csv_with_comments"] = _commented
ORACLES["csv_with_comments"] = "SELECT s_suppkey AS suppkey, s_nationkey AS nationkey FROM supplier"


def _vectors(spark, sf):
    v = readers.read_vectors(spark, f"{sf}/embeddings.parquet")
    return v.select("vec_id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


QUERIES["vector_scan"] = _vectors
ORACLES["vector_scan"] = "SELECT vec_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings"


def _whole_vectors(spark, sf):
    """Every entry tells: the sum, and the sum of entries times their place."""
    v = readers.read_vectors(spark, f"{sf}/embeddings.parquet")
    add = lambda a: F.round(F.aggregate(a, F.lit(0.0).cast("double"), lambda t, x: t + x), 4)
    number = F.transform("embedding", lambda x: x.cast("double"))
    return v.select("vec_id", F.size("embedding").alias("dim"), add(number).alias("total"),
                    add(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))).alias("placed"))


QUERIES["vector_scan_whole"] = _whole_vectors
ORACLES["vector_scan_whole"] = """SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total,
  round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS placed FROM embeddings"""


def _legacy_texts(spark, sf):
    legacy = documents(spark, sf).select(F.col("doc_id").alias("pair_id"), F.col("source").alias("question"), F.col("text").alias("BestAnswer"),
                                         F.concat(F.lit(" ; "), F.regexp_replace("text", ";", ","), F.lit(" ;"), F.col("lang")).alias("Incorrect Answers"))
    out = reshape.coalesce_incorrect(legacy)
    return out.select("pair_id", "question", *digest(("best_answer", "best_md5"), ("best_incorrect", "incorrect_md5")))


QUERIES["pair_column_fallback_texts"] = _legacy_texts
ORACLES["pair_column_fallback_texts"] = r"""SELECT doc_id AS pair_id, source AS question, md5(text) AS best_md5,
  md5(coalesce(nullif(regexp_replace(replace(text, ';', ','), '^\s+|\s+$', '', 'g'), ''), lang)) AS incorrect_md5 FROM documents"""


def _feature_sink(spark, sf):
    from workload.common import doc_features
    path = scratch_path(spark, "features")
    writers.write_features(doc_features(spark, sf), path, partition_by=("lang",))
    back = spark.read.parquet(path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))


QUERIES["feature_table_sink"] = _feature_sink
ORACLES["feature_table_sink"] = r"SELECT lang, count(*) AS n, sum(len(regexp_extract_all(text, '[^\s]+')))::DOUBLE AS words FROM documents GROUP BY 1"


def _export(spark, sf):
    p = pairs(spark, sf).select("pair_id", "category", "question")
    return writers.export_subset(p, flags(spark, sf), subsets(spark, sf)).select("pair_id", "category", "question", "style_violation", "subset_name")


QUERIES["subset_export_rows"] = _export
ORACLES["subset_export_rows"] = f"""WITH {FLAGS}, {PAIR_DOCS} SELECT pair_id, pd.category, question, style_violation, 'subset_' || question AS subset_name FROM pd JOIN fl USING (pair_id)"""


def _guarded(spark, sf):
    """A sheet is written, a second run skips it, and resuming leaves only unlabelled documents."""
    path = scratch_path(spark, "sheet")
    d = table(spark, sf, "documents").select("doc_id", "lang", F.lit("").alias("my_notes"))
    states = [writers.write_guarded(d, path, ["my_notes"]), writers.write_guarded(d, path, ["my_notes"]),
              writers.write_guarded(d, path, ["my_notes"], overwrite=True)]
    left = writers.pending(spark.read.options(header=True).csv(path).withColumn("doc_id", F.col("doc_id").cast("long")),
                           table(spark, sf, "labels"), "doc_id")
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n_pending")).withColumn("states", F.lit(",".join(states)))


QUERIES["guarded_write_and_resume"] = _guarded
ORACLES["guarded_write_and_resume"] = """SELECT lang, count(*) AS n_pending, 'written,skipped,overwritten' AS states FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1"""


def _streamed(spark, sf):
    """Prediction files arriving as a stream: the merged impact equals the batch result."""
    folder, log, check = (scratch_path(spark, n) for n in ("arriving", "log", "offsets"))
    p = predictions(spark, sf).withColumn("source_file", F.lit("one.csv"))
    last = merge.last_wins(p).select("model_name", "pair_id", "correct")
    last.coalesce(4).write.option("header", True).csv(folder)
    query = stream.start_ingest(spark, folder, log, check, max_files=2)
    query.awaitTermination()
    return rounded(stream.impact_view(spark, log, flags(spark, sf)), METRICS)


QUERIES["streamed_prediction_ingest"] = _streamed
ORACLES["streamed_prediction_ingest"] = f"""WITH {FLAGS}, p AS (SELECT 'one.csv' AS source_file, event_id AS row_no, event_type AS model_name, user_id AS pair_id, (value > 10)::INT AS correct FROM events),
m AS ({LAST}) SELECT model_name, {SPLITS} FROM m JOIN fl USING (pair_id) GROUP BY 1"""
