"""What SQL can say of the fits: the numbers they start from, the labels they are given, and that they are optimal.

A Newton fit has no SQL form, but its parts do: means and scales of every fold's training rows, the null labels dealt
from draws, the control sets, and, for the weights found, that the gradient of the penalised loss is zero there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veneer.functions.draws import WORD_BITS
from veneer.operators import ordering, trial_labels
from veneer.operators.scoring import sigmoid
from veneer.operators.single import attach
from veneer.plans import subset_search as ss, surface_audit as sa
from workload.audit_queries import folded
from workload.common import FEATURES, rounded, sql_answers, sql_draw, table

QUERIES, ORACLES = {}, {}
FOLDS = 5
_BITS = (1 << WORD_BITS) - 1
_folds = " UNION ALL ".join(f"SELECT pair_id, label, '{f}' AS feature, {f}::DOUBLE AS value FROM a" for f in FEATURES)


def _standardisation(spark, sf):
    """Means and scales of the training rows of each fold (fold 5: all rows)."""
    fit = sa.observed(folded(spark, sf), FEATURES, ["row_id"], FOLDS).fit
    rows = [(k, f, float(fit.means[0, k, j]), float(fit.scales[0, k, j])) for k in range(FOLDS + 1) for j, f in enumerate(FEATURES)]
    return rounded(spark.createDataFrame(rows, "fold int, feature string, mean double, scale double"), ["mean", "scale"])


QUERIES["fold_standardisation"] = _standardisation
ORACLES["fold_standardisation"] = f"""WITH {sql_answers()}, l AS ({_folds}),
s AS (SELECT k::INT AS fold, feature, avg(value) AS m, var_pop(value) AS v FROM l, range({FOLDS + 1}) t(k) WHERE pair_id % {FOLDS} <> k GROUP BY ALL)
SELECT fold, feature, round(m, 6) AS mean, round(CASE WHEN v <= 1e-12 * (1 + m * m) THEN 1 ELSE sqrt(v) END, 6) AS scale FROM s"""


def _optimality(spark, sf):
    """Of every fold's fit: its rows, and whether the penalised gradient of each weight is zero. Worked out from the
    weights by plain columns, not by the code that found them."""
    rows = folded(spark, sf)
    fit = sa.observed(rows, FEATURES, ["row_id"], FOLDS).fit
    sums = []
    for k in range(FOLDS + 1):
        w, mean, scale = fit.weights[0, k], fit.means[0, k], fit.scales[0, k]
        eta = sum((F.col(f).cast("double") * float(w[j + 1]) for j, f in enumerate(FEATURES)), F.lit(float(w[0])))
        inside, off = F.col("fold") != k, F.col("label") - sigmoid(eta)
        sums += [F.count_if(inside).alias(f"n{k}"), F.sum(F.when(inside, off)).alias(f"g{k}_intercept")]
        sums += [(F.sum(F.when(inside, off * (F.col(f) - float(mean[j])) / float(scale[j]))) - float(fit.z_weights[0, k, j + 1])).alias(f"g{k}_{f}")
                 for j, f in enumerate(FEATURES)]
    found = rows.agg(*sums)
    entries = [F.struct(F.lit(k).alias("fold"), F.lit(f).alias("feature"), F.col(f"n{k}").alias("n_rows"), (F.abs(f"g{k}_{f}") < 1e-6).alias("optimal"))
               for k in range(FOLDS + 1) for f in ("intercept", *FEATURES)]
    return found.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


QUERIES["fit_optimality"] = _optimality
_names = ", ".join(f"('{f}')" for f in ("intercept", *FEATURES))
ORACLES["fit_optimality"] = f"""WITH {sql_answers()}
SELECT k::INT AS fold, feature, (SELECT count(*) FROM a WHERE pair_id % {FOLDS} <> k) AS n_rows, true AS optimal
FROM range({FOLDS + 1}) t(k), (VALUES {_names}) f(feature)"""


def _labelled(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label"))


def _bits(column, n: int):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(
        F.get(column, F.floor(i / WORD_BITS).cast("int")), (i % WORD_BITS).cast("int")).cast("int"))


def _dealt(spark, sf):
    """Labels of 101 runs, dealt anew over all rows: per run how many ones, and which rows have them."""
    labelled = sa.null_labels(_labelled(spark, sf), "row_id", None, 101, 0, "global")
    rows = labelled.select("row_id", F.posexplode(_bits("null_words", 101)).alias("run", "y"))
    return rows.groupBy("run").agg(F.sum("y").alias("ones"), F.sum(F.col("row_id") * F.col("y")).alias("id_sum"))


QUERIES["dealt_null_labels"] = _dealt
ORACLES["dealt_null_labels"] = f"""WITH d AS (SELECT k::INT AS run, doc_id, {sql_draw("k", "'label'", "doc_id")} AS h FROM labels, range(101) t(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY h, doc_id) AS pos FROM d)
SELECT run, count(*) AS ones, sum(doc_id)::BIGINT AS id_sum FROM r WHERE pos <= (SELECT sum(quality) FROM labels) GROUP BY 1"""


def _swapped(spark, sf):
    """Bit words of 100 runs in which the answers of a pair trade labels."""
    rows = table(spark, sf, "documents").select(F.expr("doc_id div 2").alias("pair_id"), (F.col("doc_id") % 2).cast("int").alias("label"))
    words = sa.swapped_words(100, 42)
    return rows.select("pair_id", "label", *[F.get(words, F.lit(b)).alias(f"w{b}") for b in range(2)])


QUERIES["swapped_null_labels"] = _swapped
ORACLES["swapped_null_labels"] = "SELECT doc_id // 2 AS pair_id, (doc_id % 2)::INT AS label, " + ", ".join(
    f"""CASE WHEN doc_id % 2 = 1 THEN {_BITS} - {sql_draw("'42'", f"'{b}'", "(doc_id // 2)")} ELSE {sql_draw("'42'", f"'{b}'", "(doc_id // 2)")} END AS w{b}"""
    for b in range(2)) + " FROM documents"


def _controls(spark, sf):
    """Ten random sets of pairs, as large as the set of pairs with a good document."""
    pairs = table(spark, sf, "documents").select(F.expr("doc_id div 2").alias("pair_id")).distinct()
    size = table(spark, sf, "labels").filter("quality = 1").select(F.expr("doc_id div 2").alias("pair_id")).distinct().count()
    seeds = list(range(10))
    cuts = ordering.hash_cuts(pairs, "pair_id", seeds, [size] * 10, pairs.count(), stream="control")
    inside = attach(pairs, cuts).select("pair_id", F.posexplode(ordering.before_cut(F.col("cuts"), "pair_id", seeds, stream="control")).alias("control", "y"))
    return inside.filter("y = 1").groupBy("control").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("pair_id").alias("id_sum"))


QUERIES["anchor_control_sets"] = _controls
ORACLES["anchor_control_sets"] = f"""WITH p AS (SELECT DISTINCT doc_id // 2 AS pair_id FROM documents),
n AS (SELECT count(DISTINCT doc_id // 2) AS n FROM labels WHERE quality = 1),
r AS (SELECT k::INT AS control, pair_id, row_number() OVER (PARTITION BY k ORDER BY {sql_draw("k", "'control'", "pair_id")}, pair_id) AS pos FROM p, range(10) t(k))
SELECT control, count(*) AS n_pairs, sum(pair_id)::BIGINT AS id_sum FROM r, n WHERE pos <= n.n GROUP BY 1"""


def _prefix_trials(spark, sf):
    """Rows of each side of every (prefix, split) trial of an order, as the fits of a search read them."""
    d = table(spark, sf, "documents")
    n = d.count()
    seeds, sizes = [42, 43, 44], [n // 4, n // 2, n]
    trials = [ss.Trial("all", k, s, side) for k in sizes for s in seeds for side in ("train", "hold", "all")]
    held = F.array(*[F.when(F.pmod(F.col("doc_id") + s, F.lit(4)) == 0, F.lit(s)) for s in seeds])
    ranked = ordering.global_rank(d.select("doc_id", "n_chars"), ["n_chars", "doc_id"])
    rows = ranked.select(F.lit(1).alias("label"), F.create_map(F.lit("all"), F.col("rank")).alias("ranks"), F.array_compact(held).alias("hold_seeds"))
    labels = ss.prefix_labels(trials)
    stored = rows.select(*[c.alias(name) for name, c in labels.columns.items()])
    reader = labels.reader

    def count(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(len(trials), np.int64)
        for batch in batches:
            total += (reader.take(batch, np.arange(len(trials))) != trial_labels.ABSENT).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trials), dtype=np.int32)), pa.array(total)], ["trial", "n"])

    counts = stored.mapInArrow(count, "trial int, n long").groupBy("trial").agg(F.sum("n").alias("n_rows"))
    names = spark.createDataFrame([(i, sizes.index(t.keep_n), t.seed, t.side) for i, t in enumerate(trials)], "trial int, size int, seed int, side string")
    return names.join(counts, "trial").drop("trial")


QUERIES["prefix_trial_sizes"] = _prefix_trials
ORACLES["prefix_trial_sizes"] = """WITH n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents),
z AS (SELECT 0 AS size, n // 4 AS k FROM n UNION ALL SELECT 1, n // 2 FROM n UNION ALL SELECT 2, n FROM n)
SELECT z.size, s.seed, d.side, count(*) FILTER (d.side = 'all' OR ((doc_id + s.seed) % 4 = 0) = (d.side = 'hold')) AS n_rows
FROM r, z, (VALUES (42), (43), (44)) s(seed), (VALUES ('train'), ('hold'), ('all')) d(side) WHERE r.rank <= z.k GROUP BY ALL"""
