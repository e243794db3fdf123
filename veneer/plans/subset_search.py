"""Search for prefixes of pair orders on which the surface signal is near chance.

All orders are ranked in one pass, all (order, size, split, side) trials are audited in
shared Newton passes; the pairs themselves stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veneer.functions.draws import uniform
from veneer.functions.text import PAIR_FEATURES
from veneer.operators import audit, trial_labels
from veneer.operators.ordering import (best_row, global_rank, holdout_split, prefix_sizes, priority,
                                       quantile_bin, top_k)
from veneer.operators.scoring import imbalance_penalty, search_objective, sigmoid
from veneer.session import cut_lineage

FOLDS = 5
#: Trials whose fits share the passes: their number costs a task 80 cells per fit.
CHUNK = 4 * audit.CHUNK
#: Sizes of an order are fitted in this many steps of width, each from the weights of the sizes around it.
STRIDES = (16, 4, 1)


def _keys(*columns) -> list[Column]:
    cols = [c if isinstance(c, Column) else F.col(c) for c in columns]
    return [c.cast("double") for c in cols] + [F.lit(0.0)] * (3 - len(cols))


def order_definitions(starts: dict[int, int] | None = None) -> dict[str, list[Column]]:
    """Up to three sort keys per order; the id breaks ties. ``starts`` maps seed to start count."""
    orders = {f"prefix_grid/{m}": _keys(priority(m)) for m in ("negation_only", "length_only", "neg_len", "all_features")}
    orders["negation_first/all_features"] = _keys(priority("negation_first"))
    orders["feature_balanced/all_features"] = _keys("negation_flag", "length_gap")
    orders["feature_balanced_bins/all_features"] = _keys("len_bin", "negation_flag", "length_gap")
    for seed, n in (starts or {}).items():
        for s in range(n):
            noise = 1e-6 * (uniform(f"{seed}.{s}", "start", "example_id") - 0.5)
            orders[f"multi_start/{seed}.{s}"] = _keys(priority("all_features") + noise)
    return orders


def rank_orders(cands: DataFrame, orders: dict[str, list[Column]], key: str = "example_id") -> DataFrame:
    """(key, ranks MAP<order, rank>) for any number of orders with one range shuffle."""
    binned = quantile_bin(cands, "length_gap", 4, "len_bin")
    entries = [F.struct(F.lit(name).alias("order"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
               for name, keys in orders.items()]
    long = binned.select(key, F.explode(F.array(*entries)).alias("o")).select(key, "o.*")
    ranked = global_rank(long, ["k0", "k1", "k2", key], by=["order"])
    return ranked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("order", "rank"))).alias("ranks"))


@dataclass(frozen=True)
class Trial:
    order: str
    keep_n: int
    seed: int
    side: str  # train, hold or all


def prefix_labels(trials: list[Trial]) -> trial_labels.Labels:
    """Labels of trials on `prepare`'d rows: each row's ranks and held-out splits decide, no trial adds a column."""
    orders, seeds = sorted({t.order for t in trials}), sorted({t.seed for t in trials})
    ranks = F.array(*[F.coalesce(F.try_element_at("ranks", F.lit(o)).cast("int"), F.lit(0)) for o in orders])
    held = F.transform(F.array(*[F.lit(s) for s in seeds]), lambda s: F.coalesce(F.array_contains("hold_seeds", s).cast("int"), F.lit(0)))
    reader = trial_labels.Prefixes(
        np.array([orders.index(t.order) for t in trials]), np.array([t.keep_n for t in trials]),
        np.array([-1 if t.side == "all" else seeds.index(t.seed) for t in trials]), np.array([t.side == "hold" for t in trials]))
    columns = {"y": F.col("label").cast("tinyint"), "ranks": ranks, "held": trial_labels.packed(held, len(seeds))}
    return trial_labels.Labels(columns, reader, len(trials))


def prepare(cands: DataFrame, answers: DataFrame, seeds: list[int], orders: dict[str, list[Column]],
            holdout: float = 0.25) -> DataFrame:
    """Answer rows with the ranks of every order and the seeds that hold the pair out."""
    held = (holdout_split(cands.select("example_id"), "example_id", seeds, holdout)
            .groupBy("example_id").agg(F.collect_set("seed").alias("hold_seeds")))  # at most len(seeds)
    ranks = rank_orders(cands, orders)
    side = ranks.join(held, "example_id", "left").withColumnRenamed("example_id", "pair_id")
    # every pass of the fits reads this table again
    return cut_lineage(answers.join(side, "pair_id"), every_core=True)


def separability_keys(answers: DataFrame, cands: DataFrame, seeds: list[int], features=PAIR_FEATURES,
                      holdout: float = 0.25) -> DataFrame:
    """Candidates with ``sep_<seed>``: mean |p - 1/2| under a fit on the training side, else 0; minus 1/2, as the
    distance to certainty keeps pairs apart whose probabilities are all but 0 or 1."""
    held = (holdout_split(cands.select("example_id"), "example_id", seeds, holdout)
            .groupBy(F.col("example_id").alias("pair_id")).agg(F.collect_set("seed").alias("hold_seeds")))
    rows = answers.join(held, "pair_id", "left")
    train = [~F.coalesce(F.array_contains("hold_seeds", s), F.lit(False)) for s in seeds]
    labels = [F.when(t, F.col("label")).otherwise(trial_labels.ABSENT) for t in train]
    run = audit.run_audit(rows, features, [], trial_labels.stored(labels), n_folds=FOLDS)
    run.release()
    scored = {}
    for i, s in enumerate(seeds):
        w = run.fit.weights[i, FOLDS]
        eta = sum((F.col(f).cast("double") * float(w[j + 1]) for j, f in enumerate(features)), F.lit(float(w[0])))
        scored[f"sep_{s}"] = F.when(train[i], -sigmoid(-F.abs(eta))).otherwise(-0.5)
    per_pair = rows.select(F.col("pair_id").alias("example_id"), *[c.alias(n) for n, c in scored.items()]).groupBy(
        "example_id").agg(*[F.avg(n).alias(n) for n in scored])
    return cands.join(per_pair, "example_id", "left").na.fill(-0.5, list(scored))


def raise_to_minimum(prepared: DataFrame, trials: list[Trial], minimum: int = FOLDS) -> dict[tuple[str, int], int]:
    """Smallest prefix of an order that has ``minimum`` pairs on both sides, per (order, seed)."""
    orders, seeds = sorted({t.order for t in trials}), sorted({t.seed for t in trials})
    pairs = prepared.filter("label = 1").select("pair_id", "ranks", "hold_seeds")
    long = (pairs.withColumn("order", F.explode(F.array(*[F.lit(o) for o in orders])))
            .withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
            .select("order", "seed", F.coalesce(F.expr("array_contains(hold_seeds, seed)"), F.lit(False)).alias("held"),
                    F.expr("try_element_at(ranks, `order`)").alias("rank")))
    firsts = top_k(long.filter("rank is not null"), minimum, [F.col("rank")], by=["order", "seed", "held"], name="pos")
    need = firsts.groupBy("order", "seed").agg(F.max("rank").alias("k"), F.count(F.lit(1)).alias("n"))
    # one row per (order, seed)
    return {(r["order"], r["seed"]): int(r["k"]) for r in need.collect() if r["n"] == 2 * minimum}


def leads(trials: list[Trial]) -> list[audit.Lead]:
    """Every 16th size of an order from zeros, then those between from their neighbours, as neighbours' optima are near.

    Orders of few sizes start from the weights of the same split's order with the most sizes. Where a fit starts does not
    change what it ends at, only how many passes it takes.
    """
    lines: dict[tuple[int, str], dict[str, list[int]]] = {}
    for i, t in enumerate(trials):
        lines.setdefault((t.seed, t.side), {}).setdefault(t.order, []).append(i)
    stages: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(STRIDES) + 1)]

    def between(known: list[int], i: int) -> tuple[int, int, int, float]:
        sizes = [trials[j].keep_n for j in known]
        at = int(np.searchsorted(sizes, trials[i].keep_n))
        below, above = known[max(0, at - 1)], known[min(at, len(known) - 1)]
        gap = trials[above].keep_n - trials[below].keep_n
        return i, below, above, (trials[i].keep_n - trials[below].keep_n) / gap if gap else 0.0

    for orders in lines.values():
        ranked = {o: sorted(of, key=lambda i: (trials[i].keep_n, i)) for o, of in orders.items()}
        main = min(ranked, key=lambda o: (-len(ranked[o]), o))
        for order, line in ranked.items():
            if order != main and len(line) < STRIDES[0]:
                stages[-1] += [between(ranked[main], i) for i in line]
                continue
            known: list[int] = []
            for stage, stride in zip(stages, STRIDES):
                new = [i for at, i in enumerate(line) if (at % stride == 0 or at == len(line) - 1) and i not in known]
                stage += [between(known, i) if known else (i, -1, -1, 0.0) for i in new]
                known = sorted([*known, *new], key=lambda i: (trials[i].keep_n, i))
    return [audit.Lead(*(np.array(c) for c in zip(*stage))) for stage in stages if stage]


def evaluate(prepared: DataFrame, plan: list[tuple[str, int, int]], features=PAIR_FEATURES,
             chunk: int = CHUNK, raise_small: bool = False) -> DataFrame:
    """(method, mode, target_kept, keep_n, seed, search_auc, heldout_auc, optimism_gap, train/hold pairs)."""
    base = [Trial(o, k, s, side) for o, k, s in plan for side in ("train", "hold")]
    floor = raise_to_minimum(prepared, base) if raise_small else {}
    sized = [(o, max(k, floor.get((o, s), k)), s, k) for o, k, s in plan]
    trials = [Trial(o, k, s, side) for o, k, s, _ in sized for side in ("train", "hold")]
    rows = audit.trial_metrics(prepared, features, prefix_labels(trials), FOLDS, chunk=chunk, min_rows=2 * FOLDS, leads=leads(trials))
    out = []
    for i, (order, k, seed, target) in enumerate(sized):
        tr, ho = rows[2 * i], rows[2 * i + 1]
        gap = tr["auc"] - ho["auc"] if tr["auc"] is not None and ho["auc"] is not None else None
        method, mode = order.split("/", 1)
        out.append((method, mode, target, k, seed, tr["auc"], ho["auc"], gap, tr["n_rows"] // 2, ho["n_rows"] // 2))
    return prepared.sparkSession.createDataFrame(
        out, "method string, mode string, target_kept int, keep_n int, seed int, search_time_auc double, "
             "heldout_auc double, optimism_gap double, train_pairs int, hold_pairs int")


def enrich(results: DataFrame, prepared: DataFrame, cands: DataFrame, min_keep: int,
           w_heldout: float = 1.0, w_size: float = 1.0, w_imbalance: float = 1.0) -> DataFrame:
    """Retained profile, imbalance penalty and objective per searched prefix."""
    sizes = results.select(F.concat_ws("/", "method", "mode").alias("order"), "keep_n").distinct()
    # a pair gets its profile before it is repeated per order and size; the sizes are those of the plan, some hundred
    pairs = prepared.filter("label = 1").select(F.col("pair_id").alias("example_id"), "ranks").join(cands, "example_id")
    ranks = pairs.select(*[c for c in cands.columns if c != "example_id"], F.explode("ranks").alias("order", "rank"))
    kept = ranks.join(F.broadcast(sizes), "order").filter("rank <= keep_n")
    profile = imbalance_penalty(kept, cands, ["order", "keep_n"])
    joined = results.withColumn("order", F.concat_ws("/", "method", "mode")).join(profile, ["order", "keep_n"])
    return joined.withColumn("objective_score", search_objective(
        F.col("heldout_auc"), F.col("keep_n"), F.col("n_full"), F.col("imbalance_penalty"), min_keep,
        w_heldout, w_size, w_imbalance)).drop("order")


def best_by_method(enriched: DataFrame) -> DataFrame:
    """Lowest objective per (seed, method); ties by larger size, then mode."""
    return best_row(enriched, ["seed", "method"], ["objective_score", ("keep_n", True), "mode"])


def search(cands: DataFrame, answers: DataFrame, seeds: list[int], min_keep: int, max_drop: float = 0.5,
           steps: int = 80, starts: int = 5, features=PAIR_FEATURES, chunk: int = CHUNK) -> DataFrame:
    """Multi-seed search over all five methods; one enriched row per tried prefix."""
    with_sep = separability_keys(answers, cands, seeds, features)
    orders = order_definitions({s: starts for s in seeds})
    orders |= {f"score_greedy/{s}": _keys(f"sep_{s}") for s in seeds}
    prepared = prepare(with_sep, answers, seeds, orders)
    n = cands.count()
    grid = prefix_sizes(n, min_keep, max_drop, FOLDS, steps)
    few = sorted({n, max(min_keep, int(0.9 * n)), max(min_keep, int(0.8 * n)), min_keep}, reverse=True)
    plan = []
    for order in orders:
        method, mode = order.split("/", 1)
        own = [int(mode.split(".")[0])] if method in ("multi_start", "score_greedy") else seeds
        plan += [(order, k, s) for s in own for k in (grid if method == "prefix_grid" else few)]
    return enrich(evaluate(prepared, plan, features, chunk), prepared, cands, min_keep)


def fixed_kept(cands: DataFrame, answers: DataFrame, seeds: list[int], targets: list[int],
               features=PAIR_FEATURES) -> DataFrame:
    """Both fixed-size methods at every target, sizes raised until both sides can be audited."""
    with_sep = separability_keys(answers, cands, seeds, features)
    orders = {"feature_balanced/all_features": _keys("negation_flag", "length_gap")}
    orders |= {f"score_greedy/{s}": _keys(f"sep_{s}") for s in seeds}
    prepared = prepare(with_sep, answers, seeds, orders)
    n = cands.count()
    plan = [(o, min(max(t, FOLDS + 1), n), s) for s in seeds for t in targets
            for o in ("feature_balanced/all_features", f"score_greedy/{s}")]
    results = evaluate(prepared, plan, features, raise_small=True)
    return enrich(results, prepared, cands, 0).drop("objective_score")


def fixed_kept_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("target_kept", "method").agg(
        F.avg("keep_n").alias("mean_actual_kept"), F.avg("heldout_auc").alias("mean_heldout_auc"),
        F.stddev_samp("heldout_auc").alias("std_heldout_auc"), F.avg("search_time_auc").alias("mean_search_time_auc"),
        F.avg("optimism_gap").alias("mean_optimism_gap"), F.avg("confounded_fraction").alias("mean_confounded_fraction"),
        F.avg("negation_rate").alias("mean_negation_rate"), F.avg("train_pairs").alias("mean_train_pairs"),
        F.avg("hold_pairs").alias("mean_hold_pairs"), F.count("seed").alias("num_seeds"))


def method_stability(best: DataFrame) -> DataFrame:
    """Means and sample stds per method, and how often it has the lowest held-out AUC of a seed."""
    winners = (best.filter(F.col("heldout_auc").isNotNull()).groupBy("seed")
               .agg(F.min_by("method", F.struct("heldout_auc", "method")).alias("method"))
               .groupBy("method").agg(F.count(F.lit(1)).alias("num_seeds_where_best")))
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    stats = best.groupBy("method").agg(
        F.avg("heldout_auc").alias("mean_heldout_auc"), std("heldout_auc").alias("std_heldout_auc"),
        F.avg("keep_n").alias("mean_kept_count"), std("keep_n").alias("std_kept_count"),
        F.avg("search_time_auc").alias("mean_search_time_auc"), F.avg("optimism_gap").alias("mean_optimism_gap"),
        F.count(F.lit(1)).alias("num_seeds"))
    return stats.join(winners, "method", "left").na.fill(0, ["num_seeds_where_best"])


def prefix_scan(prepared: DataFrame, order: str, sizes: list[int], features=PAIR_FEATURES) -> DataFrame:
    """(keep_n, auc, accuracy) of many prefixes of one order; every threshold reads this table."""
    trials = [Trial(order, k, -1, "all") for k in sizes]
    rows = audit.trial_metrics(prepared, features, prefix_labels(trials), FOLDS, min_rows=2 * FOLDS)
    return prepared.sparkSession.createDataFrame(
        [(k, r["auc"], r["accuracy"]) for k, r in zip(sizes, rows)], "keep_n int, auc double, accuracy double")


def near_random_grid(scan: DataFrame) -> DataFrame:
    """Distance to chance per scanned prefix."""
    return scan.withColumn("distance_to_chance", F.abs(F.col("auc") - 0.5))


def near_random_orders() -> dict[str, list[Column]]:
    """Clean pairs first, low score first, short gap first, few negations first."""
    return {"clean_first/all": _keys("confounded_flag", priority("all_features")),
            "low_score/all": _keys(priority("all_features")),
            "length_gap/all": _keys("length_gap"),
            "negation/all": _keys(priority("negation_only"))}


def dominance(row_size: Column, row_metric: Column, base_size: Column, base_metric: Column, tau: Column) -> Column:
    """True when a subset is larger than a feasible baseline and itself within the threshold."""
    eps = 1e-9
    return (base_size.isNotNull() & (row_size > base_size) & (row_metric <= tau + eps)
            & (base_metric <= tau + eps))
