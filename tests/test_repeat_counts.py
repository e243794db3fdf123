"""Registered repeat counts are the published ones."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from veneer.operators import ordering as od
from veneer.plans import subset_search as ss, surface_audit as sa

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


class Seen(Exception):
    pass


def _called(monkeypatch, spark, module, name, query):
    def stop(*args, **kwargs):
        raise Seen(args, kwargs)
    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Seen) as caught:
        QUERIES[query](spark, SF)
    return caught.value.args


@pytest.mark.parametrize("query, name, counts", [
    ("audit_with_null_and_interval", "audit_with_null", {"n_null": 100, "n_boot": 500}),
    ("claim_audit_summary", "claim_summary", {"n_null": 100, "n_boot": 1000}),
    ("ablation_by_dropping", "ablation", {"n_null": 100}),
    ("anchor_subset_audit", "anchor_audit", {"controls": 10})])
def test_counts(spark, monkeypatch, query, name, counts):
    assert _called(monkeypatch, spark, sa, name, query)[1] == counts


def test_label_runs_seeds_and_steps(spark, monkeypatch):
    assert _called(monkeypatch, spark, sa, "random_label_control", "random_label_control")[0][3] == 101
    args, kwargs = _called(monkeypatch, spark, ss, "search", "multi_seed_subset_search")
    assert args[2] == list(range(42, 52)) and not kwargs
    args, kwargs = _called(monkeypatch, spark, od, "prefix_sizes", "largest_prefix_under_threshold")
    assert len(args) == 3 and not kwargs


def test_shuffles_and_replicates():
    for name, n in (("permutation_calibration_300", 300), ("impact_report_300", 300), ("bootstrap_auc_500", 500), ("bootstrap_interval_1000", 1000)):
        assert name in QUERIES and f"range({n})" in ORACLES[name]
