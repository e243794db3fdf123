"""op8_jaccard_join: many sets at a time against one at a time, copies listed once, components joined."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from veneer.llm import op8_jaccard, shingles

TEXTS = [None, "", "  ", "a", "A b c", "a b c d e", "a\tb\nc d e f  ", "ÄÖ ß 一 x\vy z"]


def _texts():
    pick = random.Random(5)
    return TEXTS + [" ".join(f"W{pick.randrange(400)}" for _ in range(pick.randrange(700))) + pick.choice(["", " "]) for _ in range(80)] + ["", "z"]


@pytest.mark.parametrize("most", [1, 3000, 1 << 18])
@pytest.mark.parametrize("part", [slice(None), slice(3, 50), slice(0, 0), slice(0, 3)])
def test_sets_end_to_end(most, part):
    texts = pa.array(_texts(), pa.string())
    texts = texts.slice(part.start or 0, len(_texts()[part]))
    got = []
    for first, sets, at in shingles.shingle_sets(texts, 5, most):
        assert first == len(got)
        got += [sets[a:b] for a, b in zip(at[:-1], at[1:])]
    want = [shingles.shingle_set((t or "").encode()) for t in texts.to_pylist()]
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want))


@pytest.mark.parametrize("light", [0, 4, 9])
def test_keys_end_to_end(light):
    for first, sets, at in shingles.shingle_sets(pa.array([t for t in _texts() if t is None or len(t) < 60 or len(t) > 900], pa.string()), 5, 20_000):
        own = [sets[a:b] for a, b in zip(at[:-1], at[1:])]
        which, keys = op8_jaccard.list_keys_of(sets, at, light)
        assert (np.diff(which) >= 0).all()
        assert op8_jaccard._empty_parts_of(sets, at).tolist() == [op8_jaccard.empty_parts(s) for s in own]
        for i, s in enumerate(own):
            assert sorted(keys[which == i].tolist()) == (sorted(op8_jaccard.list_keys(s, light).tolist()) if len(s) else [])


@pytest.mark.parametrize("few", [200_000, 0])
def test_copies_are_listed_once(spark, monkeypatch, few):
    monkeypatch.setattr(op8_jaccard, "FEW_IDS", few)
    docs = spark.createDataFrame([(i, f"text of {i // 4}") for i in range(40)], "rid long, text string").repartition(5)
    same = spark.createDataFrame([(i, i - i % 4) for i in range(20)], "rid long, leader long")
    kept = op8_jaccard._first_of_classes(docs, same)
    assert sorted(r["rid"] for r in kept.collect()) == [0, 4, 8, 12, 16, *range(20, 40)]


def test_links_join_components(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)], "rid long, component long")
    links = spark.createDataFrame([(4, 2), (6, 5), (2, 1)], "rid long, leader long")
    joined, into = op8_jaccard._joined(found, links)
    assert {tuple(r) for r in joined.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)}
    assert {tuple(r) for r in into.collect()} == {(3, 1), (6, 5)}


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(1, 60)], "rid long, leader long")
    assert {r["component"] for r in op8_jaccard.components(links).collect()} == {1}


def _family(pick):
    """Near copies of a text in a chain of small changes, copies of each, and other texts."""
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(40):
        words = list(words)
        words[pick.randrange(60)] = f"x{i}"
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words))]
    return rows + [(1000 + i, " ".join(f"v{pick.randrange(300)}" for _ in range(40))) for i in range(40)]


def test_family(spark, monkeypatch):
    rows = _family(random.Random(3))
    monkeypatch.setattr(op8_jaccard, "FEW_IDS", 20)
    got = sorted(tuple(r) for r in op8_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert got == sorted(brute.components(rows))
