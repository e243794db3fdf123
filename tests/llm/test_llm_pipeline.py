"""The pipeline against plain Python versions of its stages, each on what the one before kept."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.conftest import SF
from tests.llm import brute
from veneer.llm import op7_bpe, op10_lines


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [{r["doc_id"]: r for r in d.collect()} for d in out]


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for a, b in zip(steps[:4], steps[1:5]):
        assert set(b) <= set(a) and next(iter(b.values())).__fields__ == next(iter(steps[0].values())).__fields__


def test_line_stage(steps):
    before, after = sorted((i, r["text"]) for i, r in steps[1].items()), steps[2]
    for (i, text), kept in zip(before, brute.kept_lines(before, op10_lines.MIN_WORDS)):
        if kept.split() or kept == text:
            assert after[i]["text"] == kept and after[i]["n_chars"] == len(kept)
        else:
            assert i not in after


def test_jaccard_stage(steps):
    found = brute.components([(i, r["text"]) for i, r in sorted(steps[2].items())])
    assert set(steps[3]) == {i for i, _, c in found if i == c}


def test_decontamination_stage(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pieces = {" ".join(w) for _, t in items for w in _windows(t)}
    clean = {i for i, r in steps[3].items() if not any(" ".join(w) in pieces for w in _windows(r["text"]))}
    assert set(steps[4]) == clean


def _windows(text):
    from veneer.llm.op3_decontaminate import windows
    return [[x.decode() for x in w] for w in windows(text.encode(), 10)]


def test_token_stage(steps):
    ranks = op7_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(steps[5]) == set(steps[4])
    for i, r in steps[5].items():
        assert list(r["token_ids"]) == library.encode_ordinary(steps[4][i]["text"])
