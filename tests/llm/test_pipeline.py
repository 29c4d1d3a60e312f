import public_tokenizers as P
import pytest

import corpus_pipeline as cp
from llm_helpers import SF
from test_order_minhash import brute
from threadloom.llm import bpe, secret_scan


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_each_stage_works_on_the_last(spark, stages):
    whole = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, apart, masked, mixed, tokens = (s.collect() for s in stages)
    assert all(tuple(s.columns) == cp.COLUMNS for s in stages[:4])
    assert 0 < len(good) < len(whole) and all(whole[r.doc_id].text == r.text for r in good)
    classes = brute([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in apart) == sorted(set(classes.values()))
    assert len(masked) == len(apart)
    for r in masked:
        before = whole[r.doc_id].text
        assert r.n_chars == len(r.text) and (r.text == before or secret_scan.MASK in r.text)
    words = sum(len(r.text.split()) for r in masked)
    assert abs(sum(len(r.text.split()) for r in mixed) - words) <= 0.02 * words
    ids = sorted(bpe.decode(r.ids, P.path(cp.RANK_FILE), P.PATTERN).decode() for r in tokens)
    assert ids == sorted(r.text for r in mixed)


def test_run_is_the_stages(spark, stages):
    again = cp.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in again.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in stages[-1].collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, odd_docs, no_docs, k):
    stage = cp.STAGES[k][1]
    assert stage(spark, odd_docs, SF).count() > 0
    assert stage(spark, no_docs, SF).count() == 0
