import random
import re

import pytest

from llm_helpers import SF, read
from threadloom.llm import secret_scan as ss
from threadloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def forest(spark):
    return ss.fitted(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_accuracy(spark, forest):
    rows = ss.labelled_findings(spark, ["it is what it is, said the one with the other"], 1500, seed=999).collect()
    said = forest.score([r.features for r in rows]) >= ss.THRESHOLD
    right = sum(bool(r.label) == bool(s) for r, s in zip(rows, said))
    assert right / len(rows) > 0.95


def test_query_finds_what_is_planted(spark):
    larger = SF.replace("0.001", "0.01")
    docs = dict(read(f"select doc_id, text from '{larger}/documents.parquet'"))
    got = QUERIES["op4_forest_filter"](spark, larger).collect()
    secrets = {(r.doc_id, r.start) for r in got if r.is_secret}
    planted = {(d, m.start(1)) for d, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")}
    assert planted and secrets == planted
    numbers = [r for r in got if re.fullmatch("[0-9]+", docs[r.doc_id][r.start : r.start + r.length])]
    assert numbers and not any(r.is_secret for r in numbers)


def test_forest_is_the_trained_one(spark):
    """The arrays vote as the library's own model does."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = ss.labelled_findings(spark, ["a b c"], 400).cache()
    forest = ss.train(rows, trees=5, depth=4)
    own = rows.select("label", "features", array_to_vector("features").alias("v"))
    model = RandomForestClassifier(featuresCol="v", numTrees=5, maxDepth=4, seed=ss.SEED, featureSubsetStrategy="sqrt").fit(own)
    said = model.transform(own).select("features", vector_to_array("probability")[1].alias("p")).collect()
    assert forest.score([r.features for r in said]).tolist() == pytest.approx([r.p for r in said], abs=1e-9)


def test_candidates():
    text = 'x password=hunter2hunter2, y "04dbebab91ab85687d33eeaaf9ac699e1188f962" averyverylongplainword 9807915762804490!!'
    assert [text[a:b] for a, b in ss.candidates(text)] == ["hunter2hunter2", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "9807915762804490"]
    assert ss.candidates("") == [] and ss.candidates("a" * 100_000) == []


def test_features_have_one_length():
    r = random.Random(1)
    rows = [ss.features(v, b, a, p) for b, v, a in (ss.known_value(r, bool(i % 2)) for i in range(300)) for p in ("", "tests/x.py")]
    assert len({len(x) for x in rows}) == 1 and ss.covered("passwordtoken") == 1.0 and ss.covered("zzqq") == 0.0


def test_mask_and_odd_rows(spark, forest, odd_docs, odd_rows, no_docs):
    out = ss.masked(ss.scan(odd_docs, forest))
    assert out.columns == [c for c in odd_docs.columns if c != "findings"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[10].text == f'a token = "{ss.MASK}" b 9807915762804490 c' and got[10].n_chars == len(got[10].text)
    same = [(r.doc_id, r.text, r.n_chars) for r in out.collect() if r.doc_id != 10]
    assert sorted(map(str, same)) == sorted(str((r[0], r[1], r[4])) for r in odd_rows if r[0] != 10)
    assert ss.scan(no_docs, forest).count() == 0
    assert ss.fitted(no_docs).roots
