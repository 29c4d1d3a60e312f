import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from llm_helpers import SF, read
from threadloom.llm import quality
from threadloom.llm.common import words


@settings(deadline=None, max_examples=10, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=40), min_size=20, max_size=30))
def test_repeated_windows(one, texts):
    def brute(ws):
        wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        return len({i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)})

    got = one([" ".join(t) for t in texts], quality.repeated_window_words(words(F.col("v"))))
    assert got == [brute(t) for t in texts]


def test_distance(spark):
    def brute(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, q)) / 2)

    pairs = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 5]), ([4, 4], [1, 1]), ([0, 7, 1], [2, 0, 9])]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(pairs)], "p array<long>, q array<long>, i int").orderBy("i")
    got = [r[0] for r in df.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([brute(*x) for x in pairs], abs=1e-7)
    empty = spark.createDataFrame([([0, 0], [1, 2]), (None, [1])], "p array<long>, q array<long>")
    assert [r[0] for r in empty.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()] == [None, None]


def test_labelled_quality(spark):
    """Good documents stay; most of the others go."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    kept = {r.doc_id: r for r in quality.judge(quality.measure(docs).cache()).collect()}
    labels = read(f"select doc_id, quality from '{SF.replace('0.001', '0.01')}/labels.parquet'")
    good = [kept[d] for d, q in labels if q == 1 and not kept[d].base_failed]
    bad = [kept[d] for d, q in labels if q == 0]
    assert sum(not r.kept for r in good) <= 0.005 * len(good) and sum(r.kept for r in bad) <= 0.15 * len(bad)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    measured = quality.measure(odd_docs.withColumn("n_words", F.lit("clash")))
    got = quality.judge(measured).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].base_failed and by_id[2].n_words == 0 and by_id[3].word_chars == 0 and by_id[6].n_words == 1
    assert by_id[4].n_words == 20_000 and by_id[11].n_words == 4 and by_id[8].n_symbols == 3
    assert quality.judge(quality.measure(no_docs)).count() == 0
