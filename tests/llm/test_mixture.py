import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import SF, read
from threadloom.llm import mixture
from threadloom.llm.queries import QUERIES


def targets(sizes):
    """Shares by weight, stopped at three times the source, the rest shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in stopped]
        rest, w = total - sum(stopped.values()), sum(weight[s] for s in free)
        out = {s: rest * weight[s] / w for s in free}
        over = [s for s in free if out[s] > 3 * sizes[s]]
        if not over:
            return {**stopped, **out}
        stopped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1}, {"x": 0, "y": 100, "z": 3}, {"é": 9, "z": 900, "Z": 1, "": 40, None: 2}, {"a": 0},
])
def test_targets(spark, sizes):
    plan = mixture.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in plan} == pytest.approx(targets(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_permutation(n):
    seen = [mixture.permuted(np.arange(n), n, key) for key in (1, 2)]
    assert all(sorted(s) == list(range(n)) for s in seen) and (n < 20 or list(seen[0]) != list(seen[1]))


def test_query(spark):
    rows = QUERIES["op3_block_mixture"](spark, SF).collect()
    again = QUERIES["op3_block_mixture"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = dict(read(f"select doc_id, source from '{SF}/documents.parquet'"))
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    assert target == pytest.approx(targets(sizes)) and len(rows) == len(source)
    assert all(abs(taken[s] - target[s]) <= 6 * mixture.BLOCK_WORDS for s in sizes)


def test_counts_and_texts_against_words(spark):
    """What the texts of the mix hold is what was counted, word by word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixture.Mix(docs, "text", "lang", block_words=16)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    texts, got = {r.doc_id: r.text for r in docs.collect()}, {}
    for r in mix.documents().collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert all(line in texts[r.doc_id] for line in r.text.split("\n"))
    assert got == {d: n for d, n in taken.items() if n}
    slots = mix.slots.collect()
    assert len({(s.source_no, s.slot) for s in slots}) == len(slots) == len({(s.source_no, s.block, s["pass"]) for s in slots})


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    mix = mixture.Mix(odd_docs, "text", "lang")
    rows = mix.taken().collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {r.doc_id: r.size for r in rows}[1] == 0 and mix.documents().filter(F.size(F.split("text", " ")) < 1).count() == 0
    for empty in (no_docs, odd_docs.filter("text is null")):
        none = mixture.Mix(empty, "text", "lang")
        assert none.taken().filter("taken > 0").count() == none.documents().count() == 0
