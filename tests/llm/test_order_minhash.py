import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from llm_helpers import SF, prose, read
from threadloom.llm import order_minhash as om
from threadloom.llm.common import Scratch
from threadloom.llm.queries import QUERIES


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30), st.integers(0, 30))
def test_banded_lcs(a, b, band):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            hit = a[i] == b[j]
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + 1 if hit else 0)
    full = table[-1][-1]
    assert om.banded_lcs(a, b, max(len(a), len(b))) == full
    if band >= len(a) + len(b) - 2 * full:
        assert om.banded_lcs(a, b, band) == full


def test_words_and_labels():
    assert list(om.word_hashes("Ab, cd!")) == list(om.word_hashes("ab CD")) and len(om.word_hashes("é ü-x 1")) == 4
    seq = om.kmers("a b c d e " * 10)
    assert len(set(seq.tolist())) == 5 and len(set(om.labelled(seq).tolist())) == len(seq) == 46
    assert len(om.kmers("")) == 0 and len(om.kmers("one two")) == 1
    text = "Ab-cd  éÉ\U0001f600, x! " * 30
    assert np.array_equal(om.kmers(om.unpacked(om.packed(text))), om.kmers(text)) and om.unpacked(om.packed("")) == ""
    moved = om.sketch(om.kmers(prose(1, 200))) == om.sketch(om.kmers(" ".join(reversed(prose(1, 200).split()))))
    assert not moved.any()


def brute(rows):
    """Class of each id: all pairs that share any k-mer, aligned, then joined up."""
    seqs = {d: om.kmers(t or "") for d, t in rows}
    holders = defaultdict(set)
    for d, s in seqs.items():
        for x in s.tolist():
            holders[x].add(d)
    near = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}
    root = {d: d for d in seqs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in near:
        if om.similarity(seqs[a], seqs[b]) >= om.SIMILARITY:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for d, t in rows:  # texts without words go by themselves
        if not len(seqs[d]):
            root[d] = min(e for e, u in rows if (u or "") == (t or ""))
    return {d: find(d) for d in seqs}


def test_query_against_all_pairs(spark):
    got = {r.doc_id: r.class_id for r in QUERIES["op1_order_minhash"](spark, SF).collect()}
    assert got == brute(read(f"select doc_id, text from '{SF}/documents.parquet'"))


def test_hot_group_and_mixed_buckets(spark, monkeypatch):
    """Many copies with small changes are one class; leaders finish buckets that hold several classes."""
    monkeypatch.setattr(om, "SMALL_BUCKET", 3)
    monkeypatch.setattr(om, "LEADERS", 2)
    r, rows, base = random.Random(3), [], prose(7, 200).split()
    for i in range(120):
        words = list(base)
        for _ in range(i % 3):
            words[r.randrange(200)] = f"w{i}"
        rows.append((i, " ".join(words)))
    shared = prose(8, 30)
    rows += [(200 + i, shared + " " + prose(100 + i, 12)) for i in range(12)]
    got = {x.doc_id: x.class_id for x in om.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len({got[i] for i in range(120)}) == 1


@pytest.mark.parametrize("n", [100, 400])
def test_shared_passages_cost_no_pairs(spark, monkeypatch, n):
    """Texts that share a half without being near meet once each with a leader, and not with each other."""
    aligned, plain = [], om.linked

    def counted(pairs, texts):
        aligned.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(om, "linked", counted)
    half = prose(8, 60)
    rows = [(i, half + " " + prose(1000 + i, 60)) for i in range(n)] + [(n + i, half + " " + prose(1000 + i, 59)) for i in range(5)]
    got = {x.doc_id: x.class_id for x in om.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(n)} | {n + i: i for i in range(5)}
    assert sum(aligned) <= om.BANDS * n


def test_components(spark):
    links = [(bytes([a]), bytes([b])) for a, b in [(1, 2), (2, 3), (3, 4), (9, 4), (20, 21), (22, 21)]]
    from threadloom.llm.common import Scratch

    found = om.components(spark.createDataFrame(links, "a binary, b binary"), Scratch(spark, "test")).collect()
    assert {r.node[0]: r.component[0] for r in found} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 20: 20, 21: 20, 22: 20}


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = om.near_classes(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].class_id == by_id[2].class_id == 1 and by_id[3].class_rows == 1 and by_id[8].class_id != by_id[9].class_id
    assert by_id[4].class_rows == 2 and sorted(r.class_rows for r in got if r.doc_id is None) == [1, 2, 2]
    kept = om.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows) - 3
    assert om.near_classes(no_docs).count() == 0 and om.one_of_each(no_docs).count() == 0


def test_sketch_of_long_text_goes_in_steps(monkeypatch):
    seq = om.kmers(prose(5, 3000))
    whole = om.sketch(seq)
    assert np.array_equal(whole, om.sketch(seq.copy())) and len(whole) == om.BANDS


def test_parity_never_parts_near_texts():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 400, int(rng.integers(1, 300)), np.uint64)
        b = np.delete(a, rng.integers(0, len(a), len(a) // 15)) if rng.random() < 0.5 else rng.permutation(a)
        bits = sum(int(x).bit_count() for x in (om.parity(om.labelled(a)) ^ om.parity(om.labelled(b))).view(np.uint64))
        left = set(om.labelled(a).tolist()) ^ set(om.labelled(b).tolist())
        assert bits <= len(left)
        if om.similarity(a, b) >= om.SIMILARITY:
            assert bits * (1 + om.SIMILARITY) <= (1 - om.SIMILARITY) * (len(a) + len(b)) + 1e-6


def test_many_links_between_two_components_count_once(spark, monkeypatch):
    """Rounds of links went through all links again; now the work follows the components that they join."""
    scratch = Scratch(spark, "test")
    key = lambda i: bytes([i])
    frame = lambda pairs: spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")
    labels = om.components(frame([(1, i) for i in range(2, 20)] + [(30, i) for i in range(31, 50)]), scratch)
    sizes, real = [], om.components

    def counted(links, *rest):
        sizes.append(links.count())
        return real(links, *rest)

    monkeypatch.setattr(om, "components", counted)
    labels = om.merged(labels, frame([(i, j) for i in range(1, 20) for j in range(30, 50)] + [(60, 61), (61, 62), (40, 5)]), scratch)
    labels = om.merged(labels, frame([(62, 70), (2, 3)]), scratch)
    want = {key(i): key(1) for i in (*range(1, 20), *range(30, 50))} | {key(i): key(60) for i in (60, 61, 62, 70)}
    assert {bytes(r.node): bytes(r.component) for r in labels.collect()} == want and labels.count() == len(want)
    assert sizes == [3, 1]


def test_a_pair_is_made_in_its_first_common_bucket(spark):
    """Near copies of one text share many rare k-mers; each near pair must come out of the buckets once, and none be lost."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(30):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own))
    near = {
        tuple(sorted((om.text_key(x, ""), om.text_key(y, ""))))
        for x, y in itertools.combinations({om.text_key(s, ""): s for s in map(om.kmers, texts)}.values(), 2)
        if om.similarity(x, y) >= om.SIMILARITY
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    scratch = Scratch(spark, "first-common")
    rest = om.rare_kmers(om.keyed(docs, [], "packed").dropDuplicates(["text_key"]), scratch)
    leads = rest.select("bucket", *(F.col(c).alias(f"lead_{c}") for c in ("text_key", "earlier")))
    met = rest.join(leads, "bucket").filter("lead_text_key < text_key")
    every, first = ([(bytes(r[0]), bytes(r[1])) for r in rows.select("lead_text_key", "text_key").collect()] for rows in (met, met.filter(om._first_here())))
    assert near and near <= set(every) == set(first)
    assert len(every) > 2 * len(set(every)) and len(first) == len(set(first))
