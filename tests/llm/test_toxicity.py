"""Toxicity: the automaton against plain distances, held-out accuracy, context, edges."""

import random
import zlib

import pytest

from threadloom.llm import toxicity
from threadloom.llm.queries import QUERIES
from llm_helpers import read

SF01 = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


@pytest.mark.parametrize("kept", [toxicity.STATES_KEPT, 3])
def test_automaton_is_exact(monkeypatch, kept):
    monkeypatch.setattr(toxicity, "STATES_KEPT", kept)
    r = random.Random(2)
    terms = sorted({"".join(r.choices("abcd", k=r.randint(3, 11))) for _ in range(60)})
    automaton = toxicity.Automaton(terms)
    for _ in range(800):
        word = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word) + 1)
            word[at : at + r.randint(0, 1)] = r.choice(["", "a", "e", "d"])
        word = "".join(word)
        want = {(i, d) for i, t in enumerate(terms) if (d := distance(word, t)) <= toxicity.edits_allowed(t)}
        assert set(automaton.near(word)) == want


def lexicon():
    return toxicity.Lexicon(["idiot", "worthless"], [(40, 0), (40, 0)], (100, 1000))


def test_misspelled_and_quoted():
    known = lexicon()
    assert [(h.term, h.edits) for h in toxicity.hits("You IDI0T, you are w0rthles!", known)] == [("idiot", 1), ("worthless", 2)]
    assert toxicity.hits("an idyllic place", known) == []
    (plain,) = toxicity.hits("they are an idiot of sorts", known)
    (quoted,) = toxicity.hits('the report said "an idiot" twice', known)
    (aimed,) = toxicity.hits("you are an idiot", known)
    assert quoted.quoted and not plain.quoted and quoted.evidence < plain.evidence < aimed.evidence
    text = "x " * 50 + "idiot " + "y " * 50
    (hit,) = toxicity.hits(text, known)
    assert text[hit.start : hit.end] == "idiot"


def test_own_label_is_left_out():
    known = toxicity.Lexicon(["slug"], [(3, 0)], (10, 100))
    assert known.weigh("slug", 1)[2] < known.weigh("slug")[2] < known.weigh("slug", 0)[2] + 0.1


def test_held_out(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op11_levenshtein_trie"](spark, SF01).collect()}
    labels = dict(read(f"SELECT doc_id, toxic FROM '{SF01}/labels.parquet'"))
    assert len(rows) == read(f"SELECT count(*) FROM '{SF01}/documents.parquet'")[0][0]
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if i in rows and rows[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(p and y for p, y in held) / sum(y for _, y in held) > 0.6


def planted():
    r = random.Random(4)
    bad, plain = ["grumbleton", "snorkwit"], ["".join(r.choices("abcdefgh", k=5)) for _ in range(200)]
    for i in range(400):
        words = r.choices(plain, k=40)
        if i % 4 == 0:
            words[r.randrange(40)] = bad[i % 8 == 0]
        yield i, " ".join(words), int(i % 4 == 0)


def test_learned_terms_and_their_misspellings(spark):
    rows = list(planted())
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert set(model.lexicon.terms) == {"grumbleton", "snorkwit"}
    new = [(1, "abcde grumbletom hgfed"), (2, "abcde hgfed"), (3, "you snorkw1t"), (None, None), (5, ""), (5, "abc " * 100_000 + "snorkwit")]
    extra = spark.createDataFrame([(i, t, 0.5, "h", 1) for i, t in new], "doc_id long, text string, score double, hits string, toxic int")
    got = [(r["doc_id"], r["score"] >= 0.5, len(r["hits"])) for r in toxicity.score(extra, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, True, 1), (2, False, 0), (3, True, 1), (None, False, 0), (5, False, 0), (5, True, 1)], key=repr)
    same = toxicity.fitted(docs.orderBy("text"), labels.orderBy("toxic"))
    assert same.lexicon.terms == model.lexicon.terms and abs(same.coefficients - model.coefficients).max() < 1e-6
    assert toxicity.score(extra.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None), (None, 1)], [(1, 0), (1, 1), (2, 0)]):
        model = toxicity.fitted(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 < r["score"] < 1 for r in toxicity.score(docs, model).collect())
