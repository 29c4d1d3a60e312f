import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from llm_helpers import SF, prose, read
from threadloom.llm import bpe
from threadloom.llm.queries import QUERIES, RANK_FILE

FILE = P.path(RANK_FILE)


@pytest.fixture(scope="module")
def plain():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, plain):
    texts = dict(read(f"select doc_id, text from '{SF}/documents.parquet'"))
    want = {}
    for d, t in texts.items():
        ids = plain.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op10_byte_bpe"](spark, SF).collect()} == want


PARTS = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2028", "\x1c", "\x85", "a", "word", "it's", "'s", "'", "12", "!?", "é", "日本", "\U0001f600", "<|endoftext|>"])


@settings(deadline=None, max_examples=300)
@given(st.lists(PARTS, max_size=30), st.integers(0, 7))
def test_cuts_do_not_change_ids(plain, parts, size):
    text = "".join(parts)
    assert "".join(bpe.pieces(text, size)) == text
    assert bpe.encode(text, FILE, P.PATTERN, size) == plain.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text, FILE, P.PATTERN, size), FILE, P.PATTERN) == text.encode()


def test_long_texts(plain):
    text = prose(1, 60_000)
    assert len(list(bpe.pieces(text))) > 2 and bpe.encode(text, FILE, P.PATTERN) == plain.encode_ordinary(text)
    assert bpe.decode(bpe.encode("x" * 300_000, FILE, P.PATTERN), FILE, P.PATTERN) == b"x" * 300_000


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    encoded = bpe.encode_docs(odd_docs, FILE, P.PATTERN)
    rows = bpe.decode_docs(encoded, FILE, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((x[1] or "").encode() for x in odd_rows)
    assert {c for c in odd_docs.columns if c != "text"} <= set(encoded.columns) and all(r.n_tokens == 0 for r in rows if r.doc_id == 1)
    assert bpe.token_digests(no_docs, FILE, P.PATTERN).count() == 0 and bpe.encode_docs(no_docs, FILE, P.PATTERN).count() == 0
