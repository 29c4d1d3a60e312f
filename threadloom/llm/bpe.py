"""Byte-level BPE with the tiktoken library and a local rank file.

Texts are encoded in Python workers over Arrow batches, without a shuffle.  A
long text is first cut where a match of the pattern ends in any case, so that
one call holds a bounded piece and the ids stay the same.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A piece of a long text has about so many characters.
PIECE_CHARS = 100_000
#: Texts of about so many bytes are encoded before their rows go on.
SLICE_BYTES = 1 << 20
ENCODED = "n_tokens bigint, ids array<int>"
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

# A run of white space always starts a match, or belongs to one that starts there: a match that begins in
# visible characters never holds white space.  So a cut between a visible character and a blank or line end is
# safe; "visible" leaves out everything that any definition of white space includes.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tokenizer of a rank file (base64 token and rank per line), once per worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _decimals(rank_file: str, pattern: str) -> list[str]:
    """Every id as text: looking it up costs half of formatting it."""
    return [str(i) for i in range(encoding(rank_file, pattern).n_vocab)]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe places only; one without such places stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + max(size, 1))
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, rank_file: str, pattern: str, size: int = PIECE_CHARS) -> list[int]:
    """Ids of a whole text, with no special tokens."""
    own = encoding(rank_file, pattern)
    if len(text) <= size:
        return own.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, size):
        ids += own.encode_ordinary(piece)
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes of ids, also where they end inside a character."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def _encoded(text: str, rank_file: str, pattern: str) -> Iterator[np.ndarray]:
    """Ids of a whole text as arrays of four bytes an id, piece by piece."""
    own = encoding(rank_file, pattern)
    for piece in pieces(text):
        yield own.encode_to_numpy(piece, disallowed_special=()).astype(np.int32)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``SLICE_BYTES`` of text; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // SLICE_BYTES
    ends = [*np.flatnonzero(np.diff(run)) + 1, batch.num_rows]
    for start, end in zip([0, *ends], ends):
        yield batch.slice(start, end - start)


def _mapped(docs: DataFrame, text: str, added: str, arrays_of) -> DataFrame:
    """``docs`` without ``text`` and with the columns ``added``, which ``arrays_of`` gives for a list of texts."""
    names = [f.split()[0] for f in added.split(", ")]
    kept = [c for c in docs.columns if c not in (text, *names)]
    schema = docs.select(*kept).schema
    out = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text) if batch.num_rows else ():
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *arrays_of(texts)], [*kept, *names])

    return docs.select(*kept, text).mapInArrow(run, ", ".join(out))


def encode_docs(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` in place of the text.

    A null text is empty and has no ids.  Columns named like a result are
    replaced, other columns stay.  A very long text is encoded in pieces, one
    without a safe place to cut as a whole.  An empty table stays empty.
    ``rank_file`` must be readable on every worker.
    """

    def arrays_of(texts: list[str]) -> list[pa.Array]:
        ids = [np.concatenate([*_encoded(t, rank_file, pattern)]) for t in texts]
        sizes = np.array([len(i) for i in ids], np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return [pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))]

    return _mapped(docs, text, ENCODED, arrays_of)


def token_digests(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (of the ids, joined by blanks) and ``decoded_sha256`` (of the bytes that they decode to).

    Rows and columns are treated as by :func:`encode_docs`; a long text is digested piece by piece.
    """

    def row_of(t: str) -> tuple[int, str, str]:
        n, joined, decoded = 0, hashlib.sha256(), hashlib.sha256()
        decimals = _decimals(rank_file, pattern)
        for piece in _encoded(t, rank_file, pattern):
            ids = piece.tolist()
            joined.update(((" " if n and ids else "") + " ".join(map(decimals.__getitem__, ids))).encode())
            decoded.update(decode(ids, rank_file, pattern))
            n += len(ids)
        return n, joined.hexdigest(), decoded.hexdigest()

    def arrays_of(texts: list[str]) -> list[pa.Array]:
        return [pa.array(list(v), kind) for v, kind in zip(zip(*map(row_of, texts)), (pa.int64(), pa.string(), pa.string()))]

    return _mapped(docs, text, DIGESTS, arrays_of)


def decode_docs(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``ids`` -> ``decoded`` bytes; other columns stay."""
    kept = [c for c in encoded.columns if c not in ("ids", "decoded")]
    out = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema), "decoded binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            values = pa.array([decode(x or [], rank_file, pattern) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), values], [*kept, "decoded"])

    return encoded.select(*kept, "ids").mapInArrow(run, ", ".join(out))
