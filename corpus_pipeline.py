"""The corpus pipeline: quality rules, near-dedup, secret masking, mixing, tokens.

Each stage reads what the one before it wrote.  All but the last give the columns
of ``documents``; further columns of the input do not go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm import bpe, mixture, order_minhash, quality, secret_scan
from threadloom.llm.common import Scratch, table
from threadloom.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The rank file, as named in the installed package of public vocabularies.
RANK_FILE = "byte_bpe_50k.tiktoken"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    measured = Scratch(spark, "quality").write(quality.measure(docs.select(*COLUMNS)), "measured")
    return quality.judge(measured).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id, as it is."""
    return order_minhash.one_of_each(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced and ``n_chars`` set to the new length."""
    docs = docs.select(*COLUMNS)
    return secret_scan.masked(secret_scan.scan(docs, secret_scan.fitted(docs))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: per pass over a source, a document with the stretches that the drawn blocks take of it.

    A document that is taken more than once has a row for each pass; one that no
    block takes has none.  ``n_chars`` is the length of the text that is left.
    """
    mixed = mixture.Mix(docs.select(*COLUMNS), "text", "lang").documents()
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids``: the token ids of every document of the mix."""
    import public_tokenizers

    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode_docs(rows, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Hashes, draws and a trained model decide rows here, which SQL cannot repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    # Arrow batches are bounded by rows and bytes there.
    docs = table(configure(spark), sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(f"stage{k - 1}")
    return docs
