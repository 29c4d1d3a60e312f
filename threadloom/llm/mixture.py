"""Mixing sources to target weights, block by block.

The words of a source are one long row of blocks of fixed length.  Every output
shard draws how many of its slots each source gets; a source numbers its slots
through all shards, and a pseudorandom permutation of its block indexes (a new one
for each pass over the source) says which block a slot holds.  Blocks and slots
meet by index.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.common import WORD, Scratch, words

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 64
SLOTS_PER_SHARD = 65_536
SEED = 17
#: Buckets that the words of one source are summed in before positions are given.
BUCKETS = 1024
#: Slots that are expanded by one row at most, so that a source with most slots is not one task's work.
RUN_SLOTS = 50_000
#: Sources are a dimension: their list is kept on the driver and must not exceed this.
MAX_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """``(source, source_size)`` -> with ``source_no``, ``weight`` and ``target``: shares of all sizes by weight.

    Sources by code point, null last, take the weights in turn.  A target stops at
    ``most`` times its source, and what is above is shared again by weight.  With the
    sources in order of ``size / weight``, the stopped ones are the first ones, so
    sums over what comes before decide each.  One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "source_no")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    listed = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    listed = listed.withColumn("limit", F.col("source_size") * most).withColumn("ratio", F.col("limit") / F.col("weight"))

    def level(limits: Column, weights_gone: Column) -> Column:
        return (F.sum("source_size").over(every) - limits) / F.nullif(F.sum("weight").over(every) - weights_gone, F.lit(0))

    gone = [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("limit", "weight")]
    listed = listed.withColumn("stopped", F.col("ratio") < level(*gone))
    stopped = [F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(every), F.lit(0)) for c in ("limit", "weight")]
    target = F.when(F.col("stopped"), F.col("limit").cast("double")).otherwise(level(*stopped) * F.col("weight"))
    return listed.withColumn("target", F.least(target, F.col("limit").cast("double"))).drop("limit", "ratio", "stopped")


def numbered(docs: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """``docs`` with a row number ``row``, ``size`` in words and ``order_key``, written out so that numbers stay.

    Which words a row gives depends on ``doc_id`` and text alone, not on ``row``.
    """
    return scratch.write(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source", *keep,
            F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("order_key"),
        ),
        "numbered",
    )


def block_pieces(rows: DataFrame, plan: DataFrame, block_words: int) -> DataFrame:
    """``(row, source_no, block, first_word, last_word)``: the part of a document in each block of its source.

    A document starts after all documents in lower buckets of its source and
    those before it in its own; no task holds more of a source than one bucket.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "order_key"), F.lit(BUCKETS)).cast("int")
    placed = rows.filter("size > 0").join(plan.select("source", "source_no"), rows["source"].eqNullSafe(plan["source"]))
    placed = placed.select("row", "source_no", "size", "order_key", "doc_id", bucket.alias("bucket"))
    lower = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "order_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum("size").over(own), F.lit(0))
    at = placed.join(sums, ["source_no", "bucket"]).withColumn("start", start)
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = at.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.col("block") * block_words - F.col("start")
    return cut.select(
        "row", "source_no", "block",
        F.greatest(begin, F.lit(0)).alias("first_word"), F.least(begin + block_words, F.col("size")).alias("last_word"),
    )


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of indexes ``k`` under a pseudorandom permutation of ``range(n)``: a Feistel network, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def mix(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + salt * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))

    out = k.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> shift, out[todo] & mask
        for salt in range(4):
            left, right = right, left ^ (mix(right, salt) & mask)
        out[todo] = (left << shift) | right
        todo &= out >= n
    return out.astype(np.int64)


def draw_slots(plan: DataFrame, block_words: int, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """``(shard, source_no, slot, block, pass)``: every slot of the mix and the block that it holds.

    Per shard a source surely gets the whole part of its expected slots; the rest is
    a multinomial draw over the fractions, seeded by the shard.  Sources at their
    limit take no part in draws and get their fractions in turn, so that none is
    asked for more than ``MAX_PASSES`` passes.
    """
    spark = plan.sparkSession
    listed = plan.orderBy("source_no").limit(MAX_SOURCES + 1).toPandas()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = listed["source_size"].to_numpy(float)
    n_blocks = np.ceil(size / block_words).astype(np.int64)
    wanted = np.divide(listed["target"].fillna(0).to_numpy(float) * n_blocks, size, out=np.zeros(len(size)), where=size > 0)
    at_limit = wanted >= MAX_PASSES * n_blocks * (1 - 1e-9)
    n_shards = max(1, math.ceil(wanted.sum() / slots_per_shard))
    share = wanted / n_shards
    fraction = np.where(at_limit, 0.0, share - np.floor(share))
    drawn = fraction.sum()

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                n = np.floor(share).astype(np.int64)
                turns = np.floor((i + 1) * share + 1e-9) - np.floor(i * share + 1e-9)
                n[at_limit] = turns[at_limit]
                rest = int(math.floor((i + 1) * drawn + 0.5) - math.floor(i * drawn + 0.5))
                if rest:
                    n += np.random.default_rng([seed, i]).multinomial(rest, fraction / drawn)
                yield pd.DataFrame({"shard": i, "source_no": np.arange(len(n)), "n": n})

    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn_counts = spark.range(n_shards).mapInPandas(counts, "shard bigint, source_no int, n bigint").filter("n > 0")
    runs = drawn_counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(RUN_SLOTS).cast("long")))
    runs = runs.withColumn("start", starts).select(
        "shard", "source_no", F.col("start").alias("first"), F.least(F.col("first") + F.col("n") - F.col("start"), F.lit(RUN_SLOTS)).alias("n")
    )
    runs = runs.repartition(max(8, math.ceil(wanted.sum() / (20 * RUN_SLOTS))), "shard", "source_no", "first")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run in batch.itertuples():
                blocks = int(n_blocks[run.source_no])
                k = np.arange(run.first, min(run.first + run.n, MAX_PASSES * blocks))
                for p in range(MAX_PASSES):
                    own = k[(k // blocks) == p] if blocks else k[:0]
                    if len(own):
                        at = permuted(own - p * blocks, blocks, (seed * 1_000_003 + run.source_no) * MAX_PASSES + p)
                        yield pd.DataFrame({"shard": run.shard, "source_no": run.source_no, "slot": own, "block": at, "pass": p})

    return runs.mapInPandas(held, "shard bigint, source_no int, slot bigint, block bigint, pass int")


class Mix:
    """The mix of a table: ``rows``, ``plan``, ``pieces`` and ``slots``.

    Null texts and texts without words have size 0 and give nothing.  A null
    source is a source like any other, the last one.  Repeated rows are documents
    of their own.  Reruns with the same seed give the same rows.  An empty table
    gives an empty mix.
    """

    def __init__(self, docs: DataFrame, *keep: str, block_words: int = BLOCK_WORDS):
        scratch = Scratch(docs.sparkSession, "mixture")
        self.rows = numbered(docs, scratch, *keep)
        self.plan = scratch.write(source_targets(self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "plan")
        self.pieces = block_pieces(self.rows, self.plan, block_words)
        self.slots = draw_slots(self.plan, block_words)

    def taken(self) -> DataFrame:
        """Every document with its source's figures and ``taken``: its words in the mix, repeats counted."""
        # The planner takes the few runs for all the slots that they expand to: no broadcast here.
        times = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
        words_taken = self.pieces.join(times, ["source_no", "block"]).groupBy("row").agg(
            F.sum((F.col("last_word") - F.col("first_word")) * F.col("times")).alias("taken")
        )
        plan = self.plan.withColumnRenamed("source", "_source")
        return (
            self.rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .join(words_taken.hint("merge"), "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        )

    def documents(self) -> DataFrame:
        """The mix as documents: for each pass the part of a document that its blocks take, in text order.

        A document that a pass takes whole keeps its text as it is.  Otherwise the
        text is the taken stretches as they stand, joined by line ends.  Needs
        ``text`` among the kept columns.
        """
        span = F.sort_array(F.collect_list(F.struct("first_word", "last_word")))
        spans = self.pieces.join(self.slots.select("source_no", "block", "pass").hint("merge"), ["source_no", "block"])
        spans = spans.groupBy("row", "pass").agg(span.alias("spans"))
        joined = self.rows.join(spans.hint("merge"), "row").drop("order_key", "row", "pass")
        return joined.withColumn("spans", F.when(F.size("spans") > 0, F.col("spans"))).mapInArrow(_cut, joined.schema).drop("spans", "size")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD)
    for batch in batches:
        names = batch.schema.names
        texts = []
        for text, size, spans in zip(*(batch.column(names.index(c)).to_pylist() for c in ("text", "size", "spans"))):
            runs: list[list[int]] = []
            for s in spans:
                if runs and runs[-1][1] == s["first_word"]:
                    runs[-1][1] = s["last_word"]
                else:
                    runs.append([s["first_word"], s["last_word"]])
            if runs != [[0, size]]:
                ends = [(m.start(), m.end()) for m in word.finditer(text)]
                text = "\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in runs)
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(k) for k, c in enumerate(names)]
        yield pa.RecordBatch.from_arrays(columns, names)
