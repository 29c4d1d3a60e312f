"""Chunk inventories, stream counts and reports on how runs are stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.schemas import STREAMS


def tag_streams(streams: dict[str, DataFrame], *columns: str) -> DataFrame:
    """Union of the given streams with a ``stream`` column; keeps only ``columns``."""
    tagged = [df.select(F.lit(name).alias("stream"), *columns) for name, df in streams.items()]
    return reduce(DataFrame.unionByName, tagged)


def run_stream_counts(tagged: DataFrame) -> DataFrame:
    """Records per run and stream."""
    return tagged.groupBy("run_id", "stream").agg(F.count(F.lit(1)).alias("records"))


def run_totals(counts: DataFrame) -> DataFrame:
    """One row per run with a column per stream; a stream without records is 0."""
    return counts.groupBy("run_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("stream") == s, F.col("records"))), F.lit(0)).alias(s) for s in STREAMS]
    )


def chunk_inventory(records: DataFrame, keys: tuple[str, ...] = ("run_id", "stream")) -> DataFrame:
    """Records per chunk; ``chunk_no`` 0 is an old-style single file."""
    return (
        records.groupBy(*keys, "chunk_no")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("legacy", F.col("chunk_no") == 0)
    )


def over_limit(inventory: DataFrame, chunk_size: int) -> DataFrame:
    """Chunks above the limit; old-style files are exempt but flagged ``legacy``."""
    return inventory.filter(F.col("records") > chunk_size)


def inventory_pages(inventory: DataFrame, page_size: int = 1000) -> DataFrame:
    """Chunk lists of at most ``page_size`` chunks: run, stream, page, chunks, total.

    Paged, because the number of chunks of one run has no bound.
    """
    entry = F.struct("chunk_no", "records", "legacy")
    page = F.floor(F.col("chunk_no") / page_size).cast("bigint").alias("page")
    return inventory.groupBy("run_id", "stream", page).agg(
        F.array_sort(F.collect_list(entry)).alias("chunks"), F.sum("records").alias("total")
    )


def manifest(inventory: DataFrame, params: DataFrame, chunk_size: int) -> DataFrame:
    """One JSON document per run: parameters, and per stream chunks and records.

    ``params`` has ``run_id``, ``started_at`` and any parameter columns.  The
    chunk lists themselves are :func:`inventory_pages`.
    """

    def count_of(stream: str, value) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stream") == stream, value)), F.lit(0)).alias(stream)

    per_run = inventory.groupBy("run_id").agg(
        F.struct(*[count_of(s, F.lit(1)) for s in STREAMS]).alias("chunks"),
        F.struct(*[count_of(s, F.col("records")) for s in STREAMS]).alias("totals"),
    )
    names = [c for c in params.columns if c not in ("run_id", "started_at")]
    doc = F.to_json(
        F.struct(
            "run_id",
            "started_at",
            F.lit(chunk_size).alias("chunk_size"),
            F.struct(*names).alias("params"),
            "chunks",
            "totals",
        ),
        {"ignoreNullFields": "false"},
    )
    return params.join(per_run, "run_id", "left").select("run_id", doc.alias("value"))


def chunk_report(inventory: DataFrame, chunk_size: int) -> DataFrame:
    """Per run: totals, whether the layers agree, chunks over the limit, overall ``ok``.

    Old-style files over the limit are counted apart and do not spoil ``ok``;
    :func:`over_limit` names the chunks.
    """
    is_over = F.col("records") > chunk_size

    def total(stream: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stream") == stream, F.col("records"))), F.lit(0))

    report = inventory.groupBy("run_id").agg(
        *[total(s).alias(s) for s in STREAMS],
        F.count_if(is_over & ~F.col("legacy")).alias("over_limit"),
        F.count_if(is_over & F.col("legacy")).alias("legacy_over_limit"),
    )
    posts = F.col("raw_posts") == F.col("processed_posts")
    comments = F.col("raw_comments") == F.col("processed_comments")
    return (
        report.withColumn("posts_agree", posts)
        .withColumn("comments_agree", comments)
        .withColumn("ok", posts & comments & (F.col("over_limit") == 0))
    )
