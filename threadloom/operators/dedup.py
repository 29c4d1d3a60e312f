"""First-seen deduplication and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.scalars import dedup_key


def first_seen(df: DataFrame, order: list[Column | str], record_id: str = "id") -> DataFrame:
    """Keep the first row per id in ``order``; rows without an id are all kept.

    The earliest row is picked by an aggregate, not a window: each task reduces
    its own copies first, so an id that fills a third of the table sends only
    one row per task to the shuffle.
    """
    columns = df.columns
    rank = F.struct(*order)
    keyed = df.withColumn("__key", dedup_key(record_id))
    # A row without an id is a group of its own, whatever its place in the order.
    keyed = keyed.withColumn("__alone", F.when(F.col("__key").isNull(), F.monotonically_increasing_id()))
    picked = keyed.groupBy("__key", "__alone").agg(
        F.min_by(F.struct(*[F.col(c) for c in columns]), rank).alias("__row")
    )
    return picked.select(*[F.col("__row")[c].alias(c) for c in columns])


def unseen(batch: DataFrame, seen: DataFrame, record_id: str = "id", seen_id: str | None = None) -> DataFrame:
    """Rows whose id is not in ``seen``; rows without an id pass."""
    known = seen.select(dedup_key(seen_id or record_id).alias("__seen")).filter("__seen is not null").distinct()
    return batch.join(known, dedup_key(record_id) == F.col("__seen"), "left_anti")


def all_known_ids(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Distinct ids over several tables given as ``(table, id column)``."""
    parts = [df.select(dedup_key(column).alias("id")).filter("id is not null").distinct() for df, column in sources]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.distinct()


def reconcile_stored(progress_ids: DataFrame, stored: DataFrame, record_id: str = "id") -> DataFrame:
    """Ids that are stored but missing from the progress record."""
    on_disk = stored.select(dedup_key(record_id).alias("id")).filter("id is not null").distinct()
    noted = progress_ids.select(dedup_key("id").alias("__noted")).filter("__noted is not null").distinct()
    return on_disk.join(noted, F.col("id") == F.col("__noted"), "left_anti")
