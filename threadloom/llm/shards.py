"""Sharding by fixed virtual slots.

A record hashes into one of some thousands of slots, for ever.  Bytes are summed
per slot, and a small map, stored by version, says which shard holds each slot.
Balancing or another number of shards edits the map; a record never changes its
slot.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.llm.common import let

N_SLOTS = 4096
#: How far above the mean a shard may stay before slots are taken from it.
TOLERANCE = 0.01


def record_slot(n_slots: int = N_SLOTS) -> Column:
    """Slot of a row: the hash of ``doc_id``, size and checksum, so an id with many texts, or none, does not fill one slot."""
    return F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(n_slots)).cast("int")


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and one more, so a null or empty text is 1), ``text_crc32`` and ``virtual_slot``."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    return measured.withColumn("virtual_slot", record_slot(n_slots))


def slot_sizes(records: DataFrame) -> DataFrame:
    """``(virtual_slot, bytes, n_rows)`` of the slots in use: at most one row per slot and task is shuffled."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def balanced_map(
    spark: SparkSession, sizes: DataFrame, n_shards: int, current: DataFrame | None = None,
    n_slots: int = N_SLOTS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(virtual_slot, shard)`` for every slot, so that the bytes of the shards come near to each other.

    Without a ``current`` map all slots are free.  With one, a shard keeps its
    largest slots up to the mean and the tolerance, and only what is above that
    (or on a shard that is no more) becomes free.  Free slots go, largest first,
    to the shard with the fewest bytes; an empty slot counts as one byte.  The map
    has ``n_slots`` rows, so this one-row fold has a fixed bound.
    """
    slots = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    known = slots.join(sizes, "virtual_slot", "left").withColumn("bytes", F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(1)))
    held = known.join(current, "virtual_slot", "left") if current is not None else known.withColumn("shard", F.lit(None).cast("int"))
    held = held.withColumn("shard", F.when(F.col("shard") < n_shards, F.col("shard")))
    largest_first = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    limit = F.sum("bytes").over(Window.partitionBy()) / n_shards * (1 + tolerance)
    kept = F.sum("bytes").over(largest_first.rowsBetween(Window.unboundedPreceding, 0)) <= limit
    held = held.withColumn("shard", F.when(F.col("shard").isNotNull() & kept, F.col("shard")))

    one = held.agg(
        F.sort_array(
            F.collect_list(F.when(F.col("shard").isNull(), F.struct((-F.col("bytes")).alias("b"), "virtual_slot")))
        ).alias("free"),
        F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("virtual_slot", "shard"))).alias("placed"),
        F.array(*(F.coalesce(F.sum(F.when(F.col("shard") == k, F.col("bytes"))), F.lit(0).cast("long")) for k in range(n_shards))).alias("loads"),
    )

    def place(state: Column, slot: Column) -> Column:
        def at(k: Column) -> Column:
            return F.struct(
                F.transform(state["loads"], lambda x, i: F.when(i == k, x - slot["b"]).otherwise(x)).alias("loads"),
                F.concat(state["placed"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), k.alias("shard")))).alias("placed"),
            )

        return let((F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int"), at)

    folded = F.aggregate("free", F.struct("loads", "placed"), place)["placed"]
    return one.select(F.explode(folded).alias("m")).select("m.virtual_slot", "m.shard")


def store_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """Write one version of the map; a version that exists is never replaced."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{folder}/map_version={version}")


def stored_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/map_version={version}").withColumn("map_version", F.lit(version))


def assign(records: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with ``shard``, ``map_version`` and ``slot``: the place in the shard, from 0 without gaps.

    A place is the number of rows in earlier slots of the shard plus the place in
    the own slot by ``doc_id``, so no task orders more than one virtual slot at a time.
    Rows that are equal throughout share their places in any order.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slot: the broadcast is bounded by the number of slots.
    offsets = F.broadcast(
        slot_map.join(sizes, "virtual_slot", "left").withColumn("first", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
        .select("virtual_slot", "shard", "map_version", "first")
    )
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(own) - 1)
        .join(offsets, "virtual_slot")
        .withColumn("slot", F.col("first") + F.col("place"))
        .drop("first", "place")
    )


def shard(docs: DataFrame, folder: str, n_shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) in a shard of near equal bytes; the map is stored in ``folder``.

    Result: ``doc_id, size, text_crc32, virtual_slot, shard, map_version, slot``.
    Rows of one ``doc_id``, or of none, are spread by their texts.  Rows that are equal in id
    and text get places of their own, but in one slot: the law holds as far as no
    such row is repeated to a large share of all bytes.
    An empty table gives an empty result and a map of empty slots.
    """
    records = slotted(docs.select("doc_id", "text"), n_slots).drop("text")
    sizes = slot_sizes(records)
    store_map(balanced_map(docs.sparkSession, sizes, n_shards, n_slots=n_slots), folder, 1)
    return assign(records, sizes, stored_map(docs.sparkSession, folder, 1))
