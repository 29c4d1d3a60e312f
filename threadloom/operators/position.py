"""Global and per-group record positions without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.schemas import MAX_PAGE_SIZE
from threadloom.session import ensure_checkpoint_dir


def with_position(
    df: DataFrame, order: list[Column | str], within: list[str] | tuple[str, ...] = (), name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in ``order``, per ``within`` group.

    The rows are dealt into sorted ranges over (group, order) and written to the
    checkpoint folder once.  Each range is numbered on its own, and the counts of
    earlier ranges are added, so no task holds more than one range even when one
    group has most of the rows.  Spark sizes the ranges: as many as
    ``spark.sql.shuffle.partitions`` at most, fewer for little data.  Written
    rows keep counts and numbers consistent when a lost executor forces a rerun.

    ``order`` takes columns, ascending or descending, with either place for
    nulls.  It must tell rows apart for a repeatable result; rows that are equal in
    it share a range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    group = [F.col(c) for c in within]
    dealt = df.repartitionByRange(*group, *order_cols).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("__n"))
    # One row per range (and group), so this window is small by construction.
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("__range").alias("__r"),
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(within)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inner = Window.partitionBy("__range", *group).orderBy(*order_cols)
    numbered = dealt.withColumn("__rn", F.row_number().over(inner) - 1)
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col("__start") + F.col("__rn"))
        .drop("__range", "__rn", "__r", "__start", *[f"__g{i}" for i in range(len(within))])
    )


# ------------------------------------------------------------------ chunks


def next_slot(inventory: DataFrame, chunk_size: int, within: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Where appending continues: in the highest chunk, or after it when full."""
    last = inventory.filter("chunk_no >= 1").groupBy(*within).agg(
        F.max("chunk_no").alias("chunk_no"), F.max_by("records", "chunk_no").alias("records")
    )
    full = F.col("records") >= chunk_size
    return last.select(
        *within,
        F.when(full, F.col("chunk_no") + 1).otherwise(F.col("chunk_no")).alias("start_no"),
        F.when(full, F.lit(0)).otherwise(F.col("records")).alias("start_fill"),
    )


def assign_chunks(
    df: DataFrame,
    order: list[Column | str],
    chunk_size: int,
    within: tuple[str, ...] = (),
    slots: DataFrame | None = None,
) -> DataFrame:
    """Number the chunk every record goes to; ``slots`` is from :func:`next_slot`."""
    check_chunk_size(chunk_size)
    placed = with_position(df, order, within)
    if slots is None:
        start_no, start_fill = F.lit(1), F.lit(0)
    else:
        placed = placed.join(slots, list(within), "left")
        start_no, start_fill = F.coalesce("start_no", F.lit(1)), F.coalesce("start_fill", F.lit(0))
    chunk = start_no + F.floor((start_fill + F.col("pos")) / chunk_size)
    return placed.withColumn("chunk_no", chunk.cast("bigint")).drop("start_no", "start_fill")


def check_chunk_size(value) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"chunk_size: positive integer, not {value!r}")
    return value


# ------------------------------------------------------------------- pages


def check_page_size(value) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size: integer 1-{MAX_PAGE_SIZE}, not {value!r}")
    return value


def page_plan(df: DataFrame, order: list[Column | str], page_size: int) -> DataFrame:
    """Add the 1-based page number of each row of an ordered result."""
    check_page_size(page_size)
    placed = with_position(df, order)
    return placed.withColumn("page_no", (F.floor(F.col("pos") / page_size) + 1).cast("bigint"))


def page_cursors(pages: DataFrame, ts: str = "created_utc", sort: str = "asc", new: Column | None = None) -> DataFrame:
    """Per page: rows, new rows, and the time cursor it leaves behind.

    ``new`` marks rows not seen before.  A page without a new row steps one
    second past its extreme; a page without a time keeps the cursor (null here).
    """
    extreme = F.max(ts) if sort == "asc" else F.min(ts)
    step = 1 if sort == "asc" else -1
    fresh = F.count_if(new) if new is not None else F.count(F.lit(1))
    return pages.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("page_rows"), fresh.alias("new_rows"), extreme.cast("double").alias("extreme")
    ).select(
        "page_no",
        "page_rows",
        "new_rows",
        F.when(F.col("new_rows") > 0, F.col("extreme")).otherwise(F.col("extreme") + step).alias("cursor"),
    )


def stall_audit(
    page_log: DataFrame, page_size: int, within: list[str] | tuple[str, ...] = (), start_cursor: float | None = None
) -> DataFrame:
    """Flag pages that were full yet left the cursor where it was: paging would loop.

    ``page_log`` has ``page_no``, ``page_rows`` and ``cursor`` (null: the page
    had no usable time and kept the cursor).  The previous page is found by
    joining on ``page_no + 1``, so nothing is sorted in one task.
    """
    previous = page_log.select(
        *within,
        (F.col("page_no") + 1).alias("page_no"),
        F.col("cursor").alias("__before"),
        F.lit(True).alias("__known"),
    )
    first = F.col("page_no") == 1
    sent = F.when(first, F.lit(start_cursor).cast("double")).otherwise(F.col("__before"))
    known = first | F.coalesce("__known", F.lit(False))
    same = F.col("cursor").isNull() | (known & F.col("cursor").eqNullSafe(F.col("sent_cursor")))
    return (
        page_log.join(previous, [*within, "page_no"], "left")
        .withColumn("sent_cursor", sent)
        .withColumn("stalled", same & (F.col("page_rows") >= page_size))
        .drop("__before", "__known")
    )
