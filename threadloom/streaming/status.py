"""State of an archive from its own logs: runs, collections, the comment phase.

The commit log says how many rows each batch put into each table, and the journal
which collections there are.  Both grow with batches and events, not with rows, so
a status costs no read of posts or comments.  One thing is not in the logs: the
posts behind the comments of a run whose progress was reset; these are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.operators.collections import catalog
from threadloom.operators.progress import progress_status
from threadloom.sources.store import Store
from threadloom.streaming.collection import current


def _rows(table: str, when: Column | None = None) -> Column:
    """Rows that batches put into a table, added up."""
    n = F.col("rows")[table]
    return F.coalesce(F.sum(n if when is None else F.when(when, n)), F.lit(0))


def run_counts(store: Store) -> DataFrame:
    """One row per run: rows of each table, and when a batch was last committed."""
    tables = ("raw_posts", "posts", "page_errors", "raw_comments", "comments", "done_posts", "skipped_posts", "tree_errors", "line_errors")
    return store.events().groupBy("run_id").agg(
        *[_rows(t).alias(t) for t in tables],
        F.bool_or(F.col("stream").isin("comments", "skips")).alias("has_saved"),
        F.timestamp_micros((F.max("seq") / 1000).cast("bigint")).alias("saved_at"),
    )


def forgotten_runs(store: Store) -> DataFrame:
    """Runs whose collection was reset or started afresh: their data stays, their progress does not count."""
    runs = store.read("journal").select("run_id").filter("run_id is not null").distinct()
    return runs.join(current(store).select("run_id"), "run_id", "left_anti")


def store_status(store: Store) -> DataFrame:
    """Stored rows and comment progress of every run that has a committed batch.

    ``status`` is ``complete`` once as many posts are done or noted as empty as are
    stored, ``in_progress`` before, ``not_started`` without any batch of comments,
    and ``unknown`` for comments of a run whose progress was reset.
    """
    counts, gone = run_counts(store), forgotten_runs(store)
    per_post = store.spark.createDataFrame([], "run_id string, stored_posts bigint")
    if not gone.isEmpty():
        # Read for those runs only: the partitions of all others are pruned.
        theirs = store.read("comments").join(gone, "run_id", "left_semi").select("run_id", "post_id").distinct()
        per_post = theirs.groupBy("run_id").agg(F.count("post_id").alias("stored_posts"))
    flagged = counts.join(gone.withColumn("gone", F.lit(True)), "run_id", "left").join(per_post, "run_id", "left")
    return progress_status(
        flagged.select(
            "run_id",
            "saved_at",
            "raw_posts",
            F.col("posts").alias("processed_posts"),
            "raw_comments",
            F.col("comments").alias("processed_comments"),
            F.col("posts").alias("posts_considered"),
            (F.col("has_saved") & F.col("gone").isNull()).alias("has_saved"),
            F.col("done_posts").alias("posts_completed"),
            F.col("skipped_posts").alias("posts_skipped_empty"),
            F.col("comments").alias("comments_collected"),
            F.col("comments").alias("stored_comments"),
            "stored_posts",
        )
    )


def store_collections(store: Store) -> DataFrame:
    """The catalog of the collections in the journal, as ``collections.catalog`` gives it for saved documents.

    A collection is ``complete`` once it has as many posts as its latest cap; a
    reset one is not listed.
    """
    held = current(store).select("name", "run_id", "at", "max_posts")
    state = store_status(store)
    known = held.join(state, "run_id", "left").withColumn("error", F.lit(None).cast("string"))
    posts = known.select(
        "name", "error", "run_id", F.greatest("at", "saved_at").alias("saved_at"),
        F.coalesce("processed_posts", F.lit(0)).alias("total_fetched"), "max_posts",
    )
    begun = known.filter(F.col("status").isin("complete", "in_progress"))
    return catalog(posts, begun.select("name", "error", "posts_completed", "posts_skipped_empty", "comments_collected"))


def comment_phase(store: Store, run_id: str, session: str) -> DataFrame:
    """One row on what a call of ``ingest_comments`` did (``IngestResult.session``), beside what was there before.

    A call that committed nothing comes after all others.
    """
    events = store.events().filter((F.col("run_id") == run_id) & F.col("stream").isin("comments", "skips"))
    now, seq = F.col("session").eqNullSafe(F.lit(session)), F.col("seq")
    first, last = events.filter(now).agg(F.min("seq"), F.max("seq")).first()
    before = F.lit(True) if first is None else seq < first
    until = F.lit(True) if last is None else seq <= last
    return events.agg(
        F.lit(run_id).alias("run_id"),
        (_rows("done_posts", now) + _rows("tree_errors", now)).alias("posts_attempted"),
        _rows("done_posts", now).alias("posts_completed"),
        (_rows("done_posts", before) + _rows("skipped_posts", before)).alias("posts_already_complete"),
        _rows("skipped_posts", now).alias("posts_skipped_empty"),
        _rows("comments", now).alias("comments_collected"),
        _rows("comments", until).alias("total_comments"),
    )
