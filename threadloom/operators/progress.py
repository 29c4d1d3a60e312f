"""Comment-phase planning and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.scalars import blank_to_null, dedup_key
from threadloom.schemas import SMOKE_POST_CAP


def done_ids(done: DataFrame, done_id: str = "post_id") -> DataFrame:
    return done.select(dedup_key(done_id).alias("__done")).filter("__done is not null").distinct()


def completed_posts(noted: DataFrame, comments: DataFrame) -> DataFrame:
    """Distinct post ids that are noted as done or already have stored comments.

    ``repaired`` is true for those only the stored comments know about.
    """
    both = noted.select(dedup_key("post_id").alias("post_id"), F.lit(False).alias("repaired")).unionByName(
        comments.select(blank_to_null("post_id").alias("post_id"), F.lit(True).alias("repaired"))
    )
    return both.filter("post_id is not null").groupBy("post_id").agg(F.min("repaired").alias("repaired"))


def pending_posts(
    posts: DataFrame,
    done: DataFrame,
    order: list[Column | str],
    post_id: str = "id",
    done_id: str = "post_id",
    skip_empty: bool = True,
    max_posts: int | None = None,
) -> DataFrame:
    """Posts whose comments are still to be fetched, in ``order``.

    Left out: posts without a usable id, posts already done, and (``skip_empty``)
    posts known to have no comments.  None of these count toward ``max_posts``.
    """
    todo = posts.filter(dedup_key(post_id).isNotNull())
    if skip_empty:
        todo = todo.filter(~F.col("num_comments").eqNullSafe(F.lit(0)))
    todo = todo.join(done_ids(done, done_id), dedup_key(post_id) == F.col("__done"), "left_anti")
    return todo if max_posts is None else todo.orderBy(*order).limit(max_posts)


def smoke_posts(posts: DataFrame, done: DataFrame, order: list[Column | str], **options) -> DataFrame:
    """A first handful of pending posts, to try a run."""
    return pending_posts(posts, done, order, max_posts=SMOKE_POST_CAP, **options)


def phase_summary(posts: DataFrame, done: DataFrame, post_id: str = "id", done_id: str = "post_id",
                  skip_empty: bool = True) -> DataFrame:
    """One row on what a comment run would do, over all posts."""
    key = dedup_key(post_id)
    flagged = posts.select(key.alias("__id"), "num_comments").join(
        done_ids(done, done_id).withColumn("__known", F.lit(True)), F.col("__id") == F.col("__done"), "left"
    )
    known = F.coalesce("__known", F.lit(False))
    usable = F.col("__id").isNotNull()
    empty = F.lit(skip_empty) & F.col("num_comments").eqNullSafe(F.lit(0))
    return flagged.agg(
        F.count(F.lit(1)).alias("posts_seen"),
        F.count_if(usable).alias("posts_usable"),
        F.count_if(~usable).alias("posts_without_id"),
        F.count_if(usable & known).alias("posts_already_complete"),
        F.count_if(usable & ~known & empty).alias("posts_skipped_empty"),
        F.count_if(usable & ~known & ~empty).alias("posts_attempted"),
    )


def require_usable_posts(summary: DataFrame) -> DataFrame:
    """Fail when a run has no posts, or none with a usable id; no comments is fine."""
    message = F.when(F.col("posts_seen") == 0, "no posts are stored for this run").when(
        F.col("posts_usable") == 0, "no stored post has a usable id"
    )
    return summary.filter(
        F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    )


def comment_progress(runs: DataFrame, posts: DataFrame, comments: DataFrame, noted: DataFrame) -> DataFrame:
    """Comment progress of every run.

    ``runs``: ``run_id``; ``posts`` and ``comments``: stored rows with ``run_id``
    (and ``post_id``); ``noted``: saved progress with ``run_id``,
    ``posts_completed``, ``posts_skipped_empty``, ``comments_collected``.
    Saved progress of the run decides; without it stored comments make it
    ``unknown``; with neither it is ``not_started``.
    """
    considered = posts.groupBy("run_id").agg(F.count(F.lit(1)).alias("posts_considered"))
    # Two plain aggregates instead of count(distinct): no row is expanded.
    per_post = comments.groupBy("run_id", "post_id").agg(F.count(F.lit(1)).alias("n"))
    stored = per_post.groupBy("run_id").agg(
        F.count("post_id").alias("stored_posts"), F.sum("n").alias("stored_comments")
    )
    saved = noted.select(
        "run_id",
        F.lit(True).alias("has_saved"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("posts_completed", "posts_skipped_empty", "comments_collected")],
    )
    joined = (
        runs.select("run_id").distinct().join(considered, "run_id", "left").join(stored, "run_id", "left")
        .join(saved, "run_id", "left")
    )
    return progress_status(joined)


def progress_status(joined: DataFrame) -> DataFrame:
    """The status rule of :func:`comment_progress` over one row per run.

    Columns: ``run_id``, ``posts_considered``; ``has_saved`` and the three saved
    counts; ``stored_posts``, ``stored_comments``.  Others stay.
    """
    used = ("posts_considered", "stored_posts", "stored_comments", "has_saved", "posts_completed", "posts_skipped_empty", "comments_collected")
    rest = [c for c in joined.columns if c not in used]
    has_saved = F.coalesce("has_saved", F.lit(False))
    total = F.coalesce("posts_considered", F.lit(0))
    finished = F.col("posts_completed") + F.col("posts_skipped_empty")
    has_data = F.coalesce("stored_comments", F.lit(0)) > 0
    return joined.select(
        *rest,
        F.when(has_saved, F.when((total > 0) & (finished >= total), "complete").otherwise("in_progress"))
        .when(has_data, "unknown")
        .otherwise("not_started")
        .alias("status"),
        F.when(has_saved, F.col("posts_completed")).otherwise(F.coalesce("stored_posts", F.lit(0))).alias("posts_completed"),
        F.when(has_saved, F.col("posts_skipped_empty")).otherwise(F.lit(0)).alias("posts_skipped_empty"),
        F.when(has_saved, F.col("comments_collected")).otherwise(F.coalesce("stored_comments", F.lit(0))).alias(
            "comments_collected"
        ),
        total.alias("posts_considered"),
    )


def ingest_summary(batches: DataFrame) -> DataFrame:
    """Per run: pages, posts of the latest session, total.  One input row per batch."""
    latest = F.max("session").alias("session")
    newest = batches.groupBy("run_id").agg(latest)
    flagged = batches.join(newest.withColumnRenamed("session", "__latest"), "run_id")
    now = F.col("session") == F.col("__latest")
    return flagged.groupBy("run_id").agg(
        F.count_if(now).alias("pages"),
        F.coalesce(F.sum(F.when(now, F.col("rows"))), F.lit(0)).alias("posts_this_run"),
        F.sum("rows").alias("total_posts"),
        F.coalesce(F.bool_or(now & F.col("stopped")), F.lit(False)).alias("stopped"),
    )
