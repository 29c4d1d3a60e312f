"""Agreement between layers, lost records, posts with their comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.scalars import dedup_key


def id_agreement(raw: DataFrame, processed: DataFrame, raw_id: str = "id", processed_id: str = "id") -> DataFrame:
    """Per id: how often it is in each layer.

    One grouping over both layers instead of a full join: counts are reduced
    before the only shuffle, so repeated ids cannot make a task large.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = raw.select(dedup_key(raw_id).alias("id"), one.alias("r"), none.alias("p")).unionByName(
        processed.select(dedup_key(processed_id).alias("id"), none.alias("r"), one.alias("p"))
    )
    return both.groupBy("id").agg(F.sum("r").alias("raw_rows"), F.sum("p").alias("processed_rows"))


def layer_agreement(raw: DataFrame, processed: DataFrame, raw_id: str = "id", processed_id: str = "id") -> DataFrame:
    """One row: totals, set and bag equality of ids, uniqueness of ids per layer."""
    ids = id_agreement(raw, processed, raw_id, processed_id)
    named = F.col("id").isNotNull()
    return ids.agg(
        F.coalesce(F.sum("raw_rows"), F.lit(0)).alias("raw_total"),
        F.coalesce(F.sum("processed_rows"), F.lit(0)).alias("processed_total"),
        F.count_if(named & (F.col("processed_rows") == 0)).alias("only_raw_ids"),
        F.count_if(named & (F.col("raw_rows") == 0)).alias("only_processed_ids"),
        F.count_if(named & (F.col("raw_rows") > 1)).alias("repeated_raw_ids"),
        F.count_if(named & (F.col("processed_rows") > 1)).alias("repeated_processed_ids"),
        F.count_if(F.col("raw_rows") != F.col("processed_rows")).alias("unequal_ids"),
    ).select(
        "*",
        (F.col("raw_total") == F.col("processed_total")).alias("counts_agree"),
        ((F.col("only_raw_ids") == 0) & (F.col("only_processed_ids") == 0)).alias("ids_agree"),
        ((F.col("repeated_raw_ids") == 0) & (F.col("repeated_processed_ids") == 0)).alias("ids_unique"),
    )


def lost_records(noted: DataFrame, stored: DataFrame, noted_id: str = "id", stored_id: str = "id") -> DataFrame:
    """Ids that progress has noted but the stored data no longer holds."""
    have = stored.select(dedup_key(stored_id).alias("__id")).filter("__id is not null").distinct()
    want = noted.select(dedup_key(noted_id).alias("id")).filter("id is not null").distinct()
    return want.join(have, F.col("id") == F.col("__id"), "left_anti")


def deletion_guard(progress: DataFrame, totals: DataFrame) -> DataFrame:
    """Per run: noted total against stored total; ``data_missing`` if more was noted.

    ``progress`` has ``run_id, total_fetched``; ``totals`` has ``run_id, processed_posts``.
    """
    return progress.join(totals, "run_id", "left").select(
        "run_id",
        "total_fetched",
        F.coalesce("processed_posts", F.lit(0)).alias("stored"),
        (F.col("total_fetched") > F.coalesce("processed_posts", F.lit(0))).alias("data_missing"),
        F.greatest(F.col("total_fetched") - F.coalesce("processed_posts", F.lit(0)), F.lit(0)).alias("missing"),
    )


def posts_with_comments(
    posts: DataFrame, comments: DataFrame, how: str = "inner", post_key: Column | None = None
) -> DataFrame:
    """Posts joined with their comments on ``post_id``; comment columns get ``c_``.

    For ``how='left'`` the posts without comments are added by an anti join on
    the distinct post ids of the comments.  A plain left join could not be split
    by AQE when one post has most of the comments; the inner join can.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: inner or left, not {how!r}")
    key = post_key if post_key is not None else dedup_key("id")
    right = comments.select([F.col(c).alias(f"c_{c}") for c in comments.columns])
    inner = posts.withColumn("__key", key).join(right, F.col("__key") == F.col("c_post_id")).drop("__key")
    if how == "inner":
        return inner
    commented = comments.select(F.col("post_id").alias("__has")).filter("__has is not null").distinct()
    bare = posts.join(commented, key == F.col("__has"), "left_anti")
    return inner.unionByName(bare, allowMissingColumns=True)


def comment_stats(posts: DataFrame, comments: DataFrame, post_id: str = "id") -> DataFrame:
    """Per post: stored comments, deepest level, distinct authors.  Counts before joining."""
    per_post = comments.groupBy(F.col("post_id").alias("__post")).agg(
        F.count_if(F.coalesce(F.col("kind") != "more", F.lit(True))).alias("stored_comments"),
        F.max("depth").alias("max_depth"),
        F.count_distinct("author").alias("authors"),
    )
    return posts.join(per_post, dedup_key(post_id) == F.col("__post"), "left").select(
        *[F.col(c) for c in posts.columns],
        F.coalesce("stored_comments", F.lit(0)).alias("stored_comments"),
        "max_depth",
        F.coalesce("authors", F.lit(0)).alias("authors"),
    )
