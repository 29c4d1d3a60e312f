"""Incremental ingest: landed pages and trees -> store, exactly once.

Each micro-batch writes its tables under an attempt of its own and then commits
them all at once in the store's log; it looks for known ids only in other batches.
Replaying a batch after a crash therefore replaces what it wrote, in all tables,
whatever step it died at and however many rows it has this time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions.scalars import dedup_key
from threadloom.functions.jsonrows import with_object
from threadloom.operators.dedup import first_seen, unseen
from threadloom.operators.tree import flatten_trees, tree_errors, tree_nodes
from threadloom.operators.progress import done_ids
from threadloom.sources.lines import parse_log_lines
from threadloom.sources.payloads import explode_pages
from threadloom.sources.store import Store, append_records, stored_done, stored_keys
from threadloom.streaming.arrival import STATE_CONF, first_arrivals, write_arrivals


@dataclass(frozen=True)
class IngestResult:
    """Batches that are done, whether the run was asked to stop, and whether it stopped at its cap.

    ``session`` is the name of the call in the store's log.
    """

    batches: int
    stopped: bool
    capped: bool = False
    session: str = field(default="", compare=False)


#: What a handler returns when the cap cut its batch short: the batch stays open.
_CAPPED = object()


class _Stopped(Exception):
    pass


def _drain(
    stream: DataFrame, handle, checkpoint: str, should_stop: Callable[[], bool] | None, session: str = ""
) -> IngestResult:
    """Process everything that has landed, batch by batch, until done or asked to stop.

    A stop is honoured between batches: the finished batch is committed and the
    next one is left untouched for a resume.  A batch that a cap cuts short is not
    committed: a resume reads it again, with the state from before it.
    """
    done = {"batches": 0, "stop": False, "capped": False}

    def run(batch: DataFrame, batch_id: int) -> None:
        if done["stop"]:
            raise _Stopped()
        if handle(batch, batch_id) is _CAPPED:
            done["stop"] = done["capped"] = True
            raise _Stopped()
        done["batches"] += 1
        done["stop"] = bool(should_stop and should_stop())

    query = (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except Exception as exc:
        # The query reports our own stop as a failed batch; anything else is real.
        if not done["stop"] or _Stopped.__name__ not in str(exc):
            raise
    return IngestResult(done["batches"], done["stop"] and not done["capped"], done["capped"], session)


# ------------------------------------------------------------------ posts


def page_stream(
    spark: SparkSession, landing: str, files_per_batch: int | None = None, page_per_line: bool = False
) -> DataFrame:
    """Landed search pages, named so that file names sort by arrival.

    A file is one page, or holds one page per line (``page_per_line``).
    """
    reader = spark.readStream.format("text").option("wholetext", str(not page_per_line).lower())
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.load(landing).select(
        F.col("value").alias("payload"),
        F.col("_metadata.file_name").alias("page"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return pages.filter(F.trim("payload") != "") if page_per_line else pages


def with_lines(batch: DataFrame) -> DataFrame:
    """Number the rows of a micro-batch so that a file keeps its line order."""
    return batch.withColumn("line", F.monotonically_increasing_id())


_PAGE_ORDER = ("page", "block", "line", "pos")


def page_items(pages: DataFrame) -> DataFrame:
    """Post objects of pages with their ``id``, and unusable pages with their text and ``page_error`` and no id."""
    items = explode_pages(pages, keep_errors=True)
    return items.withColumn("id", F.when(F.col("page_error").isNull(), F.get_json_object("value", "$.id")))


def ingest_posts(
    store: Store,
    landing: str,
    run_id: str,
    checkpoint: str,
    max_posts: int | None = None,
    files_per_batch: int | None = None,
    page_per_line: bool = False,
    should_stop: Callable[[], bool] | None = None,
    after_raw: Callable[[int], None] | None = None,
) -> IngestResult:
    """Store the new posts of every landed page, first seen first, up to ``max_posts``.

    Running it again with the same ``checkpoint`` and ``run_id`` resumes.  Pages
    that cannot be used go to ``page_errors``.  ``after_raw`` is called between reading a batch and writing it (for tests).
    """

    session = uuid.uuid4().hex

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.begin("posts", run_id, batch_id)
        order = [F.col(c) for c in _PAGE_ORDER]
        # Unusable pages are rows without an id, so a page is parsed once for all tables.
        rows = first_seen(page_items(with_lines(batch)), order).persist()
        fresh = unseen(rows.filter("page_error is null"), stored_keys(store, run_id, batch_id)).drop("id", "page_error")
        try:
            # They are kept with their text: the file counts as read from now on.
            bad = rows.filter("page_error is not null").select("page", F.col("value").alias("payload"), "page_error")
            store.write_batch("page_errors", bad, run_id, batch_id)
            if max_posts is not None:
                kept = store.read("posts", run_id).filter(F.col("batch_id") != batch_id).count()
                fresh = fresh.orderBy(*order).limit(max(0, max_posts - kept))
            fresh = fresh.persist()
            if after_raw:
                after_raw(batch_id)
            append_records(fresh, store, "posts", run_id, batch_id, order)
            store.commit("posts", run_id, batch_id, session)
        finally:
            fresh.unpersist()
            rows.unpersist()

    return _drain(page_stream(store.spark, landing, files_per_batch, page_per_line), handle, checkpoint, should_stop, session)


def ingest_posts_stateful(
    store: Store,
    landing: str,
    run_id: str,
    checkpoint: str,
    max_posts: int | None = None,
    files_per_batch: int | None = None,
    page_per_line: bool = False,
    should_stop: Callable[[], bool] | None = None,
) -> IngestResult:
    """As :func:`ingest_posts`, with the known ids in the streaming state store.

    No stored row is read while it runs, so cost per batch follows the batch, not
    the stored total: this is the way for long runs.  Of several copies, in one batch
    or in many, the first by page, split and line is kept.  Posts without an id are
    all kept.  Pages that cannot be used go to ``page_errors``.

    At ``max_posts`` the run ends (``capped``): the batch that goes beyond keeps its
    first posts and stays open, so with a higher cap the posts that were cut off are
    taken up again, without landing again.
    """
    arrived = first_arrivals(page_items(page_stream(store.spark, landing, files_per_batch, page_per_line)))
    order = [F.col("page"), F.col("block"), F.col("line")]
    stored: dict[str, int] = {}
    session = uuid.uuid4().hex

    def handle(batch: DataFrame, batch_id: int):
        rows = batch.persist()
        store.begin("posts", run_id, batch_id)
        try:
            bad = rows.filter("page_error is not null").select("page", F.col("value").alias("payload"), "page_error")
            store.write_batch("page_errors", bad, run_id, batch_id)
            fresh, capped = rows.filter("page_error is null").drop("id", "key", "page_error"), False
            if max_posts is not None:
                if not stored:  # once per call; a batch that is read again does not count itself
                    stored["n"] = store.read("posts", run_id).filter(F.col("batch_id") != batch_id).count()
                n, room = fresh.count(), max(0, max_posts - stored["n"])
                capped = n > room
                fresh = fresh.orderBy(*order).limit(room) if capped else fresh
                stored["n"] += min(n, room)
            if not capped:  # else the batch stays open, and the state does not know it
                write_arrivals(rows, checkpoint, batch_id)
            append_records(fresh, store, "posts", run_id, batch_id, order)
            store.commit("posts", run_id, batch_id, session)
            return _CAPPED if capped else None
        finally:
            rows.unpersist()

    conf = store.spark.conf
    before = {k: conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        conf.set(k, v)
    try:
        return _drain(arrived, handle, checkpoint, should_stop, session)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def ingest_batches(store: Store, run_id: str) -> DataFrame:
    """Pages and stored posts per batch of a run."""
    return store.read("posts", run_id).groupBy("run_id", "batch_id").agg(
        F.count_distinct("page").alias("pages"), F.count(F.lit(1)).alias("rows")
    )


# --------------------------------------------------------------- comments


def tree_lines(batch: DataFrame) -> DataFrame:
    """Landed tree lines as ``post_id, payload, file``, and unusable lines as ``file, value, error`` without the rest."""
    lines = with_object(batch.filter(F.trim("value") != ""), "value", "post_id string, payload string", "line")
    post_id, payload = F.col("post_id"), F.col("line.payload")
    error = F.when(F.col("line").isNull(), "not one JSON object").when(post_id.isNull() | payload.isNull(), "no post id or no payload")
    lines = lines.withColumn("post_id", dedup_key("line.post_id")).withColumn("error", error)
    good = F.col("error").isNull()
    return lines.select(
        F.when(good, post_id).alias("post_id"), F.when(good, payload).alias("payload"), "file", F.when(~good, F.col("value")).alias("value"), "error"
    )


def ingest_comments(
    store: Store,
    landing: str,
    run_id: str,
    checkpoint: str,
    wanted: DataFrame | None = None,
    files_per_batch: int | None = None,
    should_stop: Callable[[], bool] | None = None,
    skip_empty: bool = True,
) -> IngestResult:
    """Flatten, normalize and store landed comment trees, once per post.

    Landed files are JSON lines ``{"post_id", "payload"}``.  Posts already done
    are skipped, with ``skip_empty`` also the run's posts that say they have no
    comments: those are noted first (see :func:`note_empty_posts`); ``wanted`` (a column ``id``) limits the posts.  An unusable
    payload goes to ``tree_errors`` and leaves its post open.  A line that is not
    such an object, or names no post, goes to ``line_errors`` with its text.
    """
    session = uuid.uuid4().hex
    if skip_empty:
        note_empty_posts(store, run_id, session)
    reader = store.spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(landing).select("value", F.col("_metadata.file_name").alias("file"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.begin("comments", run_id, batch_id)
        done = stored_done(store, run_id, batch_id)
        # Unusable lines are rows without a post id, so a line is parsed once for all tables.
        rows = first_seen(tree_lines(batch), [F.col("file"), F.col("payload")], "post_id").persist()
        trees = rows.filter("error is null").select("post_id", "payload")
        trees = trees.join(done_ids(done), F.col("post_id") == F.col("__done"), "left_anti")
        if wanted is not None:
            asked = wanted.select(dedup_key("id").alias("__want")).distinct()
            trees = trees.join(asked, F.col("post_id") == F.col("__want"), "left_semi")
        flat = flatten_trees(trees, keep_raw=True).drop("ords").persist()
        try:
            store.write_batch("line_errors", rows.filter("error is not null").select("file", "value", "error"), run_id, batch_id)
            failed = tree_errors(flat)
            append_records(tree_nodes(flat), store, "comments", run_id, batch_id, [F.col("post_id"), F.col("pos")])
            store.write_batch("tree_errors", failed, run_id, batch_id)
            usable = trees.select("post_id").join(failed.select("post_id"), "post_id", "left_anti").filter("post_id is not null")
            # A post counts as done only together with its comments.
            store.write_batch("done_posts", usable, run_id, batch_id)
            store.commit("comments", run_id, batch_id, session)
        finally:
            flat.unpersist()
            rows.unpersist()

    return _drain(stream, handle, checkpoint, should_stop, session)


def note_empty_posts(store: Store, run_id: str, session: str | None = None) -> None:
    """Note the stored posts that say they have no comments, so that they count as done.

    A batch of posts is looked at once, and again only when it was replaced.  A
    post that is done already, or has no usable id, is not noted.
    """
    events = store.events().filter(F.col("run_id") == run_id)
    posts = events.filter("stream = 'posts'").select("batch_id", F.col("try").alias("of"))
    looked = events.filter("stream = 'skips'").select("batch_id", "of")
    # One short row per batch of posts since the last call.
    fresh = {r["batch_id"]: r["of"] for r in posts.join(looked, ["batch_id", "of"], "left_anti").collect()}
    if not fresh:
        return
    here = F.col("batch_id").isin(list(fresh))
    empty = store.read("posts", run_id).filter(here & (F.col("num_comments") == 0))
    empty = empty.select(dedup_key("id").alias("post_id"), "batch_id").filter("post_id is not null")
    known = store.read("done_posts", run_id).select("post_id").unionByName(
        store.read("skipped_posts", run_id).filter(~here).select("post_id")
    )
    noted = empty.groupBy("post_id").agg(F.min("batch_id").alias("batch_id"))
    noted = noted.join(done_ids(known), F.col("post_id") == F.col("__done"), "left_anti")
    store.write_derived("skipped_posts", noted, run_id, fresh, session)


def ingest_both(posts: Callable[[], IngestResult], comments: Callable[[], IngestResult]) -> tuple:
    """Posts, then comments; comments are skipped when the first phase was stopped."""
    first = posts()
    return first, None if first.stopped else comments()


# -------------------------------------------------------------------- logs


def ingest_logs(store: Store, landing: str, run_id: str, checkpoint: str) -> IngestResult:
    """Collect log lines as they land; ``logs.log_progress`` over them is the live state."""
    stream = store.spark.readStream.format("text").load(landing).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("row", F.monotonically_increasing_id())
        seq = F.struct(F.lit(batch_id).cast("bigint").alias("batch"), "file", "block", "row").alias("seq")
        store.begin("logs", run_id, batch_id)
        store.write_batch("log_lines", parse_log_lines(numbered.select("value", seq)), run_id, batch_id)
        store.commit("logs", run_id, batch_id)

    return _drain(stream, handle, checkpoint, None)
