"""Queries over an archive of the engine's own: ingested, then described from its logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.plans.registry import query, table
from threadloom.plans.runs import _landing, _text
from threadloom.sources.store import Store, stored_done
from threadloom.streaming import collection
from threadloom.streaming.ingest import ingest_comments, ingest_posts
from threadloom.streaming.status import comment_phase, store_collections, store_status


def _comments() -> Column:
    """Every event is a post with so many comments, in the collection of its type."""
    return F.col("event_id") % 3


def _land_posts(events: DataFrame, folder: str) -> None:
    key = F.col("event_id")
    events.select(_text('{"data":[{"id":"e', key, '","num_comments":', _comments(), ',"created_utc":', key, "}]}")).write.mode("append").text(folder)


def _land_trees(events: DataFrame, folder: str) -> None:
    node = _text('{"kind":"t1","data":{"id":"c', F.col("event_id"), 'x"}}')
    nodes = F.concat_ws(",", F.array_repeat(node, _comments().cast("int")))
    tree = _text('{"data":[', nodes, "]}").alias("payload")
    events.select(_text("e", F.col("event_id")).alias("post_id"), tree).write.mode("append").json(folder)


class _Archive:
    """A collection per event type in a new store below the checkpoint folder."""

    def __init__(self, spark, sf_dir):
        self.root = _landing(spark)
        self.store = Store(spark, f"{self.root}/store")
        self.events = table(spark, sf_dir, "events", spread=True)

    def of(self, kind: str) -> DataFrame:
        return self.events.filter(F.col("event_type") == kind)

    def posts(self, kind: str, max_posts: int | None = None) -> None:
        collection.start(self.store, {"subreddit": kind, "run_id": kind, "max_posts": max_posts})
        _land_posts(self.of(kind), f"{self.root}/{kind}-pages")
        ingest_posts(self.store, f"{self.root}/{kind}-pages", kind, f"{self.root}/{kind}-posts", page_per_line=True)

    def comments(self, kind: str, rows: str):
        _land_trees(self.of(kind).filter(rows), f"{self.root}/{kind}-trees")
        return ingest_comments(self.store, f"{self.root}/{kind}-trees", kind, f"{self.root}/{kind}-comments")


_STATUS_SQL = """
    WITH r AS (SELECT event_type AS run_id, count(*) AS n, count_if(event_id % 3 = 0) AS none, count_if(event_id % 3 = 1) AS one,
                 count_if(event_id % 3 = 2) AS two
               FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY 1),
      c AS (SELECT *, CASE run_id WHEN 'click' THEN one WHEN 'signup' THEN 0 ELSE one + two END AS done,
              CASE run_id WHEN 'click' THEN one WHEN 'signup' THEN 0 ELSE one + 2 * two END AS comments FROM r)
    SELECT run_id, n AS raw_posts, n AS processed_posts, comments AS raw_comments, comments AS processed_comments,
      CASE WHEN run_id = 'signup' THEN 'not_started' WHEN run_id = 'purchase' THEN 'unknown'
           WHEN done + none >= n THEN 'complete' ELSE 'in_progress' END AS status,
      done AS posts_completed, CASE WHEN run_id IN ('view', 'click') THEN none ELSE 0 END AS posts_skipped_empty,
      comments AS comments_collected, n AS posts_considered
    FROM c"""


@query("store_status", _STATUS_SQL)
def status(spark, sf_dir):
    """A run in each state: finished, half done, not begun, and one whose progress was reset."""
    a = _Archive(spark, sf_dir)
    for kind in ("view", "click", "signup", "purchase"):
        a.posts(kind)
    a.comments("view", "event_id % 3 > 0")
    a.comments("click", "event_id % 3 = 1")
    a.comments("purchase", "event_id % 3 > 0")
    collection.reset(a.store, "purchase-open-open")
    return store_status(a.store).drop("saved_at")


@query(
    "store_collections",
    """SELECT event_type || '-open-open' AS name, event_type AS run_id, count(*) AS total_fetched,
         CASE event_type WHEN 'click' THEN 'complete' ELSE 'in_progress' END AS status,
         CASE event_type WHEN 'click' THEN count_if(event_id % 3 = 2) END AS posts_completed,
         CASE event_type WHEN 'click' THEN count_if(event_id % 3 = 0) END AS posts_skipped_empty,
         CASE event_type WHEN 'click' THEN count_if(event_id % 3 = 2) * 2 END AS comments_collected
       FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type""",
)
def collections(spark, sf_dir):
    """One collection at its cap, one resumed with a higher cap, one reset."""
    a = _Archive(spark, sf_dir)
    for kind in ("view", "click", "purchase"):
        a.posts(kind, max_posts=1)
    collection.resume(a.store, {"subreddit": "view", "max_posts": 10**15})
    a.comments("click", "event_id % 3 = 2")
    collection.reset(a.store, "purchase-open-open")
    return store_collections(a.store).select(
        "name", "run_id", "total_fetched", "status", "posts_completed", "posts_skipped_empty", "comments_collected"
    )


@query(
    "store_comment_phase",
    """SELECT 'view' AS run_id, count_if(event_id % 3 = 2) AS posts_attempted, count_if(event_id % 3 = 2) AS posts_completed,
         count_if(event_id % 3 < 2) AS posts_already_complete, 0 AS posts_skipped_empty,
         count_if(event_id % 3 = 2) * 2 AS comments_collected, CAST(sum(event_id % 3) AS BIGINT) AS total_comments
       FROM events WHERE event_type = 'view'""",
)
def second_phase(spark, sf_dir):
    """What the second of two calls did; trees of the first land again and count as known."""
    a = _Archive(spark, sf_dir)
    a.posts("view")
    a.comments("view", "event_id % 3 = 1")
    return comment_phase(a.store, "view", a.comments("view", "event_id % 3 > 0").session)


@query(
    "skipped_posts",
    """SELECT 'e' || event_id AS post_id, event_id % 3 = 0 AS skipped FROM events WHERE event_type = 'click' AND event_id % 3 < 2""",
)
def skipped_posts(spark, sf_dir):
    """Posts that need no tree any more; a tree that lands for an empty post changes nothing."""
    a = _Archive(spark, sf_dir)
    a.posts("click")
    a.comments("click", "event_id % 3 < 2")
    empty = a.store.read("skipped_posts", "click").select("post_id", F.lit(True).alias("skipped"))
    return stored_done(a.store, "click").join(empty, "post_id", "left").fillna(False)


_DAMAGED_LINES = """CASE event_type WHEN 'signup' THEN '{"payload":"' || event_id || '"}' ELSE '{"post_id":"e' || event_id END"""


@query(
    "stream_ingest_damaged",
    f"""SELECT 'raw_comments' AS kind, 'c' || event_id || 'x' AS value, NULL AS error
        FROM events, range(2) t(i) WHERE event_type IN ('view', 'click') AND i < event_id % 3
        UNION ALL SELECT 'done_posts', 'e' || event_id, NULL FROM events WHERE event_type IN ('view', 'click')
        UNION ALL SELECT 'tree_errors', 'e' || event_id, 'no list under data' FROM events WHERE event_type = 'click'
        UNION ALL SELECT 'line_errors', {_DAMAGED_LINES}, CASE event_type WHEN 'signup' THEN 'no post id or no payload' ELSE 'not one JSON object' END
        FROM events WHERE event_type IN ('signup', 'error')""",
)
def damaged(spark, sf_dir):
    """Good trees, trees of the wrong shape that land again whole, lines without a post and torn lines: all tables of the ingest."""
    a = _Archive(spark, sf_dir)
    landed, key = f"{a.root}/click-trees", F.col("event_id")
    _land_trees(a.of("view"), landed)
    a.of("click").select(_text("e", key).alias("post_id"), F.lit('{"data": 5}').alias("payload")).write.mode("append").json(landed)
    torn = F.when(F.col("event_type") == "signup", _text('{"payload":"', key, '"}')).otherwise(_text('{"post_id":"e', key))
    a.events.filter("event_type in ('signup', 'error')").select(torn).write.mode("append").text(landed)
    ingest_comments(a.store, landed, "click", f"{a.root}/click-comments")
    a.comments("click", "true")
    none = F.lit(None).cast("string").alias("error")
    tables = {
        "raw_comments": (F.get_json_object("value", "$.data.id"), none),
        "done_posts": (F.col("post_id"), none),
        "tree_errors": (F.col("post_id"), "error"),
        "line_errors": (F.col("value"), "error"),
    }
    found = [
        a.store.read(name).select(F.lit(name).alias("kind"), value.alias("value"), error) for name, (value, error) in tables.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
