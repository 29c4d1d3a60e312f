"""Queries over comment trees and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.operators.integrity import comment_stats, posts_with_comments
from threadloom.operators.normalize import normalize_comments, quarantined
from threadloom.operators.tree import (
    PLACEHOLDERS,
    collapsed_ids,
    collapsed_remainder,
    flatten_trees,
    rebuild_paths,
    subtree,
    tree_nodes,
)
from threadloom.plans.registry import query, table


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_trees(spark, sf_dir: str) -> DataFrame:
    """One comment tree per order, with the oddities trees have.

    t1 root > t1 reply > (reply without id > t1 reply), a stray string, a "more"
    placeholder; then a node without data.  Finished orders have a bad envelope.
    """
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    deep = _text('{"kind":"t1","data":{"id":"d', key, '","parent_id":"t1_x","body":"deep","score":"9","replies":""}}')
    no_id = _text('{"kind":"t1","data":{"id":null,"parent_id":"odd","score":2.0,"replies":{"data":{"children":[', deep, "]}}}}")
    more = F.when(
        F.col("o_orderpriority") == "5-LOW",
        _text('{"kind":"more","data":{"children":["m', key, '"," ",', cust, '],"count":', cust, ',"parent_id":"t1_r', key, '"}}'),
    ).otherwise(_text('{"kind":"more","data":{"children":["m', key, '"," ",', cust, '],"parent_id":"t3_', key, '"}}'))
    reply = _text(
        '{"kind":"t1","data":{"id":"r', key, '","parent_id":"t1_c', key, '","author":"u', cust, '","body":"',
        F.col("o_orderpriority"), '","subreddit":"shop","created_utc":', day, ',"replies":{"data":{"children":[', no_id, ',"stray",', more, "]}}}}",
    )
    root = _text(
        '{"kind":"t1","data":{"id":" t1_c', key, '","parent_id":"t3_', key, '","subreddit":"shop","score":', cust,
        ',"permalink":"/r/shop/', key, '","replies":{"kind":"Listing","data":{"children":[', reply, "]}}}}",
    )
    good = _text('{"data":[', root, ',{"kind":"t1"},null,[]]}')
    payload = F.when(F.col("o_orderstatus") == "P", _text('{"data":', good, "}")).otherwise(good)
    return table(spark, sf_dir, "orders", spread=True).select(key.cast("string").alias("post_id"), payload.alias("payload"))


_COMMENT_SQL = """
  SELECT k AS post_id, 0 AS pos, 't1_c' || k AS comment_id, k AS parent_id, 'post' AS parent_kind, 't1' AS kind, 0 AS depth,
         '' AS path, NULL AS author, NULL AS body, c AS score, NULL AS created_iso,
         'https://www.reddit.com/r/shop/' || k AS permalink, '' AS children, NULL AS collapsed_count FROM o
  UNION ALL SELECT k, 1, 'r' || k, 'c' || k, 'comment', 't1', 1, 'c' || k, 'u' || c, pr, NULL,
         strftime(dt, '%Y-%m-%dT%H:%M:%S') || '+00:00', 'https://www.reddit.com/r/shop/comments/' || k || '/_/r' || k || '/', '', NULL FROM o
  UNION ALL SELECT k, 2, NULL, 'odd', 'unknown', 't1', 2, 'c' || k || '>r' || k, NULL, NULL, 2, NULL, NULL, '', NULL FROM o
  UNION ALL SELECT k, 3, 'd' || k, 'x', 'comment', 't1', 3, 'c' || k || '>r' || k, NULL, 'deep', NULL, NULL, NULL, '', NULL FROM o
  UNION ALL SELECT k, 4, NULL, CASE pr WHEN '5-LOW' THEN 'r' || k ELSE k END,
         CASE pr WHEN '5-LOW' THEN 'comment' ELSE 'post' END, 'more', 2, 'c' || k || '>r' || k, NULL, NULL, NULL, NULL, NULL,
         'm' || k || ',' || c, CASE pr WHEN '5-LOW' THEN c ELSE 2 END FROM o
"""
_ORDERS_SQL = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_custkey AS c, o_orderpriority AS pr, o_orderdate AS dt
                           FROM orders WHERE o_orderstatus <> 'P')"""


@query("flatten_deep", "SELECT r_regionkey AS post_id, 2300 + 10 * r_regionkey AS nodes, 2299 + 10 * r_regionkey AS deepest FROM region")
def flatten_deep(spark, sf_dir):
    """One chain of replies per region, each deeper than the parser of the standard library goes."""
    depth = (2300 + 10 * F.col("r_regionkey")).cast("int")
    opening = '{"kind":"t1","data":{"id":"a","replies":{"data":{"children":['
    payload = F.concat(F.lit('{"data":['), F.repeat(F.lit(opening), depth), F.repeat(F.lit("]}}}}"), depth), F.lit("]}"))
    trees = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("post_id"), payload.alias("payload"))
    flat = tree_nodes(flatten_trees(trees)).groupBy("post_id")
    return flat.agg(F.count("*").cast("int").alias("nodes"), F.max("depth").alias("deepest")).withColumn("post_id", F.col("post_id").cast("int"))


@query("flatten_threads", f"{_ORDERS_SQL} {_COMMENT_SQL}")
def flatten_threads(spark, sf_dir):
    """Flatten and normalize one tree per order."""
    flat = tree_nodes(flatten_trees(order_trees(spark, sf_dir)))
    c = normalize_comments(flat)
    return c.select(
        "post_id", "pos", "comment_id", "parent_id", "parent_kind", "kind", "depth",
        F.array_join("path", ">").alias("path"), "author", "body", "score", "created_iso", "permalink",
        F.array_join("collapsed_children", ",").alias("children"), "collapsed_count",
    )


@query(
    "tree_quarantine",
    """SELECT CAST(o_orderkey AS VARCHAR) AS post_id, 'tree' AS what FROM orders WHERE o_orderstatus = 'P'
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'node' FROM orders WHERE o_orderstatus <> 'P'""",
)
def tree_quarantine(spark, sf_dir):
    """Payloads that are no tree, and nodes that cannot be normalized."""
    return quarantined(flatten_trees(order_trees(spark, sf_dir)))


@query(
    "flatten_chains",
    """SELECT CAST(p_partkey AS VARCHAR) AS post_id, CAST(d AS INTEGER) AS depth, 'n' || d AS comment_id,
         array_to_string(list_transform(range(d), lambda i: 'n' || i), '/') AS path
       FROM part, unnest(range(p_size)) AS t(d)""",
)
def flatten_chains(spark, sf_dir):
    """One reply chain per part, as deep as its size (up to 50 levels)."""

    def wrap(inner, i):
        return _text('{"kind":"t1","data":{"id":"n', i, '","replies":{"data":{"children":[', inner, "]}}}}")

    levels = F.reverse(F.sequence(F.lit(0), F.col("p_size") - 1))
    chain = F.aggregate(levels, F.lit('"end"'), wrap)
    trees = table(spark, sf_dir, "part", spread=True).select(
        F.col("p_partkey").cast("string").alias("post_id"), _text('{"data":[', chain, "]}").alias("payload")
    )
    c = normalize_comments(tree_nodes(flatten_trees(trees)))
    return c.select("post_id", "depth", "comment_id", F.array_join("path", "/").alias("path"))


@query(
    "collapsed_remainder",
    """SELECT CAST(o_orderkey AS VARCHAR) AS post_id, 1 AS placeholders, 2 AS listed_children,
         CASE o_orderpriority WHEN '5-LOW' THEN o_custkey ELSE 2 END AS collapsed_total
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def remainder(spark, sf_dir):
    return collapsed_remainder(normalize_comments(tree_nodes(flatten_trees(order_trees(spark, sf_dir), kinds=PLACEHOLDERS))))


@query(
    "collapsed_ids",
    """SELECT CAST(o_orderkey AS VARCHAR) AS post_id, 'm' || o_orderkey AS child_id FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P'""",
)
def remainder_ids(spark, sf_dir):
    c = normalize_comments(tree_nodes(flatten_trees(order_trees(spark, sf_dir), kinds=PLACEHOLDERS)))
    return collapsed_ids(c).select("post_id", "child_id")


# ----------------------------------------------------------------- rebuild


def conversation_links(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    node = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parent = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    return c.select(
        F.col("conv_id").cast("string").alias("post_id"),
        F.concat(F.lit("t1_"), node).alias("comment_id"),
        F.when(F.col("turn") == 0, F.concat(F.lit("t3_"), F.col("conv_id").cast("string")))
        .otherwise(F.concat(F.lit("t1_"), parent))
        .alias("parent_id"),
    )


@query(
    "rebuild_paths",
    """WITH RECURSIVE t AS (
         SELECT conv_id, turn, 0 AS depth, '' AS path FROM conversations WHERE turn = 0
         UNION ALL
         SELECT c.conv_id, c.turn, t.depth + 1,
                CASE WHEN t.path = '' THEN '' ELSE t.path || '/' END || t.conv_id || '-' || t.turn
         FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1)
       SELECT CAST(conv_id AS VARCHAR) AS post_id, conv_id || '-' || turn AS comment_id, depth, path FROM t""",
)
def rebuild_conversations(spark, sf_dir):
    r = rebuild_paths(conversation_links(spark, sf_dir))
    return r.select("post_id", "comment_id", "depth", F.array_join("path", "/").alias("path"))


def part_links(spark, sf_dir) -> DataFrame:
    """All parts as one thread, three replies per comment."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.lit("all").alias("post_id"),
        k.cast("string").alias("comment_id"),
        F.when(k > 0, F.floor((k - 1) / 3).cast("string")).alias("parent_id"),
    )


_PART_TREE_SQL = """t AS (
     SELECT p_partkey AS k, 0 AS depth, [] :: BIGINT[] AS path FROM part WHERE p_partkey = 0
     UNION ALL SELECT p.p_partkey, t.depth + 1, list_append(t.path, t.k)
     FROM part p JOIN t ON p.p_partkey > 0 AND (p.p_partkey - 1) // 3 = t.k)"""


@query(
    "rebuild_wide_thread",
    f"""WITH RECURSIVE {_PART_TREE_SQL}
        SELECT CAST(k AS VARCHAR) AS comment_id, depth, array_to_string(path, '/') AS path, true AS resolved FROM t""",
)
def rebuild_parts(spark, sf_dir):
    r = rebuild_paths(part_links(spark, sf_dir))
    return r.select("comment_id", "depth", F.array_join("path", "/").alias("path"), "resolved")


@query(
    "subtree",
    f"""WITH RECURSIVE {_PART_TREE_SQL}
        SELECT CAST(k AS VARCHAR) AS comment_id, depth FROM t
        WHERE (k = 1 OR list_contains(path, 1)) AND depth - 1 <= 4
          AND NOT (k > 1 AND (k - 1) % 3 = 2)
          AND len(list_filter(path, lambda a: a > 1 AND (a - 1) % 3 = 2)) = 0""",
)
def part_subtree(spark, sf_dir):
    """Below comment 1: four levels, two replies per comment."""
    links = part_links(spark, sf_dir)
    rebuilt = rebuild_paths(links).drop("resolved")
    comments = links.join(rebuilt, ["post_id", "comment_id"]).withColumn("n", F.col("comment_id").cast("bigint"))
    return subtree(comments, "1", max_depth=4, max_breadth=2, order=["n"]).select("comment_id", "depth")


# ------------------------------------------------------ posts and comments


def _orders_as_posts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")


def _lines_as_comments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("post_id"),
        F.col("l_partkey").cast("string").alias("comment_id"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"),
        F.col("l_linenumber").alias("depth"),
        F.when(F.col("l_returnflag") == "R", "more").otherwise("t1").alias("kind"),
    )


@query(
    "posts_with_comments",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus, CAST(l_partkey AS VARCHAR) AS c_comment_id,
         's' || l_suppkey AS c_author FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
)
def joined_posts(spark, sf_dir):
    joined = posts_with_comments(_orders_as_posts(spark, sf_dir), _lines_as_comments(spark, sf_dir), "left")
    return joined.select("id", "o_orderstatus", "c_comment_id", "c_author")


@query(
    "comment_stats",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, count(l_partkey) FILTER (l_returnflag <> 'R') AS stored_comments,
         max(l_linenumber) AS max_depth, count(DISTINCT l_suppkey) AS authors
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
)
def order_comment_stats(spark, sf_dir):
    return comment_stats(_orders_as_posts(spark, sf_dir), _lines_as_comments(spark, sf_dir)).drop("o_orderstatus")
