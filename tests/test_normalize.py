import json

import pytest

from threadloom.operators.normalize import normalize_comments, normalize_posts, project_fields, unusable_nodes
from threadloom.operators.tree import flatten_trees, tree_nodes
from threadloom.schemas import COMMENT_FIELDS, POST_FIELDS

POST = {
    "id": "abc123", "subreddit": "python", "title": "Hi", "selftext": "b", "author": "me", "author_fullname": "t2_x",
    "score": 5, "num_comments": 2, "created_utc": 1577836800, "url": "http://u", "retrieved_on": 1,
}


def posts(spark, *records, **kw):
    lines = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    return [r.asDict() for r in normalize_posts(spark.createDataFrame(lines, "value string").coalesce(1), **kw).collect()]


def test_full_post(spark):
    (p,) = posts(spark, POST)
    assert tuple(p) == POST_FIELDS
    assert p == {
        "id": "abc123", "subreddit": "python", "title": "Hi", "selftext": "b", "author": "me", "score": 5,
        "num_comments": 2, "created_utc": 1577836800.0, "created_iso": "2020-01-01T00:00:00+00:00", "url": "http://u",
        "permalink": "https://www.reddit.com/r/python/comments/abc123/",
    }


def test_id_is_kept_as_it_is(spark):
    p = posts(spark, {**POST, "id": "t3_ABC_x9"})[0]
    assert p["id"] == "t3_ABC_x9" and p["permalink"].endswith("/t3_ABC_x9/")


def test_sparse_and_null(spark):
    for record in ({"id": "x"}, {**dict.fromkeys(POST), "id": "x"}):
        p = posts(spark, record)[0]
        assert p.pop("id") == "x" and set(p.values()) == {None}


def test_permalink_forms(spark):
    links = [" /r/a/1 ", "r/a/1", "https://x.org/1", "", None, 5]
    got = [posts(spark, {**POST, "permalink": link})[0]["permalink"] for link in links]
    base = "https://www.reddit.com"
    built = f"{base}/r/python/comments/abc123/"
    assert got == [f"{base}/r/a/1", f"{base}/r/a/1", "https://x.org/1", built, built, built]
    assert posts(spark, {"id": "a", "permalink": "/z"}, site_base="http://s")[0]["permalink"] == "http://s/z"


def test_repeated_key_keeps_the_last(spark):
    assert posts(spark, '{"id":"a","id":"b","score":1,"score":2}')[0]["score"] == 2


def test_unusable_lines(spark):
    bad = ["[1]", "nonsense", '{"id":"a"} x', '{"id":"a"},{"id":"b"}', "null", ""]
    assert [p["id"] for p in posts(spark, POST, *bad, on_error="drop")] == ["abc123"]
    assert len(posts(spark, POST, *bad, on_error="null")) == 7
    for line in bad:
        with pytest.raises(Exception, match="record is not one JSON object"):
            posts(spark, line)


def comment_rows(spark, payload, post_id="post1"):
    df = spark.createDataFrame([(post_id, json.dumps(payload))], "post_id string, payload string")
    flat = tree_nodes(flatten_trees(df))
    return [r.asDict() for r in normalize_comments(flat).orderBy("pos").drop("pos", "ords", "raw").collect()], flat


def node(**data):
    return {"kind": data.pop("kind", "t1"), "data": data}


def test_reply_and_top_level(spark):
    rows, _ = comment_rows(spark, {"data": [
        node(id="c1", parent_id="t3_post1", subreddit="py", body="x", score=3, created_utc=1577836800, replies={
            "data": {"children": [node(id="t1_c2", parent_id="t1_c1", author="me", permalink="/r/py/c2")]}}),
    ]})
    assert tuple(rows[0]) == COMMENT_FIELDS
    top, reply = rows
    assert (top["comment_id"], top["parent_id"], top["parent_kind"], top["depth"], top["path"]) == ("c1", "post1", "post", 0, [])
    assert top["permalink"] == "https://www.reddit.com/r/py/comments/post1/_/c1/"
    assert (reply["comment_id"], reply["parent_id"], reply["parent_kind"], reply["depth"], reply["path"]) == (
        "t1_c2", "c1", "comment", 1, ["c1"])
    assert reply["permalink"] == "https://www.reddit.com/r/py/c2"
    assert reply["collapsed_children"] == [] and reply["collapsed_count"] is None


def test_parent_equal_to_post_is_post(spark):
    rows, _ = comment_rows(spark, {"data": [node(id="a", parent_id="post1"), node(id="b", parent_id="other"), node(id="c", parent_id=5)]})
    assert [r["parent_kind"] for r in rows] == ["post", "unknown", None]


def test_placeholders(spark):
    rows, _ = comment_rows(spark, {"data": [
        node(kind="more", children=["a", " ", "b", 5], count=7, subreddit="s"),
        node(kind="more", children=["a", "b"], count=True),
        node(kind="more", children="x", count=2.0),
    ]})
    assert [(r["comment_id"], r["collapsed_children"], r["collapsed_count"], r["permalink"]) for r in rows] == [
        (None, ["a", "b", "5"], 7, None), (None, ["a", "b"], 2, None), (None, [], 0, None)]


def test_null_fields(spark):
    rows, _ = comment_rows(spark, {"data": [node(id=None, body=None, author=None, score="9", created_utc="5", parent_id=None)]})
    r = rows[0]
    assert [r[k] for k in ("comment_id", "body", "author", "score", "created_iso", "parent_id", "parent_kind", "permalink")] == [None] * 8


def test_node_without_data_is_set_aside(spark):
    rows, flat = comment_rows(spark, {"data": [node(id="a"), {"kind": "t1"}, {"kind": "t1", "data": []}]})
    assert [r["comment_id"] for r in rows] == ["a"]
    assert unusable_nodes(flat).count() == 2


def test_field_projection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert project_fields(df, "a, ,c").columns == ["a", "c"]
    assert project_fields(df, ["b", " "]).columns == ["b"]
    assert project_fields(df, " ").columns == project_fields(df, None).columns == ["a", "b", "c"]
