import hashlib
import json
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import threadloom.operators.tree as tree_module
from threadloom.operators.integrity import comment_stats, posts_with_comments
from threadloom.operators.normalize import normalize_comments
from threadloom.operators.tree import (
    collapsed_ids,
    collapsed_remainder,
    flatten_trees,
    rebuild_paths,
    subtree,
    tree_errors,
    tree_nodes,
    tree_order,
)


def node(id, *replies, **extra):
    return {"kind": "t1", "data": {"id": id, "replies": {"data": {"children": list(replies)}} if replies else "", **extra}}


def flat(spark, *payloads, **kw):
    rows = [(f"p{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return flatten_trees(spark.createDataFrame(rows, "post_id string, payload string"), **kw)


def shape(df):
    return [
        (json.loads(r.node).get("data", {}).get("id"), r.depth, r.path) for r in tree_order(tree_nodes(df)).collect()
    ]


def test_nesting_and_order(spark):
    tree = {"data": [node("c1", node("c2", node("c3"))), node("c4")]}
    assert shape(flat(spark, tree)) == [("c1", 0, []), ("c2", 1, ["c1"]), ("c3", 2, ["c1", "c2"]), ("c4", 0, [])]


def test_odd_nodes(spark):
    tree = {"data": ["junk", {"kind": "t1"}, node("a", None, 5, node(None, node("t1_b", node("c")))), {"kind": "t1", "data": {"id": "z", "replies": {"data": [1]}}}]}
    assert shape(flat(spark, tree)) == [
        (None, 0, []), ("a", 0, []), (None, 1, ["a"]), ("t1_b", 2, ["a"]), ("c", 3, ["a", "b"]), ("z", 0, [])]


def test_bad_envelopes(spark):
    df = flat(spark, "null", "[]", '{"data":{}}', "{}", "not json", '{"data":[]}')
    assert sorted(r.post_id for r in tree_errors(df).collect()) == ["p0", "p1", "p2", "p3", "p4"]
    assert tree_nodes(df).count() == 0


def test_raw_node_is_verbatim(spark):
    root = node("a", node("b"), extra="é", n=1.0)
    rows = tree_nodes(flat(spark, {"data": [root]}, keep_raw=True)).orderBy("pos").collect()
    assert rows[0].raw == json.dumps(root, ensure_ascii=False)
    assert "replies" not in json.loads(rows[0].node)["data"]


def test_very_deep_thread(spark):
    text = '""'
    for i in reversed(range(1500)):
        text = '{"data":{"children":[{"kind":"t1","data":{"id":"n%d","replies":%s}}]}}' % (i, text)
    payload = '{"data":' + text[len('{"data":{"children":'):-1] + "}"
    payload = payload[:-1]
    nodes = tree_nodes(flat(spark, payload))
    assert nodes.count() == 1500
    last = nodes.orderBy("pos").tail(1)[0]
    assert last.depth == 1499 and len(last.path) == 1499


def test_very_deep_thread_keeps_its_raw_nodes(spark):
    """Nodes whose replies are too deep for the library keep their text, with lists, escapes and numbers as they are."""
    opening = '{"kind": "t1", "data": {"id": "n%d", "body": "\u00e9 \\"q\\"", "n": [1.0, null, true, {}], "replies": {"data": {"children": ['
    levels = 3000
    node_text = "".join(opening % i for i in range(levels)) + "]}}}}" * levels
    starts = [0]
    for i in range(levels - 1):
        starts.append(starts[-1] + len(opening % i))
    want = (node_text[s : len(node_text) - 5 * i] for i, s in enumerate(starts))
    rows = tree_nodes(flat(spark, '{"data": [%s, {"kind": "t1", "data": {"id": "z"}}]}' % node_text, keep_raw=True))
    got = rows.select("pos", F.length("raw").alias("n"), F.sha2("raw", 256).alias("h")).orderBy("pos").collect()
    assert len(got) == levels + 1 and got[-1].n == len('{"kind": "t1", "data": {"id": "z"}}')
    assert [(r.n, r.h) for r in got[:-1]] == [(len(w), hashlib.sha256(w.encode()).hexdigest()) for w in want]


def random_tree(rng, size):
    """Nested payload and the flat rows it must give."""
    children = {None: []}
    for i in range(size):
        parent = rng.choice(list(children))
        children[parent].append(f"n{i}")
        children[f"n{i}"] = []
    rows = []

    def build(name, path):
        rows.append((name, len(path), list(path)))
        return node(name, *[build(c, [*path, name]) for c in children[name]], parent_id=f"t1_{path[-1]}" if path else "t3_p")

    return {"data": [build(c, []) for c in children[None]]}, rows


def test_random_trees_flatten_and_rebuild(spark):
    rng = random.Random(5)
    trees = [random_tree(rng, rng.randint(1, 60)) for _ in range(12)]
    df = flat(spark, *[t for t, _ in trees])
    assert shape(df.filter("post_id = 'p3'")) == trees[3][1]
    comments = normalize_comments(tree_nodes(df)).cache()
    expected = {(f"p{i}", n): (d, p) for i, (_, rows) in enumerate(trees) for n, d, p in rows}
    assert {(r.post_id, r.comment_id): (r.depth, r.path) for r in comments.collect()} == expected
    rebuilt = rebuild_paths(comments.select("post_id", "comment_id", "parent_id"))
    assert {(r.post_id, r.comment_id): (r.depth, r.path) for r in rebuilt.collect()} == expected
    comments.unpersist()


def test_rebuild_marks_cycles_and_keeps_orphans(spark):
    rows = [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "tail", "a"), ("p", "self", "self"),
            ("p", "orphan", "gone"), ("p", "kid", "t1_orphan"), ("p", "root", "t3_p"), ("p", "root", "t3_p")]
    got = {r.comment_id: (r.depth, r.path, r.resolved) for r in
           rebuild_paths(spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string")).collect()}
    assert got["orphan"] == (0, [], True) and got["kid"] == (1, ["orphan"], True) and got["root"] == (0, [], True)
    assert all(got[k] == (None, None, False) for k in ("a", "b", "c", "tail", "self"))
    assert len(got) == 8


@pytest.fixture(scope="module")
def thread(spark):
    tree = {"data": [
        node("a", node("b", node("c", node("d"))), node("e"), node("f", node("g"))),
        node("h"),
        {"kind": "more", "data": {"children": ["x", "y"], "count": 9, "parent_id": "t1_h"}},
    ]}
    return normalize_comments(tree_nodes(flat(spark, tree, {"data": [{"kind": "more", "data": {"children": ["q"]}}]})))


def ids(df):
    return sorted(r.comment_id for r in df.filter("comment_id is not null").collect())


def test_subtree(thread):
    one = thread.filter("post_id = 'p0'")
    assert ids(subtree(one, "t1_b")) == ["b", "c", "d"]
    assert ids(subtree(one, "a", max_depth=1)) == ["a", "b", "e", "f"]
    assert ids(subtree(one, max_depth=0)) == ["a", "h"]
    assert ids(subtree(one, "a", max_breadth=25000)) == ["a", "b", "c", "d", "e", "f", "g"]
    assert [r.comment_id for r in subtree(one, "a", limit=2, order=["pos"]).collect()] == ["a", "b"]
    for bad in ({"limit": 0}, {"limit": 25001}, {"max_depth": -1}, {"max_breadth": True}):
        with pytest.raises(ValueError):
            subtree(one, **bad)


def test_remainders(thread):
    got = {r.post_id: (r.placeholders, r.listed_children, r.collapsed_total) for r in collapsed_remainder(thread).collect()}
    assert got == {"p0": (1, 2, 9), "p1": (1, 1, 1)}
    assert {(r.post_id, r.parent_id, r.child_id) for r in collapsed_ids(thread).collect()} == {
        ("p0", "h", "x"), ("p0", "h", "y"), ("p1", None, "q")}


def test_posts_with_comments(spark, thread):
    posts = spark.createDataFrame([(" p0 ", 1), ("p9", 2), (None, 3)], "id string, n int")
    assert posts_with_comments(posts, thread).count() == 9
    left = posts_with_comments(posts, thread, "left")
    assert left.count() == 11
    assert sorted(r.n for r in left.filter("c_depth is null").collect()) == [2, 3]
    stats = {r.n: (r.stored_comments, r.max_depth) for r in comment_stats(posts, thread).collect()}
    assert stats == {1: (8, 3), 2: (0, None), 3: (0, None)}


def test_walk_runs_without_the_package(tmp_path):
    """Workers of a cluster need not have this package installed."""
    code = cloudpickle.dumps(tree_module._flatten_batches(True))
    script = (
        "import pickle, sys, pyarrow as pa; run = pickle.loads(sys.stdin.buffer.read());"
        "b = pa.RecordBatch.from_pydict({'post_id': ['p'], 'payload': ['{\"data\":[{\"kind\":\"t1\",\"data\":{\"id\":\"a\"}}]}']});"
        "print([r['depth'] for x in run(iter([b])) for r in x.to_pylist()], 'threadloom' in sys.modules)"
    )
    done = subprocess.run([sys.executable, "-c", script], input=code, capture_output=True, cwd=tmp_path, timeout=60)
    assert done.stdout.decode().strip() == "[0] False", done.stderr.decode()


def test_half_surrogates_and_any_depth(spark):
    depth = 3_000
    deep = '{"data":[' + '{"kind":"t1","data":{"id":"a","replies":{"data":{"children":[' * depth + "]}}}}" * depth + "]}"
    odd = '{"data":[{"kind":"t1","data":{"id":"x\\ud83d","body":"half \\ud83d emoji"}}]}'
    trees = spark.createDataFrame([("deep", deep), ("odd", odd), ("bad", deep[:-1])], "post_id string, payload string")
    flat = flatten_trees(trees)
    got = {r.post_id: r for r in flat.groupBy("post_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("error").alias("error"), F.max("node").alias("node")).collect()}
    assert got["deep"].n == depth and got["deep"].depth == depth - 1 and got["deep"].error is None
    assert got["odd"].error is None and "half ? emoji" in got["odd"].node and got["bad"].error is not None


def test_words_that_are_no_json_are_refused_at_every_depth(spark):
    deep = '{"data":' + "[" * 5000 + "NaN" + "]" * 5000 + "}"
    rows = [("flat", '{"data":[NaN]}'), ("deep", deep), ("inf", '{"data":[{"kind":"t1","data":{"id":"a","score":-Infinity}}]}')]
    flat = flatten_trees(spark.createDataFrame(rows, "post_id string, payload string")).collect()
    assert sorted((r.post_id, r.error) for r in flat) == [(p, "not readable: ValueError") for p in ("deep", "flat", "inf")]


def test_quarantine_walks_the_trees_once(spark):
    from threadloom.operators.normalize import quarantined

    trees = spark.createDataFrame(
        [("good", '{"data":[{"kind":"t1","data":{"id":"a"}}]}'), ("node", '{"data":[{"kind":"t1"},{"data":5}]}'), ("tree", '{"data":5}'), ("none", None)],
        "post_id string, payload string",
    )
    found = quarantined(flatten_trees(trees))
    assert sorted(map(tuple, found.collect())) == [("node", "node"), ("node", "node"), ("none", "tree"), ("tree", "tree")]
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_tasks_over_a_large_scan_stay_short(spark, tmp_path, monkeypatch):
    """A scan with a split per core kept one task per core however many rows it had."""
    from threadloom.sources import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(spread, "ROWS_PER_TASK", 10)
    dealt = spread.spread_scan(spark.read.parquet(str(tmp_path / "t")))
    assert dealt.rdd.getNumPartitions() == 100 and dealt.distinct().count() == 1000


def test_only_the_kinds_asked_for_are_written(spark):
    """The remainder needs the placeholders only; every node was written, sent and parsed again for it."""
    more = '{"kind":"more","data":{"children":["x"],"parent_id":"t1_b"}}'
    payload = '{"data":[{"kind":"t1","data":{"id":"a","replies":{"data":{"children":[{"kind":["more"]},%s]}}}},{"kind":"m\\u006fre","data":{}},{"data":"more"}]}' % more
    trees = spark.createDataFrame([("p", payload), ("bad", "{}")], "post_id string, payload string")
    some, everything = flatten_trees(trees, kinds=["more"]), flatten_trees(trees)
    assert sorted((r.pos, r.depth, r.path) for r in some.filter("error is null").collect()) == [(2, 1, ["a"]), (3, 0, [])]
    assert [r.post_id for r in some.filter("error is not null").collect()] == ["bad"]
    wanted = everything.filter("error is null and pos in (2, 3) or error is not null")
    assert sorted(map(str, some.collect())) == sorted(map(str, wanted.collect()))
    with pytest.raises(ValueError):
        flatten_trees(trees, keep_raw=True, kinds=["more"])


def test_writer_of_nodes_is_made_once_and_writes_as_the_library(monkeypatch):
    made = []
    real = tree_module.json.encoder.c_make_encoder
    monkeypatch.setattr(tree_module.json.encoder, "c_make_encoder", lambda *a: made.append(a) or real(*a))
    values = [
        {"a": 1, "b": [True, None, 1.5, -0.0, 1e300, float("inf"), 10**40], "c": {"d": "\u00e9\ud83d\u2028\"\\\n\x00", "": {}}},
        {"é": [], "x": [[{}], "é"]}, [], {}, ["a", 2],
    ]
    for ascii_only in (False, True):
        encoder = tree_module._Encoder(ascii_only)
        texts = [encoder.encode(v) for v in values]
        assert len(made) == 1
        assert texts == [tree_module.json.JSONEncoder(ensure_ascii=ascii_only).encode(v) for v in values]
        assert [encoder.encode(v) for v in ("é", 5, None, 0.1)] == [tree_module.json.dumps(v, ensure_ascii=ascii_only) for v in ("é", 5, None, 0.1)]
        made.clear()
