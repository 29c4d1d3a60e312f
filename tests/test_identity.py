import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators.collections import (
    catalog,
    find_collections,
    first_mismatch,
    free_run_ids,
    migratable,
    resume_gate,
    run_binding,
    safe_summary,
    spec_violations,
    with_identity,
)
from threadloom.operators.progress import comment_progress, ingest_summary
from threadloom.sources.documents import (
    COMMENTS_NAMES,
    POSTS_NAMES,
    check_comments_documents,
    check_posts_documents,
    completed_ids,
    preferred_documents,
    read_comments_progress,
    read_posts_progress,
    scan_documents,
    seen_ids,
    with_collection_name,
)

FILTERS = {"subreddit": "r/Philippines", "title": None, "query": None, "selftext": None, "author": None, "after": "2026-01-01", "before": None}
BLOCK = {"name": "n", "subreddit": "Philippines", "subreddit_norm": "philippines", "after": "2026-01-01", "before": None,
         "after_token": "2026-01-01", "before_token": "open", "title": None, "query": None, "selftext": None, "author": None,
         "sort": "asc", "limit": 25}
REQUEST = {**FILTERS, "sort": "asc"}


def posts_doc(collection=BLOCK, filters=FILTERS, **over):
    pager = {"version": 1, "filters": filters, "sort": "asc", "page_size": 25, "max_posts": None, "cursor": 5, "total_fetched": 2, "seen_ids": ["a", "b"]}
    pager.update({k[6:]: over.pop(k) for k in list(over) if k.startswith("pager_")})
    doc = {"version": 1, "saved_at": "s", "run_id": "r", "paginator": pager, **over}
    return {**doc, "collection": collection} if collection is not None else doc


def compare(spark, doc, request, check):
    schema = "value string, " + ", ".join(f"{k} string" for k in REQUEST)
    row = (json.dumps(doc), *[{**REQUEST, **request}[k] for k in REQUEST])
    df = spark.createDataFrame([row], schema).select("value", F.struct(*REQUEST).alias("request"))
    read = read_posts_progress(check_posts_documents(df))
    pairs = read.select("request", F.struct("pager_version", "pager_sort", "filters", "collection").alias("stored"))
    return pairs.select(check(pairs)).first()[0]


MISMATCHES = [
    ({}, None), ({"subreddit": "philippines"}, None), ({"subreddit": "other"}, "subreddit"),
    ({"after": "2026-01-01T09:00:00"}, None), ({"after": "2026-01-02"}, "after"), ({"before": "2026-01-02"}, "before"),
    ({"title": "x"}, "title"), ({"query": "x", "author": "y"}, "query"), ({"selftext": "x"}, "selftext"), ({"author": "x"}, "author"),
    ({"sort": "desc"}, "sort"), ({"after": "x", "subreddit": "other"}, "subreddit"),
]


@pytest.mark.parametrize("collection", [BLOCK, None], ids=["block", "filters"])
def test_first_mismatch(spark, collection):
    for request, want in MISMATCHES:
        assert compare(spark, posts_doc(collection), request, first_mismatch) == want, request


def test_missing_key_in_block_is_equal_but_null_is_not(spark):
    without = {k: v for k, v in BLOCK.items() if k not in ("title", "after_token", "subreddit_norm")}
    assert compare(spark, posts_doc(without), {"title": "x", "after": "2000-01-01"}, first_mismatch) is None
    assert compare(spark, posts_doc(BLOCK), {"title": "x"}, first_mismatch) == "title"


def test_resume_gate_wants_the_stored_spelling(spark):
    gate = lambda pairs: resume_gate()
    assert compare(spark, posts_doc(), {}, gate) is None
    assert compare(spark, posts_doc(), {"subreddit": "Philippines"}, gate) == "filters"
    assert compare(spark, posts_doc(), {"sort": "desc", "subreddit": "x"}, gate) == "sort"
    assert compare(spark, posts_doc(pager_version=2), {"sort": "desc"}, gate) == "version"
    short = {k: v for k, v in FILTERS.items() if k != "author"}
    assert compare(spark, posts_doc(filters=short), {}, gate) == "filters"


def errors_of(spark, check, *docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return [r.errors for r in check(spark.createDataFrame(rows, "i int, value string")).orderBy("i").collect()]


def test_posts_document_checks(spark):
    got = errors_of(
        spark, check_posts_documents, posts_doc(), posts_doc(None, run_id=None), "[]", "{",
        posts_doc(version=2, run_id=" ", pager_filters=[], pager_sort=1, pager_cursor=True, pager_total_fetched=2.0, pager_seen_ids=["a", 1]),
        posts_doc(version="1", paginator=5), posts_doc({"name": " "}), posts_doc([1]), posts_doc(pager_total_fetched=-1, pager_seen_ids=None),
    )
    assert got[0] == got[1] == [] and got[2] == got[3] == ["not a JSON object"]
    assert len(got[4]) == 7
    assert got[5] == ["version: 1", "paginator: object"]
    assert got[6] == ["collection.name: non-empty text", "collection.subreddit: non-empty text"]
    assert got[7] == ["collection: object or null"]
    assert len(got[8]) == 2


def comments_doc(**state):
    return {"version": 1, "saved_at": "s", "run_id": "r", "comments": {"completed_post_ids": ["a"], "posts_completed": 1, **state}}


def test_comments_document_checks(spark):
    got = errors_of(
        spark, check_comments_documents, comments_doc(), comments_doc(posts_completed=True, comments_collected=-1, completed_post_ids=[1]),
        {"version": 1, "run_id": None}, {**comments_doc(), "version": 3},
    )
    assert got[0] == [] and len(got[1]) == 3
    assert got[2] == ["run_id: non-empty text", "comments: object"]
    assert got[3] == ["version: 1"]


def test_documents_on_disk(spark, tmp_path):
    def put(folder, name, doc):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=2))

    put("a", "posts-checkpoint.json", posts_doc(pager_total_fetched=9))
    put("a", "checkpoint.json", posts_doc(None, run_id="old"))
    put("b", "checkpoint.json", posts_doc(None, run_id="only"))
    put("c", "posts-checkpoint.json", "{")
    put("a", "comments-checkpoint.json", comments_doc(completed_post_ids=["a", "b"]))
    put("a", "other.json", "{}")
    posts = check_posts_documents(scan_documents(spark, str(tmp_path), POSTS_NAMES))
    got = {r.folder.rsplit("/", 1)[1]: r for r in read_posts_progress(posts).collect()}
    assert got["a"].total_fetched == 9 and got["b"].run_id == "only" and "c" not in got
    assert posts.filter(F.size("errors") > 0).count() == 1
    assert sorted(r.id for r in seen_ids(posts).filter("run_id = 'r'").collect()) == ["a", "b"]
    comments = check_comments_documents(scan_documents(spark, str(tmp_path), COMMENTS_NAMES))
    (c,) = read_comments_progress(comments).collect()
    assert (c.posts_completed, c.posts_skipped_empty, c.comments_collected) == (1, 0, 0)
    assert completed_ids(comments).count() == 2
    (tmp_path / "checkpoint.json").write_text(json.dumps(posts_doc(None)))
    named = with_collection_name(scan_documents(spark, str(tmp_path), POSTS_NAMES), str(tmp_path))
    assert {r.name: r.legacy for r in named.collect()} == {"legacy": True, "a": False, "b": False, "c": False}
    picked = preferred_documents(spark.createDataFrame([("f", "b", "2"), ("f", "a", "1"), ("f", "z", "3")], "folder string, file string, value string"), ("a", "b"))
    assert [(r.file, r.value) for r in picked.collect()] == [("a", "1")]


def test_lookup(spark):
    saved = spark.createDataFrame([("Phil",), ("PHIL",), ("Solo",), ("Solo",)], "name string")
    wanted = spark.createDataFrame([("Phil",), ("phil",), ("solo",), ("none",)], "wanted string")
    assert {r.wanted: r.found for r in find_collections(wanted, saved).collect()} == {"Phil": "Phil", "phil": None, "solo": "Solo", "none": None}


def test_binding_and_migration(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, run_id string")
    c = spark.createDataFrame([("a", "1"), ("b", "9")], "name string, run_id string")
    assert [r.name for r in run_binding(p, c).collect()] == ["b"]
    old = spark.createDataFrame(
        [("ok", None, "1", "1"), ("posts only", None, "1", None), ("bad", "after", "1", "1"), ("mixed", None, "1", "2"), ("there", None, "1", "1")],
        "name string, mismatch string, posts_run string, comments_run string")
    assert sorted(r.name for r in migratable(old, spark.createDataFrame([("there",)], "name string")).collect()) == ["ok", "posts only"]


def test_free_run_ids(spark):
    taken = spark.createDataFrame([("x",), ("x-2",), ("x-3",), ("y",), ("y-3",), ("z-2",), ("w-9",), ("w-9-2",)], "run_id string")
    want = spark.createDataFrame([("X",), ("y",), ("z",), ("new one",), ("w-9",)], "run_id string")
    assert {r.base: r.run_id for r in free_run_ids(want, taken).collect()} == {
        "x": "x-4", "y": "y-2", "z": "z", "new_one": "new_one", "w-9": "w-9-3"}


def test_catalog_statuses(spark):
    p = spark.createDataFrame(
        [("done", None, "r", "s", 10, 10), ("open", None, "r", "s", 9, 10), ("uncapped", None, "r", "s", 9, None), ("broken", "bad", None, None, None, None)],
        "name string, error string, run_id string, saved_at string, total_fetched bigint, max_posts bigint")
    c = spark.createDataFrame([("done", None, 1, 0, 5), ("only", None, 1, 0, 5), ("hurt", "bad", None, None, None)],
                              "name string, error string, posts_completed bigint, posts_skipped_empty bigint, comments_collected bigint")
    got = {r.name: r for r in catalog(p, c).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "done": "complete", "open": "in_progress", "uncapped": "in_progress", "broken": "error", "only": "comments_only", "hurt": "empty"}
    assert got["hurt"].comments_error == "bad" and got["done"].has_comments


def test_comment_progress(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string")
    posts = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "run_id string, id string")
    comments = spark.createDataFrame([("a", "1"), ("c", "1"), ("c", "1"), ("c", None)], "run_id string, post_id string")
    noted = spark.createDataFrame([("a", 1, 1, 5), ("b", 0, 0, None)], "run_id string, posts_completed bigint, posts_skipped_empty bigint, comments_collected bigint")
    got = {r.run_id: (r.status, r.posts_completed, r.comments_collected, r.posts_considered) for r in comment_progress(runs, posts, comments, noted).collect()}
    assert got == {"a": ("complete", 1, 5, 2), "b": ("in_progress", 0, 0, 1), "c": ("unknown", 1, 3, 1), "d": ("not_started", 0, 0, 0)}


def test_ingest_summary(spark):
    rows = [("r", 1, 5, False), ("r", 2, 3, False), ("r", 2, 4, True)]
    (s,) = ingest_summary(spark.createDataFrame(rows, "run_id string, session int, rows bigint, stopped boolean")).collect()
    assert (s.pages, s.posts_this_run, s.total_posts, s.stopped) == (2, 7, 12, True)


def test_identity_columns(spark):
    specs = spark.createDataFrame([("r/Philippines", "2026-01-01", "2026-06-30", "k")], "subreddit string, after string, before string, api_key string")
    r = with_identity(specs).first()
    assert r.name == "Philippines-2026-01-01-2026-06-30" and r.subreddit_norm == "philippines"
    assert safe_summary(specs).columns == ["subreddit", "after", "before"]
    wide = specs.select("subreddit", F.struct(F.lit("r").alias("raw_dir"), F.lit("s").alias("api_key")).alias("output"))
    assert safe_summary(wide).first().asDict(recursive=True)["output"] == {"raw_dir": "r"}
    assert safe_summary(specs.select("subreddit", F.lit("text").alias("output"))).columns == ["subreddit"]


def test_spec_sections_and_texts(spark):
    """A section that is no object, and text that is not exactly one object."""
    sections = ("api", "output", "collection", "comments", "logging")
    values = [5, None, "text", [], [{"level": "loud"}], True]
    cases = {json.dumps({"subreddit": "a", s: v}): [f"{s}: object"] for s in sections for v in values}
    texts = ['{"subreddit":"a"} x', '{"subreddit":"a"}{"subreddit":"b"}', "[]", "", "5", '{"subreddit":', None]
    cases |= dict.fromkeys(texts, ["not a JSON object"])
    rows = spec_violations(spark.createDataFrame([(v,) for v in cases], "value string")).collect()
    assert {r.value: r.errors for r in rows} == cases


def test_spec_checks(spark):
    def errors(**spec):
        base = {"subreddit": "py", **spec}
        df = spark.createDataFrame([(json.dumps({k: v for k, v in base.items() if v != "__none"}),)], "value string")
        return spec_violations(df).first().errors

    assert errors() == [] and errors(limit=100, sort="desc", max_posts=None, after=1577836800.5, before="2020-01-01T00:00:00", title="x") == []
    assert len(errors(subreddit=" ", limit=500, sort="new")) == 3
    assert errors(subreddit="__none") == ["subreddit: non-empty text"]
    for bad in ({"limit": None}, {"limit": 0}, {"limit": 5.0}, {"sort": None}, {"max_posts": 0}, {"title": " "}, {"query": 5}, {"author": ""},
                {"after": True}, {"before": " "}, {"after": []}, {"api": {"base_url": "ftp://x"}}, {"api": {"base_url": " "}},
                {"output": {"raw_dir": 5}}, {"output": {"chunk_size": 0}}, {"collection": {"throttle_qps": True}}, {"collection": {"max_retries": -1}},
                {"comments": {"tree_limit": 25001}}, {"comments": {"max_comment_posts": 0}}, {"comments": {"skip_empty_posts": 1}},
                {"logging": {"level": "loud"}}, {"logging": {"file": ""}}):
        assert len(errors(**bad)) == 1, bad
    assert errors(output={"chunk_size": None}, comments={"max_comment_posts": None}, logging={"level": "info"}) == []
