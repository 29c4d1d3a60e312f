import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators.integrity import layer_agreement
from threadloom.operators.logs import log_progress
from threadloom.operators.progress import pending_posts
from threadloom.sources.store import Store
from threadloom.operators.collections import migratable
from threadloom.streaming.collection import CollectionError, copy_old_progress, current, reset, resume, start
from threadloom.streaming import ingest
from threadloom.streaming.arrival import known_arrivals
from threadloom.streaming.ingest import (
    IngestResult,
    ingest_batches,
    ingest_both,
    ingest_comments,
    ingest_logs,
    ingest_posts,
    ingest_posts_stateful,
)


class Site:
    """A folder where pages and trees land, with a store next to it."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.store = Store(spark, str(root / "store"), chunk_size=50)
        self.pages = 0

    def land(self, *ids, folder="pages"):
        self.pages += 1
        (self.root / folder).mkdir(exist_ok=True)
        posts = [{"id": i, "created_utc": n, "subreddit": "s", "page": self.pages} for n, i in enumerate(ids)]
        (self.root / folder / f"page-{self.pages:04d}.json").write_text(json.dumps({"data": posts}, indent=1))

    def ingest(self, run="r", **kw):
        return ingest_posts(self.store, str(self.root / "pages"), run, str(self.root / f"progress-{run}"), files_per_batch=1, **kw)

    def ids(self, run="r"):
        return sorted(str(r.id) for r in self.store.read("posts", run).collect())

    def agree(self):
        raw = self.store.read("raw_posts").select(F.get_json_object("value", "$.id").alias("id"))
        return layer_agreement(raw, self.store.read("posts")).first()


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def test_pages_overlap_and_resume(site):
    site.land("a", "b")
    site.land("b", "c", None, None)
    assert site.ingest().batches == 2
    assert site.ids() == ["None", "None", "a", "b", "c"]
    assert site.ingest().batches == 0
    site.land("c", " a ", "d")
    assert site.ingest().batches == 1
    assert site.ids() == ["None", "None", "a", "b", "c", "d"]
    check = site.agree()
    assert check.counts_agree and check.ids_agree and check.ids_unique
    assert sorted((r.batch_id, r.rows) for r in ingest_batches(site.store, "r").collect()) == [(0, 2), (1, 3), (2, 1)]


def test_crash_between_the_two_writes(site, monkeypatch):
    from threadloom.sources import store as store_module

    site.land("a", "b")
    site.land("b", "c")
    real = Store.write_batch

    def dies(self, table, df, run_id, batch_id):
        if table == "posts" and batch_id == 1:
            raise RuntimeError("executor gone")
        return real(self, table, df, run_id, batch_id)

    monkeypatch.setattr(store_module.Store, "write_batch", dies)
    with pytest.raises(Exception, match="executor gone"):
        site.ingest()
    # Raw rows of the batch are written, but not committed: both layers show the batch before.
    assert site.agree().raw_total == 2 and site.ids() == ["a", "b"]
    monkeypatch.setattr(store_module.Store, "write_batch", real)
    site.ingest()
    assert site.ids() == ["a", "b", "c"]
    check = site.agree()
    assert check.counts_agree and check.ids_unique


def dies_after_commit(monkeypatch):
    """The store has the batch, the stream's checkpoint has not."""
    real = Store.commit

    def dies(*args):
        real(*args)
        raise RuntimeError("driver gone")

    monkeypatch.setattr(Store, "commit", dies)
    return lambda: monkeypatch.setattr(Store, "commit", real)


def test_crash_after_the_writes(site, monkeypatch):
    """The batch is stored but never committed by the stream; its replay must not see itself as known."""
    site.land("a", "b")
    mend = dies_after_commit(monkeypatch)
    with pytest.raises(Exception, match="driver gone"):
        site.ingest()
    assert site.ids() == ["a", "b"]
    mend()
    site.land("b", "c")
    site.ingest()
    assert site.ids() == ["a", "b", "c"] and site.agree().ids_unique


def test_replay_that_shrinks(site, monkeypatch):
    """A batch dies between its layers, and its replay has fewer posts, or none in a table that had some."""
    from threadloom.streaming import ingest as ingest_module

    site.land("a", "b")
    site.ingest()
    site.land("b", "c", "d", "e")
    (site.root / "pages" / "page-0003.json").write_text("torn")
    real, cut = Store.write_batch, ingest_module.unseen

    def dies(self, table, df, run_id, batch_id):
        if table == "posts":
            raise RuntimeError("executor gone")
        return real(self, table, df, run_id, batch_id)

    monkeypatch.setattr(Store, "write_batch", dies)
    with pytest.raises(Exception, match="executor gone"):
        site.ingest()
    monkeypatch.setattr(Store, "write_batch", real)
    # Other known ids by now: the same batch finds less that is new.
    monkeypatch.setattr(ingest_module, "unseen", lambda *args: cut(*args).filter("id <> 'd'"))
    site.ingest()
    check = site.agree()
    assert site.ids() == ["a", "b", "c", "e"] and check.counts_agree and check.ids_agree and check.raw_total == 4
    assert site.store.read("page_errors", "r").count() == 1


def test_a_committed_batch_is_replaced_as_a_whole(site):
    store = site.store
    rows = lambda *ids: site.spark.createDataFrame([(i,) for i in ids], "post_id string")
    errors = site.spark.createDataFrame([("b", "no tree")], "post_id string, error string")
    for ids, bad in ((("a", "b"), errors), (("a",), errors.limit(0)), ((), errors.limit(0)), (("c",), errors)):
        store.begin("comments", "r=1/x", 0)
        store.write_batch("done_posts", rows(*ids), "r=1/x", 0)
        store.write_batch("tree_errors", bad, "r=1/x", 0)
        store.commit("comments", "r=1/x", 0)
        assert sorted(r.post_id for r in store.read("done_posts", "r=1/x").collect()) == sorted(ids)
        assert store.read("tree_errors", "r=1/x").count() == bad.count()
    store.begin("comments", "r=1/x", 1)
    store.write_batch("done_posts", rows("lost"), "r=1/x", 1)
    again = Store(site.spark, store.root)
    files = lambda: sorted((site.root / "store" / "done_posts").rglob("*.parquet"))
    before = len(files())
    again.compact()
    assert [r.post_id for r in again.read("done_posts").collect()] == ["c"] and len(files()) < before
    assert len(list((site.root / "store" / "commits").glob("*.json"))) == 1
    again.begin("comments", "r=1/x", 1)
    again.write_batch("done_posts", rows("d"), "r=1/x", 1)
    again.commit("comments", "r=1/x", 1)
    assert sorted(r.post_id for r in again.read("done_posts").collect()) == ["c", "d"]


def test_stop_between_batches_and_resume(site):
    for ids in ("ab", "cd", "ef"):
        site.land(*ids)
    result = site.ingest(should_stop=lambda: True)
    assert (result.batches, result.stopped) == (1, True)
    assert site.ids() == ["a", "b"]
    result = site.ingest()
    assert (result.batches, result.stopped) == (2, False)
    assert site.ids() == list("abcdef")


def test_cap_and_raised_cap(site):
    """Posts cut off by a cap are not known, so a higher cap later still gets them when they land again."""
    site.land("a", "b", "c")
    site.land("d")
    site.ingest(max_posts=2)
    assert site.ids() == ["a", "b"]
    site.land("b", "c", "d", "e")
    site.ingest(max_posts=4)
    assert site.ids() == ["a", "b", "c", "d"]


def test_runs_do_not_share_known_ids(site):
    site.land("a")
    site.ingest("one")
    site.ingest("two")
    assert site.ids("one") == site.ids("two") == ["a"]


def test_pages_that_are_no_pages_are_kept_apart(site):
    """A consumed file is not read again, so its text must not be lost; the pages around it are stored."""
    site.land("a")
    bad = {"bad1.json": '{"data": {}}', "bad2.json": '{"data": [{"id": "x"}', "bad3.json": "<html>", "bad4.json": '{"data": []} more'}
    for name, text in bad.items():
        (site.root / "pages" / name).write_text(text)
    site.land("b")
    assert site.ingest().batches == 6 and site.ids() == ["a", "b"]
    assert {r.page: r.payload for r in site.store.read("page_errors").collect()} == bad


def test_tree_lines_that_are_no_lines_are_kept_apart(site):
    (site.root / "trees").mkdir()
    good = json.dumps({"post_id": "p", "payload": tree("c")})
    lines = [good, good[:20], json.dumps({"payload": tree("d")}), json.dumps({"post_id": "q"}), "", "[1]"]
    (site.root / "trees" / "t.json").write_text("\n".join(lines))
    ingest_comments(site.store, str(site.root / "trees"), "r", str(site.root / "c"))
    assert sorted(r.value for r in site.store.read("line_errors").collect()) == sorted([*lines[1:4], lines[5]])
    assert [r.post_id for r in site.store.read("done_posts").collect()] == ["p"]
    assert [r.comment_id for r in site.store.read("comments").collect()] == ["c"]


def stateful(site, **kw):
    return ingest_posts_stateful(site.store, str(site.root / "pages"), "r", str(site.root / "p"), **{"files_per_batch": 1, **kw})


def test_tree_lines_are_read_once_for_all_tables(site, monkeypatch):
    read = site.spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(value):
        read.add(1)
        return True

    real = ingest.with_object
    monkeypatch.setattr(ingest, "with_object", lambda df, *rest: real(df.filter(counted("value")), *rest))
    good = [json.dumps({"post_id": f"p{i}", "payload": json.dumps({"data": [{"kind": "t1", "data": {"id": f"c{i}"}}]})}) for i in range(3)]
    (site.root / "trees").mkdir()
    (site.root / "trees" / "a.jsonl").write_text("\n".join([*good, '{"post_id": "p9"', '{"payload": "x"}']))
    wanted = site.spark.createDataFrame([("p0",), ("p1",)], "id string")
    ingest_comments(site.store, str(site.root / "trees"), "r", str(site.root / "c"), wanted=wanted)
    errors = {(r.value, r.error) for r in site.store.read("line_errors").collect()}
    assert errors == {('{"post_id": "p9"', "not one JSON object"), ('{"payload": "x"}', "no post id or no payload")}
    assert sorted(r.post_id for r in site.store.read("done_posts").collect()) == ["p0", "p1"]
    assert sorted(r.comment_id for r in site.store.read("comments").collect()) == ["c0", "c1"]
    assert read.value == 5


def test_tables_not_yet_written_cost_no_task(site):
    ids = site.spark.range(5).select(F.col("id").cast("string").alias("post_id"))
    for none in (site.store.read("done_posts", "r"), site.store.events().select(F.col("run_id").alias("post_id"))):
        left = ids.join(none, "post_id", "left_anti")
        assert left.count() == 5
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "LogicalRDD" not in plan


def test_stateful_dedup(site):
    site.land("a", "b", None, None)
    site.land("b", "c", None)
    stateful(site)
    site.land("c", "a", "d")
    stateful(site)
    assert site.ids() == ["None"] * 3 + ["a", "b", "c", "d"]
    check = site.agree()
    assert check.counts_agree and check.ids_agree
    known = known_arrivals(site.spark, str(site.root / "p")).collect()
    assert {(r.id, r.page) for r in known} == {(i, f"page-{n:04d}.json") for i, n in (("a", 1), ("b", 1), ("c", 2), ("d", 3))}


def kept(site):
    rows = site.store.read("posts", "r").select("id", "page", "created_utc").collect()
    return {r.id: (r.page, r.created_utc) for r in rows}


def test_first_of_differing_copies_is_kept(site):
    """Copies differ inside a page, inside a batch and between batches."""
    site.land("a", "b", "a")
    site.land("b", "c", "c")
    site.land("c", "d")
    stateful(site, files_per_batch=2)
    site.land("d", "e")
    stateful(site)
    want = {"a": (1, 0), "b": (1, 1), "c": (2, 1), "d": (3, 1), "e": (4, 1)}
    assert kept(site) == {i: (f"page-{n:04d}.json", float(t)) for i, (n, t) in want.items()}


def test_pages_in_lines_keep_their_order(site):
    page = lambda *posts: json.dumps({"data": [{"id": i, "created_utc": t} for i, t in posts]})
    (site.root / "pages").mkdir()
    lines = [page(("x", n), (f"y{n}", n)) for n in range(300)]
    (site.root / "pages" / "b.json").write_text("\n".join(["no page", "", *lines]))
    (site.root / "pages" / "a.json").write_text(page(("y7", -1)))
    stateful(site, files_per_batch=None, page_per_line=True)
    found = kept(site)
    assert found["x"] == ("b.json", 0.0) and found["y7"] == ("a.json", -1.0) and len(found) == 301
    bad = site.store.read("page_errors", "r").collect()
    assert [(r.page, r.payload, r.page_error) for r in bad] == [("b.json", "no page", "not exactly one JSON object")]


def test_stateful_cap_stop_and_raised_cap(site):
    """The batch that goes beyond the cap stays open: with a higher cap, what was cut off comes without landing again."""
    for ids in ("ab", "bcd", "ef"):
        site.land(*ids)
    assert stateful(site, should_stop=lambda: True) == IngestResult(1, True)
    assert site.ids() == ["a", "b"]
    assert stateful(site, max_posts=3) == IngestResult(0, False, True)
    assert site.ids() == ["a", "b", "c"]
    assert stateful(site, max_posts=3).capped and site.ids() == ["a", "b", "c"]
    assert stateful(site, max_posts=5) == IngestResult(1, False, True)
    assert site.ids() == ["a", "b", "c", "d", "e"]
    assert stateful(site) == IngestResult(1, False)
    assert site.ids() == list("abcdef") and site.agree().ids_unique


def test_stateful_crash_after_the_writes(site, monkeypatch):
    site.land("a", "b")
    mend = dies_after_commit(monkeypatch)
    with pytest.raises(Exception, match="driver gone"):
        stateful(site)
    assert site.ids() == ["a", "b"]
    mend()
    site.land("b", "c")
    stateful(site)
    assert site.ids() == ["a", "b", "c"] and site.agree().ids_unique


def test_stateful_batches_read_nothing_that_is_stored(site, monkeypatch):
    """So the cost of a batch does not follow the stored total."""
    from threadloom.streaming.arrival import STATE_CONF

    for n in range(12):
        site.land(f"{n}", f"{n + 1}", f"own{n}")
    reads, real = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, *args: reads.append(args) or real(self, *args))
    before = {k: site.spark.conf.get(k, None) for k in STATE_CONF}
    assert stateful(site).batches == 12 and reads == []
    assert stateful(site, max_posts=1).batches == 0 and {k: site.spark.conf.get(k, None) for k in STATE_CONF} == before
    assert len(site.ids()) == 25


def tree(*ids):
    return json.dumps({"data": [{"kind": "t1", "data": {"id": i, "body": "x"}} for i in ids]})


def land_trees(site, name, **trees):
    (site.root / "trees").mkdir(exist_ok=True)
    lines = [json.dumps({"post_id": p, "payload": t}) for p, t in trees.items()]
    (site.root / "trees" / f"{name}.json").write_text("\n".join(lines))


def comments(site, **kw):
    return ingest_comments(site.store, str(site.root / "trees"), "r", str(site.root / "progress-c"), files_per_batch=1, **kw)


def stored_comments(site):
    return sorted((r.post_id, r.comment_id) for r in site.store.read("comments", "r").collect())


def test_comments_once_per_post(site):
    land_trees(site, "t1", p1=tree("a", "b"), p2=tree(), bad='{"data": 5}')
    land_trees(site, "t2", p1=tree("z"), p3=tree("c"))
    comments(site)
    assert stored_comments(site) == [("p1", "a"), ("p1", "b"), ("p3", "c")]
    assert sorted(r.post_id for r in site.store.read("done_posts").collect()) == ["p1", "p2", "p3"]
    assert [r.post_id for r in site.store.read("tree_errors").collect()] == ["bad"]
    assert site.store.read("raw_comments").count() == 3
    land_trees(site, "t3", bad=tree("d"))
    comments(site)
    assert ("bad", "d") in stored_comments(site)


def test_comments_only_for_wanted_posts(site, spark):
    posts = spark.createDataFrame([("p1", 1), ("p2", 0), ("p3", 4)], "id string, num_comments bigint")
    wanted = pending_posts(posts, site.store.read("done_posts"), ["id"])
    land_trees(site, "t1", p1=tree("a"), p2=tree("b"), other=tree("c"))
    comments(site, wanted=wanted)
    assert stored_comments(site) == [("p1", "a")]


def test_comment_batch_replays_whole(site, monkeypatch):
    """Comments written, completion not: the post must be written again, once."""
    land_trees(site, "t1", p1=tree("a", "b"))
    real = Store.write_batch

    def dies(self, table, df, run_id, batch_id):
        if table == "done_posts":
            raise RuntimeError("gone")
        return real(self, table, df, run_id, batch_id)

    monkeypatch.setattr(Store, "write_batch", dies)
    with pytest.raises(Exception, match="gone"):
        comments(site)
    monkeypatch.setattr(Store, "write_batch", real)
    comments(site)
    assert stored_comments(site) == [("p1", "a"), ("p1", "b")]


def test_two_phases(site):
    site.land("p1")
    site.land("p2")
    land_trees(site, "t1", p1=tree("a"))
    first, second = ingest_both(lambda: site.ingest(should_stop=lambda: True), lambda: comments(site))
    assert first.stopped and second is None
    first, second = ingest_both(site.ingest, lambda: comments(site))
    assert not first.stopped and second.batches == 1


def test_live_log_progress(site):
    folder = site.root / "logs"
    folder.mkdir()
    line = "2026-01-01 10:00:0{0} | INFO     | x.paginator | Page {0}: 5 new posts ({1} total)\n"
    (folder / "1.log").write_text(line.format(1, 5) + line.format(2, 10))
    go = lambda: ingest_logs(site.store, str(folder), "r", str(site.root / "progress-l"))
    go()
    assert log_progress(site.store.read("log_lines")).first().pages == 2
    (folder / "2.log").write_text(line.format(3, 15) + "noise\n")
    go()
    r = log_progress(site.store.read("log_lines")).first()
    assert (r.pages, r.posts) == (3, 15)


def test_collection_life(site):
    spec = {"subreddit": "r/Philippines", "after": "2026-01-01"}
    one = start(site.store, spec)
    assert one["name"] == "Philippines-2026-01-01-open" and one["run_id"].endswith("z_r_philippines")
    with pytest.raises(CollectionError, match="already has progress"):
        start(site.store, {**spec, "subreddit": "PHILIPPINES"})
    assert resume(site.store, spec) == one
    with pytest.raises(CollectionError, match="another query"):
        resume(site.store, {**spec, "query": "x"})
    with pytest.raises(CollectionError, match="nothing to resume"):
        resume(site.store, {"subreddit": "other"})
    other = start(site.store, {"subreddit": "other", "run_id": one["run_id"]})
    assert other["run_id"] == one["run_id"] + "-2"
    again = start(site.store, spec, fresh=True)
    assert again["run_id"] != one["run_id"] and resume(site.store, spec) == again
    assert reset(site.store, "Other-open-open") and not reset(site.store, "nothing")
    assert [r.name for r in current(site.store).collect()] == ["Philippines-2026-01-01-open"]
    identity = json.dumps({k: spec.get(k) for k in ("subreddit", "title", "query", "selftext", "author", "after", "before")} | {"sort": "asc", "subreddit": "old"})
    old = site.spark.createDataFrame(
        [("old-2026-01-01-open", None, "oldrun", "oldrun", identity, 5), (one["name"], None, "x", "x", "{}", 5)],
        "name string, mismatch string, posts_run string, comments_run string, identity string, max_posts int")
    copy_old_progress(site.store, migratable(old, current(site.store)))
    assert resume(site.store, {**spec, "subreddit": "old"})["run_id"] == "oldrun" and resume(site.store, spec) == again


def test_ids_cost_the_state_no_call_each(site):
    """Ten thousand posts of which some have no id: a call per id took about a millisecond each, and posts without an id left no trace."""
    page = lambda n: json.dumps({"data": [{"id": f"i{n % 9000}", "created_utc": n}, {"id": None, "created_utc": n}]})
    (site.root / "pages").mkdir()
    (site.root / "pages" / "a.json").write_text("\n".join(page(n) for n in range(10_000)))
    stateful(site, files_per_batch=None, page_per_line=True)
    posts = site.store.read("posts", "r")
    assert posts.filter("id is null").count() == 10_000 and posts.filter("id is not null").count() == 9_000
    assert posts.filter("id is not null").agg(F.max("created_utc")).first()[0] == 8999.0
    state = site.spark.read.format("statestore").load(str(site.root / "p"))
    kept_keys = [r[0] for r in state.select("key.key").collect()]
    assert sum(not k.startswith("\0") for k in kept_keys) == 9_000 == known_arrivals(site.spark, str(site.root / "p")).count()
    assert sum(k.startswith("\0") for k in kept_keys) <= 4096


def test_first_arrivals_plan_calls_no_python_per_id(spark):
    from threadloom.streaming.arrival import first_arrivals

    stream = spark.readStream.format("rate").load().selectExpr("cast(value as string) id", "'p' page", "0L block")
    plan = first_arrivals(stream)._jdf.queryExecution().logical().toString()
    assert "TransformWithState" not in plan and "Deduplicate" in plan
