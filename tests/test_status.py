"""State of a store from its own logs."""

import json

import pytest

from threadloom.sources.store import Store, stored_done
from threadloom.streaming import collection
from threadloom.streaming.ingest import ingest_comments, ingest_posts, note_empty_posts
from threadloom.streaming.status import comment_phase, run_counts, store_collections, store_status


class Site:
    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        self.store = Store(spark, str(root / "store"))

    def _land(self, folder, text):
        self.n += 1
        (self.root / folder).mkdir(exist_ok=True)
        (self.root / folder / f"{self.n:04d}.json").write_text(text)

    def posts(self, run="r", **comments):
        if comments:
            self._land("pages", json.dumps({"data": [{"id": i, "num_comments": n} for i, n in comments.items()]}))
        return ingest_posts(self.store, str(self.root / "pages"), run, str(self.root / f"p-{run}"), files_per_batch=1)

    def trees(self, run="r", skip_empty=True, **nodes):
        lines = [json.dumps({"post_id": p, "payload": json.dumps({"data": [{"kind": "t1", "data": {"id": c}} for c in ids]})}) for p, ids in nodes.items()]
        if lines:
            self._land("trees", "\n".join(lines))
        (self.root / "trees").mkdir(exist_ok=True)
        return ingest_comments(self.store, str(self.root / "trees"), run, str(self.root / f"c-{run}"), files_per_batch=1, skip_empty=skip_empty)

    def status(self, run="r"):
        return next(r for r in store_status(self.store).collect() if r.run_id == run)


@pytest.fixture
def site(spark, tmp_path):
    return Site(spark, tmp_path)


def test_a_store_without_anything(site):
    assert store_status(site.store).count() == 0 and store_collections(site.store).count() == 0
    assert comment_phase(site.store, "r", "none").first().total_comments == 0


def test_status_follows_the_phases(site):
    site.posts(a=2, b=0, c=1)
    s = site.status()
    assert (s.status, s.raw_posts, s.processed_posts, s.posts_considered, s.posts_completed) == ("not_started", 3, 3, 3, 0)
    first = site.trees(a=["x", "y"])
    s = site.status()
    assert (s.status, s.posts_completed, s.posts_skipped_empty, s.comments_collected) == ("in_progress", 1, 1, 2)
    second = site.trees(c=["z"], a=["w"])
    s = site.status()
    assert (s.status, s.posts_completed, s.raw_comments, s.processed_comments) == ("complete", 2, 3, 3)
    one, two = (comment_phase(site.store, "r", x.session).first().asDict() for x in (first, second))
    assert (one["posts_attempted"], one["posts_already_complete"], one["posts_skipped_empty"], one["comments_collected"]) == (1, 0, 1, 2)
    assert (two["posts_attempted"], two["posts_already_complete"], two["posts_skipped_empty"], two["total_comments"]) == (1, 2, 0, 3)
    # New posts open the run again.
    site.posts(d=5)
    assert site.status().status == "in_progress"


def test_empty_posts_are_noted_once(site, monkeypatch):
    site.posts(a=0, b=None)
    site.posts(c=0, a=0)
    site.trees()
    note_empty_posts(site.store, "r")
    assert sorted(r.post_id for r in stored_done(site.store, "r").collect()) == ["a", "c"]
    # A tree of a post that counts as done is not stored, as for any done post.
    site.trees(a=["x"], b=["y"])
    assert [r.post_id for r in site.store.read("comments").collect()] == ["b"]
    reads = []
    real = Store.read
    monkeypatch.setattr(Store, "read", lambda self, *args: reads.append(args) or real(self, *args))
    note_empty_posts(site.store, "r")
    assert reads == []


def test_empty_posts_may_be_asked_for(site):
    site.posts(a=0)
    site.trees(skip_empty=False, a=[])
    s = site.status()
    assert (s.status, s.posts_completed, s.posts_skipped_empty) == ("complete", 1, 0)
    site.trees()  # a post that is done is not noted as well
    assert site.status().posts_skipped_empty == 0


def test_a_replaced_batch_counts_once(site):
    row = site.spark.createDataFrame([("a",), ("b",), ("c",)], "value string")
    for rows in (row, row.limit(1), row.limit(0)):
        site.store.begin("posts", "r", 0)
        site.store.write_batch("raw_posts", rows, "r", 0)
        expected = rows.count()
        site.store.commit("posts", "r", 0)
        assert run_counts(site.store).first().raw_posts == expected == site.store.read("raw_posts").count()
    # Written, but not committed.
    site.store.begin("posts", "r", 0)
    site.store.write_batch("raw_posts", row, "r", 0)
    assert run_counts(site.store).first().raw_posts == 0


def test_replaced_posts_are_looked_at_again(site):
    posts = site.spark.createDataFrame([("a", 0), ("b", 0)], "id string, num_comments bigint")
    for rows, noted in ((posts, ["a", "b"]), (posts.limit(1), ["a"])):
        site.store.begin("posts", "r", 0)
        site.store.write_batch("posts", rows, "r", 0)
        site.store.commit("posts", "r", 0)
        note_empty_posts(site.store, "r")
        assert sorted(r.post_id for r in site.store.read("skipped_posts", "r").collect()) == noted


def test_counts_outlive_compaction_and_need_no_table(site, monkeypatch):
    site.posts(a=1, b=0)
    session = site.trees(a=["x"]).session
    before, phase = store_status(site.store).collect(), comment_phase(site.store, "r", session).collect()
    site.store.compact()
    reads, real = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, table, *args: reads.append(table) or real(self, table, *args))
    assert store_status(site.store).collect() == before and before[0].status == "complete"
    assert comment_phase(site.store, "r", session).collect() == phase
    assert set(reads) == {"journal"}


def test_reset_and_raised_cap(site):
    spec = {"subreddit": "s", "run_id": "r", "max_posts": 2}
    collection.start(site.store, spec)
    site.posts(a=1, b=0)
    site.trees(a=["x", "y"])
    row = store_collections(site.store).first()
    assert (row.status, row.total_fetched, row.posts_completed, row.posts_skipped_empty, row.comments_collected) == ("complete", 2, 1, 1, 2)
    collection.resume(site.store, {**spec, "max_posts": 5})
    assert store_collections(site.store).first().status == "in_progress"
    before = site.store.read("journal").count()
    collection.resume(site.store, {**spec, "max_posts": 5})
    assert site.store.read("journal").count() == before
    collection.reset(site.store, "s-open-open")
    s = site.status()
    assert (s.status, s.posts_completed, s.posts_skipped_empty, s.comments_collected) == ("unknown", 1, 0, 2)
    assert store_collections(site.store).count() == 0
