import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators.dedup import all_known_ids, first_seen, reconcile_stored, unseen
from threadloom.operators.position import assign_chunks, next_slot, page_cursors, page_plan, stall_audit, with_position
from threadloom.operators.search import Search, search_posts, time_order


def arrivals(spark, *pages):
    rows = [(p, i, id, ts) for p, page in enumerate(pages) for i, (id, ts) in enumerate(page)]
    return spark.createDataFrame(rows, "page int, pos int, id string, ts double")


def test_overlapping_pages(spark):
    df = arrivals(spark, [("a", 1.0), ("b", 2.0)], [("b", 9.0), ("c", 3.0)], [(" a ", 8.0), (None, 1.0), (None, 1.0), (" ", 1.0)])
    got = first_seen(df, [F.col("page"), F.col("pos")]).orderBy("page", "pos").collect()
    assert [(r.id, r.ts) for r in got] == [("a", 1.0), ("b", 2.0), ("c", 3.0), (None, 1.0), (None, 1.0), (" ", 1.0)]


def test_first_seen_hot_id_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 50)}" if rng.random() < 0.9 else None) for i in range(3000)]
    rng.shuffle(rows)
    first = {}
    for seq, id in sorted(rows):
        first.setdefault(id if id else ("none", seq), seq)
    got = first_seen(spark.createDataFrame(rows, "seq int, id string").repartition(6), [F.col("seq")])
    assert sorted(r.seq for r in got.collect()) == sorted(first.values())


def test_unseen_and_reconcile(spark):
    batch = spark.createDataFrame([("a",), (" b ",), (None,), ("",)], "id string")
    seen = spark.createDataFrame([("b",), ("b",), (None,)], "id string")
    assert sorted(str(r.id) for r in unseen(batch, seen).collect()) == ["", "None", "a"]
    stored = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (" ",), ("c",)], "id string")
    assert [r.id for r in reconcile_stored(seen, stored).orderBy("id").collect()] == ["a", "c"]
    assert sorted(r.id for r in all_known_ids((batch, "id"), (stored, "id")).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("within", [(), ("g",)])
def test_position_against_brute_force(spark, within):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["x", "y", None]), rng.choice([None, rng.randint(0, 40)]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, ts int, id int").repartition(7)
    got = with_position(df, ["ts", "id"], within).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if within else "all", []).append(r)
    want = {r[2]: i for g in groups.values() for i, r in enumerate(sorted(g, key=key))}
    assert {r.id: r.pos for r in got} == want


def test_position_orders_with_direction_and_nulls(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 10)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, created_utc double").repartition(5)
    for order, key in (
        (time_order("desc"), lambda r: (r[1] is None, -(r[1] or 0), r[0])),
        ([F.col("created_utc").asc_nulls_last(), "id"], lambda r: (r[1] is None, r[1] or 0, r[0])),
        ([F.col("created_utc").desc_nulls_first(), F.col("id").desc()], lambda r: (r[1] is not None, -(r[1] or 0), -r[0])),
    ):
        want = {r[0]: i // 20 + 1 for i, r in enumerate(sorted(rows, key=key))}
        assert {r.id: r.page_no for r in page_plan(df, order, 20).collect()} == want


def test_first_seen_keeps_all_rows_without_id_under_ties(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (" ", 1), ("a", 1), ("a", 1), ("a", 2)], "id string, seq int")
    assert sorted(str(r.id) for r in first_seen(df, [F.col("seq")]).collect()) == [" ", "None", "None", "a"]


def test_page_plan_and_cursors(spark):
    df = spark.createDataFrame([(f"p{i}", float(i)) for i in range(7)], "id string, created_utc double")
    pages = page_plan(df, ["created_utc", "id"], 3)
    assert {r.id: r.page_no for r in pages.collect()} == {f"p{i}": i // 3 + 1 for i in range(7)}
    cursors = {r.page_no: (r.page_rows, r.cursor) for r in page_cursors(pages).collect()}
    assert cursors == {1: (3, 2.0), 2: (3, 5.0), 3: (1, 6.0)}
    down = {r.page_no: r.cursor for r in page_cursors(pages, sort="desc").collect()}
    assert down == {1: 0.0, 2: 3.0, 3: 6.0}
    for bad in (0, 101, True, 2.0):
        with pytest.raises(ValueError):
            page_plan(df, ["id"], bad)


def test_page_of_known_posts_steps_past_its_time(spark):
    """Requests seen: nothing, 5, then 6."""
    df = spark.createDataFrame([(1, "a", 5.0, True), (1, "b", 5.0, True), (2, "a", 5.0, False), (2, "b", 5.0, False)],
                               "page_no bigint, id string, created_utc double, fresh boolean")
    log = page_cursors(df, new=F.col("fresh"))
    assert [r.cursor for r in log.orderBy("page_no").collect()] == [5.0, 6.0]
    assert [r.cursor for r in page_cursors(df, sort="desc", new=F.col("fresh")).orderBy("page_no").collect()] == [5.0, 4.0]


def test_stalls(spark):
    log = spark.createDataFrame([(1, 2, 5.0), (2, 2, 5.0), (3, 1, 5.0), (5, 2, 5.0), (6, 2, None)], "page_no bigint, page_rows bigint, cursor double")
    got = {r.page_no: r.stalled for r in stall_audit(log, 2).collect()}
    assert got == {1: False, 2: True, 3: False, 5: False, 6: True}
    assert {r.page_no: r.stalled for r in stall_audit(log, 2, start_cursor=5.0).collect()}[1] is True


def posts(spark):
    rows = [(f"p{i}", "Py" if i % 2 else "other", "A Cat" if i % 3 == 0 else None, "dog", "me", float(100 - i)) for i in range(10)]
    return spark.createDataFrame(rows, "id string, subreddit string, title string, selftext string, author string, created_utc double")


def found(spark, **spec):
    stored = spec.pop("stored", 0)
    return [r.id for r in search_posts(posts(spark), Search(**spec), stored).collect()]


def test_search(spark):
    assert found(spark, subreddit=" r/PY ") == ["p9", "p7", "p5", "p3", "p1"]
    assert found(spark, subreddit="py", sort="desc", max_posts=2) == ["p1", "p3"]
    assert found(spark, max_posts=5, stored=3) == ["p9", "p8"]
    assert found(spark, max_posts=5, stored=9) == []
    assert found(spark, title="cat") == ["p9", "p6", "p3", "p0"]
    assert found(spark, query="DOG", title="CAT", limit=1) == ["p9"]
    assert found(spark, author="u/me", after=97, before=99) == ["p3", "p2", "p1"]
    assert found(spark, author="nobody") == []
    assert found(spark, title="  ", limit=100)[0] == "p9"
    for bad in ({"sort": "new"}, {"limit": 0}, {"limit": 101}, {"max_posts": 0}, {"max_posts": True}):
        with pytest.raises(ValueError):
            Search(**bad)


def test_search_plan_is_a_bounded_top_k(spark, tmp_path):
    posts(spark).write.parquet(str(tmp_path / "posts"))
    df = search_posts(spark.read.parquet(str(tmp_path / "posts")), Search(author="me", after=1, max_posts=3, fields="id"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "EqualTo(author,me)" in plan and "GreaterThanOrEqual(created_utc" in plan
    assert "selftext" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("rows,size,want", [(3, 50000, [3]), (500, 500, [500]), (501, 500, [500, 1]), (1200, 500, [500, 500, 200])])
def test_chunk_sizes(spark, rows, size, want):
    got = assign_chunks(spark.range(rows).toDF("id"), ["id"], size).groupBy("chunk_no").count().orderBy("chunk_no").collect()
    assert [(r.chunk_no, r["count"]) for r in got] == list(enumerate(want, 1))


def test_chunks_continue(spark):
    """3 rows, then 4 more at size 5: 5 + 2.  A smaller size leaves old chunks alone."""
    inventory = spark.createDataFrame([("r", 0, 9), ("r", 1, 3), ("full", 2, 5), ("full", 1, 5), ("big", 4, 90)], "run_id string, chunk_no bigint, records bigint")
    slots = next_slot(inventory, 5)
    assert {r.run_id: (r.start_no, r.start_fill) for r in slots.collect()} == {"r": (1, 3), "full": (3, 0), "big": (5, 0)}
    more = spark.createDataFrame([(run, i) for run in ("r", "full", "big", "new") for i in range(4)], "run_id string, id int")
    got = assign_chunks(more, ["id"], 5, ("run_id",), slots).groupBy("run_id", "chunk_no").count().collect()
    assert {(r.run_id, r.chunk_no): r["count"] for r in got} == {
        ("r", 1): 2, ("r", 2): 2, ("full", 3): 4, ("big", 5): 4, ("new", 1): 4}
    for bad in (0, -1, True, "5", 2.5):
        with pytest.raises(ValueError):
            assign_chunks(more, ["id"], bad)
