import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators.integrity import deletion_guard, id_agreement, layer_agreement, lost_records
from threadloom.operators.layout import chunk_inventory, chunk_report, inventory_pages, manifest, over_limit, run_stream_counts, run_totals, tag_streams
from threadloom.operators.normalize import normalize_posts
from threadloom.operators.position import next_slot
from threadloom.operators.progress import completed_posts, pending_posts, phase_summary, require_usable_posts
from threadloom.sources.documents import discover_runs, read_manifests, scan_documents
from threadloom.sources.lines import LINE_ORDER, corrupt_line_numbers, scan_log, scan_processed_runs, scan_run_lines, split_corrupt, strict_lines
from threadloom.sources.payloads import explode_pages, page_errors
from threadloom.sources.store import read_chunks, write_chunks


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(line + "\n" for line in lines))


def test_run_scan_order_and_names(spark, tmp_path):
    run = tmp_path / "run1"
    write(run / "posts.jsonl", '{"id":"old1"}', "", '{"id":"old2"}')
    write(run / "posts" / "posts_00002.jsonl", '{"id":"b"}')
    write(run / "posts" / "posts_10.jsonl", '{"id":"d"}', '{"id":"e"}')
    write(run / "posts" / "posts_9.jsonl", '{"id":"c"}')
    for name in ("posts_0.jsonl", "posts_x.jsonl", "postsextra.jsonl", "posts_1.txt"):
        write(run / "posts" / name, '{"id":"no"}')
    write(run / "comments" / "comments_1.jsonl", '{"id":"no"}')
    write(tmp_path / "run2" / "posts" / "posts_1.jsonl", '{"id":"z"}')
    lines = strict_lines(scan_run_lines(spark, str(tmp_path)))
    posts = normalize_posts(lines).orderBy("run_id", *LINE_ORDER)
    assert [(r.run_id, r.id, r.chunk_no) for r in posts.collect()] == [
        ("run1", "old1", 0), ("run1", "old2", 0), ("run1", "b", 2), ("run1", "c", 9), ("run1", "d", 10), ("run1", "e", 10), ("run2", "z", 1)]
    counts = {(r.run_id, r.chunk_no): (r.records, r.legacy) for r in chunk_inventory(lines, ("run_id",)).collect()}
    assert counts[("run1", 0)] == (2, True) and counts[("run1", 10)] == (2, False)


def test_corrupt_lines(spark, tmp_path):
    write(tmp_path / "r" / "posts" / "posts_1.jsonl", '{"id":"a"}', "  ", '{"id":', '{"id":"b"}', "[1]")
    write(tmp_path / "r" / "posts" / "posts_2.jsonl", '{"id":"c"}')
    lines = scan_run_lines(spark, str(tmp_path))
    with pytest.raises(Exception, match="not one JSON object, in .*posts_1.jsonl"):
        strict_lines(lines).collect()
    good, bad = split_corrupt(lines)
    assert good.count() == 3 and bad.count() == 2
    where = corrupt_line_numbers(lines).orderBy("line_no").collect()
    assert [(r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in where] == [("posts_1.jsonl", 3, '{"id":'), ("posts_1.jsonl", 5, "[1]")]


def test_write_chunks_and_continue(spark, tmp_path):
    def rows(start, n):
        return spark.range(start, start + n).select(F.lit("run").alias("run_id"), "id", F.concat(F.lit('{"id":"'), "id", F.lit('"}')).alias("value"))

    out = str(tmp_path / "chunks")
    write_chunks(rows(0, 12), out, ["id"], 5)
    stored = read_chunks(spark, out)
    slots = next_slot(chunk_inventory(stored, ("run_id",)), 5)
    write_chunks(rows(12, 4), out, ["id"], 5, slots)
    got = read_chunks(spark, out).withColumn("file", F.input_file_name())
    assert {r.chunk_no: r.records for r in chunk_inventory(got, ("run_id",)).collect()} == {1: 5, 2: 5, 3: 5, 4: 1}
    assert got.count() == 16 and got.select("value").distinct().count() == 16
    first = [json.loads(r.value)["id"] for r in read_chunks(spark, out).filter("chunk_no = 1").collect()]
    assert first == ["0", "1", "2", "3", "4"]


def test_search_pages(spark):
    def items(*payloads):
        df = spark.createDataFrame(list(enumerate(payloads)), "page int, payload string")
        return [(r.page, r.pos, r.value) for r in explode_pages(df).orderBy("page", "pos").collect()]

    assert items('{"data":[{"id":"a"},"x",{"id":"b"},"{x"]}', '{"data":[]}', "{}") == [(0, 0, '{"id":"a"}'), (0, 2, '{"id":"b"}')]
    no_list = ['{"data":{}}', '{"data":null}', '{"data":"x"}']
    no_object = ['{"data":[{"id":"b"},{"id":"c"', "<html>", "", '[{"data":[]}]', '{"data":[]} junk', '{"data":[]}{}', "5", "null"]
    for bad in no_list + no_object:
        with pytest.raises(Exception, match="no list under data" if bad in no_list else "not exactly one JSON object"):
            items(bad)
    pages = spark.createDataFrame([(p,) for p in [*no_list, *no_object, "{}", '{"data":[{"id":1}]}']], "payload string")
    assert sorted(r.payload for r in page_errors(pages).collect()) == sorted(no_list + no_object)


def streams(spark, **counts):
    return tag_streams({
        s: spark.range(counts.get(s, 0)).select(F.lit("r").alias("run_id"), (F.col("id") / 5 + 1).cast("bigint").alias("chunk_no"))
        for s in ("raw_posts", "processed_posts", "raw_comments", "processed_comments")
    }, "run_id", "chunk_no")


def test_report(spark):
    tagged = streams(spark, raw_posts=12, processed_posts=12, raw_comments=3, processed_comments=3)
    (ok,) = chunk_report(chunk_inventory(tagged), 5).collect()
    assert ok.ok and ok.posts_agree and ok.comments_agree and ok.raw_posts == 12 and ok.over_limit == 0
    (bad,) = chunk_report(chunk_inventory(tagged), 4).collect()
    assert not bad.ok and bad.over_limit == 4
    assert sorted((r.stream, r.chunk_no) for r in over_limit(chunk_inventory(tagged), 4).collect()) == [
        ("processed_posts", 1), ("processed_posts", 2), ("raw_posts", 1), ("raw_posts", 2)]
    pages = inventory_pages(chunk_inventory(tagged), 2).filter("stream = 'raw_posts'").orderBy("page").collect()
    assert [[(c.chunk_no, c.records) for c in p.chunks] for p in pages] == [[(1, 5)], [(2, 5), (3, 2)]]
    (off,) = chunk_report(chunk_inventory(streams(spark, raw_posts=2, processed_posts=1)), 5).collect()
    assert not off.ok and not off.posts_agree and off.comments_agree
    old = chunk_inventory(spark.range(9).select(F.lit("r").alias("run_id"), F.lit("raw_posts").alias("stream"), F.lit(0).alias("chunk_no")))
    (legacy,) = chunk_report(old, 5).collect()
    assert legacy.over_limit == 0 and legacy.legacy_over_limit == 1
    (wide,) = run_totals(run_stream_counts(tagged)).collect()
    assert wide.asDict() == {"run_id": "r", "raw_posts": 12, "processed_posts": 12, "raw_comments": 3, "processed_comments": 3}


def test_manifest_round_trip(spark, tmp_path):
    params = spark.createDataFrame([("r", "2026-01-01", "py", None)], "run_id string, started_at string, subreddit string, max_posts int")
    (row,) = manifest(chunk_inventory(streams(spark, raw_posts=7)), params, 5).collect()
    doc = json.loads(row.value)
    assert doc["params"] == {"subreddit": "py", "max_posts": None} and doc["totals"]["raw_posts"] == 7
    assert doc["chunks"] == {"raw_posts": 2, "processed_posts": 0, "raw_comments": 0, "processed_comments": 0}
    write(tmp_path / "r" / "manifest.json", json.dumps(doc, indent=2))
    write(tmp_path / "broken" / "manifest.json", "{")
    got = {m.run_id: m for m in read_manifests(scan_documents(spark, str(tmp_path), ("manifest.json",))).collect()}
    assert got["r"].started_at == "2026-01-01" and got["r"].chunk_size == 5 and json.loads(got["r"].params) == {"subreddit": "py"} | {"max_posts": None}
    assert got["broken"].started_at is None and got["broken"].params is None
    runs = discover_runs(spark.createDataFrame([("r",), ("gone",)], "run_id string"), run_totals(run_stream_counts(streams(spark, raw_posts=1))))
    assert {r.run_id: r.raw_posts for r in runs.collect()} == {"r": 1, "gone": None}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_agreement(spark):
    raw, clean = ids(spark, "a", "b", "b", None), ids(spark, "a", "b", "c", None)
    (r,) = layer_agreement(raw, clean).collect()
    assert (r.raw_total, r.processed_total, r.only_raw_ids, r.only_processed_ids, r.repeated_raw_ids) == (4, 4, 0, 1, 1)
    assert r.counts_agree and not r.ids_agree and not r.ids_unique
    assert {x.id: (x.raw_rows, x.processed_rows) for x in id_agreement(raw, clean).collect()}[None] == (1, 1)
    assert [x.id for x in lost_records(ids(spark, "a", "z", "z", None), clean).collect()] == ["z"]
    guard = deletion_guard(
        spark.createDataFrame([("r", 5), ("s", 2), ("t", 1)], "run_id string, total_fetched bigint"),
        spark.createDataFrame([("r", 3), ("s", 2)], "run_id string, processed_posts bigint"),
    )
    assert {g.run_id: (g.data_missing, g.missing) for g in guard.collect()} == {"r": (True, 2), "s": (False, 0), "t": (True, 1)}


def test_comment_work_list(spark):
    posts = spark.createDataFrame([("p1", 2, 1), ("p2", 0, 2), ("p3", None, 3), (" ", 1, 4), ("p4", 5, 5)], "id string, num_comments bigint, n int")
    done = spark.createDataFrame([("p4",), ("p4",)], "post_id string")
    todo = lambda **kw: [r.id for r in pending_posts(posts, done, ["n"], **kw).orderBy("n").collect()]
    assert todo() == ["p1", "p3"] and todo(skip_empty=False) == ["p1", "p2", "p3"] and todo(max_posts=1) == ["p1"]
    (s,) = phase_summary(posts, done).collect()
    assert s.asDict() == {"posts_seen": 5, "posts_usable": 4, "posts_without_id": 1, "posts_already_complete": 1,
                          "posts_skipped_empty": 1, "posts_attempted": 2}
    assert require_usable_posts(phase_summary(posts, done)).count() == 1
    with pytest.raises(Exception, match="no posts are stored"):
        require_usable_posts(phase_summary(posts.limit(0), done)).collect()
    with pytest.raises(Exception, match="usable id"):
        require_usable_posts(phase_summary(posts.filter("n = 4"), done)).collect()
    comments = spark.createDataFrame([("p1",), (" ",), ("p4",), (" p1 ",)], "post_id string")
    assert {r.post_id: r.repaired for r in completed_posts(done, comments).collect()} == {"p1": True, "p4": False}


def test_log_scan(spark, tmp_path):
    write(tmp_path / "a.log", "2026-01-01 10:00:00 | INFO     | app.paginator | Page 1: 5 new posts (5/10 total)", "junk", "2026-01-01 10:00:05 | WARNING  | app.x | a | b")
    rows = scan_log(spark, str(tmp_path), "r").orderBy("seq").collect()
    assert [(r.level, r.logger, r.message) for r in rows] == [
        ("INFO", "app.paginator", "Page 1: 5 new posts (5/10 total)"), ("WARNING", "app.x", "a | b")]


def test_processed_scan(spark, tmp_path):
    post = {"id": "a", "score": 3, "num_comments": None, "created_utc": 5, "created_iso": "x", "title": "t"}
    comment = {"comment_id": "c", "post_id": "a", "depth": 1, "path": ["r"], "collapsed_children": [], "collapsed_count": None}
    write(tmp_path / "r" / "posts" / "posts_1.jsonl", json.dumps(post), "")
    write(tmp_path / "r" / "comments.jsonl", json.dumps(comment))
    p = scan_processed_runs(spark, str(tmp_path)).first()
    assert (p.run_id, p.chunk_no, p.id, p.score, p.created_utc) == ("r", 1, "a", 3, 5.0)
    c = scan_processed_runs(spark, str(tmp_path), "comments").first()
    assert (c.chunk_no, c.comment_id, c.path, c.collapsed_children) == (0, "c", ["r"], [])


def test_a_search_page_is_parsed_once(spark, tmp_path):
    """The check of a page was expanded to a parse at every use, in the filter and in the column."""
    write(tmp_path / "pages", '{"data":[{"id":1},"{}",{"a":"x"}]}', "[1]", '{"data":{"a":[]}}', '{"data":null}', "{}")
    pages = spark.read.text(str(tmp_path)).withColumnRenamed("value", "payload")
    for found, rows in ((page_errors(pages), 3), (explode_pages(pages, keep_errors=True), 5)):
        assert found._jdf.queryExecution().executedPlan().toString().count("parseJson") == 1
        assert found.count() == rows
    good = explode_pages(pages.filter("payload like '%[{%'"))
    assert [(r.pos, r.value) for r in good.collect()] == [(0, '{"id":1}'), (2, '{"a":"x"}')]
