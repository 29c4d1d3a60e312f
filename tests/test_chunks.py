"""The chunk layout: what is written is read, in order, whatever happened between."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.sources import chunks
from threadloom.sources.chunks import Log, append_chunks, empty_batch, scan_chunks
from threadloom.sources.lines import LINE_ORDER, scan_run_lines, strict_lines


def rows(spark, start, n, run="run"):
    value = F.format_string('{"id":"%s-%d"}', F.lit(run), F.col("id"))
    return spark.range(start, start + n).select(F.lit(run).alias("run_id"), "id", value.alias("value"))


def held(spark, root, run="run"):
    found = scan_chunks(spark, root, "posts", run).orderBy("run_id", "chunk_no", "line_no").collect()
    return [(r.chunk_no, r.line_no, int(json.loads(r.value)["id"].split("-")[1])) for r in found]


def want(n, size=5):
    return [(k // size + 1, k % size + 1, k) for k in range(n)]


def test_continue_and_scan(spark, tmp_path):
    root = str(tmp_path)
    for batch, (start, n) in enumerate([(0, 12), (12, 2), (14, 20), (34, 1)]):
        append_chunks(rows(spark, start, n), root, "posts", ["id"], 5, batch)
        assert held(spark, root) == want(start + n)
    append_chunks(rows(spark, 0, 7, "other"), root, "posts", ["id"], 5, 0)
    assert held(spark, root) == want(35) and held(spark, root, "other") == want(7)
    # The scan of archives of other writers reads the same lines.
    scanned = strict_lines(scan_run_lines(spark, root)).orderBy("run_id", *LINE_ORDER).collect()
    assert [r.value for r in scanned] == [r.value for r in scan_chunks(spark, root).orderBy("run_id", "chunk_no", "line_no").collect()]


def test_a_larger_or_smaller_chunk_size_later(spark, tmp_path):
    root = str(tmp_path)
    append_chunks(rows(spark, 0, 7), root, "posts", ["id"], 5, 0)
    append_chunks(rows(spark, 7, 6), root, "posts", ["id"], 3, 1)
    assert [p[:2] for p in held(spark, root)] == [(1, k) for k in range(1, 6)] + [(2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2)]
    assert [p[2] for p in held(spark, root)] == list(range(13))


def test_a_batch_written_again_may_shrink(spark, tmp_path):
    root = str(tmp_path)
    append_chunks(rows(spark, 0, 8), root, "posts", ["id"], 5, 0)
    for again in (13, 3, 1, 9):
        append_chunks(rows(spark, 8, again), root, "posts", ["id"], 5, 1)
        assert held(spark, root) == want(8 + again)
    empty_batch(root, "posts", "run", 1)
    assert held(spark, root) == want(8)
    append_chunks(rows(spark, 8, 4), root, "posts", ["id"], 5, 2)
    assert held(spark, root) == want(12)


@pytest.mark.parametrize("moved", [0, 1, 3])
def test_crash_while_chunks_are_moved(spark, tmp_path, monkeypatch, moved):
    """Some chunks of the batch are in place, the log is not written: readers see the batch before; a smaller replay fits."""
    root = str(tmp_path)
    append_chunks(rows(spark, 0, 8), root, "posts", ["id"], 5, 0)
    writer = chunks.ChunkWriter(root, "posts", 1, ["run"])
    messages = []
    for n, (a, b) in {2: (8, 10), 3: (10, 15), 4: (15, 17)}.items():
        import pyarrow as pa

        lines = range(a % 5 + 1 if n == 2 else 1, (a % 5 if n == 2 else 0) + b - a + 1)
        values = [json.dumps({"id": f"run-{k}"}) for k in range(a, b)]
        messages.append(writer.write(iter([pa.RecordBatch.from_pydict({"run_id": ["run"] * (b - a), "chunk_no": [n] * (b - a), "line_no": list(lines), "value": values})])))
    for m in messages[:moved]:
        for _, _, _, part, path in m.chunks:
            chunks._open(root)[0].move(part, path)
    assert held(spark, root) == want(8)
    append_chunks(rows(spark, 8, 3), root, "posts", ["id"], 5, 1)
    assert held(spark, root) == want(11)


def test_abort_leaves_nothing(spark, tmp_path):
    root = str(tmp_path)
    bad = rows(spark, 0, 40).withColumn("value", F.when(F.col("id") == 33, F.raise_error(F.lit("no line")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no line"):
        append_chunks(bad, root, "posts", ["id"], 5, 0)
    assert held(spark, root) == [] and Log(root, "run", "posts").runs() is None


def test_log_stays_small(spark, tmp_path):
    assert chunks.packed({1: 5, 2: 5, 3: 5, 4: 2}) == [[1, 3, 5], [4, 4, 2]]
    log = Log(str(tmp_path), "run", "posts")
    for batch in range(20):
        log.commit(batch, {n: 5 for n in range(1, batch + 2)})
    assert len(log.entries()) == chunks.ENTRIES_KEPT and log.runs() == [[1, 20, 5]] and log.runs(before=19) == [[1, 19, 5]]


def test_old_files_and_strict_scan_names_the_line(spark, tmp_path):
    run = tmp_path / "run1"
    (run / "posts").mkdir(parents=True)
    (run / "posts.jsonl").write_text('{"id":"old"}\n\n{"id":"old2"}')
    (run / "posts" / "posts_10.jsonl").write_text('{"id":"d"}\n{"id":\n')
    (run / "posts" / "posts_2.jsonl").write_text('{"id":"b"}\n')
    for name in ("posts_0.jsonl", "posts_x.jsonl", "posts_3.jsonl.part"):
        (run / "posts" / name).write_text('{"id":"no"}\n')
    lines = scan_chunks(spark, str(tmp_path))
    assert [(r.chunk_no, r.line_no) for r in lines.orderBy("chunk_no", "line_no").collect()] == [(0, 1), (0, 2), (0, 3), (2, 1), (10, 1), (10, 2)]
    with pytest.raises(Exception, match="not one JSON object, in .*posts_10.jsonl, line 2"):
        strict_lines(lines).collect()
    assert strict_lines(lines.filter("chunk_no < 10")).count() == 3
    assert scan_chunks(spark, str(tmp_path / "none")).count() == 0


def test_runs_are_not_dealt_to_one_task_each(spark, tmp_path, monkeypatch):
    """The place where a run goes on was joined by sorting all rows of the run in one task."""
    placed = []
    real = chunks.assign_chunks
    monkeypatch.setattr(chunks, "assign_chunks", lambda *a: placed.append(real(*a)) or placed[-1])
    rows = spark.range(3000).select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("run_id"), F.col("id").cast("string").alias("value"), "id")
    for batch in range(2):
        append_chunks(rows, str(tmp_path), "posts", ["id"], 700, batch)
    assert len(placed) == 2
    for df in placed:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [run_id#" in plan and "SortMergeJoin [run_id#" not in plan
    got = scan_chunks(spark, str(tmp_path)).orderBy("run_id", "chunk_no", "line_no").collect()
    assert [r.value for r in got] == [str(k) for run in (0, 1) for _ in range(2) for k in range(run, 3000, 2)]
    assert {(r.chunk_no, r.line_no) for r in got if r.run_id == "r1"} == {(k // 700 + 1, k % 700 + 1) for k in range(3000)}
