"""The chunk layout of a run as a Spark data source that reads what it writes.

``<root>/<run>/<kind>/<kind>_<n>.jsonl`` holds at most ``chunk_size`` lines, in
order; ``<root>/<run>/<kind>.jsonl`` is an old-style single file and counts as
chunk 0.  A reader gives every line with its place (run, chunk, line).  A writer
puts whole chunks beside the old ones and, once all tasks are done, moves them
into place and commits the batch by one small file below ``<run>/_log/<kind>``,
which says how many lines of each chunk count.  Readers look through the newest
such entry: lines that a crash left behind are not there, and writing a batch again
starts from the entry before it, so it may also have fewer lines than at first.

Files are opened in the workers, so the root must be a path that ``pyarrow.fs``
can open there (a shared folder, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from threadloom.operators.position import assign_chunks

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "run_chunks"
LINES = "value string, run_id string, chunk_no bigint, line_no bigint, file string"
#: Bytes of chunks that one task reads; a larger chunk is a task of its own.
TASK_BYTES = 64 << 20
READ_BYTES = 8 << 20
BATCH_LINES = 5_000
#: Log entries that stay: the newest one counts, the one before serves a batch that is written again.
ENTRIES_KEPT = 5


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


# --------------------------------------------------------------------- log


def packed(counts: dict[int, int]) -> list[list[int]]:
    """Lines per chunk as runs ``[first, last, lines]``: all full chunks in a row are one."""
    runs: list[list[int]] = []
    for n in sorted(counts):
        if runs and runs[-1][1] == n - 1 and runs[-1][2] == counts[n]:
            runs[-1][1] = n
        else:
            runs.append([n, n, counts[n]])
    return runs


@dataclass(frozen=True)
class Log:
    """The commits of one kind of record in one run."""

    root: str
    run_id: str
    kind: str

    @property
    def folder(self) -> str:
        return f"{_open(self.root)[1]}/{self.run_id}/_log/{self.kind}"

    def entries(self) -> list[tuple[int, str]]:
        files = _open(self.root)[0].get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        found = [(int(m[1]), f.path) for f in files if (m := re.fullmatch(r"(\d+)\.json", f.base_name))]
        return sorted(found)

    def runs(self, before: int | None = None) -> list[list[int]] | None:
        """Lines per chunk as of the newest commit (``before`` a batch); None without any commit."""
        found = [path for batch, path in self.entries() if before is None or batch < before]
        if not found:
            return None
        with _open(self.root)[0].open_input_stream(found[-1]) as stream:
            return json.loads(stream.read())["chunks"]

    def commit(self, batch: int, counts: dict[int, int]) -> None:
        """The batch counts from now on, and later batches (of an earlier try) no more."""
        files, _ = _open(self.root)
        files.create_dir(self.folder, recursive=True)
        for later, path in self.entries():
            if later > batch:
                files.delete_file(path)
        part = f"{self.folder}/{uuid.uuid4().hex}.part"
        with files.open_output_stream(part) as stream:
            stream.write(json.dumps({"batch": batch, "chunks": packed(counts)}).encode())
        files.move(part, f"{self.folder}/{batch:012d}.json")
        for _, path in self.entries()[:-ENTRIES_KEPT]:
            files.delete_file(path)


def _counts(runs: list[list[int]] | None) -> dict[int, int]:
    return {n: lines for first, last, lines in runs or [] for n in range(first, last + 1)}


# ------------------------------------------------------------------- reader


@dataclass
class Part(InputPartition):
    """Chunks that one task reads: path, run, chunk number, lines that count (None: all)."""

    chunks: list[tuple[str, str, int, int | None]]


def _lines(stream) -> Iterator[bytes]:
    """The lines of a file, the last one also without a line end."""
    rest = b""
    while block := stream.read(READ_BYTES):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class ChunkReader(DataSourceReader):
    def __init__(self, root: str, kind: str, run_id: str | None):
        self.root, self.kind, self.run_id = root, kind, run_id

    def partitions(self) -> list[Part]:
        files, root = _open(self.root)
        chunk = re.compile(rf"([^/]+)/{re.escape(self.kind)}/{re.escape(self.kind)}_(\d+)\.jsonl")
        single = re.compile(rf"([^/]+)/{re.escape(self.kind)}\.jsonl")
        found: list[tuple[str, int, int, str]] = []
        for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = f.path[len(root) :].lstrip("/")
            if f.type == fs.FileType.File and (m := chunk.fullmatch(name)) and int(m[2]) >= 1:
                found.append((m[1], int(m[2]), f.size, f.path))
            elif f.type == fs.FileType.File and (m := single.fullmatch(name)):
                found.append((m[1], 0, f.size, f.path))
        parts: list[Part] = []
        size, known = TASK_BYTES, {}
        for run, n, n_bytes, path in sorted(found):
            if self.run_id is not None and run != self.run_id:
                continue
            if run not in known:
                runs = Log(self.root, run, self.kind).runs()
                known[run] = None if runs is None else _counts(runs)
            # Chunks of other writers have no log: all their lines count, as those of an old-style file.
            lines = None if known[run] is None or n == 0 else known[run].get(n, 0)
            if lines == 0:
                continue
            if size + n_bytes > TASK_BYTES:
                parts.append(Part([]))
                size = 0
            parts[-1].chunks.append((path, run, n, lines))
            size += n_bytes
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.root)
        for path, run, n, most in partition.chunks:
            done, held = 0, []

            def batch() -> pa.RecordBatch:
                k = len(held)
                values = pa.array([v.decode("utf-8", "replace") for v in held], pa.string())
                columns = [values, [run] * k, [n] * k, range(done + 1, done + k + 1), [path] * k]
                return pa.RecordBatch.from_arrays(
                    [values, *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int64(), pa.int64(), pa.string())))],
                    ["value", "run_id", "chunk_no", "line_no", "file"],
                )

            with files.open_input_stream(path) as stream:
                for line in _lines(stream):
                    if most is not None and done + len(held) == most:
                        break
                    held.append(line)
                    if len(held) == BATCH_LINES:
                        yield batch()
                        done, held = done + len(held), []
            if held:
                yield batch()


# ------------------------------------------------------------------- writer


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: run, chunk number, lines, where it is and where it goes."""

    chunks: list[tuple[str, int, int, str, str]]


def _stretches(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and end of the rows in a row that are equal in all columns."""
    n = len(columns[0])
    if n:
        new = np.zeros(n - 1, bool)
        for column in columns:
            new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        yield from zip(edges, edges[1:])


class ChunkWriter(DataSourceArrowWriter):
    """Rows ``run_id, chunk_no, line_no, value``, each chunk whole and in order in one task."""

    def __init__(self, root: str, kind: str, batch: int, runs: list[str]):
        self.root, self.kind, self.batch, self.runs = root, kind, batch, runs
        # What is committed before this batch: its chunks are continued, whatever an earlier try of the batch left.
        self.before = {run: _counts(Log(root, run, kind).runs(before=batch)) for run in runs}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = _open(self.root)
        done: list[tuple[str, int, int, str, str]] = []
        try:
            self._write(iterator, done)
        except BaseException:
            for _, _, _, part, _ in done:
                files.delete_file(part)
            raise
        return Written(done)

    def _write(self, iterator: Iterator[pa.RecordBatch], done: list) -> None:
        """Fill ``done``, with the chunk that is being written as its last entry."""
        files, root = _open(self.root)
        now, out, lines = None, None, 0

        def close() -> None:
            if out:
                out.close()
                done[-1] = (*now, lines, *done[-1][3:])

        for batch in iterator:
            runs, numbers, places, values = (batch.column(batch.schema.get_field_index(c)) for c in ("run_id", "chunk_no", "line_no", "value"))
            values = pc.replace_substring(pc.fill_null(values, ""), "\n", " ")
            for start, end in _stretches(runs, numbers):
                run, n = runs[start].as_py(), numbers[start].as_py()
                if (run, n) != now:
                    close()
                    now, folder, lines = (run, n), f"{root}/{run}/{self.kind}", 0
                    files.create_dir(folder, recursive=True)
                    path = f"{folder}/{self.kind}_{n:05d}.jsonl"
                    part = f"{path[:-6]}.{uuid.uuid4().hex}.part"
                    out = files.open_output_stream(part)
                    done.append((run, n, 0, part, path))
                    if kept := self.before[run].get(n, 0):
                        with files.open_input_stream(path) as old:
                            for text, _ in zip(_lines(old), range(kept)):
                                out.write(text + b"\n")
                                lines += 1
                got, wanted = places[start:end].to_numpy(zero_copy_only=False), np.arange(lines + 1, lines + 1 + end - start)
                if len(wrong := np.flatnonzero(got != wanted)):
                    raise ValueError(f"line {got[wrong[0]]} of chunk {n} of {run} follows line {wanted[wrong[0]] - 1}")
                out.write("\n".join([*values[start:end].to_pylist(), ""]).encode())
                lines += end - start
        close()

    def commit(self, messages: list[Written]) -> None:
        files, _ = _open(self.root)
        counts = {run: dict(known) for run, known in self.before.items()}
        for run, n, lines, part, path in (c for m in messages if m for c in m.chunks):
            files.move(part, path)
            counts[run][n] = lines
        for run, known in counts.items():
            Log(self.root, run, self.kind).commit(self.batch, known)

    def abort(self, messages: list[Written]) -> None:
        files, _ = _open(self.root)
        for _, _, _, part, _ in (c for m in messages if m for c in m.chunks):
            files.delete_file(part)


class RunChunks(DataSource):
    """Options: ``root``, ``kind``; to read also ``run_id``; to write ``batch`` and ``runs`` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options["root"], self.options["kind"], self.options.get("run_id"))

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        if overwrite:
            raise ValueError("chunks are continued, not overwritten: write in mode append")
        return ChunkWriter(self.options["root"], self.options["kind"], int(self.options["batch"]), json.loads(self.options["runs"]))


# -------------------------------------------------------------------- frames


def scan_chunks(spark: SparkSession, root: str, kind: str = "posts", run_id: str | None = None) -> DataFrame:
    """``value, run_id, chunk_no, line_no, file``: every line of the runs under ``root`` with its place.

    ``(run_id, chunk_no, line_no)`` orders the lines as they were written; chunk 0
    is an old-style file, and ``line_no`` counts from 1, blank lines included.
    """
    spark.dataSource.register(RunChunks)
    reader = spark.read.format(FORMAT).option("root", root).option("kind", kind)
    return (reader if run_id is None else reader.option("run_id", run_id)).load()


def stored_slots(spark: SparkSession, root: str, kind: str, runs: list[str], chunk_size: int, batch: int) -> DataFrame:
    """Where batch ``batch`` continues each run, in the form that ``assign_chunks`` takes."""
    slots = []
    for run in runs:
        known = _counts(Log(root, run, kind).runs(before=batch))
        last = max(known, default=0)
        fill = known.get(last, 0)
        slots.append((run, last + 1, 0) if not last or fill >= chunk_size else (run, last, fill))
    # An Arrow table is a relation whose size Spark knows, so joining it does not deal all rows to one task per run.
    names = {"run_id": pa.string(), "start_no": pa.int64(), "start_fill": pa.int64()}
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*slots) if slots else [()] * 3, names.values())], list(names)))


def append_chunks(records: DataFrame, root: str, kind: str, order: list[Column | str], chunk_size: int, batch: int) -> None:
    """Append ``run_id, value`` in ``order`` to the chunks of each run, as one batch.

    Writing a batch again replaces what it wrote before, also with fewer lines or
    none; batches after it are no longer there then.  A line end inside a value
    becomes a blank.  The runs of a batch are listed on the driver.
    """
    spark = records.sparkSession
    spark.dataSource.register(RunChunks)
    runs = [r["run_id"] for r in records.select("run_id").distinct().collect()]
    placed = assign_chunks(records, order, chunk_size, ("run_id",), stored_slots(spark, root, kind, runs, chunk_size, batch))
    slots = stored_slots(spark, root, kind, runs, chunk_size, batch)
    first = (F.col("chunk_no") - F.col("start_no")) * chunk_size - F.col("start_fill")
    lines = placed.join(slots, "run_id").withColumn("line_no", F.col("pos") + 1 - first)
    (
        lines.select("run_id", F.col("chunk_no").cast("bigint"), F.col("line_no").cast("bigint"), "value")
        .repartition("run_id", "chunk_no")
        .sortWithinPartitions("run_id", "chunk_no", "line_no")
        .write.format(FORMAT)
        .mode("append")
        .options(root=root, kind=kind, batch=str(batch), runs=json.dumps(runs))
        .save()
    )


def empty_batch(root: str, kind: str, run_id: str, batch: int) -> None:
    """Commit a batch of a run that has no lines (any more)."""
    log = Log(root, run_id, kind)
    log.commit(batch, _counts(log.runs(before=batch)))
