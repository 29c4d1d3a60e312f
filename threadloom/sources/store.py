"""Tables of a store: where runs are kept and how batches are written.

Every table is partitioned by ``run_id``; ingested tables also by ``batch_id`` and
by ``try``, one value per attempt at a batch.  A batch writes all its tables under
its own try and then commits that try in the log of its stream, which is one small
file.  Readers look through the log, so rows of an attempt that died between two
tables are not there, and an attempt with fewer rows, or with none in some table,
replaces all of an earlier one.

The log also holds how many rows each table got, counted while they were written
(see :meth:`Store.events`), so totals need no read of the tables.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from threadloom.functions.scalars import dedup_key
from threadloom.operators.normalize import normalize_comments, normalize_posts
from threadloom.operators.position import assign_chunks, check_chunk_size
from threadloom.schemas import COMMENT, DEFAULT_CHUNK_SIZE, POST

_KEYS = "run_id string, batch_id bigint"
_SCHEMAS = {
    "raw_posts": f"value string, {_KEYS}",
    "raw_comments": f"value string, {_KEYS}",
    "posts": None,
    "comments": None,
    "done_posts": f"post_id string, {_KEYS}",
    "skipped_posts": f"post_id string, {_KEYS}",
    "tree_errors": f"post_id string, error string, {_KEYS}",
    "page_errors": f"page string, payload string, page_error string, {_KEYS}",
    "line_errors": f"file string, value string, error string, {_KEYS}",
    "log_lines": "logged_at timestamp, level string, logger string, message string, "
    "seq struct<batch bigint, file string, block bigint, row bigint>, run_id string, batch_id bigint",
    "journal": "name string, run_id string, event string, at timestamp, identity string, max_posts bigint",
}
_TEXT = ("raw_posts", "raw_comments")
#: The tables that one stream writes together.
STREAMS = {
    "posts": ("raw_posts", "posts", "page_errors"),
    "comments": ("raw_comments", "comments", "done_posts", "tree_errors", "line_errors"),
    "skips": ("skipped_posts",),
    "logs": ("log_lines",),
}
_STREAM_OF = {t: stream for stream, tables in STREAMS.items() for t in tables}
#: ``of`` is the attempt of another stream that a batch was made from.
_EVENT = "`try` string, seq bigint, session string, of string, rows map<string,bigint>"
_COMMITS = f"stream string, run_id string, batch_id bigint, {_EVENT}"


class Store:
    """Names the tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, chunk_size: int = DEFAULT_CHUNK_SIZE):
        self.spark, self.root = spark, root.rstrip("/")
        self.chunk_size = check_chunk_size(chunk_size)
        self._tries: dict[tuple[str, str, int], str] = {}
        self._counts: dict[tuple[str, str, int], dict[str, Observation]] = {}

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _hadoop(self, path: str):
        """A path and its file system, which may be one that only Spark can reach."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, table: str) -> bool:
        folder, files = self._hadoop(self.path(table))
        return files.exists(folder)

    def _empty(self, schema: str) -> DataFrame:
        """No rows, and known to be none before anything runs: joins and unions with it are planned away."""
        return self.spark.createDataFrame([], schema).limit(0)

    def _schema(self, table: str):
        if table == "posts":
            return f"{_ddl(POST)}, page string, pos int, {_KEYS}"
        if table == "comments":
            return f"{_ddl(COMMENT)}, pos int, {_KEYS}"
        return _SCHEMAS[table]

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """Committed contents; empty with the right columns before the first write."""
        schema = self._schema(table)
        if not self._exists(table):
            return self._empty(schema)
        stream = _STREAM_OF.get(table)
        df = self._attempts(table) if stream else self.spark.read.schema(schema).parquet(self.path(table))
        if run_id is not None:
            df = df.filter(F.col("run_id") == run_id)
        if stream:
            seen = self.commits().filter(F.col("stream") == stream).select("run_id", "batch_id", "try")
            df = df.join(seen, ["run_id", "batch_id", "try"], "left_semi").select(*self.spark.createDataFrame([], schema).columns)
        return df

    def _attempts(self, table: str) -> DataFrame:
        """All that was written to a table of a stream, committed or not."""
        reader = self.spark.read.schema(f"{self._schema(table)}, try string")
        return reader.text(self.path(table)) if table in _TEXT else reader.parquet(self.path(table))

    def write_batch(self, table: str, df: DataFrame, run_id: str, batch_id: int) -> None:
        """Write one table of a batch; it counts once the batch is committed."""
        key = (_STREAM_OF[table], run_id, batch_id)
        own = self._tries.setdefault(key, uuid.uuid4().hex)
        keys = {"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("bigint"), "try": F.lit(own)}
        # Tasks of the writing stage count once each, whatever is run again.
        counted = self._counts.setdefault(key, {})[table] = Observation()
        writer = (
            df.withColumns(keys).observe(counted, F.count(F.lit(1)).alias("rows"))
            .write.mode("append")
            .option("maxRecordsPerFile", self.chunk_size)
            .partitionBy(*keys)
        )
        writer.text(self.path(table)) if table in _TEXT else writer.parquet(self.path(table))

    # -------------------------------------------------------- commit log

    def commits(self) -> DataFrame:
        """``stream, run_id, batch_id, try`` of the attempts that count: the latest of each batch."""
        return self.events().select("stream", "run_id", "batch_id", "try")

    def events(self) -> DataFrame:
        """The attempts that count, with ``rows`` per table, ``session`` (the call that wrote them) and ``seq`` (ns since 1970)."""
        if not self._exists("commits"):
            return self._empty(_COMMITS)
        rows = self.spark.read.schema(_COMMITS).json(self.path("commits")).filter("try is not null")
        entry = F.struct("try", "seq", "session", "of", "rows")
        latest = rows.groupBy("stream", "run_id", "batch_id").agg(F.max_by(entry, "seq").alias("e"))
        return latest.select("stream", "run_id", "batch_id", "e.*")

    def _put(self, name: str, rows: list[dict]) -> None:
        path, files = self._hadoop(f"{self.path('commits')}/{name}.json")
        out = files.create(path, True)
        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        out.close()

    def begin(self, stream: str, run_id: str, batch_id: int) -> None:
        """Start an attempt at a batch; what an earlier attempt left uncommitted will not be read."""
        self._tries[stream, run_id, batch_id] = uuid.uuid4().hex
        self._counts.pop((stream, run_id, batch_id), None)

    def commit(self, stream: str, run_id: str, batch_id: int, session: str | None = None) -> None:
        """From now on the tables of the batch hold what the current attempt wrote, and nothing else."""
        own = self._tries.pop((stream, run_id, batch_id), None) or uuid.uuid4().hex
        rows = {t: seen.get["rows"] for t, seen in self._counts.pop((stream, run_id, batch_id), {}).items()}
        row = {"stream": stream, "run_id": run_id, "batch_id": batch_id, "try": own, "seq": time.time_ns(), "session": session, "rows": rows}
        # One file per batch, so a batch that is done again writes over its own entry only.
        self._put(f"{stream}-{quote(run_id, safe='')}-{batch_id}", [row])

    def write_derived(self, table: str, df: DataFrame, run_id: str, made_from: dict[int, str], session: str | None = None) -> None:
        """Write rows of many batches (column ``batch_id``) and commit them all in one step.

        ``made_from`` names the batches, also those without rows, and the attempts they were made from.
        """
        stream, own = _STREAM_OF[table], uuid.uuid4().hex
        keyed = df.withColumns({"run_id": F.lit(run_id), "try": F.lit(own)})
        keyed.write.mode("append").partitionBy("run_id", "batch_id", "try").parquet(self.path(table))
        written = self._attempts(table).filter((F.col("run_id") == run_id) & (F.col("try") == own))
        rows = {r["batch_id"]: r["count"] for r in written.groupBy("batch_id").count().collect()}
        shared = {"stream": stream, "run_id": run_id, "try": own, "seq": time.time_ns(), "session": session}
        entries = [{**shared, "batch_id": b, "of": of, "rows": {table: rows.get(b, 0)}} for b, of in made_from.items()]
        self._put(f"{stream}-{own}", entries)

    def compact(self) -> None:
        """Put the commit log into one file and delete the attempts that do not count.

        Call it while nothing is being ingested: the rows of a running attempt would go too.
        """
        events = self.events()
        if not self._exists("commits"):
            return
        folder, files = self._hadoop(self.path("commits"))
        old = [s.getPath() for s in files.listStatus(folder)]
        # One short row per batch of the store.
        rows = [r.asDict() for r in events.collect()]
        self._put(f"all-{uuid.uuid4().hex}", rows)
        for path in old:
            files.delete(path, False)
        keep = {(r["stream"], r["run_id"], r["batch_id"], r["try"]) for r in rows}
        for table, stream in _STREAM_OF.items():
            if not self._exists(table):
                continue
            for r in self._attempts(table).select("run_id", "batch_id", "try").distinct().collect():
                if (stream, r["run_id"], r["batch_id"], r["try"]) not in keep:
                    gone, _ = self._hadoop(f"{self.path(table)}/run_id={_escaped(r['run_id'])}/batch_id={r['batch_id']}/try={r['try']}")
                    files.delete(gone, True)

    def append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path(table))


def _escaped(value: str) -> str:
    """A partition value as Spark writes it into a path."""
    marks = set('"#%\'*/:=?\\{}[]^') | {chr(c) for c in [*range(1, 32), 127]}
    return "".join(f"%{ord(c):02X}" if c in marks else c for c in value)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


# ------------------------------------------------------------ batch sinks


def append_records(raw: DataFrame, store: Store, kind: str, run_id: str, batch_id: int, order: list) -> None:
    """Append one batch to both layers: verbatim lines and normalized rows.

    ``kind`` is ``posts`` (``value``: JSON post) or ``comments`` (flattened
    nodes with ``raw`` and ``node``).
    """
    ordered = raw.orderBy(*order)
    if kind == "posts":
        store.write_batch("raw_posts", ordered.select("value"), run_id, batch_id)
        clean = normalize_posts(raw).select(*POST.fieldNames(), "page", "pos")
        store.write_batch("posts", clean, run_id, batch_id)
    elif kind == "comments":
        store.write_batch("raw_comments", ordered.select(F.col("raw").alias("value")), run_id, batch_id)
        clean = normalize_comments(raw).select(*COMMENT.fieldNames(), "pos")
        store.write_batch("comments", clean, run_id, batch_id)
    else:
        raise ValueError(f"kind: posts or comments, not {kind!r}")


def write_chunks(
    records: DataFrame, path: str, order: list, chunk_size: int, slots: DataFrame | None = None, mode: str = "append"
) -> None:
    """Write JSONL chunks ``run_id=…/chunk_no=…`` of at most ``chunk_size`` lines.

    ``records`` has ``run_id`` and ``value``.  Each chunk is one task's output,
    in order; ``slots`` continues the chunks of an earlier write.
    """
    placed = assign_chunks(records, order, chunk_size, ("run_id",), slots)
    (
        placed.repartition("run_id", "chunk_no")
        .sortWithinPartitions("run_id", "chunk_no", "pos")
        .select("value", "run_id", "chunk_no")
        .write.mode(mode)
        .partitionBy("run_id", "chunk_no")
        .text(path)
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string, run_id string, chunk_no bigint").text(path)


def stored_keys(store: Store, run_id: str, before_batch: int | None = None) -> DataFrame:
    """Ids of stored posts of a run; ``before_batch`` leaves out a batch being replayed."""
    rows = store.read("posts", run_id)
    if before_batch is not None:
        rows = rows.filter(F.col("batch_id") != before_batch)
    return rows.select(dedup_key("id").alias("id")).filter("id is not null")


def stored_done(store: Store, run_id: str, before_batch: int | None = None) -> DataFrame:
    """Ids of posts of a run that need no tree any more: stored ones, and those noted as empty."""
    rows = store.read("done_posts", run_id)
    if before_batch is not None:
        rows = rows.filter(F.col("batch_id") != before_batch)
    return rows.select("post_id").unionByName(store.read("skipped_posts", run_id).select("post_id"))
