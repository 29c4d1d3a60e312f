"""Scans of stored JSONL runs (raw layer) and of log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.jsonrows import is_blank, is_one_object, read_lines, with_object
from threadloom.operators.position import with_position
from threadloom.schemas import COMMENT, LOG_LINE_PATTERN, POST

LINE_ORDER = ("src_rank", "chunk_no", "block_start", "line_seq")


def scan_run_lines(spark: SparkSession, root: str, kind: str = "posts") -> DataFrame:
    """Lines of every run under ``root``: the single old-style file, then its chunks.

    ``kind`` is ``posts`` or ``comments``.  Expects ``<run>/<kind>.jsonl`` and
    ``<run>/<kind>/<kind>_<n>.jsonl`` with n >= 1; other files are ignored.
    ``LINE_ORDER`` sorts a run the way it was written: chunk numbers compare as
    integers, and lines inside a file by split offset, then row order.
    """
    path = F.col("file")
    chunk = F.regexp_extract(path, rf"/([^/]+)/{kind}/{kind}_(\d+)\.jsonl$", 2).try_cast("int")
    old_run = F.regexp_extract(path, rf"/([^/]+)/{kind}\.jsonl$", 1)
    chunk_run = F.regexp_extract(path, rf"/([^/]+)/{kind}/{kind}_(\d+)\.jsonl$", 1)
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"{kind}*.jsonl")
        .text(root)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_seq"),
        )
    )
    return (
        lines.withColumn("run_id", F.coalesce(F.nullif(chunk_run, F.lit("")), F.nullif(old_run, F.lit(""))))
        .withColumn("chunk_no", F.coalesce(chunk, F.lit(0)))
        .withColumn("src_rank", F.when(chunk.isNull(), 0).otherwise(1))
        .filter(F.col("run_id").isNotNull() & ((F.col("src_rank") == 0) | (F.col("chunk_no") >= 1)))
    )


def line_status(value: Column | str = "value") -> Column:
    """``blank``, ``ok`` (exactly one JSON object) or ``corrupt``."""
    rows = read_lines(value, "id string")
    return F.when(is_blank(rows), "blank").when(is_one_object(rows), "ok").otherwise("corrupt")


def strict_lines(lines: DataFrame) -> DataFrame:
    """Drop blank lines; fail the scan on a corrupt one, naming its file and, where ``line_no`` is known, its line."""
    status = line_status("value")
    place = F.concat("file", F.lit(", line "), F.col("line_no").cast("string")) if "line_no" in lines.columns else F.col("file")
    failure = F.raise_error(
        F.concat(F.lit("not one JSON object, in "), place, F.lit(": "), F.left("value", F.lit(80)))
    ).cast("boolean")
    return lines.filter(F.when(status == "corrupt", failure).otherwise(status == "ok"))


def split_corrupt(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable lines and quarantined lines."""
    tagged = lines.withColumn("line_status", line_status("value"))
    return (
        tagged.filter("line_status = 'ok'").drop("line_status"),
        tagged.filter("line_status = 'corrupt'").drop("line_status"),
    )


def corrupt_line_numbers(lines: DataFrame) -> DataFrame:
    """File and 1-based line number of every corrupt line.

    Only files that have one are numbered, and the numbering is distributed, so
    a large file is not read by a single task.
    """
    bad_files = lines.filter(line_status("value") == "corrupt").select("file").distinct()
    numbered = with_position(
        lines.join(bad_files, "file", "left_semi"), ["block_start", "line_seq"], within=["file"], name="line_pos"
    )
    return numbered.filter(line_status("value") == "corrupt").select(
        "file", (F.col("line_pos") + 1).alias("line_no"), "value"
    )


def scan_processed_runs(spark: SparkSession, root: str, kind: str = "posts") -> DataFrame:
    """Processed JSONL runs as typed rows, with the order columns of the raw scan."""
    schema = POST if kind == "posts" else COMMENT
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    lines = strict_lines(scan_run_lines(spark, root, kind))
    parsed = with_object(lines, "value", fields, "record", "raise", "processed line is not one JSON object")
    return parsed.select("run_id", *LINE_ORDER, "record.*")


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``time | level | logger | message`` lines as columns; other lines are dropped.

    Works on a batch or a streaming text source.
    """
    return lines.filter(F.col(value).rlike(LOG_LINE_PATTERN)).select(
        *[c for c in lines.columns if c != value],
        F.regexp_extract(value, LOG_LINE_PATTERN, 1).cast("timestamp").alias("logged_at"),
        F.regexp_extract(value, LOG_LINE_PATTERN, 2).alias("level"),
        F.regexp_extract(value, LOG_LINE_PATTERN, 3).alias("logger"),
        F.regexp_extract(value, LOG_LINE_PATTERN, 4).alias("message"),
    )


def scan_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Log files with a ``seq`` that keeps line order within a file."""
    lines = spark.read.text(path).select(
        F.lit(run_id).alias("run_id") if run_id else F.col("_metadata.file_name").alias("run_id"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
        "value",
    )
    return parse_log_lines(lines)
