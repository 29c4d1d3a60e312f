"""URL filters: rules on hosts and path prefixes, found by a sorted sweep.

A host is written label by label from its end, each label closed by a dot, so
that a rule's host and all its subdomains are one interval of keys.  Rules and
pages are sorted together by range partitions, and a sweep over each partition
keeps the stack of the rules that are open; rules that opened in an earlier
partition are carried into it.  A second sweep over paths finds, for each open
host, its longest rule that the path starts with.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.common import Scratch

CARRIED, OPENS, POINT, CLOSES = -1, 0, 1, 2
RULES = "host string, path string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """``blog.example.net`` -> ``net.example.blog.`` as bytes."""
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(labels, "."), F.lit(".")).cast("binary")


def _swept(points: DataFrame, openings: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Points, and openings and ends of the keys in ``openings``, in sorted segments, each row with the open ``depth``.

    ``points``: ``key`` and ``point`` (a struct).  An interval is every key that
    starts with the opening's key; it ends at that key and the byte FF, which no
    UTF-8 text holds.  Equal keys of points are spread by a hash, so a host
    with a third of all rows fills as many segments as it needs.
    """
    point_type = points.schema["point"].dataType
    no_point = F.lit(None).cast(point_type)
    ends = F.concat("key", F.unhex(F.lit("FF")))
    events = (
        points.select(F.lit(POINT).alias("kind"), "key", F.lit(None).cast("binary").alias("rule"), F.xxhash64("point").alias("tie"), "point")
        .unionByName(openings.select(F.lit(OPENS).alias("kind"), "key", F.col("key").alias("rule"), F.lit(0).cast("long").alias("tie"), no_point.alias("point")))
        .unionByName(openings.select(F.lit(CLOSES).alias("kind"), ends.alias("key"), F.col("key").alias("rule"), F.lit(0).cast("long").alias("tie"), no_point.alias("point")))
    )
    # Range edges come from samples, which another plan would draw anew: the dealt rows are written once.
    dealt = scratch.write(events.repartitionByRange("key", "kind", "tie").withColumn("segment", F.spark_partition_id()), name)
    opened = dealt.filter(F.col("kind") == OPENS).select("rule", F.col("segment").alias("first"))
    closed = dealt.filter(F.col("kind") == CLOSES).select("rule", F.col("segment").alias("last"))
    carried = (
        opened.join(closed, "rule")
        .filter("last > first")
        .select(F.lit(CARRIED).alias("kind"), F.col("rule").alias("key"), "rule", F.lit(0).cast("long").alias("tie"), no_point.alias("point"),
                F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("segment"))
    )
    step = F.when(F.col("kind") <= OPENS, 1).when(F.col("kind") == CLOSES, -1).otherwise(0)
    return dealt.unionByName(carried).withColumn("depth", F.sum(step).over(_sweep("segment")))


def _sweep(*within: str):
    order = (F.col("kind") > CARRIED, F.col("key"), F.col("kind"), F.col("tie"))
    return Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def open_stack(points: DataFrame, openings: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """``(point, stack)``: the keys of all intervals that hold the point's key, outermost first."""
    swept = _swept(points, openings, scratch, "hosts")
    stack = [
        F.when(F.col("depth") >= d, F.last(F.when((F.col("kind") <= OPENS) & (F.col("depth") == d), F.col("rule")), ignorenulls=True).over(_sweep("segment")))
        for d in range(1, levels + 1)
    ]
    return swept.withColumn("stack", F.array_compact(F.array(*stack).cast("array<binary>"))).filter(F.col("kind") == POINT).select("point", "stack")


def innermost(points: DataFrame, openings: DataFrame, scratch: Scratch) -> DataFrame:
    """``(point, rule)``: the key of the innermost interval that holds the point's key, or null.

    That is the last interval to open at the point's own depth.
    """
    swept = _swept(points, openings, scratch, "paths")
    top = F.last(F.when(F.col("kind") <= OPENS, F.col("rule")), ignorenulls=True).over(_sweep("segment", "depth"))
    return swept.withColumn("top", F.when(F.col("depth") > 0, top)).filter(F.col("kind") == POINT).select("point", F.col("top").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (``page_id``, ``url``) with ``host``, ``path``, the deciding ``rule`` (host and path, or null) and ``verdict``.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path.  The longest rule wins, then the longer host; among equal rules
    ``block`` wins.  Rules with a null field do not count.  Without a fitting rule
    the verdict is ``default``.  Null URLs have empty host and path.  Every row
    gets a result of its own, repeated ones too; an empty table gives none.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rules = (
        rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
    )
    hosts = rules.select("key").distinct()
    levels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0

    read = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
    points = read.select(host_key(F.col("host")).alias("key"), F.struct("row", "page_id", "host", "path").alias("point"))
    stacked = open_stack(points, hosts, levels, scratch)

    nul = F.unhex(F.lit("00"))
    inside = stacked.select("point", F.explode("stack").alias("at"))
    by_path = inside.select(F.concat("at", nul, F.col("point.path").cast("binary")).alias("key"), "point")
    path_rules = rules.withColumn("key", F.concat("key", nul, F.col("path").cast("binary")))
    found = innermost(by_path, path_rules.select("key"), scratch)

    length = F.length(path_rules["host"]) + F.length(path_rules["path"])
    fitting = found.filter("rule is not null").join(
        path_rules.select(F.col("key").alias("rule"), F.struct(length.alias("n"), F.length("host").alias("h"), "host", "path", "verdict").alias("best")), "rule"
    )
    best = fitting.select("point.row", "best").groupBy("row").agg(F.max("best").alias("best"))
    return (
        stacked.select("point.*").join(best, "row", "left")
        .select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
