"""Queries over runs, collections, logs and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from threadloom.functions import scalars as S
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
from threadloom.operators.integrity import deletion_guard, layer_agreement, lost_records
from threadloom.operators.layout import (
    chunk_inventory,
    chunk_report,
    inventory_pages,
    manifest,
    over_limit,
    run_stream_counts,
    run_totals,
    tag_streams,
)
from threadloom.operators.logs import log_progress, run_report
from threadloom.operators.position import assign_chunks, next_slot
from threadloom.operators.progress import (
    comment_progress,
    completed_posts,
    ingest_summary,
    pending_posts,
    phase_summary,
    smoke_posts,
)
from threadloom.operators.redact import redact_columns, redact_json_map
from threadloom.operators.responses import audit_responses, outcome_counts, with_attempts
from threadloom.plans.posts import _LINE_ORDER, _LINE_ORDER_SQL, document_posts
from threadloom.plans.registry import query, table
from threadloom.session import ensure_checkpoint_dir
from threadloom.sources.documents import (
    check_comments_documents,
    check_posts_documents,
    read_comments_progress,
    read_posts_progress,
)
from threadloom.sources.chunks import append_chunks, scan_chunks
from threadloom.sources.store import Store, read_chunks, write_chunks
from threadloom.streaming.arrival import known_arrivals
from threadloom.streaming.ingest import ingest_comments, ingest_logs, ingest_posts, ingest_posts_stateful


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---------------------------------------------------------------- progress

_PENDING_SQL = """SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
                  WHERE lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)"""


@query("pending_posts", _PENDING_SQL)
def pending(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    return pending_posts(posts, table(spark, sf_dir, "labels"), ["created_utc"], done_id="doc_id").select("id")


@query("smoke_posts", _PENDING_SQL + " ORDER BY doc_id LIMIT 5")
def smoke(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    return smoke_posts(posts, table(spark, sf_dir, "labels"), ["created_utc"], done_id="doc_id").select("id")


@query(
    "phase_summary",
    """SELECT count(*) AS posts_seen, count(*) FILTER (lang <> 'es') AS posts_usable,
         count(*) FILTER (lang = 'es') AS posts_without_id,
         count(*) FILTER (lang <> 'es' AND done) AS posts_already_complete,
         count(*) FILTER (lang = 'de' AND NOT done) AS posts_skipped_empty,
         count(*) FILTER (lang IN ('en', 'fr') AND NOT done) AS posts_attempted
       FROM (SELECT lang, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents)""",
)
def summary(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    posts = posts.withColumn("id", F.when(F.col("author") == "w_es", "  ").otherwise(F.col("id")))
    return phase_summary(posts, table(spark, sf_dir, "labels"), done_id="doc_id")


@query(
    "completed_posts",
    """SELECT CAST(doc_id AS VARCHAR) AS post_id, doc_id NOT IN (SELECT doc_id FROM labels) AS repaired
       FROM documents WHERE lang = 'en' OR doc_id IN (SELECT doc_id FROM labels)""",
)
def completed(spark, sf_dir):
    noted = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("post_id"))
    comments = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("post_id"))
    return completed_posts(noted, comments)


@query(
    "comment_progress",
    """WITH r AS (SELECT 'src' || n_nationkey AS run_id, n_regionkey, n_nationkey FROM nation),
         p AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
         c AS (SELECT source, count(DISTINCT doc_id) AS posts, count(*) AS n
               FROM documents JOIN labels USING (doc_id) GROUP BY 1)
       SELECT run_id,
         CASE WHEN n_regionkey < 2 THEN CASE WHEN coalesce(p.n, 0) > 0 AND 15 * n_nationkey >= p.n THEN 'complete' ELSE 'in_progress' END
              WHEN coalesce(c.n, 0) > 0 THEN 'unknown' ELSE 'not_started' END AS status,
         CASE WHEN n_regionkey < 2 THEN n_nationkey * 10 ELSE coalesce(c.posts, 0) END AS posts_completed,
         CASE WHEN n_regionkey < 2 THEN n_nationkey * 5 ELSE 0 END AS posts_skipped_empty,
         CASE WHEN n_regionkey < 2 THEN n_nationkey * 20 ELSE coalesce(c.n, 0) END AS comments_collected,
         coalesce(p.n, 0) AS posts_considered
       FROM r LEFT JOIN p ON r.run_id = p.source LEFT JOIN c ON r.run_id = c.source""",
)
def progress(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    documents = table(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), "doc_id")
    comments = documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "run_id", F.col("doc_id").cast("string").alias("post_id")
    )
    run = F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("run_id")
    key = F.col("n_nationkey").cast("bigint")
    noted = nation.filter("n_regionkey < 2").select(
        run,
        (key * 10).alias("posts_completed"),
        (key * 5).alias("posts_skipped_empty"),
        (key * 20).alias("comments_collected"),
    )
    return comment_progress(nation.select(run), documents, comments, noted)


@query(
    "ingest_summary",
    """WITH b AS (SELECT o_custkey AS run, year(o_orderdate) AS session, count(*) AS n FROM orders GROUP BY ALL),
         m AS (SELECT run, max(session) AS latest FROM b GROUP BY 1)
       SELECT CAST(run AS VARCHAR) AS run_id, count(*) FILTER (session = latest) AS pages,
         CAST(sum(n) FILTER (session = latest) AS BIGINT) AS posts_this_run, CAST(sum(n) AS BIGINT) AS total_posts,
         false AS stopped FROM b JOIN m USING (run) GROUP BY run""",
)
def ingest_totals(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("run_id"), F.year("o_orderdate").alias("session")
    ).agg(F.count(F.lit(1)).alias("rows"))
    return ingest_summary(batches.withColumn("stopped", F.lit(False)))


# --------------------------------------------------------------- integrity


@query(
    "layer_agreement",
    """WITH r AS (SELECT o_orderkey AS id, count(*) AS n FROM orders GROUP BY 1),
         p AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
         j AS (SELECT coalesce(r.n, 0) AS rn, coalesce(p.n, 0) AS pn FROM r FULL JOIN p ON r.id = p.id)
       SELECT CAST(sum(rn) AS BIGINT) AS raw_total, CAST(sum(pn) AS BIGINT) AS processed_total,
         count(*) FILTER (pn = 0) AS only_raw_ids, count(*) FILTER (rn = 0) AS only_processed_ids,
         count(*) FILTER (rn > 1) AS repeated_raw_ids, count(*) FILTER (pn > 1) AS repeated_processed_ids,
         count(*) FILTER (rn <> pn) AS unequal_ids, sum(rn) = sum(pn) AS counts_agree,
         count(*) FILTER (pn = 0 OR rn = 0) = 0 AS ids_agree, count(*) FILTER (rn > 1 OR pn > 1) = 0 AS ids_unique
       FROM j""",
)
def agreement(spark, sf_dir):
    return layer_agreement(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "lost_records",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def lost(spark, sf_dir):
    return lost_records(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "deletion_guard",
    """WITH s AS (SELECT l_suppkey AS run, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1),
         p AS (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY 1)
       SELECT CAST(p.run AS VARCHAR) AS run_id, p.n AS total_fetched, coalesce(s.n, 0) AS stored,
         p.n > coalesce(s.n, 0) AS data_missing, greatest(p.n - coalesce(s.n, 0), 0) AS missing
       FROM p LEFT JOIN s ON p.run = s.run""",
)
def guard(spark, sf_dir):
    progress_rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("total_fetched")
    )
    per_order = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    totals = per_order.groupBy(F.col("l_suppkey").cast("string").alias("run_id")).agg(
        F.count(F.lit(1)).alias("processed_posts")
    )
    return deletion_guard(progress_rows, totals)


# ------------------------------------------------------------------ layout


@query(
    "chunk_assignment",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(rn - 1 AS BIGINT) AS pos,
          CAST((rn - 1) // 2500 + 1 AS BIGINT) AS chunk_no FROM (
        SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER_SQL}) AS rn FROM lineitem)""",
)
def chunks(spark, sf_dir):
    placed = assign_chunks(table(spark, sf_dir, "lineitem").select(*_LINE_ORDER), _LINE_ORDER, 2500)
    return placed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos", "chunk_no")


@query(
    "chunk_resume",
    f"""WITH last AS (SELECT o_orderstatus AS run_id, max(o_orderkey // 700) + 1 AS no,
            count(*) FILTER (o_orderkey // 700 = (SELECT max(o_orderkey // 700) FROM orders i WHERE i.o_orderstatus = o.o_orderstatus)) AS fill
          FROM orders o GROUP BY o_orderstatus),
        slot AS (SELECT run_id, CASE WHEN fill >= 150 THEN no + 1 ELSE no END AS start_no,
                   CASE WHEN fill >= 150 THEN 0 ELSE fill END AS start_fill FROM last)
        SELECT l_linestatus AS run_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CAST(coalesce(start_no, 1) + (coalesce(start_fill, 0) + rn - 1) // 150 AS BIGINT) AS chunk_no FROM (
          SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_LINE_ORDER_SQL}) AS rn FROM lineitem) l
        LEFT JOIN slot ON slot.run_id = l_linestatus""",
)
def resumed_chunks(spark, sf_dir):
    """Lines continue the chunks orders left behind, with a smaller chunk size."""
    before = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("run_id"), (F.floor(F.col("o_orderkey") / 700) + 1).alias("chunk_no")
    )
    slots = next_slot(chunk_inventory(before, ("run_id",)), 150)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("run_id"), *_LINE_ORDER)
    return assign_chunks(lines, _LINE_ORDER, 150, ("run_id",), slots).select(
        "run_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "chunk_no"
    )


def _streams(spark, sf_dir) -> DataFrame:
    """Orders and lines as the four streams of runs (one run per clerk group)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("run_id"), F.floor(F.col("o_orderkey") / 500).alias("chunk_no"), "o_orderpriority"
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("run_id"), F.floor(F.col("l_orderkey") / 500).alias("chunk_no"), "l_returnflag"
    )
    return tag_streams(
        {
            "raw_posts": o,
            "processed_posts": o.filter("run_id <> 'P'"),
            "raw_comments": lines,
            "processed_comments": lines.filter("l_returnflag <> 'R'"),
        },
        "run_id",
        "chunk_no",
    )


_STREAMS_SQL = """s AS (
   SELECT o_orderstatus AS run_id, 'raw_posts' AS stream, o_orderkey // 500 AS chunk_no FROM orders
   UNION ALL SELECT o_orderstatus, 'processed_posts', o_orderkey // 500 FROM orders WHERE o_orderstatus <> 'P'
   UNION ALL SELECT l_linestatus, 'raw_comments', l_orderkey // 500 FROM lineitem
   UNION ALL SELECT l_linestatus, 'processed_comments', l_orderkey // 500 FROM lineitem WHERE l_returnflag <> 'R')"""
_INVENTORY_SQL = f"{_STREAMS_SQL}, i AS (SELECT run_id, stream, chunk_no, count(*) AS records, chunk_no = 0 AS legacy FROM s GROUP BY ALL)"


@query("run_stream_counts", f"WITH {_STREAMS_SQL} SELECT run_id, stream, count(*) AS records FROM s GROUP BY ALL")
def stream_counts(spark, sf_dir):
    return run_stream_counts(_streams(spark, sf_dir))


@query(
    "run_totals",
    f"""WITH {_STREAMS_SQL} SELECT run_id, count(*) FILTER (stream = 'raw_posts') AS raw_posts,
         count(*) FILTER (stream = 'processed_posts') AS processed_posts,
         count(*) FILTER (stream = 'raw_comments') AS raw_comments,
         count(*) FILTER (stream = 'processed_comments') AS processed_comments FROM s GROUP BY run_id""",
)
def totals(spark, sf_dir):
    return run_totals(run_stream_counts(_streams(spark, sf_dir)))


@query("chunk_inventory", f"WITH {_INVENTORY_SQL} SELECT * FROM i")
def inventory(spark, sf_dir):
    return chunk_inventory(_streams(spark, sf_dir))


@query("over_limit_chunks", f"WITH {_INVENTORY_SQL} SELECT * FROM i WHERE records > 600")
def large_chunks(spark, sf_dir):
    return over_limit(chunk_inventory(_streams(spark, sf_dir)), 600)


@query(
    "inventory_pages",
    f"""WITH {_INVENTORY_SQL} SELECT run_id, stream, chunk_no // 7 AS page, CAST(sum(records) AS BIGINT) AS total,
         string_agg(chunk_no || ':' || records, ' ' ORDER BY chunk_no) AS chunks FROM i GROUP BY run_id, stream, chunk_no // 7""",
)
def inventory_lists(spark, sf_dir):
    pages = inventory_pages(chunk_inventory(_streams(spark, sf_dir)), 7)
    entry = F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_no"].cast("string"), c["records"].cast("string")))
    return pages.select("run_id", "stream", "page", "total", F.array_join(entry, " ").alias("chunks"))


@query(
    "run_manifest",
    f"""WITH {_INVENTORY_SQL}, d AS (SELECT o_orderstatus AS run_id, min(o_orderdate) AS dt, max(o_custkey) AS cust FROM orders GROUP BY 1)
        SELECT run_id, '{{"run_id":"' || run_id || '","started_at":"' || strftime(any_value(dt), '%Y-%m-%d') || '","chunk_size":600,"params":{{"limit":'
          || any_value(cust) || ',"title":null}},"chunks":{{"raw_posts":' || count(*) FILTER (stream = 'raw_posts')
          || ',"processed_posts":' || count(*) FILTER (stream = 'processed_posts') || ',"raw_comments":' || count(*) FILTER (stream = 'raw_comments')
          || ',"processed_comments":' || count(*) FILTER (stream = 'processed_comments') || '}},"totals":{{"raw_posts":'
          || coalesce(sum(records) FILTER (stream = 'raw_posts'), 0) || ',"processed_posts":' || coalesce(sum(records) FILTER (stream = 'processed_posts'), 0)
          || ',"raw_comments":' || coalesce(sum(records) FILTER (stream = 'raw_comments'), 0) || ',"processed_comments":'
          || coalesce(sum(records) FILTER (stream = 'processed_comments'), 0) || '}}}}' AS value FROM i JOIN d USING (run_id) GROUP BY run_id""",
)
def manifests(spark, sf_dir):
    params = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run_id")).agg(
        F.min("o_orderdate").cast("date").cast("string").alias("started_at"), F.max("o_custkey").alias("limit")
    )
    params = params.withColumn("title", F.lit(None).cast("string"))
    return manifest(chunk_inventory(_streams(spark, sf_dir)), params, 600)


@query(
    "chunk_report",
    f"""WITH {_INVENTORY_SQL}, t AS (
          SELECT run_id, CAST(coalesce(sum(records) FILTER (stream = 'raw_posts'), 0) AS BIGINT) AS raw_posts,
            CAST(coalesce(sum(records) FILTER (stream = 'processed_posts'), 0) AS BIGINT) AS processed_posts,
            CAST(coalesce(sum(records) FILTER (stream = 'raw_comments'), 0) AS BIGINT) AS raw_comments,
            CAST(coalesce(sum(records) FILTER (stream = 'processed_comments'), 0) AS BIGINT) AS processed_comments,
            count(*) FILTER (records > 600 AND NOT legacy) AS over_limit,
            count(*) FILTER (records > 600 AND legacy) AS legacy_over_limit FROM i GROUP BY run_id)
        SELECT *, raw_posts = processed_posts AS posts_agree, raw_comments = processed_comments AS comments_agree,
          raw_posts = processed_posts AND raw_comments = processed_comments AND over_limit = 0 AS ok FROM t""",
)
def report(spark, sf_dir):
    return chunk_report(chunk_inventory(_streams(spark, sf_dir)), 600)


@query(
    "chunk_round_trip",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_LINE_ORDER_SQL}) - 1 AS pos FROM lineitem)
        SELECT l_linestatus AS run_id, CAST(pos // 2000 + 1 AS BIGINT) AS chunk_no, count(*) AS records,
          min('{{"k":' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '}}') AS first_line FROM r GROUP BY ALL""",
)
def chunk_round_trip(spark, sf_dir):
    """Lines written as chunked text, read back and counted per chunk."""
    line = F.concat(F.lit('{"k":'), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("}"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("run_id"), line.alias("value"), *_LINE_ORDER)
    path = f"{_landing(spark)}/chunks"
    write_chunks(lines, path, _LINE_ORDER, 2000)
    return read_chunks(spark, path).groupBy("run_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("records"), F.min("value").alias("first_line")
    )


def _lines_of(spark, sf_dir) -> DataFrame:
    """Lineitem as lines of two runs; ``part`` deals them to three batches."""
    fields = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    value = _text("[", *[x for f in fields for x in (f, ",")][:-1], "]")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("run_id"), value.alias("value"), (F.col("l_orderkey") % 3).alias("part"), *_LINE_ORDER
    )


_PLACES_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey % 3, {order}) - 1 AS pos FROM lineitem {rows})
    SELECT l_linestatus AS run_id, CAST(pos // 700 + 1 AS BIGINT) AS chunk_no, CAST(pos % 700 + 1 AS BIGINT) AS line_no,
      '[' || l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ']' AS value FROM r"""


@query("chunk_continue_round_trip", _PLACES_SQL.format(order=_LINE_ORDER_SQL, rows=""))
def chunk_continue_round_trip(spark, sf_dir):
    """Three batches continue each other's chunks; every line comes back with its place."""
    lines, root = _lines_of(spark, sf_dir), f"{_landing(spark)}/runs"
    for batch in range(3):
        append_chunks(lines.filter(F.col("part") == batch), root, "posts", _LINE_ORDER, 700, batch)
    return scan_chunks(spark, root).select("run_id", "chunk_no", "line_no", "value")


@query("replay_that_shrinks", _PLACES_SQL.format(order=_LINE_ORDER_SQL, rows="WHERE l_orderkey % 3 <> 1 OR l_linenumber = 1"))
def replay_that_shrinks(spark, sf_dir):
    """The second of three batches is written again with fewer lines; the third one follows it again."""
    lines, root = _lines_of(spark, sf_dir), f"{_landing(spark)}/runs"
    shrunk = lines.filter((F.col("part") != 1) | (F.col("l_linenumber") == 1))
    for rows, batch in ((lines, 0), (lines, 1), (lines, 2), (shrunk, 1), (shrunk, 2)):
        append_chunks(rows.filter(F.col("part") == batch), root, "posts", _LINE_ORDER, 700, batch)
    return scan_chunks(spark, root).select("run_id", "chunk_no", "line_no", "value")


# ---------------------------------------------------------------- identity


def customer_specs(spark, sf_dir) -> DataFrame:
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    after = (
        F.when(seg == "BUILDING", F.lit(None).cast("string"))
        .when(seg == "MACHINERY", _text(key * 86400))
        .when(seg == "HOUSEHOLD", F.lit(" 2020-02-03T04:05:06 "))
        .when(seg == "FURNITURE", _text("1 year!", key))
        .otherwise(_text("1e1", key % 3 + 1))
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        _text(" r/", F.lower(seg), " & ", F.col("c_name"), " ").alias("subreddit"),
        after.alias("after"),
        F.when(seg == "BUILDING", "2021-12-31").otherwise("  ").alias("before"),
        F.col("c_mktsegment").alias("title"),
        F.lit("secret").alias("api_key"),
    )


_SPEC_NAME_SQL = """SELECT c_custkey, lower(c_mktsegment) || ' & ' || c_name AS subreddit_display,
   lower(c_mktsegment || ' & ' || c_name) AS subreddit_norm,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'open'
     WHEN 'MACHINERY' THEN strftime(TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * c_custkey, '%Y-%m-%d')
     WHEN 'HOUSEHOLD' THEN '2020-02-03' WHEN 'FURNITURE' THEN '1-year-' || c_custkey
     ELSE CASE c_custkey % 3 WHEN 0 THEN '5138-11-16' WHEN 1 THEN 'epoch-1000000000000_0'
          ELSE 'epoch-10000000000000_0' END END AS after_token,
   CASE c_mktsegment WHEN 'BUILDING' THEN '2021-12-31' ELSE 'open' END AS before_token,
   regexp_replace(lower(c_mktsegment) || ' & ' || c_name, '[^A-Za-z0-9-]+', '_', 'g') AS clean
 FROM customer"""


@query(
    "collection_names",
    f"""WITH n AS ({_SPEC_NAME_SQL})
        SELECT c_custkey, subreddit_display, subreddit_norm, after_token, before_token,
          clean || '-' || after_token || '-' || before_token AS name FROM n""",
)
def names(spark, sf_dir):
    return with_identity(customer_specs(spark, sf_dir)).select(
        "c_custkey", "subreddit_display", "subreddit_norm", "after_token", "before_token", "name"
    )


@query(
    "safe_summary",
    """SELECT ' r/' || lower(c_mktsegment) || ' & ' || c_name || ' ' AS subreddit, c_mktsegment AS title,
         CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN CAST(c_custkey * 86400 AS VARCHAR)
           WHEN 'HOUSEHOLD' THEN ' 2020-02-03T04:05:06 ' WHEN 'FURNITURE' THEN '1 year!' || c_custkey
           ELSE '1e1' || (c_custkey % 3 + 1) END AS after,
         CASE c_mktsegment WHEN 'BUILDING' THEN '2021-12-31' ELSE '  ' END AS before,
         '{"raw_dir":"raw' || c_custkey || '","chunk_size":' || c_custkey || '}' AS output
       FROM customer""",
)
def summaries(spark, sf_dir):
    """Every column that comes out of specifications with secrets beside and inside ``output``."""
    output = F.struct(_text("raw", F.col("c_custkey")).alias("raw_dir"), F.lit("secret").alias("api_key"), F.col("c_custkey").alias("chunk_size"))
    shown = safe_summary(customer_specs(spark, sf_dir).withColumn("output", output))
    return shown.withColumn("output", F.to_json("output"))


def identity_pairs(spark, sf_dir) -> DataFrame:
    """Stored progress documents next to the request that wants to resume them."""
    nation = F.col("c_nationkey")
    sub = F.col("c_mktsegment")
    key = F.col("c_custkey")
    filters = _text('{"subreddit":"r/', sub, '","title":null,"query":"q', nation, '","selftext":null,"author":null,"after":', key * 86400, ',"before":null}')
    block = _text(
        ',"collection":{"name":"n","subreddit":"', sub, '","subreddit_norm":"', F.lower(sub),
        '","after_token":"', F.date_format(F.timestamp_seconds(key * 86400), "yyyy-MM-dd"),
        '","before_token":"open","query":"q', nation, '","author":null,"sort":"asc"}',
    )
    doc = _text(
        '{"version":1,"saved_at":"2024-01-01","run_id":"run', key, '","paginator":{"version":1,"filters":', filters,
        ',"sort":"asc","page_size":100,"max_posts":', nation * 100, ',"cursor":"c","total_fetched":', key, ',"seen_ids":["a"]}',
        F.when(nation < 12, block).otherwise(""), "}",
    )
    request = F.struct(
        F.when(nation == 1, "other").when(nation == 13, "else").when(nation == 14, F.concat(F.lit("r/"), sub)).otherwise(F.lower(sub)).alias("subreddit"),
        F.when(nation.isin(2, 15), "t").cast("string").alias("title"),
        F.when(nation.isin(3, 16), "q").otherwise(_text("q", nation)).alias("query"),
        F.lit(None).cast("string").alias("selftext"),
        F.when(nation.isin(4, 17), "me").cast("string").alias("author"),
        F.when(nation.isin(5, 18), "1999-01-01").otherwise(_text(key * 86400)).alias("after"),
        F.when(nation.isin(6, 19), "2030-01-01").cast("string").alias("before"),
        F.when(nation.isin(7, 20), "desc").otherwise("asc").alias("sort"),
    )
    docs = table(spark, sf_dir, "customer", spread=True).select("c_custkey", "c_nationkey", request.alias("request"), doc.alias("value"))
    progress_rows = read_posts_progress(check_posts_documents(docs))
    stored = ["run_id", "total_fetched", "max_posts", "pager_version", "pager_sort", "filters", "collection"]
    return progress_rows.select("c_custkey", "request", F.struct(*stored).alias("stored"))


_MISMATCH_SQL = """CASE WHEN c_nationkey IN (1, 13) THEN 'subreddit' WHEN c_nationkey IN (5, 18) THEN 'after'
    WHEN c_nationkey IN (6, 19) THEN 'before' WHEN c_nationkey = 15 THEN 'title' WHEN c_nationkey IN (3, 16) THEN 'query'
    WHEN c_nationkey IN (4, 17) THEN 'author' WHEN c_nationkey IN (7, 20) THEN 'sort' END"""


@query("identity_mismatch", f"SELECT c_custkey, {_MISMATCH_SQL} AS mismatch FROM customer")
def mismatch(spark, sf_dir):
    pairs = identity_pairs(spark, sf_dir)
    return pairs.select("c_custkey", first_mismatch(pairs).alias("mismatch"))


@query(
    "resume_gate",
    """SELECT c_custkey, CASE WHEN c_nationkey IN (7, 20) THEN 'sort' WHEN c_nationkey = 14 THEN NULL ELSE 'filters' END AS refused
       FROM customer""",
)
def gate(spark, sf_dir):
    return identity_pairs(spark, sf_dir).select("c_custkey", resume_gate().alias("refused"))


@query(
    "collection_lookup",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN n_name
         WHEN 'MACHINERY' THEN CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END
         WHEN 'HOUSEHOLD' THEN CASE WHEN n_regionkey = 0 THEN lower(n_name) ELSE n_name END END AS found
       FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    saved = nation.select(F.col("n_name").alias("name")).unionByName(
        nation.filter("n_regionkey = 0").select(F.lower("n_name").alias("name"))
    )
    seg = F.col("c_mktsegment")
    wanted = (
        F.when(seg == "BUILDING", F.col("n_name"))
        .when(seg == "MACHINERY", F.initcap("n_name"))
        .when(seg == "HOUSEHOLD", F.lower("n_name"))
        .otherwise(F.concat(F.lit("no "), "n_name"))
    )
    requests = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", wanted.alias("wanted")
    )
    return find_collections(requests, saved).select("c_custkey", "found")


@query(
    "run_binding",
    """SELECT c_name AS name, 'r' || c_nationkey AS posts_run, 'r' || o_custkey % 25 AS comments_run
       FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey
       WHERE c_nationkey <> o_custkey % 25""",
)
def binding(spark, sf_dir):
    posts = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), _text("r", F.col("c_nationkey")).alias("run_id"), "c_custkey")
    seen = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    comments = posts.join(seen, F.col("c_custkey") == F.col("o_custkey")).select(
        "name", _text("r", F.col("o_custkey") % 25).alias("run_id")
    )
    return run_binding(posts, comments)


def _catalog_inputs(spark, sf_dir):
    c = table(spark, sf_dir, "customer", spread=True)
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    post_doc = F.when(
        nation == 0, _text('{"version":2,"run_id":" ","paginator":[]}')
    ).otherwise(
        _text('{"version":1,"saved_at":"s', key, '","run_id":"run', key, '","paginator":{"filters":{},"sort":"asc","cursor":null,"total_fetched":',
              key, ',"max_posts":', F.when(nation < 8, F.lit("null")).otherwise((nation * 20).cast("string")), "}}")
    )
    comment_doc = F.when(
        nation == 24, _text('{"version":1,"run_id":"r","comments":{"completed_post_ids":[1],"posts_completed":true,"comments_collected":-1}}')
    ).otherwise(
        _text('{"version":1,"run_id":"run', key, '","comments":{"completed_post_ids":["a","b"],"posts_completed":', key, ',"comments_collected":', nation, "}}")
    )
    posts = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("name"), post_doc.alias("value"))
    comments = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_name").alias("name"), comment_doc.alias("value"))
    return check_posts_documents(posts), check_comments_documents(comments)


@query(
    "posts_document_errors",
    """SELECT c_name AS name, CASE WHEN c_nationkey = 0 THEN 'version: 1 | run_id: non-empty text or null | paginator: object' ELSE '' END AS errors
       FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def posts_errors(spark, sf_dir):
    return _catalog_inputs(spark, sf_dir)[0].select("name", F.array_join("errors", " | ").alias("errors"))


@query(
    "comments_document_errors",
    """SELECT c_name AS name, CASE WHEN c_nationkey = 24 THEN 'comments.completed_post_ids: list of text | '
         || 'comments.posts_completed: integer >= 0 | comments.comments_collected: integer >= 0'
         ELSE '' END AS errors
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def comments_errors(spark, sf_dir):
    return _catalog_inputs(spark, sf_dir)[1].select("name", F.array_join("errors", " | ").alias("errors"))


@query(
    "collections_catalog",
    """WITH x AS (SELECT *, c_mktsegment <> 'BUILDING' AS p, c_mktsegment IN ('BUILDING', 'MACHINERY') AS c FROM customer)
       SELECT c_name AS name,
         CASE WHEN p AND c_nationkey = 0 THEN 'error'
              WHEN p THEN CASE WHEN c_nationkey >= 8 AND c_custkey >= c_nationkey * 20 THEN 'complete' ELSE 'in_progress' END
              WHEN c AND c_nationkey <> 24 THEN 'comments_only' ELSE 'empty' END AS status,
         p AND c_nationkey <> 0 AS has_posts, c AND c_nationkey <> 24 AS has_comments,
         CASE WHEN p AND c_nationkey <> 0 THEN 'run' || c_custkey END AS run_id,
         CASE WHEN p AND c_nationkey <> 0 THEN c_custkey END AS total_fetched,
         CASE WHEN c AND c_nationkey <> 24 THEN c_custkey END AS posts_completed,
         CASE WHEN c AND c_nationkey <> 24 THEN c_nationkey END AS comments_collected
       FROM x WHERE p OR c""",
)
def collections_catalog(spark, sf_dir):
    posts, comments = _catalog_inputs(spark, sf_dir)
    errors = F.array_join("errors", " | ").alias("error")
    p = read_posts_progress(posts).select("name", F.lit(None).cast("string").alias("error"), "run_id", "saved_at", "total_fetched", "max_posts").unionByName(
        posts.filter(F.size("errors") > 0).select("name", errors), allowMissingColumns=True
    )
    c = read_comments_progress(comments).select(
        "name", F.lit(None).cast("string").alias("error"), "posts_completed", "posts_skipped_empty", "comments_collected"
    ).unionByName(comments.filter(F.size("errors") > 0).select("name", errors), allowMissingColumns=True)
    return catalog(p, c).select(
        "name", "status", "has_posts", "has_comments", "run_id", "total_fetched", "posts_completed", "comments_collected"
    )


@query(
    "migratable",
    f"""SELECT c_name AS name FROM (SELECT *, {_MISMATCH_SQL} AS mismatch FROM customer)
        WHERE mismatch IS NULL AND c_mktsegment <> 'FURNITURE' AND c_acctbal >= 0""",
)
def migrations(spark, sf_dir):
    pairs = identity_pairs(spark, sf_dir)
    judged = pairs.select("c_custkey", first_mismatch(pairs).alias("mismatch"))
    c = table(spark, sf_dir, "customer")
    old = c.join(judged, "c_custkey").select(
        F.col("c_name").alias("name"),
        "mismatch",
        F.lit("r1").alias("posts_run"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "r2").otherwise("r1").alias("comments_run"),
    )
    return migratable(old, c.filter("c_acctbal < 0").select(F.col("c_name").alias("name"))).select("name")


@query(
    "free_run_ids",
    """WITH t AS (SELECT c_nationkey AS n, c_mktsegment AS s FROM customer GROUP BY ALL)
       SELECT DISTINCT 'nation_' || n_nationkey AS base,
         CASE WHEN n_regionkey = 0 THEN 'nation_' || n_nationkey WHEN n_regionkey = 1 THEN 'nation_' || n_nationkey || '-2'
              WHEN n_regionkey = 2 THEN 'nation_' || n_nationkey || '-3' ELSE 'nation_' || n_nationkey || '-2' END AS run_id
       FROM nation JOIN t ON n = n_nationkey""",
)
def run_ids(spark, sf_dir):
    """Region 0: nothing taken; 1: the plain id; 2: plain and -2; others: plain and -3."""
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"))
    taken = customers.filter("n_regionkey > 0").select(
        F.explode(
            F.array(base, F.concat(base, F.when(F.col("n_regionkey") == 2, "-2").when(F.col("n_regionkey") > 2, "-3").otherwise("")))
        ).alias("run_id")
    )
    wanted = customers.select(_text(" Nation ", F.col("n_nationkey")).alias("run_id"))
    return free_run_ids(wanted, taken)


@query(
    "spec_violations",
    """SELECT p_partkey, CASE p_type
         WHEN 'ECONOMY' THEN CASE WHEN p_size * 4 > 100 THEN 'limit: integer 1-100' ELSE '' END
         WHEN 'STANDARD' THEN 'subreddit: non-empty text | limit: integer 1-100 | sort: asc or desc'
         WHEN 'LARGE' THEN 'max_posts: positive integer or null | title: non-empty text or null | '
           || 'query: text or null | after: date text, epoch number or null'
         WHEN 'SMALL' THEN CASE WHEN p_size > 25 THEN 'output.chunk_size: positive integer | ' ELSE '' END
           || 'collection.throttle_qps: positive number | comments.skip_empty_posts: true or false'
         ELSE CASE p_size % 4 WHEN 0 THEN 'api: object | comments: object' WHEN 1 THEN 'output: object | logging: object'
           ELSE 'not a JSON object' END END AS errors FROM part""",
)
def spec_checks(spark, sf_dir):
    size = F.col("p_size")
    kind = F.col("p_type")
    spec = (
        F.when(kind == "ECONOMY", _text('{"subreddit":"a","limit":', size * 4, ',"after":1.5,"before":"2020-01-01","max_posts":null}'))
        .when(kind == "STANDARD", F.lit('{"subreddit":"  ","limit":true,"sort":"new"}'))
        .when(kind == "LARGE", F.lit('{"subreddit":"a","max_posts":0,"title":" ","query":5,"after":false}'))
        .when(
            kind == "SMALL",
            _text('{"subreddit":"a","output":{"chunk_size":', F.when(size > 25, F.lit("0")).otherwise(size.cast("string")),
                  '},"collection":{"throttle_qps":0,"max_retries":0},"comments":{"skip_empty_posts":null},"logging":{"level":"info"}}'),
        )
        .when(size % 4 == 0, F.lit('{"subreddit":"a","api":[{"base_url":"x"}],"comments":"tree_limit"}'))
        .when(size % 4 == 1, F.lit('{"subreddit":"a","output":5,"logging":null,"collection":{}}'))
        .when(size % 4 == 2, F.lit('{"subreddit":"a"} x'))
        .otherwise(F.lit("[]"))
    )
    specs = table(spark, sf_dir, "part", spread=True).select("p_partkey", spec.alias("value"))
    return spec_violations(specs).select("p_partkey", F.array_join("errors", " | ").alias("errors"))


# -------------------------------------------------------- masking, logs, api


@query(
    "redact_columns",
    """SELECT event_id, '***REDACTED***' AS author, '***REDACTED***' AS api_key, event_type AS name,
         '***REDACTED***' AS first_token, CAST(user_id AS VARCHAR) AS plain, '***REDACTED***' AS secret_entry FROM events""",
)
def masked(spark, sf_dir):
    user = F.col("user_id").cast("string")
    e = table(spark, sf_dir, "events").select(
        "event_id",
        user.alias("author"),
        F.struct(user.alias("API_Key"), F.col("event_type").alias("name"), F.array(user, "props").alias("tokens")).alias("auth"),
        F.create_map(F.lit("plain"), user, F.lit("my_secret"), F.col("props")).alias("settings"),
    )
    r = redact_columns(e)
    return r.select(
        "event_id",
        "author",
        F.col("auth.API_Key").alias("api_key"),
        F.col("auth.name").alias("name"),
        F.col("auth.tokens")[0].alias("first_token"),
        F.col("settings")["plain"].alias("plain"),
        F.col("settings")["my_secret"].alias("secret_entry"),
    )


@query("redact_props", """SELECT event_id, '{"k":' || regexp_extract(props, '[0-9]+') || ',"password":"***REDACTED***"}' AS props FROM events""")
def masked_props(spark, sf_dir):
    props = F.regexp_replace("props", r"\}$", ',"password":"x"}')
    return table(spark, sf_dir, "events").select("event_id", redact_json_map(props).alias("props"))


@query(
    "redact_nested",
    """SELECT event_id, '{"n":{"token":"***REDACTED***","k":' || regexp_extract(props, '[0-9]+') || '},"l":[{"password":"***REDACTED***"},'
      || event_id || '],"secrets":["***REDACTED***",{"id":true}],"h":"\\ud83d","big":[1e400,' || repeat('9', 40) || '],'
      || '"token":"***REDACTED***","token":"***REDACTED***","deep":' || repeat('[', 60) || event_id || repeat(']', 60) || '}' AS props FROM events""",
)
def masked_nested(spark, sf_dir):
    number = F.regexp_extract("props", "[0-9]+", 0)
    text = _text('{"n":{"token":"S","k":', number, '},"l":[{"password":"p"},', F.col("event_id"), '],"secrets":["a",{"id":true}],',
                 r'"h":"\ud83d", "big":[1e400, ' + "9" * 40 + '],"token":1e-3,"token" : null,"deep":' + "[" * 60, F.col("event_id"), "]" * 60 + "}")
    return table(spark, sf_dir, "events").select("event_id", redact_json_map(text).alias("props"))


def event_log(spark, sf_dir) -> DataFrame:
    """Log lines of one run per user, in event order."""
    kind, key = F.col("event_type"), F.col("event_id")
    logger = (
        F.when(kind == "view", "app.paginator").when(kind == "click", "app.collector").when(kind == "signup", "app.checkpoint").otherwise("app.rate_limit")
    )
    message = (
        F.when(kind == "view", _text("Page ", key, ": 5 new posts (", key * 5, "/900000 total)"))
        .when(kind == "click", _text("Post p", key, ": ", key % 7, " comments (", key, " posts done)"))
        .when(kind == "signup", _text("Comment checkpoint saved: ", key, " posts done, ", key * 2, " comments (x)"))
        .when(kind == "purchase", _text("Waiting 1.00s before retry 1/5"))
        .otherwise(_text("request failed"))
    )
    level = F.when(kind == "purchase", "WARNING").when(kind == "error", "ERROR").otherwise("INFO")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), key.alias("seq"), F.col("ts").cast("timestamp").alias("logged_at"),
        level.alias("level"), logger.alias("logger"), message.alias("message"),
    )


_LOG_SQL = """WITH s AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS saved FROM events GROUP BY 1),
  p AS (SELECT e.user_id AS run_id,
   coalesce(max(event_id) FILTER (event_type = 'view'), 0) AS pages,
   coalesce(max(event_id) FILTER (event_type = 'view'), 0) * 5 AS posts,
   count(*) FILTER (event_type = 'purchase') AS retry_waits, count(*) FILTER (event_type = 'error') AS errors,
   coalesce(max_by(event_type, event_id) FILTER (event_type <> 'error') = 'purchase', false) AS waiting_on_rate_limit,
   count(*) FILTER (event_type IN ('click', 'signup')) > 0 AS in_comment_phase,
   coalesce(max(event_id) FILTER (event_type IN ('click', 'signup')), 0) AS comment_posts_done,
   CAST(coalesce(max(saved) * 2, 0) + coalesce(sum(event_id % 7) FILTER (event_type = 'click' AND event_id > coalesce(saved, -1)), 0) AS BIGINT) AS comments_collected,
   CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS duration_secs
   FROM events e JOIN s ON e.user_id = s.user_id GROUP BY 1)"""


@query("log_progress", f"{_LOG_SQL} SELECT * EXCLUDE (duration_secs) FROM p")
def log_state(spark, sf_dir):
    return log_progress(event_log(spark, sf_dir)).drop("last_message")


@query("run_report", f"{_LOG_SQL} SELECT run_id, pages, retry_waits, duration_secs, pages + retry_waits AS requests FROM p")
def log_report(spark, sf_dir):
    return run_report(event_log(spark, sf_dir)).select("run_id", "pages", "retry_waits", "duration_secs", "requests")


def event_responses(spark, sf_dir) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    status = F.when(kind == "view", 200).when(kind == "click", 429).when(kind == "signup", 422).when(kind == "purchase", 503)
    headers = (
        F.when((kind == "click") & (user < 50), F.create_map(F.lit("retry-after"), user.cast("string"), F.lit("X-RateLimit-Reset"), F.lit("99")))
        .when((kind == "click") & (user < 100), F.create_map(F.lit("Retry-After"), F.lit("Mon, 01 Jan 2024 00:01:30 GMT")))
        .when(kind == "click", F.create_map(F.lit("X-RATELIMIT-RESET"), F.lit("soon")))
        .otherwise(F.create_map(F.lit("X-RateLimit-Reset"), F.lit("42")))
    )
    body = (
        F.when((kind == "view") & (user < 50), F.lit('{"data":[]}'))
        .when((kind == "view") & (user < 75), F.lit('{"error":null,"message":"Query timed out"}'))
        .when((kind == "view") & (user < 100), F.lit('{"error":"bad field"}'))
        .when(kind == "view", F.lit("<html>"))
        .when((kind == "signup") & (user < 80), F.lit('{"data":null,"error":"Timeout. Maybe slow down a bit"}'))
        .otherwise(F.lit('{"error":"invalid parameter"}'))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", user.alias("request_id"), F.col("ts").cast("timestamp").alias("seq"),
        status.alias("status"), headers.alias("headers"), body.alias("body"),
    )


_AUDIT_SQL = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS attempt FROM events),
  b AS (SELECT event_id, CAST(attempt AS BIGINT) AS attempt, event_type, user_id,
    CASE event_type WHEN 'view' THEN CASE WHEN user_id < 50 THEN 'ok' WHEN user_id < 75 THEN 'query_timeout' ELSE 'api_error' END
      WHEN 'click' THEN 'rate_limited' WHEN 'signup' THEN CASE WHEN user_id < 80 THEN 'query_timeout' ELSE 'api_error' END
      WHEN 'purchase' THEN 'api_error' ELSE 'network_error' END AS outcome,
    event_type IN ('click', 'purchase', 'error') OR (event_type = 'signup' AND user_id < 80) AS retryable FROM a),
  r AS (SELECT event_id, attempt, outcome, retryable, retryable AND attempt < 5 AS retried,
    CASE WHEN retryable AND attempt < 5 THEN greatest(least(pow(2.0, attempt), 60.0),
      CASE WHEN event_type = 'click' AND user_id < 50 THEN CAST(user_id AS DOUBLE)
           WHEN event_type = 'click' AND user_id < 100 THEN 90.0 ELSE 0.0 END) END AS wait_secs FROM b)"""


def _audited(spark, sf_dir):
    return audit_responses(with_attempts(event_responses(spark, sf_dir)), now=F.lit("2024-01-01").cast("timestamp"))


@query("response_audit", f"{_AUDIT_SQL} SELECT * FROM r")
def audit(spark, sf_dir):
    return _audited(spark, sf_dir).select("event_id", "attempt", "outcome", "retryable", "retried", "wait_secs")


@query(
    "outcome_counts",
    f"""{_AUDIT_SQL} SELECT outcome, count(*) AS responses, count(*) FILTER (retryable) AS retryable,
          count(*) FILTER (retried) AS retried, max(wait_secs) AS longest_wait FROM r GROUP BY outcome""",
)
def outcomes(spark, sf_dir):
    return outcome_counts(_audited(spark, sf_dir))


# --------------------------------------------------------------- streaming


def _landing(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/landed-{uuid.uuid4().hex}"


def _event_pages(spark, sf_dir, score) -> DataFrame:
    """Every event as a search page with one post; signups come without an id."""
    return table(spark, sf_dir, "events", spread=True).select(
        "event_type",
        _text(
            '{"data":[{"id":"', F.when(F.col("event_type") == "signup", " ").otherwise(_text("e", F.col("event_id"))),
            '","subreddit":"', F.col("event_type"), '","score":', score, ',"created_utc":', F.col("event_id"), "}]}",
        ).alias("value"),
    )


_INGEST_SQL = """SELECT CASE event_type WHEN 'signup' THEN ' ' ELSE 'e' || event_id END AS id, event_type AS subreddit,
    user_id AS score, CAST(event_id AS DOUBLE) AS created_utc FROM events"""


@query("stream_ingest_posts", _INGEST_SQL)
def stream_posts(spark, sf_dir):
    """Pages land in two rounds, the second repeating known posts; a resume adds nothing twice."""
    landed = _landing(spark)
    store = Store(spark, f"{landed}/store")
    first = _event_pages(spark, sf_dir, F.col("user_id"))
    again = _event_pages(spark, sf_dir, F.lit("-1")).filter("event_type <> 'signup'")
    for pages in (first, again):
        pages.select("value").write.mode("append").text(f"{landed}/pages")
        ingest_posts(store, f"{landed}/pages", "run", f"{landed}/progress", page_per_line=True)
    return store.read("posts", "run").select("id", "subreddit", "score", "created_utc")


@query("stream_ingest_stateful", _INGEST_SQL)
def stream_posts_stateful(spark, sf_dir):
    """Differing copies inside a page, between pages and between rounds: the first one stays.  The first round stops at a cap."""
    landed = _landing(spark)
    store = Store(spark, f"{landed}/store")
    pages = _event_pages(spark, sf_dir, F.col("user_id"))
    known = F.col("event_type") != "signup"
    # The same post again in its own page, with another score, and a page that holds nothing.
    twice = F.when(known, F.regexp_replace("value", r'(\{"id.*)\]\}$', r'$1,{"id":"QQ","score":-1}]}')).otherwise(F.col("value"))
    doubled = pages.withColumn("value", F.replace(twice, F.lit("QQ"), F.regexp_extract("value", r'"id":"(e\d+)"', 1)))
    again = _event_pages(spark, sf_dir, F.lit("-2")).filter(known)
    for rows, cap in ((doubled, 100), (again, None)):
        rows.select("value").write.mode("append").text(f"{landed}/pages")
        ingest_posts_stateful(store, f"{landed}/pages", "run", f"{landed}/progress", max_posts=cap, page_per_line=True)
    return store.read("posts", "run").select("id", "subreddit", "score", "created_utc")


@query(
    "stream_first_arrivals",
    """SELECT 'e' || event_id AS id, count(*) OVER () AS known FROM events WHERE event_type <> 'signup'""",
)
def stream_first_arrivals(spark, sf_dir):
    """The ids that the state knows after two rounds, read from the checkpoint of the query."""
    landed = _landing(spark)
    store = Store(spark, f"{landed}/store")
    for _ in range(2):
        _event_pages(spark, sf_dir, F.col("user_id")).select("value").write.mode("append").text(f"{landed}/pages")
        ingest_posts_stateful(store, f"{landed}/pages", "run", f"{landed}/progress", page_per_line=True)
    arrivals = known_arrivals(spark, f"{landed}/progress")
    return arrivals.select("id", F.lit(arrivals.count()).cast("bigint").alias("known"))


@query(
    "stream_ingest_comments",
    """SELECT 'p' || event_id AS post_id, 'c' || event_id AS comment_id, 0 AS depth, CAST(user_id AS BIGINT) AS score FROM events
       UNION ALL SELECT 'p' || event_id, 'd' || event_id, 1, NULL FROM events""",
)
def stream_comments(spark, sf_dir):
    e = table(spark, sf_dir, "events", spread=True)
    key = F.col("event_id")
    payload = _text(
        '{"data":[{"kind":"t1","data":{"id":"c', key, '","score":', F.col("user_id"),
        ',"replies":{"data":{"children":[{"kind":"t1","data":{"id":"d', key, '"}}]}}}}]}',
    )
    landed = _landing(spark)
    e.select(_text("p", key).alias("post_id"), payload.alias("payload")).write.json(f"{landed}/trees")
    store = Store(spark, f"{landed}/store")
    for _ in range(2):  # the second call finds nothing new
        ingest_comments(store, f"{landed}/trees", "run", f"{landed}/progress")
    return store.read("comments", "run").select("post_id", "comment_id", "depth", "score")


@query(
    "stream_log_progress",
    """WITH s AS (SELECT max(event_id) FILTER (event_type = 'signup') AS saved FROM events)
       SELECT 'run' AS run_id, max(event_id) FILTER (event_type = 'view') AS pages,
         max(event_id) FILTER (event_type = 'view') * 5 AS posts,
         count(*) FILTER (event_type = 'purchase') AS retry_waits, count(*) FILTER (event_type = 'error') AS errors,
         max_by(event_type, event_id) FILTER (event_type <> 'error') = 'purchase' AS waiting_on_rate_limit, true AS in_comment_phase,
         max(event_id) FILTER (event_type IN ('click', 'signup')) AS comment_posts_done,
         CAST(max(saved) * 2 + coalesce(sum(event_id % 7) FILTER (event_type = 'click' AND event_id > saved), 0) AS BIGINT) AS comments_collected
       FROM events, s""",
)
def stream_log_progress(spark, sf_dir):
    """The event log landed as text, collected by a stream, and summed up."""
    landed = _landing(spark)
    store = Store(spark, f"{landed}/store")
    line = F.concat_ws(" | ", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"), F.rpad("level", 8, " "), "logger", "message")
    event_log(spark, sf_dir).orderBy("seq").select(line.alias("value")).write.text(f"{landed}/log")
    ingest_logs(store, f"{landed}/log", "run", f"{landed}/progress")
    return log_progress(store.read("log_lines", "run")).drop("last_message")
