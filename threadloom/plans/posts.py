"""Queries over posts: normalizing, search, deduplication, paging.

``events`` and ``documents`` stand in for posts.  Raw JSON is written from their
columns in Spark, so the SQL can start from the columns themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.functions import scalars as S
from threadloom.operators.dedup import all_known_ids, first_seen, reconcile_stored, unseen
from threadloom.operators.normalize import normalize_posts
from threadloom.operators.position import page_cursors, page_plan, stall_audit
from threadloom.operators.search import Search, matching, search_posts, time_order
from threadloom.plans.registry import query, table
from threadloom.sources.lines import line_status, strict_lines
from threadloom.sources.payloads import explode_pages, page_errors


def epoch(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def raw_event_posts(spark, sf_dir: str) -> DataFrame:
    """Events as raw JSON posts, with the type mix that loosely typed JSON has."""
    e = table(spark, sf_dir, "events", spread=True)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.floor(micros / 1000000).cast("string")
    kind = F.col("event_type")
    comments = (
        F.when(kind == "view", F.col("user_id").cast("string"))
        .when(kind == "click", F.concat(F.col("user_id").cast("string"), F.lit(".0")))
        .when(kind == "signup", F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"')))
        .when(kind == "error", F.lit("true"))
        .otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    )
    created = (
        F.when(kind == "signup", F.concat(F.lit('"'), seconds, F.lit('"')))
        .when(kind == "purchase", seconds)
        .otherwise((micros / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(20,6)").cast("string"))
    )
    link = (
        F.when(kind == "view", F.concat(F.lit('" /r/view/'), F.col("event_id").cast("string"), F.lit(' "')))
        .when(kind == "click", F.lit('"http://example.org/c"'))
        .when(kind == "error", F.lit("7"))
        .otherwise(F.lit('""'))
    )
    value = F.concat(
        F.lit('{"id":"e'), F.col("event_id").cast("string"),
        F.lit('","subreddit":"'), kind,
        F.lit('","title":"event '), F.col("event_id").cast("string"),
        F.lit('","author":"u'), F.col("user_id").cast("string"),
        F.lit('","score":'), F.col("value").cast("string"),
        F.lit(',"num_comments":'), comments,
        F.lit(',"created_utc":'), created,
        F.lit(',"permalink":'), link,
        F.lit(',"selftext":null,"extra":'), F.col("props"), F.lit("}"),
    )
    return e.select(value.alias("value"))


_EVENT_POSTS_SQL = """
  SELECT 'e' || event_id AS id, event_type AS subreddit, 'event ' || event_id AS title,
         CAST(NULL AS VARCHAR) AS selftext, 'u' || user_id AS author,
         CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS score,
         CASE WHEN event_type IN ('view', 'click') THEN user_id END AS num_comments,
         CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE)
              ELSE epoch_us(ts) / 1000000.0 END AS created_utc,
         CASE WHEN event_type = 'signup' THEN NULL
              WHEN event_type = 'purchase' OR epoch_us(ts) % 1000000 = 0
                THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS created_iso,
         CAST(NULL AS VARCHAR) AS url,
         CASE event_type WHEN 'view' THEN 'https://www.reddit.com/r/view/' || event_id
              WHEN 'click' THEN 'http://example.org/c'
              ELSE 'https://www.reddit.com/r/' || event_type || '/comments/e' || event_id || '/' END AS permalink
  FROM events
"""


@query("normalize_posts", _EVENT_POSTS_SQL)
def normalized_events(spark, sf_dir):
    return normalize_posts(raw_event_posts(spark, sf_dir))


@query(
    "search_posts_window",
    f"""SELECT id, author, created_iso, score, permalink FROM ({_EVENT_POSTS_SQL})
        WHERE subreddit = 'click' AND created_utc >= epoch(TIMESTAMP '2024-01-05')
          AND created_utc <= epoch(TIMESTAMP '2024-01-20 12:00:00')
        ORDER BY created_utc DESC, id LIMIT 500""",
)
def search_window(spark, sf_dir):
    spec = Search(
        subreddit="r/Click",
        after="2024-01-05",
        before="2024-01-20T12:00:00",
        sort="desc",
        max_posts=500,
        fields="id, author, created_iso, score, permalink",
    )
    return search_posts(normalize_posts(raw_event_posts(spark, sf_dir)), spec)


def document_posts(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("selftext"),
        F.concat(F.lit("w_"), "lang").alias("author"),
        F.when(F.col("lang") == "de", 0).when(F.col("lang") != "fr", F.col("n_chars")).cast("bigint").alias("num_comments"),
        (F.col("doc_id") * 60).cast("double").alias("created_utc"),
    )


@query(
    "search_keyword",
    """SELECT CAST(doc_id AS VARCHAR) AS id, source AS subreddit, length(text) AS body_length
       FROM documents
       WHERE lower(source) = 'src3' AND lang = 'en'
         AND (contains(lower(split_part(text, chr(10), 1)), 'the') OR contains(lower(text), 'the'))
         AND contains(lower(text), 'and')""",
)
def search_keyword(spark, sf_dir):
    spec = Search(subreddit="r/SRC3", author="u/w_en", query="The", selftext="AND")
    found = matching(document_posts(spark, sf_dir), spec)
    return found.select("id", "subreddit", F.length("selftext").cast("bigint").alias("body_length"))


@query(
    "typed_coercion",
    """SELECT p_partkey,
         CASE p_type WHEN 'ECONOMY' THEN CAST(p_size AS BIGINT) WHEN 'STANDARD' THEN CAST(p_size AS BIGINT)
              WHEN 'LARGE' THEN NULL WHEN 'SMALL' THEN NULL
              ELSE CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END END AS as_int,
         CASE p_type WHEN 'ECONOMY' THEN CAST(p_size AS VARCHAR) WHEN 'STANDARD' THEN p_size || '.0'
              WHEN 'LARGE' THEN CAST(p_size AS VARCHAR) WHEN 'SMALL' THEN 'true'
              ELSE CAST(p_retailprice AS VARCHAR) END AS as_text
       FROM part""",
)
def typed_coercion(spark, sf_dir):
    size = F.col("p_size").cast("string")
    token = (
        F.when(F.col("p_type") == "ECONOMY", size)
        .when(F.col("p_type") == "STANDARD", F.concat(size, F.lit(".0")))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit('"'), size, F.lit('"')))
        .when(F.col("p_type") == "SMALL", F.lit("true"))
        .otherwise(F.col("p_retailprice").cast("string"))
    )
    raw = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit('{"id":'), token, F.lit(',"score":'), token, F.lit("}")).alias("value")
    )
    return normalize_posts(raw).select("p_partkey", F.col("score").alias("as_int"), F.col("id").alias("as_text"))


# ------------------------------------------------------------------ dedup


@query(
    "first_seen_events",
    """SELECT event_id, ts_us FROM (
         SELECT event_id, epoch_us(ts) AS ts_us, event_type,
                row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS rn
         FROM events) WHERE rn = 1 OR event_type = 'error'""",
)
def first_seen_events(spark, sf_dir):
    """First event per user; errors carry a blank id, so all of them stay."""
    e = table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("id"),
    )
    return first_seen(e, [F.col("ts_us"), F.col("event_id")]).select("event_id", "ts_us")


_LINE_ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_LINE_ORDER = _LINE_ORDER_SQL.split(", ")


@query(
    "first_seen_lineitem",
    f"""SELECT {_LINE_ORDER_SQL.replace(', l_shipdate', '')} FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER_SQL}) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def first_seen_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        *_LINE_ORDER,
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
    )
    return first_seen(lines, [F.col(c) for c in _LINE_ORDER]).select(*_LINE_ORDER[:-1])


@query(
    "first_seen_documents",
    """SELECT min(doc_id) AS doc_id, sha256(trim(text)) AS text_hash FROM documents
       GROUP BY trim(text)""",
)
def first_seen_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("body"))
    keyed = d.select("doc_id", F.sha2("body", 256).alias("text_hash"))
    return first_seen(keyed, [F.col("doc_id")], "text_hash").select("doc_id", "text_hash")


@query(
    "unseen_lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def unseen_lineitem(spark, sf_dir):
    batch = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return unseen(batch, seen, "id", "o_orderkey").drop("id")


@query(
    "known_ids",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
       UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem""",
)
def known_ids(spark, sf_dir):
    return all_known_ids(
        (table(spark, sf_dir, "orders"), "o_orderkey"), (table(spark, sf_dir, "lineitem"), "l_orderkey")
    )


@query(
    "reconcile_stored",
    """SELECT CAST(doc_id AS VARCHAR) AS id FROM documents
       EXCEPT SELECT CAST(doc_id AS VARCHAR) FROM labels""",
)
def reconcile(spark, sf_dir):
    noted = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return reconcile_stored(noted, table(spark, sf_dir, "documents"), "doc_id")


# ----------------------------------------------------------------- paging


@query(
    "page_plan",
    """SELECT event_id, CAST(rn - 1 AS BIGINT) AS pos, CAST((rn - 1) // 100 + 1 AS BIGINT) AS page_no FROM (
         SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)""",
)
def event_pages(spark, sf_dir):
    return page_plan(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], 100).select(
        "event_id", "pos", "page_no"
    )


@query(
    "page_plan_lineitem",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(rn - 1 AS BIGINT) AS pos,
          CAST((rn - 1) // 100 + 1 AS BIGINT) AS page_no FROM (
         SELECT *, row_number() OVER (ORDER BY {_LINE_ORDER_SQL}) AS rn FROM lineitem)""",
)
def lineitem_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_ORDER)
    return page_plan(lines, _LINE_ORDER, 100).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos", "page_no"
    )


@query(
    "page_plan_desc",
    """SELECT event_id, CAST(rn - 1 AS BIGINT) AS pos, CAST((rn - 1) // 25 + 1 AS BIGINT) AS page_no FROM (
         SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM events)""",
)
def event_pages_newest_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return page_plan(events, time_order("desc", "ts", "event_id"), 25).select("event_id", "pos", "page_no")


@query(
    "first_seen_ties",
    """SELECT kind, CASE WHEN kind IS NULL THEN count(*) ELSE 1 END AS kept FROM (
         SELECT CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events) GROUP BY kind""",
)
def first_seen_under_ties(spark, sf_dir):
    """All rows share one place in the order; those without an id all stay."""
    kinds = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return first_seen(kinds, [F.lit(1)], "kind").groupBy("kind").agg(F.count("*").alias("kept"))


@query(
    "page_cursors",
    """SELECT page_no, page_rows, new_rows,
         CASE WHEN c = floor(c) THEN CAST(CAST(c AS BIGINT) AS VARCHAR) ELSE CAST(c AS VARCHAR) END AS cursor FROM (
       SELECT page_no, count(*) AS page_rows, count(*) FILTER (event_type = 'signup') AS new_rows,
         min(epoch_us(ts) // 1000000)::DOUBLE - CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 0 ELSE 1 END AS c
       FROM (SELECT *, CAST((row_number() OVER (ORDER BY ts DESC, event_id) - 1) // 5 + 1 AS BIGINT) AS page_no FROM events)
       GROUP BY page_no)""",
)
def event_page_cursors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    # Newest first: position by the negated time keeps one ascending order.
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    pages = page_plan(e.withColumn("down", -ts), ["down", "event_id"], 5)
    pages = pages.withColumn("created_utc", F.floor(ts / 1000000).cast("double"))
    cursors = page_cursors(pages, sort="desc", new=F.col("event_type") == "signup")
    return cursors.select("page_no", "page_rows", "new_rows", S.clean_ts("cursor").alias("cursor"))


@query(
    "stall_audit",
    """WITH p AS (
         SELECT page_no, count(*) AS page_rows, epoch(max(date_trunc('day', ts))) AS cursor FROM (
           SELECT ts, CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 25 + 1 AS BIGINT) AS page_no FROM events)
         GROUP BY page_no)
       SELECT page_no, page_rows, CAST(cursor AS DOUBLE) AS cursor,
         CAST(lag(cursor) OVER (ORDER BY page_no) AS DOUBLE) AS sent_cursor,
         page_rows >= 25 AND cursor IS NOT DISTINCT FROM lag(cursor) OVER (ORDER BY page_no) AS stalled
       FROM p""",
)
def event_stalls(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    pages = page_plan(e, ["ts", "event_id"], 25).withColumn(
        "created_utc", F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp"))).cast("double")
    )
    log = page_cursors(pages).select("page_no", "page_rows", "cursor")
    return stall_audit(log, 25)


# --------------------------------------------------------- lines and pages


def _document_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    body = F.to_json(F.struct("doc_id", "text"))
    return d.select(
        "doc_id",
        F.col("source").alias("file"),
        F.when(F.col("lang") == "en", body)
        .when(F.col("lang") == "de", F.concat(F.lit("["), body, F.lit("]")))
        .when(F.col("lang") == "fr", F.concat(body, F.lit(" trailing")))
        .otherwise(F.lit(" \t "))
        .alias("value"),
    )


@query(
    "line_status",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'ok' WHEN 'de' THEN 'corrupt' WHEN 'fr' THEN 'corrupt'
         ELSE 'blank' END AS status FROM documents""",
)
def document_line_status(spark, sf_dir):
    return _document_lines(spark, sf_dir).select("doc_id", line_status("value").alias("status"))


@query("strict_lines", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def document_strict_lines(spark, sf_dir):
    lines = _document_lines(spark, sf_dir).withColumn(
        "value", F.when(F.col("value").startswith("{") & F.col("value").endswith("}"), F.col("value")).otherwise("")
    )
    return strict_lines(lines).select("doc_id", F.col("file").alias("source"))


@query(
    "search_page_items",
    """SELECT o_orderkey, 0 AS pos, 'a' || o_orderkey AS id, CAST(o_custkey AS BIGINT) AS score FROM orders
       UNION ALL SELECT o_orderkey, 2, 'b' || o_orderkey, NULL FROM orders""",
)
def search_page_items(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    payload = F.concat(
        F.lit('{"data":[{"id":"a'), key, F.lit('","score":'), F.col("o_custkey").cast("string"),
        F.lit('},"junk",{"id":"b'), key, F.lit('"},null,[1]],"error_free":true}'),
    )
    pages = table(spark, sf_dir, "orders", spread=True).select("o_orderkey", payload.alias("payload"))
    return normalize_posts(explode_pages(pages)).select("o_orderkey", "pos", "id", "score")


_PAGE_FORMS = ('{"data":[K]}', '{"data":[K', "<html>K", '[{"data":[K]}]', '{"data":[K]} K', "", '{"data":{"a":K}}', "{}", '{"data":null}', '["data"]')


@query(
    "page_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (6, 8) THEN 'no list under data' ELSE 'not exactly one JSON object' END AS page_error
       FROM orders WHERE o_orderkey % 10 NOT IN (0, 7)""",
)
def unusable_pages(spark, sf_dir):
    """Torn, wrapped, doubled, empty and mistyped pages come out with their reason; good ones do not."""
    form = F.element_at(F.array(*map(F.lit, _PAGE_FORMS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    payload = F.replace(form, F.lit("K"), F.col("o_orderkey").cast("string"))
    return page_errors(table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload"))).select("o_orderkey", "page_error")


@query(
    "time_bounds",
    """SELECT p_partkey, CASE p_type
         WHEN 'ECONOMY' THEN epoch(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * p_size)
         WHEN 'STANDARD' THEN CAST(p_size * 1000 AS DOUBLE) + 0.5
         WHEN 'LARGE' THEN epoch(TIMESTAMP '2024-03-01' - INTERVAL 1 MONTH * p_size)
         WHEN 'SMALL' THEN epoch(TIMESTAMP '2024-03-01' - INTERVAL 1 HOUR * p_size) END AS bound
       FROM part""",
)
def time_bounds(spark, sf_dir):
    size = F.col("p_size")
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.date_add(F.lit("2024-01-01").cast("date"), size).cast("string"))
        .when(F.col("p_type") == "STANDARD", F.concat((size * 1000).cast("string"), F.lit(".5")))
        .when(F.col("p_type") == "LARGE", F.concat(size.cast("string"), F.lit("months")))
        .when(F.col("p_type") == "SMALL", F.concat(size.cast("string"), F.lit(" Hour")))
        .otherwise(F.lit("soon"))
    )
    now = F.lit("2024-03-01").cast("timestamp")
    return table(spark, sf_dir, "part").select("p_partkey", S.time_bound(text, now).alias("bound"))


@query(
    "id_parts",
    """SELECT c_custkey,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'c' || c_custkey WHEN 'MACHINERY' THEN 'p' || c_custkey
              WHEN 'HOUSEHOLD' THEN NULL ELSE 'x' || c_custkey END AS bare_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'comment' WHEN 'MACHINERY' THEN 'post'
              WHEN 'HOUSEHOLD' THEN NULL ELSE 'unknown' END AS kind,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN NULL ELSE c_name END AS author,
         left(c_name, 12) AS snippet
       FROM customer""",
)
def id_parts(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    seg = F.col("c_mktsegment")
    raw = (
        F.when(seg == "BUILDING", F.concat(F.lit(" t1_c"), key))
        .when(seg == "MACHINERY", F.concat(F.lit("t3_p"), key, F.lit("\t")))
        .when(seg == "HOUSEHOLD", F.lit("   "))
        .otherwise(F.concat(F.lit("x"), key))
    )
    author = F.when(seg == "HOUSEHOLD", F.lit(" ")).otherwise(F.concat(F.lit(" u/"), "c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        S.bare_id(raw).alias("bare_id"),
        S.parent_kind(raw).alias("kind"),
        S.author_name(author).alias("author"),
        S.body_snippet("c_name", 12).alias("snippet"),
    )
