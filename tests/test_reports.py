import json

from pyspark.sql import functions as F

from threadloom.operators.logs import log_progress, run_report
from threadloom.operators.redact import redact_columns, redact_json_map
from threadloom.operators.responses import audit_responses, outcome_counts, with_attempts


def lines(spark, *rows):
    data = [("r", i, f"2026-01-01 00:{i:02d}:00", *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, seq int, at string, level string, logger string, message string").withColumn(
        "logged_at", F.col("at").cast("timestamp"))


PAGE = ("INFO", "x.paginator", "Page 1: 5 new posts (5/10 total)")
WAIT = ("WARNING", "x.rate_limit", "Waiting 1.00s before retry 1/5 (HTTP 429)")


def test_pages_and_waits(spark):
    r = log_progress(lines(spark, PAGE, WAIT)).first()
    assert (r.pages, r.posts, r.retry_waits, r.waiting_on_rate_limit, r.last_message) == (1, 5, 1, True, WAIT[2])
    r = log_progress(lines(spark, PAGE, WAIT, ("INFO", "x.paginator", "Page 2: 5 new posts (10 total)"))).first()
    assert (r.pages, r.posts, r.waiting_on_rate_limit) == (2, 10, False)
    r = log_progress(lines(spark, WAIT, ("INFO", "x.rate_limit", "Rate limiting: waiting 0.5s before next request"))).first()
    assert not r.waiting_on_rate_limit and not r.in_comment_phase


def test_comment_counters(spark):
    post = lambda n, m: ("INFO", "x.collector", f"Post p{m}: {n} comments ({m} posts done)")
    saved = ("INFO", "x.checkpoint", "Comment checkpoint saved: 7 posts done, 40 comments (f)")
    r = log_progress(lines(spark, post(3, 1))).first()
    assert (r.comments_collected, r.comment_posts_done, r.in_comment_phase) == (3, 1, True)
    r = log_progress(lines(spark, post(3, 1), saved, post(2, 8), post(1, 9))).first()
    assert (r.comments_collected, r.comment_posts_done) == (43, 9)
    r = log_progress(lines(spark, post(3, 1), ("ERROR", "x.collector", "boom"), saved)).first()
    assert (r.comments_collected, r.comment_posts_done, r.errors) == (40, 7, 1)


def test_run_report(spark):
    r = run_report(lines(spark, PAGE, WAIT, WAIT)).first()
    assert (r.duration_secs, r.requests) == (120, 3)


def audited(spark, *rows):
    data = [(i, "q", *row) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, request_id string, status int, headers map<string,string>, body string, attempt int")
    return audit_responses(df, now=F.lit("2024-01-01").cast("timestamp"))


def test_response_classes(spark):
    slow = json.dumps({"data": None, "error": "Timeout. Maybe slow down a bit"})
    df = audited(
        spark,
        (200, {}, '{"data":[]}', 0),
        (200, {}, '{"error":"Query timed out"}', 0),
        (200, {}, '{"error":null}', 0),
        (200, {}, "[]", 0),
        (200, {}, "<html>", 0),
        (422, {"X-RateLimit-Reset": "42"}, slow, 0),
        (422, {}, '{"error":"invalid parameter"}', 0),
        (422, {}, '{"error":"x","message":"time-out"}', 1),
        (400, {}, slow, 0),
        (429, {"retry-after": "42"}, "", 0),
        (429, {}, "", 20),
        (503, {"Retry-After": "42"}, "", 3),
        (None, None, None, 4),
        (404, {}, None, 0),
    )
    got = [(r.outcome, r.retryable, r.wait_secs) for r in df.orderBy("i").collect()]
    assert got == [
        ("ok", False, None), ("query_timeout", False, None), ("api_error", False, None), ("api_error", False, None),
        ("api_error", False, None), ("query_timeout", True, 1.0), ("api_error", False, None), ("query_timeout", True, 2.0),
        ("api_error", False, None), ("rate_limited", True, 42.0), ("rate_limited", True, None), ("api_error", True, 8.0),
        ("network_error", True, 16.0), ("api_error", False, None)]
    counts = {r.outcome: (r.responses, r.retried) for r in outcome_counts(df).collect()}
    assert counts["rate_limited"] == (2, 1) and counts["ok"] == (1, 0)


def test_attempt_numbers(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2)], "request_id string, seq int")
    assert {(r.request_id, r.seq): r.attempt for r in with_attempts(df).collect()} == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 1): 0}


def test_redaction(spark):
    df = spark.sql("""SELECT 'abc' AS api_key, named_struct('token', 't', 'name', 'x', 'Password', array('p')) AS nested,
        array(named_struct('auth', 1, 'id', 2)) AS credentials, array('a', 'b') AS secrets,
        map('monkey', array('m'), 'plain', array('p')) AS settings, CAST(NULL AS STRUCT<token: STRING>) AS gone, 'me' AS author""")
    r = redact_columns(df).first().asDict(recursive=True)
    hidden = "***REDACTED***"
    assert r["api_key"] == r["author"] == hidden
    assert r["nested"] == {"token": hidden, "name": "x", "Password": [hidden]}
    assert r["credentials"] == [{"auth": hidden, "id": 2}] and r["secrets"] == [hidden, hidden]
    assert r["settings"] == {"monkey": [hidden], "plain": ["p"]} and r["gone"] is None
    assert redact_columns(df, "^api").first().author == "me"
    text = spark.createDataFrame([('{"a":"1","my_token":"2"}',)], "v string").select(redact_json_map("v")).first()[0]
    assert json.loads(text) == {"a": "1", "my_token": hidden}
    nested = '{"k":5,"n":{"token":"S","x":1.5},"l":[{"password":"p"},true],"secrets":["a",{"b":null}],"é":"\\u00e9"}'
    values = [nested, None, "[1]", "{broken", '{"token":{"a":1}}']
    got = [r[0] and json.loads(r[0]) for r in spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).select(redact_json_map("v")).collect()]
    assert got == [
        {"k": 5, "n": {"token": hidden, "x": 1.5}, "l": [{"password": hidden}, True], "secrets": [hidden, {"b": None}], "é": "é"},
        None, None, None, {"token": {"a": 1}},
    ]


def test_redaction_keeps_what_is_written(spark):
    """Half surrogates, long and large numbers, repeated keys and any depth; anything but one object is null."""
    hidden, deep = '"***REDACTED***"', 20_000
    cases = {
        r'{"a":"\ud83d", "\u0074oken":"\ud83d"}': r'{"a":"\ud83d","\u0074oken":' + hidden + "}",
        '{"x":1e400,"y":' + "9" * 5000 + ',"z":-0.0}': '{"x":1e400,"y":' + "9" * 5000 + ',"z":-0.0}',
        '{"token":1,"token":[true,[null]],"b":{}}': '{"token":%s,"token":[%s,[%s]],"b":{}}' % ((hidden,) * 3),
        '{"auth":' + "[" * deep + "7" + "]" * deep + "}": '{"auth":' + "[" * deep + hidden + "]" * deep + "}",
        " {} ": "{}",
        **dict.fromkeys(['{"a":NaN}', '{"a":1} {}', '{"a":1,}', '{"a" 1}', '{"a":[1}', '{"a":01}', '{"a":"\x01"}', '{"a":tru}', "{", "", "5", '{1:2}', '{"a":[,]}'], None),
    }
    rows = spark.createDataFrame([(v,) for v in cases], "v string").select("v", redact_json_map("v").alias("m")).collect()
    assert {r.v: r.m for r in rows} == cases
