import datetime as dt

from pyspark.sql import functions as F

from threadloom.functions import scalars as S

UTC = dt.timezone.utc


def variants(one, texts, fn):
    return one(texts, fn(F.parse_json("v")))


def test_strict_int(one):
    values = ["2", "2.0", "1e3", "2.5", "true", '"3"', "null", "[1]", "12345678901234567890123", "-7", "9007199254740993"]
    assert variants(one, values, S.strict_int) == [
        2, 2, 1000, None, None, None, None, None, None, -7, 9007199254740993]


def test_iso_matches_python(one):
    values = [0.0, 1577836800.0, 1577836800.25, -1.5, 1e12, 253402300799.0, 253402300800.0, -62135596800.0, 1704067207.179575]

    def expected(v):
        try:
            return dt.datetime.fromtimestamp(v, tz=UTC).isoformat()
        except (ValueError, OverflowError):
            return None

    assert one(values, S.iso_utc("v"), "v double") == [expected(v) for v in values]


def test_cursor_takes_numeric_text_but_iso_does_not(one):
    values = ["5", '"5.5"', '"soon"', "true", "null", '" 7 "']
    assert variants(one, values, S.cursor_ts) == [5.0, 5.5, None, None, None, 7.0]
    assert variants(one, values, S.json_number) == [5.0, None, None, None, None, None]


def test_trim_and_key(one):
    assert one([" a　", "\x1cb\t\n", "  ", None, "c d"], S.trim_ws("v")) == ["a", "b", "", None, "c d"]
    assert one([" a ", "  ", None], S.dedup_key("v")) == ["a", None, None]


def test_bare_id_and_parent_kind(one):
    values = ["t1_abc", "t3_x", "plain", "  t1_q ", "t1_", "", None, "t1_t3_z"]
    assert one(values, S.bare_id("v")) == ["abc", "x", "plain", "q", None, None, None, "t3_z"]
    assert one(values, S.parent_kind("v")) == ["comment", "post", "unknown", "comment", "comment", None, None, "comment"]


def test_community_names(one):
    values = ["r/Python", " R/ Spark ", "Plain", "r/", None, "rust"]
    assert one(values, S.community_display("v")) == ["Python", "Spark", "Plain", None, None, "rust"]
    assert one(values, S.community_key("v")) == ["python", "spark", "plain", None, None, "rust"]


def test_name_parts(one):
    assert one(["a b!!c", "--x__", "###", "", "ä"], S.sanitize_name_part("v")) == ["a_b_c", "x", "collection", "collection", "collection"]
    assert one(["abc-defgh"], S.sanitize_name_part("v", 4)) == ["abc"]
    assert one(["My Sub", "", "__"], S.sanitize_run_part("v")) == ["my_sub", "run", "run"]


def test_date_tokens(one):
    values = [None, " ", "2026-01-01", "2026-01-01T10:00:00", "1577836800", "2024", "1year", "last week!", "1e20", "1e12"]
    assert one(values, S.date_token("v")) == [
        "open", "open", "2026-01-01", "2026-01-01", "2020-01-01", "1970-01-01", "1year", "last-week", "epoch-1e_20",
        "epoch-1000000000000_0"]
    kind = S.variant_type(F.parse_json("v"))
    assert one(["true", "5"], S.date_token(S.variant_text(F.parse_json("v")), kind)) == ["invalid", "1970-01-01"]


def test_collection_name(one):
    named = S.collection_name("v", S.date_token(F.lit("2026-01-01")), S.date_token(F.lit("2026-06-30")))
    assert one(["Philippines", "r/Philippines", " "], named) == [
        "Philippines-2026-01-01-2026-06-30", "Philippines-2026-01-01-2026-06-30", None]


def test_run_id(one):
    moment = F.lit("2026-10-05 17:30:00").cast("timestamp")
    assert one(["Python", " ", "A b"], S.run_id_for(moment, "v")) == [
        "20261005t173000z_python", "20261005t173000z", "20261005t173000z_a_b"]


def test_time_bounds(one):
    now = F.lit("2026-03-31 12:00:00").cast("timestamp")
    got = one(["2020-01-01", "2020-01-01T00:00:10", "1577836800.5", "1 year", "2weeks", "soon", None], S.time_bound("v", now))
    year = dt.datetime(2025, 3, 31, 12, tzinfo=UTC).timestamp()
    weeks = dt.datetime(2026, 3, 17, 12, tzinfo=UTC).timestamp()
    assert got == [1577836800.0, 1577836810.0, 1577836800.5, year, weeks, None, None]


def test_clean_ts(one):
    assert one([5.0, 5.5, None], S.clean_ts("v"), "v double") == ["5", "5.5", None]


def test_author_and_parameter_text(one):
    assert one(["u/spez", " u/u/x", "/u/y", " "], S.author_name("v")) == ["spez", "u/x", "/u/y", None]
    assert one([True, False], S.parameter_text("v"), "v boolean") == ["true", "false"]
    assert one([" a ", ""], S.parameter_text("v")) == ["a", None]


def test_transient_timeouts(one):
    values = ["Query timed out", "TIMEOUT", "time-out", "please slow  down", "invalid parameter", None]
    assert one(values, S.is_transient_timeout("v")) == [True, True, True, True, False, False]


def test_server_wait(one):
    now = F.lit("2015-10-21 07:27:30").cast("timestamp")
    values = [
        {"Retry-After": "5", "X-RateLimit-Reset": "50"},
        {"retry-after": "Wed, 21 Oct 2015 07:28:00 GMT"},
        {"retry-after": "Wed, 21 Oct 2015 07:20:00 GMT"},
        {"X-RateLimit-Reset": "soon"},
        {"Retry-After": "later", "x-ratelimit-reset": "7"},
        {"Retry-After": "-3"},
        {"X-RateLimit-Reset": "-1"},
        {},
    ]
    assert one(values, S.server_wait("v", now), "v map<string,string>") == [5.0, 30.0, 0.0, None, 7.0, 0.0, None, None]


def test_backoff(one):
    none = F.lit(None).cast("double")
    assert one([0, 1, 2, 3, 4, 20], S.backoff_seconds("v", none), "v int") == [1.0, 2.0, 4.0, 8.0, 16.0, 60.0]
    assert one([0], S.backoff_seconds("v", F.lit(42.0)), "v int") == [42.0]
    assert one([0], S.backoff_seconds("v", F.lit(300.0)), "v int") == [300.0]


def test_snippet(one):
    assert one(["x" * 600], F.length(S.body_snippet("v"))) == [500]
