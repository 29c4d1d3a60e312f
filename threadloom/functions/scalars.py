"""Column -> Column helpers.  Built-in expressions only, no Python UDF.

"Variant" arguments are single JSON values; their type is read with
``schema_of_variant``, which for a scalar is just its type name.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.schemas import OPEN_DATE_TOKEN, SITE_BASE, TRANSIENT_TIMEOUT_PATTERN

# Every character Python's str.strip() removes.
_WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER_TEXT = r"(?U)^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_MAX_LONG = 9.2233720368547e18
# First and one-past-last second of the years 1..9999.
_MIN_EPOCH, _MAX_EPOCH = -62135596800, 253402300800


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column | str, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    For wordy rules over small tables (names, dates, headers): a column used
    many times would otherwise be expanded at every use and swell the plan.
    """
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


# ---------------------------------------------------------------- text


def trim_ws(text: Column | str) -> Column:
    """Strip every kind of whitespace from both ends, not only spaces."""
    return F.btrim(_c(text), F.lit(_WHITESPACE))


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(trim_ws(text), F.lit(""))


def dedup_key(record_id: Column | str) -> Column:
    """Identity used for deduplication; a blank id is no id."""
    return blank_to_null(_c(record_id).cast("string"))


def bare_id(value: Column | str) -> Column:
    """Id without its one-letter kind prefix (``t1_`` comment, ``t3_`` post)."""
    return F.nullif(F.regexp_replace(trim_ws(value), "^t[13]_", ""), F.lit(""))


def parent_kind(raw_parent: Column | str, parent_is_text: Column | None = None) -> Column:
    text = trim_ws(raw_parent)
    usable = text != ""
    if parent_is_text is not None:
        usable = parent_is_text & usable
    return F.when(
        usable,
        F.when(text.startswith("t1_"), "comment").when(text.startswith("t3_"), "post").otherwise("unknown"),
    )


def community_display(value: Column | str, strict: bool = False) -> Column:
    """Community name without an ``r/`` prefix; blank is null, or an error if strict."""
    name = blank_to_null(F.regexp_replace(trim_ws(value), "^[rR]/", ""))
    if not strict:
        return name
    return F.coalesce(name, F.raise_error(F.lit("subreddit: non-empty text")).cast("string"))


def community_key(value: Column | str, strict: bool = False) -> Column:
    return F.lower(community_display(value, strict))


def author_name(value: Column | str) -> Column:
    return F.nullif(F.regexp_replace(trim_ws(value), "^u/", ""), F.lit(""))


def parameter_text(value: Column | str) -> Column:
    """Text of a request parameter: booleans as true/false, blank as null."""
    return blank_to_null(_c(value).cast("string"))


def body_snippet(text: Column | str, limit: int = 500) -> Column:
    return F.left(_c(text), F.lit(limit))


def _strip_marks(text: Column) -> Column:
    return F.btrim(text, F.lit("_-"))


def sanitize_name_part(text: Column | str, max_len: int = 64) -> Column:
    """Name part made of letters, digits, ``-`` and ``_`` only."""
    cleaned = _strip_marks(F.regexp_replace(trim_ws(text), "[^A-Za-z0-9-]+", "_"))
    cut = _strip_marks(F.left(cleaned, F.lit(max_len)))
    return _let(cut, lambda part: F.when(part == "", "collection").otherwise(part))


def sanitize_run_part(text: Column | str) -> Column:
    cleaned = _strip_marks(F.regexp_replace(F.lower(trim_ws(text)), "[^a-z0-9-]+", "_"))
    return _let(cleaned, lambda part: F.when((part != ""), part).otherwise("run"))


def run_id_for(moment: Column, subreddit: Column | str) -> Column:
    """Time-ordered run id ``yyyymmddThhmmssZ_<name>``, lower-cased as stored."""
    stamp = F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")
    named = F.concat(stamp, F.lit("_"), sanitize_run_part(subreddit))
    return sanitize_run_part(F.when(blank_to_null(subreddit).isNotNull(), named).otherwise(stamp))


# ------------------------------------------------------------- numbers


def number_from_text(text: Column | str) -> Column:
    """Decimal or exponent notation only; anything else is null."""
    # The cast ignores outer whitespace, the pattern allows it.
    return F.when(_c(text).rlike(_NUMBER_TEXT), trim_ws(text).try_cast("double"))


def variant_type(value: Column | str) -> Column:
    """Type name of a JSON value; null for a missing key, ``VOID`` for JSON null."""
    return F.schema_of_variant(_c(value))


def variant_text(value: Column | str) -> Column:
    return F.try_variant_get(_c(value), "$", "string")


def variant_is_text(value: Column | str) -> Column:
    return F.coalesce(variant_type(value) == "STRING", F.lit(False))


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")


def variant_number(value: Column | str) -> Column:
    return F.try_variant_get(_c(value), "$", "double")


def strict_int(value: Column | str, kind: Column | None = None, number: Column | None = None) -> Column:
    """Whole JSON numbers only: no booleans, strings or fractions.

    On a hot path pass ``kind`` (:func:`variant_type`) and ``number``
    (:func:`variant_number`) from an earlier projection; here and below.
    """
    kind = variant_type(value) if kind is None else kind
    number = variant_number(value) if number is None else number
    return F.when(kind == "BIGINT", F.try_variant_get(_c(value), "$", "bigint")).when(
        _is_number(kind) & (F.floor(number) == number) & (F.abs(number) < _MAX_LONG),
        number.try_cast("bigint"),
    )


def json_number(value: Column | str, kind: Column | None = None, number: Column | None = None) -> Column:
    """JSON number as a double; booleans, strings and the rest are null."""
    kind = variant_type(value) if kind is None else kind
    return F.when(_is_number(kind), variant_number(value) if number is None else number)


def cursor_ts(value: Column | str, kind: Column | None = None, number: Column | None = None) -> Column:
    """Time usable as a paging cursor: numbers and numeric strings."""
    kind = variant_type(value) if kind is None else kind
    return F.when(kind == "STRING", number_from_text(variant_text(value))).otherwise(json_number(value, kind, number))


def clean_ts(seconds: Column | str) -> Column:
    """Cursor text: whole seconds without a fraction part."""
    value = _c(seconds)
    whole = (F.floor(value) == value) & (F.abs(value) < _MAX_LONG)
    return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))


def iso_utc(seconds: Column | str) -> Column:
    """Epoch seconds as ISO-8601 UTC, microseconds only when there are any."""
    value = _c(seconds)
    whole = value.try_cast("bigint")
    micros = whole * 1000000 + F.rint((value - whole) * 1000000).try_cast("bigint")
    moment = F.timestamp_micros(micros)
    in_range = (value >= _MIN_EPOCH) & (value < _MAX_EPOCH)
    return F.when(
        in_range,
        F.when(micros % 1000000 == 0, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(
            F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        ),
    )


def _epoch_slug(value: Column) -> Column:
    """Text of an epoch outside the calendar, e.g. ``1000000000000.0`` or ``1e+20``."""
    plain = F.concat(value.try_cast("bigint").cast("string"), F.lit(".0"))
    exponent = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E(?=[0-9])", "e+")
    return F.concat(F.lit("epoch-"), F.when(F.abs(value) < 1e16, plain).otherwise(exponent))


def date_token(value: Column | str, kind: Column | None = None) -> Column:
    """Short stable token of a time bound, used in names and comparisons.

    ``kind`` is the JSON type name when the value came from JSON: a boolean
    bound is ``invalid``.  Numbers and numeric text are epoch seconds.
    """

    def of_number(number: Column, text: Column) -> Column:
        in_range = (number >= _MIN_EPOCH) & (number < _MAX_EPOCH)
        day = F.date_format(F.timestamp_seconds(F.floor(F.when(in_range, number))), "yyyy-MM-dd")
        slug = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), F.lit("-"))
        odd = F.when(number.isNull(), slug).otherwise(_epoch_slug(number))
        return F.when(in_range, day).otherwise(sanitize_name_part(odd, 32))

    def of_text(text: Column) -> Column:
        prefix = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
        return (
            F.when(text.isNull() | (text == ""), OPEN_DATE_TOKEN)
            .when(prefix != "", prefix)
            .otherwise(_let(number_from_text(text), lambda number: of_number(number, text)))
        )

    token = _let(trim_ws(_c(value).cast("string")), of_text)
    if kind is None:
        return token
    return F.when(F.coalesce(kind == "BOOLEAN", F.lit(False)), "invalid").otherwise(token)


def collection_name(subreddit: Column | str, after: Column, before: Column) -> Column:
    """``<Subreddit>-<after>-<before>`` from a community and two date tokens."""

    def named(community: Column) -> Column:
        name = F.concat_ws("-", sanitize_name_part(community), after, before)
        return F.when(
            community.isNotNull(),
            _let(_strip_marks(F.left(name, F.lit(128))), lambda cut: F.when(cut == "", "collection").otherwise(cut)),
        )

    return _let(community_display(subreddit), named)


def time_bound(value: Column | str, now: Column | None = None) -> Column:
    """Epoch seconds of a bound given as date, ISO datetime, epoch or ``2weeks``."""
    moment = now if now is not None else F.current_timestamp()
    relative = r"(?i)^(\d+)\s*(second|minute|hour|day|week|month|year)s?$"

    def of_text(text: Column) -> Column:
        n = F.regexp_extract(text, relative, 1).try_cast("int")
        unit = F.lower(F.regexp_extract(text, relative, 2))

        def of(name: str) -> Column:
            return F.when(unit == name, n).otherwise(F.lit(0))

        span = F.make_interval(
            of("year"), of("month"), of("week"), of("day"), of("hour"), of("minute"), of("second")
        )
        return F.coalesce(
            F.when(n.isNotNull(), F.unix_micros(moment - span) / 1e6),
            number_from_text(text),
            F.unix_micros(text.try_cast("timestamp")) / 1e6,
        )

    return _let(trim_ws(_c(value).cast("string")), of_text)


# ----------------------------------------------------------- permalinks


def absolute_link(link: Column | str, site_base: str = SITE_BASE) -> Column:
    text = trim_ws(link)
    return F.when(text.startswith("http"), text).when(
        text != "",
        F.when(text.startswith("/"), F.concat(F.lit(site_base), text)).otherwise(
            F.concat(F.lit(site_base + "/"), text)
        ),
    )


def post_permalink(link: Column, subreddit: Column, post_id: Column, site_base: str = SITE_BASE) -> Column:
    built = F.when(
        (subreddit != "") & post_id.isNotNull(),
        F.concat(F.lit(site_base + "/r/"), subreddit, F.lit("/comments/"), post_id, F.lit("/")),
    )
    return F.coalesce(absolute_link(link, site_base), built)


def comment_permalink(
    link: Column, subreddit: Column, post_id: Column, comment_id: Column, kind: Column, site_base: str = SITE_BASE
) -> Column:
    built = F.when(
        (subreddit != "")
        & (post_id != "")
        & comment_id.isNotNull()
        & F.coalesce(kind != "more", F.lit(True)),
        F.concat(
            F.lit(site_base + "/r/"), subreddit, F.lit("/comments/"), post_id, F.lit("/_/"), comment_id, F.lit("/")
        ),
    )
    return F.coalesce(absolute_link(link, site_base), built)


# ------------------------------------------------------ response values


def is_transient_timeout(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike("(?i)" + TRANSIENT_TIMEOUT_PATTERN), F.lit(False))


def header(headers: Column | str, name: str) -> Column:
    """Header value by name in any letter case."""
    lowered = F.filter(F.map_entries(_c(headers)), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(F.transform(lowered, lambda e: e["value"]), F.lit(0))


def server_wait(headers: Column | str, now: Column) -> Column:
    """Seconds the server asks to wait: ``Retry-After``, else ``X-RateLimit-Reset``."""

    def of_retry(retry: Column) -> Column:
        day = F.regexp_extract(retry, r"(\d{1,2}) [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}", 1)
        rest = F.regexp_extract(retry, r"\d{1,2} ([A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
        at = F.try_to_timestamp(F.concat(F.lpad(day, 2, "0"), F.lit(" "), rest), F.lit("dd MMM yyyy HH:mm:ss"))
        until = (F.unix_micros(at) - F.unix_micros(now)) / 1e6
        return F.coalesce(
            # greatest() skips nulls, so a missing number must be tested first.
            _let(number_from_text(retry), lambda n: F.when(n.isNotNull(), F.greatest(F.lit(0.0), n))),
            F.when(until.isNotNull(), F.greatest(F.lit(0.0), until)),
        )

    reset = number_from_text(header(headers, "X-RateLimit-Reset"))
    return F.coalesce(_let(header(headers, "Retry-After"), of_retry), _let(reset, lambda r: F.when(r >= 0, r)))


def backoff_seconds(attempt: Column | str, wait: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Exponential delay up to ``cap``; a longer server wait wins."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), _c(attempt)), F.lit(float(cap)))
    return F.greatest(delay, wait)
