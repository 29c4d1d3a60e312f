"""Progress of a run from its log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.schemas import LOG_PAGE_PATTERN, LOG_POST_PATTERN, LOG_SAVED_PATTERN, LOG_TOTAL_PATTERN

def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def classify_log(lines: DataFrame) -> DataFrame:
    """Add what a line says about progress.

    ``lines`` has ``level``, ``logger`` and ``message``.  ``event`` is one of
    ``retry``, ``page``, ``comments``, ``saved``, ``spacing`` or null; ``clears``
    marks lines that end a rate-limit wait.
    """
    message, logger = F.col("message"), F.col("logger")
    retry = message.contains("before retry") & (F.col("level") == "WARNING")
    page = logger.endswith(".paginator") & message.contains("new posts")
    collector = logger.endswith(".collector")
    saved = logger.endswith(".checkpoint") & message.contains("posts done, ")
    spacing = message.contains("Rate limiting: waiting")
    source = (
        F.when(retry, "retry").when(page, "page").when(collector, "collector").when(saved, "saved").when(spacing, "spacing")
    )
    tagged = lines.withColumn("__source", source)
    on_page = F.col("__source") == "page"
    post_line = (F.col("__source") == "collector") & message.rlike(LOG_POST_PATTERN)
    saved_line = (F.col("__source") == "saved") & message.rlike(LOG_SAVED_PATTERN)
    page_no = F.when(on_page, _number(message, LOG_PAGE_PATTERN, 1))
    return tagged.select(
        *lines.columns,
        F.when(F.col("__source") == "retry", "retry")
        .when(page_no.isNotNull(), "page")
        .when(post_line, "comments")
        .when(saved_line, "saved")
        .when(F.col("__source") == "spacing", "spacing")
        .alias("event"),
        F.col("level").isin("ERROR", "CRITICAL").alias("is_error"),
        F.when(F.col("__source").isNotNull(), F.col("__source") == "retry").alias("waiting"),
        page_no.alias("page_no"),
        F.when(page_no.isNotNull(), _number(message, LOG_TOTAL_PATTERN, 1)).alias("posts_total"),
        F.when(post_line, _number(message, LOG_POST_PATTERN, 1)).alias("comments_added"),
        F.when(post_line, _number(message, LOG_POST_PATTERN, 2))
        .when(saved_line, _number(message, LOG_SAVED_PATTERN, 1))
        .alias("comment_posts"),
        F.when(saved_line, _number(message, LOG_SAVED_PATTERN, 2)).alias("comments_saved"),
    )


def _last(value: str, seq: str) -> Column:
    """Value of the last line that has one."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))


def log_progress(lines: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Progress per run after its last line.

    Comment totals restart from the last saved total and add the per-post lines
    after it.  Everything is a partial aggregate; the per-run result of the
    first pass is joined back once, for that restart.
    """
    seen = classify_log(lines)
    state = seen.groupBy(run).agg(
        _last("page_no", seq).alias("pages"),
        _last("posts_total", seq).alias("posts"),
        F.count_if(F.col("event") == "retry").alias("retry_waits"),
        F.count_if("is_error").alias("errors"),
        _last("waiting", seq).alias("waiting_on_rate_limit"),
        F.max_by("message", seq).alias("last_message"),
        F.coalesce(F.bool_or(F.col("event").isin("comments", "saved")), F.lit(False)).alias("in_comment_phase"),
        _last("comment_posts", seq).alias("comment_posts_done"),
        _last("comments_saved", seq).alias("__saved"),
        F.max(F.when(F.col("comments_saved").isNotNull(), F.col(seq))).alias("__saved_at"),
    )
    anchor = state.select(F.col(run).alias("__run"), "__saved_at")
    added = (
        seen.filter("comments_added is not null")
        .select(F.col(run).alias("__r"), F.col(seq).alias("__s"), "comments_added")
        .join(anchor, F.col("__r") == F.col("__run"))
        .groupBy("__r")
        .agg(
            F.sum(
                F.when(F.col("__saved_at").isNull() | (F.col("__s") > F.col("__saved_at")), F.col("comments_added"))
            ).alias("__added")
        )
    )
    zero = F.lit(0).cast("bigint")
    return state.join(added, F.col(run) == F.col("__r"), "left").select(
        run,
        *[F.coalesce(c, zero).alias(c) for c in ("pages", "posts")],
        "retry_waits",
        "errors",
        F.coalesce("waiting_on_rate_limit", F.lit(False)).alias("waiting_on_rate_limit"),
        "last_message",
        "in_comment_phase",
        F.coalesce("comment_posts_done", zero).alias("comment_posts_done"),
        (F.coalesce("__saved", zero) + F.coalesce("__added", zero)).alias("comments_collected"),
    )


def run_report(lines: DataFrame, run: str = "run_id", seq: str = "seq", at: str = "logged_at") -> DataFrame:
    """Progress plus duration and requests (pages and retries)."""
    span = lines.groupBy(F.col(run).alias("__span")).agg(
        (F.unix_seconds(F.max(at).cast("timestamp")) - F.unix_seconds(F.min(at).cast("timestamp"))).alias("duration_secs")
    )
    return (
        log_progress(lines, run, seq)
        .join(span, F.col(run) == F.col("__span"))
        .withColumn("requests", F.col("pages") + F.col("retry_waits"))
        .drop("__span")
    )
