"""Audit of logged API answers: class, retry, wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions import scalars as S
from threadloom.functions.jsonrows import with_object
from threadloom.operators.position import with_position


def with_attempts(responses: DataFrame, request: str = "request_id", seq: str = "seq") -> DataFrame:
    """0-based attempt number of each answer to the same request."""
    return with_position(responses, [seq], within=[request], name="attempt")


def audit_responses(
    responses: DataFrame,
    max_retries: int = 5,
    backoff_base: float = 1.0,
    backoff_cap: float = 60.0,
    now: Column | None = None,
) -> DataFrame:
    """Add ``outcome``, ``retryable``, ``retried`` and ``wait_secs``.

    ``responses`` has ``status`` (null: no connection), ``headers``, ``body``
    and ``attempt``.  Only a 429 makes the server's own wait count.
    """
    moment = now if now is not None else F.current_timestamp()
    parsed = with_object(responses, "body", "error variant, message variant", "__b")
    is_object = F.col("__b").isNotNull()

    def says_timeout(key: str) -> Column:
        v = F.col(f"__b.{key}")
        return S.variant_is_text(v) & S.is_transient_timeout(S.variant_text(v))

    timeout = is_object & (says_timeout("error") | says_timeout("message"))
    has_error = is_object & F.col("__b.error").isNotNull()
    status = F.col("status")
    is_2xx = status.between(200, 299)
    outcome = (
        F.when(status.isNull(), "network_error")
        .when(status == 429, "rate_limited")
        .when(status == 422, F.when(timeout, "query_timeout").otherwise("api_error"))
        .when(~is_2xx, "api_error")
        .when(~is_object, "api_error")
        .when(has_error, F.when(timeout, "query_timeout").otherwise("api_error"))
        .otherwise("ok")
    )
    retryable = (
        status.isNull() | (status == 429) | ((status == 422) & timeout) | status.between(500, 599)
    )
    retryable = F.coalesce(retryable, F.lit(False))
    wait = S.backoff_seconds(
        "attempt", F.when(status == 429, S.server_wait("headers", moment)), backoff_base, backoff_cap
    )
    retried = retryable & (F.col("attempt") < max_retries)
    return (
        parsed.withColumn("outcome", outcome)
        .withColumn("retryable", retryable)
        .withColumn("retried", retried)
        .withColumn("wait_secs", F.when(retried, wait))
        .drop("__b")
    )


def outcome_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if("retryable").alias("retryable"),
        F.count_if("retried").alias("retried"),
        F.max("wait_secs").alias("longest_wait"),
    )
