"""Search over posts: filters, order and cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions import scalars as S
from threadloom.operators.normalize import project_fields
from threadloom.operators.position import check_page_size


@dataclass(frozen=True)
class Search:
    """What a search asks for; ``None`` leaves a filter out.

    ``after`` and ``before`` take epoch seconds, a date, an ISO datetime or a
    span back from now such as ``"1year"``; both ends are included.
    """

    subreddit: str | None = None
    title: str | None = None
    selftext: str | None = None
    query: str | None = None
    author: str | None = None
    after: str | float | None = None
    before: str | float | None = None
    sort: str = "asc"
    limit: int | None = None
    max_posts: int | None = None
    fields: str | list[str] | None = None

    def __post_init__(self):
        if self.sort not in ("asc", "desc"):
            raise ValueError(f"sort: asc or desc, not {self.sort!r}")
        if self.limit is not None:
            check_page_size(self.limit)
        cap = self.max_posts
        if cap is not None and (isinstance(cap, bool) or not isinstance(cap, int) or cap < 1):
            raise ValueError(f"max_posts: positive integer or None, not {cap!r}")


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value).strip() or None


def _contains(column: str, word: str) -> Column:
    return F.contains(F.lower(column), F.lit(word.lower()))


def _bound_seconds(spark: SparkSession, value: str, side: str) -> float:
    """The bound as a number, worked out first: a plain literal reaches the scan."""
    seconds = spark.range(1).select(S.time_bound(F.lit(value))).first()[0]
    if seconds is None:
        raise ValueError(f"{side}: date, epoch number or a span like 1year, not {value!r}")
    return seconds


def matching(posts: DataFrame, spec: Search) -> DataFrame:
    """Rows that pass every filter of ``spec``, unsorted."""
    community = _text(spec.subreddit)
    if community and community[:2].lower() == "r/":
        community = community[2:].strip()
    if community:
        posts = posts.filter(F.lower("subreddit") == community.lower())
    for column, word in (("title", _text(spec.title)), ("selftext", _text(spec.selftext))):
        if word:
            posts = posts.filter(_contains(column, word))
    word = _text(spec.query)
    if word:
        posts = posts.filter(
            F.coalesce(_contains("title", word), F.lit(False)) | F.coalesce(_contains("selftext", word), F.lit(False))
        )
    author = _text(spec.author)
    if author:
        posts = posts.filter(F.col("author") == author.removeprefix("u/"))
    for value, side in ((_text(spec.after), "after"), (_text(spec.before), "before")):
        if value is not None:
            bound = F.lit(_bound_seconds(posts.sparkSession, value, side))
            posts = posts.filter(F.col("created_utc") >= bound if side == "after" else F.col("created_utc") <= bound)
    return posts


def time_order(sort: str, ts: str = "created_utc", tie: str = "id") -> list[Column]:
    return [F.col(ts).asc() if sort == "asc" else F.col(ts).desc(), F.col(tie).asc()]


def search_posts(posts: DataFrame, spec: Search, stored: int = 0) -> DataFrame:
    """Matching posts in time order, capped.

    ``stored`` rows already kept count toward ``max_posts``.  A cap runs as a
    bounded top-k per task, not as a full sort.
    """
    found = matching(posts, spec).orderBy(*time_order(spec.sort))
    caps = [c for c in (spec.limit, None if spec.max_posts is None else max(0, spec.max_posts - stored)) if c is not None]
    if caps:
        found = found.limit(min(caps))
    return project_fields(found, spec.fields)
