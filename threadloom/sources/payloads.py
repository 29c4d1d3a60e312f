"""Landed API answers: search pages and comment trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.jsonrows import read_object


def _is_object(value: Column | str, path: str = "$") -> Column:
    # The type name of an object is its whole schema as text, which costs far more than reading it.
    return F.try_variant_get(value, path, "map<string,variant>").isNotNull()


def _with_page(pages: DataFrame, payload: str) -> DataFrame:
    """Add ``__page``: what a search page is, from one parse.

    Both steps sit in an explode, as in ``with_object``: a filter or a condition on
    what they give would otherwise repeat the parse at every use.
    """
    # Inside brackets a second value or trailing text is no longer a readable list of one.
    whole = F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]")))
    parsed = pages.select("*", F.explode(F.array(whole)).alias("__whole"))
    second, data = (F.try_variant_get("__whole", path, "variant") for path in ("$[1]", "$[0].data"))
    page = F.struct(
        (_is_object("__whole", "$[0]") & second.isNull()).alias("one_object"),
        data.isNotNull().alias("has_data"),
        F.try_variant_get("__whole", "$[0].data", "array<variant>").alias("items"),
    )
    return parsed.select(*pages.columns, F.explode(F.array(page)).alias("__page"))


def _page_error() -> Column:
    return F.when(~F.col("__page.one_object"), "not exactly one JSON object").when(
        F.col("__page.has_data") & F.col("__page.items").isNull(), "no list under data"
    )


def with_page_error(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``page_error``: why a search page cannot be used, or null.

    A page is exactly one JSON object whose ``data`` is a list or missing.  Torn
    text, text after the object, an empty file and any other value are errors.
    """
    return _with_page(pages, payload).select(*pages.columns, _page_error().alias("page_error"))


def page_errors(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """The pages that cannot be used, with payload and ``page_error``."""
    return with_page_error(pages, payload).filter("page_error is not null")


def explode_pages(pages: DataFrame, payload: str = "payload", keep_errors: bool = False) -> DataFrame:
    """One row per post object of a search page: ``pos`` and verbatim ``value``.

    An unusable page (see :func:`with_page_error`) fails the read, or with
    ``keep_errors`` gives one row with the payload as ``value`` and its
    ``page_error``, which is null in other rows; a page without ``data`` is empty;
    items that are not objects are dropped, also strings that look like one.
    """
    rest = [c for c in pages.columns if c not in (payload, "page_error")]
    read = _with_page(pages, payload)
    checked = read if "page_error" in pages.columns else read.withColumn("page_error", _page_error())
    typed = F.col("__page.items")
    verbatim = read_object(payload, "data array<string>")["data"]
    kind = "array<struct<value:string,kind:variant>>"
    if keep_errors:
        failure = F.array(F.struct(F.col(payload).alias("value"), F.lit(None).cast("variant").alias("kind"))).cast(kind)
        rest, wanted = [*rest, "page_error"], F.col("page_error").isNotNull() | _is_object("item.kind")
    else:
        failure = F.raise_error(F.concat(F.lit("search page: "), "page_error")).cast(kind)
        wanted = _is_object("item.kind")
    items = F.when(F.col("page_error").isNotNull(), failure).otherwise(F.arrays_zip(verbatim.alias("value"), typed.alias("kind")))
    return (
        checked.select(*rest, F.posexplode(items).alias("pos", "item"))
        .filter(wanted)
        .select(*rest, "pos", F.col("item.value").alias("value"))
    )
