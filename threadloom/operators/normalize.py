"""Raw JSON records -> fixed schemas (one parse, one projection, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions import scalars as S
from threadloom.functions.jsonrows import read_object, with_object
from threadloom.schemas import COMMENT_FIELDS, POST_FIELDS, SITE_BASE

_POST_JSON = (
    "id string, subreddit string, title string, selftext string, author string, score variant, "
    "num_comments variant, created_utc variant, url string, permalink variant"
)
_NODE_JSON = (
    "kind variant, data struct<id string, parent_id variant, subreddit string, author string, body string, "
    "score variant, created_utc variant, permalink variant, children array<string>, count variant>"
)


def _text_only(value: Column) -> Column:
    return F.when(S.variant_type(value) == "STRING", S.variant_text(value))


def _with_types(parsed: DataFrame, record: str, names: tuple[str, ...]) -> DataFrame:
    """Add type name and numeric value of some JSON fields, computed once per row."""
    return parsed.select(
        "*",
        *[S.variant_type(F.col(f"{record}.{n}")).alias(f"__{n}_kind") for n in names],
        *[S.variant_number(F.col(f"{record}.{n}")).alias(f"__{n}_number") for n in names],
    )


def _typed(record: str, name: str) -> tuple[Column, Column, Column]:
    return F.col(f"{record}.{name}"), F.col(f"__{name}_kind"), F.col(f"__{name}_number")


def normalize_posts(
    raw: DataFrame, value: str = "value", site_base: str = SITE_BASE, on_error: str = "raise"
) -> DataFrame:
    """``POST`` columns plus every other column of ``raw``.

    ``value`` holds one JSON object per row.  Rows that do not are an error
    (``on_error='raise'``), are dropped (``'drop'``), or come back as an
    all-null post (``'null'``).
    """
    if on_error not in ("raise", "drop", "null"):
        raise ValueError(f"on_error: raise, drop or null, not {on_error!r}")
    parsed = with_object(raw, value, _POST_JSON, "__p", on_error, "record is not one JSON object")
    parsed = _with_types(parsed, "__p", ("score", "num_comments", "created_utc"))
    created = _typed("__p", "created_utc")
    f = {name: F.col(f"__p.{name}") for name in POST_FIELDS if name != "created_iso"}
    post = {
        "id": f["id"],
        "subreddit": f["subreddit"],
        "title": f["title"],
        "selftext": f["selftext"],
        "author": f["author"],
        "score": S.strict_int(*_typed("__p", "score")),
        "num_comments": S.strict_int(*_typed("__p", "num_comments")),
        "created_utc": S.cursor_ts(*created),
        "created_iso": S.iso_utc(S.json_number(*created)),
        "url": f["url"],
        "permalink": S.post_permalink(_text_only(f["permalink"]), f["subreddit"], f["id"], site_base),
    }
    rest = [c for c in raw.columns if c != value]
    return parsed.select(*rest, *[post[name].alias(name) for name in POST_FIELDS])


def normalize_comments(nodes: DataFrame, node: str = "node", site_base: str = SITE_BASE) -> DataFrame:
    """``COMMENT`` columns plus every other column of ``nodes``.

    ``nodes`` has ``post_id``, ``depth``, ``path`` and a node's JSON text, as
    made by ``tree.flatten_trees``.  A node without a ``data`` object cannot be
    normalized and is left out; :func:`unusable_nodes` returns those.
    """
    # Exploded for the same reason as in with_object: one parse per node.
    parsed = nodes.select("*", F.explode(F.array(read_object(node, _NODE_JSON))).alias("__n")).filter("__n.data is not null")
    parsed = _with_types(parsed.select("*", F.col("__n.data").alias("__d")), "__d", ("score", "created_utc"))
    # What several fields are made of is computed once per row, and rules for odd values only where there is a value.
    parsed = parsed.select(
        "*",
        _text_only(F.col("__n.kind")).alias("__kind"),
        S.blank_to_null(F.col("__d.id")).alias("__id"),
        F.when(F.col("__d.parent_id").isNotNull(), S.variant_text(F.col("__d.parent_id"))).alias("__parent"),
        F.when(F.col("__d.permalink").isNotNull(), _text_only(F.col("__d.permalink"))).alias("__link"),
    )
    created = _typed("__d", "created_utc")
    d = {name: F.col(f"__d.{name}") for name in ("parent_id", "subreddit", "author", "body", "children", "count")}
    kind, comment_id = F.col("__kind"), F.col("__id")
    parent_id = F.when(F.col("__parent").isNotNull(), S.bare_id(F.col("__parent")))
    is_more = F.coalesce(kind == "more", F.lit(False))
    children = F.filter(
        F.transform(F.coalesce(d["children"], F.array()), lambda c: F.coalesce(c, F.lit("null"))),
        lambda c: S.trim_ws(c) != "",
    )
    count = F.when(S.variant_type(d["count"]) == "BIGINT", F.try_variant_get(d["count"], "$", "bigint"))
    parent_kind = F.when(parent_id == F.col("post_id"), "post").otherwise(
        S.parent_kind(F.col("__parent"), S.variant_is_text(d["parent_id"]))
    )
    link = S.comment_permalink(F.col("__link"), d["subreddit"], F.col("post_id"), comment_id, kind, site_base)
    comment = {
        "comment_id": comment_id,
        "post_id": F.col("post_id"),
        "parent_id": parent_id,
        "parent_kind": F.when(F.col("__parent").isNotNull(), parent_kind),
        "kind": kind,
        "depth": F.col("depth").cast("int"),
        "path": F.col("path"),
        "subreddit": d["subreddit"],
        "author": d["author"],
        "body": d["body"],
        "score": S.strict_int(*_typed("__d", "score")),
        "created_utc": S.cursor_ts(*created),
        "created_iso": S.iso_utc(S.json_number(*created)),
        "permalink": F.when(F.col("__link").isNotNull() | d["subreddit"].isNotNull(), link),
        "collapsed_children": F.when(is_more, children).otherwise(F.array().cast("array<string>")),
        "collapsed_count": F.when(is_more, F.coalesce(count, F.size(children).cast("bigint"))),
    }
    rest = [c for c in nodes.columns if c not in (node, "post_id", "depth", "path")]
    return parsed.select(*rest, *[comment[name].alias(name) for name in COMMENT_FIELDS])


def unusable_nodes(nodes: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that flattening keeps but normalizing cannot use (no ``data`` object)."""
    return nodes.filter(read_object(node, _NODE_JSON)["data"].isNull())


def quarantined(flat: DataFrame) -> DataFrame:
    """``post_id, what`` of flattened trees that cannot be used: ``tree`` for a payload, ``node`` for a node without ``data``.

    One pass over the trees, where ``tree_errors`` and :func:`unusable_nodes` beside each other walk them twice.
    """
    what = F.when(F.col("error").isNotNull(), "tree").when(read_object("node", _NODE_JSON)["data"].isNull(), "node")
    # Exploded so that a node is parsed once, as in normalize_comments.
    return flat.select("post_id", F.explode(F.array(what)).alias("what")).filter("what is not null")


def project_fields(df: DataFrame, fields: str | list[str] | None) -> DataFrame:
    """Only the named fields (list or comma-separated); blank or empty keeps all."""
    names = fields.split(",") if isinstance(fields, str) else list(fields or [])
    names = [n.strip() for n in names if n.strip()]
    return df.select(*names) if names else df
