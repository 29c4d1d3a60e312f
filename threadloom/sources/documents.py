"""Progress documents and run manifests stored as one JSON file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadloom.functions.jsonrows import with_object
from threadloom.functions.scalars import strict_int, variant_is_text, variant_text, variant_type, trim_ws
from threadloom.schemas import COMMENTS_DOCUMENT_NAMES, DOCUMENT_VERSION, FILTER_KEYS, POSTS_DOCUMENT_NAMES

# Names in order of preference; the first one present in a folder is read.
POSTS_NAMES = POSTS_DOCUMENT_NAMES
COMMENTS_NAMES = COMMENTS_DOCUMENT_NAMES

_COLLECTION = (
    "name variant, subreddit variant, subreddit_norm variant, after_token variant, before_token variant, "
    "title variant, query variant, selftext variant, author variant, sort variant"
)
_FILTERS = ", ".join(f"{k} variant" for k in FILTER_KEYS)
_POSTS_DOC = (
    "version variant, saved_at string, run_id variant, paginator variant, collection variant"
)
_COMMENTS_DOC = "version variant, saved_at string, run_id variant, comments variant, collection variant"
_MANIFEST = "run_id string, started_at variant, chunk_size variant, params variant"


def scan_documents(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """``folder``, ``file``, ``value`` of the preferred document in every folder under ``root``."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(names) + "}")
        .text(root, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    )
    return preferred_documents(
        files.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), "file", "value"), names
    )


def with_collection_name(docs: DataFrame, root: str) -> DataFrame:
    """Name of the collection a document belongs to: its folder, or ``legacy`` for the root."""
    last = F.regexp_extract("folder", "([^/]+)$", 1)
    at_root = F.regexp_replace("folder", "^file:/+", "/") == F.regexp_replace(F.lit(root.rstrip("/")), "^file:/+", "/")
    return docs.withColumn("legacy", at_root).withColumn("name", F.when(at_root, "legacy").otherwise(last))


def preferred_documents(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per folder, the file whose name comes first in ``names``."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("file"))
    known = files.filter(F.col("file").isin(*names))
    return known.groupBy("folder").agg(
        F.min_by("file", rank).alias("file"), F.min_by("value", rank).alias("value")
    )


# -------------------------------------------------------------- validation


def _is_object(v: Column) -> Column:
    return F.coalesce(variant_type(v).startswith("OBJECT"), F.lit(False))


def _absent(v: Column) -> Column:
    """Missing key or JSON null."""
    return v.isNull() | (variant_type(v) == "VOID")


def _filled_text(v: Column) -> Column:
    return variant_is_text(v) & F.coalesce(trim_ws(variant_text(v)) != "", F.lit(False))


def _whole(v: Column) -> Column:
    """JSON integer >= 0 (not a boolean, not 2.0)."""
    return F.coalesce((variant_type(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 0), F.lit(False))


def _part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _text_list(v: Column) -> Column:
    """A list holding strings only; a missing list is fine, a null one is not."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return v.isNull() | F.coalesce(
        variant_type(v).startswith("ARRAY") & F.forall(items, variant_is_text), F.lit(False)
    )


def _rule(broken: Column, message: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(True)), F.lit(message))


def _violations(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def _collection_rules(block: Column) -> list[Column]:
    given = ~_absent(block)
    is_object = _is_object(block)
    return [
        _rule(given & ~is_object, "collection: object or null"),
        _rule(given & is_object & ~_filled_text(_part(block, "name")), "collection.name: non-empty text"),
        _rule(
            given & is_object & ~_filled_text(_part(block, "subreddit")),
            "collection.subreddit: non-empty text",
        ),
    ]


def check_posts_documents(docs: DataFrame) -> DataFrame:
    """Parsed posts-progress documents with every violation in ``errors``."""
    parsed = with_object(docs, "value", _POSTS_DOC, "doc")
    d = {k: F.col(f"doc.{k}") for k in ("version", "run_id", "paginator", "collection")}
    pager = d["paginator"]
    cursor, total = _part(pager, "cursor"), _part(pager, "total_fetched")
    has_pager = _is_object(pager)
    cursor_type = variant_type(cursor)
    cursor_ok = _absent(cursor) | (cursor_type == "STRING") | cursor_type.isin("BIGINT", "DOUBLE") | cursor_type.startswith(
        "DECIMAL"
    )
    version = F.try_variant_get(d["version"], "$", "double")
    version_ok = ~variant_is_text(d["version"]) & F.coalesce(version == DOCUMENT_VERSION, F.lit(False))
    errors = _violations(
        _rule(~version_ok, f"version: {DOCUMENT_VERSION}"),
        _rule(~_absent(d["run_id"]) & ~_filled_text(d["run_id"]), "run_id: non-empty text or null"),
        _rule(~has_pager, "paginator: object"),
        _rule(has_pager & ~_is_object(_part(pager, "filters")), "paginator.filters: object"),
        _rule(has_pager & ~variant_is_text(_part(pager, "sort")), "paginator.sort: text"),
        _rule(has_pager & ~cursor_ok, "paginator.cursor: text, number or null"),
        _rule(has_pager & ~_whole(total), "paginator.total_fetched: integer >= 0"),
        _rule(
            has_pager & ~_text_list(_part(pager, "seen_ids")), "paginator.seen_ids: list of text"
        ),
        *[F.when(has_pager, r) for r in _collection_rules(d["collection"])],
    )
    return parsed.withColumn(
        "errors",
        F.when(F.col("doc").isNull(), F.array(F.lit("not a JSON object"))).otherwise(errors),
    )


def check_comments_documents(docs: DataFrame) -> DataFrame:
    """Parsed comments-progress documents with every violation in ``errors``."""
    parsed = with_object(docs, "value", _COMMENTS_DOC, "doc")
    d = {k: F.col(f"doc.{k}") for k in ("version", "run_id", "comments", "collection")}
    state = d["comments"]
    has_state = _is_object(state)
    version = F.try_variant_get(d["version"], "$", "double")
    version_ok = ~variant_is_text(d["version"]) & F.coalesce(version == DOCUMENT_VERSION, F.lit(False))
    counters = [
        _rule(
            has_state & _part(state, key).isNotNull() & ~_whole(_part(state, key)),
            f"comments.{key}: integer >= 0",
        )
        for key in ("posts_completed", "posts_skipped_empty", "comments_collected")
    ]
    errors = _violations(
        _rule(~version_ok, f"version: {DOCUMENT_VERSION}"),
        _rule(~_filled_text(d["run_id"]), "run_id: non-empty text"),
        _rule(~has_state, "comments: object"),
        _rule(
            has_state & ~_text_list(_part(state, "completed_post_ids")),
            "comments.completed_post_ids: list of text",
        ),
        *counters,
        *[F.when(has_state, r) for r in _collection_rules(d["collection"])],
    )
    return parsed.withColumn(
        "errors",
        F.when(F.col("doc").isNull(), F.array(F.lit("not a JSON object"))).otherwise(errors),
    )


def read_posts_progress(checked: DataFrame) -> DataFrame:
    """Columns of valid posts-progress documents; identity parts stay JSON values."""
    doc, pager = F.col("doc"), F.col("doc.paginator")
    collection = F.when(
        _is_object(doc["collection"]), F.from_json(F.to_json(doc["collection"]), _COLLECTION)
    )
    return checked.filter(F.size("errors") == 0).select(
        *[c for c in checked.columns if c not in ("value", "doc", "errors")],
        variant_text(doc["run_id"]).alias("run_id"),
        doc["saved_at"].alias("saved_at"),
        strict_int(_part(pager, "total_fetched")).alias("total_fetched"),
        F.when(variant_type(_part(pager, "max_posts")) == "BIGINT", strict_int(_part(pager, "max_posts"))).alias("max_posts"),
        variant_text(_part(pager, "cursor")).alias("cursor"),
        _part(pager, "version").alias("pager_version"),
        _part(pager, "sort").alias("pager_sort"),
        F.from_json(F.to_json(_part(pager, "filters")), _FILTERS).alias("filters"),
        collection.alias("collection"),
    )


def seen_ids(checked: DataFrame) -> DataFrame:
    """Ids a posts-progress document has noted, one row each."""
    ids = F.try_variant_get(F.col("doc.paginator"), "$.seen_ids", "array<string>")
    return checked.filter(F.size("errors") == 0).select(
        variant_text(F.col("doc.run_id")).alias("run_id"), F.explode(ids).alias("id")
    )


def read_comments_progress(checked: DataFrame) -> DataFrame:
    doc, state = F.col("doc"), F.col("doc.comments")
    collection = F.when(
        _is_object(doc["collection"]), F.from_json(F.to_json(doc["collection"]), _COLLECTION)
    )
    return checked.filter(F.size("errors") == 0).select(
        *[c for c in checked.columns if c not in ("value", "doc", "errors")],
        variant_text(doc["run_id"]).alias("run_id"),
        doc["saved_at"].alias("saved_at"),
        *[
            F.coalesce(strict_int(_part(state, key)), F.lit(0).cast("bigint")).alias(key)
            for key in ("posts_completed", "posts_skipped_empty", "comments_collected")
        ],
        collection.alias("collection"),
    )


def completed_ids(checked: DataFrame) -> DataFrame:
    """Post ids a comments-progress document lists as done, one row each."""
    ids = F.try_variant_get(F.col("doc.comments"), "$.completed_post_ids", "array<string>")
    return checked.filter(F.size("errors") == 0).select(
        variant_text(F.col("doc.run_id")).alias("run_id"), F.explode(ids).alias("post_id")
    )


def read_manifests(docs: DataFrame) -> DataFrame:
    """Parameters of readable manifests; an unreadable one gives nulls, not an error."""
    return (
        with_object(docs, "value", _MANIFEST, "__m")
        .select(
            F.regexp_extract("folder", "([^/]+)$", 1).alias("run_id"),
            F.when(variant_is_text(F.col("__m.started_at")), variant_text(F.col("__m.started_at"))).alias("started_at"),
            F.when(variant_type(F.col("__m.chunk_size")) == "BIGINT", strict_int(F.col("__m.chunk_size"))).alias(
                "chunk_size"
            ),
            F.when(_is_object(F.col("__m.params")), F.to_json(F.col("__m.params"))).alias("params"),
        )
    )


def discover_runs(found: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per run folder; a run whose data could not be counted has null counts."""
    return found.select("run_id").distinct().join(totals, "run_id", "left")
