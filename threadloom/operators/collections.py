"""Collection identity: names, compatibility, lookup, catalog, specifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadloom.functions import scalars as S
from threadloom.functions.jsonrows import with_object
from threadloom.schemas import DOCUMENT_VERSION, FILTER_KEYS, LOG_LEVELS, MAX_PAGE_SIZE, MAX_TREE_LIMIT, SAFE_FIELDS, SAFE_OUTPUT_FIELDS

def with_identity(specs: DataFrame) -> DataFrame:
    """Add name, display name, key and date tokens to request specifications.

    ``specs`` has ``subreddit``, ``after`` and ``before`` as text.
    """
    after, before = S.date_token("after"), S.date_token("before")
    return (
        specs.withColumn("subreddit_display", S.community_display("subreddit"))
        .withColumn("subreddit_norm", S.community_key("subreddit"))
        .withColumn("after_token", after)
        .withColumn("before_token", before)
        .withColumn("name", S.collection_name("subreddit", F.col("after_token"), F.col("before_token")))
    )


def safe_summary(specs: DataFrame) -> DataFrame:
    """Only the fields that may be shown; anything else never leaves this function.

    Of an ``output`` struct only ``SAFE_OUTPUT_FIELDS`` go out.
    """
    shown = specs.select(*[c for c in SAFE_FIELDS if c in specs.columns])
    kind = shown.schema["output"].dataType if "output" in shown.columns else None
    if kind is None:
        return shown
    inner = [F.col("output")[f].alias(f) for f in SAFE_OUTPUT_FIELDS if isinstance(kind, T.StructType) and f in kind.fieldNames()]
    return shown.withColumn("output", F.when(F.col("output").isNotNull(), F.struct(*inner))) if inner else shown.drop("output")


# ----------------------------------------------------------- compatibility


def _json_equals(stored: Column, wanted: Column) -> Column:
    """Stored JSON value against wanted text; JSON null equals a null wish."""
    stored_text = F.when(S.variant_type(stored) == "VOID", F.lit(None).cast("string")).otherwise(S.variant_text(stored))
    return stored_text.eqNullSafe(wanted)


def first_mismatch(pairs: DataFrame, request: str = "request", stored: str = "stored") -> Column:
    """Name of the first identity part that differs, or null when compatible.

    ``request`` is a struct of text fields (the filter keys and ``sort``),
    ``stored`` a struct as made by ``documents.read_posts_progress``.  Order of
    the checks: community, dates, filters, sort.  A key missing from a stored
    collection block counts as equal; documents without a block are compared by
    their paging filters.
    """
    r = {k: F.col(f"{request}.{k}") for k in (*FILTER_KEYS, "sort")}
    c = {k: F.col(f"{stored}.collection.{k}") for k in (
        "subreddit", "subreddit_norm", "after_token", "before_token", "title", "query", "selftext", "author", "sort")}
    f = {k: F.col(f"{stored}.filters.{k}") for k in FILTER_KEYS}
    want_key = S.community_key(r["subreddit"])
    stored_key = F.coalesce(S.variant_text(c["subreddit_norm"]), F.lower(S.variant_text(c["subreddit"])))

    def token_differs(side: str) -> Column:
        kept = c[f"{side}_token"]
        return kept.isNotNull() & (F.coalesce(S.variant_text(kept), F.lit("None")) != S.date_token(r[side]))

    block = F.coalesce(
        F.when(~stored_key.eqNullSafe(want_key), "subreddit"),
        F.when(token_differs("after"), "after"),
        F.when(token_differs("before"), "before"),
        *[F.when(c[k].isNotNull() & ~_json_equals(c[k], r[k]), k) for k in ("title", "query", "selftext", "author", "sort")],
    )

    def stored_token(side: str) -> Column:
        return S.date_token(F.when(S.variant_type(f[side]) != "VOID", S.variant_text(f[side])), S.variant_type(f[side]))

    stored_name = F.when(S.variant_is_text(f["subreddit"]), S.community_key(S.variant_text(f["subreddit"])))
    both = stored_name.isNotNull() & want_key.isNotNull()
    legacy = F.coalesce(
        # A name that cannot be read on either side compares as unknown on both.
        F.when(both & (stored_name != want_key), "subreddit"),
        F.when(stored_token("after") != S.date_token(r["after"]), "after"),
        F.when(stored_token("before") != S.date_token(r["before"]), "before"),
        *[F.when(~_json_equals(f[k], r[k]), k) for k in ("title", "query", "selftext", "author")],
        F.when(~_json_equals(F.col(f"{stored}.pager_sort"), r["sort"]), "sort"),
    )
    return F.when(F.col(f"{stored}.collection").isNotNull(), block).otherwise(legacy)


def resume_gate(request: str = "request", stored: str = "stored") -> Column:
    """Why an exact resume is refused, or null: version, sort, then all filters as stored."""
    version = F.try_variant_get(F.col(f"{stored}.pager_version"), "$", "double")
    same_filters = reduce(
        lambda a, b: a & b,
        [
            # A key missing from the stored filters is a difference, even to a null wish.
            F.col(f"{stored}.filters.{k}").isNotNull()
            & _json_equals(F.col(f"{stored}.filters.{k}"), F.col(f"{request}.{k}"))
            for k in FILTER_KEYS
        ],
    )
    return F.coalesce(
        F.when(~F.coalesce(version == DOCUMENT_VERSION, F.lit(False)), "version"),
        F.when(~_json_equals(F.col(f"{stored}.pager_sort"), F.col(f"{request}.sort")), "sort"),
        F.when(~F.coalesce(F.col(f"{stored}.filters").isNotNull() & same_filters, F.lit(False)), "filters"),
    )


def find_collections(requests: DataFrame, catalog: DataFrame, wanted: str = "wanted") -> DataFrame:
    """Saved collection for each wanted name: exact, else a unique match ignoring case.

    The catalog is reduced to one row per lower-cased name before the join, so
    many spellings of one name do not multiply requests.
    """
    name = S.sanitize_name_part(wanted, 128)
    spelled = catalog.groupBy(F.lower("name").alias("__low"), F.col("name").alias("found")).agg(F.count(F.lit(1)).alias("__c"))
    loose = spelled.groupBy("__low").agg(F.count(F.lit(1)).alias("__n"), F.min("found").alias("__only"))
    exact = spelled.select(F.col("found").alias("__exact"))
    return (
        requests.withColumn("__name", name)
        .join(exact, F.col("__name") == F.col("__exact"), "left")
        .join(loose, F.lower("__name") == F.col("__low"), "left")
        .withColumn("found", F.coalesce("__exact", F.when(F.col("__n") == 1, F.col("__only"))))
        .drop("__name", "__exact", "__low", "__n", "__only")
    )


def run_binding(posts_progress: DataFrame, comments_progress: DataFrame) -> DataFrame:
    """Collections whose comment progress belongs to another run than their posts."""
    p = posts_progress.select("name", F.col("run_id").alias("posts_run"))
    c = comments_progress.select("name", F.col("run_id").alias("comments_run"))
    return p.join(c, "name").filter(~F.col("posts_run").eqNullSafe(F.col("comments_run")))


# ----------------------------------------------------------------- catalog


def catalog(posts_docs: DataFrame, comments_docs: DataFrame) -> DataFrame:
    """One row per saved collection.

    ``posts_docs``: ``name, error, run_id, saved_at, total_fetched, max_posts``;
    ``comments_docs``: ``name, error, posts_completed, posts_skipped_empty,
    comments_collected``.  Broken documents become rows with ``error``.
    """
    p = posts_docs.select(
        F.col("name"),
        F.lit(True).alias("p_there"),
        F.col("error").alias("p_error"),
        "run_id",
        "saved_at",
        "total_fetched",
        "max_posts",
    )
    c = comments_docs.select(
        F.col("name").alias("c_name"),
        F.lit(True).alias("c_there"),
        F.col("error").alias("c_error"),
        "posts_completed",
        "posts_skipped_empty",
        "comments_collected",
    )
    joined = p.join(c, F.col("name") == F.col("c_name"), "full_outer")
    has_posts = F.coalesce("p_there", F.lit(False)) & F.col("p_error").isNull()
    has_comments = F.coalesce("c_there", F.lit(False)) & F.col("c_error").isNull()
    reached = (F.col("max_posts") > 0) & (F.col("total_fetched") >= F.col("max_posts"))
    progress = F.when(has_posts, F.when(F.coalesce(reached, F.lit(False)), "complete").otherwise("in_progress"))
    return joined.select(
        F.coalesce("name", "c_name").alias("name"),
        F.when(F.col("p_error").isNotNull(), "error")
        .when(has_posts, progress)
        .when(has_comments, "comments_only")
        .otherwise("empty")
        .alias("status"),
        has_posts.alias("has_posts"),
        has_comments.alias("has_comments"),
        "run_id",
        "saved_at",
        "total_fetched",
        "posts_completed",
        "posts_skipped_empty",
        "comments_collected",
        F.col("p_error").alias("error"),
        F.col("c_error").alias("comments_error"),
    )


def migratable(legacy: DataFrame, saved_names: DataFrame) -> DataFrame:
    """Old-style progress that may be copied into its named collection.

    ``legacy``: ``name`` (target), ``mismatch``, ``posts_run``, ``comments_run``.
    Refused: incompatible, different runs, or a target that already exists.
    """
    taken = saved_names.select(F.col("name").alias("__taken")).distinct()
    same_run = F.col("comments_run").isNull() | F.col("posts_run").isNull() | (F.col("posts_run") == F.col("comments_run"))
    return legacy.filter(F.col("mismatch").isNull() & same_run).join(taken, F.col("name") == F.col("__taken"), "left_anti")


def free_run_ids(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Run ids for new runs: the wanted one, or ``-2``, ``-3`` … after those taken.

    ``wanted``: distinct ``run_id``.  The first free number is found by a
    gap test on the taken suffixes, not by trying one after the other.
    """
    base = wanted.select(S.sanitize_run_part("run_id").alias("base")).distinct()
    used = existing.select(
        F.regexp_replace("run_id", "-[0-9]+$", "").alias("stem"),
        F.regexp_extract("run_id", "-([0-9]+)$", 1).try_cast("bigint").alias("n"),
        F.col("run_id").alias("full"),
    ).distinct()
    plain = used.select(F.col("full").alias("base"), F.lit(1).cast("bigint").alias("n"))
    suffixed = used.filter("n >= 2").select(F.col("stem").alias("base"), "n")
    numbers = plain.unionByName(suffixed).distinct()
    following = numbers.select("base", (F.col("n") - 1).alias("n"), F.lit(True).alias("__next"))
    # The first taken number whose successor is free, counting from 1 upward.
    gaps = numbers.join(following, ["base", "n"], "left").filter("__next is null").groupBy("base").agg(F.min("n").alias("last"))
    has_plain = numbers.filter("n = 1").select("base", F.lit(True).alias("__taken"))
    return (
        base.join(has_plain, "base", "left")
        .join(gaps, "base", "left")
        .select(
            "base",
            F.when(F.col("__taken").isNull(), F.col("base"))
            .otherwise(F.concat("base", F.lit("-"), (F.col("last") + 1).cast("string")))
            .alias("run_id"),
        )
    )


# ------------------------------------------------------------ spec checks

_SECTIONS = ("api", "output", "collection", "comments", "logging")
_SPEC_JSON = ", ".join(
    f"{key} variant" for key in (*_SECTIONS, *"subreddit title query selftext author after before limit sort max_posts".split())
)


def spec_violations(specs: DataFrame, value: str = "value") -> DataFrame:
    """All violations of each request specification (JSON object) in ``errors``.

    A missing key or section takes its default and is fine; an explicit null is
    checked.  A section that is no object has one violation, and its keys none.
    Text that is not exactly one object has only that to say.
    """
    parsed = with_object(specs, value, _SPEC_JSON, "__s")

    def at(path: str) -> Column:
        section, _, key = path.partition(".")
        return F.try_variant_get(F.col(f"__s.{section}"), f"$.{key}", "variant") if key else F.col(f"__s.{section}")

    def null(v: Column) -> Column:
        return F.coalesce(S.variant_type(v) == "VOID", F.lit(False))

    def filled(v: Column) -> Column:
        return S.variant_is_text(v) & F.coalesce(S.trim_ws(S.variant_text(v)) != "", F.lit(False))

    def whole_in(v: Column, low: int, high: int | None = None) -> Column:
        n = F.try_variant_get(v, "$", "bigint")
        ok = (S.variant_type(v) == "BIGINT") & (n >= low)
        return F.coalesce(ok if high is None else ok & (n <= high), F.lit(False))

    def positive(v: Column) -> Column:
        return F.coalesce(S.json_number(v) > 0, F.lit(False))

    def is_level(v: Column) -> Column:
        return F.coalesce(F.upper(S.variant_text(v)).isin(*LOG_LEVELS), F.lit(False))

    def rule(path: str, ok, need: str, required: bool = False) -> Column:
        """``path: need`` when the value at ``path`` is there (or required) and not ok."""
        v = at(path)
        broken = ~ok(v) if required else ~(v.isNull() | ok(v))
        return F.when(F.coalesce(broken, F.lit(True)), f"{path}: {need}")

    filled_text, text_or_null = "non-empty text", "text or null"
    base_url, sort = at("api.base_url"), at("sort")
    is_url = F.coalesce(F.lower(S.variant_text(base_url)).rlike("^https?://"), F.lit(False))
    is_sort = S.variant_is_text(sort) & F.coalesce(S.variant_text(sort).isin("asc", "desc"), F.lit(False))

    def section(name: str) -> Column:
        return rule(name, lambda v: S.variant_type(v).startswith("OBJECT"), "object")

    rules = [
        section("api"),
        rule("api.base_url", filled, filled_text),
        rule("api.base_url", lambda v: ~filled(v) | is_url, "http(s) address"),
        rule("subreddit", filled, filled_text, required=True),
        rule("limit", lambda v: whole_in(v, 1, MAX_PAGE_SIZE), f"integer 1-{MAX_PAGE_SIZE}"),
        rule("sort", lambda v: is_sort, "asc or desc"),
        rule("max_posts", lambda v: null(v) | whole_in(v, 1), "positive integer or null"),
    ]
    for key in ("title", "query", "selftext", "author"):
        rules.append(rule(key, lambda v: null(v) | S.variant_is_text(v), text_or_null))
        rules.append(rule(key, lambda v: ~S.variant_is_text(v) | filled(v), f"{filled_text} or null"))
    for key in ("after", "before"):
        rules.append(
            rule(
                key,
                lambda v: null(v) | S.variant_is_text(v) | S.json_number(v).isNotNull(),
                "date text, epoch number or null",
            )
        )
        rules.append(rule(key, lambda v: ~S.variant_is_text(v) | filled(v), f"{filled_text} or null"))
    rules.append(section("output"))
    for key in ("raw_dir", "processed_dir", "checkpoint_dir"):
        rules.append(rule(f"output.{key}", filled, filled_text))
    rules.append(rule("output.chunk_size", lambda v: null(v) | whole_in(v, 1), "positive integer"))
    rules.append(section("collection"))
    for key in ("throttle_qps", "timeout_secs", "backoff_base_secs", "backoff_max_secs"):
        rules.append(rule(f"collection.{key}", positive, "positive number"))
    rules += [
        rule("collection.max_retries", lambda v: whole_in(v, 0), "integer >= 0"),
        section("comments"),
        rule("comments.tree_limit", lambda v: whole_in(v, 1, MAX_TREE_LIMIT), f"integer 1-{MAX_TREE_LIMIT}"),
        rule("comments.max_comment_posts", lambda v: null(v) | whole_in(v, 1), "positive integer or null"),
        rule("comments.skip_empty_posts", lambda v: S.variant_type(v) == "BOOLEAN", "true or false"),
        section("logging"),
        rule("logging.level", is_level, "one of " + ", ".join(LOG_LEVELS)),
        rule("logging.file", filled, filled_text),
    ]
    errors = F.filter(F.array(*rules), lambda r: r.isNotNull())
    unusable = F.array(F.lit("not a JSON object"))
    return parsed.withColumn("errors", F.when(F.col("__s").isNotNull(), errors).otherwise(unusable)).drop("__s")
