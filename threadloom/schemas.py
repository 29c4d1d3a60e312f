"""Record schemas and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: they decide results, so they are stated here as they are ---
SITE_BASE = "https://www.reddit.com"
DEFAULT_CHUNK_SIZE = 50000
DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
MAX_TREE_LIMIT = 25000
DOCUMENT_VERSION = 1
OPEN_DATE_TOKEN = "open"
SENSITIVE_KEY_PATTERN = "key|token|secret|password|credential|auth"
REDACTED = "***REDACTED***"
TRANSIENT_TIMEOUT_PATTERN = r"timed?\s*-?\s*out|slow\s*down"
SMOKE_POST_CAP = 5
LOG_PAGE_PATTERN = r"Page\s+(\d+):\s+(\d+)\s+new posts"
LOG_TOTAL_PATTERN = r"\((\d+)(?:/\d+)? total\)"
LOG_POST_PATTERN = r"Post \S+: (\d+) comments \((\d+) posts done\)"
LOG_SAVED_PATTERN = r"(\d+) posts done, (\d+) comments"
LOG_LINE_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+)\s* \| (\S+) \| ([\s\S]*)$"
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
POSTS_DOCUMENT_NAMES = ("posts-checkpoint.json", "checkpoint.json")
COMMENTS_DOCUMENT_NAMES = ("comments-checkpoint.json",)
MANIFEST_NAMES = ("manifest.json",)
SAFE_FIELDS = (
    "subreddit",
    "title",
    "query",
    "selftext",
    "after",
    "before",
    "limit",
    "sort",
    "max_posts",
    "throttle_qps",
    "chunk_size",
    "output",
)
SAFE_OUTPUT_FIELDS = ("raw_dir", "processed_dir", "checkpoint_dir", "chunk_size")
STREAMS = ("raw_posts", "processed_posts", "raw_comments", "processed_comments")
FILTER_KEYS = ("subreddit", "title", "query", "selftext", "author", "after", "before")
# ------------------------------------------------------------------------------

POST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("num_comments", T.LongType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("created_iso", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("permalink", T.StringType()),
    ]
)

COMMENT = T.StructType(
    [
        T.StructField("comment_id", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("parent_kind", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("subreddit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("created_iso", T.StringType()),
        T.StructField("permalink", T.StringType()),
        T.StructField("collapsed_children", T.ArrayType(T.StringType())),
        T.StructField("collapsed_count", T.LongType()),
    ]
)

POST_FIELDS = tuple(POST.fieldNames())
COMMENT_FIELDS = tuple(COMMENT.fieldNames())
