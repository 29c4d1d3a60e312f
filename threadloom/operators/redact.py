"""Masking of credential-looking values."""

from __future__ import annotations

import json
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadloom.schemas import REDACTED, SENSITIVE_KEY_PATTERN

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _masked(value: Column, kind: T.DataType, hide: Column | bool, pattern: re.Pattern) -> Column:
    """``hide``: whether the key above says so, known now or (map keys) per row."""
    if isinstance(kind, T.StructType):
        parts = [
            _masked(value[f.name], f.dataType, bool(pattern.search(f.name)), pattern).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        # Elements are judged by the key of the list.
        return F.transform(value, lambda item: _masked(item, kind.elementType, hide, pattern))
    if isinstance(kind, T.MapType):
        return F.transform_values(
            value,
            lambda k, v: _masked(v, kind.valueType, k.cast("string").rlike("(?i)" + pattern.pattern), pattern),
        )
    if isinstance(hide, bool):
        return F.lit(REDACTED) if hide else value
    return F.when(hide, REDACTED).otherwise(value.cast("string"))


def redact_columns(df: DataFrame, pattern: str = SENSITIVE_KEY_PATTERN) -> DataFrame:
    """Replace every value whose own key matches ``pattern`` (any case, anywhere in
    the key, so ``author`` matches ``auth``).  A container under such a key is
    still entered and judged by its own keys; list items by the key of the list.
    """
    compiled = re.compile(pattern, re.IGNORECASE)
    return df.select(*[_masked(F.col(f"`{f.name}`"), f.dataType, bool(compiled.search(f.name)), compiled).alias(f.name) for f in df.schema.fields])


_JSON_TOKEN = re.compile(
    r"""[\x20\t\n\r]*+(?:([\[\]{},:])|("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")"""
    r"""|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null))"""
)


def _masker(pattern: str):
    """JSON text -> the same tokens without white space, scalars under sensitive keys masked; None unless it is one object."""
    sensitive, hidden = re.compile(pattern, re.IGNORECASE), json.dumps(REDACTED)

    def one(text: str | None) -> str | None:
        out: list[str] = []
        open_: list[tuple[str, bool]] = []  # containers around, and whether the key above each is sensitive
        at, expect, hide = 0, "object", False
        while expect != "nothing":
            token = _JSON_TOKEN.match(text, at)
            if not token:
                return None
            at = token.end()
            mark, string, other = token.groups()
            found = mark or string or other
            if mark and mark in "}]" and expect in ("comma", f"first {mark}"):
                start, hide = open_.pop()
                if start + mark not in ("{}", "[]"):
                    return None
                expect = "comma"
            elif mark == "," and expect == "comma":
                expect = "key" if open_[-1][0] == "{" else "value"
                hide = open_[-1][1]
            elif mark == ":" and expect == "colon":
                expect = "value"
            elif string and expect in ("key", "first }"):
                expect, hide = "colon", bool(sensitive.search(json.loads(string)))
            elif mark == "{" and expect in ("object", "value", "first ]"):
                open_.append((mark, hide))
                expect = "first }"
            elif mark == "[" and expect in ("value", "first ]"):
                open_.append((mark, hide))
                expect = "first ]"
            elif not mark and expect in ("value", "first ]"):
                found, expect = hidden if hide else found, "comma"
            else:
                return None
            out.append(found)
            if not open_:
                expect = "nothing"
        return "".join(out) if not text[at:].strip(" \t\n\r") else None

    return one


def redact_json_map(value: Column | str, pattern: str = SENSITIVE_KEY_PATTERN) -> Column:
    """Masked copy of a JSON object held as text, nested objects and lists included.

    The rules are those of :func:`redact_columns`.  What is not masked stays as it is
    written, but for white space between tokens: numbers of any length, escapes (half
    surrogates too), repeated keys, which are each masked, and any depth.  Anything but
    one JSON object gives null: what cannot be read cannot be shown.  JSON of unknown
    depth has no built-in walk, hence Python over Arrow batches.
    """
    one = _masker(pattern)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return masked(value)
