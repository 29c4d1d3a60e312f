"""Life of a named collection: start, resume, reset, copy old-style progress.

The journal is append-only: one row per event.  The latest row of a name is its
state, so no file is ever rewritten and a reset touches only its own name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from threadloom.functions.scalars import run_id_for
from threadloom.operators.collections import free_run_ids, with_identity
from threadloom.schemas import FILTER_KEYS
from threadloom.sources.store import Store

_IDENTITY = (*FILTER_KEYS, "sort")


class CollectionError(Exception):
    """A collection cannot be started or resumed as asked."""


def _spec_row(store: Store, spec: dict) -> DataFrame:
    values = {k: None if spec.get(k) is None else str(spec[k]) for k in _IDENTITY}
    values["sort"] = values["sort"] or "asc"
    schema = ", ".join(f"{k} string" for k in values)
    return with_identity(store.spark.createDataFrame([tuple(values.values())], schema))


def current(store: Store) -> DataFrame:
    """Latest event per collection, without those that were reset."""
    rows = store.read("journal")
    latest = rows.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct(*rows.columns), "at").alias("r"))
    return latest.select("r.*").filter("event <> 'reset'")


def _state_of(store: Store, name: str) -> dict | None:
    rows = current(store).filter(F.lower("name") == name.lower()).take(1)
    return rows[0].asDict() if rows else None


def _record(store: Store, name: str, run_id: str | None, event: str, identity: dict, max_posts: int | None) -> None:
    row = [(name, run_id, event, json.dumps(identity, sort_keys=True), max_posts)]
    df = store.spark.createDataFrame(row, "name string, run_id string, event string, identity string, max_posts bigint")
    store.append(
        "journal", df.select("name", "run_id", "event", F.current_timestamp().alias("at"), "identity", "max_posts")
    )


def start(store: Store, spec: dict, fresh: bool = False) -> dict:
    """Begin a collection under a new run id; refuse if it already has progress.

    ``fresh`` resets this collection only.  Stored data is kept either way.
    """
    row = _spec_row(store, spec)
    made = row.withColumn("run_id", run_id_for(F.current_timestamp(), "subreddit")).take(1)[0]
    if made["name"] is None:
        raise CollectionError("subreddit: non-empty text")
    known = _state_of(store, made["name"])
    identity = {k: made[k] for k in _IDENTITY}
    if known and not fresh:
        raise CollectionError(f"collection {known['name']!r} already has progress: resume it, or start it fresh")
    if known:
        _record(store, known["name"], known["run_id"], "reset", identity, spec.get("max_posts"))
    existing = store.read("journal").select("run_id").filter("run_id is not null").distinct()
    wanted = store.spark.createDataFrame([(spec.get("run_id") or made["run_id"],)], "run_id string")
    run_id = free_run_ids(wanted, existing).take(1)[0]["run_id"]
    _record(store, made["name"], run_id, "started", identity, spec.get("max_posts"))
    return {"name": made["name"], "run_id": run_id}


def resume(store: Store, spec: dict) -> dict:
    """Run id of the collection to continue; filters and sort must be as stored.

    Another ``max_posts`` than before is the collection's cap from now on.
    """
    made = _spec_row(store, spec).take(1)[0]
    known = _state_of(store, made["name"]) if made["name"] else None
    if not known:
        raise CollectionError(f"no progress for collection {made['name']!r}: nothing to resume")
    stored = json.loads(known["identity"])
    differs = [k for k in _IDENTITY if stored.get(k) != made[k]]
    if differs:
        raise CollectionError(f"collection {known['name']!r} was stored with another {differs[0]}")
    if not known["run_id"]:
        raise CollectionError(f"collection {known['name']!r} has no run id")
    if "max_posts" in spec and spec["max_posts"] != known["max_posts"]:
        _record(store, known["name"], known["run_id"], "cap", stored, spec["max_posts"])
    return {"name": known["name"], "run_id": known["run_id"]}


def reset(store: Store, name: str) -> bool:
    """Forget the progress of one collection; its data and all others stay."""
    known = _state_of(store, name)
    if known:
        _record(store, known["name"], known["run_id"], "reset", json.loads(known["identity"]), known["max_posts"])
    return known is not None


def copy_old_progress(store: Store, accepted: DataFrame) -> None:
    """Add journal rows for old-style progress accepted by ``collections.migratable``.

    ``accepted``: ``name``, ``posts_run``, ``identity``, ``max_posts``.
    """
    store.append(
        "journal",
        accepted.select(
            "name",
            F.col("posts_run").alias("run_id"),
            F.lit("copied").alias("event"),
            F.current_timestamp().alias("at"),
            "identity",
            F.col("max_posts").cast("bigint").alias("max_posts"),
        ),
    )
