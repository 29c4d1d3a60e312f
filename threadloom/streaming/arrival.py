"""First arrivals by keyed state: which copy of an id came first, whatever batch it was in.

The state store (RocksDB) keeps the ids that arrived and nothing of their content,
so a batch costs what it holds, not what is stored.  Copies inside a micro-batch
are cut to the first one by place before the state is asked, in groups of ids, so
that no id costs a call of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.functions.scalars import dedup_key

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Where a record arrived: file, split of the file, row of the split.
PLACE = ("page", "block", "line")
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Starts the keys of rows that have no id: each is a key of its own.
ALONE = "\u0000"
#: Groups of ids that a task looks at as a whole: a group holds about this part of a micro-batch.
GROUPS = 4096
#: Rows without an id pass the state together, so many under one key.
ALONE_ROWS = 1000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``line``, the number of a row in its task, and of equal keys in a batch of rows keep the first."""
    done = 0
    for batch in batches:
        line = range(done, done + batch.num_rows)
        done += batch.num_rows
        place = pd.DataFrame({c: batch.column(batch.schema.get_field_index(c)).to_pandas() for c in ("key", "page", "block")})
        place["line"] = line
        kept = place.sort_values(list(PLACE)).drop_duplicates("key").index.sort_values()
        rows = batch.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(place["line"].loc[kept], pa.int64())], [*rows.schema.names, "line"])


def _first_of_group(table: pa.Table) -> pa.Table:
    """``key, rows``: of each key the first row by place; rows without an id all, many under one key."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in PLACE])
    ranked = pa.table({"key": table["key"].take(order), "at": order})
    rows = table.take(ranked.group_by("key", use_threads=False).aggregate([("at", "first")])["at_first"])
    alone = pc.starts_with(rows["key"], ALONE)
    rows = pa.concat_tables([rows.filter(pc.invert(alone)), rows.filter(alone)])
    known = rows.num_rows - pc.sum(alone).as_py()
    starts = [*range(known), *range(known, rows.num_rows, ALONE_ROWS)]
    packed = pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) for c in rows.columns], rows.column_names)
    lists = pa.ListArray.from_arrays(pa.array([*starts, rows.num_rows], pa.int32()), packed)
    return pa.table({"key": rows["key"].take(pa.array(starts, pa.int64())), "rows": lists})


def first_arrivals(items: DataFrame, record_id: str = "id") -> DataFrame:
    """The stream ``items`` (with ``page`` and ``block``) reduced to the first arrival of each id, with ``key`` and ``line``.

    Rows without an id all pass; the key of other rows is their id as it is compared.
    Copies of an id inside one batch of rows are
    dropped before the shuffle, so an id that fills a third of the stream sends
    one row per such batch.  The query that runs it needs ``STATE_CONF``.
    """
    alone = F.concat(F.lit(ALONE), F.uuid())
    keyed = items.withColumn("key", F.coalesce(dedup_key(record_id), alone))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    numbered = keyed.mapInArrow(_numbered, f"{columns}, line bigint")
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in numbered.schema)
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS))
    firsts = numbered.groupBy(group).applyInArrow(_first_of_group, f"key string, rows array<struct<{row}>>")
    return firsts.dropDuplicates(["key"]).select(F.inline("rows"))


def write_arrivals(rows: DataFrame, checkpoint: str, batch_id: int) -> None:
    """Note the places of the ids of a micro-batch beside the state that knows them; a replay writes them again."""
    known = rows.filter(~F.col("key").startswith(ALONE)).select(F.col("key").alias("id"), *PLACE)
    known.write.mode("overwrite").parquet(f"{_arrivals(checkpoint)}/batch_id={batch_id}")


def _arrivals(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/arrivals"


def known_arrivals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``id, page, block, line``: what the query of a checkpoint knows, and where it arrived first."""
    return spark.read.schema("id string, page string, block bigint, line bigint").parquet(_arrivals(checkpoint))
