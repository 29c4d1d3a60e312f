import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from llm_helpers import SF, read
from threadloom.llm import shards
from threadloom.llm.common import shared_folder
from threadloom.llm.queries import QUERIES


def gapless(rows):
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    return all(sorted(p) == list(range(len(p))) for p in places.values())


def test_query(spark):
    texts = dict(read(f"select doc_id, text from '{SF}/documents.parquet'"))
    rows = QUERIES["op7_virtual_slots"](spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts.items()}
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert gapless(rows) and set(load) == set(range(16)) and {r.law for r in rows} == {"bytes"}
    assert max(load.values()) - min(load.values()) <= max(len((t or "").encode()) for t in texts.values()) + 1
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op7_virtual_slots"](spark, SF).collect()))


def test_rebalancing_edits_the_map(spark):
    sizes = spark.createDataFrame([(k, 100 + k % 7, 1) for k in range(64)], "virtual_slot int, bytes long, n_rows long")
    first = {r.virtual_slot: r.shard for r in shards.balanced_map(spark, sizes, 4, n_slots=64).collect()}
    assert set(first) == set(range(64))
    current = spark.createDataFrame(list(first.items()), "virtual_slot int, shard int")
    same = {r.virtual_slot: r.shard for r in shards.balanced_map(spark, sizes, 4, current, 64).collect()}
    assert same == first
    grown = {r.virtual_slot: r.shard for r in shards.balanced_map(spark, sizes, 5, current, 64).collect()}
    assert sum(grown[k] != first[k] for k in first) <= 16 and 11 <= sum(s == 4 for s in grown.values()) <= 14
    shrunk = {r.virtual_slot: r.shard for r in shards.balanced_map(spark, sizes, 3, current, 64).collect()}
    assert set(shrunk.values()) == {0, 1, 2} and all(shrunk[k] == first[k] for k in first if first[k] < 3)
    heavy = sizes.withColumn("bytes", F.when(F.col("virtual_slot").isin([k for k in first if first[k] == 0]), 300).otherwise(F.col("bytes")))
    load = Counter()
    moved = {r.virtual_slot: r.shard for r in shards.balanced_map(spark, heavy, 4, current, 64).collect()}
    for r in heavy.collect():
        load[moved[r.virtual_slot]] += r.bytes
    assert max(load.values()) - min(load.values()) <= 300 and all(moved[k] == first[k] or first[k] == 0 for k in first)


def test_versions_stay(spark):
    folder = shared_folder(spark, "maps")
    for version, shard in ((1, 0), (2, 3)):
        shards.store_map(spark.createDataFrame([(0, shard)], "virtual_slot int, shard int"), folder, version)
    assert [shards.stored_map(spark, folder, v).first().shard for v in (1, 2)] == [0, 3]


def test_one_id_with_most_rows(spark):
    """Repeated and null ids do not bend the law."""
    docs = spark.range(8000).selectExpr("case when id % 4 = 0 then id when id % 4 = 1 then null else 7 end doc_id", "concat('text ', id) text")
    rows, load = shards.shard(docs, shared_folder(spark, "maps")).collect(), Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert len(rows) == 8000 and gapless(rows) and max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 16


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = shards.shard(odd_docs, shared_folder(spark, "maps"), 3, 32).collect()
    assert len(rows) == len(odd_rows) and gapless(rows)
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(1, 0)}
    assert shards.shard(no_docs, shared_folder(spark, "maps")).count() == 0
