"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy search.

Vectors are nodes; equal vectors are one node.  The graph starts from random
projections, and each round joins every node's neighbours, forward and reverse,
with each other: neighbours of neighbours are likely neighbours.  Queries walk the
graph from an entry, always expanding the best nodes that they have not expanded.
Vectors are drawn out to one length with one more component, so that the largest
inner product is the nearest vector and a neighbour graph is worth walking.  That
length is one per band of norms: each band has a graph of its own and a query walks
all of them, so a few very long vectors do not flatten the rest.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.common import Scratch

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    """``neighbours`` kept per node (at least the number asked for), ``reverse`` ones sampled per round, ``offers`` that
    a local join makes to one node at most, ``trees`` and ``leaf`` of the first graph, ``least_change`` of all edges at
    which rounds end, ``beam`` of the search, ``entries`` of a query into a band of norms that it is not in."""

    neighbours: int = 56
    reverse: int = 24
    offers: int = 10
    trees: int = 3
    leaf: int = 64
    least_change: float = 0.01
    max_rounds: int = 12
    beam: int = 40
    entries: int = 64
    seed: int = 5


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vector)`` in double precision, without rows that take no part.

    These are a null id, a null or zero vector, null or non-finite components, and
    a length other than the most common one.  Equal rows count once.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.filter("vec_id is not null and vector is not null").filter(F.coalesce(fine, F.lit(False)))
    length = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("vector") == (length["n"] if length else 0)).distinct()


#: Norms of a band differ by less than this factor.
BAND = 4.0


def _norm() -> F.Column:
    """The length of ``vector``, from components that are divided by the largest: squares neither overflow nor vanish."""
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    return most * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))


def banded(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``norm`` and ``band``, 0 for the longest."""
    sized = nodes.withColumn("norm", _norm())
    longest = sized.agg(F.max("norm")).first()[0] or 1.0
    # A difference of logarithms: the quotient of two norms may be too large for a double.
    return sized.withColumn("band", F.floor((F.lit(math.log(longest)) - F.log("norm")) / math.log(BAND) + 1e-9).cast("int"))


@dataclass(frozen=True)
class Band:
    """What the first graph needs to know of a band: how often to halve it, its longest norm, its middle direction."""

    depth: int
    longest: float
    middle: np.ndarray


def _leaves(bands: dict[int, Band], s: Settings):
    """Arrow batches of ``(node, vector, band)`` -> ``(node, short, band, tree, code, along)``: one row per tree."""
    rng = np.random.default_rng(s.seed)
    planes = rng.standard_normal((s.trees, max(b.depth for b in bands.values()) + 1, len(next(iter(bands.values())).middle)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            nodes, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for number in np.unique(member):
                band, rows = bands[int(number)], np.flatnonzero(member == number)
                n, depth, x = len(rows), band.depth, vectors[rows] / band.longest
                extra = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
                short = np.concatenate([x, extra[:, None]], 1).astype(np.float16)
                for t in range(s.trees):
                    side = (x - band.middle) @ planes[t].T
                    code = (side[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(n, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[rows]), pa.array([r.tobytes() for r in short], pa.binary()), pa.array(member[rows], pa.int32()), pa.array([t] * n, pa.int32()),
                         pa.array(code, pa.int64()), pa.array(side[:, depth], pa.float64())],
                        ["node", "short", "band", "tree", "code", "along"],
                    )

    return run


#: Rows of lists that a worker unpacks at once.
SLICE_ROWS = 128


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(at, SLICE_ROWS)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Number of the list that each entry of consecutive lists of these sizes is in."""
    return np.repeat(np.arange(len(sizes)), sizes)


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _best(group: np.ndarray, ids: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Places of the best ``keep`` entries of each group, best first, ties to the smaller id; an id counts once, in its first place."""
    order = np.lexsort((np.arange(len(ids)), ids, group))
    once = order[np.r_[True, (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])]] if len(order) else order
    ranked = once[np.lexsort((ids[once], -near[once], group[once]))]
    starts = np.r_[True, group[ranked][1:] != group[ranked][:-1]] if len(ranked) else np.zeros(0, bool)
    first = np.flatnonzero(starts)
    rank = np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)]))
    return ranked[rank < keep]


def _local_join(keep: int, best: int):
    """Rows with a list ``members`` of ``(id, short, least, fresh)`` -> ``(node, id, near)`` better than a node's ``least``.

    A list offers at most ``keep`` others to a node, and a slice of lists the ``best`` of these, so a node that stands
    in very many lists gets no more than that from each slice.
    """

    def joined(lists: pa.Array) -> tuple:
        flat = lists.flatten()
        ids, least, fresh = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "least", "fresh"))
        x = np.frombuffer(b"".join(flat.field("short").to_pylist()), np.float16).reshape(len(flat), -1).astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(_sizes(lists))])
        out: list[tuple] = [(ids[:0], ids[:0], x[:0, 0])]
        for a, b in zip(ends[:-1], ends[1:]):
            if not fresh[a:b].any():
                continue
            # A neighbour in both directions comes twice: once is enough, fresh if either is.
            own, first, place = np.unique(ids[a:b], return_index=True, return_inverse=True)
            new = np.zeros(len(own), bool)
            np.logical_or.at(new, place, fresh[a:b])
            v, limit = x[a:b][first], least[a:b][first]
            near = v @ v.T
            np.fill_diagonal(near, -np.inf)
            want = (near > limit[:, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(want, False)
            if len(own) > keep:
                top = np.where(want, near, -np.inf)
                want &= top >= np.partition(top, -keep, axis=1)[:, -keep, None]
            i, j = np.nonzero(want)
            out.append((own[i], own[j], near[i, j]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                lists = part.column(part.schema.get_field_index("members"))
                if not len(lists.flatten()):
                    continue
                node, ids, near = joined(lists)
                kept = _best(node, ids, near, best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[kept], kind) for v, kind in zip((node, ids, near), (pa.int64(), pa.int64(), pa.float32()))], ["node", "id", "near"]
                )

    return run


def _merge(keep: int):
    """Current lists and candidates of a node -> its best ``keep``, with the number of new ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                node, short, ids, nears, found = (part.column(part.schema.get_field_index(c)) for c in ("node", "short", "ids", "nears", "found"))
                had, more = _sizes(ids), _sizes(found)
                offered = found.flatten()
                group = np.concatenate([_places(had), _places(more)])
                name = np.concatenate([ids.flatten().to_numpy(zero_copy_only=False), offered.field("id").to_numpy(zero_copy_only=False)]).astype(np.int64)
                near = np.concatenate([nears.flatten().to_numpy(zero_copy_only=False), offered.field("near").to_numpy(zero_copy_only=False)]).astype(np.float32)
                # Known neighbours stand first, so an id that is known keeps its place there.
                kept = _best(group, name, near, keep)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(group[kept], minlength=part.num_rows))]), pa.int32())
                columns = [
                    pa.ListArray.from_arrays(ends, pa.array(v, kind))
                    for v, kind in ((name[kept], pa.int64()), (near[kept], pa.float32()), (kept >= had.sum(), pa.bool_()))
                ]
                yield pa.RecordBatch.from_arrays([node, short, *columns], ["node", "short", "ids", "nears", "fresh"])

    return run


GRAPH = "node bigint, short binary, ids array<bigint>, nears array<float>, fresh array<boolean>"
MEMBER = ("id", "short", "least", "fresh")


def _improved(members: DataFrame, graph: DataFrame, keep: int, offers: int) -> DataFrame:
    """One local join: ``members`` has a bounded list per row; the graph with what it finds.

    Of all offers to a node its best ``keep`` different ones go on, so the list that is
    merged is bounded too; more could not enter its list.  One shuffle by node serves all of it.
    """
    found = members.select("members").mapInArrow(_local_join(offers, keep), "node bigint, id bigint, near float")
    once = found.repartition("node").groupBy("node", "id").agg(F.max("near").alias("near"))
    best = Window.partitionBy("node").orderBy(F.desc("near"), "id")
    found = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep)
    found = found.groupBy("node").agg(F.collect_list(F.struct("id", "near")).alias("found"))
    return graph.join(found, "node", "left").select("node", "short", "ids", "nears", "found").mapInArrow(_merge(keep), GRAPH)


def _reverse(graph: DataFrame, most: int, salt: int) -> DataFrame:
    """``(node, id, fresh)``: for each node some of those that have it as neighbour, fresh ones first, then by hash."""
    back = graph.select(F.col("node").alias("id"), F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select(F.col("e.ids").alias("node"), "id", F.col("e.fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy(F.desc("fresh"), F.xxhash64("id", F.lit(salt)))
    return back.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")


def neighbour_graph(nodes: DataFrame, scratch: Scratch, s: Settings = Settings()) -> DataFrame:
    """``(node, vector, norm, band)`` with distinct nodes and vectors -> ``GRAPH``: the nearest neighbours found for each node in its band.

    A node's row carries its vector in short floats, in units of its band; a local join looks at no more
    than ``neighbours + reverse + 1`` of them.
    """
    figures = nodes.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.first(F.size("vector")).alias("d")).collect()
    if not figures:
        return nodes.sparkSession.createDataFrame([], GRAPH)
    # In units of a vector's own length means neither overflow nor vanish.
    means = nodes.groupBy("band").agg(*(F.avg(F.col("vector")[k] / F.col("norm")).alias(f"m{k}") for k in range(figures[0]["d"]))).collect()
    middle = {m["band"]: np.array(m[1:], float) for m in means}
    bands = {f["band"]: Band(max(0, math.ceil(math.log2(f["n"] / s.leaf))), f["longest"], middle[f["band"]]) for f in figures}
    placed = nodes.select("node", "vector", "band").mapInArrow(_leaves(bands, s), "node bigint, short binary, band int, tree int, code bigint, along double")
    placed = scratch.write(placed, "placed")
    # A leaf of any size is cut into runs of ``leaf`` nodes along one more direction.
    along = Window.partitionBy("band", "tree", "code").orderBy("along", "node")
    run = F.floor((F.row_number().over(along) - 1) / s.leaf)
    member = F.struct(F.col("node").alias("id"), "short", F.lit(float("-inf")).cast("float").alias("least"), F.lit(True).alias("fresh"))
    leaves = placed.withColumn("run", run).groupBy("band", "tree", "code", "run").agg(F.collect_list(member).alias("members"))
    empty = placed.filter("tree = 0").select("node", "short", *(F.array().cast(f"array<{k}>").alias(c) for c, k in (("ids", "bigint"), ("nears", "float"))))
    graph = scratch.write(_improved(leaves, empty, s.neighbours, s.neighbours), "graph")
    edges = sum(f["n"] * min(s.neighbours, f["n"] - 1) for f in figures)
    for number in range(s.max_rounds):
        ahead = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("id"), F.col("e.fresh").alias("fresh"))
        itself = graph.select("node", F.col("node").alias("id"), F.lit(False).alias("fresh"))
        around = ahead.unionByName(_reverse(graph, s.reverse, number)).unionByName(itself)
        full = F.size("nears") >= s.neighbours
        known = graph.select(F.col("node").alias("id"), "short", F.when(full, F.array_min("nears")).otherwise(F.lit(float("-inf"))).cast("float").alias("least"))
        members = around.join(known, "id").groupBy("node").agg(F.collect_list(F.struct(*MEMBER)).alias("members"))
        graph = scratch.write(_improved(members, graph, s.neighbours, s.offers), "graph")
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0]
        if changed <= s.least_change * edges:
            break
    scratch.drop("placed")
    return graph


def _near_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's short vector and a list of nodes of one band with theirs -> ``(query, band, node, near)``."""
    for batch in batches:
        for part in _slices(batch):
            queries, bands, shorts, lists = (part.column(part.schema.get_field_index(c)) for c in ("query", "band", "q", "reached"))
            flat, n = lists.flatten(), _sizes(lists)
            if not len(flat):
                continue
            q = np.frombuffer(b"".join(shorts.to_pylist()), np.float16).reshape(len(n), -1).astype(np.float32)
            v = np.frombuffer(b"".join(flat.field("short").to_pylist()), np.float16).reshape(len(flat), -1).astype(np.float32)
            # The last component only levels lengths; against a query it must not count.
            near = np.einsum("ij,ij->i", np.repeat(q[:, :-1], n, axis=0), v[:, :-1])
            ids, member = (pa.array(np.repeat(c.to_numpy(zero_copy_only=False), n)) for c in (queries, bands))
            yield pa.RecordBatch.from_arrays([ids, member, flat.field("node"), pa.array(near, pa.float32())], ["query", "band", "node", "near"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        q, v = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("q", "v"))
        query, node = (batch.column(batch.schema.get_field_index(c)) for c in ("query", "node"))
        yield pa.RecordBatch.from_arrays([query, node, pa.array(np.einsum("ij,ij->i", q, v), pa.float64())], ["query", "node", "score"])


def greedy_search(entries: DataFrame, queries: DataFrame, nodes: DataFrame, graph: DataFrame, scratch: Scratch, most: int, s: Settings = Settings()) -> DataFrame:
    """``(query, node, score)``: the ``most`` best nodes that each query met on its walk, with exact scores.

    ``queries``: ``(query, q)`` with nodes of the graph; ``entries``: ``(query, band, node)`` to
    start from.  A round expands, for each query and band, all nodes among its best ``beam``
    that it has not expanded; the walk ends when there is none.  It goes by short
    vectors; of each band twice as many as asked for are then scored exactly.
    """
    shorts = graph.select("node", "short")
    asked = scratch.write(queries.select("query").join(shorts.select(F.col("node").alias("query"), F.col("short").alias("q")), "query"), "asked")

    def scored(pairs: DataFrame) -> DataFrame:
        reached = pairs.join(shorts, "node").groupBy("query", "band").agg(F.collect_list(F.struct("node", "short")).alias("reached"))
        return reached.join(asked, "query").select("query", "band", "q", "reached").mapInArrow(_near_scores, "query bigint, band int, node bigint, near float")

    met = scratch.write(scored(entries).withColumn("expanded", F.lit(False)), "met")
    best = Window.partitionBy("query", "band").orderBy(F.desc("near"), "node")
    while True:
        ranked = met.withColumn("rank", F.row_number().over(best))
        now = ranked.filter((F.col("rank") <= s.beam) & ~F.col("expanded")).select("query", "band", "node")
        if not now.limit(1).count():
            break
        reached = now.join(graph.select("node", "ids"), "node").select("query", "band", F.explode("ids").alias("node")).distinct()
        fresh = scored(reached.join(met.select("query", "node"), ["query", "node"], "left_anti")).withColumn("expanded", F.lit(False))
        marked = ranked.withColumn("expanded", F.col("expanded") | (F.col("rank") <= s.beam)).drop("rank")
        met = scratch.write(marked.unionByName(fresh), "met")
    near = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= 2 * most).select("query", "node")
    exact = near.join(nodes.select("node", F.col("vector").alias("v")), "node").join(queries, "query")
    exact = exact.select("query", "node", "q", "v").mapInArrow(_scores, "query bigint, node bigint, score double")
    return exact.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(F.col("place") <= most).drop("place")


def _entries(sample: list[tuple[int, int]]):
    """Queries ``(query, band)`` -> ``(query, band, node)``: itself in its own band, the ``(band, node)`` of the sample in the others."""
    bands, nodes = np.array(sample, np.int64).reshape(-1, 2).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            columns = [(queries, own, queries)]
            columns += [(np.full((bands != b).sum(), q), bands[bands != b], nodes[bands != b]) for q, b in zip(queries, own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([c[k] for c in columns]), kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["query", "band", "node"]
            )

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, s: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product found for each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; a query is no
    candidate of its own, but rows with an equal vector are.  Nearest first, equal
    scores by ``vec_id``.  With at most ``k`` other rows all are returned.  What takes no
    part is listed at ``usable``.  The vectors themselves need not differ: of equal ones
    the graph holds one, and the result its ``k + 1`` smallest ids, all that can be asked for.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.write(usable(vectors), "rows")
    nodes = scratch.write(banded(scratch.write(rows.groupBy("vector").agg(F.min("vec_id").alias("node")), "distinct")), "nodes")
    named = scratch.write(rows.join(nodes, "vector").select("vec_id", "node"), "named")
    graph = neighbour_graph(nodes, scratch, s)
    asked = named.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    # Queries with equal vectors walk once, from their own node.
    starts = asked.select("query").distinct()
    queries = scratch.write(starts.join(nodes.withColumnRenamed("node", "query"), "query").select("query", F.col("vector").alias("q"), "band"), "queries")
    some = Window.partitionBy("band").orderBy(F.xxhash64("node", F.lit(s.seed)))
    sample = nodes.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= s.entries).select("band", "node").collect()
    entries = queries.select("query", "band").mapInArrow(_entries([tuple(r) for r in sample]), "query bigint, band int, node bigint")
    near = greedy_search(entries, queries.select("query", "q"), nodes.select("node", "vector"), graph, scratch, k + 1, s)
    first = Window.partitionBy("node").orderBy("vec_id")
    copies = named.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).drop("copy")
    answers = asked.join(near, "query").join(copies, "node").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
