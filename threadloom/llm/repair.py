"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation is brought to ``system? (user assistant)+``, or to nothing, by the
cheapest edits of its rows.  Costs to go are a vector with one entry per state, and
a row maps the vector behind it to the one before it.  Rows lie in one global order
over range partitions, which is cut into cells of a fixed number of rows; a chunk is
what one conversation has in one cell.  All chunks run backwards at the same time:
the last chunk of a conversation from the true end costs, others from speculative
ones.  Fix-up passes run a chunk again from the vector that its successor really
starts with, only until its vectors differ from the earlier ones by a constant.  The
stitched vectors then drive the trace: the least letter that is still on a cheapest
path.  It is traced from every state, and maps from entry to exit states are composed
over the chunks by doubling, so no task holds more than a chunk of a conversation.
Only the digest of a repaired conversation, sequential by definition, streams
through one task per conversation, in memory that does not grow with it.
"""

from __future__ import annotations

import functools
import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.llm.common import Scratch

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a cell: a task holds the letters and vectors of one chunk, at most so many rows.
CHUNK_ROWS = 4096
#: States: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Cost to go behind the last row: what has to be inserted to end after an assistant row, or with nothing.
END = bytes((0, 10, 5, 0))
#: Costs of the edits, and of a truncated row that stays: fixed values.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LEGAL = ("su", "ua", "au")
#: State after an inserted or reroled row, which takes the one role that fits.
_NEXT = (USER, USER, ASSISTANT, USER)
#: States after a kept row, by its role initial; absent: it does not fit.
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_SEQ_BITS = 33  # as in monotonically_increasing_id: partition above, row below


# ------------------------------------------------- vectors (in the workers)


def remembered(compute):
    """``compute`` with its results kept: few arguments occur.  A plain function, because library caches travel by name only."""
    known: dict[tuple, tuple] = {}

    def look_up(*key):
        if key not in known:
            known[key] = compute(*key)
        return known[key]

    return look_up


def edits(initial: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits that use up a row, in the order of their letters."""
    found = [("D", DELETE, state)]
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        if state in _KEPT.get(initial, ()):
            found.append(("K", extra, _KEPT[initial][state]))
        found.append(("R", REROLE + extra, _NEXT[state]))
    return found


@remembered
def before(initial: str, fault: str, behind: bytes) -> tuple[bytes, int]:
    """The vector before a row, less its least entry, and that entry.  Few vectors exist, so each is computed once."""
    here = [min(cost + behind[to] for _, cost, to in edits(initial, fault, s)) for s in range(4)]
    for _ in range(2):  # two inserted rows at most: a third one would come back to a state
        here = [min(here[s], INSERT + here[_NEXT[s]]) for s in range(4)]
    least = min(here)
    return bytes(v - least for v in here), least


def backward(initials: str, faults: str, end: bytes, old: tuple[bytes, bytes] | None = None) -> tuple[bytes, bytes]:
    """Vectors before each row and behind the last, four bytes each, and the constant taken off at each row.

    With ``old`` from an earlier end vector, only until a vector is an old one: all before it differ by a constant only.
    """
    n = len(initials)
    vectors, taken = (bytearray(old[0]), bytearray(old[1])) if old else (bytearray(4 * n + 4), bytearray(n))
    vectors[4 * n :] = now = end
    for i in range(n - 1, -1, -1):
        now, taken[i] = before(initials[i], faults[i], now)
        if old and vectors[4 * i : 4 * i + 4] == now:
            break
        vectors[4 * i : 4 * i + 4] = now
    return bytes(vectors), bytes(taken)


@remembered
def _letters(initial: str, fault: str, state: int, behind: bytes) -> tuple[str, int]:
    here, least = before(initial, fault, behind)
    left = [v + least for v in here]
    letters = ""
    while True:
        if DELETE + behind[state] == left[state]:
            return letters + "D", state
        if INSERT + left[_NEXT[state]] == left[state]:
            letters, state = letters + "I", _NEXT[state]
            continue
        for letter, cost, to in edits(initial, fault, state):
            if cost + behind[to] == left[state]:
                return letters + letter, to


def trace(initials: str, faults: str, vectors: bytes, state: int, last: bool) -> tuple[str, int]:
    """Least letters of a cheapest path from ``state`` and the state that it ends in."""
    out = []
    for i in range(len(initials)):
        letters, state = _letters(initials[i], faults[i], state, vectors[4 * i + 4 : 4 * i + 8])
        out.append(letters)
    while last and state in (SYSTEM, USER):
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


# ------------------------------------------------------------ rows and chunks


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the checksum of ``conv_id:turn`` asks for.

    Nulls in the checksum's text, in roles and in texts are one space; a null
    ``turn`` stays null in its column.  ``as_was`` and ``copy`` order rows of one turn.
    """

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault")).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.struct("role", "text").alias("as_was"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, seq``: rows of a conversation follow each other in ``seq``, by turn, nulls first.

    Rows of one turn are ordered by role and text before the damage.  Rows that
    are equal in all of it may stand in any order, so a number of their own deals
    them to several ranges.  The numbers depend on the ranges: write the result
    before using them twice.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "as_was", "copy", "own"]
    dealt = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, seq, initial, fault`` of each row: its first of b (blank), d (duplicate), t (truncated), else a point."""
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    first = F.substring("role", 1, 1)
    marks = rows.select(
        "conv_id", "turn", "seq",
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        F.when(ends == "", "b").when(ends.isin(".", "!", "?"), ".").otherwise("t").alias("own_fault"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("content"),
    )
    # Copies are counted down before the shuffle; the first ones are then looked up by their unique number.
    firsts = marks.groupBy("conv_id", "content").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    return marks.join(firsts, "seq", "left").select(
        "conv_id", "turn", "seq", "initial",
        F.when((F.col("own_fault") != "b") & F.col("is_first").isNull(), "d").otherwise(F.col("own_fault")).alias("fault"),
    )


def in_chunks(marks: DataFrame, chunk_rows: int) -> DataFrame:
    """``conv_id, cell, seq, initials, faults``: the chunks; those of a conversation lie in consecutive cells."""
    part, row = F.shiftright("seq", _SEQ_BITS), F.col("seq") % (1 << _SEQ_BITS)
    placed = marks.withColumn("part", part).withColumn("own_cell", F.floor(row / chunk_rows))
    # One row per range partition, so this window is small by construction.
    sizes = placed.groupBy("part").agg((F.max("own_cell") + 1).alias("cells"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("cells").over(earlier), F.lit(0)).alias("start"))
    letters = F.sort_array(F.collect_list(F.struct("seq", "initial", "fault")))
    grouped = placed.groupBy("conv_id", "part", "own_cell").agg(letters.alias("rows"))
    return grouped.join(starts, "part").select(
        "conv_id",
        (F.col("start") + F.col("own_cell")).alias("cell"),
        F.col("rows")[0]["seq"].alias("seq"),
        F.array_join("rows.initial", "").alias("initials"),
        F.array_join("rows.fault", "").alias("faults"),
    )


def _beside(chunks: DataFrame, other: DataFrame, step: int, how: str = "left") -> DataFrame:
    """``chunks`` with the columns of ``other`` (``conv_id``, ``cell`` and more) ``step`` cells on, in the same conversation."""
    there = other.withColumnRenamed("conv_id", "__conv").withColumn("__cell", F.col("cell") - step).drop("cell")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("cell") == F.col("__cell"))
    return chunks.join(there, same, how).drop("__conv", "__cell")


# ------------------------------------------------------------------- passes


def _per_chunk(df: DataFrame, run, added: str) -> DataFrame:
    """``df`` with columns computed from each row's values as a dict; columns of those names are replaced."""
    names = [f.split()[0] for f in added.split(", ")]
    kept = [c for c in df.columns if c not in names]
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.split()[1]] for f in added.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), added])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [run(r) for r in part.to_pylist()]
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, t) for v, t in zip(zip(*rows), types))], [*kept, *names])

    return df.mapInArrow(mapped, schema)


def _first_pass(r: dict) -> tuple:
    vectors, taken = backward(r["initials"], r["faults"], END)
    illegal = sum(a + b not in LEGAL for a, b in zip(r["initials"], r["initials"][1:]))
    return vectors, taken, vectors[:4], END, illegal


def _fix_up(r: dict) -> tuple:
    vectors, taken = backward(r["initials"], r["faults"], r["follows"], (r["vectors"], r["taken"]))
    return vectors, taken, vectors[:4], r["follows"]


def _trace_all(r: dict) -> tuple:
    entries = (NOTHING,) if r["is_first"] else range(4)
    found = [trace(r["initials"], r["faults"], r["vectors"], s, r["is_last"]) for s in entries]
    return [a for a, _ in found], "".join(str(s) for _, s in found) * (4 if r["is_first"] else 1), sum(r["taken"])


def solved(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Chunks with right vectors: speculative first, then fix-up passes while a vector is not the one that follows."""
    now = scratch.write(_per_chunk(chunks, _first_pass, "vectors binary, taken binary, start binary, end binary, illegal long"), "state")
    while True:
        follows = _beside(now, now.filter("not is_first").select("conv_id", "cell", F.col("start").alias("follows")), 1, "inner")
        wrong = scratch.write(follows.filter("follows != end"), "wrong")
        if wrong.isEmpty():
            return now
        mended = _per_chunk(wrong, _fix_up, "vectors binary, taken binary, start binary, end binary").select(*now.columns)
        same = now.join(wrong.select("seq"), "seq", "left_anti").select(*now.columns)
        now = scratch.write(same.unionByName(mended), "state")


def _after(first: Column, then: Column) -> Column:
    """One map of states after another; a map is four digits."""
    return F.concat(*(F.substring(then, F.substring(first, s + 1, 1).cast("int") + 1, F.lit(1)) for s in range(4)))


def traced(state: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, seq, audit, cost``: the letters of each chunk; costs add up over a conversation."""
    found = scratch.write(_per_chunk(state, _trace_all, "audits array<string>, exits string, offsets long"), "traces")
    alone = F.col("is_first") & F.col("is_last")
    # Exit states from the start of the conversation on: after round r, a map covers 2^r chunks.
    maps = scratch.write(found.filter(~alone).select("conv_id", "cell", "is_first", F.col("exits").alias("map")), "maps")
    span = 1
    while not maps.filter("not is_first").isEmpty():
        earlier = maps.select("conv_id", "cell", F.col("map").alias("first"), F.col("is_first").alias("done"))
        joined = _beside(maps, earlier, -span)
        maps = scratch.write(
            joined.select(
                "conv_id", "cell",
                (F.col("is_first") | F.coalesce("done", F.lit(False))).alias("is_first"),
                F.when(F.col("is_first"), F.col("map")).otherwise(_after(F.col("first"), F.col("map"))).alias("map"),
            ),
            "maps",
        )
        span *= 2
    entry = maps.select("conv_id", "cell", F.substring("map", 1, 1).cast("int").alias("entry"))
    entered = _beside(found, entry, -1)
    start = F.conv(F.hex(F.substring("start", NOTHING + 1, 1)), 16, 10).cast("long")
    return entered.select(
        "conv_id", "seq", "illegal", "faults",
        F.col("audits")[F.when(F.col("is_first"), 0).otherwise(F.col("entry"))].alias("audit"),
        (F.col("offsets") + F.when(F.col("is_first"), start).otherwise(0)).alias("cost"),
    )


def _digests(kind: pa.DataType):
    """Rows and, before those of each chunk, its letters -> one row per conversation; streams, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, digest, audit, state, letters, lines = nothing, None, [], NOTHING, iter(()), 0
        done: list[tuple] = []

        def add(line: str) -> None:
            nonlocal lines
            digest.update(("\n" if lines else "").encode() + line.encode("utf-8", "surrogatepass"))
            lines += 1

        def edit(row: tuple[str, str] | None) -> None:
            """Inserted rows, then the edit of ``row``; without one, those after the last row."""
            nonlocal state
            for letter in letters:
                if letter == "D":
                    return
                if letter == "K":
                    state = _KEPT[row[0][:1]][state]
                    return add(f"{row[0]}:{row[1]}")
                state = _NEXT[state]
                role = "user" if state == USER else "assistant"
                add(f"{role}:{row[1] if letter == 'R' else ''}")
                if letter == "R":
                    return

        def close() -> None:
            if conv is not nothing:
                edit(None)
                done.append((conv, "".join(audit), digest.hexdigest()))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [(), (), ()]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, (kind, pa.string(), pa.string()))], ["conv_id", "audit", "repaired_sha256"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    if conv is nothing or r["conv_id"] != conv:
                        close()
                        conv, digest, audit, state, letters, lines = r["conv_id"], hashlib.sha256(), [], NOTHING, iter(()), 0
                    if r["audit"] is None:
                        edit((r["role"], r["text"]))
                    else:
                        audit.append(r["audit"])
                        letters = iter(r["audit"])
            yield out()
        close()
        yield out()

    return run


def repaired(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256``: the rows meet the letters of their chunk by order, without a join."""
    kind = rows.schema["conv_id"].dataType
    no = F.lit(None).cast("string")
    heads = chunks.select("conv_id", "seq", F.lit(0).alias("is_row"), no.alias("role"), no.alias("text"), "audit")
    lines = rows.select("conv_id", "seq", F.lit(1).alias("is_row"), "role", "text", no.alias("audit"))
    sorted_ = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "is_row")
    return sorted_.mapInArrow(_digests(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, audit string, repaired_sha256 string")


def repair(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``conv_id, turn, role, text``.

    A row per ``conv_id`` of ``ids`` with ``gaps, blank, duplicate, truncated,
    illegal, cost`` (long), ``audit`` and ``repaired_sha256``.  Rows are taken by
    turn, nulls first; rows without a ``conv_id`` are one conversation; rows of one
    turn have the order of :func:`in_order`; equal rows are duplicates.  A role other
    than system, user and assistant (by its first letter) cannot be kept.  Texts
    are hashed whole, whatever their length.  Other columns are not read.  An empty
    table gives no rows.
    """
    return repair_rows(in_order(undamaged(turns)), turns.select("conv_id"), chunk_rows)


def undamaged(turns: DataFrame) -> DataFrame:
    """Rows as they are, in the columns of :func:`damage`; null roles and texts are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.struct(role, text).alias("as_was"), F.lit(0).alias("copy"))


def repair_rows(ordered: DataFrame, ids: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As :func:`repair`, of rows from :func:`in_order`; conversations of ``ids`` without rows have zeros and empty results."""
    scratch = Scratch(ordered.sparkSession, "repair")
    rows = scratch.write(ordered, "rows")
    marks = with_faults(rows)
    chunks = scratch.write(in_chunks(marks, chunk_rows), "chunks")
    after = _beside(chunks, chunks.select("conv_id", "cell", F.substring("initials", 1, 1).alias("next")), 1)
    both = _beside(after, chunks.select("conv_id", "cell", F.lit(True).alias("has_earlier")), -1)
    edge = F.concat(F.substring("initials", -1, 1), "next")
    known = both.select(
        *chunks.columns,
        F.col("next").isNull().alias("is_last"),
        F.col("has_earlier").isNull().alias("is_first"),
        F.when(F.col("next").isNotNull() & ~edge.isin(*LEGAL), 1).otherwise(0).cast("long").alias("edge"),
    )
    edges = known.filter("edge > 0").select("conv_id", F.col("edge").alias("illegal"))
    letters = scratch.write(traced(solved(known.drop("edge"), scratch), scratch), "letters")

    def count(letter: str) -> Column:
        return (F.length("faults") - F.length(F.translate("faults", letter, ""))).cast("long")

    # Everything per conversation meets in one grouping, where null is a group too.
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("__one")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps")
    )
    counts = letters.select(
        "conv_id", "cost", "illegal", count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated")
    )
    parts = [ids.select("conv_id").distinct(), turns, counts, edges, repaired(rows, letters)]
    everything = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return everything.groupBy("conv_id").agg(
        *sums,
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
