"""Near-duplicates by Order MinHash, checked by banded alignment.

A text is the sequence of its k-mers: runs of five words, in lower case and
without punctuation.  A band samples the few k-mers with the smallest hashes,
each labelled with its occurrence, and keeps them in text order; texts that agree on
a band are candidates.  Candidates are aligned within a band around the diagonal,
and are near when the k-mers matched in order are at least 0.8 of all k-mers of
the two.  Near texts are linked, and linked texts form one class.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.common import Scratch

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 5
SIMILARITY = 0.8
BANDS = 16
SAMPLED = 3
#: A bucket with at most so many texts left is finished in one round; a larger one takes some leaders, four times as many each round.
SMALL_BUCKET = 64
LEADERS = 64
#: Bits of a text in which the parity of its k-mers is kept, as columns of 64.
PARITY_BITS = 512
_PARITY = [f"parity{i}" for i in range(PARITY_BITS // 64)]
#: A text takes so many of its rarer k-mers into the bucket of a k-mer, so that a pair that met there already is not made again.
EARLIER = 16


class _Kept(dict):
    """What a worker computes once; it travels empty."""

    def __reduce__(self):
        return dict, ()


_KEPT = _Kept()
_BASE = 0x9E3779B97F4A7C13
_ODD = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for texts of up to 2**bits bytes; those of the longest text so far are kept."""
    if _KEPT.get("bits", -1) < bits:
        up, down = (np.full(1 << bits, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 2**64)))
        up[0] = down[0] = 1
        _KEPT.update(bits=bits, powers=(np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)))
    return _KEPT["powers"]


#: Which bytes of UTF-8 belong to words: ASCII letters and digits, and all others beyond ASCII.
_WORD_BYTES = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_BLANKED = bytes(b if inside else 32 for b, inside in enumerate(_WORD_BYTES))


def packed(text: str) -> bytes:
    """The words of a text, compressed: all that its k-mers need, in about a third of its bytes."""
    return zlib.compress(b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split()), 6)


def unpacked(words: bytes) -> str:
    return zlib.decompress(words).decode("utf-8", "replace")


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = _WORD_BYTES[raw]
    turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = turns[::2], turns[1::2]
    up, down = _powers(max(16, len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def kmers(text: str) -> np.ndarray:
    """64-bit k-mers in text order; a text of fewer than five words is one k-mer, one without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < K:
        return _mix(np.atleast_1d(np.sum(words * _ODD[: len(words)], dtype=np.uint64) + np.uint64(len(words))))
    n = len(words) - K + 1
    return _mix(sum((words[k : k + n] * _ODD[k] for k in range(1, K)), words[:n] * _ODD[0]))


def labelled(seq: np.ndarray) -> np.ndarray:
    """K-mers with the number of their occurrence mixed in."""
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if not same.any():
        return seq
    at = np.arange(len(s))
    occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
    out = np.empty_like(seq)
    out[order] = _mix(s + occurrence.astype(np.uint64) * _ODD[2]) * (occurrence > 0) + s * (occurrence == 0)
    return out


def sketch(seq: np.ndarray, bands: int = BANDS, sampled: int = SAMPLED) -> np.ndarray:
    """One 64-bit value per band: the sampled k-mers in text order."""
    if not len(seq):
        return np.empty(0, np.int64)
    own, seeds = labelled(seq), _mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[3])
    out = seeds.copy()
    for k in range(0, bands, step := max(1, min(bands, 2_000_000 // len(own)))):
        hashes = _mix(own[None, :] ^ seeds[k : k + step, None])
        if len(own) > sampled:
            picked = np.sort(np.argpartition(hashes, sampled - 1, axis=1)[:, :sampled], axis=1)
        else:
            picked = np.broadcast_to(np.arange(len(own)), (len(hashes), len(own)))
        for column in picked.T:
            out[k : k + step] = _mix(out[k : k + step] * _ODD[4] + own[column])
    return out.view(np.int64)


def text_key(seq: np.ndarray, text: str) -> bytes:
    """16 bytes, equal for texts of equal k-mers; a text without words counts as it stands."""
    return hashlib.blake2b(seq.tobytes() if len(seq) else b"text" + text.encode("utf-8", "replace"), digest_size=16).digest()


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence among matches within ``band`` of the diagonal, one machine word per 64 places of ``b``."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    window, every = (1 << (2 * band + 1)) - 1, (1 << len(b)) - 1
    free = every
    for i, x in enumerate(a):
        if x in places:
            hit = free & places[x] & (window << (i - band) if i >= band else window >> (band - i))
            if hit:
                free = ((free + hit) | (free - hit)) & every
    return head + tail + len(b) - free.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """K-mers matched in order over all k-mers of the two; 0.0 if that is certainly below ``least``."""
    total = len(a) + len(b)
    if not total or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    # At this many unmatched k-mers the similarity is just ``least``; an alignment with fewer stays in the band.
    band = int(total * (1 - least) / (1 + least)) + 1
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    if shared < least * (total - shared):
        return 0.0
    matched = banded_lcs(a.tolist(), b.tolist(), band)
    return matched / (total - matched)


_ADDED = {"n_kmers": ("int", pa.int32(), lambda seq, text: len(seq)), "bands": ("array<bigint>", pa.list_(pa.int64()), lambda seq, text: sketch(seq)), "packed": ("binary", pa.binary(), lambda seq, text: packed(text))}


def keyed(docs: DataFrame, keep: list[str], *added: str) -> DataFrame:
    """``keep`` columns of ``docs`` with ``text_key`` and what else is asked for: ``bands``, ``packed``."""
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema += ["text_key binary", *(f"{c} {_ADDED[c][0]}" for c in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            keys, more = [], [[] for _ in added]
            for text in texts:
                seq = kmers(text)
                keys.append(text_key(seq, text))
                for values, c in zip(more, added):
                    values.append(_ADDED[c][2](seq, text))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns += [pa.array(keys, pa.binary()), *(pa.array(values, _ADDED[c][1]) for values, c in zip(more, added))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text_key", *added])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(schema))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "a_packed", "b_packed"))
        found = []
        for x, y, s, t in zip(a, b, left, right):
            if similarity(kmers(unpacked(s)), kmers(unpacked(t))) >= SIMILARITY:
                found.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _alike(n: str, m: str) -> Column:
    """Texts whose numbers of k-mers are further apart than this cannot be near: no need to look at them."""
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are near; ``texts`` has one row per ``text_key``."""
    left, right = (texts.select(F.col("text_key").alias(c), F.col("packed").alias(f"{c}_packed")) for c in ("a", "b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_near, "a binary, b binary")


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """``(node, component)`` of every linked node: the smallest node that it reaches.

    A round takes the smallest label among a node's neighbours and then the label of
    that label, so long chains shrink by half; rounds end when no label changes.
    """
    # Each node is its own neighbour too, so that one grouping sees its label and those around it.
    ends = F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x in "ab" for y in "ab"))).alias("end")
    both = scratch.write(links.select(ends).select("end.*").distinct(), "both_ways")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), name)
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b")
        nearer = around.groupBy(F.col("a").alias("node")).agg(F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("old"), F.min("component").alias("component"))
        onward = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = nearer.join(onward, "component").select("node", "old", F.least("component", "next").alias("component"))
        moved = scratch.write(moved, name)
        labels = moved.select("node", "component")
        if not moved.filter("component != old").limit(1).count():
            scratch.drop("both_ways")
            return labels


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` after more links: each pair of components counts once, however many links join it."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    joined = ends.filter("of_a != of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
    moves = components(joined, scratch, "moves")
    onward = moves.select(F.col("node").alias("component"), F.col("component").alias("next"))
    known = labels.join(onward, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    return scratch.write(known.unionByName(moves.join(labels, "node", "left_anti")), "classes")


def _labelled_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.withColumnRenamed("node", "text_key")
    return members.join(own, "text_key", "left").withColumn("component", F.coalesce("component", "text_key"))


def parity(own: np.ndarray) -> np.ndarray:
    """Labelled k-mers as bits: each turns one of them, so two texts differ in at most as many bits as in k-mers."""
    turns = np.bincount((_mix(own) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits(turns & 1).view(np.int64)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("text_key", "packed"))
        bits = np.array([parity(labelled(kmers(unpacked(words)))) for words in texts.to_pylist()], np.int64).reshape(-1, len(_PARITY))
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(column) for column in bits.T.copy())], ["text_key", *_PARITY])


def _kmer_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, words in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text_key", "packed"))):
            own = pa.array(labelled(kmers(unpacked(words))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)], ["text_key", "kmers"])


def rare_kmers(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(bucket, text_key, n_kmers, onward, earlier)``: the shared k-mers by which a text can be found by one that is near to it.

    All texts order their labelled k-mers alike, by the number of texts that hold
    them, rarest first.  ``onward`` counts the k-mers of a text from this one on.
    Two texts share at most the smaller ``onward`` of their first common k-mer, so it
    must be enough for the similarity: a text that has more k-mers of its own than
    a near one may lack has no row at all, however long the passages are that it
    shares with others.  ``earlier`` has the buckets of the text just before this one,
    ``EARLIER`` at most.
    """
    sets = scratch.write(texts.select("text_key", "packed").mapInArrow(_kmer_sets, "text_key binary, kmers array<bigint>"), "sets")
    each = sets.select("text_key", F.size("kmers").alias("n_kmers"), F.explode("kmers").alias("bucket"))
    held = each.groupBy("bucket").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = Window.partitionBy("text_key")
    ranked = each.join(held, "bucket").withColumn("onward", F.row_number().over(own.orderBy(F.desc("holders"), F.desc("bucket"))))
    kept = ranked.filter(F.col("onward") >= SIMILARITY * F.col("n_kmers") - 1e-6)
    earlier = F.collect_list("bucket").over(own.orderBy("onward").rowsBetween(1, EARLIER))
    return kept.select("bucket", "text_key", "n_kmers", "onward", earlier.alias("earlier"))


def _enough(onward: Column, other: Column, n: Column, m: Column) -> Column:
    """Whether so many k-mers in common can be ``SIMILARITY`` of those of two texts with ``n`` and ``m``."""
    return F.least(onward, other) * (1 + SIMILARITY) >= SIMILARITY * (n + m) - 1e-6


def _differ_little() -> Column:
    """Whether the parities leave it open that two texts are near: their k-mers without a match are then at most one in nine of all."""
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead_{c}"))) for c in _PARITY[1:]), F.bit_count(F.col(_PARITY[0]).bitwiseXOR(F.col(f"lead_{_PARITY[0]}"))))
    return bits * (1 + SIMILARITY) <= (1 - SIMILARITY) * (F.col("n_kmers") + F.col("lead_n_kmers")) + 1e-6


def _first_here() -> Column:
    """Whether two texts of a bucket have no common bucket before it, as far as their rows tell; in their very first one that holds."""
    return ~F.arrays_overlap("earlier", "lead_earlier")


def text_classes(sketches: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for the texts of ``sketches`` that are near to another text.

    Equal texts are one text here.  Every bucket first compares its texts with one
    leader, so a bucket of any size costs one comparison per text.  A bucket whose
    texts are then all in one component is done.  The texts of the others are put
    into new buckets, one for each of their rare k-mers (``rare_kmers``), in which two
    texts that are near must meet.  There, texts of different
    components are compared: all of them where at most ``SMALL_BUCKET`` are left,
    else some leaders with all others, four times as many each round; a leader is then
    done and leaves its bucket.  Only pairs whose parities differ little are aligned, so
    a large group of texts that share much and are not near makes few pairs, and a
    pair is made in the first bucket that both have, not in each of those that follow.  Rounds go on until no bucket holds two components with a pair that was
    not compared, so no pair that shares a band and is near is lost.
    """
    distinct = sketches.groupBy("text_key").agg(F.first("bands").alias("bands"), F.first("n_kmers").alias("n_kmers"))
    in_buckets = distinct.select("text_key", "n_kmers", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.min(F.struct("text_key", "n_kmers")).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    shared = shared.select("bucket", "n", F.col("lead.text_key").alias("leader"), F.col("lead.n_kmers").alias("leader_kmers"))
    members = scratch.write(in_buckets.join(shared, "bucket"), "members")
    wanted = members.select("text_key").distinct()
    # Copies go before the shuffle; then texts lie by key, as the join with the wanted ones needs them.
    texts = keyed(docs, [], "packed").dropDuplicates(["text_key"]).join(wanted, "text_key", "left_semi")
    texts = scratch.write(texts, "texts")

    others = members.filter(F.col("text_key") != F.col("leader"))
    pairs = others.filter(_alike("n_kmers", "leader_kmers")).select(F.col("leader").alias("a"), F.col("text_key").alias("b")).distinct()
    tested = scratch.write(pairs, "tested0")
    labels, number = components(scratch.write(linked(tested, texts), "links0"), scratch), 0

    # Two texts in a bucket have met by now; a leader has met all others.
    rest = _labelled_members(others.filter("n > 2").select("bucket", "text_key"), labels)
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least != most")
    open_texts = scratch.write(rest.join(mixed, "bucket", "left_semi").select("text_key").distinct(), "open")
    scratch.drop("members")
    unsettled = texts.join(open_texts, "text_key", "left_semi")
    bits = scratch.write(unsettled.select("text_key", "packed").mapInArrow(_parities, ", ".join(["text_key binary", *(f"{c} bigint" for c in _PARITY)])), "bits")
    rest = scratch.write(rare_kmers(unsettled, scratch), "rest")
    scratch.drop("sets", "open")
    while True:
        number += 1
        # The rows of one component in a bucket are counted before they meet.
        named = _labelled_members(rest, labels)
        parts = named.groupBy("bucket", "component").agg(
            F.count("*").alias("of_component"), F.max(_enough(F.col("onward"), F.col("onward"), F.col("n_kmers"), F.col("n_kmers"))).alias("as_shorter")
        )
        # Of two texts the shorter one needs the longer rest of common k-mers.
        left = parts.groupBy("bucket").agg(F.sum("of_component").alias("left"), F.count("*").alias("parts"), F.max("as_shorter").alias("as_shorter"))
        left = left.filter("parts > 1 and as_shorter").select("bucket", "left")
        now = scratch.write(named.join(parts.drop("as_shorter"), ["bucket", "component"]).join(left, "bucket").join(bits, "text_key"), "now")
        if not now.limit(1).count():
            scratch.drop("now", "rest", "texts", "bits", *(f"{name}{k}" for name in ("tested", "links") for k in range(number)))
            return labels
        # Leaders come from the smallest components of their bucket, because a component with nothing left beside it is done.
        # The first of each task are chosen before the shuffle, so no task ranks a whole bucket.
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("of_component", "component", "text_key"))
        first = now.filter(F.col("left") > SMALL_BUCKET).withColumn("rank", rank).filter(F.col("rank") <= LEADERS << min(2 * (number - 1), 20)).drop("rank")
        leads = scratch.write(now.filter(F.col("left") <= SMALL_BUCKET).unionByName(first), "leads").select(
            "bucket", *(F.col(c).alias(f"lead_{c}") for c in ("text_key", "component", "n_kmers", "onward", "earlier", *_PARITY))
        )
        apart = F.col("component") != F.col("lead_component")
        enough = _enough(F.col("onward"), F.col("lead_onward"), F.col("n_kmers"), F.col("lead_n_kmers"))
        met = now.join(leads, "bucket").filter(apart & enough & _alike("n_kmers", "lead_n_kmers") & _differ_little() & _first_here())
        pairs = met.select(F.least("lead_text_key", "text_key").alias("a"), F.greatest("lead_text_key", "text_key").alias("b")).distinct()
        fresh = scratch.write(pairs.join(tested, ["a", "b"], "left_anti"), f"tested{number}")
        found = scratch.write(linked(fresh, texts), f"links{number}")
        tested = tested.unionByName(fresh)
        done = leads.select("bucket", F.col("lead_text_key").alias("text_key"))
        rest = scratch.write(now.select("bucket", "text_key", "n_kmers", "onward", "earlier").join(done, ["bucket", "text_key"], "left_anti"), "rest")
        scratch.drop("leads")
        if found.limit(1).count():
            labels = merged(labels, found, scratch)


def near_classes(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its class: ``doc_id``, ``text_key``, ``class_key``, ``class_id``, ``class_rows``.

    ``docs`` needs ``doc_id`` and ``text``.  ``class_id`` is the smallest ``doc_id`` of the
    class (null if all are null) and ``class_rows`` its number of rows, copies
    included.  Texts that differ only in case, punctuation or white space are
    copies.  Texts without words (null is empty) are copies only of equal ones, and
    texts of fewer than five words of those with the same words.  Ids may be null
    or repeat.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sketches = scratch.write(keyed(docs, ["doc_id"], "bands", "n_kmers"), "sketches")
    labels = text_classes(sketches, docs, scratch)
    rows = sketches.drop("bands", "n_kmers").join(labels.withColumnRenamed("node", "text_key"), "text_key", "left")
    rows = rows.withColumn("class_key", F.coalesce("component", "text_key")).drop("component")
    classes = rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return rows.join(classes, "class_key").select("doc_id", "text_key", "class_key", "class_id", "class_rows")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the one with its smallest ``doc_id``; all columns as they were.

    Which rows stay is settled on ids and keys, so whole rows are shuffled once.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    first = near_classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = scratch.write(first.groupBy("class_key").agg(F.min("text_key").alias("_key"), F.min("doc_id").alias("_id")).drop("class_key"), "chosen")
    rows = keyed(docs, docs.columns).withColumnRenamed("text_key", "_key")
    return rows.join(chosen, "_key").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["_key"]).select(*docs.columns)
