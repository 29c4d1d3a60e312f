"""Repair against a plain shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from threadloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        now = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        for copy in range(0 if fault == 0 else 2 if fault == 3 else 1):
            yield c, ((t is not None, t or 0), role, text, copy), t, "user" if fault == 4 else role, now


def shortest(rows, faults):
    """Costs first, then letters; every state once per place."""
    heap, seen = [(0, "", 0, "", ())], set()
    fits = {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(out)
        for role in ("user", "assistant"):
            if state in fits[role[0]]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, f"{role}:")))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
        if faults[i] not in "bd":
            own, text = rows[i]
            extra = 5 * (faults[i] == "t")
            for letter, role in (("K", own), ("R", "user"), ("R", "assistant")):
                if state in fits.get(role[:1], ()):
                    heapq.heappush(heap, (cost + extra + (letter == "R"), audit + letter, i + 1, role[:1], (*out, f"{role}:{text}")))


def expected(rows):
    by_conv = defaultdict(list)
    for c, key, t, role, text in damaged(rows):
        by_conv[c].append((key, t, role, text))
    for c in {r[0] for r in rows}:
        found = sorted(by_conv[c], key=lambda r: r[0])
        faults, seen = "", set()
        for _, _, role, text in found:
            shown = re.sub("[\x20\x09-\x0d]", "", text)
            faults += "b" if not shown else "d" if (role, text) in seen else "." if shown[-1] in ".!?" else "t"
            seen.add((role, text))
        turns = {t for _, t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [role[:1] for _, _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = shortest([r[2:] for r in found], faults)
        yield c, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(seed, sizes):
    r = random.Random(seed)
    texts = ["a.", "b", "c! ", " ", "", None, "hello?", " ", "x y\nz."]
    for c, n in sizes:
        for t in range(n):
            text = r.choice(texts) if r.random() < 0.2 else f"t{t}{r.choice(['.', '', ' ?'])}"
            yield c, r.choice([t, t, t, None, t // 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text


def run(spark, rows, chunk_rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, repair.repair_rows(repair.in_order(repair.damage(df)), df, chunk_rows).collect()), key=repr)


@pytest.mark.parametrize("chunk_rows", [2, 7, repair.CHUNK_ROWS])
def test_like_a_plain_search(spark, chunk_rows):
    rows = list(made(3, [(None, 9), (7, 150), *((c, c % 6 + 1) for c in range(20, 50))]))
    assert run(spark, rows, chunk_rows) == sorted(expected(rows), key=repr)


def test_one_conversation_has_most_rows(spark):
    rows = list(made(5, [(1, 1500), *((c, 3) for c in range(2, 40))]))
    assert run(spark, rows, 64) == sorted(expected(rows), key=repr)


def test_repeated_rows_are_dealt_to_several_chunks(spark):
    rows = [(1, 5, "user", "same words.")] * 400 + [(1, 6, "assistant", "end.")]
    assert run(spark, rows, 32) == sorted(expected(rows), key=repr)


def test_fix_up_stops_where_vectors_agree():
    r = random.Random(1)
    initials, faults = "".join(r.choices("suao", k=400)), "".join(r.choices("...tbd", k=400))
    for end in (repair.END, bytes((0, 0, 0, 0)), bytes((3, 0, 9, 4))):
        right = repair.backward(initials, faults, end)
        mended = repair.backward(initials, faults, end, repair.backward(initials, faults, bytes((9, 1, 0, 7))))
        assert mended == right


def test_whole_repair_without_damage(spark):
    rows = [(1, 0, "user", "Q?"), (1, 1, "assistant", "A."), (2, 0, "assistant", "A."), (3, 0, "tool", "t.")]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, "KK"), 2: (2, "D"), 3: (2, "D")}


def test_odd_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair(df).collect() == []
    long = "word " * 200_000 + "."
    clash = spark.createDataFrame([(1, 0, "user", long, 1, "x"), (1, 1, "assistant", None, 1, "x")], SCHEMA + ", seq int, cell string")
    (row,) = repair.repair(clash).collect()
    # The blank answer goes; the question is dropped too, as an empty answer costs more.
    assert (row["blank"], row["cost"], row["audit"]) == (1, 4, "DD")
    ids = spark.createDataFrame([(None,), (5,)], "conv_id long")
    got = repair.repair_rows(repair.in_order(repair.damage(df)), ids).collect()
    assert {(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got} == {
        (i, 0, "", hashlib.sha256(b"").hexdigest()) for i in (None, 5)
    }
