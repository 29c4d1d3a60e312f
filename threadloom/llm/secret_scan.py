"""Secret scans: candidate strings in texts, and a random forest that removes false ones.

Patterns find everything that might be a credential.  A forest then judges each
candidate by its length, its character transitions, how much of it dictionary
words cover, the path of its document and the words around it.  It is trained on
labelled findings: known values, secret or harmless, set into lines of the corpus,
so every label is right by construction.  A text is read once, in Python workers
over Arrow batches, without a shuffle; the trained forest travels as a few arrays.
"""

from __future__ import annotations

import base64
import math
import random
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.llm.common import shared_folder
from threadloom.llm.quality import COMMON_WORDS

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bounds of training: labelled findings, corpus lines that they are set into, and characters of a line.
TRAINING_FINDINGS = 6_000
TRAINING_LINES = 300
LINE_CHARS = 300
TREES, DEPTH, SEED = 40, 10, 11
THRESHOLD = 0.5
NEAR_CHARS = 60
MASK = "[SECRET]"

# Word lists and patterns: fixed values.
CREDENTIAL = "key apikey token secret password passwd pwd pass credential credentials auth bearer authorization access private signature".split()
HARMLESS = (
    "sha sha1 sha256 md5 commit hash id uuid guid version card phone order isbn checksum digest ref revision build invoice number "
    "path file url image page date time session etag public fingerprint".split()
)
PLACEHOLDER = "example sample dummy test your changeme placeholder xxxx redacted here insert todo fake demo default none null".split()
DICTIONARY = sorted(
    {w for ws in COMMON_WORDS.values() for w in ws if len(w) >= 3}
    | {*CREDENTIAL, *HARMLESS, *PLACEHOLDER, *"user admin name data config server client service account project module index value".split()}
)
PREFIXES = re.compile(r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ|ya29\.|SG\.")
RUN = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{16,}={0,2}")
ASSIGNED = re.compile(
    r"(?i:key|token|secret|passw(?:or)?d|pwd|credential|auth|bearer)[A-Za-z0-9_\"'-]{0,20}\s{0,3}(?::=|=>|[:=]|\s)\s{0,3}[\"']?([^\s\"'|<>]{8,})"
)
DIGIT = re.compile(r"[0-9]")
TEST_PATH = re.compile(r"(?i)(^|[^a-z])(tests?|examples?|samples?|mocks?|fixtures?|docs?|demo)([^a-z]|$)")
CONFIG_PATH = re.compile(r"(?i)(^|[^a-z])(env|conf|config|settings|secrets?|credentials?|ya?ml|ini|properties|pem)([^a-z]|$)")


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of all candidates, in order, none inside another: long runs with a digit, and values assigned to a credential's name."""
    found = [m.span(1) for m in ASSIGNED.finditer(text)]
    found += [m.span() for m in RUN.finditer(text) if DIGIT.search(m[0])]
    out: list[tuple[int, int]] = []
    for start, end in sorted(((a, b - len(text[a:b]) + len(text[a:b].rstrip(".,;:!?)]}*#%&$"))) for a, b in found), key=lambda s: (s[0], -s[1])):
        if end - start >= 8 and (not out or start >= out[-1][1]):
            out.append((start, end))
    return out


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def covered(value: str) -> float:
    """Share of the characters that words of the dictionary cover."""
    low, marks = value.lower(), bytearray(len(value))
    for word in DICTIONARY:
        at = low.find(word)
        while at >= 0:
            marks[at : at + len(word)] = b"\1" * len(word)
            at = low.find(word, at + 1)
    return sum(marks) / max(len(value), 1)


def features(value: str, before: str, after: str, path: str) -> list[float]:
    n, counts = len(value), Counter(value)
    kinds = [_kind(c) for c in value]
    moves = Counter(zip(kinds, kinds[1:]))
    steady = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(value, value[1:]))
    letters = max((len(r) for r in re.findall(r"[A-Za-z]+", value)), default=0)
    words_before = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", before).lower())[-3:]
    words_after = re.findall(r"[a-z0-9]+", after.lower())[:2]
    named = [any(w in listed for w in words_before) for listed in (CREDENTIAL, HARMLESS)]
    return [
        math.log2(n), -sum(c / n * math.log2(c / n) for c in counts.values()),
        *(moves[a, b] / max(n - 1, 1) for a in range(4) for b in range(4)),
        len(counts) / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n, letters / n, covered(value), steady / max(n - 1, 1),
        float(named[0]), float(named[1]), float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')), float(any(w in HARMLESS for w in words_after)),
        float(any(w in value.lower() for w in PLACEHOLDER)), float(bool(PREFIXES.match(value))), sum(k == 2 for k in kinds) / n,
        float(bool(TEST_PATH.search(path))), float(bool(CONFIG_PATH.search(path))), float("@" in value or "://" in before[-8:]),
    ]


def around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - NEAR_CHARS) : start], text[end : end + NEAR_CHARS]


def _random_text(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


def known_value(r: random.Random, secret: bool) -> tuple[str, str, str]:
    """``(before, value, after)`` of a made-up finding whose label is known."""
    low, hexa, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    every = low + low.upper() + digits
    quote = r.choice(['"', "'", '"', ""])
    if secret:
        name = r.choice(["token", "api_key", "apiKey", "secret", "password", "auth_token", "access_key", "client_secret", "SECRET_KEY", "credential"])
        value = r.choice([
            lambda: _random_text(r, hexa, r.choice([32, 40, 40, 64])), lambda: _random_text(r, every, r.randint(20, 44)),
            lambda: _random_text(r, every + "+/", r.randint(28, 60)) + "=" * r.randint(0, 2), lambda: "AKIA" + _random_text(r, low.upper() + digits, 16),
            lambda: "ghp_" + _random_text(r, every, 36), lambda: "sk_live_" + _random_text(r, every, 24), lambda: "eyJ" + _random_text(r, every + "_-", 60),
            lambda: _random_text(r, every + "!@%^-_", r.randint(10, 18)) + r.choice(digits),
        ])()
        shout = r.random() < 0.15
        joint = r.choice([" = ", "=", ": ", "=", " = ", " := "])
        before, value = f"{name}{joint}{quote}", value
        return (before.upper(), value.upper(), quote) if shout else (before, value, quote)
    word = lambda: r.choice(DICTIONARY)
    before, value, after = r.choice([
        lambda: ("", _random_text(r, digits, r.choice([16, 16, 18, 20])), ""), lambda: ("", ".".join(str(r.randint(0, 255)) for _ in range(4)) + ".", ""),
        lambda: (r.choice(["commit ", "sha256 ", "hash = ", "checksum: ", "md5=", "etag: "]) + quote, _random_text(r, hexa, r.choice([32, 40, 64])), quote),
        lambda: (r.choice(["id = ", "uuid: ", "id=", "session id "]) + quote, "-".join(_random_text(r, hexa, k) for k in (8, 4, 4, 4, 12)), quote),
        lambda: (r.choice(["token = ", "api_key=", "password: "]) + quote, r.choice(["your-api-key-here-", "xxxxxxxxxxxxxxxx", "example-token-", "changeme-", "<test>", "0000000000000000"]) + str(r.randint(0, 99)), quote),
        lambda: ("", "/".join(word() for _ in range(4)) + f"/{r.randint(1, 99)}.html", ""), lambda: ("", "_".join(word() for _ in range(3)) + f"_{r.randint(1900, 2030)}", ""),
        lambda: ("https://", f"www.{word()}{word()}.example.com/{word()}/{r.randint(1, 999)}", ""), lambda: ("", f"{word()}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", ""),
        lambda: ("version ", f"{r.randint(1, 20)}.{r.randint(0, 99)}.{r.randint(0, 9)}-build.{_random_text(r, digits, 8)}", ""),
        lambda: (r.choice(["token ", "key ", "password "]), word() + word(), " " + word()), lambda: ("", word() + word() + word() + word() + str(r.randint(1, 9)), ""),
        lambda: ("image ", base64.b64encode("".join(word() for _ in range(4)).encode()).decode(), ""), lambda: ("order number ", _random_text(r, low.upper(), 4) + _random_text(r, digits, 14), ""),
    ])()
    return (before.upper(), value.upper(), after.upper()) if r.random() < 0.1 else (before, value, after)


def labelled_findings(spark: SparkSession, lines: list[str], n: int = TRAINING_FINDINGS, seed: int = SEED) -> DataFrame:
    """``(label, features)`` of ``n`` known values, half of them secret, each set into a line."""
    fillers = [" ".join(ws) for ws in COMMON_WORDS.values()]
    lines = [x for x in lines if x.strip()] or fillers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                r = random.Random(seed * 1_000_003 + i)
                before, value, after = known_value(r, bool(i % 2))
                line = r.choice(lines).split(" ")
                at = r.randint(0, len(line))
                mark = r.choice(["", "", "", "!!", "###", ".", ","])
                head = " ".join([*line[:at], before])
                text = " ".join([head + value + after + mark, *line[at:]])
                path = r.choice(["", "src1", "src7", "src/app/main.py", "config/settings.yml", "tests/fixtures/data.json", "docs/guide.md"])
                for start, end in candidates(text):
                    if start < len(head) + len(value) and end > len(head):
                        rows.append((float(i % 2), features(text[start:end], *around(text, start, end), path)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.float64()), pa.array([x[1] for x in rows], pa.list_(pa.float64()))], ["label", "features"])

    return spark.range(0, n, 1, 8).mapInArrow(run, "label double, features array<double>")


@dataclass
class Forest:
    """Trees as arrays: at a node go left if the feature is at most the limit; a leaf has feature -1 and its share of secrets."""

    roots: list[int]
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = np.asarray(rows, float).reshape(len(rows), -1)
        total, every = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                at = np.where(inner, np.where(x[every, f] <= self.limit[at], self.left[at], self.right[at]), at)
            total += self.share[at]
        return total / len(self.roots)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """A random forest over ``(label, features)``; both labels must occur.  At most ``trees * 2**(depth + 1)`` nodes reach the driver."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = findings.sparkSession
    rows = findings.select("label", array_to_vector("features").alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    folder = shared_folder(spark, "forest")
    model.write().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    first = {}
    for k, n in enumerate(nodes):
        first.setdefault(n["treeID"], k)
    leaf = [n["leftChild"] < 0 for n in nodes]
    place = [first[n["treeID"]] for n in nodes]
    return Forest(
        list(first.values()),
        np.array([-1 if end else n["split"]["featureIndex"] for end, n in zip(leaf, nodes)]),
        np.array([0.0 if end else n["split"]["leftCategoriesOrThreshold"][0] for end, n in zip(leaf, nodes)]),
        np.array([0 if end else p + n["leftChild"] for end, n, p in zip(leaf, nodes, place)]),
        np.array([0 if end else p + n["rightChild"] for end, n, p in zip(leaf, nodes, place)]),
        np.array([n["impurityStats"][1] / max(sum(n["impurityStats"]), 1e-9) for n in nodes]),
    )


def fitted(docs: DataFrame) -> Forest:
    """A forest trained on known values in lines of ``docs``: a line of each of the ``TRAINING_LINES`` documents with the smallest hashes."""
    line = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1)
    few = docs.select(F.xxhash64("text").alias("h"), F.left(line, F.lit(LINE_CHARS)).alias("line")).orderBy("h", "line").limit(TRAINING_LINES)
    return train(labelled_findings(docs.sparkSession, [r["line"] for r in few.collect()]))


FINDINGS = "findings array<struct<start:int,end:int,score:double>>"


def scan(docs: DataFrame, forest: Forest, path: str | None = "source") -> DataFrame:
    """``docs`` with ``findings``: every candidate's place (code points, from 0) and the forest's share of votes.

    A null text has none; ``path`` names a column that is read as the document's
    path, null as empty.  All columns stay, but an input column ``findings`` is replaced.
    """
    kept = [c for c in docs.columns if c != "findings"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), FINDINGS])
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(kept.index("text")).to_pylist()
            paths = batch.column(kept.index(path)).to_pylist() if path else [None] * len(texts)
            spans = [candidates(t) if t else [] for t in texts]
            rows = [features(t[a:b], *around(t, a, b), p or "") for t, p, found in zip(texts, paths, spans) for a, b in found]
            scores = iter(forest.score(rows).tolist() if rows else ())
            out = [[{"start": a, "end": b, "score": next(scores)} for a, b in found] for found in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(out, struct)], [*kept, "findings"])

    return docs.select(*kept).mapInArrow(run, schema)


def masked(scanned: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``scanned`` with every secret in ``text`` replaced by ``MASK`` and ``n_chars`` set to the new length; rows without one stay as they are."""
    secrets = F.filter("findings", lambda f: f["score"] >= threshold)

    def cut(state, f):
        piece = F.substring(F.col("text"), state["next"] + 1, f["start"] - state["next"])
        return F.struct(F.concat(state["text"], piece, F.lit(MASK)).alias("text"), f["end"].alias("next"))

    begin = F.struct(F.lit("").alias("text"), F.lit(0).alias("next"))
    whole = F.aggregate(secrets, begin, cut, lambda s: F.concat(s["text"], F.substring(F.col("text"), s["next"] + 1, F.length("text"))))
    text = F.when(F.size(secrets) > 0, whole).otherwise(F.col("text"))
    out = scanned.withColumn("text", text)
    return (out.withColumn("n_chars", F.when(F.size(secrets) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in out.columns else out).drop("findings")
