"""Toxicity of texts: a Levenshtein automaton over a learned lexicon, weighed by context.

The lexicon is a trie of words that labelled toxic documents hold far more often than
others.  All words within a few edits of a term are accepted by one automaton: its
states are the sets of (trie node, edits so far) that a prefix can reach, built as
texts ask for them, so a word costs one look-up a letter and most end after a few.
A hit weighs the log-odds of its term and distance, learned from the same labels.
The words around it then tell quotation from abuse: quotation marks and
reporting words lower it, address and other hits raise it.  A logistic model over
sums of that evidence gives the score.

Training reads a bounded sample of the labelled rows; every text is scored whole, in
Python workers over Arrow batches, without a shuffle.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.llm.common import Scratch

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bounds of the training: labelled documents (by the hash of their id), terms of the lexicon, near words with a weight of their own.
TRAINING_ROWS = 20_000
TERMS = 500
NEAR_WORDS = 20_000
#: A term has so many contexts in toxic training documents, and is surely so much likelier in them (log-odds less 1.64 standard errors).
MIN_TOXIC, MIN_LOG_ODDS, ERRORS = 3, 1.5, 1.64
#: Below this weight a near word is no hit.
LEAST_WEIGHT = 1.0
THRESHOLD = 0.5
#: Words before and behind a hit that its context score reads.
WINDOW = 8
#: Bounds of what a worker remembers; beyond them it starts again.
WORDS_KEPT, STATES_KEPT = 200_000, 20_000

#: A word may hold marks that stand for letters; those at its end are punctuation.
MARKS = "@$*!"
WORD = re.compile(r"[^\W_][\w@$*!]*")
QUOTED = re.compile(r'"[^"\n]{1,400}"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n]{1,400}»|^[ \t]*>[^\n]*', re.M)
# Word lists and shares: fixed values.
REPORTING = frozenset(
    "said says say saying called calls call calling wrote writes quote quotes quoted quoting term word insult slur reported "
    "sagte sagt nannte nennt schrieb zitat wort dit disait appelle écrit cita citation mot dijo dice llama llamó escribió palabra".split()
)
ADDRESS = frozenset("you your yours u ur youre du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes eres".split())
QUOTED_SHARE, REPORTED_SHARE, ADDRESS_SHARE, NEIGHBOUR_SHARE = -0.6, -0.3, 0.15, 0.1
LEAST_FACTOR, MOST_FACTOR = 0.1, 1.5


def edits_allowed(term: str) -> int:
    """How far from a term a word may be: short ones must be right, since many words lie near them."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


def words_of(text: str) -> set[str]:
    """The distinct words of a text, in lower case."""
    return {w.rstrip(MARKS) for w in set(WORD.findall(text.lower()))}


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return math.log(((toxic + 0.5) / (n_toxic + 1)) / ((clean + 0.5) / (n_clean + 1)))


class Automaton:
    """Words within their allowed edits of the terms of a trie."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.most: list[int] = [0]  # edits that any term below allows
        for i, term in enumerate(terms):
            node, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.term_at[node] = i
        self.alphabet = {c for kids in self.children for c in kids}
        self.forget()

    def forget(self) -> None:
        self.sets: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[list[tuple[int, int]] | None] = []
        self.start = self._number({0: 0})
        self.found: dict[str, list[tuple[int, int]]] = {}

    def _number(self, nodes: dict[int, int]) -> int:
        """The state of a set of nodes with their least edits, letters that the word leaves out included; -1 for none."""
        open_ = list(nodes.items())
        while open_:
            node, edits = open_.pop()
            if nodes[node] < edits:
                continue
            for child in self.children[node].values():
                if edits < self.most[child] and nodes.get(child, 9) > edits + 1:
                    nodes[child] = edits + 1
                    open_.append((child, edits + 1))
        if not nodes:
            return -1
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            self.ends.append(None)
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        nodes: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            if edits < self.most[node] and nodes.get(node, 9) > edits + 1:  # a letter too much
                nodes[node] = edits + 1
            for c, child in self.children[node].items():
                cost = edits if c == letter else edits + 1  # the letter, or another one
                if cost <= self.most[child] and nodes.get(child, 9) > cost:
                    nodes[child] = cost
        return self._number(nodes)

    def near(self, word: str) -> list[tuple[int, int]]:
        """``(term, edits)`` of all terms that ``word`` is near enough to."""
        if (known := self.found.get(word)) is not None:
            return known
        if len(self.sets) > STATES_KEPT or len(self.found) > WORDS_KEPT:
            self.forget()
        state = self.start
        for c in word:
            letter = c if c in self.alphabet else ""
            move = self.moves[state].get(letter)
            if move is None:
                move = self.moves[state][letter] = self._move(state, letter)
            state = move
            if state < 0:
                break
        found: list[tuple[int, int]] = []
        if state >= 0:
            if self.ends[state] is None:
                self.ends[state] = [
                    (self.term_at[node], edits)
                    for node, edits in self.sets[state].items()
                    if self.term_at[node] >= 0 and edits <= edits_allowed(self.terms[self.term_at[node]])
                ]
            found = self.ends[state]
        self.found[word] = found
        return found


@dataclass
class Lexicon:
    """Terms with their contexts in training documents of either label, and those of words near them.

    ``near`` counts per ``(term, edits)``, ``words`` per near word; ``totals`` are all toxic and clean texts.
    """

    terms: list[str]
    counts: list[tuple[int, int]]
    totals: tuple[int, int]
    near: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    words: dict[str, tuple[int, int]] = field(default_factory=dict)

    def __post_init__(self):
        self.index = {t: i for i, t in enumerate(self.terms)}
        self.automaton = Automaton(self.terms)
        self.weights: dict[tuple[str, int | None], tuple[int, int, float] | None] = {}

    def _odds(self, counts: tuple[int, int], label: int | None) -> float:
        (t, c), (nt, nc) = counts, self.totals
        own = (0, 0) if label is None else (label, 1 - label)
        return log_odds(max(t - own[0], 0), max(c - own[1], 0), nt - own[0], nc - own[1])

    def _weigh(self, word: str, label: int | None) -> tuple[int, int, float] | None:
        if word in self.index:
            i = self.index[word]
            return i, 0, self._odds(self.counts[i], label)
        best = None
        for term, edits in self.automaton.near(word):
            # Of a class of near words, then of the word itself, each drawn towards what is known without it.
            weight = 0.7**edits * self._odds(self.counts[term], label)
            for counts, trust in ((self.near.get((term, edits), (0, 0)), 4), (self.words.get(word, (0, 0)), 2)):
                seen = sum(counts) - (label is not None and sum(counts) > 0)
                if seen:
                    weight = (seen * self._odds(counts, label) + trust * weight) / (seen + trust)
            if weight >= LEAST_WEIGHT and (best is None or weight > best[2]):
                best = term, edits, weight
        return best

    def weigh(self, word: str, label: int | None = None) -> tuple[int, int, float] | None:
        """``(term, edits, weight)`` of a word, None if it says nothing.  ``label`` leaves out a training document's own count."""
        key = word, label
        if key not in self.weights:
            if len(self.weights) > WORDS_KEPT:
                self.weights.clear()
            self.weights[key] = self._weigh(word, label)
        return self.weights[key]


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    term: str
    edits: int
    quoted: bool
    evidence: float


def hits(text: str, lexicon: Lexicon, label: int | None = None) -> list[Hit]:
    """Terms and misspelled terms of a text (places in its lower-case form), with their evidence in context."""
    low = text.lower()
    weigh = lexicon.weigh
    if not any(weigh(w, label) for w in words_of(low)):
        return []
    places = [(m.start(), m.group().rstrip(MARKS)) for m in WORD.finditer(low)]
    found = [(i, *hit) for i, (_, w) in enumerate(places) if (hit := weigh(w, label))]
    spans = [m.span() for m in QUOTED.finditer(low)]
    out, s, left, right = [], 0, 0, 0
    for i, term, edits, weight in found:
        at, word = places[i]
        while s < len(spans) and spans[s][1] <= at:
            s += 1
        quoted = s < len(spans) and spans[s][0] <= at
        # Hits from WINDOW words before to WINDOW words behind, this one included.
        while found[left][0] < i - WINDOW:
            left += 1
        while right < len(found) and found[right][0] <= i + WINDOW:
            right += 1
        around = [w for _, w in places[max(0, i - WINDOW) : i + WINDOW + 1]]
        reported = not REPORTING.isdisjoint(around[: min(i, WINDOW)])
        factor = (
            1 + QUOTED_SHARE * quoted + REPORTED_SHARE * reported + ADDRESS_SHARE * (not ADDRESS.isdisjoint(around))
            + NEIGHBOUR_SHARE * min(right - left - 1, 3)
        )
        factor = min(max(factor, LEAST_FACTOR), MOST_FACTOR)
        out.append(Hit(at, at + len(word), lexicon.terms[term], edits, quoted, weight * factor))
    return out


def features(text: str, found: list[Hit]) -> list[float]:
    open_ = [h for h in found if not h.quoted]
    best: dict[str, float] = {}
    for h in open_:
        best[h.term] = max(best.get(h.term, h.evidence), h.evidence)
    total = sum(h.evidence for h in open_)
    strong = sum(h.evidence > 1 for h in open_)
    n = len(WORD.findall(text)) if found else 0
    return [
        1.0,
        max(best.values(), default=0.0),
        math.copysign(math.log1p(abs(total)), total),
        math.log1p(sum(v > 1 for v in best.values())),
        math.log1p(strong),
        math.log1p(100 * strong / n) if n else 0.0,
        math.log1p(sum(max(h.evidence, 0) for h in found if h.quoted)),
        math.log1p(sum(h.edits > 0 and h.evidence > 1 for h in open_)),
    ]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray
    scale: np.ndarray

    def score(self, text: str, found: list[Hit]) -> float:
        z = float(np.dot(np.array(features(text, found)) / self.scale, self.coefficients))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))


# ------------------------------------------------------------------ training


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document must not be learned; documents without an id are."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most ``TRAINING_ROWS`` labelled documents that are not held out.

    The sample is taken by a hash of the id, so it does not depend on the order of rows; several labels count as the highest.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS)
    # The sample is bounded by a parameter, so it goes to every task; the texts are not shuffled.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    return found.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))


def _with_context(text: str) -> dict[str, str]:
    """Every distinct word of a text and the words beside its first place."""
    words = [w.rstrip(MARKS) for w in WORD.findall(text.lower())]
    around: dict[str, str] = {}
    for left, word, right in zip(["", *words], words, [*words[1:], ""]):
        if word not in around:
            around[word] = f"{left} {right}"
    return around


def _counted(names: list[str], of_word):
    """``of_word`` gives the keys of a word; the result has, per key and context, whether toxic and clean texts of a task hold it."""
    types = [pa.string(), pa.int32(), pa.int32()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[bool]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, context in _with_context(text).items():
                    for key in of_word(word):
                        seen.setdefault((*key, context), [False, False])[toxic != 1] = True
        columns = [pa.array([k[i] for k in seen], t) for i, t in enumerate([*types, pa.string()])]
        columns += [pa.array([v[i] for v in seen.values()], pa.bool_()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "context", "toxic", "clean"])

    return run


def _counts(rows: DataFrame, keys: str, of_word) -> DataFrame:
    """Contexts per key in toxic and in clean texts.

    A text counts once for a word, by the words beside its first place, so copies
    of a text, and passages that many texts share, count once together.
    """
    names = [f.split()[0] for f in keys.split(", ")]
    counted = rows.mapInArrow(_counted(names, of_word), f"{keys}, context string, toxic boolean, clean boolean")
    each = counted.groupBy(*names, "context").agg(F.bool_or("toxic").alias("toxic"), F.bool_or("clean").alias("clean"))
    return each.groupBy(*names).agg(F.count_if("toxic").alias("toxic"), F.count_if("clean").alias("clean"))


def learned_lexicon(rows: DataFrame) -> Lexicon:
    """The words of toxic training documents with the strongest evidence, and how words near them are spread."""
    # Equal texts count once here too.
    totals = rows.agg(*(F.count_distinct(F.when((F.col("toxic") == 1) == y, F.xxhash64("text"))) for y in (True, False))).first()
    nt, nc = int(totals[0]), int(totals[1])
    words = _counts(rows, "word string", lambda word: [(word,)] if len(word) >= 3 else [])
    odds = F.log(((F.col("toxic") + 0.5) / (nt + 1)) / ((F.col("clean") + 0.5) / (nc + 1)))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = words.filter((F.col("toxic") >= MIN_TOXIC) & (odds - ERRORS * error >= MIN_LOG_ODDS))
    # By evidence: log-odds times contexts.
    chosen = strong.orderBy((odds * F.col("toxic")).desc(), "word").limit(TERMS).collect()
    lexicon = Lexicon([r["word"] for r in chosen], [(r["toxic"], r["clean"]) for r in chosen], (nt, nc))
    if not chosen:
        return lexicon
    plain = Lexicon(lexicon.terms, lexicon.counts, lexicon.totals)

    def near(word: str) -> list:
        return [] if word in plain.index else [(word, t, e) for t, e in plain.automaton.near(word)]

    by_word = _counts(rows, "word string, term int, edits int", near).persist()
    try:
        # Bounded: a pair of a term and a distance, and a parameter.
        for r in by_word.groupBy("term", "edits").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect():
            lexicon.near[r["term"], r["edits"]] = r["toxic"], r["clean"]
        each = by_word.groupBy("word").agg(F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
        for r in each.orderBy((F.col("toxic") + F.col("clean")).desc(), "word").limit(NEAR_WORDS).collect():
            lexicon.words[r["word"]] = r["toxic"], r["clean"]
    finally:
        by_word.unpersist()
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that are not held out; without labels of both kinds it knows no terms and scores their share."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(training_rows(docs, labels), "training")
    lexicon = learned_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # What a document says about itself is left out, so training evidence is like that of new documents.
            values = [features(t, hits(t, lexicon, int(y == 1))) for t, y in zip(texts, toxic)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.list_(pa.float64()))], ["toxic", "f"])

    # A few numbers for each training row, and those are bounded.
    got = rows.mapInArrow(run, "toxic int, f array<double>").collect()
    scratch.drop("training")
    width = len(features("", []))
    x, y = np.array([r["f"] for r in got]).reshape(-1, width), np.array([float(r["toxic"] == 1) for r in got])
    scale = np.maximum(np.abs(x).max(axis=0, initial=0), 1e-9)
    scale[scale <= 1e-9] = 1.0
    return Model(lexicon, logistic(x / scale, y), scale)


# ------------------------------------------------------------------- scoring

HITS = "array<struct<start:int,end:int,term:string,edits:int,quoted:boolean,evidence:double>>"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, hits`` of every whole text; a null text is empty.

    Null and repeated ids keep their rows; equal texts have equal scores.  A
    text without a hit, an empty one included, has the score of no evidence.  Of
    other columns none is read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("evidence", pa.float64())])
    types = [to_arrow_type(kind), pa.float64(), pa.list_(hit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                found = [hits(t, model.lexicon) for t in texts]
                scores = [model.score(t, h) for t, h in zip(texts, found)]
                columns = [part.column(0), pa.array(scores, types[1]), pa.array([[vars(h) for h in hs] for hs in found], types[2])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "hits"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, score double, hits {HITS}")
