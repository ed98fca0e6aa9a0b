"""Toxicity by a fuzzy lexicon and context windows.

The lexicon's terms are a trie.  A word is read by the product of that trie with
the Levenshtein automata of all terms at once: a state is the set of (trie node,
edits so far) that the letters read can have reached, made deterministic as it is
met and kept in a bounded memo.  So misspelled terms are caught in one pass over a
word's letters, and almost every word is dead after two or three of them.

Around each hit a window of words tells quotation from abuse: quotation marks on
both sides and reporting verbs speak for the first, direct address for the
second.  A logistic model weighs what the hits of a text add up to.

Learned from labelled rows: the lexicon's terms and word beginnings (one half of
a bounded sample) and the model (the other half).  A score reads the text alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, small_batches, stash, whole_text

#: Most labelled rows that are learned from, and most terms of the lexicon.
MAX_TRAIN = 20_000
MAX_TERMS = 4096
#: Most files that the counts of the words of those rows are written to.
WORD_FILES = 16
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: (log-odds, their z) from which a term is held, and from which it is a strong one.
WEAK, STRONG = (2.0, 2.5), (2.5, 3.5)
LEAST_DOCS = 3
PREFIX_LENGTHS = (4, 5, 6, 7)
CONTEXT_WORDS = 6
CONTEXT_CHARS = 60

#: Words that start the lexicon, before anything is learned.
SEEDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile",
    "dumb", "dumbass", "jerk", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "bullshit", "crap", "retard", "scumbag", "freak", "filth", "vermin",
    "arschloch", "scheisse", "dummkopf", "hurensohn", "connard", "salaud", "merde", "abruti", "pendejo", "cabron", "mierda", "estupido", "gilipollas",
)
REPORTING = frozenset(
    "said says say wrote writes called calls quoted quotes quote quoting term word sagte schrieb zitat nannte wort dit écrit cite citation appelé mot dijo escribió cita palabra".split()
)
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes".split())
QUOTES = "\"“”„«»‘’"

_WORD = re.compile(r"[^\W_]+(?:[*@$!][^\W_]+)*")
#: SQL twin of the words that terms are learned from.
_WORD_SQL = r"[\p{L}\p{N}]+"

FEATURES = ("bias", "any_strong", "strong", "kinds", "fuzzy", "weak", "prefix", "rate", "quoted")
#: The model before any label is seen, towards which the fit is drawn.
PRIOR = np.array([-3.0, 2.5, 1.5, 0.5, 0.3, 0.2, 0.5, 0.2, -1.0])
RIDGE = 0.5


def edits_for(term: str, strength: int = 2) -> int:
    """Edits that a word may be off a term: by its length, none off a weak one."""
    return 0 if len(term) < 5 or strength < 2 else 1 if len(term) < 10 else 2


@dataclass
class Lexicon:
    """terms: (text, kind, strength); kind ``word`` or ``prefix``, strength 2 or 1."""

    terms: list[tuple[str, str, int]]
    memo_states: int = 50_000
    memo_words: int = 300_000
    _children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    _word: list[int] = field(default_factory=lambda: [-1])
    _prefix: list[int] = field(default_factory=lambda: [-1])
    _most: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for k, (text, kind, strength) in enumerate(self.terms):
            at, most = 0, edits_for(text, strength) if kind == "word" else 0
            self._most[0] = max(self._most[0], most)
            for c in text:
                if c not in self._children[at]:
                    self._children[at][c] = len(self._children)
                    for part, x in ((self._children, {}), (self._word, -1), (self._prefix, -1), (self._most, 0)):
                        part.append(x)
                at = self._children[at][c]
                self._most[at] = max(self._most[at], most)
            if kind == "word":
                self._word[at] = k
            else:
                self._prefix[at] = k
        self._forget()
        self.pieces = _Pieces(self)

    def _forget(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._sets: list[tuple] = []
        self._next: list[dict[str, int]] = []
        self._start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The state of these (node: edits), with letters that the word left out."""
        todo = list(reached.items())
        while todo:
            node, e = todo.pop()
            for child in self._children[node].values():
                if e + 1 <= self._most[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(reached.items()))
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
        return self._ids[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self._most[node] and e < reached.get(node, 99) or e == 0 and node not in reached:
                reached[node] = e

        for node, e in self._sets[state]:
            reach(node, e + 1)  # a letter too many
            for letter, child in self._children[node].items():
                reach(child, e if letter == c else e + 1)
        to = self._next[state][c] = self._state(reached)
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best match: fewest edits, then the stronger term, a
        whole word before a beginning."""
        if len(self._sets) > self.memo_states:
            self._forget()
        state, prefix = self._start, -1
        for c in word:
            state = self._next[state].get(c) or self._step(state, c)
            held = self._sets[state]
            if not held:
                break
            for node, e in held:
                if e == 0 and (k := self._prefix[node]) >= 0 and (prefix < 0 or self.terms[k][2] >= self.terms[prefix][2]):
                    prefix = k
        else:
            best = min(((e, -self.terms[k][2], k) for node, e in self._sets[state] if (k := self._word[node]) >= 0 and e <= edits_for(self.terms[k][0], self.terms[k][2])), default=None)
            if best and (prefix < 0 or best[0] == 0 and -best[1] >= self.terms[prefix][2]):
                return best[2], best[0]
        return (prefix, 0) if prefix >= 0 else None


class _Pieces(dict):
    """The hits of the words in a piece of text without white space, or None; a
    bounded memo, as most pieces come again and hit nothing."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, piece: str) -> tuple | None:
        hits = tuple(h for w in _WORD.findall(piece) if (h := self.lexicon.find(w))) or None
        if len(piece) <= 40:
            if len(self) >= self.lexicon.memo_words:
                self.clear()
            self[piece] = hits
        return hits


def quotation(low: str, start: int, end: int) -> float:
    """How much the window around a hit speaks for quotation, from 0 to 1."""
    before, after = low[max(0, start - CONTEXT_CHARS) : start], low[end : end + CONTEXT_CHARS]
    z = -2.0
    if any(q in before for q in QUOTES) and any(q in after for q in QUOTES):
        z += 3.0
    words_before, words_after = _WORD.findall(before)[-CONTEXT_WORDS:], _WORD.findall(after)[:CONTEXT_WORDS]
    if not REPORTING.isdisjoint(words_before):
        z += 1.5
    if not ADDRESS.isdisjoint(words_before) or not ADDRESS.isdisjoint(words_after):
        z -= 1.5
    return 1 / (1 + math.exp(-z))


def features(text: str, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    pieces = low.split()
    if not any(map(lexicon.pieces.__getitem__, pieces)):
        return [1.0, *[0.0] * (len(FEATURES) - 1)]
    strong = fuzzy = weak = prefix = quoted = 0.0
    kinds = set()
    for m in _WORD.finditer(low):
        for k, edits in lexicon.pieces[m[0]] or ():
            _, kind, strength = lexicon.terms[k]
            q = quotation(low, m.start(), m.end())
            quoted += q
            if strength < 2:
                weak += 1 - q
                continue
            if edits:
                fuzzy += 1 - q
                continue
            kinds.add(k)
            if kind == "prefix":
                prefix += 1 - q
            else:
                strong += 1 - q
    sure = strong + prefix
    return [1.0, min(1.0, sure), math.log1p(strong), math.log1p(len(kinds)), math.log1p(fuzzy), math.log1p(weak), math.log1p(prefix), min(5.0, 100 * sure / len(pieces)), math.log1p(quoted)]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards PRIOR."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    terms: list[tuple[str, str, int]]
    weights: list[float]


def _feature_rows(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for rows in batches:
            each = [features(t or "", lexicon) for t in rows.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.list_(pa.float64())), rows.column(1)], ["x", "toxic"])

    return run


def held_out():
    """Whether a row is in the fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> Model:
    """The model from at most ``max_train`` labelled rows outside the held-out fold.

    The rows are the first by a hash of doc_id.  For the lexicon, a word counts once
    for every pair of neighbours, so near copies add little.  Several labels of a
    doc_id: the largest counts.  Without both labels the seeds and
    PRIOR serve.
    """
    named = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out())
    named = named.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(named), "doc_id")  # max_train rows at most
    sample = stash(rows.select("text", "toxic", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half")), "labelled")

    # a term counts once for every pair of neighbours that it is seen with, so that copies of a text count as one
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD_SQL), 0)
    seen = "transform(w, (x, i) -> concat(x, ' ', xxhash64(if(i = 0, null, element_at(w, greatest(i, 1))), try_element_at(w, i + 2))))"
    first = sample.filter("half = 0").select("toxic", words.alias("w"))
    uses = first.select("toxic", F.explode(F.expr(f"array_distinct({seen})")).alias("use"))
    uses = uses.distinct().select("toxic", F.split("use", " ")[0].alias("t")).filter(F.length("t").between(3, 40))
    whole = uses.groupBy("t").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g"))
    whole = stash(whole.coalesce(WORD_FILES), "words")  # a file costs executors without native Hadoop several processes
    bad, good = whole.agg(F.sum("b"), F.sum("g")).first()
    terms = {s: (s, "word", 2) for s in SEEDS}
    if bad and good:
        begun = whole.select(F.explode(F.expr("transform(filter(array(%s), k -> length(t) > k), k -> left(t, k))" % ", ".join(map(str, PREFIX_LENGTHS)))).alias("t"), "b", "g")
        begun = begun.groupBy("t").agg(F.sum("b").alias("b"), F.sum("g").alias("g")).withColumn("kind", F.lit("prefix"))
        counts = whole.withColumn("kind", F.lit("word")).unionByName(begun).filter(F.col("b") >= LEAST_DOCS)
        odds = F.log((F.col("b") + 0.5) / (F.col("g") + 0.5)) - F.lit(math.log(bad / good))
        counts = counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5)))
        best = counts.filter((F.col("odds") >= WEAK[0]) & (F.col("z") >= WEAK[1])).orderBy(F.desc("z"), "t", "kind").limit(max_terms)
        for r in best.collect():
            strength = 2 if r["odds"] >= STRONG[0] and r["z"] >= STRONG[1] else 1
            terms.setdefault(r["t"] if r["kind"] == "word" else (r["t"], "prefix"), (r["t"], r["kind"], strength))
    found = list(terms.values())
    pairs = sample.filter("half = 1").select("text", "toxic").mapInArrow(_feature_rows(found), "x array<double>, toxic int").collect()  # half of max_train rows
    x = np.array([r["x"] for r in pairs]).reshape(-1, len(FEATURES))
    y = np.array([r["toxic"] for r in pairs], float)
    return Model(found, fit(x, y).tolist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two columns more, called ``names``; every row and column stays.
    A name that ``docs`` has already raises ValueError."""
    if list(names) != fresh(docs, *names):
        raise ValueError(f"the table has a column {names[0]} or {names[1]} already")
    (text,) = fresh(docs, "text_read")

    def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(model.terms), np.array(model.weights)
        for rows in texts:
            last = rows.num_columns - 1
            x = np.array([features(t.as_py() or "", lexicon) for t in rows.column(last)]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            held = rows.columns[:last], rows.schema.names[:last]
            yield pa.RecordBatch.from_arrays([*held[0], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*held[1], *names])

    small_batches(docs.sparkSession)
    kind = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.withColumn(text, whole_text()).mapInArrow(run, kind)


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text is empty; empty texts get the score of a text without a hit, and
    long texts are read whole.  A null doc_id isn't held out and has no label.
    Repeated rows are scored alike, each on its own; ties of a label's copies go to
    the largest label.  Other columns aren't read.  No rows give no rows.
    """
    model = learn(docs, labels, max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    return score(rows, model, threshold).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns kept."""
    names = tuple(fresh(docs, "score", "predicted"))
    return score(docs, learn(docs, labels, max_train), threshold, names).filter(F.col(names[1]) == 0).drop(*names)
