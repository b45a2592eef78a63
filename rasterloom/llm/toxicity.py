"""Toxicity by a lexicon trie intersected with Levenshtein automata, and by what stands around each hit.

The lexicon is learned from labels: words, and stems that take many endings, that documents marked toxic hold far more
often than others. A document's distinct words run through one lazily determinised automaton, whose states are sets
of (trie node, edits so far); so a misspelling within the edits allowed for a term's length is found while the word
is read once, and nearly all words leave the automaton after a few letters. Misspellings that are words of clean
documents are no hits. A stem that clean documents hold too, but once, is a weak one: only a document with several words
of it has hits, one fewer than its words.

Each hit is scored in its context window: between quotation marks it is quoted and counts QUOTED of a plain one, a
misspelled one counts MISSPELLED of an exact one, and further hits in the window mark abuse. The weighted count, weak
hits, their density and company feed a logistic curve that is fitted to the labels; the two factors are given, for
labels with enough quotations or misspellings to fit them are rare.

Cases: null and empty texts have no hit and get the lowest score; with no labels of one kind nothing is toxic; very
long texts and words cost time in proportion; repeated rows and rows without an id score by their text; an empty table
gives no rows. Only text is read for a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fold, pieces, texts_of
from rasterloom.llm.sample import joined_sample
from rasterloom.llm.vocab import Words

#: Learning takes about so many whole documents of each label.
DOCS_PER_LABEL = 1500
#: A term needs so many times the odds in toxic documents, and this likelihood ratio (G) against chance.
LEAST_ODDS, LEAST_G = 12.0, 25.0
#: The automaton begins anew above so many states.
MOST_STATES = 100_000
#: Stems have at least STEM letters and at most LONGEST_STEM; WINDOW words on either side are a hit's context.
STEM, LONGEST_STEM, WINDOW = 4, 24, 6
#: What a misspelled hit counts beside an exact one, and a quoted one beside a plain one.
MISSPELLED, QUOTED = 0.5, 0.25
#: Words of one weak stem that a document must hold.
SEVERAL = 2
THRESHOLD = 0.7
EDGE = ".,!?;:\"'()[]{}<>«»„“”‚‘’`*_|~#$%&-…"
QUOTES = frozenset("\"«»„“”‚‘’`")

def edits_for(length: int, stem: bool) -> int:
    return int(length >= (8 if stem else 5))


def bare(word: str) -> str:
    return word.strip(EDGE).lower()


class Automaton:
    """Terms in a trie; states are frozen sets of (node, edits) and are made when first reached."""

    def __init__(self, terms: dict[str, bool]):
        """terms: whether each is a stem, which any ending may follow."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, bool]] = {}
        self.limit: list[int] = [0]
        for term, stem in terms.items():
            node, most = 0, edits_for(len(term), stem)
            for c in term:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.limit.append(0)
                self.limit[node] = max(self.limit[node], most)
            self.limit[0] = max(self.limit[0], most)
            self.ends[node] = most, stem
        self._begin()

    def _begin(self) -> None:
        """State 0 is dead, state 1 the start; moves are filled in as words need them."""
        self.sets: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ended: list[int] = []
        self.stem: list[int] = []
        self._state(frozenset())
        self._state(self._close({(0, 0)}))

    def _state(self, s: frozenset) -> int:
        if s not in self.index:
            self.index[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
            ok = [(k, self.ends[node][1]) for node, k in s if node in self.ends and k <= self.ends[node][0]]
            self.ended.append(min((k for k, _ in ok), default=9))
            self.stem.append(min((k for k, stem in ok if stem), default=9))
        return self.index[s]

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        """With letters of a term left out; of one node only the fewest edits stay, within what its terms allow."""
        best: dict[int, int] = {}
        stack = list(states)
        while stack:
            node, k = stack.pop()
            if k > self.limit[node] or best.get(node, 9) <= k:
                continue
            best[node] = k
            stack.extend((n, k + 1) for n in self.next[node].values())
        return frozenset(best.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, k in state:
            if c in self.next[node]:
                out.add((self.next[node][c], k))
            out.add((node, k + 1))
            out.update((n, k + 1) for n in self.next[node].values())
        return self._close(out)

    def edits(self, word: str) -> int:
        """The fewest edits from a term (or from a stem at the word's beginning), -1 if more than allowed."""
        if len(self.sets) > MOST_STATES:
            self._begin()
        moves, stem, state, found = self.moves, self.stem, 1, 9
        for c in word:
            after = moves[state].get(c)
            if after is None:
                after = moves[state][c] = self._state(self._step(self.sets[state], c))
            state = after
            if not state:
                break
            if stem[state] < found:
                found = stem[state]
        found = min(found, self.ended[state])
        return found if found < 9 else -1


FEATURES = 4


@dataclass
class Model:
    terms: dict[str, bool]
    weak: frozenset = frozenset()
    clean: frozenset = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    automaton: Automaton | None = None

    def __getstate__(self):
        return {"terms": self.terms, "weak": self.weak, "clean": self.clean, "weights": self.weights, "automaton": None}


class Scorer:
    def __init__(self, model: Model):
        self.model, self.words = model, Words()
        self.kind, self.stem = np.zeros(0, np.int8), np.zeros(0, np.int64)
        self.weak = {x: i + 1 for i, x in enumerate(sorted(model.weak))}
        self.lengths = sorted({len(x) for x in model.weak})
        model.automaton = model.automaton or Automaton(model.terms)

    def _kind(self, word: str) -> int:
        """Bits: 1 exact hit, 2 misspelled hit, 4 quotation mark before the word, 8 after it."""
        b = bare(word)
        k = self.model.automaton.edits(b) if b else -1
        hit = 0 if k < 0 or (k and b in self.model.clean) else 1 if k == 0 else 2
        at = max(word.lower().find(b), 0) if b else len(word)  # marks that stand alone are one before nothing
        return hit | 4 * (not QUOTES.isdisjoint(word[:at])) | 8 * (not QUOTES.isdisjoint(word[at + len(b) :]))

    def _stem(self, word: str) -> int:
        """The number of the weak stem that a word begins with, 0 without one."""
        b = bare(word)
        return next((self.weak[b[:n]] for n in self.lengths if b[:n] in self.weak), 0)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, as logarithms of one more: weighted hits, weak hits, density of both, hits in company."""
        if self.words.begin():
            self.kind, self.stem = self.kind[:0], self.stem[:0]
        places, offsets, new = self.words.of(texts, str.split)
        self.kind = np.concatenate([self.kind, np.fromiter(map(self._kind, new), np.int8, len(new))])
        self.stem = np.concatenate([self.stem, np.fromiter(map(self._stem, new), np.int64, len(new))])
        out, size = np.zeros((len(texts), FEATURES)), np.diff(offsets)
        self._hits(self.kind[places], places, offsets, out)
        at = np.flatnonzero(self.stem[places])
        if len(at):
            doc = np.searchsorted(offsets, at, side="right") - 1
            # distinct words of each stem in each document
            each = np.unique(np.stack([doc, self.stem[places[at]], places[at]], 1), axis=0)
            pair, n = np.unique(each[:, :2], axis=0, return_counts=True)
            out[:, 1] = np.bincount(pair[:, 0], np.maximum(n - SEVERAL + 1, 0), len(texts))
        out[:, 2] = (out[:, 0] + out[:, 1]) / np.maximum(size, 1) * 100
        return np.log1p(out)

    def _hits(self, kind: np.ndarray, places: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
        at = np.flatnonzero(kind & 3)
        if not len(at):
            return
        doc = np.searchsorted(offsets, at, side="right") - 1
        lo, hi = np.maximum(at - WINDOW, offsets[doc]), np.minimum(at + WINDOW + 1, offsets[doc + 1])
        marks = lambda bits: np.concatenate([[0], np.cumsum((kind & bits) > 0)])
        opened, closed, hits = marks(4), marks(8), marks(3)
        # quoted: an odd number of marks before the hit, so that one is open, and one after it
        before = opened[at + 1] - opened[lo] + closed[at] - closed[lo]
        quoted = (before % 2 == 1) & (opened[hi] - opened[at + 1] + closed[hi] - closed[at] > 0)
        exact = (kind[at] & 1) > 0
        once = np.zeros(len(at), bool)  # a misspelling counts once in a document: repeated, it is rather a word of its own
        once[np.unique(doc * (len(self.kind) + 1) + places[at], return_index=True)[1]] = True
        weight = np.where(quoted, QUOTED, 1.0) * np.where(exact, 1.0, MISSPELLED * once)
        out[:, 0] = np.bincount(doc, weight, len(out))
        out[:, 3] = np.bincount(doc, (hits[hi] - hits[lo] > 1) & ~quoted, len(out))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        w = self.model.weights
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -500, 500)))


def _begun(words: set[str], known: dict | None = None) -> Counter:
    """How many words begin with each stem (of those known, if given)."""
    out = Counter(w[:k] for w in words for k in range(STEM, min(len(w), LONGEST_STEM) + 1))
    return out if known is None else Counter({x: n for x, n in out.items() if x in known})


def lexicon(texts: list[str], labels: np.ndarray) -> tuple[dict[str, bool], frozenset]:
    """Terms, and whether each is a stem; weak stems.

    Evidence for a term is its toxic documents or its distinct contexts (the words before and after it) in them,
    whichever are fewer: copies of a document add no contexts, and one long document is one document. Evidence against
    it is the clean documents that hold it; for a weak stem, documents of either kind that hold several words of it."""
    n1, n0 = int(labels.sum()), int((labels == 0).sum())
    share = n1 / (n1 + n0)

    def able(k: int, c: int) -> bool:
        if not k or c > k * n0 / n1 / LEAST_ODDS:
            return False
        return 2 * (k * np.log(k / ((k + c) * share)) + (c * np.log(c / ((k + c) * (1 - share))) if c else 0)) >= LEAST_G

    sets = [{w for w in map(bare, t.split()) if len(w) > 2} for t in texts]
    word, begin, twice = ([Counter(), Counter()] for _ in range(3))
    for kind in (1, 0):
        known = {x for x, k in begin[1].items() if able(k, 0)} if kind == 0 else None
        for own, y in zip(sets, labels.tolist(), strict=True):
            if y == kind:
                found = _begun(own, known)
                word[kind].update(own)
                begin[kind].update(found.keys())
                twice[kind].update(x for x, n in found.items() if n >= SEVERAL)
    whole = {w for w, k in word[1].items() if able(k, word[0][w])}
    stems = {x for x, k in begin[1].items() if able(k, begin[0][x])}
    weak = {x for x, k in twice[1].items() if x not in stems and able(k, twice[0][x])}
    contexts: dict[str, set] = {}
    for t, y in zip(texts, labels.tolist(), strict=True):
        if y == 1:
            words = [bare(w) for w in t.split()]
            for before, w, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                if w in whole:
                    contexts.setdefault(w + "$", set()).add((before, after))
                for k in range(STEM, min(len(w), LONGEST_STEM) + 1):
                    if w[:k] in stems or w[:k] in weak:
                        contexts.setdefault(w[:k], set()).add((before, w, after))
    seen = lambda x, k: min(k, len(contexts.get(x, ())))
    whole = {w: k for w in whole if able(k := seen(w + "$", word[1][w]), word[0][w])}
    stems = {x: k for x in stems if able(k := seen(x, begin[1][x]), begin[0][x])}
    weak = {x: k for x in weak if able(k := seen(x, twice[1][x]), twice[0][x])}
    chosen: set[str] = set()
    for x in sorted(weak, key=len):
        if not any(x[:k] in chosen for k in range(STEM, len(x))):
            chosen.add(_extended(x, weak))
    # a weak stem stands for the stems and words that it explains: those that have no more evidence alone
    under = lambda w: next((weak[w[:k]] for k in range(STEM, len(w) + 1) if w[:k] in chosen), 0)
    terms: dict[str, bool] = {}
    for x in sorted(stems, key=len):
        if any(terms.get(x[:k]) for k in range(STEM, len(x))) or stems[x] <= under(x):
            continue
        # where a few words hold most of a stem's evidence, they are terms and it is none
        held = sorted((k for w, k in word[1].items() if w.startswith(x)), reverse=True)
        if sum(held[:2]) < 0.6 * sum(held):
            terms[_extended(x, stems)] = True
    for w, k in sorted(whole.items()):
        if not any(terms.get(w[:j]) for j in range(STEM, len(w) + 1)) and k > under(w):
            terms[w] = False
    return terms, frozenset(chosen)


def _extended(x: str, stems: dict[str, int]) -> str:
    """A stem as long as nearly all its evidence goes on."""
    while longer := [y for y in stems if len(y) == len(x) + 1 and y.startswith(x) and stems[y] >= 0.9 * stems[x]]:
        x = longer[0]
    return x


def fit(texts: list[str | None], labels: np.ndarray, prior: float) -> Model:
    texts = [t or "" for t in texts]
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        return Model({}, weights=np.array([0.0] * FEATURES + [-30.0]))
    model = Model(*lexicon(texts, labels))
    model.automaton = Automaton(model.terms)
    near = lambda rows: frozenset(w for w in {bare(w) for i in rows if labels[i] == 0 for w in texts[i].split()} if model.automaton.edits(w) > 0)
    # each half is seen with the clean words of the other, as unseen documents will be
    x = np.ones((len(texts), FEATURES + 1))
    for own in (0, 1):
        rows = range(own, len(texts), 2)
        model.clean = near(range(1 - own, len(texts), 2))
        x[own::2, :FEATURES] = Scorer(model).features([texts[i] for i in rows])
    model.clean = near(range(len(texts)))
    w = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    theta, ridge = np.zeros(x.shape[1]), np.array([0.05] * FEATURES + [1e-4])
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (labels - p)) - ridge * theta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        theta = theta + np.clip(np.linalg.solve(h, g), -3, 3)
    model.weights = theta
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", docs_per_label: int = DOCS_PER_LABEL) -> Model:
    got, counts = joined_sample(docs, labels, label, docs_per_label, doc_id, text)
    return fit([r["text"] for r in got], np.array([r["label"] for r in got], int), counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, hits: terms by the weight of their context and spelling."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for batch in pieces(batches, "text"):
            x = s.features(texts_of(batch, "text"))
            out = 1 / (1 + np.exp(-np.clip(x @ s.model.weights[:-1] + s.model.weights[-1], -500, 500)))
            yield pa.record_batch([batch.column(0), pa.array(out), pa.array(np.round(np.expm1(x[:, 0]), 3))], ["doc_id", "score", "hits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, hits double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from two folds of three, score all rows."""
    model = learn(docs, labels.filter(fold(3) != 1))
    return score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
