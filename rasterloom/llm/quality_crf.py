"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's evidence is a table look-up for each of its own binned features and for
those of the line before and after it; a transition matrix ties neighbours. Forward-backward marginals, weighted by
line length, average to a document's share of good text, which a logistic curve turns into the score.

Learning has labels of documents only. Lines begin with their document's label; after a first fit, lines of bad
documents that look good by themselves are relabelled, and the fit is repeated.

Cases: null and empty texts are one empty line, so they get a score like any other; with no labels the score is 1;
documents without labels are scored alike; an empty table gives no rows. Only text is read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fold, pieces, texts_of
from rasterloom.llm.sample import joined_sample

#: Learning takes about so many whole documents of each label.
DOCS_PER_LABEL = 1500
THRESHOLD = 0.3
#: Cut points of each feature's bins.
CUTS = {
    "length": [0.5, 10, 30, 80, 200, 600, 2000],
    "word": [2, 3, 4, 5, 6, 8, 12, 20],
    "upper": [0.001, 0.02, 0.05, 0.1, 0.3, 0.6],
    "digit": [0.001, 0.02, 0.08, 0.25],
    "point": [0.001, 0.01, 0.02, 0.04, 0.08, 0.15],
    "symbol": [0.001, 0.01, 0.03, 0.06, 0.12, 0.25],
    "other": [0.001, 0.03, 0.08, 0.15, 0.4],
    "fresh": [0.15, 0.3, 0.5, 0.65, 0.8, 0.9, 0.999],
    "ends": [0.5],
    "again": [0.5],
    "place": [0.5],
}
WIDTH = 10
_CLASS = np.zeros(256, np.int8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[128:] = 5


def lines_of(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All lines, and offsets of the texts in them; every text has a line."""
    lines, ends = [], [0]
    for t in texts:
        lines.extend((t or "").split("\n"))
        ends.append(len(lines))
    return lines, np.array(ends)


def features(lines: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins, (lines, features), and line lengths in bytes."""
    data = [x.encode() for x in lines]
    size = np.fromiter(map(len, data), np.int64, len(data))
    stop = np.cumsum(size)
    kind = _CLASS[np.frombuffer(b"".join(data), np.uint8)]
    share = {}
    for name, c in (("upper", 1), ("digit", 2), ("point", 3), ("symbol", 4), ("other", 5)):
        places = np.flatnonzero(kind == c)
        share[name] = np.diff(np.searchsorted(places, np.concatenate([[0], stop]))) / np.maximum(size, 1)
    words, fresh = np.zeros(len(lines)), np.ones(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            words[i], fresh[i] = len(w), len(set(w)) / len(w)
    again, first = np.zeros(len(lines)), np.zeros(len(lines))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        first[a] = 1
        if b - a > 1:
            seen: set[str] = set()
            for i in range(a, b):
                again[i] = lines[i] in seen
                seen.add(lines[i])
    value = share | {"length": size, "word": size / np.maximum(words, 1), "fresh": fresh, "ends": np.array([x[-1:] in (".", "?", "!", ":") for x in lines]), "again": again, "place": first}
    return np.stack([np.searchsorted(cuts, value[name], side="right") for name, cuts in CUTS.items()], 1), np.maximum(size, 1)


def _cells(bins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Indices into the flat weight table, (lines, 3 * features): own, before, after. Bin WIDTH - 1 stands for no line."""
    n, k = bins.shape
    none = np.full((1, k), WIDTH - 1)
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    before[ends[:-1]], after[ends[1:] - 1] = WIDTH - 1, WIDTH - 1
    return np.concatenate([bins, before, after], 1) + np.arange(3 * k) * WIDTH


def marginals(e: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected transition counts summed over texts; e: the evidence for good over bad.

    Texts advance together, longest first, so that each step is one vector over those that still have lines."""
    n = np.diff(ends)
    order = np.argsort(-n, kind="stable")
    start, n = ends[:-1][order], n[order]
    alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right") if len(n) else []
    fwd, bwd, pairs = np.zeros((len(e), 2)), np.zeros((len(e), 2)), np.zeros((2, 2))
    own = np.stack([np.zeros(len(e)), e], 1)
    for t, m in enumerate(alive):
        at = start[:m] + t
        f = own[at] if t == 0 else own[at] + np.logaddexp(fwd[at - 1, :1] + trans[0], fwd[at - 1, 1:] + trans[1])
        fwd[at] = f - f.max(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        x = own[at + 1] + bwd[at + 1]
        b = np.logaddexp(x[:, :1] + trans[:, 0], x[:, 1:] + trans[:, 1])
        bwd[at] = b - b.max(1, keepdims=True)
        both = fwd[at][:, :, None] + trans + x[:, None, :]
        both = np.exp(both - both.max((1, 2), keepdims=True))
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    return 1 / (1 + np.exp(np.clip((fwd + bwd)[:, 0] - (fwd + bwd)[:, 1], -500, 500))), pairs


@dataclass
class Model:
    table: np.ndarray
    trans: np.ndarray
    slope: float = 0.0
    level: float = 30.0

    def shares(self, texts: list[str | None]) -> np.ndarray:
        lines, ends = lines_of(texts)
        bins, size = features(lines, ends)
        good, _ = marginals(self.table[_cells(bins, ends)].sum(1), ends, self.trans)
        return np.add.reduceat(good * size, ends[:-1]) / np.add.reduceat(size, ends[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.shares(texts) + self.level)))


def _fit_chain(cells: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, rate: float = 0.1, penalty: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the conditional likelihood of the line labels y."""
    size = int(len(CUTS) * 3 * WIDTH)
    theta = np.zeros(size + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.setdiff1d(np.arange(len(y)), ends[1:] - 1)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), 1)
    flat, total = cells.ravel(), weight.sum()
    for t in range(1, steps + 1):
        table, trans = theta[:size], theta[size:].reshape(2, 2)
        p, pairs = marginals(table[cells].sum(1), ends, trans)
        miss = (y - p) * weight
        g = np.concatenate([np.bincount(flat, np.repeat(miss, cells.shape[1]), size) / total, ((seen - pairs) / len(y)).ravel()]) - penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:size], theta[size:].reshape(2, 2)


def fit(texts: list[str | None], labels: np.ndarray, prior: float) -> Model:
    """prior: the share of label 1 among labelled rows, which the sample does not keep."""
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        one = bool(len(labels) and labels[0] == 0)
        return Model(np.zeros(len(CUTS) * 3 * WIDTH), np.zeros((2, 2)), 0.0, -30.0 if one else 30.0)
    lines, ends = lines_of(texts)
    bins, _ = features(lines, ends)
    cells, n = _cells(bins, ends), np.diff(ends)
    y = np.repeat(labels, n)
    weight = np.repeat(1.0 / n, n)  # a document counts once, however many lines it has
    table, trans = _fit_chain(cells, ends, y, weight, 60)
    own = table[cells[:, : len(CUTS)]].sum(1)
    y = np.where((y == 0) & (own > np.log(9)), 1, y)
    model = Model(*_fit_chain(cells, ends, y, weight, 80))
    x = model.shares(texts)
    w = np.where(labels == 1, prior / max(labels.mean(), 1e-9), (1 - prior) / max(1 - labels.mean(), 1e-9))
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton steps for the logistic curve, with a small ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (labels - p) * x).sum() - 1e-2 * a, (w * (labels - p)).sum()])
        h = w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
    model.slope, model.level = float(a), float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", docs_per_label: int = DOCS_PER_LABEL) -> Model:
    got, counts = joined_sample(docs, labels, label, docs_per_label, doc_id, text)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r["text"] for r in got], np.array([r["label"] for r in got], int), prior)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = pa.array(sent.value.scores(texts_of(batch, "text")))
            yield pa.record_batch([batch.column(0), out], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score threshold or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(sent.value.scores(texts_of(batch, text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from four folds of five, score all rows."""
    model = learn(docs, labels.filter(fold(5) != 0))
    return score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
