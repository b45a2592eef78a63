"""Language identification by unigram piece models, marginalised over all segmentations.

Each language has probabilities of the pieces of a fixed public vocabulary, fitted by expectation maximisation. A
word's likelihood is the sum over all its segmentations, by a forward pass over the lattice of pieces; equal-length
words and all languages advance together in numpy. A text's score adds up its words; the posterior under a uniform
prior over languages is the score.

Words of any length are summed over all their segmentations: a long one (a text without spaces) is cut where no piece
reaches across, which changes no sum, and of what is still long, windows advance together.

Cases: null text and text without a letter are `und` with score 0; ties fall to the first language in order; with nothing to learn from, all is `und`; an empty
table gives no rows. Only text is read for a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fold, pieces, texts_of
from rasterloom.llm.sample import labelled_sample
from rasterloom.llm.vocab import SPACE, VOCAB_PATH, Vocab, Words, by_length, codes_of, load, sums_by_text, vocab_of

#: Learning takes about so many whole documents of each language.
DOCS_PER_LANG = 300
ROUNDS, SMOOTHING = 4, 0.05
#: Forward values are multiplied by this for each character, which keeps them in the range of doubles.
GAIN = 16.0
LETTER = regex.compile(r"\p{L}")


#: In fitting, what is longer than this without a place that no piece crosses, such as one letter repeated, is cut at each
#: multiple of it; all of it counts, but for the pieces across those cuts.
FITTED = 256
#: Parts above ALONE characters are summed in windows of TOGETHER that advance together.
TOGETHER, ALONE = 32, 1024


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _edges(v: Vocab, codes: np.ndarray) -> list[list[tuple[int, np.ndarray]]]:
    """By end: (size, ids), where -1 is the row of unknown characters for single ones, -2 nothing."""
    return [[(n, i if n == 1 else np.where(i < 0, -2, i)) for n, i in found] for _, found in v.lattice(codes)]


def _gains(p: np.ndarray) -> np.ndarray:
    """p, a row for nothing, a row for unknown characters; pieces rows by id, so that ids -2 and -1 index the last two."""
    return np.concatenate([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), 1e-7)])


def _forward(edges: list, gains: np.ndarray, m: int) -> list[np.ndarray]:
    a = [np.ones((m, gains.shape[1]))]
    for found in edges:
        total = 0.0
        for n, i in found:
            total = total + a[len(a) - n] * gains[i] * GAIN**n
        a.append(total)
    return a


def log_sums(v: Vocab, gains: np.ndarray, words: list[str], length: int) -> np.ndarray:
    """Log of the summed probabilities of all segmentations, (words, languages), of words of one length.

    Only the sums that a piece can still reach back to are held, and they are scaled to 1 every 32 characters."""
    last, scale = [np.ones((len(words), gains.shape[1]))], np.zeros((len(words), gains.shape[1]))
    for j, found in v.lattice(codes_of(words, length)):
        total = 0.0
        for n, i in found:
            total = total + last[-n] * gains[i if n == 1 else np.where(i < 0, -2, i)] * GAIN**n
        last = [*last[-v.longest :], total]
        if j % 32 == 0:
            by = np.maximum(total, 1e-300)
            last = [x / by for x in last]
            scale += np.log(by)
    return np.log(np.maximum(last[-1], 1e-300)) + scale - length * np.log(GAIN)


def long_sum(v: Vocab, gains: np.ndarray, word: str) -> np.ndarray:
    """The same for one long word, (languages). The sums at the last places before a window go in and those at its last places
    come out, and that is linear; so all windows of a stretch advance together, each from every unit vector, and the
    products follow one after another."""
    size, width = v.longest, gains.shape[1]
    state, scale = np.zeros((size, width)), np.zeros(width)
    state[-1] = 1.0
    rows = max(1, (1 << 17) // (size * size * width))
    whole = len(word) // TOGETHER * TOGETHER
    for a in range(0, whole, rows * TOGETHER):
        b = min(whole, a + rows * TOGETHER)
        n = (b - a) // TOGETHER
        # by window and place in it, the pieces that end there: (size, ids)
        ends: list[dict[int, np.ndarray]] = [{} for _ in range(TOGETHER)]
        for k, starts, ids in v.spans(word, max(0, a - size + 1), b):
            at = starts + k - 1 - a
            inside = (at >= 0) & (at < b - a)
            at, ids = at[inside], ids[inside]
            for j in np.unique(at % TOGETHER).tolist():
                own = at % TOGETHER == j
                ends[j].setdefault(k, np.full(n, -2))[at[own] // TOGETHER] = ids[own]
        last = [np.broadcast_to(np.eye(size)[i][None, :, None], (n, size, width)) for i in range(size)]
        for j in range(TOGETHER):
            one = ends[j].pop(1, np.full(n, -2))
            total = last[-1] * (gains[np.where(one < 0, -1, one)] * GAIN)[:, None, :]
            for k, i in ends[j].items():
                total = total + last[-k] * (gains[i] * GAIN**k)[:, None, :]
            last = [*last[1:], total]
        out = np.stack(last, 2)  # window, place before, place after, language
        for w in range(n):
            state = np.einsum("il,iol->ol", state, out[w])
            by = np.maximum(state.max(0), 1e-300)
            state, scale = state / by, scale + np.log(by)
    for j in range(whole + 1, len(word) + 1):
        total = np.zeros(width)
        for k in range(1, min(size, j) + 1):
            i = v.ids.get(word[j - k : j], -2)
            total = total + state[-k] * gains[i if i >= 0 or k > 1 else -1] * GAIN**k
        state = np.concatenate([state[1:], total[None]])
    return np.log(np.maximum(state[-1], 1e-300)) + scale - len(word) * np.log(GAIN)


def fit(v: Vocab, counts: dict[str, Counter]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of pieces, (pieces, languages), from word counts by language."""
    langs = sorted(counts)
    whole = sorted(set().union(*counts.values()))
    spaced, owner = v.parts([SPACE + w for w in whole])
    weight = np.array([[counts[g].get(whole[i], 0) for g in langs] for i in owner], float).reshape(len(spaced), len(langs))
    parts = [[w[k : k + FITTED] for k in range(0, len(w), FITTED)] for w in spaced]
    weight, spaced = np.repeat(weight, [len(x) for x in parts], axis=0), [w for x in parts for w in x]
    groups = [(n, places, _edges(v, codes_of([spaced[i] for i in places], n))) for n, places in by_length(spaced, len(langs))]
    size = len(v.pieces)
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(ROUNDS):
        gains, seen = _gains(p), np.zeros((size + 2, len(langs)))
        for n, places, edges in groups:
            a = _forward(edges, gains, len(places))
            b: list = [0.0] * n + [np.ones((len(places), len(langs)))]
            w = weight[places] / a[n]
            for j in range(n, 0, -1):
                for k, i in edges[j - 1]:
                    g = gains[i] * GAIN**k * b[j]
                    b[j - k] = b[j - k] + g
                    e = a[j - k] * g * w
                    for c in range(len(langs)):
                        seen[:, c] += np.bincount(i % (size + 2), e[:, c], size + 2)
        p = seen[:size] + SMOOTHING
        p /= p.sum(0)
    return langs, p


class Scorer:
    def __init__(self, v: Vocab, p: np.ndarray):
        self.v, self.gains, self.words, self.scores = v, _gains(p), Words(), np.zeros((0, p.shape[1]))

    def add(self, new: list[str]) -> None:
        width = self.scores.shape[1]
        parts, owner = self.v.parts([SPACE + w for w in new])
        out = np.zeros((len(parts), width))
        for n, places in by_length(parts, width):
            own = [parts[i] for i in places]
            out[places] = log_sums(self.v, self.gains, own, n) if n <= ALONE else [long_sum(self.v, self.gains, w) for w in own]
        sums = np.stack([np.bincount(owner, out[:, k], len(new)) for k in range(width)], 1) if width else np.zeros((len(new), 0))
        self.scores = np.concatenate([self.scores, sums])

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihoods, (texts, languages)."""
        if self.words.begin():
            self.scores = self.scores[:0]
        places, offsets, new = self.words.of(texts, words_of)
        if new:
            self.add(new)
        return sums_by_text(self.scores[places], offsets)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocab_path: str = VOCAB_PATH, docs_per_lang: int = DOCS_PER_LANG) -> tuple[list[str], np.ndarray]:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL")
    counts: dict[str, Counter] = {}
    for r in labelled_sample(rows, "lang", docs_per_lang, ["text"]):
        counts.setdefault(r["lang"], Counter()).update(words_of(r["text"]))
    return fit(vocab_of(load(vocab_path)), counts)


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, doc_id: str = "doc_id", text: str = "text", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast((load(vocab_path), langs, p.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, langs, p = sent.value
        scorer = Scorer(vocab_of(model), p.astype(float)) if langs else None
        for batch in pieces(batches, "text"):
            texts = texts_of(batch, "text")
            there = np.array([bool(t) and LETTER.search(t) is not None for t in texts]) & bool(langs)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if there.any():
                x = scorer.texts([t if h else None for t, h in zip(texts, there, strict=True)])
                x = np.exp(x - x.max(1, keepdims=True))
                best = x.argmax(1)
                pred = np.where(there, np.array(langs, object)[best], "und")
                score = np.where(there, x.max(1) / x.sum(1), 0.0)
            yield pa.record_batch([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op1(docs: DataFrame) -> DataFrame:
    """Learn from three folds of four, predict all rows."""
    langs, p = learn(docs.filter(fold(4) != 2))
    return identify(docs, langs, p).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
