"""SentencePiece encoding and decoding over a fixed vocabulary, by a batched numpy Viterbi.

The texts of a batch are cut into words; distinct words of one length advance together, character by character.
Hashes of all substrings that end at a character probe the sorted hashes of pieces of that length, and the running
maxima keep back pointers. The longest piece wins ties, as the first found does from the left. Characters outside
the vocabulary become the bytes of their UTF-8 form. A text that is not empty gets one leading space.

Cases: null gives null ids, no token and a null round_trip; the empty text gives no ids; a literal
U+2581 in a text cannot be told from a space, so round_trip is false there. A long word (a text without spaces) is
cut where no piece reaches across, which changes no path, and its parts advance together as words do; a part that is
still long, such as one letter a thousand times, is a batch of its own, with the same probes, time linear in its
length and memory for a stretch of it. Columns other than id and text are not read by encode().
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pieces, texts_of
from rasterloom.llm.vocab import BATCHED, SPACE, STRETCH, VOCAB_PATH, Vocab, Words, by_length, codes_of, load, split_spaces, vocab_of


def long_path(v: Vocab, word: str) -> array:
    """Ids of the best segmentation of one word of any length. The places of a stretch are probed at once, and the maxima run
    along it; from one stretch to the next go the last scores that a piece can reach back to. A place holds five bytes."""
    n = len(word)
    size_at, took, scores = np.ones(n, np.uint8), np.full(n, -1, np.int32), v.scores.tolist()
    best = [0.0]  # the scores of the last places
    for a, b in v.stretches(word):
        low = max(0, a - v.longest + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(b - a + 1)]
        for size, starts, ids in v.spans(word, low, b):
            for at, i in zip((starts + size - a).tolist(), ids.tolist(), strict=True):
                if 0 < at <= b - a:
                    ends[at].append((size, i))
        back, ids_ = [1] * (b - a), [-1] * (b - a)
        for j in range(1, b - a + 1):
            known, top = False, -np.inf
            for size, i in reversed(ends[j]):
                known = known or size == 1
                if (s := best[-size] + scores[i]) > top:
                    top, back[j - 1], ids_[j - 1] = s, size, i
            if not known and (s := best[-1] + v.unk_score) > top:
                top, back[j - 1], ids_[j - 1] = s, 1, -1
            best.append(top)
        size_at[a:b], took[a:b] = back, ids_
        del best[: -v.longest]
    out, j = array("i"), n
    while j:
        i = int(took[j - 1])
        if i >= 0:
            out.append(i)
        else:
            out.extend(v.bytes[list(word[j - 1].encode())].tolist()[::-1])
        j -= int(size_at[j - 1])
    out.reverse()
    return out


def best_paths(v: Vocab, words: list[str], length: int) -> list[list[int]]:
    """The same for words of one length, all at once."""
    codes = codes_of(words, length)
    m = len(words)
    best = np.full((m, length + 1), -np.inf)
    best[:, 0] = 0
    back, ids = np.zeros((m, length + 1), np.int8), np.full((m, length + 1), -1, np.int32)
    scores = np.append(v.scores, -np.inf)
    for j, found in v.lattice(codes):
        known = np.zeros(m, bool)
        for size, i in found:
            s = best[:, j - size] + scores[i]
            better = s > best[:, j]
            best[better, j], back[better, j], ids[better, j] = s[better], size, i[better]
            if size == 1:
                known = i >= 0
        s = np.where(known, -np.inf, best[:, j - 1] + v.unk_score)
        better = s > best[:, j]
        best[better, j], back[better, j], ids[better, j] = s[better], 1, -1
    out: list[list[int]] = [[] for _ in words]
    at, rows = np.full(m, length), np.arange(m)
    while len(rows):
        for row, i, j in zip(rows.tolist(), ids[rows, at[rows]].tolist(), at[rows].tolist(), strict=True):
            if i >= 0:
                out[row].append(i)
            else:
                out[row].extend(v.bytes[list(words[row][j - 1].encode())].tolist()[::-1])
        at[rows] -= back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    return [x[::-1] for x in out]


class Encoder:
    """Ids by distinct word in one array; a batch gathers from it."""

    def __init__(self, v: Vocab):
        self.v, self.words = v, Words()
        self.clear()

    def clear(self) -> None:
        self.values, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, new: list[str]) -> None:
        parts, owner = self.v.parts([SPACE + w.replace(" ", SPACE) for w in new])
        found: list[list[int]] = [[]] * len(parts)
        for n, places in by_length(parts):
            own = [parts[i] for i in places]
            for i, ids in zip(places, best_paths(self.v, own, n) if n <= BATCHED else [long_path(self.v, w) for w in own], strict=True):
                found[i] = ids
        sizes = np.bincount(owner, [len(x) for x in found], len(new)).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.values = np.concatenate([self.values, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and offsets of the texts in them."""
        if self.words.begin():
            self.clear()
        places, offsets, new = self.words.of(texts, split_spaces)
        if new:
            self.add(new)
        sizes = self.sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.arange(ends[-1]) + np.repeat(self.starts[places] - ends[:-1], sizes)
        return self.values[gather], ends[offsets]


def decode_ids(v: Vocab, ids: list[int] | np.ndarray) -> str:
    """The text of ids, a stretch at a time; bytes that are no UTF-8 become U+FFFD."""
    parts = []
    for k in range(0, len(ids), STRETCH):
        some = ids[k : k + STRETCH]
        some = some.tolist() if isinstance(some, np.ndarray) else some
        if v.byte_of.keys().isdisjoint(some):
            parts.append("".join(map(v.pieces.__getitem__, some)).encode())
        else:
            parts.append(b"".join(bytes([v.byte_of[i]]) if i in v.byte_of else v.pieces[i].encode() for i in some))
    return b"".join(parts).decode(errors="replace").replace(SPACE, " ")[1:]


_encoders: dict[int, Encoder] = {}


def encoder_of(model: bytes) -> Encoder:
    v = vocab_of(model)
    if id(v) not in _encoders:
        _encoders.clear()
        _encoders[id(v)] = Encoder(v)
    return _encoders[id(v)]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab_path: str = VOCAB_PATH, check: bool = True) -> DataFrame:
    """doc_id, n_tokens int, ids array<int>, round_trip boolean (the decoded ids are the text; null unless check)."""
    model = docs.sparkSession.sparkContext.broadcast(load(vocab_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(model.value)
        for batch in pieces(batches, "text"):
            texts = texts_of(batch, "text")
            ids, ends = e.encode(texts)
            null = np.array([t is None for t in texts])
            same = [None if t is None or not check else decode_ids(e.v, ids[a:b]) == t for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(null))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(ends).astype(np.int32)), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """encoded with a text column made from its ids; null ids give null."""
    model = encoded.sparkSession.sparkContext.broadcast(load(vocab_path))

    @F.pandas_udf("string")
    def text(series):  # noqa: ANN001, ANN202
        v = vocab_of(model.value)
        return series.map(lambda x: None if x is None else decode_ids(v, list(x)))

    return encoded.withColumn(out, text(F.col(ids)))
