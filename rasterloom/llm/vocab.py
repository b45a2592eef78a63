"""A fixed public piece vocabulary, and the lattice of its pieces over batches of words.

The file is a SentencePiece model; only its pieces, scores and types are read, and the scores are taken as unigram
scores. load() runs on the driver; the contents (32,000 pieces, half a megabyte, whatever the data) are broadcast.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

VOCAB_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words above this many characters are first cut where no piece reaches across; what is left longer than this is alone.
BATCHED = 64
UNK_PENALTY = 10.0
#: Characters of a long word that are worked on at once.
STRETCH = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protobuf message: numbers, and ints or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[i : i + n]
            i += n


def load(path: str = VOCAB_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocab:
    def __init__(self, model: bytes):
        self.pieces, scores, self.types = [], [], []
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.types.append(x.get(3, NORMAL))
        scores = np.array(scores)
        normal = np.array(self.types) == NORMAL
        # pieces with no rank of their own (score -1e9) come after all others; at -1e9 sums would lose the rest
        ranked = normal & (scores > -1e8)
        scores[normal & ~ranked] = scores[ranked].min() - 1
        self.unk_score = float(scores[normal].min() - UNK_PENALTY)
        top = float(scores[normal].max())
        self.scores = np.array([len(p.encode()) * top - 0.1 if t == USER else s for p, s, t in zip(self.pieces, scores, self.types, strict=True)])
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        self.bytes = np.zeros(256, np.int32)
        for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        self.longest = max(map(len, self.ids))
        # no piece has a space after another character, so the best path of a text is that of its words side by side
        assert not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.reach: dict[str, int] = {}
        for p in self.ids:
            self.reach[p[-1]] = max(len(p), self.reach.get(p[-1], 0))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(self.longest, BASE, np.uint64))
            self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for n in range(1, self.longest + 1):
                own = [p for p in self.ids if len(p) == n]
                if own:
                    h = self.prefix_hashes(codes_of(own, n))[:, n]
                    order = np.argsort(h)
                    assert len(np.unique(h)) == len(h)
                    self.keys[n] = h[order], np.array([self.ids[p] for p in own], np.int32)[order]

    def prefix_hashes(self, codes: np.ndarray) -> np.ndarray:
        x = codes.astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + x[:, j]
        return out

    def lattice(self, codes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each end j of words of one length: (piece length, id of the piece that ends there or -1 by word), longest first."""
        h = self.prefix_hashes(codes)
        for j in range(1, codes.shape[1] + 1):
            found = []
            for n in sorted((n for n in self.keys if n <= j), reverse=True):
                keys, ids = self.keys[n]
                want = h[:, j] - h[:, j - n] * self.power[n - 1]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                if n == 1 or hit.any():
                    found.append((n, np.where(hit, ids[at], -1)))
            yield j, found


    def spans(self, word: str, first: int = 0, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(piece length, starts, ids) of the pieces that start at places from first to end of one word, for all of these
        places at once."""
        end = len(word) if end is None else min(end, len(word))
        part = word[first : end + self.longest - 1]
        x = codes_of([part], len(part))[0].astype(np.uint64) + np.uint64(1)
        x = (x ^ (x >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        h = np.zeros(len(x), np.uint64)
        for n in range(1, min(self.longest, len(x)) + 1):
            h = h[: len(x) - n + 1] * BASE + x[n - 1 :]
            if n in self.keys:
                keys, ids = self.keys[n]
                own = h[: end - first]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                found = np.flatnonzero(keys[at] == own)
                yield n, found + first, ids[at[found]]

    def stretches(self, word: str) -> Iterator[tuple[int, int]]:
        """First and end of stretches of a word; what is worked on a stretch at a time is bounded, however long the word is."""
        for a in range(0, len(word), STRETCH):
            yield a, min(a + STRETCH, len(word))

    def segments(self, word: str) -> list[str]:
        """The parts of a word between places that no piece reaches across; every segmentation is cut at all of them, so
        best paths, sums over all paths and token counts of the word are those of its parts."""
        edges, over = [0], np.zeros(self.longest, np.int64)
        for a, b in self.stretches(word):
            crossed = np.zeros(b - a + self.longest + 1, np.int64)
            crossed[: self.longest] = over
            for n, starts, _ in self.spans(word, a, b):
                if n > 1:
                    np.add.at(crossed, starts + 1 - a, 1)
                    np.add.at(crossed, starts + n - a, -1)
            sums = np.cumsum(crossed)
            edges.extend((np.flatnonzero(sums[: b - a] == 0) + a)[int(a == 0) :].tolist())
            # what crosses into the next stretch: the sum so far, and the ends beyond
            over = np.append(sums[b - a], crossed[b - a + 1 : b - a + self.longest])
        edges.append(len(word))
        return [word[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def parts(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Words, the long ones as their segments, and the place of the word that each belongs to."""
        out, owner = [], []
        for i, w in enumerate(words):
            own = [w] if len(w) <= BATCHED else self.segments(w)
            out.extend(own)
            owner.extend([i] * len(own))
        return out, np.array(owner, np.int64)


def codes_of(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


_built: dict[int, Vocab] = {}


def vocab_of(model: bytes) -> Vocab:
    """The vocabulary of these contents, built once in a process."""
    key = hash(model)
    if key not in _built:
        _built.clear()
        _built[key] = Vocab(model)
    return _built[key]


def by_length(words: list[str], width: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths, and the places of the words that have them; in portions that bound matrices of width values a character."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            n = int(lengths[part[0]])
            step = max(1, (1 << 19) // max(n * width, 1))
            for i in range(0, len(part), step):
                yield n, part[i : i + step]


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


_runs = re.compile(r" [ ▁]*[^ ▁]*|▁[ ▁]*[^ ▁]*")


def split_spaces(text: str) -> list[str]:
    """Words of a text with their leading spaces, less one; together with one space each they make up ' ' + text."""
    whole = " " + text
    if "  " in whole or SPACE in whole:
        return [w[1:] for w in _runs.findall(whole)]
    return text.split(" ")


class Words:
    """Distinct words by place, kept from batch to batch up to a number of words and of characters, then begun anew."""

    def __init__(self, most: int = 250_000, most_chars: int = 8 << 20):
        self.most, self.most_chars, self.places, self.done, self.chars = most, most_chars, _Places(), 0, 0

    def begin(self) -> bool:
        """Before a batch; True if the places so far are void."""
        if len(self.places) > self.most or self.chars > self.most_chars:
            self.places, self.done, self.chars = _Places(), 0, 0
            return True
        return False

    def of(self, texts: list[str | None], split) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Places of all words, offsets of the texts in them, and the words new to this batch."""
        parts, offsets, get = [], np.zeros(len(texts) + 1, np.int64), self.places.__getitem__
        for i, text in enumerate(texts):
            words = split(text) if text else []
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
            offsets[i + 1] = offsets[i] + len(words)
        new = list(self.places)[self.done :] if len(self.places) > self.done else []
        self.done = len(self.places)
        self.chars += sum(map(len, new))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), offsets, new


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets, empty ranges too."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]
