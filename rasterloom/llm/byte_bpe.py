"""Byte-level BPE encoding and decoding by prefix dynamic programming over a public rank file.

A text is cut by the public pattern; each match is a byte string of its own. Of every prefix of such a string exactly one
token can be the last of its encoding, so that token is all that is stored of the prefix. It is found from the tokens that
end there: one is right if it stands alone or if it may follow the stored last token of the prefix before it. Two tokens
may stand side by side unless merging by rank would join bytes across their border first. That is told by the parts that
touch the border while each token is being made: a part is there until the merge that takes it up. An append
only adds prefixes, and after an edit the stored tokens change until as many as the longest token agree again.

Cases: a null text is an empty one and has no token; an empty table gives no rows; repeated rows give a row each; texts of
any length and words of any length are read whole, in portions that bound a worker's memory; other columns are not read.
Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pieces, texts_of
from rasterloom.llm.vocab import Words

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Verdicts on pairs of tokens that a process keeps before it begins anew.
PAIRS = 1 << 19
_NEVER = 1 << 62


class Merges:
    """Tokens and ranks, with the parts of each token that touch its ends while it is being made."""

    def __init__(self, contents: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, contents.splitlines()) if a}
        if sum(len(t) == 1 for t in self.rank) != 256:
            raise ValueError("every byte must be a token")
        self.token = {r: t for t, r in self.rank.items()}
        #: By token: (part at its right or left end, rank of the merge that takes the part up).
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        for r, t in sorted(self.token.items(), key=lambda x: (len(x[1]) > 1, x[0])):
            if len(t) == 1:
                self.right[r] = self.left[r] = ((t, _NEVER),)
                continue
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut], -1), self.rank.get(t[cut:], -1)
                if a in self.right and b in self.left and not self.crossed(a, b, r):
                    self.left[r] = ((t, _NEVER), (t[:cut], r), *self.left[a][1:])
                    self.right[r] = ((t, _NEVER), (t[cut:], r), *self.right[b][1:])
                    break  # no other cut holds: the merges below this rank leave one pair
        self._automaton()
        self.longest = max(map(len, self.rank))
        self.n_told = 0
        most = max(self.token) + 1
        self.lengths = np.zeros(most, np.int64)
        for r, t in self.token.items():
            self.lengths[r] = len(t)
        self.size = self.lengths.tolist()
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(most)), np.uint8)

    def _automaton(self) -> None:
        """Of the bytes read so far, the longest end that begins a token is a node; `ends` has the tokens that end there,
        longest first, each with its length and the verdicts on what it may follow. A token that no merge makes is left out: it is met only where a whole match is one."""
        self.child: dict[int, int] = {}
        self.fail, own, parents = [0], {}, []
        for r in self.right:
            node = 0
            for byte in self.token[r]:
                below = self.child.get(node << 8 | byte)
                if below is None:
                    below = self.child[node << 8 | byte] = len(self.fail)
                    self.fail.append(0)
                    parents.append((node, byte))
                node = below
            own[node] = r
        depth = [0]
        for node, _ in parents:
            depth.append(depth[node] + 1)
        self.told: dict[int, dict[int, bool]] = {r: {} for r in self.right}
        self.ends: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()] * len(self.fail)
        for node in sorted(range(1, len(self.fail)), key=depth.__getitem__):
            above, byte = parents[node - 1]
            if above:
                self.fail[node] = self.step(self.fail[above], byte)
            shorter = self.ends[self.fail[node]]
            self.ends[node] = ((own[node], depth[node], self.told[own[node]]), *shorter) if node in own else shorter

    def step(self, node: int, byte: int) -> int:
        child, fail = self.child, self.fail
        while (below := child.get(node << 8 | byte)) is None:
            node = fail[node]
        return below

    def crossed(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether a merge of a rank below `before` joins bytes of token a with bytes of token b that follows it."""
        get = self.rank.get
        for u, until_u in self.right[a]:
            for w, until_w in self.left[b]:
                # of merges of one rank the left one comes first
                m = get(u + w)
                if m is not None and m < before and m < until_u and m <= until_w:
                    return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; the verdict is kept."""
        if self.n_told >= PAIRS:
            self.n_told = 0
            for verdicts in self.told.values():
                verdicts.clear()
        self.n_told += 1
        out = self.told[b][a] = not self.crossed(a, b)
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin and the last one's end."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], sizes)
        return self.flat[gather], ends


class Prefixes:
    """A byte string, the last token of each of its prefixes, and the automaton's node there."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data, self.last, self.nodes = merges, b"", [], []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; no stored token changes."""
        m, last, nodes = self.merges, self.last, self.nodes
        child, fail, ends = m.child, m.fail, m.ends
        j, node = len(last), nodes[-1] if nodes else 0
        self.data += more
        for byte in more:
            while (below := child.get(node << 8 | byte)) is None:
                node = fail[node]
            node = below
            j += 1
            for t, n, told in ends[node]:
                if n == j:
                    break
                a = last[j - n - 1]
                ok = told.get(a)
                if ok or ok is None and m.follows(a, t):
                    break
            last.append(t)
            nodes.append(node)

    def cut(self, at: int) -> None:
        """Keep so many bytes; what is stored of them stays right."""
        self.data = self.data[:at]
        del self.last[at:], self.nodes[at:]

    def replace(self, at: int, removed: int, inserted: bytes) -> int:
        """Put bytes in the place of others and return how many prefixes were looked at again: those within the inserted
        bytes, and those after them until as many as the longest token have the last tokens that they had, each of which
        begins after the edit."""
        last, nodes, tail = self.last[at + removed :], self.nodes[at + removed :], self.data[at + removed :]
        self.cut(at)
        self.append(inserted)
        same = k = 0
        while k < len(tail) and same < self.merges.longest:
            self.append(tail[k : k + 1])
            same = same + 1 if last[k] == self.last[-1] and self.merges.size[last[k]] <= k else 0
            k += 1
        self.data += tail[k:]
        self.last.extend(last[k:])
        self.nodes.extend(nodes[k:])
        return len(inserted) + k

    def tokens(self) -> list[int]:
        whole = self.merges.rank.get(self.data)
        if whole is not None:
            return [whole]
        out, j, size, last = [], len(self.data), self.merges.size, self.last
        while j:
            t = last[j - 1]
            out.append(t)
            j -= size[t]
        return out[::-1]


def shared(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        low, n = (mid, n) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Encoder:
    """Ids of distinct matches in one array, from which texts gather theirs."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.split, self.words = merges, regex.compile(pattern).findall, Words(600_000, 12 << 20)
        self.clear()

    def clear(self) -> None:
        self.values, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def paths(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word. Words are taken in their order, so what is stored of a prefix serves all that begin with it."""
        out: list[list[int]] = [[]] * len(words)
        p = Prefixes(self.merges)
        for i in sorted(range(len(words)), key=words.__getitem__):
            if words[i] in self.merges.rank:
                out[i] = [self.merges.rank[words[i]]]
                continue
            n = shared(p.data, words[i])
            p.cut(n)
            p.append(words[i][n:])
            out[i] = p.tokens()
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and offsets of the texts in them."""
        if self.words.begin():
            self.clear()
        places, offsets, new = self.words.of(texts, self.split)
        if new:
            found = self.paths([w.encode() for w in new])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.values = np.concatenate([self.values, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
        sizes = self.sizes[places]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.arange(ends[-1]) + np.repeat(self.starts[places] - ends[:-1], sizes)
        return self.values[gather], ends[offsets]

    def edited(self, text: str, ids: np.ndarray, at: int, removed: int, inserted: str) -> tuple[str, np.ndarray, int]:
        """(text, ids, characters encoded) after characters at `at` give way to others, from the ids before.

        A match never reaches from a character that is no space over a space behind it, whatever stands elsewhere. So the
        encoding changes at most between the last such place before the edit and the first behind it."""
        if not 0 <= at <= at + removed <= len(text):
            raise ValueError(f"no {removed} characters at {at} in a text of {len(text)}")
        new = text[:at] + inserted + text[at + removed :]
        a = at - 1
        while a > 0 and not (text[a].isspace() and not text[a - 1].isspace()):
            a -= 1
        a = max(a, 0)
        b = at + removed + 1
        while b < len(text) and not (text[b].isspace() and not text[b - 1].isspace()):
            b += 1
        b = min(b, len(text))
        ends = np.concatenate([[0], np.cumsum(self.merges.lengths[ids])])
        i, k = np.searchsorted(ends, [len(text[:a].encode()), len(text[:b].encode())])
        region = new[a : b + len(new) - len(text)]
        return new, np.concatenate([ids[:i], self.encode([region])[0], ids[k:]]).astype(np.int32), len(region)


_encoders: dict[tuple, Encoder] = {}


def encoder_of(contents: bytes, pattern: str = PATTERN) -> Encoder:
    """The encoder of these contents, built once in a process."""
    key = hash(contents), pattern
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Merges(contents), pattern)
    return _encoders[key]


def load(path: str = RANKS_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


KINDS = {"ids": "array<int>", "packed": "binary", "decoded": "binary"}


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS_PATH, pattern: str = PATTERN, out: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, n_tokens long and the columns of `out`: ids array<int>, packed (the ids as little-endian unsigned 32-bit
    integers), decoded (the bytes that the ids stand for). The rank file is read on the driver and broadcast (under one
    megabyte, whatever the data)."""
    model = docs.sparkSession.sparkContext.broadcast(load(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(model.value, pattern)
        for batch in pieces(batches, "text"):
            ids, ends = e.encode(texts_of(batch, "text"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(ends))}
            if "ids" in out:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
            if "packed" in out:
                columns["packed"] = _slices(ids.astype("<u4").view(np.uint8), ends * 4)
            if "decoded" in out:
                data, at = e.merges.decode(ids)
                columns["decoded"] = _slices(data, at[ends])
            yield pa.record_batch([columns[c] for c in ["doc_id", "n_tokens", *out]], ["doc_id", "n_tokens", *out])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long" + "".join(f", {c} {KINDS[c]}" for c in out))


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", ranks_path: str = RANKS_PATH) -> DataFrame:
    """encoded with a binary column made from its ids; null ids give null, an id that is no token raises."""
    model = encoded.sparkSession.sparkContext.broadcast(load(ranks_path))

    @F.pandas_udf("binary")
    def data(series):  # noqa: ANN001, ANN202
        token = encoder_of(model.value).merges.token
        return series.map(lambda x: None if x is None else b"".join(map(token.__getitem__, x)))

    return encoded.withColumn(out, data(F.col(ids)))


def apply_edits(docs: DataFrame, ranks_path: str = RANKS_PATH, pattern: str = PATTERN) -> DataFrame:
    """doc_id, text, ids and n_encoded (characters that were encoded again) after one edit a row, from rows of doc_id, text,
    ids, at, removed and inserted, in characters. A null text, list, place or insertion is empty or zero. A place
    outside the text raises."""
    model = docs.sparkSession.sparkContext.broadcast(load(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(model.value, pattern)
        for batch in pieces(batches, "text"):
            rows = [e.edited(r["text"] or "", np.array(r["ids"] or [], np.int32), r["at"] or 0, r["removed"] or 0, r["inserted"] or "") for r in batch.to_pylist()]
            texts, ids, n = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0), pa.array(texts), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(n, pa.int64())], ["doc_id", "text", "ids", "n_encoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("ids").cast("array<int>").alias("ids"), F.col("at").cast("long").alias("at"), F.col("removed").cast("long").alias("removed"), "inserted")
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>, n_encoded long")


def op12(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(docs, out=("packed", "decoded"))
    return both.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
