"""Huffman coding of histograms: lengths and codes by symbol, sizes, bits, and back.

A tree is made from a histogram, never from the pixels, so the work in Python is over distinct symbols."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(counts: dict) -> object:
    """Nested pairs with symbols at the leaves: the two lightest join until one is left. Ties go to the lower symbol,
    then to the node made first, so equal histograms make equal trees."""
    heap = [(n, i, s) for i, (s, n) in enumerate(sorted(counts.items()))]
    if not heap:
        raise ValueError("no symbol to code")
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, Branch(a[2], b[2])))
        made += 1
    return heap[0][2]


class Branch(tuple):
    """A node: left (bit 0) and right (bit 1)."""

    def __new__(cls, left, right):
        return super().__new__(cls, (left, right))


def codes(root: object) -> dict:
    """Symbol to bit string; a single symbol has the empty code."""
    out, stack = {}, [(root, "")]
    while stack:
        node, code = stack.pop()
        if isinstance(node, Branch):
            stack += [(node[1], code + "1"), (node[0], code + "0")]
        else:
            out[node] = code
    return out


def dump(root: object, symbol) -> bytes:
    """Pre-order: 0 and the symbol for a leaf, 1 and both sides for a branch."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Branch):
            out.append(b"\x01")
            stack += [node[1], node[0]]
        else:
            out.append(b"\x00" + symbol(node))
    return b"".join(out)


def parse(data: bytes, at: int, size: int, symbol) -> tuple[object, int]:
    """The tree that begins at `at`, and where it ends; an unknown tag raises."""
    open_: list[list] = []
    while True:
        tag = data[at]
        at += 1
        if tag == 1:
            open_.append([])
            continue
        if tag != 0:
            raise ValueError(f"unknown tag {tag}")
        node = symbol(data[at : at + size])
        at += size
        while open_:
            open_[-1].append(node)
            if len(open_[-1]) < 2:
                break
            node = Branch(*open_.pop())
        else:
            return node, at


def packed(bits: str) -> bytes:
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes() if bits else b""


class Table:
    """Codes from left to right as 64-bit numbers, filled up with zeros: the code that bits begin with is the last one that
    is not above their first 64."""

    def __init__(self, root: object):
        self.symbols, starts, sizes = [], [], []
        stack = [(root, 0, 0)]
        while stack:
            node, code, size = stack.pop()
            if isinstance(node, Branch):
                if size == 64:
                    raise ValueError("a code of more than 64 bits")
                stack += [(node[1], code << 1 | 1, size + 1), (node[0], code << 1, size + 1)]
            else:
                self.symbols.append(node)
                starts.append(code << (64 - size) & ((1 << 64) - 1))
                sizes.append(size)
        self.starts, self.sizes = np.array(starts, np.uint64), np.array(sizes, np.int64)

    @classmethod
    def of(cls, starts: list[int], sizes: list[int]) -> Table:
        """The table of codes that are read from left to right."""
        out = cls.__new__(cls)
        out.starts, out.sizes = np.array(starts, np.uint64), np.array(sizes, np.int64)
        return out

    def decode(self, data: bytes, n: int) -> np.ndarray:
        """Places among the codes, which are those in `symbols`, of n symbols. The code at every bit of a stretch is looked up at once; what is left to do one
        symbol after another is a step from each to the next."""
        if not self.sizes.any():
            return np.zeros(n, np.int64)
        out = np.empty(n, np.int64)
        raw, done, at = np.frombuffer(data + bytes(9), np.uint8), 0, 0
        while done < n:
            first = at >> 3
            stretch = raw[first : first + STRETCH + 9].astype(np.uint64)
            here = len(stretch) - 9
            if here <= 0:
                raise ValueError("bits end before the last symbol")
            whole = np.zeros(here, np.uint64)
            for k in range(8):
                whole = whole << np.uint64(8) | stretch[k : k + here]
            bit = np.arange(8, dtype=np.uint64)
            window = (whole[:, None] << bit) | (stretch[8 : 8 + here, None] >> (np.uint64(8) - bit))
            found = np.searchsorted(self.starts, window.ravel(), "right") - 1
            steps, p, end = self.sizes[found].tolist(), at - 8 * first, 8 * here
            places = []
            while p < end and done + len(places) < n:
                places.append(p)
                p += steps[p]
            out[done : done + len(places)] = found[places]
            done, at = done + len(places), p + 8 * first
        if at > 8 * len(data):
            raise ValueError("bits end before the last symbol")
        return out


#: Bytes of which the codes are looked up at once.
STRETCH = 1 << 16


#: Symbols on the wire, by the name of their kind: (bytes, writer, reader).
RGB = (11, lambda s: struct.pack("<Q3B", 3, *s), lambda b: struct.unpack("<Q3B", b)[1:])
SIGNED = (6, lambda s: struct.pack("<3h", *s), lambda b: struct.unpack("<3h", b))


def encode_all(symbols: list, kind) -> bytes:
    """Tree, then the codes of all symbols in order, zero-padded to a byte."""
    return encode_array(np.array(symbols, np.int64).reshape(len(symbols), -1), kind)


def encode_array(rows: np.ndarray, kind) -> bytes:
    """The same for symbols of three numbers as rows of an array.

    Leaves by weight and joined nodes in the order of their making are two queues: the lightest node is at the head of one,
    and of equals the leaf comes first, which is the order of tree()."""
    if not len(rows):
        raise ValueError("no symbol to code")
    named, inverse, counts = np.unique((rows[:, 0] + 32768) << 32 | (rows[:, 1] + 32768) << 16 | rows[:, 2] + 32768, return_inverse=True, return_counts=True)
    n = len(named)
    leaves = np.argsort(counts, kind="stable")
    light, queue = [*counts[leaves].tolist(), 1 << 62, 1 << 62], leaves.tolist()
    joined, pairs, i, j = [], [], 0, 0
    for _ in range(n - 1):
        pair, weight = [], 0
        for _ in (0, 1):
            if j < len(joined) and joined[j] < light[i]:
                pair.append(n + j)
                weight += joined[j]
                j += 1
            else:
                pair.append(queue[i])
                weight += light[i]
                i += 1
        pairs.append(pair)
        joined.append(weight)
    symbols = zip(*((named >> s & 65535) - 32768 for s in (32, 16, 0)), strict=True)
    wire, words, out, stack = [b"\x00" + kind[1](v) for v in symbols], np.empty(n, object), [], [(2 * n - 2, "")]
    while stack:
        node, code = stack.pop()
        if node < n:
            words[node] = code
            out.append(wire[node])
        else:
            left, right = pairs[node - n]
            out.append(b"\x01")
            stack += ((right, code + "1"), (left, code + "0"))
    return b"".join(out) + packed("".join(words[inverse]))


def decode_all(data: bytes, at: int, n: int, kind) -> list:
    return [tuple(s) for s in decode_array(data, at, n, kind).tolist()]


def decode_array(data: bytes, at: int, n: int, kind) -> np.ndarray:
    """n symbols of numbers as rows of an array, by a tree that is read leaf by leaf from left to right."""
    size, read, leaves, starts, sizes, open_ = kind[0], kind[2], [], [], [], [(0, 0)]
    while open_:
        code, depth = open_.pop()
        tag = data[at]
        at += 1
        if tag == 1:
            if depth == 64:
                raise ValueError("a code of more than 64 bits")
            open_ += ((code | 1 << (63 - depth), depth + 1), (code, depth + 1))
        elif tag == 0:
            leaves.append(read(data[at : at + size]))
            starts.append(code)
            sizes.append(depth)
            at += size
        else:
            raise ValueError(f"unknown tag {tag}")
    return np.array(leaves, np.int64)[Table.of(starts, sizes).decode(data[at:], n)]


def codebook(histogram: DataFrame, symbol: list[str], key: str = "img_id", count: str = "cnt") -> DataFrame:
    """key, symbol columns, cnt, code, len."""
    kinds = dict(histogram.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [key, *symbol, count]) + ", code string, len int"

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[symbol].itertuples(index=False, name=None))
        book = codes(tree(dict(zip(rows, pdf[count].tolist(), strict=True))))
        code = [book[s] for s in rows]
        return pdf[[key, *symbol, count]].assign(code=code, len=[len(c) for c in code])

    return histogram.groupBy(key).applyInPandas(make, schema)


def byte_sizes(data: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, payload_bits, size, kraft of byte strings (column `data`): histogram and tree of each in one pass.

    An empty string has no tree: no symbol, no bits, and the size of the header alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256)
                there = np.flatnonzero(counts)
                n = len(there)
                length = {s: len(c) for s, c in codes(tree({int(s): int(counts[s]) for s in there})).items()} if n else {}
                bits = sum(int(counts[s]) * k for s, k in length.items())
                rows.append((i, n, bits, 8 + 3 * n - (n > 0) + -(-bits // 8), sum((2.0**-k for k in length.values()), 0.0)))
            if rows:
                types = [batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)], [key, "n", "payload_bits", "size", "kraft"])

    kind = dict(data.dtypes)[key]
    return data.select(key, "data").mapInArrow(run, f"{key} {kind}, n long, payload_bits long, size long, kraft double")


def sizes(book: DataFrame, symbol_bytes: int, key: str = "img_id") -> DataFrame:
    """key, n (distinct symbols), payload_bits, size: header of the image, tree and payload in bytes."""
    n, bits = F.count("*"), F.sum(F.col("cnt") * F.col("len"))
    size = F.lit(8) + n * (1 + symbol_bytes) + n - 1 + F.ceil(bits / 8)
    return book.groupBy(key).agg(n.alias("n"), bits.alias("payload_bits"), size.cast("long").alias("size"))
