"""Removal of repeated strings of WINDOW bytes, by a sparse suffix array that sampled splitters deal into buckets.

Not all suffixes are sorted but those at anchors: in each window the KGRAM bytes of least hash name its anchor, so equal
windows have equal anchors, and about one position in forty is one. A suffix's leading tokens are the 64-bit name of
its first KGRAM bytes and that of the whole context of its windows. Splitters sampled from the tokens range-partition
the suffixes; each bucket is sorted by multikey quicksort and neighbours are compared. Of equal contexts the first in
(document, position) stays and the rest are removed whole. Where one first token has several contexts, windows may
agree in part. Up to FEW contexts meet by their token, bytes and all, and their windows are compared there. The windows
of a token with more contexts, or of one that touches a bucket's boundary and so may go on beyond it, are dealt one by
one in the same way, with the window's name as token, so that no token gathers in one task.

A batch hands on only the first of equal suffixes, so a passage that a third of all documents hold reaches the buckets
once a batch; splitters go on by document and place, so what is still many rows is several buckets, each of which hands
on its first. That holds for single windows too: a bucket says which windows its edges share with others, at most two, and
those that an earlier bucket has go as well. Buckets are as many as their rows and bytes need. Names are pairs of 64-bit hashes of bytes (a suffix by its first
bytes and by its whole context, a window by two independent tables); no text is moved but to where its own removals are.

Cases: null is the empty text; a row without an id has no place in the order, so it loses nothing and removes
nothing; texts under WINDOW bytes have no window; a text that repeats itself loses all but the first; repeated rows of one
id are one text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, keep, pieces

WINDOW, KGRAM = 100, 24
SPAN = WINDOW - KGRAM + 1
#: Contexts of one first token that are compared in one place.
FEW = 64
#: Bytes in hand at once; each takes some eighty more while it is hashed.
BATCH = 3 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
#: Rows of a bucket, 40 bytes each and as much again while they are sorted.
BUCKET = 1 << 20
#: Bytes of contexts that meet by their token in one task; a token has at most FEW of them.
NARROWED = 64 << 20
#: Rows of a partition whose lists are hashed; above this Spark sorts them.
HASHED = 1 << 22
#: Two tokens, a document, a range of its windows (first << 8 | further ones), and what is known: 0 nothing, 1 removed, 2 may
#: agree in part with others of its first token, which is 0 if its windows have to be looked at one by one.
SUFFIX = "t long, c long, doc long, r long, kind int"
CONTEXT = f"{SUFFIX}, bytes binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bytes:
    """The bytes of some texts end to end, and names of any of their substrings."""

    def __init__(self, texts: list[bytes], table: int = 0):
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        power = np.full(len(data), BASE, np.uint64)
        power[:1] = 1
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[table][data] * np.cumprod(power), out=self.sums[1:])
        power[1:] = BACK
        self.back = np.cumprod(power)

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, anchor, first window, last window) for each run of windows with one anchor; places are absolute."""
        n = len(self.sums) - 1
        none = np.zeros(0, np.int64)
        if n < WINDOW:
            return none, none, none, none
        at = np.arange(n - KGRAM + 1)
        x = self.names(at, at + KGRAM) >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
        width = 1
        while 2 * width <= SPAN:
            x = np.minimum(x[:-width], x[width:])
            width *= 2
        x = np.minimum(x[: len(x) - (SPAN - width)], x[SPAN - width :])
        text = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)[: len(x)]
        good = np.arange(len(x)) + WINDOW <= self.ends[text]
        windows = np.flatnonzero(good)
        if not len(windows):
            return none, none, none, none
        where = (x[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[windows][1:] != text[windows][:-1])]))
        last = np.append(new[1:], len(windows)) - 1
        return text[windows[new]], where[new], windows[new], windows[last]


def multikey_order(columns: list[np.ndarray], few: int = 4096) -> np.ndarray:
    """The order of rows by their columns in turn: parts of one column are split in three around a pivot, and what
    equals the pivot goes on with the next column; parts of few rows are finished directly."""
    order = np.arange(len(columns[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == len(columns):
            continue
        rows = order[lo:hi]
        if hi - lo <= few:
            order[lo:hi] = rows[np.lexsort([c[rows] for c in columns[depth:][::-1]])]
            continue
        key = columns[depth][rows]
        pivot = np.partition(key[:: max(1, len(key) // 99)], len(key[:: max(1, len(key) // 99)]) // 2)[len(key[:: max(1, len(key) // 99)]) // 2]
        less, same = key < pivot, key == pivot
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([rows[less], rows[same], rows[~(less | same)]])
        stack += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


def _rows(t, c, doc, r, kind) -> pa.RecordBatch:
    if kind == 1:
        t = c = np.zeros(len(doc), np.int64)
    return pa.record_batch([*(pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False)) for x in (t, c, doc, r)), pa.array(np.full(len(doc), kind, np.int32))], [x.split()[0] for x in SUFFIX.split(", ")])


def _firsts(t, c, doc, r) -> tuple[tuple, pa.RecordBatch]:
    """Of equal (t, c) the first by (doc, place), as columns; the others as removed rows."""
    order = multikey_order([t, c, doc, r])
    t, c, doc, r = t[order], c[order], doc[order], r[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]) if len(t) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(t) else np.zeros(0, np.int64)
    gone = (doc != doc[first]) | (r != r[first])
    return (t[new], c[new], doc[new], r[new]), _rows(t[gone], c[gone], doc[gone], r[gone], 1)


def _ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and ranges of single windows, consecutive ones in one range of up to 200."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if len(doc) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    nth = np.arange(len(doc)) - (start[np.cumsum(new) - 1] if len(doc) else 0)
    head = np.flatnonzero(nth % 200 == 0)
    size = np.diff(np.append(head, len(doc)))
    return doc[head], at[head] << 8 | size - 1


def _each(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... for n places, of each pair in turn."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _data(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t.encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH):
        x = Bytes(_data(batch))
        text, at, lo, hi = x.anchors()
        doc = batch.column(0).to_numpy()[text]
        context = mix(x.names(lo, hi + WINDOW) + (at - lo).astype(np.uint64) * BASE)
        first, gone = _firsts(x.names(at, at + KGRAM).astype(np.int64), context.astype(np.int64), doc, lo - x.starts[text] << 8 | hi - lo)
        yield from (_rows(*first, 0), gone)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: what is removed (1), and the first suffixes of tokens with several contexts (2)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    columns = [np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(4)]
    del got
    first, gone = _firsts(*columns)
    if gone.num_rows:
        yield gone
    t = first[0]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    size = np.diff(np.append(np.flatnonzero(new), len(t)))[np.cumsum(new) - 1]
    edge = (t == t[0]) | (t == t[-1])
    several = (size > 1) | edge
    token = np.where(edge | (size > FEW), 0, t)
    yield _rows(*(x[several] for x in (token, *first[1:])), 2)


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket of single windows: what is removed (1), and the first of those that its edges share with others (3). A
    window of any number of rows may fill many buckets, each of which has at most two rows left of it."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    first, gone = _firsts(*(np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(4)))
    if gone.num_rows:
        yield gone
    t, c = first[:2]
    edge = ((t == t[0]) & (c == c[0])) | ((t == t[-1]) & (c == c[-1]))
    yield _rows(*(x[edge] for x in first), 3)


def _with_bytes(rows: pa.RecordBatch, data: list[bytes] | None = None) -> pa.RecordBatch:
    column = pa.nulls(rows.num_rows, pa.binary()) if data is None else pa.array(data, pa.binary())
    return pa.record_batch([*rows.columns, column], [*rows.schema.names, "bytes"])


def _window_names(texts: list[bytes], places) -> list[np.ndarray]:
    """Two independent names of the windows that begin at places, a function of Bytes."""
    out = []
    for table in (0, 1):
        x = Bytes(texts, table)
        at = places(x)
        out.append(x.names(at, at + WINDOW).astype(np.int64))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the ranges in `marked` that have a token; single windows, each by its name, of those that have none."""
    for batch in pieces(batches, "text", BATCH):
        texts, marked, docs = _data(batch), batch.column(2), batch.column(0).to_numpy()
        size = np.array(marked.value_lengths().fill_null(0))
        text = np.repeat(np.arange(len(size)), size)
        packed, token = (marked.flatten().field(k).to_numpy() for k in ("r", "t"))
        lo, n = packed >> 8, (packed & 255) + 1
        few = token != 0
        ranges = zip(text[few].tolist(), lo[few].tolist(), (lo + n)[few].tolist(), strict=True)
        yield _with_bytes(_rows(token[few], token[few], docs[text[few]], packed[few], 2), [texts[i][a : b + WINDOW - 1] for i, a, b in ranges])
        lo, n, text = lo[~few], n[~few], text[~few]
        if not len(lo):
            continue
        at, text = _each(lo, n), np.repeat(text, n)
        first, gone = _firsts(*_window_names(texts, lambda x: at + x.starts[text]), docs[text], at << 8)
        doc, r = _ranges(gone.column(2).to_numpy(), gone.column(3).to_numpy() >> 8)
        yield _with_bytes(_rows(*first, 0))
        yield _with_bytes(_rows(r, r, doc, r, 1))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows removed among the contexts of a token; all contexts of a token are in one partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t, doc, r = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
    data = pa.chunked_array([b.column(3) for b in got])
    order = np.argsort(t, kind="stable")
    size = np.cumsum((r[order] & 255) + WINDOW)
    ends = np.append(np.flatnonzero(t[order][1:] != t[order][:-1]) + 1, len(t))
    lo = 0
    while lo < len(t):
        fits = ends[(ends > lo) & (size[ends - 1] - (size[lo - 1] if lo else 0) <= BATCH)]
        hi = int(fits[-1]) if len(fits) else int(ends[ends > lo][0])
        rows = order[lo:hi]
        n = (r[rows] & 255) + 1
        at, docs = _each(r[rows] >> 8, n), np.repeat(doc[rows], n)
        _, gone = _firsts(*_window_names(data.take(pa.array(rows)).to_pylist(), lambda x, n=n: _each(x.starts, n)), docs, at)
        d, ranges = _ranges(gone.column(2).to_numpy(), gone.column(3).to_numpy())
        yield _rows(ranges, ranges, d, ranges, 1)
        lo = hi


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH):
        rows = []
        for doc, data, ranges in zip(batch.column(0).to_pylist(), _data(batch), batch.column(2), strict=True):
            packed = ranges.values.to_numpy() if ranges.is_valid else np.zeros(0, np.int64)
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, packed >> 8, 1)
            np.add.at(edge, (packed >> 8) + (packed & 255) + WINDOW, -1)
            gone = np.cumsum(edge)[:-1] > 0
            spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
            rows.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _by_text(rows: DataFrame, name: str, what: Column, texts: int, count: int) -> DataFrame:
    """Lists by document. Where they are small by partition, they are the hashed side of the join, so that texts are neither
    sorted nor spilled; else Spark sorts both sides, which can spill. texts: partitions; count: rows."""
    lists = rows.groupBy("doc").agg(F.collect_list(what).alias(name)).withColumnRenamed("doc", "doc_id")
    return lists.hint("shuffle_hash") if count // max(texts, 1) <= HASHED else lists


def _dealt(suffixes: DataFrame, rows: int, compare) -> DataFrame:
    """Suffixes dealt by sampled splitters, sorted and compared."""
    n = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET))
    return suffixes.filter("kind = 0").select("t", "c", "doc", "r").repartitionByRange(n, "t", "c", "doc", "r").mapInArrow(compare, SUFFIX)


def _across(edges: DataFrame) -> DataFrame:
    """Of windows at the edges of buckets those that another bucket has an earlier one of, as removed."""
    least = F.min(F.struct("doc", "r")).over(Window.partitionBy("t", "c"))
    later = edges.select("t", "c", "doc", "r", least.alias("m")).filter("doc != m.doc OR r != m.r")
    return later.select(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("c"), "doc", "r", F.lit(1).alias("kind"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    left = F.count_if(F.col("kind") == 0)
    suffixes = keep(docs.filter("doc_id IS NOT NULL").mapInArrow(_suffixes, SUFFIX), rows=left)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a token at a bucket's edge is looked at again below, so rows of one token may be in several buckets
    compared = keep(_dealt(suffixes, suffixes.seen["rows"] or 0, _compare).unionAll(suffixes.filter("kind = 1")), rows=F.count_if(F.col("kind") == 2))
    discard(suffixes)
    marked = docs.join(_by_text(compared.filter("kind = 2"), "marked", F.struct("r", "t"), parts, compared.seen["rows"] or 0), "doc_id").select("doc_id", "text", "marked")
    windows = keep(marked.mapInArrow(_windows, CONTEXT), rows=left, size=F.sum(F.octet_length("bytes")))
    n = max(parts, -(-(windows.seen["size"] or 0) // NARROWED))
    narrowed = windows.filter("kind = 2").select("t", "doc", "r", "bytes").repartition(n, "t").mapInArrow(_narrow, SUFFIX)
    single = keep(_dealt(windows, windows.seen["rows"] or 0, _compare_windows))
    found = compared.unionAll(narrowed).unionAll(single).unionAll(_across(single.filter("kind = 3"))).unionAll(windows.drop("bytes"))
    gone = keep(found.filter("kind = 1").select("doc", "r"), rows=F.count(F.lit(1)))
    discard(compared, windows, single)
    done = docs.join(_by_text(gone, "gone", F.col("r"), parts, gone.seen["rows"] or 0), "doc_id", "left").select("doc_id", "text", "gone")
    return done.mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
