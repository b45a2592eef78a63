"""The two dictionary coders over streams of blocks: what a key's coder has to remember is its state in the state store.

Blocks of a key (`block` 0, 1, ... and `last`) arrive in any number of triggers, in their order from trigger to trigger. A
symbol is given when no later byte can change it; the unread rest stays in the state until more comes or the last block has
come, after which the key's state is cleared. So the symbols are those of the whole byte string, however it is cut, and
a query that is restarted from its checkpoint goes on where it stopped.

Cases: a null block is an empty one; a last block alone may be empty; a key without a last block keeps its rest; a block that is
missing before one that has come raises, and so does one after the last of the same trigger."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterloom.operators.lz import EOF, FIRST, MIN_REP, MOST, WINDOW, _common

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PairCoder:
    """Pairs of the longest known sequences; each pair joined becomes a sequence until numbers run out. Sequences are the
    nodes of a trie that have a number; node 0 is the root, nodes 1 to 256 are the single bytes."""

    def __init__(self, edges: dict[int, int] | None = None, numbers: dict[int, int] | None = None, number: int = FIRST, opened: bytes = b"", rest: bytes = b"", odd: bool = False):
        """edges: from 256 times a node plus a byte to the node below; numbers: from a node to its sequence's number."""
        self.edges, self.numbers, self.number = edges or {}, numbers or {}, number
        self.opened, self.rest, self.odd = opened, rest, odd
        self.nodes = 257 + len(self.edges)
        #: What the last call of code() has added, in order: nodes are numbered as they are made, and so are sequences.
        self.new_edges: list[int] = []
        self.new_ends: list[int] = []

    def _learn(self, node: int, more: bytes) -> None:
        """Number the sequence that goes on from a node, which is made where it is not there yet."""
        edges = self.edges
        for b in more:
            edge = node << 8 | b
            below = edges.get(edge)
            if below is None:
                below = edges[edge] = self.nodes
                self.new_edges.append(edge)
                self.nodes += 1
            node = below
        self.numbers[node] = self.number
        self.new_ends.append(node)
        self.number += 1

    def code(self, more: bytes, last: bool) -> list[int]:
        """The symbols that are certain now; after the last bytes an odd end is filled with EOF."""
        self.new_edges, self.new_ends = [], []
        data, at, out = self.rest + more, 0, []
        below, numbered, n, odd, begun, first = self.edges.get, self.numbers.get, len(data), self.odd, self.opened, 0
        if odd:
            first = begun[0] + 1
            for b in begun[1:]:
                first = self.edges[first << 8 | b]
        while at < n:
            best = data[at]
            node = longest = best + 1
            i = end = at + 1
            while i < n:
                node = below(node << 8 | data[i])
                if node is None:
                    break
                i += 1
                number = numbered(node)
                if number is not None:
                    best, end, longest = number, i, node
            else:
                if not last:  # bytes that have not come could make it longer
                    break
            out.append(best)
            if not odd:
                begun, first = data[at:end], longest
            elif self.number < EOF:
                self._learn(first, data[at:end])
            odd, at = not odd, end
        self.opened, self.odd, self.rest = begun if odd else b"", odd, data[at:]
        if last and self.odd:
            out.append(EOF)
            self.odd = False
        return out


class Ring:
    """The last bytes of a stream and where beginnings of MIN_REP bytes stand among them, in two generations: when the younger
    has taken in as many places as the window has, the older one is forgotten, so neither grows with the stream."""

    def __init__(self, data: bytes = b"", base: int = 0):
        """data: the bytes from place `base` of the stream on."""
        self.data, self.base = bytearray(data), base
        self.old: dict[bytes, list[int]] = {}
        self.young: dict[bytes, list[int]] = {}
        self.turned = self.indexed = base

    def append(self, more: bytes) -> None:
        self.data += more

    @property
    def end(self) -> int:
        return self.base + len(self.data)

    def slice(self, a: int, b: int) -> bytes:
        return bytes(self.data[a - self.base : b - self.base])

    def _index(self, until: int) -> None:
        """Take in all places before `until` whose beginnings are there."""
        data, base = self.data, self.base
        for p in range(self.indexed, min(until, self.end - MIN_REP + 1)):
            if p - self.turned >= WINDOW:
                self.old, self.young, self.turned = self.young, {}, p
            gram = bytes(data[p - base : p - base + MIN_REP])
            if gram in self.young:
                self.young[gram].append(p)
            else:
                self.young[gram] = [p]
            self.indexed = p + 1

    def match(self, at: int) -> tuple[int, int]:
        """(length, distance back) of the longest copy of what follows `at` that lies wholly before it and within the window,
        the oldest of equals; (0, 0) if none has MIN_REP bytes."""
        room = min(self.end - at, MOST)
        if room < MIN_REP:
            return 0, 0
        self._index(at)
        gram, best, back = self.slice(at, at + MIN_REP), 0, 0
        data, here = self.data, at - self.base
        for generation in (self.old, self.young):
            places = generation.get(gram, ())
            for p in places[bisect_left(places, at - WINDOW) :] if places else ():
                most = min(at - p, room)
                if most <= best:
                    if at - p <= best:  # so are all that follow
                        break
                    continue
                there = p - self.base
                if data[there + best] != data[here + best]:
                    continue
                size = _common(data, there, here, most)
                if size > best and size >= MIN_REP:
                    best, back = size, at - p
                    if best >= room:
                        return best, back
        return best, back

    def find(self, at: int) -> tuple[int, int]:
        """match() without an index, for few places: each search of the window asks for one byte more than the best so far."""
        data, here = self.data, at - self.base
        room, best, back = min(len(data) - here, MOST), 0, 0
        if room < MIN_REP:
            return 0, 0
        place = data.find(data[here : here + MIN_REP], max(0, here - WINDOW), here)
        while place >= 0:
            size = _common(data, place, here, min(here - place, room))
            if size > best:
                best, back = size, here - place
            if best >= room:
                break
            place = data.find(data[here : here + best + 1], place + 1, here)
        return best, back

    def drop(self, until: int) -> None:
        """Forget the bytes before a place; nothing is looked for that far back any more."""
        if until > self.base:
            del self.data[: until - self.base]
            self.base = until


class CopyCoder:
    """Copies from the window and explicit blocks between them. A copy is looked for where an open block has 0, 2, 4, 8, ... bytes,
    so at few places: an index of all would cost more than the searches."""

    def __init__(self, data: bytes = b"", base: int = 0, at: int = 0, start: int = 0):
        self.ring, self.at, self.start = Ring(data, base), at, start

    def code(self, more: bytes, last: bool) -> list[tuple]:
        """("explicit", bytes) and ("back", length, distance) that are certain now: all that begin where the longest copy
        has come whole."""
        ring, out = self.ring, []
        ring.append(more)
        while ring.end - self.at >= MOST or last:
            size, back = ring.find(self.at)
            if size:
                self._explicit(out)
                out.append(("back", size, back))
                self.at = self.start = self.at + size
                continue
            want = max(self.at - self.start, 2)
            took = min(want, MOST - (self.at - self.start), ring.end - self.at)
            self.at += took
            ended = self.at == ring.end and took < want
            if ended or self.at - self.start >= MOST:
                self._explicit(out)
                if self.at == ring.end:
                    break
        ring.drop(min(self.start, self.at - WINDOW))
        return out

    def _explicit(self, out: list) -> None:
        if self.at > self.start:
            out.append(("explicit", self.ring.slice(self.start, self.at)))
        self.start = self.at


def _blocks(rows: Iterator[Row], following: int) -> tuple[bytes, bool, int]:
    """The bytes of a trigger's blocks in their order, whether the last is among them, and the number of the one to come."""
    out, last = [], False
    for r in sorted(rows, key=lambda r: r["block"]):
        if last or r["block"] != following:
            raise ValueError(f"block {r['block']} came where {following} was due")
        out.append(bytes(r["data"] or b""))
        following, last = following + 1, bool(r["last"])
    return b"".join(out), last, following


class PairProcessor(StatefulProcessor):
    """The trie as a list of what each trigger has added to it, the unread rest and the open pair as value state. An entry of a
    map for each edge would be a call of the state store for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.trie = handle.getListState("trie", "edges binary, ends binary")
        self.rest = handle.getValueState("rest", "number int, opened binary, rest binary, odd boolean, block long, written long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.rest.get()
        block, written = (known[4], known[5]) if known else (0, 0)
        data, last, following = _blocks(rows, block)
        coder = PairCoder()
        if known:
            edges, ends = array("q"), array("q")
            for more in self.trie.get():
                edges.frombytes(more[0])
                ends.frombytes(more[1])
            coder = PairCoder(dict(zip(edges, count(257))), dict(zip(ends, count(FIRST))), known[0], bytes(known[1]), bytes(known[2]), known[3])
        symbols = coder.code(data, last)
        if last:
            if known:
                self.trie.clear()
                self.rest.clear()
        else:
            if coder.new_ends:
                self.trie.appendValue((array("q", coder.new_edges).tobytes(), array("q", coder.new_ends).tobytes()))
            self.rest.update((coder.number, coder.opened, coder.rest, coder.odd, following, written + len(symbols)))
        if symbols:
            yield Row(key=key[0], start=written, wire=array("H", symbols).tobytes())

    def close(self) -> None:
        pass


class CopyProcessor(StatefulProcessor):
    """The ring with the open block and the unread rest behind it as value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "ring binary, base long, at long, start long, block long, written long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.ring.get()
        block, written = (known[4], known[5]) if known else (0, 0)
        data, last, following = _blocks(rows, block)
        coder = CopyCoder(bytes(known[0]), known[1], known[2], known[3]) if known else CopyCoder()
        symbols = coder.code(data, last)
        if not last:
            self.ring.update((bytes(coder.ring.data), coder.ring.base, coder.at, coder.start, following, written + len(symbols)))
        elif known:
            self.ring.clear()
        for i, s in enumerate(symbols):
            explicit = s[0] == "explicit"
            yield Row(key=key[0], seq=written + i, explicit=s[1] if explicit else None, size=len(s[1]) if explicit else s[1], back=None if explicit else s[2])

    def close(self) -> None:
        pass


def _stream(blocks: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows = blocks.select(F.col(key).alias("key"), F.col("block").cast("long").alias("block"), "data", "last")
    kind = dict(rows.dtypes)["key"]
    spark = blocks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("key").transformWithState(processor, f"key {kind}, {schema}", "append", "none").withColumnRenamed("key", key)


def stream_pair_bytes(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, wire: the pair coder's symbols as they become certain, two bytes each (little-endian), with the place of the
    first of them.

    blocks: a stream of key, block, data and last. The state store is RocksDB, which the session is set to."""
    return _stream(blocks, key, PairProcessor(), "start long, wire binary")


def stream_pairs(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, symbols: the same as numbers."""
    byte = lambda i: F.conv(F.hex(F.substring("wire", i, 1)), 16, 10).cast("int")
    each = F.sequence(F.lit(1), F.octet_length("wire") - 1, F.lit(2))
    symbols = F.transform(each, lambda i: byte(i) + 256 * byte(i + 1))
    return stream_pair_bytes(blocks, key).select(key, "start", symbols.alias("symbols"))


def stream_copies(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seq, explicit (null for a copy), size, back (null for an explicit block): the look-back coder's symbols."""
    return _stream(blocks, key, CopyProcessor(), "seq long, explicit binary, size int, back int")


def in_blocks(data: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """key, block, data, last of byte strings (column `data`) in blocks of `size` bytes; an empty one is one empty block."""
    n = F.greatest(F.ceil(F.octet_length("data") / F.lit(size)), F.lit(1)).cast("int")
    each = data.select(key, F.col("data").alias("_d"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return each.select(key, F.col("block").cast("long").alias("block"), F.expr(f"substring(_d, block * {size} + 1, {size})").alias("data"), (F.col("block") == F.col("_n") - 1).alias("last"))


def matches(data: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, size, back: of every place of byte strings (column `data`) the longest copy before it, where there is one."""
    import pyarrow as pa

    kind = dict(data.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x in zip(batch.column(0), batch.column(1), strict=True):
                whole = x.as_buffer().to_pybytes() if x.is_valid else b""
                ring, found = Ring(whole), []
                for at in range(len(whole)):
                    size, back = ring.match(at)
                    if size:
                        found.append((at, size, back))
                if found:
                    pos, sizes, backs = zip(*found, strict=True)
                    yield pa.record_batch([pa.repeat(name, len(found)), pa.array(pos, pa.int64()), pa.array(sizes, pa.int64()), pa.array(backs, pa.int64())], [key, "pos", "size", "back"])

    return data.select(key, "data").mapInArrow(run, f"{key} {kind}, pos long, size long, back long")
