"""Two dictionary coders over bytes: pairs into a growing dictionary, and look-back copies."""

from __future__ import annotations

import struct
from array import array
from bisect import bisect_left

import numpy as np

EOF, FIRST = 0xFFFF, 0x100
MIN_REP, WINDOW, MOST = 6, 65535, 32767


def dict_symbols(data: bytes) -> list[int]:
    """Symbols in pairs: each is the longest sequence in the dictionary, and each pair joined becomes a new entry until
    numbers run out. An odd end is filled with EOF."""
    child: dict[tuple[int, int], int] = {}
    code = [0, *range(256)]  # node 0 is the root, 1..256 the single bytes
    for b in range(256):
        child[0, b] = b + 1
    nodes, number, at, n = 257, FIRST, 0, len(data)
    out: list[int] = []
    started = 0
    while at < n:
        begin = at
        node, best, end, i = 0, -1, at, at
        while i < n:
            node = child.get((node, data[i]), -1)
            if node < 0:
                break
            i += 1
            if code[node] >= 0:
                best, end = code[node], i
        out.append(best)
        at = end
        if len(out) % 2:
            started = begin
        elif number < EOF:
            node = 0
            for b in data[started:at]:
                k = child.get((node, b))
                if k is None:
                    k = child[node, b] = nodes
                    code.append(-1)
                    nodes += 1
                node = k
            code[node] = number
            number += 1
    return out + [EOF] * (len(out) % 2)


def dict_decode(symbols: list[int]) -> bytes:
    if len(symbols) % 2:
        raise ValueError("symbols come in pairs")
    seqs = {i: bytes([i]) for i in range(256)} | {EOF: b""}
    number, out = FIRST, []
    for a, b in zip(symbols[::2], symbols[1::2], strict=True):
        if a not in seqs or b not in seqs:
            raise ValueError(f"no sequence for {a if a not in seqs else b}")
        pair = seqs[a] + seqs[b]
        if number < EOF:
            seqs[number] = pair
            number += 1
        out.append(pair)
    return b"".join(out)


def dict_entries(symbols: list[int]) -> list[bytes]:
    """The sequences that a symbol stream adds to the dictionary, in the order of their numbers."""
    seqs = {i: bytes([i]) for i in range(256)} | {EOF: b""}
    for a, b in list(zip(symbols[::2], symbols[1::2], strict=True))[: EOF - FIRST]:
        seqs[FIRST + len(seqs) - 257] = seqs[a] + seqs[b]
    return [seqs[FIRST + i] for i in range(len(seqs) - 257)]


def trie_stats(symbols: list[int]) -> tuple[int, int, int]:
    """(values, nodes, inner nodes) of the trie of single bytes and added sequences."""
    entries = dict_entries(symbols)
    nodes = {s[:k] for s in entries for k in range(1, len(s) + 1)} | {bytes([i]) for i in range(256)}
    inner = {s[:-1] for s in nodes}
    return 256 + len(set(entries)), len(nodes) + 1, len(inner)


def dict_bytes(symbols: list[int]) -> bytes:
    return struct.pack(f"<{len(symbols)}H", *symbols)


def dict_parse(data: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(data) // 2}H", data))


def longest_match(data: bytes, at: int) -> tuple[int, int]:
    """(length, distance back) of the longest copy of what follows `at` that lies wholly before it, the oldest of equals.

    The first place that holds MIN_REP bytes is the oldest; each next search asks for one byte more than the best."""
    if len(data) - at < MIN_REP:
        return 0, 0
    low, best, back = max(0, at - WINDOW), 0, 0
    place = data.find(data[at : at + MIN_REP], low, at)
    while place >= 0:
        most = min(at - place, len(data) - at, MOST)
        size = _common(data, place, at, most)
        if size > best:
            best, back = size, at - place
        if best >= min(len(data) - at, MOST):
            break
        place = data.find(data[at : at + best + 1], place + 1, at)
    return best, back


def _common(data: bytes | bytearray, a: int, b: int, most: int) -> int:
    """Length of the common beginning at a and b, by doubling then halving."""
    lo, step = 0, 16
    while lo < most:
        k = min(step, most - lo)
        if data[a + lo : a + lo + k] == data[b + lo : b + lo + k]:
            lo += k
            step *= 2
        elif k == 1:
            break
        else:
            most, step = lo + k - 1 if k > 1 else lo, max(1, k // 2)
    return lo


class Grams:
    """An index of a stretch of bytes by what stands at each place, for each length from MIN_REP to LONG: places by their bytes, then
    in order. Eleven arrays of a number a place each, three times, so it is made of a stretch and the window before it."""

    LONG, FEW = 16, 32

    def __init__(self, data: bytes, low: int, high: int):
        """Of data, whose places from low to high are asked for."""
        self.data, self.low, self.high, self.levels = data, low, high, []
        a = np.frombuffer(data, np.uint8)[low : high + self.LONG].astype(np.int64)
        key = np.zeros(max(len(a) - MIN_REP + 1, 0), np.int64)
        for i in range(MIN_REP):
            key = key << 8 | a[i : i + len(key)]
        for n in range(MIN_REP, self.LONG + 1):
            if not len(key):
                break
            order = np.argsort(key, kind="stable").astype(np.int32)
            ordered = key[order]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            ids = np.empty(len(key), np.int32)
            ids[order] = np.cumsum(fresh) - 1
            bounds = np.append(np.flatnonzero(fresh), len(key)).astype(np.int32)
            self.levels.append(tuple(array("i", v.tobytes()) for v in (ids, order, bounds)))
            key = ids[:-1].astype(np.int64) << 8 | a[n : n + len(ids) - 1]

    def oldest(self, n: int, at: int) -> tuple[int, int, int]:
        """The oldest place in the window of the n bytes at `at` that lies wholly before it, or -1; and where places of the
        window begin and end in their order."""
        ids, order, bounds = self.levels[n - MIN_REP]
        at -= self.low
        if at >= len(ids):
            return -1, 0, 0
        g = ids[at]
        end = bounds[g + 1]
        i = bisect_left(order, max(0, at - WINDOW), bounds[g], end)
        return (order[i] + self.low if order[i] + n <= at else -1), i, end

    def longest_match(self, at: int) -> tuple[int, int]:
        """longest_match() of the data. Any part of a copy is a copy, so its length is found by halving; a longer one than LONG
        is among the places of its first LONG bytes, which are gone through where they are few."""
        if not self.levels:
            return 0, 0
        place = self.oldest(MIN_REP, at)[0]
        if place < 0:
            return 0, 0
        lo, hi = MIN_REP, MIN_REP + len(self.levels) - 1
        while lo < hi:
            n = (lo + hi + 1) // 2
            found, i, end = self.oldest(n, at)
            if found < 0:
                hi = n - 1
            else:
                lo, place = n, found
        if lo < self.LONG:
            return lo, at - place
        _, i, end = self.oldest(self.LONG, at)
        order = self.levels[-1][1]
        end = bisect_left(order, at - self.low - self.LONG + 1, i, end)
        if end - i > self.FEW:
            return longest_match(self.data, at)
        best, back, rest = 0, 0, min(len(self.data) - at, MOST)
        for p in order[i:end]:
            p += self.low
            size = _common(self.data, p, at, min(at - p, rest))
            if size > best:
                best, back = size, at - p
        return best, back


#: Places of which one index is made, and the searches in them that come before it, for few are sooner done without.
STRETCH, UNAIDED = 1 << 17, 64


def back_symbols(data: bytes) -> list[tuple]:
    """("explicit", bytes) and ("back", length, distance). A copy is looked for where an explicit block stands at 0, 2,
    4, 8, ... bytes; what finds none grows to its double, up to what a length can say."""
    out: list[tuple] = []
    at, start, high, tries, grams = 0, 0, STRETCH, 0, None
    while True:
        if at >= high:
            high, tries, grams = at + STRETCH, 0, None
        if tries == UNAIDED:
            grams = Grams(data, max(0, at - WINDOW), high)
        tries += 1
        size, back = grams.longest_match(at) if grams else longest_match(data, at)
        if size >= MIN_REP:
            if at > start:
                out.append(("explicit", data[start:at]))
            out.append(("back", size, back))
            at += size
            start = at
            continue
        want = max(at - start, 2)
        room = MOST - (at - start)
        took = min(want, room, len(data) - at)
        at += took
        if len(data) - at == 0 and took < want or at - start >= MOST:
            if at > start:
                out.append(("explicit", data[start:at]))
            start = at
            if at >= len(data):
                return out


def back_bytes(symbols: list[tuple]) -> bytes:
    return b"".join(struct.pack("<H", len(s[1])) + s[1] if s[0] == "explicit" else struct.pack("<HH", s[1] | 0x8000, s[2]) for s in symbols)


def back_parse(data: bytes) -> list[tuple]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<H", data, at)
        at += 2
        if n & 0x8000:
            out.append(("back", n & 0x7FFF, struct.unpack_from("<H", data, at)[0]))
            at += 2
        else:
            out.append(("explicit", data[at : at + n]))
            at += n
    return out


def back_decode(symbols: list[tuple]) -> bytes:
    out = bytearray()
    for s in symbols:
        if s[0] == "explicit":
            out += s[1]
        else:
            place = len(out) - s[2]
            out += out[place : place + s[1]]
    return bytes(out)
