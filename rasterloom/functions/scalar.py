"""Column functions: distances, vectors, rounding, curve positions, bits, little-endian bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def square_sum(a: list[Column], b: list[Column]) -> Column:
    """Squared distance in 64-bit integers (or doubles, if the operands are)."""
    kind = lambda c: c.cast("long")
    return reduce(Column.__add__, [(kind(x) - kind(y)) * (kind(x) - kind(y)) for x, y in zip(a, b, strict=True)])


def dist(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(square_sum(a, b).cast("double"))


def dist_f64(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(Column.__add__, [(x.cast("double") - y) * (x.cast("double") - y) for x, y in zip(a, b, strict=True)]))


def d2_xy(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return square_sum([x, y], [cx, cy])


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def signed(c: Column) -> Column:
    return c.cast("smallint")


def unsigned(c: Column) -> Column:
    """0..255 as it is; anything else raises."""
    return F.when(c.between(0, 255), c.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a byte: "), c.cast("string"))).cast("int"))


def round_u8(c: Column) -> Column:
    """Half away from zero, within a byte."""
    return unsigned(F.round(c).cast("int"))


def next_pow2(n: Column) -> Column:
    """The least power of two that is n or more; 1 for 0."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.expr("1") * F.pow(F.lit(2.0), F.length(F.bin((n - 1).cast("long")))).cast("int"))


def small_side(w: Column, h: Column) -> Column:
    half = lambda n: F.shiftright(next_pow2(n), 1)
    return F.least(half(w), half(h))


def large_side(w: Column, h: Column) -> Column:
    return F.greatest(next_pow2(w), next_pow2(h))


def hilbert_index(x: Column, y: Column, side: Column) -> Column:
    """Distance along the Hilbert curve of a square whose side is a power of two; it begins at (0, 0) and ends at (side - 1, 0).

    The quadrant bits are folded from the highest down, turning the square as the curve does."""
    bits = F.when(side > 1, F.transform(F.sequence(F.lit(1), F.length(F.bin(side.cast("long"))) - 1), lambda k: F.pow(F.lit(2.0), F.length(F.bin(side.cast("long"))) - 1 - k).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, s: Column) -> Column:
        rx, ry = F.when(acc["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(0), F.when(acc["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(0)
        low = s - 1
        u, v = acc["x"].bitwiseAND(low), acc["y"].bitwiseAND(low)
        flip = (ry == 0) & (rx == 1)
        u2, v2 = F.when(flip, low - u).otherwise(u), F.when(flip, low - v).otherwise(v)
        d = acc["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, v2).otherwise(u2).alias("x"), F.when(ry == 0, u2).otherwise(v2).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(bits, start, step, lambda acc: acc["d"])


# bits


def bit_mask(n: Column) -> Column:
    """The n lowest bits; all eight above that."""
    return F.when(n >= 8, F.lit(255)).otherwise((F.pow(F.lit(2.0), n) - 1).cast("int"))


def nth(byte: Column, i: Column, msb: bool = True) -> Column:
    return F.expr("0") + F.floor(byte / F.pow(F.lit(2.0), (7 - i) if msb else i)).cast("int") % 2


def push_bit(byte: Column, bit: Column, msb: bool = True) -> Column:
    """The byte with a bit moved in: at the low end of a most-significant-first byte, else at the high end."""
    return ((byte * 2) % 256 + bit) if msb else (F.floor(byte / 2).cast("int") + bit * 128)


def bit_string(byte: Column, msb: bool = True) -> Column:
    s = F.lpad(F.bin(byte.cast("long")), 8, "0")
    return s if msb else F.reverse(s)


def byte_from_bits(bits: Column, msb: bool = True) -> Column:
    """The byte of a string of exactly eight bits, else null."""
    return F.when(F.length(bits) == 8, F.conv(bits if msb else F.reverse(bits), 2, 10).cast("int"))


def pack_bits(bits: Column) -> Column:
    """A bit string as bytes, zero-padded at the end."""
    full = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), "0")
    n = (F.length(full) / 8).cast("int")
    hex_of = lambda k: F.lpad(F.conv(F.substring(full, k * 8 - 7, F.lit(8)), 2, 16), 2, "0")
    return F.when(F.length(bits) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), n), hex_of), "")))


def unpack_bits(data: Column) -> Column:
    """Bytes as a bit string."""
    n = F.octet_length(data)
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.lpad(F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 2), 8, "0")), ""))


# little-endian bytes


def le(n: Column, size: int) -> Column:
    """An integer as size bytes, the lowest first; negative ones in two's complement."""
    h = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 17 - 2 * (k + 1), 2) for k in range(size)]))


def from_le(data: Column, size: int, is_signed: bool = False, at: int = 1) -> Column:
    h = F.hex(F.substring(data, at, size))
    v = F.conv(F.concat(*[F.substring(h, 2 * (size - k) - 1, 2) for k in range(size)]), 16, 10).cast("decimal(20,0)")
    v = F.when(v >= F.lit(2 ** (8 * size - 1)).cast("decimal(20,0)"), v - F.lit(2 ** (8 * size)).cast("decimal(21,0)")).otherwise(v) if is_signed else v
    return v.cast("long")


def ser_pixel(r: Column, g: Column, b: Column) -> Column:
    """Eleven bytes: a 64-bit length of 3, then the channels."""
    return F.concat(le(F.lit(3), 8), le(r, 1), le(g, 1), le(b, 1))


def ser_signed(dr: Column, dg: Column, db: Column) -> Column:
    """Six bytes: three 16-bit integers."""
    return F.concat(le(dr, 2), le(dg, 2), le(db, 2))


def compress_len(n: Column, tag: Column) -> Column:
    """Fifteen bits of length under one tag bit."""
    return F.when(n <= 32767, n + tag * 32768).otherwise(F.raise_error(F.lit("length above 32767")).cast("int"))


def decompress_len(v: Column) -> Column:
    return F.struct(F.floor(v / 32768).cast("int").alias("tag"), (v % 32768).cast("int").alias("len"))


# rings


def ring_distance(place: Column, written: Column, size: int) -> Column:
    """How far back a place of a ring lies from the next one to be written; the ring's size for that one itself."""
    return size - F.pmod(place - written, F.lit(size))


def ring_place(distance: Column, written: Column, size: int) -> Column:
    """The place that lies a distance back from the next one to be written."""
    return F.pmod(written - distance, F.lit(size))


def still_in_ring(position: Column, written: Column, size: int) -> Column:
    """Whether a byte is still held: written, and not overwritten yet."""
    return (position < written) & (position >= written - size)


def default_array(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)


def human_bytes(c: Column) -> Column:
    """A size as text: whole bytes below 1,000, then one decimal of the largest decimal unit that it reaches.

    Tenths are whole numbers, halves going up, so no size depends on how a double is printed. A null stays one."""
    c = c.cast("long")
    shown = F.concat(c.cast("string"), F.lit(" B"))
    for power, name in enumerate("KMGTPE", 1):
        unit = 1000**power
        tenths = F.call_function("div", c, F.lit(unit)) * 10 + F.call_function("div", c % unit + unit // 20, F.lit(unit // 10))
        text = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}B"))
        shown = F.when(c >= unit, text).otherwise(shown)
    return shown
