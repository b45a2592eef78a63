"""Image codecs as DataFrame operators: pixels to one binary for each image, and back.

What is a set operation (histograms, palettes, centroids, nearest points) is a plan over all images; what is a
sequence (bit strings, dictionaries) is one image in one task, which is also the unit of its file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rasterloom.functions.scalar import RGB
from rasterloom.operators import huffman, kmeans, lz
from rasterloom.operators.fold import folded
from rasterloom.operators.joins import recolour
from rasterloom.operators.scan import on_curve, rect_places
from rasterloom.operators.sequence import EqualRuns, MeanRuns
from rasterloom.sources.images import channels_of
from rasterloom.sources.tables import images

PIXELS = "img_id long, pos long, x int, y int, r int, g int, b int"


def header(w: int, h: int) -> bytes:
    return struct.pack("<II", w, h)


def dimensions(data: bytes) -> tuple[int, int]:
    return struct.unpack_from("<II", data)


def pixel_bytes(rgb: np.ndarray) -> bytes:
    """Eleven bytes a pixel: a 64-bit length of 3, then the channels."""
    out = np.zeros((len(rgb), 11), np.uint8)
    out[:, 0] = 3
    out[:, 8:] = rgb
    return out.tobytes()


def bytes_pixels(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, 11)
    if len(rows) and (rows[:, :8] != np.array([3, 0, 0, 0, 0, 0, 0, 0])).any():
        raise ValueError("a pixel does not have three channels")
    return rows[:, 8:].astype(np.int64)


class _Whole:
    """A fold that gathers an image in raster order and encodes it at its end."""

    def __init__(self, encode):
        self.encode, self.parts = encode, []

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> None:
        self.parts.append(np.stack(values, 1))

    def end(self) -> list:
        px = np.concatenate(self.parts).astype(np.int64)
        w, h = int(px[:, 0].max()) + 1, int(px[:, 1].max()) + 1
        return _row(w, h, lambda: self.encode(w, h, px[:, 2:]))


def _row(w: int, h: int, encode) -> list:
    try:
        return [[w], [h], [encode()], [None]]
    except Exception as e:  # noqa: BLE001  one bad image is a row that says so
        return [[w], [h], [None], [f"{type(e).__name__}: {e}"]]


class Measured:
    """A fold of an image's x, y, r, g, b to a row for each codec: its bytes are decoded where they are made and compared with
    the pixels, so neither they nor decoded pixels are dealt out again. Squared differences are summed over the places that
    both have, over the larger count of pixels; an image that fails has no difference."""

    SCHEMA = "codec string, w int, h int, size long, encoded binary, error double, error_msg string, n_pixels long"

    def __init__(self, codecs: list[Codec], save: bool = False):
        """save: give the bytes of pictures that differ, and of those alone."""
        self.codecs, self.save, self.pos, self.parts = codecs, save, [], []

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> None:
        self.pos.append(np.array(order))
        self.parts.append(np.stack(values, 1))

    def end(self) -> list:
        pos, px = np.concatenate(self.pos), np.concatenate(self.parts).astype(np.int64)
        x, y, rgb = px[:, 0], px[:, 1], px[:, 2:]
        w, h = int(x.max()) + 1, int(y.max()) + 1
        rows = []
        for c in self.codecs:
            data, error, why = None, 0.0, None
            try:
                data = c.encode_places(w, h, x, y, rgb)
                error, whole = difference(pos, rgb, c.decode_image(data))
                why = None if whole else "decoded size differs"
            except Exception as e:  # noqa: BLE001  one bad image is a row that says so
                why = f"{type(e).__name__}: {e}"
            if why is None and c.is_lossless and error:
                why = "decoded image doesn't match"
            rows.append((c.name, w, h, None if data is None else len(data), data if self.save and error else None, error, why, len(pos)))
        return [list(c) for c in zip(*rows, strict=True)]


#: Pictures of which the results leave together.
TOGETHER = 256
MEASURED = f"img_id long, name string, {Measured.SCHEMA}"


def measured_pictures(pictures: DataFrame, codecs: list[Codec], save: bool = False) -> DataFrame:
    """img_id, name and the columns of Measured for each codec, of pictures that are a row each (img_id, name, w, h, channels, bgr,
    error_msg): their pixels never become rows. A picture with an error has its message alone."""
    fields = to_arrow_schema(StructType.fromDDL(MEASURED))

    def one(i: int, name: str, w: int, h: int, channels: int, data: pa.Scalar, why: str | None) -> Iterator[tuple]:
        if why is not None:
            return ((i, name, c.name, None, None, None, None, None, why, None) for c in codecs)
        pos, fold = np.arange(w * h), Measured(codecs, save)
        fold.feed(pos, [pos % w, pos // w, *channels_of(data.as_buffer(), w, h, channels)])
        return ((i, name, *row) for row in zip(*fold.end(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                *plain, data, why = batch.slice(k, TOGETHER).columns
                rows = [r for *p, d, e in zip(*(c.to_pylist() for c in plain), data, why.to_pylist(), strict=True) for r in one(*p, d, e)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return pictures.select("img_id", "name", "w", "h", "channels", "bgr", "error_msg").mapInArrow(run, MEASURED)


class Given:
    """A fold of an image's bytes, which come before its pixels, and of its pixels r, g, b to their difference."""

    def __init__(self, codec: Codec):
        self.codec, self.pos, self.parts, self.data = codec, [], [], None

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> None:
        if order[0] < 0:
            self.data, order, values = values[3][0], order[1:], [v[1:] for v in values]
        self.pos.append(np.array(order))
        self.parts.append(np.stack(values[:3], 1))

    def end(self) -> list:
        if self.data is None:
            return [[0.0], [False]]
        return [[v] for v in difference(np.concatenate(self.pos), np.concatenate(self.parts).astype(np.int64), self.codec.decode_image(bytes(self.data)))]


def difference(pos: np.ndarray, rgb: np.ndarray, decoded: tuple[int, int, np.ndarray]) -> tuple[float, bool]:
    """(mean squared difference over places that both have, whether the numbers of pixels agree)."""
    n = decoded[0] * decoded[1]
    both = (pos >= 0) & (pos < n)
    d = rgb[both] - decoded[2][pos[both]]
    return float((d * d).sum()) / max(len(pos), n), len(pos) == n


class Codec:
    """name, is_lossless, and a pair of functions over one image: (w, h, rgb rows in raster order) to bytes, and back."""

    name: str
    is_lossless = True
    #: Whether an image's bytes follow from its pixels alone, in one task.
    by_image = True

    def encode_image(self, w: int, h: int, rgb: np.ndarray) -> bytes:
        raise NotImplementedError

    def encode_places(self, w: int, h: int, x: np.ndarray, y: np.ndarray, rgb: np.ndarray) -> bytes:
        """encode_image() of pixels that also know their places, in raster order."""
        return self.encode_image(w, h, rgb)

    def decode_image(self, data: bytes) -> tuple[int, int, np.ndarray]:
        raise NotImplementedError

    def ordered(self, px: DataFrame) -> tuple[DataFrame, str]:
        """px and the column by which an image's pixels come to the fold."""
        return px, "pos"

    def start(self):
        """The fold of an image's x, y, r, g, b to w, h, encoded, error_msg."""
        return _Whole(self.encode_image)

    def encode(self, px: DataFrame) -> DataFrame:
        """img_id, w, h, encoded, error_msg."""
        rows, order = self.ordered(px)
        return folded(rows, "img_id", order, ["x", "y", *RGB], self.start, "w int, h int, encoded binary, error_msg string")

    def decode(self, encoded: DataFrame) -> DataFrame:
        """Pixels of all images that have bytes."""

        def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    w, h, rgb = self.decode_image(data.as_buffer().to_pybytes())
                    pos = np.arange(w * h)
                    columns = [np.full(w * h, i), pos, *(c.astype(np.int32) for c in (pos % w, pos // w, rgb[:, 0], rgb[:, 1], rgb[:, 2]))]
                    yield pa.record_batch([pa.array(c) for c in columns], ["img_id", "pos", "x", "y", "r", "g", "b"])

        return encoded.filter("encoded IS NOT NULL").select("img_id", "encoded").mapInArrow(all_, PIXELS)


    def pictures(self, encoded: DataFrame, key: str = "img_id") -> DataFrame:
        """key, w, h, channels, bgr of all images that have bytes: a decoded picture as one row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, data in zip(batch.column(0), batch.column(1), strict=True):
                    w, h, rgb = self.decode_image(data.as_buffer().to_pybytes())
                    yield pa.record_batch([pa.array([name.as_py()], batch.schema.types[0]), *(pa.array([v], pa.int32()) for v in (w, h, 3)), pa.array([rgb[:, ::-1].astype(np.uint8).tobytes()], pa.binary())], [key, "w", "h", "channels", "bgr"])

        return encoded.filter("encoded IS NOT NULL").select(key, "encoded").mapInArrow(run, f"{key} {dict(encoded.dtypes)[key]}, w int, h int, channels int, bgr binary")


class Plain(Codec):
    """The sides and all pixels as they are."""

    name = "plain"

    def encode_image(self, w, h, rgb):
        return header(w, h) + pixel_bytes(rgb)

    def decode_image(self, data):
        return (*dimensions(data), bytes_pixels(data[8:]))


class Hufman(Codec):
    name = "Hufman"

    def encode_image(self, w, h, rgb):
        return header(w, h) + huffman.encode_array(rgb, huffman.RGB)

    def decode_image(self, data):
        w, h = dimensions(data)
        return w, h, huffman.decode_array(data, 8, w * h, huffman.RGB)


@lru_cache(maxsize=2)
def _places(w: int, h: int) -> np.ndarray:
    pos = np.arange(w * h)
    return rect_places(pos % w, pos // w, w, h)


def _along(w: int, h: int, rgb: np.ndarray) -> np.ndarray:
    out = np.empty_like(rgb)
    out[_places(w, h)] = rgb
    return out


def _back(w: int, h: int, scanned: np.ndarray) -> np.ndarray:
    return scanned[_places(w, h)]


class Delta(Codec):
    name = "delta"

    def encode_image(self, w, h, rgb):
        s = _along(w, h, rgb)
        return header(w, h) + huffman.encode_array(np.diff(s, axis=0, prepend=0), huffman.SIGNED)

    def decode_image(self, data):
        w, h = dimensions(data)
        s = np.cumsum(huffman.decode_array(data, 8, w * h, huffman.SIGNED), axis=0)
        if ((s < 0) | (s > 255)).any():
            raise ValueError("a channel leaves the range of a byte")
        return w, h, _back(w, h, s)


class _Runs:
    """A fold over an image's pixels along the curve; what it holds are the open run and the bytes of those before."""

    def __init__(self, allowance: float):
        self.allowance, self.state, self.bytes, self.w, self.h = allowance, MeanRuns(allowance) if allowance else EqualRuns(), bytearray(), 0, 0

    def _add(self, got: list) -> None:
        if got:
            rows = np.zeros((len(got), 12), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 9:] = [n for n, _ in got], 3, [c for _, c in got]
            self.bytes += rows.tobytes()

    def feed(self, order: np.ndarray, values: list[np.ndarray]) -> None:
        self.w, self.h = max(self.w, int(values[0].max()) + 1), max(self.h, int(values[1].max()) + 1)
        self._add(self.state.stretch(np.stack(values[2:], 1)))

    def end(self) -> list:
        self._add(self.state.rest())
        return _row(self.w, self.h, lambda: header(self.w, self.h) + bytes(self.bytes))


class HilbertRle(Codec):
    """Run lengths along the curve: exact, or within an allowance of the run's mean."""

    def __init__(self, allowance: float = 0.0):
        MeanRuns(allowance)
        self.allowance, self.is_lossless = allowance, allowance == 0
        self.name = "hilbert-rle" if self.is_lossless else f"hilbert-rle-approx_{allowance:.12g}"

    def ordered(self, px):
        return on_curve(px), "hidx"

    def start(self):
        return _Runs(self.allowance)

    def encode_places(self, w, h, x, y, rgb):
        whole = len(x) == w * h and (y * w + x == np.arange(w * h)).all()
        order = np.argsort(_places(w, h) if whole else rect_places(x, y, w, h), kind="stable")
        runs = _Runs(self.allowance)
        runs.feed(order, [x[order], y[order], *(rgb[order, i] for i in range(3))])
        return runs.end()[2][0]

    def decode_image(self, data):
        w, h = dimensions(data)
        rows = np.frombuffer(data, np.uint8, offset=8).reshape(-1, 12)
        if (rows[:, 0] == 0).any():
            raise ValueError("a run without members")
        return w, h, _back(w, h, np.repeat(rows[:, 9:].astype(np.int64), rows[:, 0], axis=0))


class HilbertZip(Codec):
    name = "hilbert-zip"

    def encode_image(self, w, h, rgb):
        return header(w, h) + lz.dict_bytes(lz.dict_symbols(pixel_bytes(_along(w, h, rgb))))

    def decode_image(self, data):
        w, h = dimensions(data)
        return w, h, _back(w, h, bytes_pixels(lz.dict_decode(lz.dict_parse(data[8:]))))


class ZipDict(Codec):
    name = "zip-dict"

    def encode_image(self, w, h, rgb):
        return lz.dict_bytes(lz.dict_symbols(header(w, h) + pixel_bytes(rgb)))

    def decode_image(self, data):
        raw = lz.dict_decode(lz.dict_parse(data))
        return (*dimensions(raw), bytes_pixels(raw[8:]))


class ZipBack(Codec):
    name = "zip-back"

    def encode_image(self, w, h, rgb):
        return lz.back_bytes(lz.back_symbols(header(w, h) + pixel_bytes(rgb)))

    def decode_image(self, data):
        raw = lz.back_decode(lz.back_parse(data))
        return (*dimensions(raw), bytes_pixels(raw[8:]))


class ClusterColours(Hufman):
    """Colours reduced to k by weighted k-means, then Huffman codes."""

    is_lossless, by_image = False, False

    def __init__(self, k: int, max_iter: int | None = None):
        self.k, self.max_iter, self.name = k, max_iter, f"cluster-colors_{k}"

    def palette(self, px: DataFrame) -> DataFrame:
        """img_id, r, g, b, nr, ng, nb of every colour, and `converged`."""
        colours = px.groupBy("img_id", *RGB).agg(F.count("*").alias("cnt"))
        place = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
        points, centroids = kmeans.kmeans(colours.withColumn("pos", place.cast("long")), self.k, list(RGB), max_iter=self.max_iter)
        to = centroids.select("img_id", "cid", *[F.col(c).alias(f"n{c}") for c in RGB], "converged")
        return points.join(to, ["img_id", "cid"]).select("img_id", *RGB, "nr", "ng", "nb", "converged")

    def encode(self, px):
        """As of any codec, with `converged`."""
        palette = self.palette(px)
        ended = palette.groupBy("img_id").agg(F.min("converged").alias("converged"))
        return super().encode(recolour(px, palette.drop("converged"))).join(ended, "img_id")


class Voronoi(Codec):
    """k centroids of place and colour; a pixel gets the colour of the centroid whose place is nearest."""

    is_lossless, by_image = False, False

    def __init__(self, k: int, max_iter: int | None = None):
        self.k, self.max_iter, self.name = k, max_iter, f"voronoi_{k}"

    def centroids(self, px: DataFrame) -> DataFrame:
        return kmeans.kmeans(px.withColumn("cnt", F.lit(1)), self.k, kmeans.PLACE, max_iter=self.max_iter)[1]

    def encode(self, px):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("cid")
            body = b"".join(struct.pack("<IIQ3B", x, y, 3, r, g, b) for x, y, r, g, b in pdf[kmeans.PLACE].itertuples(index=False, name=None))
            return pd.DataFrame({"img_id": [pdf.img_id.iloc[0]], "w": [pdf.w.iloc[0]], "h": [pdf.h.iloc[0]], "encoded": [header(int(pdf.w.iloc[0]), int(pdf.h.iloc[0])) + struct.pack("<Q", len(pdf)) + body], "error_msg": [None], "converged": [bool(pdf.converged.all())]})

        return self.centroids(px).join(images(px), "img_id").groupBy("img_id").applyInPandas(one, "img_id long, w int, h int, encoded binary, error_msg string, converged boolean")

    def decode_image(self, data):
        w, h = dimensions(data)
        (k,) = struct.unpack_from("<Q", data, 8)
        c = np.array([struct.unpack_from("<IIQ3B", data, 16 + 19 * i) for i in range(k)], np.int64)
        pos, near = np.arange(w * h), np.empty(w * h, np.int64)
        step = max(1, 4_000_000 // max(k, 1))
        for i in range(0, w * h, step):
            p = pos[i : i + step]
            near[i : i + step] = ((p[:, None] % w - c[:, 0]) ** 2 + (p[:, None] // w - c[:, 1]) ** 2).argmin(1)
        return w, h, c[near][:, 3:]
