"""Cloud-optimised GeoTIFF rasters as a Spark data source named ``cog``.

    spark.dataSource.register(CogDataSource)
    spark.read.format("cog").option("path", "heights.tif").option("kind", "heights").load()

gives one row a tile: kind, level, tile_offset, tx, ty, state, nbytes, payload.  The directory of the file is read on the
driver from its first bytes; each partition reads a run of tiles of one level by byte range and unpacks them.  Filters on
level, tile_offset, tx and ty are pushed to the planning of partitions, so tiles that cannot match are never read, and
with ``option("payload", "false")`` only the index is.  A zero-length tile is ``Empty`` and has no payload.

``path`` is a local file, a ``file://`` or an ``http(s)://`` address; HTTP reads ask for ranges and need status 206.
With ``option("cache", dir)`` ranges are kept as files under the digest of the address and are used again when their
size is right.
"""

from __future__ import annotations

import hashlib
import lzma
import math
import os
import struct
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

TILE = 512
HEADER_BYTES = 8192
LZMA = 34925
SCHEMA = "kind string, level int, tile_offset int, tx int, ty int, state string, nbytes bigint, payload binary"

#: Wire types of directory entries: struct letter and size.
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, TILE_W, TILE_H, OFFSETS, COUNTS, FORMAT, SCALE, TIE, GEO = 254, 256, 257, 258, 259, 262, 277, 284, 322, 323, 324, 325, 339, 33550, 33922, 34735
KINDS = {"heights": (1, 16, 1, 2), "colors": (2, 8, 3, 1)}  # photometric, bits, samples, sample format


class CogError(ValueError):
    """A file that is not a raster of the supported form."""


def read_range(path: str, start: int, size: int, cache: str | None = None) -> bytes:
    """Bytes of a file or an HTTP address, by way of the cache where there is one."""
    if cache:
        spot = os.path.join(cache, "cog", hashlib.md5(path.encode()).hexdigest(), f"{start:016X}-{size:08X}.dat")
        if os.path.exists(spot) and os.path.getsize(spot) == size:
            with open(spot, "rb") as f:
                return f.read()
        data = read_range(path, start, size)
        os.makedirs(os.path.dirname(spot), exist_ok=True)
        part = f"{spot}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, spot)
        return data
    if path.startswith(("http://", "https://")):
        ask = urllib.request.Request(path, headers={"Range": f"bytes={start}-{start + size - 1}"})
        with urllib.request.urlopen(ask) as answer:
            if answer.status != 206:
                raise CogError(f"no range from {path}: status {answer.status}")
            return answer.read()
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(start)
        return f.read(size)


@dataclass
class Layer:
    """One level of a raster."""

    level: int
    width: int
    height: int
    scale: float
    tie_lat: float
    tie_lon: float
    offsets: tuple[int, int]  # where the arrays of tile offsets and sizes are, and of which type
    counts: tuple[int, int]
    n_tiles: int

    @property
    def stride(self) -> int:
        return math.ceil(self.width / TILE)

    @property
    def end(self) -> tuple[float, float]:
        """Latitude and longitude of the south-east corner."""
        return self.tie_lat - self.scale * self.height, self.tie_lon + self.scale * self.width

    def describe(self) -> str:
        south, east = self.end
        return f"level {self.level}: {self.width} x {self.height} px, {self.n_tiles} tiles, {self.scale:.6f} deg, {south:.3f}..{self.tie_lat:.3f} N, {self.tie_lon:.3f}..{east:.3f} E"


def _entries(data: bytes, at: int) -> tuple[dict[int, tuple[int, int, bytes]], int]:
    (n,) = struct.unpack_from("<Q", data, at)
    at += 8
    tags = {}
    for k in range(n):
        tag, kind, count, inline = struct.unpack_from("<HHQ8s", data, at + 20 * k)
        if kind in _TYPES:  # entries of unknown types are left out
            tags[tag] = (kind, count, inline)
    return tags, struct.unpack_from("<Q", data, at + 20 * n)[0]


def _values(data: bytes, entry: tuple[int, int, bytes]) -> list:
    kind, count, inline = entry
    letter, size = _TYPES[kind]
    raw = inline if size * count <= 8 else data[struct.unpack("<Q", inline)[0] :]
    return list(struct.unpack_from(f"<{letter * count}", raw))


def parse(path: str, kind: str, cache: str | None = None) -> list[Layer]:
    """The layers of a raster, finest first, from the directories in its first bytes."""
    data = read_range(path, 0, min(HEADER_BYTES, os.path.getsize(path.removeprefix("file://"))) if not path.startswith("http") else HEADER_BYTES, cache)
    order, version, size, zero, first = struct.unpack_from("<2sHHHQ", data)
    if order != b"II":
        raise CogError("only little-endian files are supported")
    if (version, size, zero) != (43, 8, 0):
        raise CogError("not a BigTIFF file with offsets of 8 bytes")
    layers: list[Layer] = []
    at, scale, tie = first, 0.0, (0.0, 0.0)
    while at:
        tags, at = _entries(data, at)
        one = lambda tag: _need(tags, tag) and _values(data, tags[tag])[0]  # noqa: B023, E731
        photo, bits, samples, fmt = KINDS[kind]
        if one(COMPRESSION) != LZMA or one(PLANAR) != 1 or (one(TILE_W), one(TILE_H)) != (TILE, TILE):
            raise CogError("expected LZMA tiles of 512 x 512 in one plane")
        if one(SAMPLES) != samples or set(_values(data, tags[BITS])) != {bits} or one(PHOTOMETRIC) != photo or set(_values(data, _need(tags, FORMAT))) != {fmt}:
            raise CogError(f"these are not {kind}")
        width, height = one(WIDTH), one(LENGTH)
        n = math.ceil(width / TILE) * math.ceil(height / TILE)
        where = []
        for tag in (OFFSETS, COUNTS):
            t, count, inline = _need(tags, tag)
            if count != n:
                raise CogError("the tile arrays do not fit the image")
            place = struct.unpack("<Q", inline)[0]
            where.append((-int.from_bytes(inline, "little") if count * _TYPES[t][1] <= 8 else place, t))
        if not layers:
            sx, sy, sz = _values(data, _need(tags, SCALE))
            i, j, k, x, y, z = _values(data, _need(tags, TIE))
            if sx != sy or sz or i or j or k or z:
                raise CogError("expected square pixels tied at the first one")
            if not (math.isclose(x, -180, abs_tol=1e-12) or x == -180 - sx / 2) or not (math.isclose(y, 90, abs_tol=1e-12) or y == 60 + sx / 2):
                raise CogError("the tie point is not at a corner of the earth")
            keys = _values(data, _need(tags, GEO))
            if keys[:2] != [1, 1]:
                raise CogError("unknown geographic keys")
            for key, place, count, value in zip(*(iter(keys[4:]),) * 4, strict=False):
                if place or count != 1 or {1024: 2, 1025: 1, 2048: 4326}.get(key, value) != value:
                    raise CogError("expected latitude and longitude on WGS 84, pixels as areas")
            scale, tie = sx, (y, x)
        elif one(SUBFILE) != 1:
            raise CogError("expected an overview")
        layers.append(Layer(len(layers), width, height, scale * 2 ** len(layers), *tie, where[0], where[1], n))
    return layers


def _need(tags: dict, tag: int):
    if tag not in tags:
        raise CogError(f"tag {tag} is missing")
    return tags[tag]


def tile_index(path: str, layer: Layer, cache: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """File offsets and sizes of the tiles of a layer."""
    out = []
    for place, kind in (layer.offsets, layer.counts):
        size = _TYPES[kind][1]
        if place < 0 or (size * layer.n_tiles <= 8):
            raw = (-place).to_bytes(8, "little")[: size * layer.n_tiles]
        else:
            raw = read_range(path, place, size * layer.n_tiles, cache)
        out.append(np.frombuffer(raw, f"<u{size}").astype(np.int64))
    return out[0], out[1]


def unpack(kind: str, data: bytes) -> bytes:
    """A tile's samples: 16-bit heights, or colours with an opaque fourth channel."""
    raw = lzma.decompress(data)
    if kind == "heights":
        return raw
    rgb = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return np.concatenate([rgb, np.full((len(rgb), 1), 255, np.uint8)], 1).tobytes()


@dataclass
class _Run(InputPartition):
    level: int
    stride: int
    tiles: list[tuple[int, int, int]]  # tile_offset, file offset, bytes

    def __init__(self, level: int, stride: int, tiles: list):
        super().__init__(None)
        self.level, self.stride, self.tiles = level, stride, tiles


class CogReader(DataSourceReader):
    #: Compressed bytes that one partition is meant to read.
    RUN_BYTES = 16 << 20

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "heights")
        self.cache, self.payload = options.get("cache"), options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        made = {EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in made and name in ("level", "tile_offset", "tx", "ty", "nbytes"):
                self.tests.append((name, (made[type(f)], f.value)))
            else:
                yield f

    def _wanted(self, **place) -> bool:
        return all(test(place[name], value) for name, (test, value) in self.tests if name in place)

    def partitions(self) -> list[InputPartition]:
        out = []
        for layer in parse(self.path, self.kind, self.cache):
            if not self._wanted(level=layer.level):
                continue
            offsets, counts = tile_index(self.path, layer, self.cache)
            run, size = [], 0
            for t, (o, n) in enumerate(zip(offsets.tolist(), counts.tolist(), strict=True)):
                if self._wanted(tile_offset=t, tx=t % layer.stride, ty=t // layer.stride, nbytes=n):
                    run.append((t, o, n))
                    size += n
                    if size >= self.RUN_BYTES:
                        out.append(_Run(layer.level, layer.stride, run))
                        run, size = [], 0
            if run:
                out.append(_Run(layer.level, layer.stride, run))
        return out or [_Run(-1, 1, [])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        for t, o, n in partition.tiles:
            body = unpack(self.kind, read_range(self.path, o, n, self.cache)) if n and self.payload else None
            yield self.kind, partition.level, t, t % partition.stride, t // partition.stride, "Ready" if n else "Empty", n, body


class CogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cog"

    def schema(self) -> str:
        parse(self.options["path"], self.options.get("kind", "heights"), self.options.get("cache"))
        return SCHEMA

    def reader(self, schema) -> CogReader:
        return CogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CogDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def layers_of(spark: SparkSession, path: str, kind: str = "heights", cache: str | None = None) -> DataFrame:
    """The layers dimension of a raster."""
    rows = [(x.level, x.width, x.height, x.scale, x.tie_lat, x.tie_lon, x.stride, x.n_tiles, x.describe()) for x in parse(path, kind, cache)]
    return spark.createDataFrame(rows, "level int, width int, height int, scale_deg double, tie_lat double, tie_lon double, stride int, n_tiles int, txt string")


def pixels_of(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Height tiles as pixels (level, tile_offset, row, col, height), where all of them are needed."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for level, t, tx, ty, body in zip(b["level"], b["tile_offset"], b["tx"], b["ty"], b["payload"], strict=True):
                h = np.frombuffer(body, "<i2")
                at = np.arange(tile * tile)
                yield pd.DataFrame({"level": np.int32(level), "tile_offset": np.int32(t), "row": (at // tile + ty * tile).astype(np.int32), "col": (at % tile + tx * tile).astype(np.int32), "height": h.astype(np.int32)})

    ready = tiles.filter("payload IS NOT NULL").select("level", "tile_offset", "tx", "ty", "payload")
    return ready.mapInPandas(run, "level int, tile_offset int, row int, col int, height int")


def write(path: str, kind: str, layers: list[np.ndarray], scale: float, tie: tuple[float, float] = (90.0, -180.0), empty=()) -> None:
    """A small raster file: arrays (rows, columns[, 3]), finest first; tiles (level, offset) in ``empty`` get no bytes."""
    photo, bits, samples, fmt = KINDS[kind]
    blobs, spans, at = [], [], HEADER_BYTES
    for level, a in enumerate(layers):
        rows, cols = a.shape[:2]
        stride, down = math.ceil(cols / TILE), math.ceil(rows / TILE)
        padded = np.zeros((down * TILE, stride * TILE, *a.shape[2:]), "<i2" if kind == "heights" else np.uint8)
        padded[:rows, :cols] = a
        offs, sizes = [], []
        for t in range(stride * down):
            y, x = divmod(t, stride)
            body = b"" if (level, t) in empty else lzma.compress(padded[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE].tobytes())
            offs.append(at), sizes.append(len(body)), blobs.append(body)
            at += len(body)
        spans.append((offs, sizes))
    head, extra = bytearray(HEADER_BYTES), 4096
    struct.pack_into("<2sHHHQ", head, 0, b"II", 43, 8, 0, 16)
    at = 16
    for level, (a, (offs, sizes)) in enumerate(zip(layers, spans, strict=True)):
        entries = [(SUBFILE, 4, [int(level > 0)]), (WIDTH, 3, [a.shape[1]]), (LENGTH, 3, [a.shape[0]]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [LZMA]), (PHOTOMETRIC, 3, [photo]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (TILE_W, 3, [TILE]), (TILE_H, 3, [TILE]), (OFFSETS, 16, offs), (COUNTS, 4, sizes), (FORMAT, 3, [fmt] * samples), (65000, 99, [0])]
        if not level:
            entries += [(SCALE, 12, [scale, scale, 0.0]), (TIE, 12, [0.0, 0.0, 0.0, tie[1], tie[0], 0.0]), (GEO, 3, [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326])]
        struct.pack_into("<Q", head, at, len(entries))
        spot = at + 8
        for tag, t, values in entries:
            letter, size = _TYPES.get(t, ("B", 1))
            body = struct.pack(f"<{letter * len(values)}", *values)
            if len(body) > 8:
                head[extra : extra + len(body)] = body
                body, extra = struct.pack("<Q", extra), extra + len(body)
            struct.pack_into("<HHQ8s", head, spot, tag, t, len(values), body)
            spot += 20
        at = spot + 8
        struct.pack_into("<Q", head, spot, at if level + 1 < len(layers) else 0)
    if extra > HEADER_BYTES or at > 4096:
        raise CogError("too many tiles for the header of this small writer")
    with open(path, "wb") as f:
        f.write(bytes(head) + b"".join(blobs))
