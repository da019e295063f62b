"""Levels of detail and places in tiled rasters.  Level 0 is the finest; each level halves the resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.functions.scalars import trunc

TILE = 512
POSTING_M, POSTING_ARCSEC = 30.0, 1.0
MAX_METERS_LEVEL, MAX_ANGLE_LEVEL = 9, 12


def _level(value: Column, unit: float, top: int) -> Column:
    out = F.lit(top)
    for k in range(top - 1, -1, -1):
        out = F.when(value < unit * (1 << k), F.lit(k)).otherwise(out)
    return out


def level_of_meters(meters: Column) -> Column:
    """The first level whose posting exceeds a distance; at most 9."""
    return _level(meters, POSTING_M, MAX_METERS_LEVEL)


def level_of_arcseconds(seconds: Column) -> Column:
    return _level(seconds, POSTING_ARCSEC, MAX_ANGLE_LEVEL)


def pixel_meters(level: Column) -> Column:
    return F.lit(POSTING_M) * F.pow(F.lit(2.0), level)


def pixel_arcseconds(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def level_of_depth(depth: Column, kind: str) -> Column:
    """Heights have ten levels below the root, colours six."""
    return F.greatest(F.lit(0), F.lit(10 if kind == "heights" else 6) - depth)


def coarser(level: Column, last: Column) -> Column:
    """The levels from one to the last, finest first."""
    return F.when(level <= last, F.sequence(level, last)).otherwise(F.array().cast("array<int>"))


def tile_place(lat: Column, lon: Column, tie_lat: Column, tie_lon: Column, scale: Column, width: Column, height: Column, tile: int = TILE) -> dict[str, Column]:
    """Tile and pixel of a position in degrees in a layer whose north-west corner is the tie point.

    Longitudes wrap round, latitudes are clamped, and the flag says whether either happened.  The last row and column
    take positions on the far edge.
    """
    u = (lon - tie_lon) / (scale * width)
    v = (tie_lat - lat) / (scale * height)
    uw = u - F.floor(u)
    vc = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    col = F.least(F.floor(uw * width), width.cast("long") - 1)
    row = F.least(F.floor(vc * height), height.cast("long") - 1)
    stride = F.ceil(width / tile).cast("long")
    tx, ty = F.floor(col / tile).cast("long"), F.floor(row / tile).cast("long")
    return {"tile_offset": (ty * stride + tx).cast("int"), "row": row.cast("int"), "col": col.cast("int"), "oob": (uw != u) | (vc != v)}


def tile_xy(offset: Column, stride: Column) -> tuple[Column, Column]:
    return offset % stride, F.floor(offset / stride).cast("int")


def tile_offset(x: Column, y: Column, stride: Column) -> Column:
    return y * stride + x


def pixel_of(u: Column, v: Column, tile: int = TILE) -> Column:
    """Row-major pixel of a place inside a tile."""
    return (trunc(v * tile) * tile + trunc(u * tile)).cast("int")
