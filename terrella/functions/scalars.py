"""Scalar mathematics, angles and text forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.80665


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def untrunc(x: Column) -> Column:
    """The cut-off value plus one, whatever the sign and even for whole numbers."""
    return trunc(x) + 1


def half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double")


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def sign(x: Column) -> Column:
    """1 for zero and above, -1 below."""
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def clamp(x: Column, lo, hi) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))  # greatest() and least() skip nulls


def wrap(x: Column, lo: float, hi: float) -> Column:
    """The value moved by whole turns into (lo, hi]."""
    turn = hi - lo
    rest = F.lit(float(hi)) - x
    return F.lit(float(hi)) - (rest - turn * F.floor(rest / turn))


def dms(degrees: Column) -> tuple[Column, Column, Column]:
    """Degrees, minutes and seconds, each cut off."""
    size = F.abs(degrees)
    d = F.floor(size)
    minutes = (size - d) * 60
    m = F.floor(minutes)
    return d.cast("long"), m.cast("long"), F.floor((minutes - m) * 60).cast("long")


def _dms_text(degrees: Column, positive: str, negative: str) -> Column:
    d, m, s = dms(degrees)
    return F.format_string("%s%03dd%02dm%02ds", F.when(degrees >= 0, F.lit(positive)).otherwise(F.lit(negative)), d, m, s)


def latitude_text(degrees: Column) -> Column:
    return _dms_text(degrees, "N", "S")


def longitude_text(degrees: Column) -> Column:
    return _dms_text(degrees, "E", "W")


def g_force(acceleration: Column) -> Column:
    """An acceleration in m/s2 as a multiple of standard gravity."""
    return acceleration / GRAVITY


def radians(degrees: Column) -> Column:
    return degrees * F.lit(math.pi / 180)


def degrees(angle: Column) -> Column:
    return angle / F.lit(math.pi / 180)


def geode_text(lat: Column, lon: Column) -> Column:
    return F.concat(F.when(lat >= 0, F.lit("N")).otherwise(F.lit("S")), F.abs(lat).cast("string"), F.when(lon >= 0, F.lit("E")).otherwise(F.lit("W")), F.abs(lon).cast("string"))


def tile_text(kind: Column, level: Column, stride: Column, offset: Column) -> Column:
    return F.format_string("N:%s:%02d:%04d:%08d", kind, level, stride, offset)
