"""Positions on a spherical earth: +X to negative longitude, +Y to the north pole, +Z to (0, 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.functions.vectors import Quaternion, Vec3

RADIUS = 6_356_766.0
METERS_PER_DEGREE = 111_111.0


def cartesian(lat: Column, lon: Column, asl: Column) -> Vec3:
    """A position (radians, metres above the sea) as a point in metres."""
    r = asl + RADIUS
    return Vec3(-r * F.sin(lon) * F.cos(lat), r * F.sin(lat), r * F.cos(lon) * F.cos(lat))


def geodetic(p: Vec3) -> tuple[Column, Column, Column]:
    """Latitude, longitude (radians) and metres above the sea of a point; the earth's centre has no latitude."""
    d = p.length()
    return F.asin(F.when(d > 0, p.y / F.when(d > 0, d))), F.atan2(-p.x, p.z), d - RADIUS


def geocentric_distance(asl: Column) -> Column:
    return asl + RADIUS


def above_sea(distance: Column) -> Column:
    return distance - RADIUS


def rotation_at(lat: Column, lon: Column) -> Quaternion:
    """Turns the frame at (0, 0) to the one at a position: about Y by -lon, then about X by -lat."""
    return Quaternion.about("y", -lon).times(Quaternion.about("x", -lat))


def interpolate(a: Column, b: Column, f) -> Column:
    return a + (f if isinstance(f, Column) else F.lit(float(f))) * (b - a)


def bearing_vector(bearing: Column) -> tuple[Column, Column]:
    """East and north parts of a bearing, clockwise from north."""
    return F.sin(bearing), F.cos(bearing)


def pitch_rise_run(pitch: Column) -> tuple[Column, Column]:
    return F.sin(pitch), F.cos(pitch)


def bearing_pitch_vector(bearing: Column, pitch: Column) -> Vec3:
    rise, run = pitch_rise_run(pitch)
    return Vec3(F.sin(bearing) * run, F.cos(bearing) * run, rise)


def world_vector(bearing: Column, pitch: Column, lat: Column, lon: Column) -> Vec3:
    return bearing_pitch_vector(bearing, pitch).rotated(rotation_at(lat, lon))


NORTH, EAST, SOUTH, WEST = 0.0, 90.0, 180.0, 270.0


def box_contains(s: Column, w: Column, n: Column, e: Column, lat: Column, lon: Column) -> Column:
    """Inclusive; a box whose west is beyond its east crosses the antimeridian."""
    inside = F.when(w <= e, lon.between(w, e)).otherwise((lon >= w) | (lon <= e))
    return lat.between(s, n) & inside


def box_corners(s: Column, w: Column, n: Column, e: Column) -> Column:
    """South-west, north-west, north-east, south-east."""
    at = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.array(at(s, w), at(n, w), at(n, e), at(s, e))


def box_center(s: Column, w: Column, n: Column, e: Column) -> tuple[Column, Column]:
    return (s + n) / 2, (w + e) / 2


def expand_box(s: Column, w: Column, n: Column, e: Column, meters: Column, divide: bool = False) -> tuple[Column, Column, Column, Column]:
    """A box in degrees with a border.  The border in longitude is the one in latitude times cos(lat); with ``divide``
    it is divided by it, which keeps the border's width in metres."""
    dlat = meters / METERS_PER_DEGREE
    c = F.cos(F.radians(s))
    dlon = F.when(c != 0, dlat / F.when(c != 0, c)) if divide else c * dlat
    return s - dlat, w - dlon, n + dlat, e + dlon


def box_union(s: Column, w: Column, n: Column, e: Column) -> list[Column]:
    """Aggregates: the box around all boxes of a group.  Null sides are passed over."""
    return [F.min(s).alias("s"), F.min(w).alias("w"), F.max(n).alias("n"), F.max(e).alias("e")]
