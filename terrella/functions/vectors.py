"""Three-dimensional vectors as triples of columns; everything compiles to arithmetic."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


class Vec3(NamedTuple):
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(x, y, z) -> Vec3:
        return Vec3(_col(x), _col(y), _col(z))

    @staticmethod
    def field(name: str) -> Vec3:
        """A struct column's x, y and z."""
        return Vec3(F.col(f"{name}.x"), F.col(f"{name}.y"), F.col(f"{name}.z"))

    @staticmethod
    def columns(prefix: str) -> Vec3:
        return Vec3(*(F.col(f"{prefix}{a}") for a in "xyz"))

    def plus(self, o: Vec3) -> Vec3:
        return Vec3(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec3) -> Vec3:
        return Vec3(self.x - o.x, self.y - o.y, self.z - o.z)

    def negated(self) -> Vec3:
        return Vec3(-self.x, -self.y, -self.z)

    def times(self, k) -> Vec3:
        k = _col(k)
        return Vec3(self.x * k, self.y * k, self.z * k)

    def over(self, k) -> Vec3:
        k = _col(k)
        return Vec3(*(F.when(k != 0, c / k) for c in (self.x, self.y, self.z)))

    def dot(self, o: Vec3) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec3) -> Vec3:
        return Vec3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def normalized(self) -> Vec3:
        """Null components for the zero vector."""
        return self.over(self.length())

    def normalized_or_zero(self) -> Vec3:
        n = self.length()
        return Vec3(*(F.when(n > 0, c / F.when(n > 0, n)).otherwise(0.0) for c in (self.x, self.y, self.z)))

    def reflected(self, normal: Vec3) -> Vec3:
        return self.minus(normal.times(2 * self.dot(normal)))

    def to(self, o: Vec3) -> Vec3:
        return o.minus(self)

    def scaled_units(self, factor: float) -> Vec3:
        return self.times(factor)

    def is_finite(self) -> Column:
        out = F.lit(True)
        for c in (self.x, self.y, self.z):
            out = out & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
        return out

    def rotated(self, q: Quaternion) -> Vec3:
        """v + 2 w (u x v) + 2 u x (u x v) for the quaternion (w, u)."""
        u = Vec3(q.x, q.y, q.z)
        t = u.cross(self).times(2.0)
        return self.plus(t.times(q.w)).plus(u.cross(t))

    def transformed(self, m: list[list]) -> Vec3:
        """By the upper three rows of a 4 x 4 matrix given row by row."""
        return Vec3(*(_col(r[0]) * self.x + _col(r[1]) * self.y + _col(r[2]) * self.z + _col(r[3]) for r in m[:3]))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))

    def named(self, prefix: str) -> list[Column]:
        return [self.x.alias(f"{prefix}x"), self.y.alias(f"{prefix}y"), self.z.alias(f"{prefix}z")]

    def text(self, unit: str) -> Column:
        return F.concat(F.lit("["), self.x.cast("string"), F.lit(", "), self.y.cast("string"), F.lit(", "), self.z.cast("string"), F.lit("]" + unit))


class Quaternion(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column

    @staticmethod
    def about(axis: str, angle: Column) -> Quaternion:
        half = angle / 2
        return Quaternion(F.cos(half), *(F.sin(half) if a == axis else F.lit(0.0) for a in "xyz"))

    @staticmethod
    def about_vector(axis: Vec3, angle: Column) -> Quaternion:
        s = F.sin(angle / 2)
        return Quaternion(F.cos(angle / 2), axis.x * s, axis.y * s, axis.z * s)

    @staticmethod
    def identity() -> Quaternion:
        return Quaternion(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)))

    def times(self, o: Quaternion) -> Quaternion:
        return Quaternion(
            self.w * o.w - self.x * o.x - self.y * o.y - self.z * o.z,
            self.w * o.x + self.x * o.w + self.y * o.z - self.z * o.y,
            self.w * o.y - self.x * o.z + self.y * o.w + self.z * o.x,
            self.w * o.z + self.x * o.y - self.y * o.x + self.z * o.w,
        )
