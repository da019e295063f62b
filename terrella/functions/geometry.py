"""Shapes, measures and intersections over columns.  Results with cases are dictionaries of columns with a ``kind``."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.functions.vectors import Quaternion, Vec3

EPS = 2.220446049250313e-16
INF = float("inf")


class Stage:
    """Holds intermediate results of a data frame's rows as columns, so that expressions that use them stay small."""

    def __init__(self, df):
        self.df, self.n = df, 0

    def __call__(self, value):
        """A column or vector as a reference to a held column."""
        columns = list(value) if isinstance(value, Vec3) else [value]
        names = [f"__stage{self.n + k}" for k in range(len(columns))]
        self.n += len(columns)
        self.df = self.df.withColumns(dict(zip(names, columns, strict=True)))
        refs = [F.col(n) for n in names]
        return Vec3(*refs) if isinstance(value, Vec3) else refs[0]


def _same(value):
    return value


def nearly(a: Column, b, absolute: float = EPS, relative: float = EPS) -> Column:
    """Equal within an absolute bound, or one relative to the larger of the two."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    gap = F.abs(a - b)
    return (gap <= absolute) | (gap <= F.greatest(F.abs(a), F.abs(b)) * relative)


def pick(cases: list[tuple[Column, Column]], other=None) -> Column:
    """The value of the first case that holds."""
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return out if other is None else out.otherwise(other)


def pick_vec(cases: list[tuple[Column, Vec3]]) -> Vec3:
    return Vec3(*(pick([(w, v[k]) for w, v in cases]) for k in range(3)))


class Box(NamedTuple):
    lo: Vec3
    hi: Vec3

    def span(self) -> Vec3:
        return self.hi.minus(self.lo)

    def center(self) -> Vec3:
        return self.lo.plus(self.hi).times(0.5)

    def corners(self) -> list[Vec3]:
        return [Vec3(x, y, z) for x in (self.lo.x, self.hi.x) for y in (self.lo.y, self.hi.y) for z in (self.lo.z, self.hi.z)]

    def contains(self, p: Vec3) -> Column:
        return p.x.between(self.lo.x, self.hi.x) & p.y.between(self.lo.y, self.hi.y) & p.z.between(self.lo.z, self.hi.z)

    def overlaps(self, o: Box) -> Column:
        out = F.lit(True)
        for k in range(3):
            out = out & (self.lo[k] <= o.hi[k]) & (o.lo[k] <= self.hi[k])
        return out

    def is_finite(self) -> Column:
        return self.lo.is_finite() & self.hi.is_finite()

    def is_degenerate(self) -> Column:
        """Not finite, or without extent along an axis."""
        flat = F.lit(False)
        for k in range(3):
            flat = flat | (self.hi[k] <= self.lo[k])
        return ~self.is_finite() | flat

    def volume(self) -> Column:
        s = self.span()
        return s.x * s.y * s.z

    def radius(self) -> Column:
        """Half the longest span."""
        s = self.span()
        return F.greatest(s.x, s.y, s.z) / 2

    def bounding_sphere(self) -> tuple[Vec3, Column]:
        return self.center(), self.span().length() / 2

    def moved(self, by: Vec3) -> Box:
        return Box(self.lo.plus(by), self.hi.plus(by))

    def rescaled(self, k) -> Box:
        return Box(self.lo.times(k), self.hi.times(k))

    def union(self, o: Box) -> Box:
        return Box(Vec3(*(F.least(a, b) for a, b in zip(self.lo, o.lo, strict=True))), Vec3(*(F.greatest(a, b) for a, b in zip(self.hi, o.hi, strict=True))))

    @staticmethod
    def of_sphere(center: Vec3, radius: Column) -> Box:
        return Box(center.minus(Vec3(radius, radius, radius)), center.plus(Vec3(radius, radius, radius)))

    @staticmethod
    def empty() -> Box:
        return Box(Vec3.of(INF, INF, INF), Vec3.of(-INF, -INF, -INF))

    @staticmethod
    def infinite() -> Box:
        return Box(Vec3.of(-INF, -INF, -INF), Vec3.of(INF, INF, INF))

    @staticmethod
    def bounds(p: Vec3) -> Box:
        """The box of all points of a group, to be used in an aggregation."""
        return Box(Vec3(*(F.min(c) for c in p)), Vec3(*(F.max(c) for c in p)))

    @staticmethod
    def union_of(b: Box) -> Box:
        """The box of all boxes of a group, to be used in an aggregation."""
        return Box(Vec3(*(F.min(c) for c in b.lo)), Vec3(*(F.max(c) for c in b.hi)))


def ndbox_contains(lo: Column, hi: Column, p: Column) -> Column:
    """Inclusive test of a point in a box of any number of dimensions; all three are arrays."""
    return F.forall(F.arrays_zip(lo.alias("a"), hi.alias("b"), p.alias("p")), lambda x: (x["p"] >= x["a"]) & (x["p"] <= x["b"]))


def ndbox_overlaps(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    return F.forall(F.zip_with(alo, bhi, lambda a, b: a <= b), lambda t: t) & F.forall(F.zip_with(blo, ahi, lambda a, b: a <= b), lambda t: t)


class Plane(NamedTuple):
    normal: Vec3
    distance: Column

    @staticmethod
    def axis(name: str) -> Plane:
        return Plane({"xy": Vec3.of(0, 0, 1), "yz": Vec3.of(1, 0, 0), "xz": Vec3.of(0, 1, 0)}[name], F.lit(0.0))

    @staticmethod
    def through(point: Vec3, normal: Vec3) -> Plane:
        return Plane(normal, point.dot(normal))

    @staticmethod
    def of_triangle(a: Vec3, b: Vec3, c: Vec3) -> Plane:
        return Plane.through(a, triangle_normal(a, b, c))

    @staticmethod
    def raw(a: Column, b: Column, c: Column, d: Column) -> Plane:
        return Plane(Vec3(a, b, c).normalized(), -d)

    @staticmethod
    def of_vector4(a: Column, b: Column, c: Column, d: Column) -> Plane:
        n = Vec3(a, b, c).length()
        return Plane.raw(a / n, b / n, c / n, d / n)

    def distance_to(self, p: Vec3) -> Column:
        return self.normal.dot(p) - self.distance

    def closest(self, p: Vec3) -> Vec3:
        return p.minus(self.normal.times(self.distance_to(p)))

    def has(self, p: Vec3) -> Column:
        return nearly(self.distance_to(p), 0.0)

    def in_front(self, p: Vec3, offset: Column | float = 0.0) -> Column:
        return self.distance_to(p) >= offset

    def opposes(self, v: Vec3) -> Column:
        return self.normal.dot(v) < 0

    def nudged(self, by: Column) -> Plane:
        return Plane(self.normal, self.distance + by)

    def side(self, p: Vec3) -> Column:
        return side(self.distance_to(p))


def side(distance: Column) -> Column:
    return F.when(distance > 0, "above").when(distance < 0, "below").otherwise("on")


def triangle_normal(a: Vec3, b: Vec3, c: Vec3) -> Vec3:
    return b.minus(a).cross(c.minus(a)).normalized_or_zero()


def edge_midpoint(a: Vec3, b: Vec3) -> Vec3:
    return a.plus(b.minus(a).over(2.0))


def orthonormal(n: Vec3) -> Vec3:
    """A unit vector at right angles to a unit vector: along the axis that the vector leans to least, made orthogonal.

    The first axis is taken where |x| is no larger than |y| and |z|, then the second, else the third.
    """
    ax, ay, az = F.abs(n.x), F.abs(n.y), F.abs(n.z)
    first, second = (ax <= ay) & (ax <= az), ay <= az
    e = Vec3(F.when(first, 1.0).otherwise(0.0), F.when(~first & second, 1.0).otherwise(0.0), F.when(~first & ~second, 1.0).otherwise(0.0))
    return n.cross(e).normalized()


def circle_point(center: Vec3, normal: Vec3, radius: Column, angle: Column) -> Vec3:
    """A point of a circle; angle 0 is at the direction of :func:`orthonormal`."""
    return center.plus(orthonormal(normal).times(radius).rotated(Quaternion.about_vector(normal, angle)))


def cone_volume(r0: Column, r1: Column, height: Column) -> Column:
    return F.lit(math.pi / 3) * (r0 * r0 + r0 * r1 + r1 * r1) * height


def segment_measures(a: Vec3, b: Vec3) -> dict:
    d = b.minus(a)
    return {"length": d.length(), "direction": d.normalized(), "center": a.plus(b).times(0.5)}


def ray_approach(o1: Vec3, d1: Vec3, o2: Vec3, d2: Vec3) -> tuple[Column, Vec3]:
    """How far along the first ray, and where, it is closest to the second; null for parallel rays."""
    c = o2.minus(o1)
    aa, ab, ac, bb, bc = d1.dot(d1), d1.dot(d2), d1.dot(c), d2.dot(d2), d2.dot(c)
    den = aa * bb - ab * ab
    t = F.when(den != 0, (ac * bb - ab * bc) / F.when(den != 0, den))
    return t, o1.plus(d1.times(t))


def solid_angle(observer: Vec3, direction: Vec3, points: list[Vec3], hold=_same) -> Column:
    """Projected solid angle of a polygon, as a share of the full turn; edges in line with the observer count nothing."""
    total = F.lit(0.0)
    for i, p in enumerate(points):
        v0, v1 = hold(p.minus(observer)), hold(points[(i + 1) % len(points)].minus(observer))
        tau = hold(v0.cross(v1).normalized_or_zero())
        cosine = hold(F.least(F.greatest(v0.normalized_or_zero().dot(v1.normalized_or_zero()), F.lit(-1.0)), F.lit(1.0)))
        total = total - direction.dot(tau) * F.acos(cosine)
    return total / (2 * math.pi)


def box_ray(box: Box, origin: Vec3, direction: Vec3, hold=_same) -> dict[str, Column]:
    """``none``, ``inside`` (the origin) or ``through`` (the point of entry)."""
    box, origin, direction = Box(hold(box.lo), hold(box.hi)), hold(origin), hold(direction)
    candidate = hold(Vec3(*(F.when(origin[k] < box.lo[k], box.lo[k]).when(origin[k] > box.hi[k], box.hi[k]) for k in range(3))))
    inside = candidate[0].isNull() & candidate[1].isNull() & candidate[2].isNull()
    t = hold(Vec3(*(F.when(candidate[k].isNotNull() & (direction[k] != 0), (candidate[k] - origin[k]) / F.when(direction[k] != 0, direction[k])).otherwise(-1.0) for k in range(3))))
    far = hold(F.greatest(*t))
    which = hold(pick([(t[0] == far, F.lit(0)), (t[1] == far, F.lit(1))], F.lit(2)))
    p = hold(Vec3(*(F.when(which == k, candidate[k]).otherwise(origin[k] + far * direction[k]) for k in range(3))))
    hits = F.lit(True)
    for k in range(3):
        hits = hits & ((which == k) | p[k].between(box.lo[k], box.hi[k]))
    kind = pick([(inside, F.lit("inside")), (far < 0, F.lit("none")), (hits, F.lit("through"))], F.lit("none"))
    kind = hold(kind)
    return {"kind": kind, **{a: F.when(kind == "inside", origin[k]).when(kind == "through", p[k]) for k, a in enumerate("xyz")}}


def plane_segment(plane: Plane, a: Vec3, b: Vec3, hold=_same) -> dict[str, Column]:
    """``coplanar``, ``above``, ``below`` or ``intersect``, a point, and the distances that go with the case.

    above: the closest point of the plane and the distance.  below: the deepest end's point on the plane, how deep the
    deepest end is (``interpen``) and how deep the other one is (``depth``).  intersect: the point, whether the start is
    in front, and how deep the end behind the plane is.
    """
    plane = Plane(hold(plane.normal), hold(plane.distance))
    a, b = hold(a), hold(b)
    d0, d1 = hold(plane.distance_to(a)), hold(plane.distance_to(b))
    seg = segment_measures(a, b)
    seg = {"length": hold(seg["length"]), "direction": hold(seg["direction"]), "center": hold(seg["center"])}
    bottom = hold(seg["direction"].dot(plane.normal))
    parallel = hold(nearly(bottom, 0.0))
    t = hold((plane.distance - a.dot(plane.normal)) / F.when(~parallel, bottom))
    apart = (t < 0) | (t > seg["length"])
    middle = plane.closest(seg["center"])
    flat = F.abs(d0) <= 0.000_001
    front = d0 >= 0
    cases = [
        (parallel & flat, "coplanar", seg["center"], None, None, None),
        (parallel & (d0 < 0), "below", middle, None, -d0, -d0),
        (parallel, "above", middle, d0, None, None),
        (apart & (d0 < 0) & (d0 > d1), "below", plane.closest(b), None, -d1, -d0),
        (apart & (d0 < 0), "below", plane.closest(a), None, -d0, -d1),
        (apart & (d0 < d1), "above", plane.closest(a), d0, None, None),
        (apart, "above", plane.closest(b), d1, None, None),
        (F.lit(True), "intersect", a.plus(seg["direction"].times(t)), None, F.when(front, -d1).otherwise(-d0), None),
    ]
    null = F.lit(None).cast("double")
    p = pick_vec([(w, v) for w, _, v, _, _, _ in cases])
    out = {"kind": hold(pick([(c[0], F.lit(c[1])) for c in cases])), "x": p.x, "y": p.y, "z": p.z}
    for k, name in ((3, "distance"), (4, "interpen"), (5, "depth")):
        out[name] = hold(pick([(c[0], null if c[k] is None else c[k]) for c in cases]))
    return out | {"start_in_front": F.when(out["kind"] == "intersect", front)}


def capsule_plane(plane: Plane, a: Vec3, b: Vec3, radius: Column, hold=_same) -> dict[str, Column]:
    """``above`` (distance), ``intersect`` (interpen) or ``below`` (interpen, depth), by the segment's own case."""
    s = plane_segment(plane, a, b, hold)
    above, below = s["kind"] == "above", s["kind"] == "below"
    clear, sunk = above & (s["distance"] > radius), below & (s["depth"] > radius)
    kind = pick([(clear, F.lit("above")), (sunk, F.lit("below"))], F.lit("intersect"))
    interpen = pick([(clear, F.lit(None).cast("double")), (above, radius - s["distance"]), (s["kind"] == "coplanar", radius)], s["interpen"] + radius)
    return {"kind": kind, "x": s["x"], "y": s["y"], "z": s["z"], "distance": F.when(clear, s["distance"] - radius), "interpen": interpen, "depth": F.when(sunk, s["depth"] - radius)}


def circle_plane(center: Vec3, normal: Vec3, radius: Column, plane: Plane, offset: float = 0.0, hold=_same) -> dict[str, Column]:
    """``parallel``, ``in_front``, ``behind``, ``tangent`` (p) or ``intersection`` (p and q)."""
    center, normal, radius = hold(center), hold(normal), hold(radius)
    plane = Plane(hold(plane.normal), hold(plane.distance))
    own = Plane(normal, hold(center.dot(normal)))
    line = hold(normal.cross(plane.normal))
    size = hold(line.dot(line))
    parallel = hold(nearly(size, 0.0))
    d = hold(line.normalized())
    # The point of both planes that is closest to the origin.
    p0 = hold(plane.normal.cross(line).times(own.distance).plus(line.cross(normal).times(plane.distance)).over(F.when(~parallel, size)))
    near = hold(p0.plus(d.times(center.minus(p0).dot(d))))
    gap = hold(center.minus(near).length())
    tangent = nearly(gap, radius, relative=1e-9)
    miss = (gap > radius) & ~tangent
    kind = pick([(parallel, F.lit("parallel")), (miss & plane.in_front(center, offset), F.lit("in_front")), (miss, F.lit("behind")), (tangent, F.lit("tangent"))], F.lit("intersection"))
    kind = hold(kind)
    half = F.sqrt(F.greatest(radius * radius - gap * gap, F.lit(0.0)))
    hit, two = kind.isin("tangent", "intersection"), kind == "intersection"
    step = d.times(F.when(two, half).otherwise(0.0))
    p, q = near.plus(step), near.minus(step)
    return {"kind": kind, **{f"p{a}": F.when(hit, p[k]) for k, a in enumerate("xyz")}, **{f"q{a}": F.when(two, q[k]) for k, a in enumerate("xyz")}}


def sphere_plane(center: Vec3, radius: Column, plane: Plane) -> dict[str, Column]:
    """``none`` (distance, side) or ``circle`` (its centre and radius)."""
    d = plane.distance_to(center)
    hit = F.abs(d) < radius
    c = plane.closest(center)
    return {
        "kind": F.when(hit, "circle").otherwise("none"), "distance": F.when(~hit, F.abs(d) - radius), "side": F.when(~hit, side(d)),
        "radius": F.when(hit, F.sqrt(F.when(hit, radius * radius - d * d))), **{a: F.when(hit, c[k]) for k, a in enumerate("xyz")},
    }


def ray_sphere(origin: Vec3, direction: Vec3, center: Vec3, radius: Column, hold=_same) -> dict[str, Column]:
    """The first hit at or ahead of the origin, or nulls."""
    m = hold(origin.minus(center))
    a, b, c = hold(direction.dot(direction)), hold(2.0 * direction.dot(m)), hold(m.dot(m) - radius * radius)
    disc = hold(b * b - 4.0 * a * c)
    root = hold(F.sqrt(F.when(disc >= 0, disc)))
    q = hold(F.when(b > 0, -0.5 * (b + root)).otherwise(-0.5 * (b - root)))
    t0 = hold(q / F.when(a != 0, a))
    t1 = hold(F.when(q != 0, c / F.when(q != 0, q)).otherwise(t0))
    lo, hi = F.least(t0, t1), F.greatest(t0, t1)
    t = hold(F.when(lo >= 0, lo).when(hi >= 0, hi))
    p = origin.plus(direction.times(t))
    return {"t": t, "x": p.x, "y": p.y, "z": p.z}


def ray_triangle(origin: Vec3, direction: Vec3, p0: Vec3, p1: Vec3, p2: Vec3, hold=_same) -> dict[str, Column]:
    """Distance, point and barycentric u, v, w of a hit on either face, or nulls (Moeller and Trumbore)."""
    origin, direction = hold(origin), hold(direction)
    e1, e2 = hold(p1.minus(p0)), hold(p2.minus(p0))
    h = hold(direction.cross(e2))
    det = hold(e1.dot(h))
    good = F.abs(det) > EPS
    inv = hold(F.lit(1.0) / F.when(good, det))
    s = hold(origin.minus(p0))
    u = hold(inv * s.dot(h))
    k = hold(s.cross(e1))
    v = hold(inv * direction.dot(k))
    t = hold(inv * e2.dot(k))
    hit = good & (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1) & (t > EPS)
    hit = hold(hit)
    p = origin.plus(direction.times(t))
    return {"distance": F.when(hit, t), "x": F.when(hit, p.x), "y": F.when(hit, p.y), "z": F.when(hit, p.z), "u": F.when(hit, u), "v": F.when(hit, v), "w": F.when(hit, 1.0 - u - v)}
