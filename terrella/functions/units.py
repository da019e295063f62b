"""Units of measure over Spark columns.

A :class:`Quantity` is a double column with a unit.  Dimensions are checked when the plan is built, so a query that adds
metres to seconds fails before it runs; at run time only multiplications by literals are left, which Spark folds.
A value is converted as ``value * factor_from / factor_to``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class UnitError(TypeError):
    """Units that do not fit together."""


@dataclass(frozen=True)
class Unit:
    """One named unit: its factor to the base of its kind, its dimension, and how it is written."""

    name: str
    kind: str
    factor: float
    short: str
    suffix: str
    dimension: tuple[tuple[str, int], ...]


_DIM = {"angle": (("angle", 1),), "length": (("length", 1),), "mass": (("mass", 1),), "time": (("time", 1),), "force": (("length", 1), ("mass", 1), ("time", -2)), "pressure": (("length", -1), ("mass", 1), ("time", -2)), "scalar": ()}
_DEG = math.pi / 180

#: Base units: rad, m, g, s.  A newton is 1000 g m/s2, a pascal 1000 g/(m s2).
UNITS: dict[str, Unit] = {
    key: Unit(name, kind, factor, short, suffix, _DIM[kind])
    for key, name, kind, factor, short, suffix in [
        ("rad", "radians", "angle", 1.0, "rad", "rad"),
        ("deg", "degrees", "angle", _DEG, "deg", "°"),
        ("arcmin", "arcminutes", "angle", _DEG / 60, "arcmin", "'"),
        ("arcsec", "arcseconds", "angle", _DEG / 60 / 60, "arcsec", '"'),
        ("m", "meters", "length", 1.0, "m", "m"),
        ("km", "kilometers", "length", 1000.0, "km", "km"),
        ("ft", "feet", "length", 0.3048, "ft", "ft"),
        ("mi", "miles", "length", 1609.34, "mi", "mi"),
        ("nmi", "nautical miles", "length", 1852.0, "nmi", "nmi"),
        ("au", "astronomical units", "length", 149597870700.0, "au", "au"),
        ("g", "grams", "mass", 1.0, "g", "g"),
        ("kg", "kilograms", "mass", 1000.0, "kg", "kg"),
        ("lb", "pounds", "mass", 453.59237, "lb", "lb"),
        ("slug", "slugs", "mass", 14593.90, "slug", "slug"),
        ("s", "seconds", "time", 1.0, "s", "s"),
        ("h", "hours", "time", 3600.0, "h", "h"),
        ("N", "newtons", "force", 1000.0, "N", "N"),
        ("lbf", "pounds of force", "force", 1000.0 / 0.224809, "lbf", "lbf"),
        ("Pa", "pascals", "pressure", 1000.0, "Pa", "Pa"),
        ("psf", "pounds per square foot", "pressure", 1000.0 * 47.880, "psf", "psf"),
    ]
}

#: Kinds of quantity by dimension, as the results of products are named.
KINDS = {
    "angle": "rad", "length": "m", "area": "m^2", "volume": "m^3", "mass": "kg", "time": "s", "velocity": "m/s", "velocity_squared": "m^2/s^2",
    "acceleration": "m/s^2", "angular_velocity": "rad/s", "angular_acceleration": "rad/s^2", "force": "N", "torque": "N*m", "pressure": "Pa",
    "density": "kg/m^3", "mass_rate": "kg/s", "inertia": "kg*m^2", "scalar": "",
}

#: Names of often used compound units.
ALIASES = {"mps": "m/s", "fps": "ft/s", "mph": "mi/h", "knots": "nmi/h", "kph": "km/h", "mps2": "m/s^2", "fps2": "ft/s^2", "kg_m3": "kg/m^3", "lb_ft3": "lb/ft^3", "kg_m2": "kg*m^2", "lb_s": "lb/s", "nm": "N*m"}


def parse(text: str) -> Counter:
    """Exponents of the units in a text such as ``kg*m^2/s^2``."""
    out: Counter = Counter()
    sign = 1
    for token in re.findall(r"[*/]|[A-Za-z]+(?:\^-?\d+)?", ALIASES.get(text, text)):
        if token in "*/":
            sign = 1 if token == "*" else -1
            continue
        name, _, power = token.partition("^")
        if name not in UNITS:
            raise UnitError(f"no unit named {name!r}")
        out[name] += sign * int(power or 1)
    return Counter({k: v for k, v in out.items() if v})


def factor(units: Counter) -> float:
    out = 1.0
    for name, power in sorted(units.items()):
        out *= UNITS[name].factor ** power
    return out


def dimension(units: Counter, radians_are_bare: bool = False) -> dict[str, int]:
    out: Counter = Counter()
    for name, power in units.items():
        for d, n in UNITS[name].dimension:
            out[d] += n * power
    if radians_are_bare:
        out.pop("angle", None)
    return {k: v for k, v in out.items() if v}


def unit_text(units: Counter) -> str:
    """``ft/s^2``, ``kg*m^2``: what is above the line joined by a star, then a line for each unit below."""
    part = lambda items: [n if p == 1 else f"{n}^{p}" for n, p in items]
    up = part((UNITS[n].short, p) for n, p in units.items() if p > 0)
    down = part((UNITS[n].short, -p) for n, p in units.items() if p < 0)
    return "/".join(["*".join(up) or "1", *down]) if up or down else ""


@dataclass(frozen=True)
class Quantity:
    """A double column with units; operators convert the right side to the left side's units."""

    column: Column
    units: Counter

    @staticmethod
    def of(column, unit: str) -> Quantity:
        return Quantity(column if isinstance(column, Column) else F.lit(float(column)), parse(unit))

    def _needs(self, units: Counter, bare: bool = False) -> None:
        if dimension(self.units, bare) != dimension(units, bare):
            raise UnitError(f"{unit_text(self.units) or 'a bare number'} is not {unit_text(units) or 'a bare number'}")

    def to(self, unit: str | Counter, radians_are_bare: bool = False) -> Quantity:
        units = parse(unit) if isinstance(unit, str) else unit
        self._needs(units, radians_are_bare)
        a, b = factor(self.units), factor(units)
        return Quantity(self.column if a == b else self.column * F.lit(a) / F.lit(b), units)

    def value(self, unit: str) -> Column:
        return self.to(unit).column

    def __add__(self, other: Quantity) -> Quantity:
        return Quantity(self.column + other.to(self.units).column, self.units)

    def __sub__(self, other: Quantity) -> Quantity:
        return Quantity(self.column - other.to(self.units).column, self.units)

    def __neg__(self) -> Quantity:
        return Quantity(-self.column, self.units)

    def _aligned(self, other: Quantity) -> Quantity:
        """``other`` in this quantity's units, kind by kind, so that lengths meet lengths in one unit."""
        mine = {UNITS[n].kind: n for n in self.units}
        return other.to(_fold(Counter(), ((mine.get(UNITS[n].kind, n), p) for n, p in other.units.items())))

    def __mul__(self, other) -> Quantity:
        if not isinstance(other, Quantity):
            return Quantity(self.column * other, self.units)
        right = self._aligned(other)
        return Quantity(self.column * right.column, _fold(self.units, right.units.items()))

    __rmul__ = __mul__

    def __truediv__(self, other) -> Quantity:
        """Division; a zero divisor gives null."""
        if not isinstance(other, Quantity):
            other = Quantity(other if isinstance(other, Column) else F.lit(float(other)), Counter())
        right = self._aligned(other)
        return Quantity(F.when(right.column != 0, self.column / right.column), _fold(self.units, ((n, -p) for n, p in right.units.items())))

    def sqrt(self) -> Quantity:
        if any(p % 2 for p in self.units.values()):
            raise UnitError(f"no square root of {unit_text(self.units)}")
        return Quantity(F.sqrt(self.column), Counter({n: p // 2 for n, p in self.units.items()}))

    def is_zero(self) -> Column:
        return self.column == 0

    def is_nan(self) -> Column:
        return F.isnan(self.column)

    def is_infinite(self) -> Column:
        return F.abs(self.column) == F.lit(math.inf)

    def is_finite(self) -> Column:
        return ~self.is_nan() & ~self.is_infinite()

    def kind(self) -> str:
        d = dimension(self.units)
        for name, unit in KINDS.items():
            if dimension(parse(unit)) == d:
                return name
        return "dynamic"

    def display(self) -> Column:
        """The value followed by its unit."""
        return F.concat(self.column.cast("string"), F.lit(unit_text(self.units)))


def _fold(units: Counter, more) -> Counter:
    out = Counter(units)
    for n, p in more:
        out[n] += p
    return Counter({n: p for n, p in out.items() if p})


def area(a: Quantity, b: Quantity) -> Quantity:
    return _as(a * b, "area")


def _as(q: Quantity, kind: str) -> Quantity:
    if q.kind() != kind:
        raise UnitError(f"{unit_text(q.units)} is of kind {q.kind()}, not {kind}")
    return q


#: Products and quotients of kinds: (left, operator, right) -> result.  ``sqrt`` has no right side.
PRODUCTS = {
    ("length", "*", "length"): "area", ("area", "/", "length"): "length", ("area", "*", "length"): "volume", ("volume", "/", "length"): "area", ("area", "sqrt", ""): "length",
    ("velocity", "/", "time"): "acceleration", ("velocity", "*", "time"): "length", ("velocity", "*", "velocity"): "velocity_squared", ("velocity", "*", "angular_velocity"): "acceleration", ("velocity_squared", "sqrt", ""): "velocity",
    ("acceleration", "*", "time"): "velocity", ("angular_velocity", "/", "time"): "angular_acceleration", ("angular_velocity", "*", "time"): "angle", ("angular_velocity", "*", "angular_velocity"): "angular_acceleration", ("angular_acceleration", "*", "time"): "angular_velocity",
    ("force", "/", "mass"): "acceleration", ("force", "/", "acceleration"): "mass", ("force", "*", "length"): "torque", ("mass", "*", "acceleration"): "force", ("mass", "*", "area"): "inertia", ("mass_rate", "*", "time"): "mass", ("time", "*", "velocity"): "length",
}


def product(left: Quantity, operator: str, right: Quantity | None = None, unit: str | None = None) -> Quantity:
    """A product of the table above, in ``unit`` (by default the kind's own); radians count as bare where they drop out."""
    kind = PRODUCTS[(left.kind(), operator, right.kind() if right is not None else "")]
    raw = left.sqrt() if operator == "sqrt" else left * right if operator == "*" else left / right
    return raw.to(unit or KINDS[kind], radians_are_bare=kind in ("acceleration", "angular_acceleration"))


def convert(column: Column, source: str, target: str) -> Column:
    return Quantity.of(column, source).value(target)


#: Temperature scales: kelvin = (value + shift) * scale + offset.
TEMPERATURES = {"K": (0.0, 1.0, 0.0), "C": (0.0, 1.0, 273.15), "F": (-32.0, 5.0 / 9.0, 273.15), "R": (0.0, 5.0 / 9.0, 0.0)}


def to_kelvin(column: Column, scale: str) -> Column:
    shift, by, offset = TEMPERATURES[scale]
    return (column + shift) * by + offset


def from_kelvin(column: Column, scale: str) -> Column:
    shift, by, offset = TEMPERATURES[scale]
    return (column - offset) / by - shift


def temperature(column: Column, source: str, target: str) -> Column:
    return from_kelvin(to_kelvin(column, source), target)


def temperature_sum(a: Column, a_scale: str, b: Column, b_scale: str) -> Column:
    """Sum of two temperatures in the scale of the first; both count from absolute zero."""
    return from_kelvin(to_kelvin(a, a_scale) + to_kelvin(b, b_scale), a_scale)


def temperature_int(column: Column) -> Column:
    """A temperature as a whole number: cut off, unlike other quantities, which round."""
    return F.when(column >= 0, F.floor(column)).otherwise(F.ceil(column)).cast("long")


_INTS = {"byte": (-128, 127), "short": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "ubyte": (0, 255), "ushort": (0, 65535), "uint": (0, (1 << 32) - 1), "long": (-(1 << 63), (1 << 63) - 1)}


def to_int(column: Column, kind: str) -> Column:
    """Round half away from zero, then clamp to the range of the integer kind; NaN gives 0."""
    lo, hi = _INTS[kind]
    rounded = F.when(F.isnan(column), F.lit(0.0)).otherwise(F.signum(column) * F.floor(F.abs(column) + 0.5))
    target = {"byte": "byte", "short": "short", "int": "int", "ubyte": "short", "ushort": "int", "uint": "long", "long": "long"}[kind]
    return F.when(rounded <= lo, F.lit(lo)).when(rounded >= hi, F.lit(hi)).otherwise(F.when((rounded > lo) & (rounded < hi), rounded).cast("long")).cast(target)


def close(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Equality within an absolute or a relative bound."""
    gap = F.abs(a - b)
    return (gap <= absolute) | (gap <= F.greatest(F.abs(a), F.abs(b)) * relative)


def unit_table(spark: SparkSession) -> DataFrame:
    """The linear units as a dimension table."""
    return spark.createDataFrame([(k, u.kind, u.factor, u.name, u.suffix) for k, u in UNITS.items()], "unit string, kind string, factor double, name string, suffix string")
