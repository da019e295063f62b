"""Queries over units, scalars, geodesy, vectors, shapes and intersections."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import functions as F

from terrella.functions import geodesy as G
from terrella.functions import geometry as S
from terrella.functions import scalars as K
from terrella.functions import units as U
from terrella.functions.units import Quantity as Q
from terrella.functions.vectors import Quaternion, Vec3
from terrella.plans import virtual as V

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def r(column, places: int = 6):
    """Rounded, without a negative zero."""
    return F.round(column, places) + F.lit(0.0)


def rs(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0.0::DOUBLE)"


def d(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


# Units ------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, unit, p_retailprice * factor / base AS value FROM part, (VALUES " + ", ".join(f"('{k}', {d(u.factor)}, {d(U.factor(U.parse(U.KINDS[u.kind])))})" for k, u in U.UNITS.items()) + ") t(unit, factor, base)")
def u01_convert_all(spark, sf_dir):
    """Every linear unit to the unit of its kind."""
    part = V.table(spark, sf_dir, "part")
    each = F.array(*(F.struct(F.lit(k).alias("unit"), (F.col("p_retailprice") * F.lit(u.factor) / F.lit(U.factor(U.parse(U.KINDS[u.kind])))).alias("value")) for k, u in U.UNITS.items()))
    return part.select("p_partkey", F.inline(each))


_FT, _MI, _NMI, _LB, _LBF = 0.3048, 1609.34, 1852.0, 453.59237, 1000.0 / 0.224809
_X = {
    "area_ft2": f"l_quantity * (l_extendedprice * 1.0::DOUBLE / {d(_FT)})",
    "volume_m3": "(l_quantity * l_quantity) * l_extendedprice",
    "side_m": "sqrt(l_extendedprice)",
    "way_m": "l_quantity * l_extendedprice",
    "speed2": f"l_quantity * (l_extendedprice * {d(_NMI / 3600.0)} / 1.0::DOUBLE)",
    "speed": "sqrt(l_extendedprice)",
    "turn_acc": "l_quantity * l_tax",
    "gain": "l_quantity * l_extendedprice",
    "turned_rad": "l_quantity * l_tax",
    "spin_acc": "l_tax * l_tax",
    "spin": "l_tax * l_quantity",
    "torque_nm": f"l_quantity * (l_extendedprice * {d(_FT)} / 1.0::DOUBLE)",
    "force_n": f"(l_quantity * l_extendedprice) * {d(1000.0)} / {d(1000.0)}",
    "inertia": "l_quantity * l_extendedprice",
    "fuel_kg": "l_quantity * l_extendedprice",
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{rs(v, 4)} AS {k}" for k, v in _X.items()) + " FROM lineitem")
def u02_products(spark, sf_dir):
    """Products and roots of quantities; the right side is converted to the left side's units."""
    q, p, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    made = {
        "area_ft2": U.product(Q.of(q, "ft"), "*", Q.of(p, "m"), "ft^2"),
        "volume_m3": U.product(U.product(Q.of(q, "m"), "*", Q.of(q, "m")), "*", Q.of(p, "m")),
        "side_m": U.product(Q.of(p, "m^2"), "sqrt"),
        "way_m": U.product(Q.of(q, "m/s"), "*", Q.of(p, "s")),
        "speed2": U.product(Q.of(q, "m/s"), "*", Q.of(p, "knots")),
        "speed": U.product(Q.of(p, "m^2/s^2"), "sqrt"),
        "turn_acc": U.product(Q.of(q, "m/s"), "*", Q.of(t, "rad/s"), "m/s^2"),
        "gain": U.product(Q.of(q, "m/s^2"), "*", Q.of(p, "s")),
        "turned_rad": U.product(Q.of(q, "rad/s"), "*", Q.of(t, "s")),
        "spin_acc": U.product(Q.of(t, "rad/s"), "*", Q.of(t, "rad/s")),
        "spin": U.product(Q.of(t, "rad/s^2"), "*", Q.of(q, "s")),
        "torque_nm": U.product(Q.of(q, "N"), "*", Q.of(p, "ft")),
        "force_n": U.product(Q.of(q, "kg"), "*", Q.of(p, "m/s^2")),
        "inertia": U.product(Q.of(q, "kg"), "*", Q.of(p, "m^2")),
        "fuel_kg": U.product(Q.of(q, "kg/s"), "*", Q.of(p, "s")),
    }
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(r(v.column, 4).alias(k) for k, v in made.items()))


_Y = {
    "len_m": "l_extendedprice / l_discount",
    "area_m2": "l_extendedprice / l_discount",
    "acc": "l_quantity / l_discount",
    "spin_acc": "l_quantity / l_discount",
    "acc_of_force": "l_extendedprice / l_discount",
    "mass_kg": "l_extendedprice / l_discount",
    "ratio": f"l_quantity / (l_discount * {d(_FT)} / 1.0::DOUBLE)",
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_discount <> 0 THEN {rs(v, 4)} END AS {k}" for k, v in _Y.items()) + " FROM lineitem")
def u03_quotients(spark, sf_dir):
    """Quotients of quantities; a zero divisor gives null."""
    q, p, t = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    made = {
        "len_m": U.product(Q.of(p, "m^2"), "/", Q.of(t, "m")),
        "area_m2": U.product(Q.of(p, "m^3"), "/", Q.of(t, "m")),
        "acc": U.product(Q.of(q, "m/s"), "/", Q.of(t, "s")),
        "spin_acc": U.product(Q.of(q, "rad/s"), "/", Q.of(t, "s")),
        "acc_of_force": U.product(Q.of(p, "N"), "/", Q.of(t, "kg")),
        "mass_kg": U.product(Q.of(p, "N"), "/", Q.of(t, "m/s^2")),
        "ratio": Q.of(q, "m") / Q.of(t, "ft"),
    }
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(r(v.column, 4).alias(k) for k, v in made.items()))


@query(f"""WITH k AS (SELECT p_partkey, (p_size + -32.0::DOUBLE) * {d(5 / 9)} + 273.15::DOUBLE AS k FROM part)
    SELECT p_partkey, {rs("k - 273.15::DOUBLE")} AS c, {rs(f"(k - 273.15::DOUBLE) / {d(5 / 9)} + 32")} AS f, {rs(f"k / {d(5 / 9)}")} AS r, {rs("k")} AS k, {rs("k + k - 273.15::DOUBLE")} AS twice_c, trunc(k)::BIGINT AS k_int FROM k""")
def u04_temperature(spark, sf_dir):
    t = F.col("p_size").cast("double")
    kelvin = U.temperature(t, "F", "K")
    return V.table(spark, sf_dir, "part").select(
        "p_partkey", r(U.temperature(t, "F", "C")).alias("c"), r(U.temperature(t, "F", "F")).alias("f"), r(U.temperature(t, "F", "R")).alias("r"), r(kelvin).alias("k"),
        r(U.temperature_sum(U.temperature(t, "F", "C"), "C", t, "F")).alias("twice_c"), U.temperature_int(kelvin).alias("k_int"),
    )


_ANGLE = "((l_partkey * 37) % 1440 - 720)::DOUBLE"


@query(f"""SELECT l_orderkey, l_linenumber, 180.0::DOUBLE - ((180 - {_ANGLE}) - 360 * floor((180 - {_ANGLE}) / 360)) AS wrapped, least(greatest({_ANGLE}, -90), 90) AS clamped,
    CASE WHEN {_ANGLE} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sgn, {rs(f"sin({_ANGLE} * {d(math.pi / 180)})")} AS sine, {rs(f"cos({_ANGLE} * {d(math.pi / 180)})")} AS cosine, round({_ANGLE} / 7)::BIGINT AS rounded FROM lineitem""")
def u05_angle_wrap(spark, sf_dir):
    a = ((F.col("l_partkey") * 37) % 1440 - 720).cast("double")
    rad = K.radians(a)
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.wrap(a, -180, 180).alias("wrapped"), K.clamp(a, -90, 90).alias("clamped"), K.sign(a).alias("sgn"), r(F.sin(rad)).alias("sine"), r(F.cos(rad)).alias("cosine"), U.to_int(a / 7, "long").alias("rounded"))


def _dms_sql(x: str, p: str, n: str) -> str:
    m = f"((abs({x}) - floor(abs({x}))) * 60)"
    s = f"floor(({m} - floor({m})) * 60)"
    return f"(CASE WHEN {x} >= 0 THEN '{p}' ELSE '{n}' END || lpad(floor(abs({x}))::BIGINT::VARCHAR, 3, '0') || 'd' || lpad(floor({m})::BIGINT::VARCHAR, 2, '0') || 'm' || lpad({s}::BIGINT::VARCHAR, 2, '0') || 's')"


@query(f"WITH {V.GEO_CUSTOMER} SELECT c_custkey, {_dms_sql('lat_deg', 'N', 'S')} AS lat_txt, {_dms_sql('lon_deg', 'E', 'W')} AS lon_txt FROM gc")
def u06_dms_format(spark, sf_dir):
    return V.geo_customer(spark, sf_dir).select("c_custkey", K.latitude_text(F.col("lat_deg")).alias("lat_txt"), K.longitude_text(F.col("lon_deg")).alias("lon_txt"))


_V = "(l_extendedprice / 7 - 3000)"


@query(f"""SELECT l_orderkey, l_linenumber, floor({_V})::DOUBLE + 0.0::DOUBLE AS flo, trunc({_V}) + 0.0::DOUBLE AS tru, ceil({_V})::DOUBLE + 0.0::DOUBLE AS cei, trunc({_V}) + 1 AS untr, round({_V}) + 0.0::DOUBLE AS rou, CASE WHEN l_tax > 0 THEN {rs("ln(l_tax)")} END AS logn,
    {rs("asin(l_discount)")} AS asn, {rs("pow(l_discount, 3.0::DOUBLE)", 9)} AS cube, abs({_V}) AS size, CASE WHEN l_tax <> 0 THEN {rs("l_quantity / l_tax")} END AS quot, {rs("l_quantity / 9.80665::DOUBLE")} AS gees FROM lineitem""")
def u07_rounding(spark, sf_dir):
    x = F.col("l_extendedprice") / 7 - 3000
    return V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.floor(x).cast("double").alias("flo"), K.trunc(x).alias("tru"), F.ceil(x).cast("double").alias("cei"), K.untrunc(x).alias("untr"), K.half_away(x).alias("rou"), r(K.ln(F.col("l_tax"))).alias("logn"),
        r(F.asin("l_discount")).alias("asn"), r(F.pow(F.col("l_discount"), F.lit(3.0)), 9).alias("cube"), F.abs(x).alias("size"), r(K.divide(F.col("l_quantity"), F.col("l_tax"))).alias("quot"), r(K.g_force(F.col("l_quantity"))).alias("gees"),
    )


@query(f"""WITH {V.LAYERS}, {V.RESIDENCY} SELECT rs.level, tile_offset, 'N:H:' || lpad(rs.level::VARCHAR, 2, '0') || ':' || lpad(stride::VARCHAR, 4, '0') || ':' || lpad(tile_offset::VARCHAR, 8, '0') AS txt, tile_offset::VARCHAR || 'ft/s^2' AS acc_txt
    FROM rs JOIN ly USING (level)""")
def u08_display(spark, sf_dir):
    tiles = V.residency(spark).join(F.broadcast(V.layers(spark).select("level", "stride")), "level")
    acc = Q(F.col("tile_offset"), Counter({"ft": 1, "s": -2})).display()
    return tiles.select("level", "tile_offset", K.tile_text(F.lit("H"), F.col("level"), F.col("stride"), F.col("tile_offset")).alias("txt"), acc.alias("acc_txt"))


@query("SELECT l_orderkey, l_linenumber, greatest(-32768, least(32767, round(l_extendedprice - 40000)))::SMALLINT AS i16, greatest(0, least(255, round(l_extendedprice / 100)))::SMALLINT AS u8, greatest(-128, least(127, round(l_quantity * 5 - 100)))::TINYINT AS i8, abs(l_tax - l_discount) <= 0.02::DOUBLE AS near, abs(l_tax - l_discount) <= greatest(abs(l_tax), abs(l_discount)) * 0.5::DOUBLE AS near_rel FROM lineitem")
def u09_int_conversion(spark, sf_dir):
    """Saturating conversion to whole numbers, and approximate equality."""
    p, t, x = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount")
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.to_int(p - 40000, "short").alias("i16"), U.to_int(p / 100, "ubyte").alias("u8"), U.to_int(F.col("l_quantity") * 5 - 100, "byte").alias("i8"), U.close(t, x, absolute=0.02).alias("near"), U.close(t, x, absolute=-1.0, relative=0.5).alias("near_rel"))


# Geodesy ----------------------------------------------------------------------------------------------------------

_RAD = d(math.pi / 180)
_PT = f"pt AS (SELECT *, lat_deg * {_RAD} AS la, lon_deg * {_RAD} AS lo, asl_m + 6356766.0::DOUBLE AS rr FROM gc), xyz AS (SELECT *, -rr * sin(lo) * cos(la) AS x, rr * sin(la) AS y, rr * cos(lo) * cos(la) AS z FROM pt)"


def _xyz(spark, sf_dir):
    c = V.geo_customer(spark, sf_dir)
    p = G.cartesian(K.radians(F.col("lat_deg")), K.radians(F.col("lon_deg")), F.col("asl_m"))
    return c.select("*", *p.named(""))


@query(f"WITH {V.GEO_CUSTOMER}, {_PT} SELECT c_custkey, {rs('x', 3)} AS x, {rs('y', 3)} AS y, {rs('z', 3)} AS z FROM xyz")
def g01_pt3(spark, sf_dir):
    return _xyz(spark, sf_dir).select("c_custkey", *(r(F.col(a), 3).alias(a) for a in "xyz"))


@query(f"WITH {V.GEO_CUSTOMER}, {_PT} SELECT c_custkey, {rs('asin(y / sqrt(x*x + y*y + z*z))')} AS lat, {rs('atan2(-x, z)')} AS lon, {rs('sqrt(x*x + y*y + z*z) - 6356766.0::DOUBLE', 3)} AS asl FROM xyz")
def g02_inverse(spark, sf_dir):
    lat, lon, asl = G.geodetic(Vec3.columns(""))
    return _xyz(spark, sf_dir).select("c_custkey", r(lat).alias("lat"), r(lon).alias("lon"), r(asl, 3).alias("asl"))


@query(f"WITH {V.GEO_CUSTOMER}, {_PT} SELECT c_nationkey, max(greatest(abs(asin(y / sqrt(x*x + y*y + z*z)) - la), abs(sqrt(x*x + y*y + z*z) - rr))) < 1e-6 AS ok, count(*)::BIGINT AS n FROM xyz GROUP BY c_nationkey")
def g03_roundtrip(spark, sf_dir):
    lat, _, asl = G.geodetic(Vec3.columns(""))
    error = F.greatest(F.abs(lat - K.radians(F.col("lat_deg"))), F.abs(G.geocentric_distance(asl) - G.geocentric_distance(F.col("asl_m"))))
    return _xyz(spark, sf_dir).groupBy("c_nationkey").agg((F.max(error) < 1e-6).alias("ok"), F.count("*").alias("n"))


@query(f"""WITH {V.GEO_CUSTOMER}, a AS (SELECT c_custkey, lat_deg * {_RAD} AS la, lon_deg * {_RAD} AS lo, ((c_custkey * 37) % 360) * {_RAD} AS b, ((c_custkey * 13) % 180 - 90) * {_RAD} AS p FROM gc),
    v AS (SELECT *, sin(b) * cos(p) AS vx, cos(b) * cos(p) AS vy, sin(p) AS vz FROM a), x AS (SELECT *, vy * cos(la) + vz * sin(la) AS y1, -vy * sin(la) + vz * cos(la) AS z1 FROM v)
    SELECT c_custkey, {rs("vx * cos(lo) - z1 * sin(lo)")} AS vx, {rs("y1")} AS vy, {rs("vx * sin(lo) + z1 * cos(lo)")} AS vz FROM x""")
def g04_bearing_vec(spark, sf_dir):
    v = G.world_vector(K.radians((F.col("c_custkey") * 37) % 360), K.radians((F.col("c_custkey") * 13) % 180 - 90), K.radians(F.col("lat_deg")), K.radians(F.col("lon_deg")))
    return V.geo_customer(spark, sf_dir).select("c_custkey", *(r(c).alias(f"v{a}") for c, a in zip(v, "xyz", strict=True)))


@query(f"WITH {V.GEO_CUSTOMER} SELECT a.c_custkey, {rs('a.lat_deg + 0.25::DOUBLE * (b.lat_deg - a.lat_deg)')} AS lat, {rs('a.lon_deg + 0.25::DOUBLE * (b.lon_deg - a.lon_deg)')} AS lon, {rs('a.asl_m + 0.25::DOUBLE * (b.asl_m - a.asl_m)')} AS asl FROM gc a JOIN gc b ON a.c_custkey + 1 = b.c_custkey")
def g05_interpolate(spark, sf_dir):
    c = V.geo_customer(spark, sf_dir)
    nxt = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lat_deg").alias("lat2"), F.col("lon_deg").alias("lon2"), F.col("asl_m").alias("asl2"))
    at = lambda a, b: r(G.interpolate(F.col(a), F.col(b), 0.25))
    return c.join(nxt, "c_custkey").select("c_custkey", at("lat_deg", "lat2").alias("lat"), at("lon_deg", "lon2").alias("lon"), at("asl_m", "asl2").alias("asl"))


@query(f"""WITH {V.GEO_CUSTOMER}, m AS (SELECT c_nationkey, min(lat_deg) AS s, min(lon_deg) AS w0, max(lat_deg) AS n, max(lon_deg) AS e0, min(asl_m) AS min_asl, max(asl_m) AS max_asl FROM gc GROUP BY c_nationkey)
    SELECT c_nationkey, s, CASE WHEN e0 - w0 > 180 THEN e0 ELSE w0 END AS w, n, CASE WHEN e0 - w0 > 180 THEN w0 ELSE e0 END AS e, min_asl, max_asl, (s + n) / 2 AS mid_lat FROM m""")
def g06_bbox_by_nation(spark, sf_dir):
    """Bounds of a nation's customers; the longitudes are swapped where they span more than half the earth."""
    m = V.geo_customer(spark, sf_dir).groupBy("c_nationkey").agg(F.min("lat_deg").alias("s"), F.min("lon_deg").alias("w0"), F.max("lat_deg").alias("n"), F.max("lon_deg").alias("e0"), F.min("asl_m").alias("min_asl"), F.max("asl_m").alias("max_asl"))
    swap = F.col("e0") - F.col("w0") > 180
    lat, _ = G.box_center(F.col("s"), F.col("w0"), F.col("n"), F.col("e0"))
    return m.select("c_nationkey", "s", F.when(swap, F.col("e0")).otherwise(F.col("w0")).alias("w"), "n", F.when(swap, F.col("w0")).otherwise(F.col("e0")).alias("e"), "min_asl", "max_asl", lat.alias("mid_lat"))


_GROWN = f"gr AS (SELECT s_suppkey, s - 50000.0::DOUBLE / 111111.0::DOUBLE AS s, w - cos(s * {_RAD}) * (50000.0::DOUBLE / 111111.0::DOUBLE) AS w, n + 50000.0::DOUBLE / 111111.0::DOUBLE AS n, e + cos(s * {_RAD}) * (50000.0::DOUBLE / 111111.0::DOUBLE) AS e FROM gb)"


@query(f"WITH {V.GEO_CUSTOMER}, {V.GEO_BOX}, {_GROWN} SELECT s_suppkey, count(c_custkey)::BIGINT AS n_inside FROM gr LEFT JOIN gc ON lat_deg BETWEEN s AND n AND lon_deg BETWEEN w AND e GROUP BY s_suppkey")
def g07_expand_contains(spark, sf_dir):
    """Customers in each supplier's box with a border of 50 km: boxes are cut into whole degrees and meet positions by
    equality of their degree, so that no range join is planned."""
    s, w, n, e = (F.col(c) for c in "swne")
    grown = dict(zip("swne", G.expand_box(s, w, n, e, F.lit(50000.0)), strict=True))
    boxes = V.geo_box(spark, sf_dir).select("s_suppkey", *(v.alias(k) for k, v in grown.items()))
    cells = boxes.withColumn("cy", F.explode(F.sequence(F.floor("s").cast("int"), F.floor("n").cast("int")))).withColumn("cx", F.explode(F.sequence(F.floor("w").cast("int"), F.floor("e").cast("int"))))
    points = V.geo_customer(spark, sf_dir).select("c_custkey", "lat_deg", "lon_deg", F.floor("lat_deg").cast("int").alias("cy"), F.floor("lon_deg").cast("int").alias("cx"))
    hits = cells.join(points, ["cy", "cx"]).filter(G.box_contains(s, w, n, e, F.col("lat_deg"), F.col("lon_deg"))).groupBy("s_suppkey").agg(F.count("*").alias("n_inside"))
    return boxes.select("s_suppkey").join(hits, "s_suppkey", "left").select("s_suppkey", F.coalesce("n_inside", F.lit(0)).cast("long").alias("n_inside"))


@query(f"WITH {V.GEO_BOX}, c AS (SELECT s_suppkey, 0 AS k, s AS lat, w AS lon FROM gb UNION ALL SELECT s_suppkey, 1, n, w FROM gb UNION ALL SELECT s_suppkey, 2, n, e FROM gb UNION ALL SELECT s_suppkey, 3, s, e FROM gb) SELECT s_suppkey, k::INT AS k, lat, lon FROM c")
def g08_box_corners(spark, sf_dir):
    b = V.geo_box(spark, sf_dir)
    return b.select("s_suppkey", F.posexplode(G.box_corners(*(F.col(c) for c in "swne"))).alias("k", "c")).select("s_suppkey", "k", "c.lat", "c.lon")


@query(f"WITH b AS (SELECT c_custkey, ((c_custkey * 37) % 360) * {_RAD} AS b FROM customer) SELECT c_custkey, {rs('sin(b)')} AS x, {rs('cos(b)')} AS y, {rs('b + 1.5707963267948966::DOUBLE')} AS east_of FROM b")
def g09_bearing_2d(spark, sf_dir):
    b = K.radians((F.col("c_custkey") * 37) % 360)
    x, y = G.bearing_vector(b)
    return V.table(spark, sf_dir, "customer").select("c_custkey", r(x).alias("x"), r(y).alias("y"), r(b + K.radians(F.lit(G.EAST))).alias("east_of"))


# Vectors and shapes -----------------------------------------------------------------------------------------------

_N = "sqrt(e3*e3 + e4*e4 + e5*e5)"
_UNIT = f"un AS (SELECT *, e3 / {_N} AS nx, e4 / {_N} AS ny, e5 / {_N} AS nz FROM sh WHERE e3*e3 + e4*e4 + e5*e5 > 0)"


def _unit_shapes(spark, sf_dir):
    s = V.shapes(spark, sf_dir).filter(V.e(3).dot(V.e(3)) > 0)
    return s.select("*", *V.e(3).normalized().named("n"))


_DOT = "(e0*nx + e1*ny + e2*nz)"


@query(f"""WITH {V.SHAPES}, {_UNIT} SELECT vec_id, {rs("sqrt(e0*e0 + e1*e1 + e2*e2)", 9)} AS len, {rs(_DOT, 9)} AS dot, {rs("e1*nz - e2*ny", 9)} AS cx, {rs("e2*nx - e0*nz", 9)} AS cy, {rs("e0*ny - e1*nx", 9)} AS cz,
    {rs(f"e0 - 2*{_DOT}*nx", 9)} AS rx, {rs(f"e1 - 2*{_DOT}*ny", 9)} AS ry, {rs(f"e2 - 2*{_DOT}*nz", 9)} AS rz, {rs("(e6 - e0) * 3.0 / 2.0 / 0.3048::DOUBLE", 9)} AS tx FROM un""")
def v01_vector_ops(spark, sf_dir):
    p, n = V.e(0), Vec3.columns("n")
    c, x = p.cross(n), p.reflected(n)
    to = p.to(V.e(6)).times(3.0).over(2.0).scaled_units(1 / 0.3048)
    return _unit_shapes(spark, sf_dir).select("vec_id", r(p.length(), 9).alias("len"), r(p.dot(n), 9).alias("dot"), *(r(v, 9).alias(f"c{a}") for v, a in zip(c, "xyz", strict=True)), *(r(v, 9).alias(f"r{a}") for v, a in zip(x, "xyz", strict=True)), r(to.x, 9).alias("tx"))


@query(f"WITH {V.SHAPES} SELECT vec_id, {rs('e0 * cos(label * 0.1::DOUBLE) - e1 * sin(label * 0.1::DOUBLE)')} AS x, {rs('e0 * sin(label * 0.1::DOUBLE) + e1 * cos(label * 0.1::DOUBLE)')} AS y, {rs('e2')} AS z, {rs('2*e0 + 5')} AS mx, {rs('3*e1 - e2 + 7')} AS my, {rs('e0 + e2')} AS mz FROM sh")
def v02_rotate(spark, sf_dir):
    p = V.e(0)
    v = p.rotated(Quaternion.about("z", F.col("label") * F.lit(0.1)))
    m = p.transformed([[2, 0, 0, 5], [0, 3, -1, 7], [1, 0, 1, 0], [0, 0, 0, 1]])
    return V.shapes(spark, sf_dir).select("vec_id", *(r(c).alias(a) for c, a in zip(v, "xyz", strict=True)), *(r(c).alias(f"m{a}") for c, a in zip(m, "xyz", strict=True)))


@query(f"""WITH {V.SHAPES}, b AS (SELECT label, min(e0) AS a, min(e1) AS b, min(e2) AS c, max(e0) AS x, max(e1) AS y, max(e2) AS z FROM sh GROUP BY label)
    SELECT label, {rs("(x-a)*(y-b)*(z-c)", 9)} AS volume, {rs("greatest(x-a, y-b, z-c)/2", 9)} AS radius, {rs("(a+x)*0.5", 9)} AS cx, {rs("(b+y)*0.5", 9)} AS cy, {rs("(c+z)*0.5", 9)} AS cz, {rs("sqrt((x-a)*(x-a)+(y-b)*(y-b)+(z-c)*(z-c))/2", 9)} AS sphere, x <= a OR y <= b OR z <= c AS degenerate FROM b""")
def e01_box_measures(spark, sf_dir):
    box = S.Box.bounds(V.e(0))
    g = V.shapes(spark, sf_dir).groupBy("label").agg(*box.lo.named("l"), *box.hi.named("h"))
    b = S.Box(Vec3.columns("l"), Vec3.columns("h"))
    c, sphere = b.bounding_sphere()
    return g.select("label", r(b.volume(), 9).alias("volume"), r(b.radius(), 9).alias("radius"), *(r(v, 9).alias(f"c{a}") for v, a in zip(c, "xyz", strict=True)), r(sphere, 9).alias("sphere"), b.is_degenerate().alias("degenerate"))


_BOXES = "bx AS (SELECT vec_id, e0, e1, e2, least(e0,e3) AS ax, least(e1,e4) AS ay, least(e2,e5) AS az, greatest(e0,e3) AS bx, greatest(e1,e4) AS by_, greatest(e2,e5) AS bz FROM sh)"


@query(f"""WITH {V.SHAPES}, {_BOXES} SELECT p.vec_id AS a, q.vec_id AS b, p.ax <= q.bx AND q.ax <= p.bx AND p.ay <= q.by_ AND q.ay <= p.by_ AND p.az <= q.bz AND q.az <= p.bz AS overlap,
    q.e0 BETWEEN p.ax AND p.bx AND q.e1 BETWEEN p.ay AND p.by_ AND q.e2 BETWEEN p.az AND p.bz AS holds, {rs("(greatest(p.bx,q.bx)-least(p.ax,q.ax))*(greatest(p.by_,q.by_)-least(p.ay,q.ay))*(greatest(p.bz,q.bz)-least(p.az,q.az))", 9)} AS union_volume FROM bx p JOIN bx q ON p.vec_id + 1 = q.vec_id""")
def e02_boxes_overlap(spark, sf_dir):
    """Overlap, containment and union of neighbouring boxes, in three dimensions and as arrays."""
    p, q = V.e(0), V.e(3)
    lo, hi = Vec3(*(F.least(a, b) for a, b in zip(p, q, strict=True))), Vec3(*(F.greatest(a, b) for a, b in zip(p, q, strict=True)))
    s = V.shapes(spark, sf_dir).select("vec_id", *lo.named("l"), *hi.named("h"), *p.named("p"))
    o = s.select((F.col("vec_id") - 1).alias("a"), *(F.col(f"{k}{a}").alias(f"o{k}{a}") for k in "lhp" for a in "xyz"))
    one, two = S.Box(Vec3.columns("l"), Vec3.columns("h")), S.Box(Vec3.columns("ol"), Vec3.columns("oh"))
    arr = lambda k: F.array(*(F.col(f"{k}{a}") for a in "xyz"))
    j = s.withColumnRenamed("vec_id", "a").join(o, "a")
    both = one.overlaps(two) & S.ndbox_overlaps(arr("l"), arr("h"), arr("ol"), arr("oh"))
    holds = one.contains(Vec3.columns("op")) & S.ndbox_contains(arr("l"), arr("h"), arr("op"))
    return j.select("a", (F.col("a") + 1).alias("b"), both.alias("overlap"), holds.alias("holds"), r(one.union(two).volume(), 9).alias("union_volume"))


_PD = "(nx*e6 + ny*e7 + nz*e8 - (e0*nx + e1*ny + e2*nz))"


@query(f"WITH {V.SHAPES}, {_UNIT} SELECT vec_id, {rs(_PD, 9)} AS dist, CASE WHEN {_PD} > 0 THEN 'above' WHEN {_PD} < 0 THEN 'below' ELSE 'on' END AS side, {rs(f'e6 - nx*{_PD}', 9)} AS px, {rs(f'e7 - ny*{_PD}', 9)} AS py, {rs(f'e8 - nz*{_PD}', 9)} AS pz, {_PD} >= 0 AS front, nx*e9 + ny*e10 + nz*e11 < 0 AS opposes FROM un")
def e03_plane_measures(spark, sf_dir):
    plane = S.Plane.through(V.e(0), Vec3.columns("n"))
    c = plane.closest(V.e(6))
    return _unit_shapes(spark, sf_dir).select("vec_id", r(plane.distance_to(V.e(6)), 9).alias("dist"), plane.side(V.e(6)).alias("side"), *(r(v, 9).alias(f"p{a}") for v, a in zip(c, "xyz", strict=True)), plane.in_front(V.e(6)).alias("front"), plane.opposes(V.e(9)).alias("opposes"))


@query(f"SELECT p_partkey, {rs(f'{d(math.pi / 3)} * (p_size*p_size + p_size*(p_size/2) + (p_size/2)*(p_size/2)) * (p_retailprice/100)', 4)} AS v FROM part")
def e04_cone_volume(spark, sf_dir):
    s = F.col("p_size").cast("double")
    return V.table(spark, sf_dir, "part").select("p_partkey", r(S.cone_volume(s, s / 2, F.col("p_retailprice") / 100), 4).alias("v"))


@query(f"WITH {V.SHAPES} SELECT vec_id, {rs('sqrt((e3-e0)*(e3-e0)+(e4-e1)*(e4-e1)+(e5-e2)*(e5-e2))', 9)} AS len, {rs('(e0+e3)*0.5', 9)} AS cx, {rs('(e1+e4)*0.5', 9)} AS cy, {rs('(e2+e5)*0.5', 9)} AS cz, {rs('e0+(e3-e0)/2', 9)} AS mx FROM sh")
def e05_segment(spark, sf_dir):
    m = S.segment_measures(V.e(0), V.e(3))
    return V.shapes(spark, sf_dir).select("vec_id", r(m["length"], 9).alias("len"), *(r(v, 9).alias(f"c{a}") for v, a in zip(m["center"], "xyz", strict=True)), r(S.edge_midpoint(V.e(0), V.e(3)).x, 9).alias("mx"))


_RA = """ra AS (SELECT vec_id, e0, e1, e2, e3, e4, e5, e3*e3+e4*e4+e5*e5 AS aa, e3*e9+e4*e10+e5*e11 AS ab, e3*(e6-e0)+e4*(e7-e1)+e5*(e8-e2) AS ac, e9*e9+e10*e10+e11*e11 AS bb, e9*(e6-e0)+e10*(e7-e1)+e11*(e8-e2) AS bc FROM sh),
    rt AS (SELECT *, CASE WHEN aa*bb-ab*ab <> 0 THEN (ac*bb-ab*bc)/(aa*bb-ab*ab) END AS t FROM ra)"""


@query(f"WITH {V.SHAPES}, {_RA} SELECT vec_id, {rs('t')} AS t, {rs('e0+e3*t')} AS x, {rs('e1+e4*t')} AS y, {rs('e2+e5*t')} AS z FROM rt")
def e06_ray_approach(spark, sf_dir):
    t, p = S.ray_approach(V.e(0), V.e(3), V.e(6), V.e(9))
    return V.shapes(spark, sf_dir).select("vec_id", r(t).alias("t"), *(r(v).alias(a) for v, a in zip(p, "xyz", strict=True)))


@query(f"WITH {V.SHAPES}, {_UNIT} SELECT vec_id, true AS on_circle, true AS in_plane FROM un")
def e07_circle_point(spark, sf_dir):
    """A point of a circle lies at the radius and in the circle's plane."""
    radius = F.abs(F.col("e6")) + F.lit(0.5)
    n = Vec3.columns("n")
    p = S.circle_point(V.e(0), n, radius, F.col("label") * F.lit(0.3))
    v = p.minus(V.e(0))
    return _unit_shapes(spark, sf_dir).select("vec_id", (F.abs(v.length() - radius) < 1e-9).alias("on_circle"), (F.abs(v.dot(n)) < 1e-9).alias("in_plane"))


# Intersections ----------------------------------------------------------------------------------------------------

_IB = f"""ib AS (SELECT vec_id, least(e0,e3) AS l0, least(e1,e4) AS l1, least(e2,e5) AS l2, greatest(e0,e3) AS h0, greatest(e1,e4) AS h1, greatest(e2,e5) AS h2, e6*3 AS o0, e7*3 AS o1, e8*3 AS o2, (e0+e3)/2 - e6*3 AS d0, (e1+e4)/2 - e7*3 AS d1, (e2+e5)/2 - e8*3 + e9*0.05::DOUBLE AS d2 FROM sh),
    ic AS (SELECT *, {", ".join(f"CASE WHEN o{k} < l{k} THEN l{k} WHEN o{k} > h{k} THEN h{k} END AS c{k}" for k in range(3))} FROM ib),
    it AS (SELECT *, {", ".join(f"CASE WHEN c{k} IS NOT NULL AND d{k} <> 0 THEN (c{k}-o{k})/d{k} ELSE -1.0::DOUBLE END AS t{k}" for k in range(3))} FROM ic),
    iw AS (SELECT *, greatest(t0,t1,t2) AS t, CASE WHEN t0 = greatest(t0,t1,t2) THEN 0 WHEN t1 = greatest(t0,t1,t2) THEN 1 ELSE 2 END AS w FROM it),
    ip AS (SELECT *, {", ".join(f"CASE WHEN w = {k} THEN c{k} ELSE o{k}+t*d{k} END AS p{k}" for k in range(3))} FROM iw),
    ik AS (SELECT *, CASE WHEN c0 IS NULL AND c1 IS NULL AND c2 IS NULL THEN 'inside' WHEN t < 0 THEN 'none' WHEN {" AND ".join(f"(w = {k} OR p{k} BETWEEN l{k} AND h{k})" for k in range(3))} THEN 'through' ELSE 'none' END AS kind FROM ip)"""


@query(f"WITH {V.SHAPES}, {_IB} SELECT vec_id, kind, " + ", ".join(f"CASE kind WHEN 'inside' THEN {rs(f'o{k}')} WHEN 'through' THEN {rs(f'p{k}')} END AS {a}" for k, a in enumerate("xyz")) + " FROM ik")
def i01_box_ray(spark, sf_dir):
    p, q = V.e(0), V.e(3)
    box = S.Box(Vec3(*(F.least(a, b) for a, b in zip(p, q, strict=True))), Vec3(*(F.greatest(a, b) for a, b in zip(p, q, strict=True))))
    o = V.e(6).times(3.0)
    toward = p.plus(q).over(2.0).minus(o)
    st = S.Stage(V.shapes(spark, sf_dir))
    hit = S.box_ray(box, o, Vec3(toward.x, toward.y, toward.z + F.col("e9") * F.lit(0.05)), st)
    return st.df.select("vec_id", hit["kind"].alias("kind"), *(r(hit[a]).alias(a) for a in "xyz"))


_SG = f"""sg AS (SELECT vec_id, nx, ny, nz, e0*nx+e1*ny+e2*nz AS pd, e6 AS ax, e7 AS ay, e8 AS az, e9 AS bx, e10 AS b_y, e11 AS bz FROM un),
    s1 AS (SELECT *, nx*ax+ny*ay+nz*az-pd AS d0, nx*bx+ny*b_y+nz*bz-pd AS d1, sqrt((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)+(bz-az)*(bz-az)) AS len FROM sg WHERE (bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)+(bz-az)*(bz-az) > 0),
    s2 AS (SELECT *, (bx-ax)/len AS ux, (b_y-ay)/len AS uy, (bz-az)/len AS uz FROM s1), s3 AS (SELECT *, ux*nx+uy*ny+uz*nz AS bottom FROM s2), s4 AS (SELECT *, (pd-(ax*nx+ay*ny+az*nz))/bottom AS t FROM s3 WHERE abs(bottom) > 1e-12),
    s5 AS (SELECT *, CASE WHEN t < 0 OR t > len THEN CASE WHEN d0 < 0 THEN 'below' ELSE 'above' END ELSE 'intersect' END AS kind, CASE WHEN t < 0 OR t > len THEN CASE WHEN d0 < 0 THEN CASE WHEN d0 > d1 THEN 1 ELSE 0 END ELSE CASE WHEN d0 < d1 THEN 0 ELSE 1 END END END AS e FROM s4),
    s6 AS (SELECT *, CASE e WHEN 0 THEN ax-nx*d0 WHEN 1 THEN bx-nx*d1 ELSE ax+ux*t END AS x, CASE e WHEN 0 THEN ay-ny*d0 WHEN 1 THEN b_y-ny*d1 ELSE ay+uy*t END AS y, CASE e WHEN 0 THEN az-nz*d0 WHEN 1 THEN bz-nz*d1 ELSE az+uz*t END AS z,
        CASE WHEN kind = 'above' THEN least(d0,d1) END AS distance, CASE WHEN kind = 'below' THEN greatest(-d0,-d1) WHEN kind = 'intersect' THEN CASE WHEN d0 >= 0 THEN -d1 ELSE -d0 END END AS interpen, CASE WHEN kind = 'below' THEN least(-d0,-d1) END AS depth FROM s5)"""


def _segments(spark, sf_dir):
    a, b = V.e(6), V.e(9)
    plane = S.Plane.through(V.e(0), Vec3.columns("n"))
    tilted = F.abs(b.minus(a).normalized().dot(plane.normal)) > 1e-12
    return _unit_shapes(spark, sf_dir).filter(tilted), plane, a, b


@query(f"WITH {V.SHAPES}, {_UNIT}, {_SG} SELECT vec_id, kind, {rs('x')} AS x, {rs('y')} AS y, {rs('z')} AS z, {rs('distance')} AS distance, {rs('interpen')} AS interpen, {rs('depth')} AS depth, CASE WHEN kind = 'intersect' THEN d0 >= 0 END AS start_in_front FROM s6")
def i02_plane_segment(spark, sf_dir):
    s, plane, a, b = _segments(spark, sf_dir)
    st = S.Stage(s)
    hit = S.plane_segment(plane, a, b, hold=st)
    return st.df.select("vec_id", hit["kind"].alias("kind"), *(r(hit[k]).alias(k) for k in ("x", "y", "z", "distance", "interpen", "depth")), hit["start_in_front"].alias("start_in_front"))


@query(f"""WITH {V.SHAPES}, {_UNIT}, {_SG}, cp AS (SELECT *, CASE WHEN kind = 'above' AND distance > 0.05::DOUBLE THEN 'above' WHEN kind = 'below' AND depth > 0.05::DOUBLE THEN 'below' ELSE 'intersect' END AS k FROM s6)
    SELECT vec_id, k AS kind, {rs('x')} AS x, {rs('y')} AS y, {rs('z')} AS z, CASE WHEN k = 'above' THEN {rs('distance - 0.05::DOUBLE')} END AS distance, CASE WHEN k = 'above' THEN NULL WHEN kind = 'above' THEN {rs('0.05::DOUBLE - distance')} ELSE {rs('interpen + 0.05::DOUBLE')} END AS interpen, CASE WHEN k = 'below' THEN {rs('depth - 0.05::DOUBLE')} END AS depth FROM cp""")
def i03_capsule_plane(spark, sf_dir):
    s, plane, a, b = _segments(spark, sf_dir)
    st = S.Stage(s)
    hit = S.capsule_plane(plane, a, b, F.lit(0.05), hold=st)
    return st.df.select("vec_id", hit["kind"].alias("kind"), *(r(hit[k]).alias(k) for k in ("x", "y", "z", "distance", "interpen", "depth")))


_CP = f"""c0 AS (SELECT vec_id, e0, e1, e2, nx, ny, nz, abs(e6) + 0.1::DOUBLE AS rad, e9/sqrt(e9*e9+e10*e10+e11*e11) AS mx, e10/sqrt(e9*e9+e10*e10+e11*e11) AS my, e11/sqrt(e9*e9+e10*e10+e11*e11) AS mz, e7 AS pd FROM un WHERE e9*e9+e10*e10+e11*e11 > 0),
    c1 AS (SELECT *, ny*mz-nz*my AS lx, nz*mx-nx*mz AS ly, nx*my-ny*mx AS lz, mx*e0+my*e1+mz*e2-pd AS cd, nx*mx+ny*my+nz*mz AS dd FROM c0),
    c2 AS (SELECT *, lx*lx+ly*ly+lz*lz AS ll FROM c1), c3 AS (SELECT *, abs(cd)/sqrt(ll) AS gap, sqrt(ll) AS sl FROM c2 WHERE ll > 1e-9),
    c4 AS (SELECT *, CASE WHEN gap > rad THEN CASE WHEN cd >= 0 THEN 'in_front' ELSE 'behind' END ELSE 'intersection' END AS kind, e0-(mx-dd*nx)*cd/ll AS kx, e1-(my-dd*ny)*cd/ll AS ky, e2-(mz-dd*nz)*cd/ll AS kz, sqrt(greatest(rad*rad-gap*gap, 0.0::DOUBLE)) AS half FROM c3)"""


@query(f"WITH {V.SHAPES}, {_UNIT}, {_CP} SELECT vec_id, kind, " + ", ".join(f"CASE WHEN kind = 'intersection' THEN {rs(f'k{a} + l{a}/sl*half')} END AS p{a}, CASE WHEN kind = 'intersection' THEN {rs(f'k{a} - l{a}/sl*half')} END AS q{a}" for a in "xyz") + " FROM c4")
def i04_circle_plane(spark, sf_dir):
    m = V.e(9)
    s = _unit_shapes(spark, sf_dir).filter(m.dot(m) > 0)
    line = Vec3.columns("n").cross(m.normalized())
    st = S.Stage(s.filter(line.dot(line) > 1e-9))
    hit = S.circle_plane(V.e(0), Vec3.columns("n"), F.abs(F.col("e6")) + F.lit(0.1), S.Plane(m.normalized(), F.col("e7")), hold=st)
    return st.df.select("vec_id", hit["kind"].alias("kind"), *(r(hit[f"{k}{a}"]).alias(f"{k}{a}") for k in "pq" for a in "xyz"))


@query(f"""WITH {V.SHAPES}, {_UNIT}, sp AS (SELECT *, nx*e6+ny*e7+nz*e8-(e0*nx+e1*ny+e2*nz) AS dd, abs(e9)+0.05::DOUBLE AS rr FROM un)
    SELECT vec_id, CASE WHEN abs(dd) < rr THEN 'circle' ELSE 'none' END AS kind, CASE WHEN abs(dd) >= rr THEN {rs('abs(dd)-rr')} END AS distance, CASE WHEN abs(dd) >= rr THEN CASE WHEN dd > 0 THEN 'above' WHEN dd < 0 THEN 'below' ELSE 'on' END END AS side,
    CASE WHEN abs(dd) < rr THEN {rs('sqrt(rr*rr-dd*dd)')} END AS radius, CASE WHEN abs(dd) < rr THEN {rs('e6-nx*dd')} END AS x, CASE WHEN abs(dd) < rr THEN {rs('e7-ny*dd')} END AS y, CASE WHEN abs(dd) < rr THEN {rs('e8-nz*dd')} END AS z FROM sp""")
def i05_sphere_plane(spark, sf_dir):
    hit = S.sphere_plane(V.e(6), F.abs(F.col("e9")) + F.lit(0.05), S.Plane.through(V.e(0), Vec3.columns("n")))
    return _unit_shapes(spark, sf_dir).select("vec_id", hit["kind"].alias("kind"), r(hit["distance"]).alias("distance"), hit["side"].alias("side"), r(hit["radius"]).alias("radius"), *(r(hit[a]).alias(a) for a in "xyz"))


@query(f"""WITH {V.SHAPES}, {_UNIT}, q0 AS (SELECT *, nx*nx+ny*ny+nz*nz AS a, 2*(nx*(e0-e6)+ny*(e1-e7)+nz*(e2-e8)) AS b, (e0-e6)*(e0-e6)+(e1-e7)*(e1-e7)+(e2-e8)*(e2-e8)-(abs(e9)+0.1::DOUBLE)*(abs(e9)+0.1::DOUBLE) AS c FROM un),
    q1 AS (SELECT *, CASE WHEN b*b-4*a*c >= 0 THEN (-b-sqrt(b*b-4*a*c))/(2*a) END AS lo, CASE WHEN b*b-4*a*c >= 0 THEN (-b+sqrt(b*b-4*a*c))/(2*a) END AS hi FROM q0), q2 AS (SELECT *, CASE WHEN lo >= 0 THEN lo WHEN hi >= 0 THEN hi END AS t FROM q1)
    SELECT vec_id, {rs('t')} AS t, {rs('e0+nx*t')} AS x, {rs('e1+ny*t')} AS y, {rs('e2+nz*t')} AS z FROM q2""")
def i06_ray_sphere(spark, sf_dir):
    st = S.Stage(_unit_shapes(spark, sf_dir))
    hit = S.ray_sphere(V.e(0), Vec3.columns("n"), V.e(6), F.abs(F.col("e9")) + F.lit(0.1), st)
    return st.df.select("vec_id", *(r(hit[k]).alias(k) for k in ("t", "x", "y", "z")))


_TRI = """t0 AS (SELECT vec_id, e0, e1, e2, e3, e4, e5, e6, e7, e8, e9*5 AS ox, e10*5 AS oy, e11*5 AS oz, (e0+e3+e6)/3 - e9*5 + e1*0.2::DOUBLE AS dx, (e1+e4+e7)/3 - e10*5 AS dy, (e2+e5+e8)/3 - e11*5 AS dz, e3-e0 AS ax, e4-e1 AS ay, e5-e2 AS az, e6-e0 AS bx, e7-e1 AS b_y, e8-e2 AS bz FROM sh),
    t1 AS (SELECT *, dy*bz-dz*b_y AS hx, dz*bx-dx*bz AS hy, dx*b_y-dy*bx AS hz, ox-e0 AS sx, oy-e1 AS sy, oz-e2 AS sz FROM t0), t2 AS (SELECT *, ax*hx+ay*hy+az*hz AS det, sy*az-sz*ay AS kx, sz*ax-sx*az AS ky, sx*ay-sy*ax AS kz FROM t1),
    t3 AS (SELECT *, CASE WHEN abs(det) > 2.220446049250313e-16 THEN (sx*hx+sy*hy+sz*hz)/det END AS u, CASE WHEN abs(det) > 2.220446049250313e-16 THEN (dx*kx+dy*ky+dz*kz)/det END AS v, CASE WHEN abs(det) > 2.220446049250313e-16 THEN (bx*kx+b_y*ky+bz*kz)/det END AS t FROM t2),
    t4 AS (SELECT *, coalesce(u >= 0 AND u <= 1 AND v >= 0 AND u+v <= 1 AND t > 2.220446049250313e-16, false) AS hit FROM t3)"""


@query(f"WITH {V.SHAPES}, {_TRI} SELECT vec_id, " + ", ".join(f"CASE WHEN hit THEN {rs(v)} END AS {k}" for k, v in {"distance": "t", "x": "ox+dx*t", "y": "oy+dy*t", "z": "oz+dz*t", "u": "u", "v": "v", "w": "1-u-v"}.items()) + " FROM t4")
def i07_ray_triangle(spark, sf_dir):
    a, b, c, o = V.e(0), V.e(3), V.e(6), V.e(9).times(5.0)
    m = a.plus(b).plus(c).over(3.0).minus(o)
    st = S.Stage(V.shapes(spark, sf_dir))
    hit = S.ray_triangle(o, Vec3(m.x + F.col("e1") * F.lit(0.2), m.y, m.z), a, b, c, st)
    return st.df.select("vec_id", *(r(hit[k]).alias(k) for k in ("distance", "x", "y", "z", "u", "v", "w")))


def _sa_sql() -> str:
    edge = []
    for i in range(3):
        p, q = [f"(e{3 * i + k} - o{k})" for k in range(3)], [f"(e{3 * ((i + 1) % 3) + k} - o{k})" for k in range(3)]
        cr = [f"({p[(k + 1) % 3]}*{q[(k + 2) % 3]} - {p[(k + 2) % 3]}*{q[(k + 1) % 3]})" for k in range(3)]
        n = lambda v: "sqrt(" + "+".join(f"{x}*{x}" for x in v) + ")"
        dot = "+".join(f"{a}*{b}" for a, b in zip(p, q, strict=True))
        edge.append(f"CASE WHEN {n(cr)} > 0 AND {n(p)} > 0 AND {n(q)} > 0 THEN {cr[2]}/{n(cr)} * acos(least(greatest(({dot})/({n(p)}*{n(q)}), -1.0::DOUBLE), 1.0::DOUBLE)) ELSE 0 END")
    return " + ".join(edge)


@query(f"WITH {V.SHAPES}, o AS (SELECT *, 0.0::DOUBLE AS o0, 0.0::DOUBLE AS o1, -1.0::DOUBLE AS o2 FROM sh) SELECT vec_id, {rs(f'-({_sa_sql()}) / {d(2 * math.pi)}')} AS sa FROM o")
def i08_solid_angle(spark, sf_dir):
    st = S.Stage(V.shapes(spark, sf_dir))
    sa = S.solid_angle(Vec3.of(0, 0, -1), Vec3.of(0, 0, 1), [V.e(0), V.e(3), V.e(6)], st)
    return st.df.select("vec_id", r(sa).alias("sa"))
