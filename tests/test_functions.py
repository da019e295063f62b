"""Known values of units, scalars, geodesy, vectors, shapes and intersections."""

import math

import pytest
from pyspark.sql import functions as F
from terrella.functions import geodesy as G
from terrella.functions import geometry as S
from terrella.functions import levels as L
from terrella.functions import scalars as K
from terrella.functions import units as U
from terrella.functions.units import Quantity as Q
from terrella.functions.vectors import Quaternion, Vec3

R, H = 6_356_766.0, 1 / math.sqrt(2)


def values(spark, **columns):
    st = S.Stage(spark.range(1))
    return st.df.select(*(c.alias(k) for k, c in columns.items())).first()


def staged(spark, fn, *args):
    st = S.Stage(spark.range(1))
    hit = fn(*args, hold=st)
    return st.df.select(*(c.alias(k) for k, c in hit.items())).first()


def test_units(spark):
    v = values(
        spark,
        acc=(Q.of(100, "m/s^2") + Q.of(100, "ft/s^2")).column, slow=U.product(Q.of(100, "mph"), "/", Q.of(1, "h"), "m/s^2").column, vel=U.product(Q.of(100, "m/s^2"), "*", Q.of(10, "s")).column,
        spin=(Q.of(100, "rad/s") + Q.of(5732, "deg/s")).column, mps=(Q.of(100, "m/s") + Q.of(100, "mph")).column, ft2=Q.of(1, "ft^2").value("m^2"), area=(Q.of(2, "ft") * Q.of(1, "m")).column,
        side=U.product(Q.of(4, "m^2"), "/", Q.of(10, "ft")).column, vol=Q.of(1, "ft^3").value("m^3"), force=Q.of(35000, "lbf").value("N"), mass=Q.of(60000, "lb").value("kg"), rate=Q.of(100, "lb/s").value("kg/s"),
        psf=Q.of(2116.22, "psf").value("Pa"), hour=Q.of(1, "h").value("s"), arc=Q.of(1, "deg").value("arcsec"), push=U.product(Q.of(2, "lb"), "*", Q.of(3, "m/s^2"), "N").column, ratio=(Q.of(1, "km") / Q.of(1, "m")).column,
        gee=U.product(Q.of(1, "lbf"), "/", Q.of(1, "lb"), "ft/s^2").column, speed=U.product(U.product(Q.of(1, "m/s"), "*", Q.of(1, "m/s")) + U.product(Q.of(1, "m/s"), "*", Q.of(1, "m/s")), "sqrt").column, zero=(Q.of(1, "m") / Q.of(0, "s")).column,
    )
    want = dict(acc=130.48, slow=0.0124177, vel=1000, spin=200.042, mps=144.704, ft2=0.092903, area=6.561679, side=1.312335, vol=0.0283168, force=155687.7, mass=27215.5, rate=45.359237, psf=101325, hour=3600, arc=3600, push=6 * 0.45359237, ratio=1000, gee=32.174, speed=math.sqrt(2))
    for k, x in want.items():
        assert v[k] == pytest.approx(x, rel=1e-4, abs=1e-6), k
    assert v["zero"] is None
    with pytest.raises(U.UnitError):
        Q.of(1, "m") + Q.of(1, "s")
    with pytest.raises(U.UnitError):
        U.parse("furlong")
    assert U.unit_text(U.parse("ft/s^2")) == "ft/s^2" and Q.of(1, "kg*m^2").kind() == "inertia"


def test_temperature_and_ints(spark):
    v = values(spark, f=U.temperature(F.lit(100.0), "C", "F"), k=U.temperature(F.lit(32.0), "F", "K"), r=U.temperature(F.lit(0.0), "C", "R"), cut=U.temperature_int(F.lit(-3.9)), up=U.to_int(F.lit(2.5), "int"), down=U.to_int(F.lit(-2.5), "int"), hi=U.to_int(F.lit(1e30), "long"), u8=U.to_int(F.lit(-5.0), "ubyte"), nan=U.to_int(F.lit(float("nan")), "int"))
    assert (round(v["f"], 9), round(v["k"], 9), round(v["r"], 6), v["cut"], v["up"], v["down"], v["hi"], v["u8"], v["nan"]) == (212.0, 273.15, 491.67, -3, 3, -3, 2**63 - 1, 0, 0)


def test_scalars(spark):
    wraps = {-181: 179, 181: -179, 3781: -179, -3781: 179, -180: 180, 180: 180}
    v = values(spark, **{f"w{i}": K.wrap(F.lit(float(a)), -180, 180) for i, a in enumerate(wraps)}, un=K.untrunc(F.lit(-2.0)), tr=K.trunc(F.lit(-2.7)), sg=K.sign(F.lit(0.0)), lat=K.latitude_text(F.lit(-12.75)), lon=K.longitude_text(F.lit(101.0)), name=K.tile_text(F.lit("H"), F.lit(3), F.lit(12), F.lit(45)), c=K.clamp(F.lit(None).cast("double"), 0, 1))
    assert [v[f"w{i}"] for i in range(len(wraps))] == pytest.approx(list(wraps.values()), abs=1e-12)
    assert (v["un"], v["tr"], v["sg"], v["lat"], v["lon"], v["name"], v["c"]) == (-1.0, -2.0, 1.0, "S012d45m00s", "E101d00m00s", "N:H:03:0012:00000045", None)


@pytest.mark.parametrize("lat,lon,xyz", [(0, 0, (0, 0, R)), (0, 90, (-R, 0, 0)), (0, -90, (R, 0, 0)), (90, 7, (0, R, 0)), (-90, 7, (0, -R, 0)), (45, 0, (0, R * H, R * H)), (45, 90, (-R * H, R * H, 0))])
def test_cartesian(spark, lat, lon, xyz):
    p = G.cartesian(K.radians(F.lit(float(lat))), K.radians(F.lit(float(lon))), F.lit(0.0))
    a, o, h = G.geodetic(p)
    up = G.world_vector(F.lit(0.0), F.lit(math.pi / 2), K.radians(F.lit(float(lat))), K.radians(F.lit(float(lon))))
    v = values(spark, x=p.x, y=p.y, z=p.z, a=K.degrees(a), o=K.degrees(o), h=h, ux=up.x, uy=up.y, uz=up.z)
    assert (v["x"], v["y"], v["z"]) == pytest.approx(xyz, abs=1e-6)
    assert v["a"] == pytest.approx(lat, abs=1e-6) and v["h"] == pytest.approx(0, abs=1e-6)
    assert abs(lat) == 90 or v["o"] == pytest.approx(lon, abs=1e-9)
    assert (v["ux"] * R, v["uy"] * R, v["uz"] * R) == pytest.approx(xyz, abs=1e-6)


def test_boxes_of_positions(spark):
    inside = lambda w, e, lon: G.box_contains(F.lit(0.0), F.lit(float(w)), F.lit(10.0), F.lit(float(e)), F.lit(5.0), F.lit(float(lon)))
    v = values(spark, a=inside(0, 10, 10), b=inside(0, 10, 11), c=inside(170, -170, 179), d=inside(170, -170, 0))
    assert tuple(v) == (True, False, True, False)


def test_planes_and_boxes(spark):
    xy = S.Plane.axis("xy")
    c = xy.closest(Vec3.of(1, 1, -1))
    box = S.Box(Vec3.of(0, 0, 0), Vec3.of(1, 1, 1))
    other = lambda a, b: S.Box(Vec3.of(a, a, a), Vec3.of(b, b, b))
    v = values(spark, on=xy.has(Vec3.of(10, 10, 0)), off=xy.has(Vec3.of(10, 10, 0.1)), d=xy.distance_to(Vec3.of(1, 1, -1)), cz=c.z, o1=box.overlaps(other(0.5, 3)), o2=box.overlaps(other(2, 3)), e=S.Box.empty().is_degenerate(), i=S.Box.infinite().is_degenerate(), u=box.is_degenerate(), side=xy.side(Vec3.of(0, 0, -3)))
    assert tuple(v) == (True, False, -1.0, 0.0, True, False, True, True, False, "below")


def test_box_ray(spark):
    box = S.Box(Vec3.of(-1, -1, -1), Vec3.of(1, 1, 1))
    k = 1 / math.sqrt(3)
    assert staged(spark, S.box_ray, box, Vec3.of(0, 0, 0), Vec3.of(1, 0, 0))["kind"] == "inside"
    hit = staged(spark, S.box_ray, box, Vec3.of(2, 2, 2), Vec3.of(-k, -k, -k))
    assert hit["kind"] == "through" and (hit["x"], hit["y"], hit["z"]) == pytest.approx((1, 1, 1))
    assert staged(spark, S.box_ray, box, Vec3.of(2, 2, 2), Vec3.of(k, k, k))["kind"] == "none"
    assert staged(spark, S.box_ray, box, Vec3.of(0, 3, 0), Vec3.of(1, 0, 0))["kind"] == "none"


def test_plane_segment_and_capsule(spark):
    xz = S.Plane.axis("xz")
    seg = lambda a, b: staged(spark, S.plane_segment, xz, Vec3.of(*a), Vec3.of(*b))
    assert (lambda r: (r["kind"], r["distance"]))(seg((0, 1, 0), (0, 2, 1))) == ("above", 1.0)
    assert seg((0, 0, 0), (1, 0, 1))["kind"] == "coplanar"
    hit = seg((0, -1, 1), (0, 1, -1))
    assert (hit["kind"], hit["interpen"], hit["start_in_front"]) == ("intersect", 1.0, False) and (hit["x"], hit["y"], hit["z"]) == pytest.approx((0, 0, 0))
    low = seg((0, -2, 0), (1, -2, 0))
    assert (low["kind"], low["depth"]) == ("below", 2.0)
    cap = lambda a, b: staged(spark, S.capsule_plane, xz, Vec3.of(*a), Vec3.of(*b), F.lit(1.0))
    deep = cap((0, -2, 0), (0, -4, 0))
    assert (deep["kind"], deep["interpen"], deep["depth"]) == ("below", 5.0, 1.0)
    assert (lambda r: (r["kind"], r["interpen"]))(cap((0, 0.5, 0), (0, 3, 0))) == ("intersect", 0.5)
    assert cap((0, 3, 0), (0, 4, 0))["kind"] == "above" and cap((0, 1, 0), (0, 3, 0))["interpen"] == 0.0


def test_circle_and_sphere_planes(spark):
    yz = lambda d: S.Plane(Vec3.of(1, 0, 0), F.lit(float(d)))
    at = lambda d, n=(0, 1, 0): staged(spark, S.circle_plane, Vec3.of(0, 0, 0), Vec3.of(*n), F.lit(1.0), yz(d))
    hit = at(-0.5)
    assert hit["kind"] == "intersection" and sorted((hit["pz"], hit["qz"])) == pytest.approx([-math.sqrt(0.75), math.sqrt(0.75)]) and hit["px"] == pytest.approx(-0.5)
    assert (lambda r: (r["kind"], round(r["px"], 9)))(at(1)) == ("tangent", 1.0)
    assert at(10)["kind"] == "behind" and at(-10)["kind"] == "in_front" and at(1, (1, 0, 0))["kind"] == "parallel"
    tilted = staged(spark, S.circle_plane, Vec3.of(0, 0, 0), Vec3.of(0, 1, 0), F.lit(1.0), S.Plane(Vec3.of(H, H, 0), F.lit(0.25)))
    for k in "pq":
        p = [tilted[f"{k}{a}"] for a in "xyz"]
        assert sum(c * c for c in p) == pytest.approx(1) and p[1] == pytest.approx(0) and H * (p[0] + p[1]) == pytest.approx(0.25)
    ball = lambda y: values(spark, **S.sphere_plane(Vec3.of(0, 0, 0), F.lit(1.0), S.Plane(Vec3.of(0, 1, 0), F.lit(float(y)))))
    assert (ball(-2)["distance"], ball(-2)["side"], ball(2)["side"]) == (1.0, "above", "below")
    assert ball(0.5)["radius"] == pytest.approx(math.sqrt(0.75)) and ball(0.5)["y"] == pytest.approx(0.5)


def test_rays(spark):
    z = Vec3.of(0, 0, 1)
    hit = staged(spark, S.ray_sphere, Vec3.of(0, 0, 0), z, Vec3.of(0, 0, 10), F.lit(1.0))
    assert (hit["x"], hit["y"], hit["z"]) == (0.0, 0.0, 9.0)
    assert staged(spark, S.ray_sphere, Vec3.of(0, 0, 0), z, Vec3.of(0, 0, -10), F.lit(1.0))["t"] is None
    tri = [Vec3.of(10, -1, -1), Vec3.of(10, 1, -1), Vec3.of(10, 0, 1)]
    ray = lambda d: staged(spark, S.ray_triangle, Vec3.of(0, 0, 0), Vec3.of(*d), *tri)
    assert (ray((1, 0, 0))["x"], ray((1, 0, 0))["distance"]) == pytest.approx((10, 10))
    assert ray((-1, 0, 0))["distance"] is None and ray((0, 1, 0))["distance"] is None
    t, p = S.ray_approach(Vec3.of(0, 0, 0), Vec3.of(1, 0, 0), Vec3.of(3, 5, 5), Vec3.of(0, 0, 1))
    sa = lambda d, s: S.solid_angle(Vec3.of(0, 0, 0), Vec3.of(0, 0, d), [Vec3.of(-s, -s, 2), Vec3.of(-s, s, 2), Vec3.of(s, s, 2)])
    v = values(spark, t=t, x=p.x, a=sa(1, 1), b=sa(-1, 1), c=sa(1, 2), flat=S.solid_angle(Vec3.of(0, 0, 0), z, [Vec3.of(0, 0, 1), Vec3.of(0, 0, 2), Vec3.of(0, 0, 3)]))
    assert (v["t"], v["x"]) == (3.0, 3.0) and v["a"] == -v["b"] and abs(v["c"]) > abs(v["a"]) and v["flat"] == 0


def test_vectors_and_levels(spark):
    q = Vec3.of(0, 0, 1).rotated(Quaternion.about("y", F.lit(math.pi / 2)))
    v = values(spark, x=q.x, z=q.z, n=Vec3.of(0, 0, 0).normalized_or_zero().x, l45=L.level_of_meters(F.lit(45.0)), l29=L.level_of_meters(F.lit(29.0)), big=L.level_of_meters(F.lit(1e9)), d10=L.level_of_depth(F.lit(10), "heights"), d12=L.level_of_depth(F.lit(12), "heights"), vol=S.cone_volume(F.lit(1.0), F.lit(0.0), F.lit(3.0)))
    assert v["x"] == pytest.approx(1) and v["z"] == pytest.approx(0) and (v["n"], v["l45"], v["l29"], v["big"], v["d10"], v["d12"]) == (0.0, 1, 0, 9, 0, 0) and v["vol"] == pytest.approx(math.pi)
