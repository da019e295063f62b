"""Meshes and index tables as DataFrames: vertices (obj, idx, x, y, z) and faces (obj, idx, i0, i1, i2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrella.functions.geometry import Box
from terrella.functions.vectors import Quaternion, Vec3

#: Corners of a box (0 low, 1 high along x, y, z) and its twelve faces, two for each side.
_BOX_VERTS = [(0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0), (1, 1, 1)]
_BOX_SIDES = [(6, 0, 1, 2), (2, 1, 7, 3), (3, 7, 4, 5), (5, 4, 0, 6), (0, 4, 7, 1), (5, 6, 2, 3)]


def box_verts(df: DataFrame, obj: str, box: Box) -> DataFrame:
    corner = lambda i, v: F.struct(F.lit(i).alias("idx"), *((box.hi if v[k] else box.lo)[k].alias(a) for k, a in enumerate("xyz")))
    return df.select(F.col(obj).alias("obj"), F.inline(F.array(*(corner(i, v) for i, v in enumerate(_BOX_VERTS)))))


def _faces(df: DataFrame, obj: str, faces: list[tuple[int, int, int]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("idx"), *(F.lit(v).alias(f"i{k}") for k, v in enumerate(f))) for i, f in enumerate(faces)))
    return df.select(F.col(obj).alias("obj"), F.inline(rows))


def box_faces(df: DataFrame, obj: str) -> DataFrame:
    return _faces(df, obj, [f for a, b, c, d in _BOX_SIDES for f in ((a, b, c), (a, c, d))])


def _arc_from_y(axis: Vec3) -> Quaternion:
    """The shortest turn from +Y to a unit vector; half a turn about X for -Y."""
    w = 1.0 + axis.y
    n = F.sqrt(w * w + axis.z * axis.z + axis.x * axis.x)
    flip = w <= 1e-12
    part = lambda c, other: F.when(flip, F.lit(other)).otherwise(c / F.when(n > 0, n))
    return Quaternion(part(w, 0.0), part(axis.z, 1.0), part(F.lit(0.0), 0.0), part(-axis.x, 0.0))


def cylinder_verts(df: DataFrame, obj: str, origin: Vec3, axis: Vec3, length: Column, r0: Column, r1: Column, detail: int) -> DataFrame:
    """Two rings of ``detail`` vertices, the bottom one first; a cone where the radii differ."""
    named = df.select(F.col(obj).alias("obj"), *origin.named("o"), *axis.named("a"), length.alias("__len"), r0.alias("__r0"), r1.alias("__r1"))
    rings = named.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(2 * detail - 1))))
    top = F.col("idx") >= detail
    angle = F.lit(2 * math.pi / detail) * (F.col("idx") % detail)
    r = F.when(top, F.col("__r1")).otherwise(F.col("__r0"))
    local = Vec3(F.cos(angle) * r, F.when(top, F.col("__len")).otherwise(0.0), F.sin(angle) * r)
    p = Vec3.columns("o").plus(local.rotated(_arc_from_y(Vec3.columns("a"))))
    return rings.select("obj", "idx", *p.named(""))


def cylinder_faces(df: DataFrame, obj: str, detail: int) -> DataFrame:
    n = detail
    sides = [f for i in range(n) for f in (((i + 1) % n, i, i + n), ((i + 1) % n + n, (i + 1) % n, i + n))]
    caps = [((i + 1) % n, 0, i) for i in range(1, n)] + [(i + n, n, (i + 1) % n + n) for i in range(1, n)]
    return _faces(df, obj, sides + caps)


def joined_meshes(parts: list[tuple[DataFrame, DataFrame, int]]) -> tuple[DataFrame, DataFrame]:
    """Meshes of the same objects as one: vertex numbers of later parts are moved past those of earlier ones."""
    verts = faces = None
    base_v = base_f = 0
    for v, f, (n_v, n_f) in parts:
        v = v.withColumn("idx", F.col("idx") + base_v)
        f = f.withColumn("idx", F.col("idx") + base_f).withColumns({c: F.col(c) + base_v for c in ("i0", "i1", "i2")})
        verts, faces = (v, f) if verts is None else (verts.unionByName(v), faces.unionByName(f))
        base_v, base_f = base_v + n_v, base_f + n_f
    return verts, faces


def rebased(meshes: DataFrame, group: str, order: str) -> DataFrame:
    """Union of meshes within a group: each row (one a mesh, with n_verts) gets the base of its vertex numbers."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return meshes.withColumn("base", F.coalesce(F.sum("n_verts").over(before), F.lit(0)))


def arrow(df: DataFrame, obj: str, origin: Vec3, axis: Vec3, length: Column, radius: Column, detail: int) -> tuple[DataFrame, DataFrame]:
    """A shaft of nine tenths and a cone of one tenth of the length, 1.4 times as wide at its foot."""
    shaft = cylinder_verts(df, obj, origin, axis, length * 0.9, radius, radius, detail)
    head = cylinder_verts(df, obj, origin.plus(axis.times(length * 0.9)), axis, length * 0.1, radius * 1.4, radius * 0.0, detail)
    size = (2 * detail, 2 * detail + 2 * (detail - 1))
    return joined_meshes([(shaft, cylinder_faces(df, obj, detail), size), (head, cylinder_faces(df, obj, detail), size)])


_T = (1 + math.sqrt(5)) / 2
_ICO_VERTS = [(-1, _T, 0), (1, _T, 0), (-1, -_T, 0), (1, -_T, 0), (0, -1, _T), (0, 1, _T), (0, -1, -_T), (0, 1, -_T), (_T, 0, -1), (_T, 0, 1), (-_T, 0, -1), (-_T, 0, 1)]
_ICO_FACES = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]


def unit_sphere(spark: SparkSession, detail: int) -> tuple[DataFrame, DataFrame]:
    """A subdivided icosahedron: verts (idx, x, y, z) and faces (idx, i0, i1, i2).

    Each level makes four faces of each and three vertices of its own for each face.  A face carries its corners, so a
    level is one projection; numbers follow from the face's number alone.
    """
    norm = math.sqrt(1 + _T * _T)
    point = lambda k: tuple(c / norm for c in _ICO_VERTS[k])
    verts = spark.createDataFrame([(k, *point(k)) for k in range(12)], "idx int, x double, y double, z double")
    corner = "struct<i:int,x:double,y:double,z:double>"
    faces = spark.createDataFrame([(n, *((k, *point(k)) for k in f)) for n, f in enumerate(_ICO_FACES)], f"idx int, c0 {corner}, c1 {corner}, c2 {corner}")
    n_faces, base = 20, 12
    for _ in range(detail):
        mid = lambda a, b: Vec3.field(a).plus(Vec3.field(b).minus(Vec3.field(a)).over(2.0)).normalized()
        new = [mid("c0", "c1"), mid("c1", "c2"), mid("c2", "c0")]
        at = faces.select("idx", "c0", "c1", "c2", *(F.struct((F.col("idx") * 3 + base + k).cast("int").alias("i"), *v.named("")).alias(n) for k, (v, n) in enumerate(zip(new, "abc", strict=True))))
        verts = verts.unionByName(at.select(F.inline(F.array("a", "b", "c"))).withColumnRenamed("i", "idx"))
        four = [("c0", "a", "c"), ("c1", "b", "a"), ("c2", "c", "b"), ("a", "b", "c")]
        kids = F.array(*(F.struct((F.col("idx") * 4 + k).cast("int").alias("idx"), *(F.col(n).alias(f"c{i}") for i, n in enumerate(f))) for k, f in enumerate(four)))
        faces = at.select(F.inline(kids))
        base, n_faces = base + 3 * n_faces, 4 * n_faces
    return verts, faces.select("idx", *(F.col(f"c{k}.i").alias(f"i{k}") for k in range(3)))


def grid_tris(grids: DataFrame, keys: list[str]) -> DataFrame:
    """Two triangles for each cell of grids (width, height in cells): idx, i0, i1, i2."""
    cells = grids.withColumn("y", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))
    at = lambda x, y: ((F.col("y") + y) * (F.col("width") + 1) + F.col("x") + x).cast("int")
    pair = F.array(F.struct(F.lit(0).alias("k"), at(0, 0).alias("i0"), at(1, 0).alias("i1"), at(1, 1).alias("i2")), F.struct(F.lit(1).alias("k"), at(0, 0).alias("i0"), at(1, 1).alias("i1"), at(0, 1).alias("i2")))
    return cells.select(*keys, F.col("y"), F.col("x"), "width", F.inline(pair)).select(*keys, (2 * (F.col("y") * F.col("width") + F.col("x")) + F.col("k")).cast("int").alias("idx"), "i0", "i1", "i2")


def grid_edges(grids: DataFrame, keys: list[str]) -> DataFrame:
    """Right, up and diagonal edge of each cell, and the far borders: i0, i1."""
    cells = grids.withColumn("y", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, width - 1)")))
    at = lambda x, y: ((F.col("y") + y) * (F.col("width") + 1) + F.col("x") + x).cast("int")
    edge = lambda a, b, when=None: F.struct(at(*a).alias("i0"), at(*b).alias("i1")) if when is None else F.when(when, F.struct(at(*a).alias("i0"), at(*b).alias("i1")))
    five = F.array(edge((0, 0), (1, 0)), edge((0, 0), (0, 1)), edge((0, 0), (1, 1)), edge((1, 0), (1, 1), F.col("x") == F.col("width") - 1), edge((0, 1), (1, 1), F.col("y") == F.col("height") - 1))
    return cells.select(*keys, F.inline(F.filter(five, lambda e: e.isNotNull())))


def height_field(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Grid samples (gx, gy, lat, lon, asl, level) as one row a grid: floor, centre, cell scale and rows of heights."""
    rows = samples.groupBy(*keys, "level", "gy").agg(F.sort_array(F.collect_list(F.struct("gx", "asl"))).alias("row"), F.min("asl").alias("lo"), F.min("lat").alias("lat"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    out = rows.groupBy(*keys, "level").agg(F.min("lo").alias("floor_asl"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("w").alias("w"), F.max("e").alias("e"), F.sort_array(F.collect_list(F.struct("gy", "row"))).alias("rows"))
    lat = (F.col("s") + F.col("n")) / 2
    pixel = F.lit(30.0) * F.pow(F.lit(2.0), "level")
    heights = F.transform("rows", lambda r: F.transform(r["row"], lambda s: s["asl"] - F.col("floor_asl")))
    width, height = F.size(F.col("rows")[0]["row"]) - 1, F.size("rows") - 1
    return out.select(*keys, "level", "floor_asl", lat.alias("center_lat"), ((F.col("w") + F.col("e")) / 2).alias("center_lon"), (pixel * F.cos(F.radians(lat)) * width).alias("size_x"), (pixel * height).alias("size_z"), heights.alias("heights"))


def mesh_corners(tris: DataFrame, verts: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Triangles with the positions of their corners, by one equality join on the exploded corners.

    Vertices are never broadcast: where they are exploded from few rows, they look small to the planner.  ``parts`` fixes
    the number of tasks, so that a caller who knows the number of rows can bound what one task sorts.
    """
    spread = lambda df, *by: df.repartition(parts, *keys, *by) if parts else df
    corners = tris.select(*keys, F.col("idx").alias("tri"), F.posexplode(F.array("i0", "i1", "i2")).alias("k", "idx"))
    hit = spread(corners, "idx").join(spread(verts, "idx").hint("merge"), [*keys, "idx"])
    return spread(hit, "tri").groupBy(*keys, "tri").agg(*(F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{a}{k}") for k in range(3) for a in "xyz"))


def transformed(verts: DataFrame, origin: Vec3, turn: Quaternion) -> DataFrame:
    return verts.withColumns(dict(zip("xyz", origin.plus(Vec3.columns("").rotated(turn)), strict=True)))


def unshared(tris: DataFrame, verts: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Three vertices of its own for each triangle, in flipped order, with the face's normal."""
    t = mesh_corners(tris, verts, keys, parts)
    a, b, c = (Vec3(*(F.col(f"{x}{k}") for x in "xyz")) for k in range(3))
    n = c.minus(a).cross(b.minus(a)).normalized_or_zero()
    three = F.array(*(F.struct((F.col("tri") * 3 + k).alias("idx"), *v.named(""), *n.named("n")) for k, v in enumerate((a, c, b))))
    return t.select(*keys, F.inline(three))


# Triangle subdivision ---------------------------------------------------------------------------------------------

def _halved(spark: SparkSession, level: int, s: int) -> DataFrame:
    """All triangles of a level: path (base 4, a digit a level) and corners, folded from the path's digits."""
    start = f"named_struct('x0', 0, 'y0', {s}, 'x1', {-s}, 'y1', {-s}, 'x2', {s}, 'y2', {-s})"
    half = lambda a, b: (f"(t.x{a} + t.x{b}) DIV 2", f"(t.y{a} + t.y{b}) DIV 2")
    own = lambda a: (f"t.x{a}", f"t.y{a}")
    a, b, c = half(0, 1), half(1, 2), half(2, 0)
    kids = [(own(0), a, c), (a, own(1), b), (c, b, own(2)), (b, c, a)]
    kid = lambda k: "named_struct(" + ", ".join(f"'x{i}', cast({x} AS int), 'y{i}', cast({y} AS int)" for i, (x, y) in enumerate(k)) + ")"
    step = "CASE shiftright(id, 2 * j) & 3 " + " ".join(f"WHEN {n} THEN {kid(k)}" for n, k in enumerate(kids[:3])) + f" ELSE {kid(kids[3])} END"
    digits = f"sequence({level - 1}, 0, -1)" if level else "cast(array() AS array<int>)"
    return spark.range(4**level).select(F.col("id").alias("path"), F.expr(f"aggregate({digits}, {start}, (t, j) -> {step})").alias("t")).select("path", "t.*")


def subdivided(spark: SparkSession, level: int) -> tuple[DataFrame, DataFrame]:
    """A triangle halved ``level`` times: tris (path, corners) and deps (idx and the edge lo, hi that it halves).

    Vertices are numbered level by level in the order in which a walk over the triangles first meets them, so the table
    of a level starts with that of the level before.  Coordinates are whole numbers (2**(level + 1) to the apex).  All
    levels' midpoints are found and numbered at once, and the corners of the last level are looked up by their place.
    The numbering is one sorted pass over the table's vertices, whose count the level fixes.
    """
    s = 1 << (level + 1)
    roots = spark.createDataFrame([(0, 0, s), (1, -s, -s), (2, s, -s)], "idx int, x int, y int")
    numbers, deps = roots, roots.select("idx", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
    if level:
        met = None
        for k in range(level):
            mids = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("path") * 3 + j).alias("at"), F.expr(f"(x{a} + x{b}) DIV 2").cast("int").alias("x"), F.expr(f"(y{a} + y{b}) DIV 2").cast("int").alias("y"), *(F.col(f"{c}{e}").alias(f"{c}{n}") for n, e in (("a", a), ("b", b)) for c in "xy")) for j, (a, b) in enumerate(((0, 1), (1, 2), (2, 0)))))
            one = _halved(spark, k, s).select(F.inline(mids))
            met = one if met is None else met.unionByName(one)
        first = met.groupBy("x", "y").agg(F.min(F.struct("k", "at", "xa", "ya", "xb", "yb")).alias("f"))
        own = first.select((F.row_number().over(Window.orderBy("f.k", "f.at")) + 2).cast("int").alias("idx"), "x", "y", "f.xa", "f.ya", "f.xb", "f.yb")
        numbers = roots.unionByName(own.select("idx", "x", "y"))
        end = lambda n: numbers.select(F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("idx").alias(f"i{n}"))
        deps = deps.unionByName(own.join(end("a"), ["xa", "ya"]).join(end("b"), ["xb", "yb"]).select("idx", F.least("ia", "ib").alias("lo"), F.greatest("ia", "ib").alias("hi")))
    corners = _halved(spark, level, s).select("path", F.posexplode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)))).alias("k", "c")).select("path", "k", "c.x", "c.y")
    named = corners.join(numbers, ["x", "y"]).groupBy("path").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{a}{k}") for k in range(3) for c, a in (("idx", "i"), ("x", "x"), ("y", "y"))))
    return named, deps


def row_bins(tris: DataFrame) -> DataFrame:
    """Triangles with their row (lo, hi of y), leftmost x and the corner furthest right."""
    right = F.greatest("x0", "x1", "x2")
    return tris.select("path", "i0", "i1", "i2", F.least("y0", "y1", "y2").alias("lo"), F.greatest("y0", "y1", "y2").alias("hi"), F.least("x0", "x1", "x2").alias("leftmost"), F.when(F.col("x0") == right, F.col("i0")).when(F.col("x1") == right, F.col("i1")).otherwise(F.col("i2")).alias("rightmost"))


def sorted_rows(tris: DataFrame) -> DataFrame:
    """One row a bin: its triangles sorted by leftmost x (then path), and its number from the top."""
    rows = row_bins(tris).groupBy("lo", "hi").agg(F.sort_array(F.collect_list(F.struct("leftmost", "path", "i0", "i1", "i2", "rightmost"))).alias("t"))
    return rows.withColumn("bin", F.row_number().over(Window.orderBy(F.desc("lo"))) - 1)


def row_pairs(tris: DataFrame) -> DataFrame:
    """Pairs of rows (the bins 2k and 2k + 1): pair, a and b, arrays of triangles.  A lone row has b null."""
    rows = sorted_rows(tris).withColumn("pair", F.floor(F.col("bin") / 2))
    return rows.groupBy("pair").agg(F.max(F.when(F.col("bin") % 2 == 0, F.col("t"))).alias("a"), F.max(F.when(F.col("bin") % 2 == 1, F.col("t"))).alias("b"))


WINDINGS = {"full": (True, True), "missing0": (False, True), "missing2": (True, False), "missing20": (False, False)}


def _i(tri: str, corners: str) -> str:
    return ", ".join(f"{tri}.i{c}" for c in corners)


def _emit(*parts: str) -> Column:
    return F.expr("concat(" + ", ".join(p if p.startswith(("flatten", "transform")) else f"array({p})" for p in parts) + ")")


def _indices(pairs: DataFrame, lone: Column, top: dict[str, Column], rest: dict[str, Column], level: int) -> DataFrame:
    out = None
    for name in WINDINGS:
        value = lone if level == 0 else F.when(F.col("pair") == 0, top[name]).otherwise(rest[name])
        rows = pairs.select(F.lit(level).alias("level"), F.lit(name).alias("winding"), "pair", F.posexplode(value).alias("k", "index"))
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("level", "winding").orderBy("pair", "k")
    return out.select("level", "winding", (F.row_number().over(order) - 1).cast("int").alias("pos"), F.col("index").cast("int"))


def line_list(spark: SparkSession, level: int) -> DataFrame:
    """Wireframe: pairs of indices for each winding."""
    pairs = row_pairs(subdivided(spark, level)[0])
    all_ = lambda t: _i(t, "011220")
    t0, t1, t2 = "a[0]", "b[0]", "b[2]"
    top = {
        "full": _emit(all_(t0), all_(t1), all_(t2)),
        "missing2": _emit(_i(t0, "0"), _i(t2, "2"), _i(t2, "2"), _i(t2, "1"), _i(t2, "1"), _i(t0, "0"), all_(t1), _i(t0, "0"), _i(t1, "0")),
        "missing0": _emit(_i(t0, "0"), _i(t1, "1"), _i(t1, "1"), _i(t1, "2"), _i(t1, "2"), _i(t0, "0"), all_(t2), _i(t0, "0"), _i(t2, "0")),
        "missing20": _emit(_i(t0, "0"), _i(t1, "1"), _i(t1, "1"), _i(t2, "2"), _i(t2, "2"), _i(t0, "0"), _i(t0, "0"), _i(t1, "2")),
    }
    inner = lambda r: f"flatten(transform(slice({r}, 2, greatest(0, size({r}) - 3)), (t, n) -> IF(n % 2 = 1, array({_i('t', '1220')}), array({_i('t', '01')}))))"
    fa, fb, la, lb = "a[0]", "b[0]", "a[size(a) - 1]", "b[size(b) - 1]"
    left = {True: [all_(fa), all_(fb)], False: [_i(fa, "0"), _i(fb, "1"), _i(fb, "1"), _i(fa, "2"), _i(fa, "20"), _i(fb, "12")]}
    right = {True: [all_(la), all_(lb)], False: [_i(la, "01"), _i(la, "1"), _i(lb, "2"), _i(lb, "2"), _i(la, "0"), _i(lb, "21")]}
    rest = {name: _emit(*left[s0], inner("a"), inner("b"), *right[s2]) for name, (s0, s2) in WINDINGS.items()}
    return _indices(pairs, _emit(all_("a[0]")), top, rest, level)


def triangle_strip(spark: SparkSession, level: int) -> DataFrame:
    """Triangle strips for each winding; repeated indices make the triangles without area between runs."""
    pairs = row_pairs(subdivided(spark, level)[0])
    t0, t1, t2 = "a[0]", "b[0]", "b[2]"
    top = {
        "full": _emit(_i(t0, "012"), _i(t1, "2"), _i(t2, "22"), _i(t1, "0"), _i(t1, "0211")),
        "missing2": _emit(_i(t2, "2"), _i(t0, "0"), _i(t1, "201")),
        "missing0": _emit(_i(t2, "201"), _i(t0, "0"), _i(t1, "1")),
        "missing20": _emit(_i(t2, "2"), _i(t0, "0"), _i(t1, "211")),
    }
    fa, fb, la, lb = "a[0]", "b[0]", "a[size(a) - 1]", "b[size(b) - 1]"
    left = {True: [_i(fa, "0"), _i(fb, "1112"), _i(fa, "1202")], False: [_i(fa, "0"), _i(fb, "222"), _i(fa, "2"), _i(fb, "1"), _i(fa, "002")]}
    upper, lower = "transform(slice(a, 2, greatest(0, size(a) - 2)), t -> t.rightmost)", "transform(slice(b, 2, greatest(0, size(b) - 3)), t -> t.rightmost)"
    right = {True: [_i(la, "2"), _i(lb, "22"), _i(la, "2100")], False: [_i(la, "0"), _i(lb, "22")]}
    rest = {name: _emit(*left[s0], upper, _i(la, "11"), _i(fb, "002"), lower, *right[s2], _i(fb, "11")) for name, (s0, s2) in WINDINGS.items()}
    return _indices(pairs, _emit(_i("a[0]", "012")), top, rest, level)


def index_tables(spark: SparkSession, max_level: int, strips: bool = False) -> DataFrame:
    """All tables for levels 0 to ``max_level`` and the four windings."""
    out = None
    for level in range(max_level + 1):
        t = triangle_strip(spark, level) if strips else line_list(spark, level)
        out = t if out is None else out.unionByName(t)
    return out


def table_ranges(tables: DataFrame) -> DataFrame:
    """Size and start of each table when all are laid end to end by level and winding."""
    sizes = tables.groupBy("level", "winding").agg(F.count("*").alias("n"))
    before = Window.orderBy("level", "winding").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
