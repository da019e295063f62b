"""Queries over tiled rasters, joins, aggregations, windows, meshes and maintenance."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from terrella.functions import geodesy as G
from terrella.functions import levels as L
from terrella.functions.geometry import Box
from terrella.functions.vectors import Vec3
from terrella.operators import mesh as M
from terrella.operators import raster as R
from terrella.plans import virtual as V
from terrella.plans.scalar_queries import r, rs
from terrella.streaming import maintenance as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}
TILE = V.TILE


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


# Levels and places ------------------------------------------------------------------------------------------------

_M, _S = "(10 + (c_custkey * 7) % 20000)", "(0.5::DOUBLE + (c_custkey * 11) % 5000)"


def _level_sql(x: str, unit: float, top: int) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {unit * 2**k} THEN {k}" for k in range(top)) + f" ELSE {top} END"


@query(f"SELECT c_custkey, {_level_sql(_M, 30, 9)} AS lvl_m, {_level_sql(_S, 1, 12)} AS lvl_angle, 30.0::DOUBLE * pow(2.0::DOUBLE, {_level_sql(_M, 30, 9)}) AS pixel_m, greatest(0, 10 - (c_custkey % 15))::INT AS h_level, greatest(0, 6 - (c_custkey % 15))::INT AS c_level, len(range({_level_sql(_M, 30, 9)}, 13))::INT AS n_coarser FROM customer")
def m01_levels(spark, sf_dir):
    m, s = F.col("c_custkey") * 7 % 20000 + 10, F.col("c_custkey") * 11 % 5000 + F.lit(0.5)
    lvl, depth = L.level_of_meters(m), (F.col("c_custkey") % 15).cast("int")
    return V.table(spark, sf_dir, "customer").select("c_custkey", lvl.alias("lvl_m"), L.level_of_arcseconds(s).alias("lvl_angle"), L.pixel_meters(lvl).alias("pixel_m"), L.level_of_depth(depth, "heights").alias("h_level"), L.level_of_depth(depth, "colors").alias("c_level"), F.size(L.coarser(lvl, F.lit(12))).alias("n_coarser"))


_PLACE = V.place_sql("lat_deg", "lon_deg")


@query(f"WITH {V.GEO_CUSTOMER}, {V.LAYERS}, p AS (SELECT c_custkey, level, stride, {_PLACE} FROM gc, ly) SELECT c_custkey, level, tile_offset, row, col, oob, (tile_offset % stride)::INT AS tx, (tile_offset // stride)::INT AS ty FROM p")
def m02_tile_for(spark, sf_dir):
    p = R.place(V.geo_customer(spark, sf_dir), V.layers(spark), TILE)
    tx, ty = L.tile_xy(F.col("tile_offset"), F.col("stride"))
    return p.select("c_custkey", "level", "tile_offset", "row", "col", "oob", tx.alias("tx"), ty.alias("ty"))


_GRID = f"""g0 AS (SELECT s_suppkey, ly.*, trunc((w - tie_lon) / scale_deg) AS x0, trunc((e - tie_lon) / scale_deg) + 1 AS x1, trunc((s - (tie_lat - height * scale_deg)) / scale_deg) AS y0, trunc((n - (tie_lat - height * scale_deg)) / scale_deg) + 1 AS y1 FROM gb, ly),
    g1 AS (SELECT *, unnest(range(0, (x1 - x0)::INT + 1)) AS gx FROM g0), g2 AS (SELECT *, unnest(range(0, (y1 - y0)::INT + 1)) AS gy FROM g1),
    g3 AS (SELECT *, tie_lon + (x0 + gx) * scale_deg AS lon, tie_lat - height * scale_deg + (y0 + gy) * scale_deg AS lat FROM g2),
    g4 AS (SELECT s_suppkey, level, gx, gy, lat, lon, {V.place_sql("lat + scale_deg / 2", "lon + scale_deg / 2")} FROM g3)"""
_HEIGHT = "CASE WHEN coalesce(state, 'Missing') = 'Empty' THEN 0 WHEN state = 'Ready' THEN px.height END"
_DISPLACED = f"g5 AS (SELECT g4.*, CASE WHEN oob THEN 0 ELSE {_HEIGHT} END AS asl FROM g4 LEFT JOIN px USING (level, tile_offset, row, col) LEFT JOIN rs USING (level, tile_offset))"
_RASTER = f"{V.LAYERS}, {V.PIXELS}, {V.RESIDENCY}"


def _grids(spark, sf_dir):
    regions = V.geo_box(spark, sf_dir).crossJoin(F.broadcast(V.layers(spark)))  # a dimension of four rows
    return R.grid(regions, TILE)


def _displaced(spark, sf_dir):
    return R.displaced(_grids(spark, sf_dir), V.pixels(spark), V.residency(spark))


@query(f"WITH {V.GEO_BOX}, {V.LAYERS}, {_GRID} SELECT s_suppkey, level, count(*)::BIGINT AS n_samples, {rs('min(lat)')} AS min_lat, {rs('max(lat)')} AS max_lat, {rs('min(lon)')} AS min_lon, bool_or(oob) AS any_oob FROM g4 GROUP BY s_suppkey, level")
def m03_expanded_grid(spark, sf_dir):
    return _grids(spark, sf_dir).groupBy("s_suppkey", "level").agg(F.count("*").alias("n_samples"), r(F.min("lat")).alias("min_lat"), r(F.max("lat")).alias("max_lat"), r(F.min("lon")).alias("min_lon"), F.bool_or("oob").alias("any_oob"))


_PROBED = f"p AS (SELECT c_custkey, c_nationkey, level, {_PLACE} FROM gc, ly), q AS (SELECT p.*, coalesce(state, 'Missing') AS state, {_HEIGHT} AS asl FROM p LEFT JOIN px USING (level, tile_offset, row, col) LEFT JOIN rs USING (level, tile_offset))"


@query(f"WITH {V.GEO_CUSTOMER}, {_RASTER}, {_PROBED} SELECT c_custkey, level, state, asl::INT AS asl FROM q")
def m04_nearest(spark, sf_dir):
    """The pixel under each customer at each level: null where missing, 0 where empty."""
    p = R.place(V.geo_customer(spark, sf_dir), V.layers(spark), TILE)
    return R.probe(p, V.pixels(spark), V.residency(spark)).select("c_custkey", "level", "state", F.col("asl").cast("int").alias("asl"))


_BILINEAR = f"""b0 AS (SELECT c_custkey, c_nationkey, ly.*, (lon_deg - tie_lon) / scale_deg AS sx, (tie_lat - lat_deg) / scale_deg AS sy FROM gc, ly),
    b1 AS (SELECT *, sx - floor(sx) AS fx, sy - floor(sy) AS fy, i, j FROM b0, range(0, 2) t(i), range(0, 2) u(j)),
    b2 AS (SELECT *, ((floor(sx)::INT + i) % width)::INT AS col, least(greatest(floor(sy)::INT + j, 0), height - 1)::INT AS row FROM b1),
    b3 AS (SELECT *, ((row // {TILE}) * stride + col // {TILE})::INT AS tile_offset, (CASE WHEN i = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN j = 1 THEN fy ELSE 1 - fy END) AS weight FROM b2),
    b4 AS (SELECT b3.c_custkey, b3.c_nationkey, b3.level, weight, CASE WHEN state = 'Empty' THEN 0 WHEN state = 'Ready' THEN px.height END AS asl FROM b3 LEFT JOIN px USING (level, tile_offset, row, col) LEFT JOIN rs USING (level, tile_offset)),
    b5 AS (SELECT c_custkey, c_nationkey, level, sum(weight * asl) AS asl FROM b4 GROUP BY ALL HAVING bool_and(asl IS NOT NULL))"""


def _interpolated(spark, sf_dir):
    points = V.geo_customer(spark, sf_dir).crossJoin(F.broadcast(V.layers(spark)))  # a dimension of four rows
    corners = R.probe(R.bilinear(points, None, TILE), V.pixels(spark), V.residency(spark))
    return corners.groupBy("c_custkey", "c_nationkey", "level").agg(F.bool_and(F.col("asl").isNotNull()).alias("whole"), F.sum(F.col("weight") * F.col("asl")).alias("asl")).filter("whole")


@query(f"WITH {V.GEO_CUSTOMER}, {_RASTER}, {_BILINEAR} SELECT c_custkey, level, {rs('asl', 4)} AS asl FROM b5")
def m05_bilinear(spark, sf_dir):
    return _interpolated(spark, sf_dir).select("c_custkey", "level", r(F.col("asl"), 4).alias("asl"))


@query(f"WITH {V.GEO_CUSTOMER}, {_RASTER}, {_BILINEAR}, f AS (SELECT c_custkey, c_nationkey, arg_min(asl, level) AS asl FROM b5 GROUP BY ALL) SELECT c_nationkey, {rs('avg(asl)', 4)} AS avg_asl, count(*)::BIGINT AS n FROM f GROUP BY c_nationkey")
def entry_height_by_nation(spark, sf_dir):
    """Mean interpolated height per nation, each customer at the finest level that has all four pixels."""
    best = _interpolated(spark, sf_dir).groupBy("c_custkey", "c_nationkey").agg(F.min_by("asl", "level").alias("asl"))
    return best.groupBy("c_nationkey").agg(r(F.avg("asl"), 4).alias("avg_asl"), F.count("*").alias("n"))


@query(f"WITH {V.GEO_BOX}, {_RASTER}, {_GRID}, {_DISPLACED} SELECT s_suppkey, level, {rs('avg(asl)')} AS avg_asl, min(asl)::INT AS min_asl, max(asl)::INT AS max_asl, count(*)::BIGINT AS n_samples FROM g5 GROUP BY s_suppkey, level HAVING bool_and(asl IS NOT NULL)")
def m06_grid_stats(spark, sf_dir):
    d = _displaced(spark, sf_dir)
    whole = d.groupBy("s_suppkey", "level").agg(F.avg("asl").alias("avg_asl"), F.min("asl").alias("min_asl"), F.max("asl").alias("max_asl"), F.count("*").alias("n_samples"), F.bool_and(F.col("asl").isNotNull()).alias("whole")).filter("whole")
    return whole.select("s_suppkey", "level", r(F.col("avg_asl")).alias("avg_asl"), F.col("min_asl").cast("int").alias("min_asl"), F.col("max_asl").cast("int").alias("max_asl"), "n_samples")


_BURN = f"""bt AS (SELECT level, tile_offset, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, s_suppkey AS rank, (s_suppkey * 1000 - 40000)::INT AS value FROM g4 GROUP BY level, tile_offset, s_suppkey),
    bs AS (SELECT *, unnest(range(r0, r1)) AS row FROM bt WHERE r0 < r1 AND c0 < c1), bc AS (SELECT *, unnest(range(c0, c1)) AS col FROM bs), bb AS (SELECT level, tile_offset, row, col, arg_max(value, rank) AS v FROM bc GROUP BY ALL)"""


@query(f"WITH {V.GEO_BOX}, {V.LAYERS}, {V.PIXELS}, {_GRID}, {_BURN} SELECT level, tile_offset, sum(CASE WHEN v IS NULL THEN height ELSE greatest(-32768, least(32767, v)) END)::BIGINT AS sum_h FROM px LEFT JOIN bb USING (level, tile_offset, row, col) GROUP BY level, tile_offset")
def m07_burn(spark, sf_dir):
    """Constant heights burnt into the part of each tile that a supplier's grid covers."""
    g = _grids(spark, sf_dir).groupBy("level", "tile_offset", F.col("s_suppkey").alias("rank")).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    burnt = R.burn(V.pixels(spark), g.withColumn("value", (F.col("rank") * 1000 - 40000).cast("int")))
    return burnt.groupBy("level", "tile_offset").agg(F.sum("height").cast("long").alias("sum_h"))


@query(f"WITH {V.GEO_BOX}, {V.LAYERS}, {_GRID}, t AS (SELECT level, tile_offset, s_suppkey, arg_min(struct_pack(a := lat, o := lon), gy * 100000 + gx) AS lo, arg_max(struct_pack(a := lat, o := lon), gy * 100000 + gx) AS hi FROM g4 GROUP BY ALL) SELECT s_suppkey, level, tile_offset, {rs('lo.a')} AS lo_lat, {rs('lo.o')} AS lo_lon, {rs('hi.a')} AS hi_lat, {rs('hi.o')} AS hi_lon FROM t")
def w04_first_last(spark, sf_dir):
    """First and last sample of each tile in scan order."""
    at, s = F.col("gy") * 100000 + F.col("gx"), F.struct("lat", "lon")
    t = _grids(spark, sf_dir).groupBy("s_suppkey", "level", "tile_offset").agg(F.min_by(s, at).alias("lo"), F.max_by(s, at).alias("hi"))
    return t.select("s_suppkey", "level", "tile_offset", *(r(F.col(f"{k}.{a}")).alias(f"{k}_{a}") for k in ("lo", "hi") for a in ("lat", "lon")))


# Joins ------------------------------------------------------------------------------------------------------------


def _tiles_sql(border: int) -> str:
    return f"""t0 AS (SELECT s_suppkey, ly.*, greatest(floor(((w - tie_lon) / scale_deg - {border}) / {TILE}), 0)::INT AS x0, least(floor(((e - tie_lon) / scale_deg + {border}) / {TILE}), stride - 1)::INT AS x1, greatest(floor(((tie_lat - n) / scale_deg - {border}) / {TILE}), 0)::INT AS y0, least(floor(((tie_lat - s) / scale_deg + {border}) / {TILE}), ceil(height / {TILE}) - 1)::INT AS y1 FROM gb, ly),
    t1 AS (SELECT *, unnest(range(x0, x1 + 1))::INT AS tx FROM t0), tl AS (SELECT *, unnest(range(y0, y1 + 1))::INT AS ty FROM t1)"""


@query(f"WITH {V.GEO_BOX}, {V.LAYERS}, {V.RESIDENCY}, {_tiles_sql(0)} SELECT s_suppkey, tl.level, (ty * stride + tx)::INT AS tile_offset, rs.state FROM tl JOIN rs ON rs.level = tl.level AND rs.tile_offset = ty * stride + tx WHERE tl.level = 0")
def j01_region_tiles(spark, sf_dir):
    t = R.region_tiles(V.geo_box(spark, sf_dir), V.layers(spark).filter("level = 0"), TILE)
    return R.with_state(t, V.residency(spark)).select("s_suppkey", "level", "tile_offset", "state")


@query(f"WITH {V.GEO_BOX}, {V.LAYERS}, {_tiles_sql(0)} SELECT s_suppkey, level, (ty * stride + tx)::INT AS tile_offset FROM tl WHERE level >= 1")
def j02_stack(spark, sf_dir):
    """The tiles of a region at a level and all coarser ones."""
    return R.region_tiles(V.geo_box(spark, sf_dir), V.layers(spark).filter("level >= 1"), TILE).select("s_suppkey", "level", "tile_offset")


@query(f"WITH {V.GEO_BOX}, {V.LAYERS}, {_tiles_sql(1)} SELECT DISTINCT level, (ty * stride + tx)::INT AS tile_offset FROM tl")
def j03_touching(spark, sf_dir):
    """Every tile that some region may touch, with a border of one pixel."""
    return R.region_tiles(V.geo_box(spark, sf_dir), V.layers(spark), TILE, 1).select("level", "tile_offset").distinct()


@query(f"WITH {V.GEO_CUSTOMER}, {_RASTER}, {_PROBED} SELECT c_custkey, min(level)::INT AS level, arg_min(asl, level)::INT AS asl FROM q WHERE asl IS NOT NULL GROUP BY c_custkey")
def j04_best_level(spark, sf_dir):
    """The finest resident level of each customer and its height there."""
    p = R.probe(R.place(V.geo_customer(spark, sf_dir), V.layers(spark), TILE), V.pixels(spark), V.residency(spark))
    return p.filter("asl IS NOT NULL").groupBy("c_custkey").agg(F.min("level").alias("level"), F.min_by("asl", "level").cast("int").alias("asl"))


_TOUCH = f"{V.GEO_BOX}, {V.LAYERS}, {_tiles_sql(1)}, tt AS (SELECT s_suppkey, level, (ty * stride + tx)::INT AS tile_offset FROM tl)"


def _touched(spark, sf_dir):
    return R.region_tiles(V.geo_box(spark, sf_dir), V.layers(spark), TILE, 1).select("s_suppkey", "level", "tile_offset")


@query(f"WITH {_TOUCH}, {V.NOTIFICATIONS} SELECT event_id, entity_id FROM nt WHERE EXISTS (SELECT 1 FROM tt WHERE tt.level = nt.level AND tt.tile_offset = nt.tile_offset)")
def j05_semi(spark, sf_dir):
    return V.notifications(spark, sf_dir).join(_touched(spark, sf_dir), R.TILE_KEY, "left_semi").select("event_id", "entity_id")


@query(f"WITH {_TOUCH}, {V.NOTIFICATIONS} SELECT event_id, entity_id FROM nt WHERE NOT EXISTS (SELECT 1 FROM tt WHERE tt.level = nt.level AND tt.tile_offset = nt.tile_offset)")
def j06_anti(spark, sf_dir):
    return V.notifications(spark, sf_dir).join(_touched(spark, sf_dir), R.TILE_KEY, "left_anti").select("event_id", "entity_id")


@query("SELECT s_suppkey, count(l_orderkey)::BIGINT AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 45 GROUP BY s_suppkey")
def j07_outer(spark, sf_dir):
    l = V.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))  # noqa: E741
    return V.table(spark, sf_dir, "supplier").select("s_suppkey").join(l, "s_suppkey", "left").select("s_suppkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH ev AS (SELECT event_id, user_id % 40 AS parent_id, value AS asl FROM events), pa AS (SELECT n_nationkey::BIGINT AS parent_id FROM nation), ch AS (SELECT c_nationkey::BIGINT AS parent_id, c_custkey AS child_id, (c_custkey % 7)::DOUBLE AS off FROM customer)
    SELECT parent_id, NULL::BIGINT AS child_id, asl FROM ev SEMI JOIN pa USING (parent_id) UNION ALL SELECT ev.parent_id, child_id, asl - off FROM ev SEMI JOIN pa USING (parent_id) JOIN ch USING (parent_id)""")
def j08_event_children(spark, sf_dir):
    """The height of every event for its parent and all of the parent's children."""
    ev = V.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("parent_id"), F.col("value").alias("asl"))
    parents = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("parent_id"))
    kids = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("parent_id"), F.col("c_custkey").alias("child_id"), (F.col("c_custkey") % 7).cast("double").alias("offset"))
    return T.events_to_children(ev, parents, kids)


@query(f"WITH {V.LAYERS}, a AS (SELECT level, [1000 * level + 7 * i FOR i IN range(0, stride)] AS offs, [100 + i FOR i IN range(0, stride)] AS cnts FROM ly), b AS (SELECT level, generate_subscripts(offs, 1) - 1 AS tile, unnest(offs) AS off, unnest(cnts) AS nbytes FROM a) SELECT level, tile::INT AS tile, off::BIGINT AS off, nbytes::BIGINT AS nbytes FROM b")
def j09_pair_index(spark, sf_dir):
    """Offset and size arrays of each layer, paired by place."""
    rows = V.layers(spark).select("level", F.explode(F.array(F.lit("offs"), F.lit("cnts"))).alias("kind"), F.expr("sequence(0, stride - 1)").alias("i"))
    arrays = rows.withColumn("values", F.when(F.col("kind") == "offs", F.transform("i", lambda i: F.col("level") * 1000 + i * 7)).otherwise(F.transform("i", lambda i: i + 100)))
    wide = arrays.groupBy("level").agg(F.max(F.when(F.col("kind") == "offs", F.col("values"))).alias("o"), F.max(F.when(F.col("kind") == "cnts", F.col("values"))).alias("c"))
    return wide.select("level", F.posexplode(F.arrays_zip("o", "c")).alias("tile", "x")).select("level", "tile", F.col("x.o").cast("long").alias("off"), F.col("x.c").cast("long").alias("nbytes"))


@query(f"WITH {V.LAYERS}, {V.RESIDENCY} SELECT level, sum(CASE WHEN state = 'Ready' THEN nbytes ELSE 0 END)::BIGINT AS bytes FROM rs GROUP BY level")
def a01_resident_bytes(spark, sf_dir):
    return R.resident_bytes(V.residency(spark)).select("level", F.col("bytes").cast("long").alias("bytes"))


@query(f"WITH {V.LAYERS}, {V.RESIDENCY}, x AS (SELECT level, 2 * count(*) AS total, sum(CASE WHEN state <> 'Missing' THEN 2 ELSE 0 END) AS done FROM rs GROUP BY level) SELECT level, total::BIGINT AS total, {rs('done / total')} AS share FROM x")
def a02_startup_progress(spark, sf_dir):
    x = V.residency(spark).groupBy("level").agg((2 * F.count("*")).alias("total"), F.sum(F.when(F.col("state") != "Missing", 2).otherwise(0)).alias("done"))
    return x.select("level", "total", r(T.progress(F.col("done"), F.col("total"))).alias("share"))


@query(f"WITH {V.GEO_BOX}, {_RASTER}, {_GRID}, {_DISPLACED} SELECT s_suppkey, level, count(*) FILTER (asl IS NULL)::BIGINT AS missing, bool_and(asl IS NOT NULL) AS whole FROM g5 GROUP BY s_suppkey, level")
def a03_grid_gate(spark, sf_dir):
    """Which grids have a height for every sample."""
    return _displaced(spark, sf_dir).groupBy("s_suppkey", "level").agg(F.sum(F.when(F.col("asl").isNull(), 1).otherwise(0)).cast("long").alias("missing"), F.bool_and(F.col("asl").isNotNull()).alias("whole"))


# Sets and windows -------------------------------------------------------------------------------------------------


@query(f"WITH {V.NOTIFICATIONS} SELECT level, tile_offset, arg_max(event_id, (ts, event_id)) AS event_id FROM nt GROUP BY level, tile_offset")
def s01_upsert(spark, sf_dir):
    """Keyed upsert: the last notification of a tile wins."""
    return V.notifications(spark, sf_dir).groupBy("level", "tile_offset").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT s_suppkey, s_nationkey, 8 + s_suppkey % 5 AS n_verts, coalesce(sum(8 + s_suppkey % 5) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM supplier")
def s02_union_rebase(spark, sf_dir):
    """Union of meshes: where the vertex numbers of each begin within its nation."""
    m = V.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 5 + 8).alias("n_verts"))
    return M.rebased(m, "s_nationkey", "s_suppkey").withColumn("base", F.col("base").cast("long"))


_SUB = "sub AS (SELECT l, y, n FROM range(0, 5) t(l), range(0, 33) u(y), LATERAL (SELECT (y + 1) AS n) WHERE y <= (1 << l))"


@query("WITH r AS (SELECT l::INT AS level, y FROM range(0, 5) t(l), range(0, 17) u(y) WHERE y < (1 << l)) SELECT level, y::INT AS bin, (2 * y + 1)::BIGINT AS n FROM r")
def w01_row_pairs(spark, sf_dir):
    """Rows of the subdivided triangle from the top: row k has 2k + 1 triangles."""
    out = None
    for level in range(5):
        rows = M.sorted_rows(M.subdivided(spark, level)[0]).select(F.lit(level).alias("level"), F.col("bin").cast("int").alias("bin"), F.size("t").cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT k::INT AS pair, (4 * k + 1)::BIGINT AS n_a, (4 * k + 3)::BIGINT AS n_b FROM range(0, 8) t(k)")
def w02_chunks(spark, sf_dir):
    """Rows in pairs without overlap."""
    p = M.row_pairs(M.subdivided(spark, 4)[0])
    return p.select(F.col("pair").cast("int").alias("pair"), F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE i > 1 AND i <= 1 + n - 3")
def w03_slices(spark, sf_dir):
    """Positions 1 to n - 3 of each sorted group."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    l = V.table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))  # noqa: E741
    return l.filter("i > 1 AND i <= 1 + n - 3").select("l_orderkey", "l_linenumber", "l_partkey")


# Meshes -----------------------------------------------------------------------------------------------------------

_BV = [(0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0), (1, 1, 1)]


@query(f"WITH {V.SHAPES}, v(idx, a, b, c) AS (VALUES {', '.join(f'({i}, {a}, {b}, {c})' for i, (a, b, c) in enumerate(_BV))}) SELECT vec_id AS obj, idx, CASE a WHEN 1 THEN greatest(e0, e3) ELSE least(e0, e3) END AS x, CASE b WHEN 1 THEN greatest(e1, e4) ELSE least(e1, e4) END AS y, CASE c WHEN 1 THEN greatest(e2, e5) ELSE least(e2, e5) END AS z FROM sh, v")
def t01_box_mesh(spark, sf_dir):
    p, q = V.e(0), V.e(3)
    box = Box(Vec3(*(F.least(a, b) for a, b in zip(p, q, strict=True))), Vec3(*(F.greatest(a, b) for a, b in zip(p, q, strict=True))))
    return M.box_verts(V.shapes(spark, sf_dir), "vec_id", box)


@query("SELECT p_partkey AS obj, k::INT AS idx, " + ", ".join(f"{rs(f'CASE WHEN k >= 8 THEN p_size / 2 ELSE p_size END * {fn}(2 * pi() / 8 * (k % 8))')} AS {a}" for a, fn in (("x", "cos"), ("z", "sin"))) + ", CASE WHEN k >= 8 THEN p_retailprice ELSE 0.0::DOUBLE END AS y FROM part, range(0, 16) t(k)")
def t02_cylinder_mesh(spark, sf_dir):
    s = F.col("p_size").cast("double")
    v = M.cylinder_verts(V.table(spark, sf_dir, "part"), "p_partkey", Vec3.of(0, 0, 0), Vec3.of(0, 1, 0), F.col("p_retailprice"), s, s / 2, 8)
    return v.select("obj", "idx", r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("z")).alias("z"))


@query("SELECT d::INT AS detail, (12 + 20 * ((pow(4, d) - 1)))::BIGINT AS n_verts, (20 * pow(4, d))::BIGINT AS n_faces, true AS on_sphere FROM range(0, 4) t(d)")
def t03_sphere_mesh(spark, sf_dir):
    out = None
    for detail in range(4):
        v, f = M.unit_sphere(spark, detail)
        row = v.agg(F.count("*").alias("n_verts"), F.bool_and(F.abs(Vec3.columns("").length() - 1) < 1e-9).alias("on_sphere")).withColumn("n_faces", F.lit(0).cast("long"))
        faces = f.agg(F.count("*").alias("n_faces")).withColumn("n_verts", F.lit(0).cast("long")).withColumn("on_sphere", F.lit(True))
        both = row.unionByName(faces).agg(F.sum("n_verts").alias("n_verts"), F.sum("n_faces").alias("n_faces"), F.bool_and("on_sphere").alias("on_sphere")).withColumn("detail", F.lit(detail))
        out = both if out is None else out.unionByName(both)
    return out.select("detail", "n_verts", "n_faces", "on_sphere")


@query("SELECT s_suppkey AS obj, 32::BIGINT AS n_verts, 60::BIGINT AS n_faces, 31::INT AS max_index FROM supplier")
def t04_arrow_mesh(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    v, f = M.arrow(s, "s_suppkey", Vec3.of(0, 0, 0), Vec3.of(0, 0, 1), F.lit(2.0), F.lit(0.1), 8)
    faces = f.groupBy("obj").agg(F.count("*").alias("n_faces"), F.max(F.greatest("i0", "i1", "i2")).alias("max_index"))
    return v.groupBy("obj").agg(F.count("*").alias("n_verts")).join(faces, "obj")


@query("WITH p AS (SELECT s_suppkey AS obj, (3 + s_suppkey % 4)::INT AS width, (2 + s_suppkey % 3)::INT AS height FROM supplier), c AS (SELECT *, unnest(range(0, height)) AS y FROM p), d AS (SELECT *, unnest(range(0, width)) AS x FROM c), f AS (SELECT obj, (2 * (y * width + x) + k)::INT AS idx, (y * (width + 1) + x)::INT AS i0, (CASE k WHEN 0 THEN y * (width + 1) + x + 1 ELSE (y + 1) * (width + 1) + x + 1 END)::INT AS i1, (CASE k WHEN 0 THEN (y + 1) * (width + 1) + x + 1 ELSE (y + 1) * (width + 1) + x END)::INT AS i2 FROM d, range(0, 2) t(k)) SELECT * FROM f")
def t06_grid_tris(spark, sf_dir):
    return M.grid_tris(_small_grids(spark, sf_dir), ["obj"])


def _small_grids(spark, sf_dir):
    return V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("obj"), (F.col("s_suppkey") % 4 + 3).cast("int").alias("width"), (F.col("s_suppkey") % 3 + 2).cast("int").alias("height"))


@query("WITH p AS (SELECT s_suppkey AS obj, (3 + s_suppkey % 4) AS w, (2 + s_suppkey % 3) AS h FROM supplier) SELECT obj, (3 * w * h + w + h)::BIGINT AS n_edges FROM p")
def t06_grid_edges(spark, sf_dir):
    return M.grid_edges(_small_grids(spark, sf_dir), ["obj"]).groupBy("obj").agg(F.count("*").alias("n_edges"))


@query("WITH p AS (SELECT s_suppkey AS obj, (3 + s_suppkey % 4) AS w, (2 + s_suppkey % 3) AS h FROM supplier) SELECT obj, (2 * w * h)::BIGINT AS n, (w * h)::DOUBLE AS area, (6 * w * h - 1)::INT AS last FROM p")
def t05_trimesh(spark, sf_dir):
    """Triangles looked up by index: their areas add up to the grid's; unshared vertices are three a triangle."""
    g = _small_grids(spark, sf_dir)
    parts = g.count() // 2000 + 1  # few bytes make many rows: a task gets about 2000 grids, at most 144 corners each
    g = g.repartition(parts, "obj")
    tris = M.grid_tris(g, ["obj"])
    verts = g.withColumn("y", F.explode(F.expr("sequence(0, height)"))).withColumn("x", F.explode(F.expr("sequence(0, width)"))).select("obj", (F.col("y") * (F.col("width") + 1) + F.col("x")).cast("int").alias("idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("z"))
    c = M.mesh_corners(tris, verts, ["obj"], parts)
    a, b, d = (Vec3(*(F.col(f"{x}{k}") for x in "xyz")) for k in range(3))
    area = c.groupBy("obj").agg(F.count("*").alias("n"), F.sum(b.minus(a).cross(d.minus(a)).length() / 2).alias("area"))
    last = M.unshared(tris, verts, ["obj"], parts).groupBy("obj").agg(F.max("idx").alias("last"))
    return area.join(last.hint("merge"), "obj")  # one row an object: too many to broadcast


@query(f"WITH {V.GEO_BOX}, {_RASTER}, {_GRID}, {_DISPLACED}, h AS (SELECT s_suppkey, level, min(asl) AS lo, max(asl) AS hi, min(lat) AS s, max(lat) AS n, max(gx) AS w, max(gy) AS hh FROM g5 GROUP BY s_suppkey, level HAVING bool_and(asl IS NOT NULL)) SELECT s_suppkey, level, lo::INT AS floor_asl, {rs('(s + n) / 2')} AS center_lat, {rs('30.0::DOUBLE * pow(2.0::DOUBLE, level) * cos(radians((s + n) / 2)) * w', 3)} AS size_x, {rs('30.0::DOUBLE * pow(2.0::DOUBLE, level) * hh', 3)} AS size_z, (hi - lo)::INT AS top, (hh + 1)::INT AS n_rows FROM h")
def t07_height_field(spark, sf_dir):
    d = _displaced(spark, sf_dir)
    whole = R.whole_grids(d, ["s_suppkey", "level"])
    f = M.height_field(d.join(whole, ["s_suppkey", "level"], "left_semi"), ["s_suppkey"])
    top = F.array_max(F.flatten("heights"))
    return f.select("s_suppkey", "level", F.col("floor_asl").cast("int").alias("floor_asl"), r(F.col("center_lat")).alias("center_lat"), r(F.col("size_x"), 3).alias("size_x"), r(F.col("size_z"), 3).alias("size_z"), top.cast("int").alias("top"), F.size("heights").alias("n_rows"))


@query("SELECT l::INT AS level, (((1 << l) + 1) * ((1 << l) + 2) // 2)::BIGINT AS n_verts, (1 << (2 * l))::BIGINT AS n_tris, (((1 << l) + 1) * ((1 << l) + 2) // 2 - 1)::INT AS last FROM range(0, 6) t(l)")
def t08_subdivision(spark, sf_dir):
    out = None
    for level in range(6):
        tris, deps = M.subdivided(spark, level)
        a = deps.agg(F.count("*").alias("n_verts"), F.max("idx").alias("last"), F.lit(0).cast("long").alias("n_tris"))
        b = tris.agg(F.lit(0).cast("long").alias("n_verts"), F.max(F.greatest("i0", "i1", "i2")).alias("last"), F.count("*").alias("n_tris"))
        one = a.unionByName(b).agg(F.sum("n_verts").alias("n_verts"), F.sum("n_tris").alias("n_tris"), F.max("last").alias("last")).withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
    return out.select("level", "n_verts", "n_tris", "last")


@query(None)
def t09_lines(spark, sf_dir):
    return M.index_tables(spark, 3)


@query(None)
def t10_strips(spark, sf_dir):
    return M.index_tables(spark, 3, strips=True)


@query("WITH v(winding, k) AS (VALUES ('full', 0), ('missing0', 1), ('missing2', 2), ('missing20', 3)) SELECT 0 AS level, winding, 6::BIGINT AS n, (6 * k)::BIGINT AS start FROM v UNION ALL SELECT 1, winding, CASE k WHEN 0 THEN 18 WHEN 3 THEN 8 ELSE 14 END, 24 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 18 WHEN 2 THEN 32 ELSE 46 END FROM v")
def t12_ranges(spark, sf_dir):
    """Where each table begins when the line lists of levels 0 and 1 are laid end to end."""
    t = M.table_ranges(M.index_tables(spark, 1))
    return t.select("level", "winding", "n", F.col("start").cast("long").alias("start"))


# Maintenance ------------------------------------------------------------------------------------------------------


@query(f"WITH {V.NOTIFICATIONS} SELECT entity_id, min(level)::INT AS level FROM nt GROUP BY entity_id")
def r01_best_refinement(spark, sf_dir):
    return T.best_refinement(V.notifications(spark, sf_dir))


@query(f"WITH {V.NOTIFICATIONS} SELECT entity_id, arg_min(value, (ts, event_id)) AS target FROM nt WHERE level <= 3 AND (17 * tile_offset + level) % 11 <> 0 GROUP BY entity_id")
def r02_flatten_once(spark, sf_dir):
    ready = (F.col("level") <= 3) & ((F.col("tile_offset") * 17 + F.col("level")) % 11 != 0)
    return T.decided_once(V.notifications(spark, sf_dir), ready, F.col("value"))


@query(f"""WITH RECURSIVE {V.NOTIFICATIONS}, st AS (SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS k, (event_id % 1000)::DOUBLE AS g, (2 + entity_id % 5)::DOUBLE AS r, ((entity_id * 37) % 1500)::DOUBLE AS a FROM nt),
    fold AS (SELECT entity_id, k, g, r, a AS asl FROM st WHERE k = 1 UNION ALL
        SELECT st.entity_id, st.k, st.g, st.r, CASE WHEN st.g <> f.g AND (f.asl - st.r <= f.g OR f.asl - st.r <= st.g) THEN f.asl + st.g - f.g ELSE f.asl END FROM fold f JOIN st ON st.entity_id = f.entity_id AND st.k = f.k + 1)
    SELECT entity_id, arg_max(asl, k) AS asl FROM fold GROUP BY entity_id""")
def r03_stabiliser(spark, sf_dir):
    """Heights of entities that hover or stand, after every change of the ground below."""
    return T.adjusted(V.notifications(spark, sf_dir), F.col("event_id") % 1000, (F.col("entity_id") * 37) % 1500, F.col("entity_id") % 5 + 2)


@query("SELECT user_id AS parent_id, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events SEMI JOIN nation ON n_nationkey = user_id GROUP BY user_id")
def r04_event_join(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("parent_id"), "event_id")
    nations = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("parent_id"))
    return ev.join(nations, "parent_id", "left_semi").groupBy("parent_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {V.NOTIFICATIONS} SELECT DISTINCT level, tile_offset FROM nt")
def r05_dedup_requests(spark, sf_dir):
    return T.new_requests(V.notifications(spark, sf_dir))


_GRID1 = _GRID.replace(" AS x0", " - 1 AS x0").replace(" AS x1", " + 1 AS x1").replace(" AS y0", " - 1 AS y0").replace(" AS y1", " + 1 AS y1")
_TENT = lambda y, x: f"sum(asl * greatest(0.0::DOUBLE, 1 - abs(lat - {y}) / scale_deg) * greatest(0.0::DOUBLE, 1 - abs(lon - {x}) / scale_deg))"
_CORNERS = f"""co AS (SELECT s_suppkey, level, {", ".join(f"{_TENT(y, x)} AS c{y}{x}" for y in "sn" for x in "we")} FROM g5 JOIN gb USING (s_suppkey) JOIN (SELECT level, scale_deg FROM ly) USING (level) GROUP BY s_suppkey, level HAVING bool_and(asl IS NOT NULL)),
    cl AS (SELECT s_suppkey, level, least(csw, cse, cnw, cne) AS lo, greatest(csw, cse, cnw, cne) AS hi FROM co)"""


def _corners(spark, sf_dir):
    grids = R.grid(V.geo_box(spark, sf_dir).crossJoin(F.broadcast(V.layers(spark))), TILE, 1)  # a dimension of four rows
    return R.corner_heights(R.displaced(grids, V.pixels(spark), V.residency(spark)), ["s_suppkey", "level"])


@query(f"WITH {V.GEO_BOX}, {_RASTER}, {_GRID1}, {_DISPLACED}, {_CORNERS} SELECT s_suppkey, level, {rs('lo', 4)} AS lowest_corner, {rs('hi', 4)} AS highest_corner FROM cl")
def a05_corner_heights(spark, sf_dir):
    return _corners(spark, sf_dir).select("s_suppkey", "level", r(F.col("lowest_corner"), 4).alias("lowest_corner"), r(F.col("highest_corner"), 4).alias("highest_corner"))


@query(f"WITH {V.GEO_BOX}, {_RASTER}, {_GRID1}, {_DISPLACED}, {_CORNERS} SELECT s_suppkey, min(level)::INT AS level, {rs('arg_min(lo, level) - s_suppkey % 4', 4)} AS asl FROM cl GROUP BY s_suppkey")
def r06_foundation(spark, sf_dir):
    """Foundations at the lowest corner of their finest whole grid."""
    best = T.levelled(_corners(spark, sf_dir), ["s_suppkey"], F.col("s_suppkey") % 4)
    return best.select("s_suppkey", "level", r(F.col("asl"), 4).alias("asl"))


_FLATTEN = """ft AS (SELECT s_suppkey, level, avg(asl) AS mean FROM g5 GROUP BY s_suppkey, level HAVING bool_and(asl IS NOT NULL)), fv AS (SELECT s_suppkey, floor(arg_min(mean, level))::INT AS value FROM ft GROUP BY s_suppkey),
    bt AS (SELECT level, tile_offset, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, s_suppkey AS rank, any_value(value) AS value FROM g4 JOIN fv USING (s_suppkey) GROUP BY level, tile_offset, s_suppkey),
    bs AS (SELECT *, unnest(range(r0, r1)) AS row FROM bt WHERE r0 < r1 AND c0 < c1), bc AS (SELECT *, unnest(range(c0, c1)) AS col FROM bs), bb AS (SELECT level, tile_offset, row, col, arg_max(value, rank) AS v FROM bc GROUP BY ALL)"""


@query(f"WITH {V.GEO_BOX}, {_RASTER}, {_GRID}, {_DISPLACED}, {_FLATTEN} SELECT level, tile_offset, sum(coalesce(v, px.height))::BIGINT AS sum_h FROM px JOIN rs USING (level, tile_offset) LEFT JOIN bb USING (level, tile_offset, row, col) WHERE state = 'Ready' GROUP BY level, tile_offset")
def r07_flatten(spark, sf_dir):
    """Resident tiles with each region flattened, at every level, to the mean height of its finest whole grid."""
    samples = _displaced(spark, sf_dir)
    target = R.flatten_target(samples.select("s_suppkey", "level", "asl"), ["s_suppkey"])
    parts = _grids(spark, sf_dir).groupBy("level", "tile_offset", "s_suppkey").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    ready = V.residency(spark).filter("state = 'Ready'").select("level", "tile_offset")
    burnt = R.burn(V.pixels(spark).join(ready, R.TILE_KEY), parts.join(target, "s_suppkey").withColumnRenamed("s_suppkey", "rank"))
    return burnt.groupBy("level", "tile_offset").agg(F.sum("height").cast("long").alias("sum_h"))


@query(f"WITH {V.GEO_BOX} SELECT s_nationkey, {rs('min(s)')} AS s, {rs('min(w)')} AS w, {rs('max(n)')} AS n, {rs('max(e)')} AS e FROM gb JOIN supplier USING (s_suppkey) GROUP BY s_nationkey")
def a10_box_union(spark, sf_dir):
    """The box around all suppliers' boxes of each nation."""
    nations = V.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    boxes = V.geo_box(spark, sf_dir).join(nations, "s_suppkey").groupBy("s_nationkey").agg(*G.box_union(*map(F.col, "swne")))
    return boxes.select("s_nationkey", *(r(F.col(c)).alias(c) for c in "swne"))


def _folder(spark) -> str:
    """A folder that the executors share: the cluster's own, or a local one under a local master."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    base = sc.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else "")
    if base.startswith("file:") or base.startswith("/"):
        path = "/" + base.removeprefix("file:").lstrip("/")
        os.makedirs(path, exist_ok=True)
        return tempfile.mkdtemp(dir=path)
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a mounted folder that all executors share")
    return tempfile.mkdtemp(prefix="terrella-cog-")


def _sample_raster(spark) -> str:
    from terrella.sources import cog

    path = os.path.join(_folder(spark), "heights.tif")
    fine = ((np.arange(1024)[:, None] * 131 + np.arange(2048)[None, :] * 977) % 9000 - 500).astype(np.int16)
    cog.write(path, "heights", [fine, fine[::2, ::2]], 360 / 2048, empty={(0, 2)})
    cog.register(spark)
    return path


@query("SELECT 0 AS level, t::INT AS tile_offset, CASE WHEN t = 2 THEN 'Empty' ELSE 'Ready' END AS state, CASE WHEN t <> 2 THEN 524288 END AS n FROM range(0, 8) r(t) UNION ALL SELECT 1, t::INT, 'Ready', 524288 FROM range(0, 2) r(t)")
def c01_cog_scan(spark, sf_dir):
    """All tiles of a generated raster, unpacked."""
    t = spark.read.format("cog").option("path", _sample_raster(spark)).option("kind", "heights").load()
    return t.select("level", "tile_offset", "state", F.length("payload").alias("n"))


@query("SELECT t::INT AS tile_offset, t::INT AS tx FROM range(1, 3) r(t)")
def c02_cog_prune(spark, sf_dir):
    """Tiles of one level and column range; the filters reach the planning of partitions."""
    t = spark.read.format("cog").option("path", _sample_raster(spark)).option("payload", "false").load()
    return t.filter("level = 0 AND tx >= 1 AND tx <= 2 AND ty = 0").select("tile_offset", "tx")


@query(f"WITH {V.LAYERS} SELECT level, 'level ' || level || ': ' || width || ' x ' || height || ' px, ' || stride || ' tiles wide' AS txt FROM ly")
def d01_describe(spark, sf_dir):
    return V.layers(spark).select("level", F.format_string("level %d: %d x %d px, %d tiles wide", "level", "width", "height", "stride").alias("txt"))
