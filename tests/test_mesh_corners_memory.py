"""Corners of triangles are looked up without a broadcast of vertices, and grids are spread before they are exploded."""

import duckdb
from pyspark.sql import functions as F
from terrella.operators import mesh as M
from terrella.plans.catalogue import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vertices_are_not_broadcast(spark):
    tris = spark.createDataFrame([(1, 0, 0, 1, 2), (2, 0, 2, 1, 0)], "obj long, idx int, i0 int, i1 int, i2 int")
    verts = spark.range(1, 3).select(F.col("id").alias("obj"), F.explode(F.expr("array(0, 1, 2)")).alias("idx")).withColumns({a: (F.col("idx") + k).cast("double") for k, a in enumerate("xyz")})
    got = M.mesh_corners(tris, verts, ["obj"])
    assert "BroadcastExchange" not in _plan(got)
    assert sorted((r["obj"], r["x0"], r["y1"], r["z2"]) for r in got.collect()) == [(1, 0.0, 2.0, 4.0), (2, 2.0, 2.0, 2.0)]


def test_grids_are_spread(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT range AS s_suppkey FROM range(20001)) TO '{tmp_path}/supplier.parquet'")
    df = QUERIES["t05_trimesh"](spark, str(tmp_path))
    plan = _plan(df)
    assert "BroadcastExchange" not in plan and plan.count("11), REPARTITION_BY_NUM") >= 4
    want = [sum((3 + s % 4) * (2 + s % 3) for s in range(20001)) * k for k in (2, 1)] + [sum(6 * (3 + s % 4) * (2 + s % 3) - 1 for s in range(20001))]
    assert list(df.agg(F.sum("n"), F.sum("area"), F.sum("last")).first()) == want
