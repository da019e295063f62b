"""Virtual columns that turn the driver's tables into positions, boxes, shapes and rasters, for Spark and as SQL.

Both forms use the same whole-number arithmetic, so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.functions.vectors import Vec3

TILE = 32
LEVELS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(key: str):
    return ((F.col(key) * 7919) % 17900) / F.lit(100.0) - F.lit(89.5)


def _lon(key: str):
    return ((F.col(key) * 104729) % 36000) / F.lit(100.0) - F.lit(180.0)


def geo_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_nationkey", _lat("c_custkey").alias("lat_deg"), _lon("c_custkey").alias("lon_deg"), F.col("c_acctbal").alias("asl_m"))


def geo_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("half", (F.col("s_suppkey") % 5 + 1) * F.lit(0.05))
    lat, lon, half = _lat("s_suppkey"), _lon("s_suppkey"), F.col("half")
    return s.select("s_suppkey", (lat - half).alias("s"), (lon - half).alias("w"), (lat + half).alias("n"), (lon + half).alias("e"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and twelve doubles e0 .. e11 of an embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(12)))


def e(first: int) -> Vec3:
    return Vec3(*(F.col(f"e{first + k}") for k in range(3)))


def layers(spark: SparkSession) -> DataFrame:
    level = F.col("level")
    df = spark.range(LEVELS).select(F.col("id").cast("int").alias("level"))
    side = lambda n: F.floor(F.lit(n) / F.pow(F.lit(2.0), level)).cast("int")
    df = df.select("level", side(720).alias("width"), side(360).alias("height"), (F.lit(0.5) * F.pow(F.lit(2.0), level)).alias("scale_deg"), F.lit(90.0).alias("tie_lat"), F.lit(-180.0).alias("tie_lon"))
    return df.withColumn("stride", F.ceil(F.col("width") / TILE).cast("int"))


def pixels(spark: SparkSession) -> DataFrame:
    spots = layers(spark).withColumn("row", F.explode(F.expr("sequence(0, height - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, width - 1)")))
    h = (F.col("row") * 131 + F.col("col") * 977 + F.col("level") * 7) % 9000 - 500
    t = F.expr(f"cast((row div {TILE}) * stride + (col div {TILE}) AS int)")
    return spots.select("level", t.alias("tile_offset"), "row", "col", h.cast("int").alias("height"))


def residency(spark: SparkSession) -> DataFrame:
    tiles = layers(spark).withColumn("tile_offset", F.explode(F.expr(f"sequence(0, stride * cast(ceil(height / {TILE}) AS int) - 1)")))
    missing = (F.col("level") < 3) & ((F.col("tile_offset") * 17 + F.col("level")) % 11 == 0)
    empty = (F.col("tile_offset") + F.col("level")) % 13 == 5
    return tiles.select("level", "tile_offset", F.when(missing, "Missing").when(empty, "Empty").otherwise("Ready").alias("state"), F.lit(2 * TILE * TILE).alias("nbytes"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("ts", "event_id", F.col("user_id").alias("entity_id"), (F.col("event_id") % 13).cast("int").alias("level"), (F.col("event_id") % 97).cast("int").alias("tile_offset"), "value")


_LAT = "(({k} * 7919) % 17900) / 100 - 89.5::DOUBLE"
_LON = "(({k} * 104729) % 36000) / 100 - 180.0::DOUBLE"
GEO_CUSTOMER = f"gc AS (SELECT c_custkey, c_nationkey, {_LAT.format(k='c_custkey')} AS lat_deg, {_LON.format(k='c_custkey')} AS lon_deg, c_acctbal AS asl_m FROM customer)"
GEO_BOX = f"""gb0 AS (SELECT s_suppkey, {_LAT.format(k='s_suppkey')} AS la, {_LON.format(k='s_suppkey')} AS lo, (s_suppkey % 5 + 1) * 0.05::DOUBLE AS half FROM supplier),
    gb AS (SELECT s_suppkey, la - half AS s, lo - half AS w, la + half AS n, lo + half AS e FROM gb0)"""
SHAPES = "sh AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(12)) + " FROM embeddings)"
LAYERS = f"ly AS (SELECT l::INT AS level, (720 >> l)::INT AS width, (360 >> l)::INT AS height, 0.5::DOUBLE * pow(2.0::DOUBLE, l) AS scale_deg, 90.0::DOUBLE AS tie_lat, -180.0::DOUBLE AS tie_lon, ceil((720 >> l) / {TILE})::INT AS stride FROM range(0, {LEVELS}) t(l))"
PIXELS = f"""pr AS (SELECT *, unnest(range(0, height))::INT AS row FROM ly), pc AS (SELECT *, unnest(range(0, width))::INT AS col FROM pr),
    px AS (SELECT level, ((row // {TILE}) * stride + col // {TILE})::INT AS tile_offset, row, col, ((131 * row + 977 * col + 7 * level) % 9000 - 500)::INT AS height FROM pc)"""
RESIDENCY = f"""rt AS (SELECT *, unnest(range(0, stride * ceil(height / {TILE})::INT))::INT AS tile_offset FROM ly),
    rs AS (SELECT level, tile_offset, CASE WHEN level < 3 AND (17 * tile_offset + level) % 11 = 0 THEN 'Missing' WHEN (tile_offset + level) % 13 = 5 THEN 'Empty' ELSE 'Ready' END AS state, {2 * TILE * TILE} AS nbytes FROM rt)"""
NOTIFICATIONS = "nt AS (SELECT ts, event_id, user_id AS entity_id, (event_id % 13)::INT AS level, (event_id % 97)::INT AS tile_offset, value FROM events)"


def place_sql(lat: str, lon: str) -> str:
    """Columns row, col, tile_offset and oob of a position, over a row of ``ly``."""
    u, v = f"(({lon}) - tie_lon) / (scale_deg * width)", f"(tie_lat - ({lat})) / (scale_deg * height)"
    uw, vc = f"({u} - floor({u}))", f"least(greatest({v}, 0.0::DOUBLE), 1.0::DOUBLE)"
    col, row = f"least(floor({uw} * width)::INT, width - 1)", f"least(floor({vc} * height)::INT, height - 1)"
    return f"{row} AS row, {col} AS col, (({row} // {TILE}) * stride + {col} // {TILE})::INT AS tile_offset, ({uw} <> {u} OR {vc} <> {v}) AS oob"
