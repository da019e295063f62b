"""Tiled rasters: pruning regions to tiles, probing pixels, interpolation, fallback over levels, statistics, burning.

Regions and positions meet tiles by equality: a region is expanded to the tile numbers it covers with ``sequence`` and
``explode``, so no range join and no nested loop is planned.  ``layers`` has one row a level: level, width, height,
scale_deg, tie_lat, tie_lon, stride; it is a dimension of at most some dozens of rows and is broadcast.
``pixels`` has level, tile_offset, row, col, height; ``residency`` has level, tile_offset and state, which is ``Ready``,
``Empty`` (all heights are 0) or ``Missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.functions.levels import tile_place
from terrella.functions.scalars import trunc, untrunc

TILE_KEY = ["level", "tile_offset"]


def _tile_numbers(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo.cast("int"), hi.cast("int")))


def region_tiles(regions: DataFrame, layers: DataFrame, tile: int, border: int = 0) -> DataFrame:
    """The tiles of each layer that each region (s, w, n, e in degrees) covers, by index arithmetic.

    ``border`` widens the region by pixels.  Tiles outside the raster are left out.
    """
    j = regions.crossJoin(F.broadcast(layers))  # a dimension with one row a level
    px = lambda lon: (lon - F.col("tie_lon")) / F.col("scale_deg")
    py = lambda lat: (F.col("tie_lat") - lat) / F.col("scale_deg")
    rows = F.ceil(F.col("height") / tile)
    x0, x1 = F.floor((px(F.col("w")) - border) / tile), F.floor((px(F.col("e")) + border) / tile)
    y0, y1 = F.floor((py(F.col("n")) - border) / tile), F.floor((py(F.col("s")) + border) / tile)
    j = j.withColumn("__x0", F.greatest(x0, F.lit(0))).withColumn("__x1", F.least(x1, F.col("stride") - 1)).withColumn("__y0", F.greatest(y0, F.lit(0))).withColumn("__y1", F.least(y1, rows - 1))
    j = j.filter("__x0 <= __x1 AND __y0 <= __y1")
    j = j.withColumn("tx", _tile_numbers(F.col("__x0"), F.col("__x1"))).withColumn("ty", _tile_numbers(F.col("__y0"), F.col("__y1")))
    return j.withColumn("tile_offset", (F.col("ty") * F.col("stride") + F.col("tx")).cast("int")).drop("__x0", "__x1", "__y0", "__y1")


def with_state(tiles: DataFrame, residency: DataFrame) -> DataFrame:
    """Tiles and their state; a tile that the table does not have is missing."""
    return tiles.join(residency.select(*TILE_KEY, "state"), TILE_KEY, "left").withColumn("state", F.coalesce("state", F.lit("Missing")))


def place(points: DataFrame, layers: DataFrame, tile: int, lat: str = "lat_deg", lon: str = "lon_deg") -> DataFrame:
    """Each position's tile and pixel in each layer."""
    j = points.crossJoin(F.broadcast(layers))  # a dimension with one row a level
    at = tile_place(F.col(lat), F.col(lon), F.col("tie_lat"), F.col("tie_lon"), F.col("scale_deg"), F.col("width"), F.col("height"), tile)
    return j.withColumns(at)


def probe(samples: DataFrame, pixels: DataFrame, residency: DataFrame | None = None) -> DataFrame:
    """The height under each sample: 0 in an empty tile, null in a missing one."""
    hit = samples.join(pixels.select("level", "tile_offset", "row", "col", "height").withColumnRenamed("height", "__h"), ["level", "tile_offset", "row", "col"], "left")
    if residency is None:
        return hit.withColumnRenamed("__h", "asl")
    state = with_state(hit, residency)
    return state.withColumn("asl", F.when(F.col("state") == "Empty", F.lit(0)).when(F.col("state") == "Ready", F.col("__h"))).drop("__h")


def grid(regions: DataFrame, tile: int, border: int = 0) -> DataFrame:
    """The aligned grid of samples over each region at its layer: gx, gy (from the south-west), lat, lon and the place of
    each sample's pixel.

    Low edges are cut off and high edges cut off plus one, so a grid always surrounds its region; each sample is looked
    up half a pixel further in but reported where it is.
    """
    px = lambda lon: (lon - F.col("tie_lon")) / F.col("scale_deg")
    up = lambda lat: (lat - (F.col("tie_lat") - F.col("height") * F.col("scale_deg"))) / F.col("scale_deg")
    df = regions.withColumn("__x0", trunc(px(F.col("w"))) - border).withColumn("__x1", untrunc(px(F.col("e"))) + border)
    df = df.withColumn("__y0", trunc(up(F.col("s"))) - border).withColumn("__y1", untrunc(up(F.col("n"))) + border)
    df = df.withColumn("gx", F.explode(F.sequence(F.lit(0), (F.col("__x1") - F.col("__x0")).cast("int")))).withColumn("gy", F.explode(F.sequence(F.lit(0), (F.col("__y1") - F.col("__y0")).cast("int"))))
    lon = F.col("tie_lon") + (F.col("__x0") + F.col("gx")) * F.col("scale_deg")
    lat = F.col("tie_lat") - F.col("height") * F.col("scale_deg") + (F.col("__y0") + F.col("gy")) * F.col("scale_deg")
    df = df.withColumn("lat", lat).withColumn("lon", lon)
    at = tile_place(F.col("lat") + F.col("scale_deg") / 2, F.col("lon") + F.col("scale_deg") / 2, F.col("tie_lat"), F.col("tie_lon"), F.col("scale_deg"), F.col("width"), F.col("height"), tile)
    return df.withColumns(at).drop("__x0", "__x1", "__y0", "__y1")


def displaced(samples: DataFrame, pixels: DataFrame, residency: DataFrame) -> DataFrame:
    """Grid samples with heights; samples beyond the raster are 0."""
    found = probe(samples, pixels, residency)
    return found.withColumn("asl", F.when(F.col("oob"), F.lit(0)).otherwise(F.col("asl")))


def whole_grids(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of grids all of whose samples have a height."""
    return samples.groupBy(*keys).agg(F.bool_and(F.col("asl").isNotNull()).alias("whole")).filter("whole").drop("whole")


def finest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's complete levels, the finest."""
    return rows.groupBy(*keys).agg(F.min("level").alias("level"))


def grid_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg("asl").alias("avg_asl"), F.min("asl").alias("min_asl"), F.max("asl").alias("max_asl"), F.count("*").alias("n_samples"))


def corner_heights(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest and highest height of the corners of each whole grid's region (s, w, n, e), between the samples around them.

    Each sample counts for a corner by its tent function, which is the interpolation between four samples, so one
    aggregation does for all corners.
    """
    tent = lambda at, spot: F.greatest(F.lit(0.0), 1 - F.abs(F.col(at) - F.col(spot)) / F.col("scale_deg"))
    sums = [F.sum(F.col("asl") * tent("lat", y) * tent("lon", x)).alias(f"__{y}{x}") for y in "sn" for x in "we"]
    found = samples.groupBy(*keys).agg(*sums, F.bool_and(F.col("asl").isNotNull()).alias("__whole")).filter("__whole")
    corners = [F.col(f"__{y}{x}") for y in "sn" for x in "we"]
    return found.select(*keys, F.least(*corners).alias("lowest_corner"), F.greatest(*corners).alias("highest_corner"))


def flatten_target(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The height to flatten each region to: the mean of its finest whole grid, to the whole number below."""
    means = samples.groupBy(*keys, "level").agg(F.avg("asl").alias("mean"), F.bool_and(F.col("asl").isNotNull()).alias("whole")).filter("whole")
    return means.groupBy(*keys).agg(F.floor(F.min_by("mean", "level")).cast("int").alias("value"))


def bilinear(points: DataFrame, pixels: DataFrame, tile: int, lat: str = "lat_deg", lon: str = "lon_deg") -> DataFrame:
    """Height between the four pixel corners around a position of a layer row (one per row of ``points``).

    The corner samples have a pixel's height each; they are met by one equality join on the exploded corners and pivoted
    back by an aggregation, so the raster is shuffled once.
    """
    sx = (F.col(lon) - F.col("tie_lon")) / F.col("scale_deg")
    sy = (F.col("tie_lat") - F.col(lat)) / F.col("scale_deg")
    df = points.withColumn("__cx", F.floor(sx)).withColumn("__cy", F.floor(sy)).withColumn("fx", sx - F.floor(sx)).withColumn("fy", sy - F.floor(sy))
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    df = df.withColumn("__c", corners)
    col = F.pmod(F.col("__cx") + F.col("__c.i"), F.col("width").cast("long"))
    row = F.least(F.greatest(F.col("__cy") + F.col("__c.j"), F.lit(0)), F.col("height").cast("long") - 1)
    df = df.withColumn("row", row.cast("int")).withColumn("col", col.cast("int"))
    df = df.withColumn("tile_offset", (F.floor(F.col("row") / tile) * F.col("stride") + F.floor(F.col("col") / tile)).cast("int"))
    weight = F.when(F.col("__c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("__c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    return df.withColumn("weight", weight).drop("__c", "__cx", "__cy")


def burn(pixels: DataFrame, rectangles: DataFrame) -> DataFrame:
    """Pixels with constant heights burnt into half-open rectangles (level, tile_offset, r0, r1, c0, c1, value, rank).

    Where rectangles overlap, the highest rank wins.  Values are clamped to 16 bits.
    """
    spots = rectangles.filter("r0 < r1 AND c0 < c1").withColumn("row", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("col", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
    best = spots.groupBy("level", "tile_offset", "row", "col").agg(F.max(F.struct("rank", "value")).alias("top"))
    value = F.col("top.value")
    clamped = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(-32768)), F.lit(32767))).cast("int")  # greatest() skips nulls
    return pixels.join(best, ["level", "tile_offset", "row", "col"], "left").withColumn("height", F.coalesce(clamped, F.col("height"))).drop("top")


def resident_bytes(tiles: DataFrame) -> DataFrame:
    """Bytes held per level: payload lengths of tiles that are ready."""
    return tiles.groupBy("level").agg(F.sum(F.when(F.col("state") == "Ready", F.col("nbytes")).otherwise(0)).alias("bytes"))
