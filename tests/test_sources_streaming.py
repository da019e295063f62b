"""The raster source on a generated file, and maintenance folds as batch and as stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from terrella.operators import mesh as M
from terrella.sources import cog
from terrella.streaming import maintenance as T


@pytest.fixture(scope="module")
def raster(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cog") / "h.tif")
    fine = ((np.arange(1024)[:, None] * 131 + np.arange(2048)[None, :] * 977) % 9000 - 500).astype(np.int16)
    cog.write(path, "heights", [fine, fine[::2, ::2]], 360 / 2048, empty={(0, 2)})
    return path, fine


def test_layers_and_tiles(spark, raster, tmp_path):
    path, fine = raster
    cog.register(spark)
    layers = cog.layers_of(spark, path).orderBy("level").collect()
    assert [(r["width"], r["height"], r["stride"], r["n_tiles"]) for r in layers] == [(2048, 1024, 4, 8), (1024, 512, 2, 2)]
    assert layers[1]["scale_deg"] == 2 * layers[0]["scale_deg"]
    read = lambda **o: spark.read.format("cog").option("path", path).options(**o).load()
    rows = {(r["level"], r["tile_offset"]): r for r in read(cache=str(tmp_path)).collect()}
    assert len(rows) == 10 and rows[(0, 2)]["state"] == "Empty" and rows[(0, 2)]["payload"] is None
    tile = np.frombuffer(rows[(0, 5)]["payload"], "<i2").reshape(512, 512)
    assert (tile == fine[512:, 512:1024]).all()
    assert len(list(tmp_path.rglob("*.dat"))) >= 9
    assert {(r["level"], r["tile_offset"]) for r in read(cache=str(tmp_path)).filter("level = 1").collect()} == {(1, 0), (1, 1)}
    assert read(payload="false").filter("level = 0 AND ty = 1").rdd.getNumPartitions() == 1
    px = cog.pixels_of(read().filter("level = 1 AND tile_offset = 1"))
    assert px.agg(F.sum("height")).first()[0] == int(fine[::2, ::2][:, 512:].astype(np.int64).sum())


def test_colours(spark, tmp_path):
    path = str(tmp_path / "c.tif")
    rgb = np.random.default_rng(1).integers(0, 256, (512, 1024, 3), np.uint8)
    cog.write(path, "colors", [rgb], 360 / 1024)
    cog.register(spark)
    body = spark.read.format("cog").option("path", path).option("kind", "colors").load().filter("tile_offset = 1").first()["payload"]
    got = np.frombuffer(body, np.uint8).reshape(512, 512, 4)
    assert (got[..., :3] == rgb[:, 512:]).all() and (got[..., 3] == 255).all()


def test_bad_files(raster, tmp_path):
    data = open(raster[0], "rb").read()
    for name, change in {"order": (0, b"MM"), "version": (2, b"\x2a\0")}.items():
        bad = tmp_path / name
        bad.write_bytes(data[: change[0]] + change[1] + data[change[0] + len(change[1]) :])
        with pytest.raises(cog.CogError):
            cog.parse(str(bad), "heights")
    with pytest.raises(cog.CogError):
        cog.parse(raster[0], "colors")


def _notes(spark):
    rows = [(F"2024-01-01 00:00:{s:02d}", i, i % 3, (7 - i) % 5, i, float(i * 10), i > 3) for i, s in enumerate(range(20))]
    return spark.createDataFrame(rows, "ts string, event_id long, entity_id long, level int, tile_offset int, value double, ready boolean").withColumn("ts", F.to_timestamp("ts"))


def test_streams_equal_batches(spark, tmp_path):
    notes = _notes(spark)
    for k in range(4):
        notes.filter(f"event_id div 5 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(notes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, fn, mode in (("finest", T.stream_refinement, "update"), ("first", T.stream_decisions, "append")):
        q = fn(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finest = {r["entity_id"]: r["m"] for r in spark.table("finest").groupBy("entity_id").agg(F.min("level").alias("m")).collect()}
    assert finest == {r["entity_id"]: r["level"] for r in T.best_refinement(notes).collect()}
    first = {r["entity_id"]: r["target"] for r in spark.table("first").collect()}
    assert first == {r["entity_id"]: r["target"] for r in T.decided_once(notes, F.col("ready"), F.col("value")).collect()}
    seen = []
    T.tick([lambda b, n: seen.append(("a", n)), lambda b, n: seen.append(("b", n))])(notes, 7)
    assert seen == [("a", 7), ("b", 7)]


def test_subdivision_tables(spark):
    before = []
    for level in range(4):
        tris, deps = M.subdivided(spark, level)
        table = [tuple(r) for r in deps.orderBy("idx").collect()]
        assert len(table) == (2**level + 1) * (2**level + 2) // 2 and table[: len(before)] == before
        before = table
        assert tris.count() == 4**level
    for level in (0, 2):
        lines = M.line_list(spark, level).filter("winding = 'full'").orderBy("pos").collect()
        pairs = {tuple(sorted((lines[i]["index"], lines[i + 1]["index"]))) for i in range(0, len(lines), 2)}
        tris = M.subdivided(spark, level)[0].collect()
        edges = {tuple(sorted(p)) for t in tris for p in ((t["i0"], t["i1"]), (t["i1"], t["i2"]), (t["i2"], t["i0"]))}
        assert pairs == edges
        strip = [r["index"] for r in M.triangle_strip(spark, level).filter("winding = 'full'").orderBy("pos").collect()]
        made = {tuple(sorted(strip[i : i + 3])) for i in range(len(strip) - 2) if len(set(strip[i : i + 3])) == 3}
        assert made >= {tuple(sorted((t["i0"], t["i1"], t["i2"]))) for t in tris}
