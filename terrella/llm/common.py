"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: A key that holds at least one row in HOT_PARTS is hot: there can be no more than HOT_PARTS such keys.
HOT_PARTS = 1000

#: Space, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = b" \t\n\x0b\x0c\r"


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder of this process, and a cluster an error, as its
    executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="terrella-")
    sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_base(spark)}/terrella-{uuid.uuid4().hex}/{name}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            if jvm is not None:
                parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
                parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
        except Exception:  # noqa: BLE001 - the gateway may be gone at exit
            pass

    atexit.register(remove)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of each query as soon as that query has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts its lineage and lets its shuffle files go."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows of an Arrow batch of this session, so that long texts do not pile up in a Python worker.

    A larger bound is lowered and stays so: plans made here read it when they run, after the call that made them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def with_added(df: DataFrame, **added: str) -> StructType:
    """The schema of ``df`` and added columns."""
    return StructType([*df.schema.fields, *(StructField(name, _parse_datatype_string(kind)) for name, kind in added.items())])


def hot_keys(counts: DataFrame, keys: list[str], total: int, count: str = "count", parts: int = HOT_PARTS) -> DataFrame:
    """Keys with at least ``total / parts`` of the rows and the number of salts for each; at most ``parts`` rows."""
    least = max(2, -(-total // parts))
    return counts.filter(F.col(count) >= least).select(*keys, F.least(F.lit(parts), F.ceil(F.col(count) / least)).cast("int").alias("__salts"))


def salted(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small`` (one row a key) where a hot key of ``big`` goes to many tasks.

    ``hot`` comes from :func:`hot_keys`, so it has at most HOT_PARTS rows and may be broadcast; the rows of ``small``
    with a hot key are repeated once a salt, at most 2 * HOT_PARTS rows more.  Null keys of ``big`` are spread too.
    """
    hot = F.broadcast(hot)
    blank = None
    for k in keys:
        blank = F.col(k).isNull() if blank is None else blank | F.col(k).isNull()
    left = big.join(hot, keys, "left")
    left = left.withColumn("__salt", F.when(blank, F.pmod(spread, F.lit(1 << 20))).when(F.col("__salts").isNotNull(), F.pmod(spread, F.col("__salts"))).otherwise(0).cast("int")).drop("__salts")
    right = small.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
