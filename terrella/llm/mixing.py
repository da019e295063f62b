"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of ``n`` rows and share ``w`` of the target of ``T`` rows has the repetition rate ``w * T / n``.  A row of it
gets a number of copies from a Poisson distribution with that mean: a hash of the seed and the row's id gives a number
between 0 and 1, and the distribution function, tabulated once a source, is inverted at it.  Rates beyond ``SPLIT``
are the sum of as many independent draws as keep each below it.  The copies are exploded and shuffled globally: they
are partitioned and sorted by a hash of seed, id and copy.

Rates have one row a source.  They are broadcast when there are at most ``BROADCAST_SOURCES`` of them (counted first),
and else joined with salts for the sources that hold many rows.

Defined results: a null source is a source of its own; sources without a weight have ``default_weight``; a weight of 0
drops a source; a null id draws as the empty text; rows that repeat an id draw alike; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import hot_keys, salted, written

SPLIT = 300.0
BROADCAST_SOURCES = 10_000
COPY = "__copy"


def unit(*parts: Column) -> Column:
    """A number in [0, 1): the first 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, 2, ... as an array, as far as it stays below 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.filter(F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"]), lambda c: c < 1)


def rates(docs: DataFrame, weights: dict[str, float], default_weight: float, scale: float, source_col: str) -> DataFrame:
    """One row a source: key, count, rate, draws and the distribution function of one draw.  The counts are written once."""
    name = docs[source_col].cast("string")
    counts = written(docs.groupBy(name.alias("source")).count(), "sources")
    weight = F.lit(float(default_weight))
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("count").alias("n")).first()  # one row
    rate = F.col("weight") / F.lit(float(sums["w"] or 1)) * F.lit(float(sums["n"] or 0) * scale) / F.col("count")
    out = weighed.withColumn("rate", rate).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int"))
    return out.withColumn("cdf", distribution(F.col("rate") / F.col("draws"))).withColumn("key", _source_key(F.col("source")))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def mixed(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, scale: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, as many rows of each as drawn, and ``__copy`` (from 1), in a global random order.

    A row of ``docs`` travels as one struct, so its columns may have any names; one called ``__copy`` is replaced.
    """
    table = rates(docs, weights, default_weight, scale, source_col)
    id_text = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    kept = [docs[c] for c in docs.columns if c != COPY]
    named = docs.select(F.struct(*kept).alias("row"), _source_key(docs[source_col].cast("string")).alias("key"), id_text.alias("id"))
    small = table.select("key", "draws", "cdf")
    n_sources, total = table.agg(F.count("*"), F.sum("count")).first()
    if n_sources <= BROADCAST_SOURCES:
        joined = named.join(F.broadcast(small), "key")
    else:
        joined = salted(named, small, ["key"], hot_keys(table, ["key"], total), F.xxhash64("id"))
    copies = F.aggregate(
        F.sequence(F.lit(0), F.col("draws") - 1),
        F.lit(0),
        lambda n, i: n + F.size(F.filter("cdf", lambda c: c <= F.when(i == 0, F.col("u")).otherwise(unit(F.lit(str(seed)), i.cast("string"), F.col("id"))))),
    )
    counted = joined.withColumn("u", unit(F.lit(str(seed)), F.lit("0"), F.col("id"))).withColumn("n", copies).filter("n > 0").select("row", "id", "n")
    spread = counted.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}order"), "id", F.col("copy").cast("string")))
    return spread.withColumn("order", order).repartition("order").sortWithinPartitions("order").select("row.*", F.col("copy").alias(COPY))
