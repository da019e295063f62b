"""The corpus pipeline: stages that turn raw documents into training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next.
All but the last return the columns of ``documents``; other columns of the input are dropped, whatever their names.

Defined results, in all stages: a null text counts as empty and an empty table gives an empty one.  A row with a null id is
a document like any other, and rows that repeat an id are documents of their own, except that near-dedup keeps one of the
rows that repeat both id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm import quality, segmentation
from terrella.llm.common import remainder, written
from terrella.llm.line_dedup import line_dedup
from terrella.llm.mixing import mixed
from terrella.llm.near_dedup import keep_one
from terrella.llm.queries import MIX_SEED, MIX_WEIGHTS, QUALITY_FROM

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from ``labels`` as the query op5 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, remainder(labels["doc_id"]) != 2)
    return quality.score(docs.select(COLUMNS), model).filter(F.col("__score") >= QUALITY_FROM).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold; a document may be left with an empty text."""
    out = line_dedup(docs.select(COLUMNS), min_docs=10, min_chars=1)
    return out.withColumn("text", F.col("__kept")).withColumn("n_chars", F.length("__kept").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component (five words, similarity of 0.8 or more): that with the smallest id, a null
    id coming last.  Rows without words are nobody's copies and all stay."""
    return keep_one(docs.select(COLUMNS), words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The target mix of sources, globally shuffled; a document's copies are rows of their own.  A null source is a source."""
    return mixed(docs.select(COLUMNS), MIX_WEIGHTS, seed=MIX_SEED).select(COLUMNS)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row of the mix, as piece ids; an empty text has the empty one alone."""
    out = segmentation.sample(docs, segmentation.vocabulary(spark), k=2)
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", segment),
]

#: The first, third and last stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
