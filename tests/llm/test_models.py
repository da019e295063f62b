"""Language identification and quality: held-out accuracy, and the cases that need a defined result."""

import os
import zlib

import pytest
from pyspark.sql import functions as F
from terrella.llm import language_id, quality
from terrella.llm.common import remainder

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@needs_data
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, remainder(docs["doc_id"]) != 2)
    out = language_id.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").filter(remainder(F.col("id")) == 2)
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert right / n > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (None, "the of and is"), (4, "x" * 3_000_000)], "doc_id long, text string")
    rows = {r["id"]: r for r in language_id.identify(odd, model).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert rows[None]["lang_pred"] == "en" and rows[4]["lang_pred"] in model.languages and 0 <= rows[4]["score"] <= 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert [r["lang_pred"] for r in language_id.identify(docs, model).collect()] == ["und"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.train(docs, labels, F.lit(True))
    assert [r["__score"] for r in quality.score(docs, q).collect()] == [0.5]


@needs_data
def test_quality_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, remainder(labels["doc_id"]) != 2)
    out = quality.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["__score"] >= 0.7) == bool(r["quality"]) for r in held)
    assert right / len(held) > 0.9
    odd = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "é" * 100_000, 3)], "doc_id long, text string, quality int")
    assert all(0 <= r["__score"] <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(odd.limit(0), model).collect() == []
