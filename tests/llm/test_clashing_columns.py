"""Every operator with extra columns that have the names of its inner columns and results."""

import os

import pytest
from pyspark.sql import functions as F
from terrella.llm import language_id, quality, segmentation
from terrella.llm.exact_dedup import exact_dedup
from terrella.llm.html_text import extract_pages
from terrella.llm.line_dedup import line_dedup
from terrella.llm.media import media_features
from terrella.llm.mixing import mixed
from terrella.llm.near_dedup import keep_one, near_duplicates
from terrella.llm.personal_data import personal_data

NAMES = "id row key rank node draws cdf rate count copy order u n hi lo refs gone tkey shard salt salts __salt __salts __key __id __text __score __kept __copy __u __n __source spans base more media digest seq packed label component set bands size first kept ids test lang_pred score page_id".split()
ROWS = [(1, "Some words of a text, mail a@b.org", "a", "en"), (2, "Some words of a text, mail a@b.org", "b", "en"), (None, None, None, None), (1, "", "a", "de"), (3, "other words that are here\nand here", "c", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    return df.select("*", *(F.lit(7).alias(c) for c in NAMES))


def _same(out, docs, dropped=()):
    """The rows of an output that carries its input's columns."""
    names = [c for c in docs.columns if c in out.columns and c not in dropped]
    assert set(NAMES) - set(dropped) <= set(out.columns)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, out.select(names).collect())) == sorted(map(key, docs.select(names).collect()))


def test_carrying_operators(docs):
    _same(line_dedup(docs), docs, ("__kept",))
    _same(line_dedup(docs, broadcast_bytes=0), docs, ("__kept",))
    _same(extract_pages(docs, html_col="text"), docs, ("__text",))
    model = quality.train(docs, docs.select("doc_id", F.lit(1).alias("quality")), F.lit(True))
    _same(quality.score(docs, model), docs, ("__score",))
    out = mixed(docs, {"a": 3.0})
    assert set(out.columns) == set(docs.columns) and out.filter("`key` <> 7 OR cdf <> 7").isEmpty()
    kept = keep_one(docs, words=3)
    assert kept.columns == docs.columns and kept.count() == 4


def test_other_operators(docs):
    n = len(ROWS)
    assert near_duplicates(docs, words=3).count() == n
    assert exact_dedup(docs).count() == n
    assert media_features(docs).count() == n
    assert personal_data(docs).count() == n
    model = language_id.train(docs, docs["doc_id"].isNotNull())
    assert language_id.identify(docs, model).count() == n


@pytest.mark.skipif(not os.path.exists(segmentation.DEFAULT_MODEL), reason="no vocabulary file")
def test_segmentation(docs):
    vocab = segmentation.load()
    assert segmentation.sample(docs, vocab).filter("NOT exact").isEmpty()
    _same(segmentation.decode(segmentation.encode(docs), vocab), docs, ("ids",))
