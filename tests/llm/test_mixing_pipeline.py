"""Poisson mixing against direct computation, and the corpus pipeline stage by stage."""

import hashlib
import math
import os
from collections import Counter

import corpus_pipeline as P
import pytest
from terrella.llm.mixing import COPY, mixed

SF = "/root/testdata/sf0.001"


def _copies(key, rate, seed):
    draws = max(1, math.ceil(rate / 300))
    n = 0
    for i in range(draws):
        u = int(hashlib.md5(f"{seed}|{i}|{key}".encode()).hexdigest()[:13], 16) / 2**52
        p = f = math.exp(-rate / draws)
        k = 0
        while f <= u and k < 5000:
            k += 1
            p *= rate / draws / k
            f += p
        n += k
    return n


def test_mixing_equals_direct_draws(spark):
    rows = [(i, f"t{i}", ("a", "b", None, "tiny")[0 if i < 200 else 1 if i < 290 else 2 if i < 299 else 3], 1) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[0], (None, "n", "a", 1)], "doc_id long, text string, source string, count int")
    weights = {"a": 1.0, "b": 0.0, "tiny": 6.0}
    got = Counter((r["doc_id"], r["source"]) for r in mixed(df, weights, seed=3).collect())
    total, n, w = 302, Counter(r[2] for r in [*rows, rows[0], (None, "n", "a", 1)]), {"a": 1.0, "b": 0.0, None: 1.0, "tiny": 6.0}
    want = Counter()
    for i, _, s, _ in [*rows, rows[0], (None, "n", "a", 1)]:
        want[(i, s)] += _copies("" if i is None else i, w[s] / 8 * total / n[s], 3)
    assert got == Counter({k: v for k, v in want.items() if v})
    assert got[(299, "tiny")] > 150
    copies = [r[COPY] for r in mixed(df, weights, seed=3).filter("doc_id = 299").collect()]
    assert sorted(copies) == list(range(1, len(copies) + 1))
    assert mixed(df.limit(0), weights).collect() == []


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.filter("NOT exact").isEmpty() and docs.count() > 0
    assert len(P.STAGES) == 5
