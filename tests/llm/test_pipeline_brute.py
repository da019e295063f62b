"""The whole pipeline against a direct computation, and its stages on odd rows."""

import hashlib
import math
import os
import random
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from terrella.llm import quality, segmentation
from terrella.llm.common import remainder
from terrella.llm.queries import MIX_SEED, MIX_WEIGHTS, QUALITY_FROM
from test_line_index import _key
from test_near_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for i in range(60):
        body = make(rng.randint(20, 60))
        lines = [" ".join(body[:12]), " ".join(body[12:])] + (["The same license line"] if i % 3 == 0 else [])
        rows.append((i, "\n".join(lines), "en", f"src{i % 4}"))
        if i % 5 == 0:
            rows.append((1000 + i, "\n".join([*lines, "more"]), "en", "src1"))
    rows += [(2000 + i, "9 9 !! 9 ?? 9 " * 8 + str(i), "en", "src0") for i in range(40)]  # junk
    rows += [(3000, "", "en", None), (3001, None, "en", "src2"), (None, rows[4][1], "en", "src3"), rows[7]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.mark.skipif(not os.path.exists(segmentation.DEFAULT_MODEL), reason="no vocabulary file")
def test_run_equals_direct_computation(spark, tmp_path):
    rows = _documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i, *_ in rows if i is not None and i < 3000], "doc_id long, quality int, toxic int").distinct()
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))

    model = quality.train(docs, labels, remainder(labels["doc_id"]) != 2)
    import numpy as np

    held = [r for r in rows if model.scores(np.array([quality.pooled((r[1] or "").encode(), model.vectors)]))[0] >= QUALITY_FROM]
    assert 60 < len(held) < len(rows) - 30
    refs = Counter(k for r in held for k in {_key(x) for x in (r[1] or "").split("\n")} if k)
    held = [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if not _key(x) or refs[_key(x)] < 10), r[3]) for r in held]
    left = []
    components = {}
    for (i, t, s), (_, n, component, _) in zip(held, _in_order(held), strict=True):
        components.setdefault(component if n else ("none", len(components)), []).append((i, t, s))
    for members in components.values():
        i, t, s = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        left.append((i, t, s))
    n, weight = Counter(s for _, _, s in left), lambda s: MIX_WEIGHTS.get(s, 1.0)
    mix = []
    for i, t, s in left:
        rate = weight(s) / sum(map(weight, n)) * len(left) / n[s]
        u = int(hashlib.md5(f"{MIX_SEED}|0|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        p = f = math.exp(-rate)
        copies = 0
        while f <= u:
            copies += 1
            p *= rate / copies
            f += p
        mix += [(i, t)] * copies
    vocab = segmentation.load()
    want = sorted((str(mix[g[0]][0]), g[1], tuple(g[2].tolist())) for g in segmentation.sample_group(vocab, mix, 2, 23))
    got = sorted((str(r["doc_id"]), r["rank"], tuple(r["ids"])) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want


def _in_order(held):
    """(id, size, component, kept) of each row, in the order of the rows; components have numbers of rows for ids here."""
    numbered = brute([(k, r[1]) for k, r in enumerate(held)], 5, 80)
    return sorted(numbered)


@pytest.mark.skipif(not os.path.exists(segmentation.DEFAULT_MODEL), reason="no vocabulary file")
def test_stages_on_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a text", "en", "a", 6), (1, "a text", "en", "a", 6), (2, "", None, "a", 0)]
    odd = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("gone", "row", "tkey", "__kept", "__score", "draws", "cdf", "__copy", "id")))
    for docs, n in ((odd, 5), (odd.limit(0), 0)):
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert k == 4 or out.columns == P.COLUMNS, name
            got = out.count()
            assert got == 0 if n == 0 else k in (0, 3, 4) or got == (4 if k == 2 else 5), name
