"""Exact and line deduplication against brute force, and the cuckoo filter and its indexes."""

import hashlib
import random
from collections import Counter

import pytest
from terrella.llm import exact_dedup as X
from terrella.llm import line_dedup as D
from terrella.llm.cuckoo import CuckooFilter, Full

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cuckoo_filter():
    rng = random.Random(4)
    keys = [rng.getrandbits(64) for _ in range(5000)]
    f = CuckooFilter.of(keys)
    assert all(k in f for k in keys)
    others = [rng.getrandbits(64) for _ in range(5000)]
    assert sum(k in f for k in others) < 25
    for k in keys[:2500]:
        assert f.delete(k)
    assert all(k in f for k in keys[2500:])
    g = CuckooFilter.from_bytes(f.to_bytes())
    assert g.live == f.live and all(k in g for k in keys[2500:])
    import numpy as np

    assert g.probe(np.array(keys[2500:], np.uint64)).all()
    small = CuckooFilter(1)
    with pytest.raises(Full):
        for k in keys:
            small.insert(k)


def test_exact_index_resizes_and_deletes():
    index = X.ExactIndex(1)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(500)]
    assert all(index.insert(d, 3, (5, i)) for i, d in enumerate(digests))
    assert index.resizes and all(d in index for d in digests)
    assert not index.insert(digests[0], 3, (9, 700))
    assert index.delete(digests[0], (9, 700)) == "elect"
    assert index.delete(digests[0], (5, 0)) == "gone" and digests[0] not in index
    assert index.delete(digests[0], (5, 0)) == "missing"


def _rows():
    rng = random.Random(8)
    lines = ["License: all rights reserved", " LICENSE: all rights reserved\t", "rare", "", "x", "é", "É"]
    rows = [(i, "\n".join(rng.choice([*lines, f"own {rng.randrange(40)}"]) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(["a b", "ab", "a\nb ", "", None, " \n\t", "A B", "a" * 300_000])]
    rows += [(900 + i, "the very same text") for i in range(90)] + [rows[3], (None, "the very  same text"), (None, None)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, count int, `key` string")


def _exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in (t or "") if c not in BLANK), []).append((i, t or ""))
    out = []
    for body, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), 1 << 70 if r[0] is None else r[0]))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=repr)


def test_exact_dedup_equals_brute_force(spark):
    rows = _rows()
    assert sorted((tuple(r) for r in X.exact_dedup(_frame(spark, rows)).collect()), key=repr) == _exact(rows)
    assert X.exact_dedup(_frame(spark, [])).collect() == []


def test_exact_index_updates(spark):
    rows = [(i, t) for i, t in _rows() if i is not None]
    gone, stay = rows[::3], [r for k, r in enumerate(rows) if k % 3]
    index = X.updated(X.index_of(_frame(spark, stay)), inserted=_frame(spark, gone))
    assert {tuple(r) for r in index.collect()} == {tuple(r) for r in X.index_of(_frame(spark, rows)).collect()}
    back = X.updated(index, deleted=_frame(spark, gone), remaining=_frame(spark, stay))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in X.index_of(_frame(spark, stay)).collect()}


def _key(line):
    return line.strip(BLANK).translate(LOWER)


def _lines(rows, least, chars=1):
    refs = Counter(k for _, t in rows for k in {_key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(_key(x)) < chars or refs[_key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    rows = _rows()
    for chars in (1, 2):
        got = D.line_dedup(_frame(spark, rows), min_docs=10, min_chars=chars).select("doc_id", "__n_lines", "__n_dropped", "__kept").collect()
        assert sorted((tuple(r) for r in got), key=lambda r: repr(r)) == _lines([r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None], 10, chars) or _same_but_null(got, rows, chars)
    assert D.line_dedup(_frame(spark, [])).collect() == []


def _same_but_null(got, rows, chars):
    """Rows with equal (or null) ids lose what any of them loses, so compare those with an id of their own."""
    ids = Counter(i for i, _ in rows)
    own = lambda r: r[0] is not None and ids[r[0]] == 1
    return [r for r in sorted((tuple(r) for r in got), key=repr) if own(r)] == [r for r in _lines(rows, 10, chars) if own(r)]


def test_line_counts_are_reversible(spark):
    rows = [r for r in _rows() if r[0] is not None]
    more, base = rows[::2], rows[1::2]
    counts = D.insert_documents(D.reference_counts(_frame(spark, base)), _frame(spark, more))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in D.reference_counts(_frame(spark, rows)).collect()}
    back = D.delete_documents(counts, _frame(spark, more))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in D.reference_counts(_frame(spark, base)).collect()}
