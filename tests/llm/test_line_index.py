"""Line deduplication against brute force on every row, with kept filters, and through both ways of probing."""

import random
from collections import Counter

from terrella.llm import line_dedup as D
from terrella.llm.cuckoo import View

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows(seed=8, n=150):
    rng = random.Random(seed)
    lines = ["License: all rights reserved", " LICENSE: all rights reserved\t", "rare", "", "x", "é", "É"]
    rows = [(i, "\n".join(rng.choice([*lines, f"own {rng.randrange(40)}"]) for _ in range(rng.randint(1, 6)))) for i in range(n)]
    rows += [(900 + i, "the very same text") for i in range(90)] + [rows[3], rows[3], (3, "rare\nx\nnothing else"), (None, "the very same text\nx"), (None, None), (7, ""), (8, "a" * 300_000)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k", 1, "own", 2) for i, t in rows], "doc_id long, text string, gone int, `__key` string, tkey int, `__kept` string, `row` int")


def _key(line):
    return line.strip(BLANK).translate(LOWER)


def _brute(rows, least, chars, all_rows=None):
    refs = Counter(k for _, t in all_rows or rows for k in {_key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(_key(x)) < chars or refs[_key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def _got(df):
    assert df.columns == ["doc_id", "gone", "__key", "tkey", "row", "__n_lines", "__n_dropped", "__kept"]
    return sorted((tuple(r) for r in df.select("doc_id", "__n_lines", "__n_dropped", "__kept").collect()), key=repr)


def test_every_row_equals_brute_force(spark, monkeypatch):
    rows = _rows()
    for chars in (1, 2):
        assert _got(D.line_dedup(_frame(spark, rows), 10, chars)) == _brute(rows, 10, chars)
    monkeypatch.setattr(D, "SHARD_KEYS", 5)
    monkeypatch.setattr(D, "GROUP_ROWS", 40)
    for room in (D.BROADCAST_BYTES, 0):
        assert _got(D.line_dedup(_frame(spark, rows), 10, 1, broadcast_bytes=room)) == _brute(rows, 10, 1)
    assert D.line_dedup(_frame(spark, []), broadcast_bytes=0).collect() == D.line_dedup(_frame(spark, [])).collect() == []


def test_index_follows_insertions_and_deletions(spark, tmp_path, monkeypatch):
    base, more = _rows(8, 60), _rows(9, 160)
    monkeypatch.setattr(D, "SHARD_KEYS", 4)
    first = D.index_lines(_frame(spark, base), 10, 1)
    both = D.updated(first, inserted=_frame(spark, more))
    back = D.updated(both, deleted=_frame(spark, more))
    for index, rows in ((both, base + more), (back, base)):
        assert {tuple(r) for r in index.counts.collect()} == {tuple(r) for r in D.reference_counts(_frame(spark, rows)).collect()}
        views = {r["shard"]: View(bytes(r["data"])) for r in index.filters.collect()}
        hot = index.hot.toArrow()
        hi, lo = (hot.column(c).to_numpy() for c in ("hi", "lo"))
        for k, shard in enumerate((lo % index.shards).tolist()):
            assert views[shard].probe(hi[k : k + 1].view("uint64")).all()
    assert _got(D.line_dedup(_frame(spark, base), index=both)) == _brute(base, 10, 1, base + more)
    assert _got(D.line_dedup(_frame(spark, base), index=back)) == _brute(base, 10, 1)
    live = sum(int.from_bytes(bytes(r["data"])[4:8], "little") for r in back.filters.collect())
    assert live == back.hot.count()  # what is no longer hot has left the filters
    both.save(f"file://{tmp_path}/index")
    assert _got(D.line_dedup(_frame(spark, more), index=D.LineIndex.load(spark, f"file://{tmp_path}/index"))) == _brute(more, 10, 1, base + more)
