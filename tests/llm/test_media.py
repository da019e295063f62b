"""Media columns: chunking, and an exact round trip of every text against direct computation."""

import hashlib
import random
import zlib

from terrella.llm.media import MAX_CHUNK, chunks, features, media_features, media_of, payload_of


def _payload(text):
    b = (text or "").encode()
    return b + b"\xff" * (576 - len(b) % 576 if not b or len(b) % 576 else 0)


def test_chunks_cover_and_follow_content():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    cut = chunks(data)
    assert cut[0][0] == 0 and cut[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    assert max(b - a for a, b in cut) <= MAX_CHUNK
    moved = chunks(b"some other start" + data)
    have = {data[a:b] for a, b in cut}
    other = b"some other start" + data
    assert sum(other[a:b] in have for a, b in moved) > 0.8 * len(moved)
    assert chunks(b"") == []


def test_round_trip(spark):
    rng = random.Random(1)
    passage = " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(8000))
    texts = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, passage, passage, "new start " + passage, passage + " end", "z" * 100_000, "😀\n" * 5000]
    texts += ["copy of one text"] * 60
    rows = [(i if i != 3 else None, t, 9) for i, t in enumerate(texts)] + [(1, "", 9)]
    out = media_features(spark.createDataFrame(rows, "doc_id long, text string, media int")).collect()
    want = sorted(repr((i, len((t or "").encode()), len(p := _payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m := media_of((t or "").encode())), hashlib.sha256(m).hexdigest(), features(p))) for i, t, _ in rows)
    assert sorted(repr(tuple(r)) for r in out) == want
    assert payload_of(media_of(b"abc")) == _payload("abc")


def test_empty_table(spark):
    assert media_features(spark.createDataFrame([], "doc_id long, text string")).collect() == []
