"""Short documents that share a passage share chunks of it."""

import random

from terrella.llm.media import chunks, media_of, store


def test_short_documents_with_one_passage_share_a_chunk(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = 0
    for _ in range(20):
        passage = make(400)
        a, b = (media_of(f"{make(40)} {passage} {make(40)}".encode()) for _ in range(2))
        assert max(len(a), len(b)) < 4096
        shared += bool({a[x:y] for x, y in chunks(a)} & {b[x:y] for x, y in chunks(b)})
    assert shared >= 15
    passage = make(400)
    rows = [(i, f"{make(40)} {passage} {make(40)}") for i in range(6)]
    store(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}")
    kept = spark.read.parquet(f"file://{tmp_path}/chunks").collect()
    places = spark.read.parquet(f"file://{tmp_path}/manifests").count()
    assert max(r["refs"] for r in kept) == 6 and len(kept) < places == sum(r["refs"] for r in kept)
