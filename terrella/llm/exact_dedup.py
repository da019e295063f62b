"""Exact deduplication through a sharded cuckoo-filter index.

Texts are equal when identical after deleting every blank (``[\\x20\\x09-\\x0D]``); a null text counts as empty.  Each
map task combines its own rows by SHA-256 of the normalised text, so a text that a third of all rows share reaches its
shard as one row a task.  Each shard keeps a cuckoo filter over the live digests and, in buckets, what it knows of each
digest: a filter miss is a new text, a filter hit is verified against the bucket's full 256-bit digest and normalised
length before the rows merge.  When the filter overflows, a larger one is filled from the stored keys.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest id (a null
id loses to any other).  Empty texts are equal to one another.  Rows that repeat an id are rows of their own: each is
counted, and each gets a result row.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import BLANKS, hot_keys, salted, tune, written
from terrella.llm.cuckoo import CuckooFilter, Full

#: Rows that one shard of the index is meant to hold.
SHARD_ROWS = 100_000
FLUSH_KEYS = 100_000
NO_ID = 1 << 63


def _better(a: tuple, b: tuple) -> tuple:
    """The better of two (code points, id) pairs."""
    ka = (-a[0], NO_ID if a[1] is None else a[1])
    kb = (-b[0], NO_ID if b[1] is None else b[1])
    return a if ka <= kb else b


class ExactIndex:
    """A live index of digests: cuckoo filter in front, bucketed records behind."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[bytes, dict[bytes, list]] = defaultdict(dict)
        self.resizes = 0

    @staticmethod
    def _key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def _record(self, digest: bytes, length: int | None) -> list | None:
        """The verified record of a digest, or None: the filter first, then the bucket's content."""
        if self._key(digest) not in self.filter:
            return None
        found = self.buckets.get(digest[8:10], {}).get(digest)
        if found is not None and length is not None and found[2] != length:
            raise ValueError("two texts of different length have one SHA-256 digest")
        return found

    def insert(self, digest: bytes, length: int, best: tuple, count: int = 1) -> bool:
        """Add rows of one text; True if the text is new."""
        found = self._record(digest, length)
        if found is not None:
            found[0] += count
            found[1] = _better(found[1], best)
            return False
        self.buckets[digest[8:10]][digest] = [count, best, length]
        try:
            self.filter.insert(self._key(digest))
        except Full:
            self.resizes += 1
            self.filter = CuckooFilter.of((self._key(d) for b in self.buckets.values() for d in b), self.filter.buckets * 8)
        return True

    def delete(self, digest: bytes, best: tuple, count: int = 1) -> str:
        """Take rows of one text out: ``missing``, ``live``, ``elect`` (the row that stayed is gone) or ``gone``."""
        found = self._record(digest, None)
        if found is None:
            return "missing"
        found[0] -= count
        if found[0] > 0:
            return "elect" if found[1] == best else "live"
        del self.buckets[digest[8:10]][digest]
        self.filter.delete(self._key(digest))
        return "gone"

    def __contains__(self, digest: bytes) -> bool:
        return self._record(digest, None) is not None

    def rows(self) -> Iterator[tuple]:
        for bucket in self.buckets.values():
            for digest, (count, best, length) in bucket.items():
                yield digest, count, best, length


def _normalised(batch: pa.RecordBatch) -> Iterator[tuple]:
    ids, chars = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
    for i, n, text in zip(ids, chars, batch.column("text"), strict=True):
        body = (text.as_py() or b"").translate(None, BLANKS)
        yield i, n, hashlib.sha256(body).digest(), len(body)


def _combined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, list] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([r[k] for r in seen.values()], pa.int64()) for k in range(2)), *(pa.array([r[2][k] for r in seen.values()], pa.int64()) for k in range(2))], names=["digest", "count", "length", "best_n", "best_id"])
        seen.clear()
        return out

    for batch in stream:
        for i, n, digest, length in _normalised(batch):
            r = seen.get(digest)
            if r is None:
                seen[digest] = [1, length, (n, i)]
            else:
                r[0] += 1
                r[2] = _better(r[2], (n, i))
        if len(seen) >= FLUSH_KEYS:
            yield flush()
    yield flush()


def _digests(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = list(_normalised(batch))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "digest"])


def _shard(table: pa.Table) -> pa.Table:
    index = ExactIndex(max(64, table.num_rows // 2))
    for digest, count, length, n, i in zip(*(table.column(c).to_pylist() for c in ("digest", "count", "length", "best_n", "best_id")), strict=True):
        index.insert(digest, length, (n, i), count)
    rows = list(index.rows())
    return pa.table({"digest": pa.array([r[0] for r in rows], pa.binary()), "count": pa.array([r[1] for r in rows], pa.int64()), "best_n": pa.array([r[2][0] for r in rows], pa.int64()), "best_id": pa.array([r[2][1] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64())})


GROUPS = "digest binary, count bigint, best_n bigint, best_id bigint, length bigint"


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), text.cast("binary").alias("text"))


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records of a sharded index over all rows: digest, count, best_n, best_id, length."""
    tune(docs.sparkSession)
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    pieces = source(docs, id_col, text_col).mapInArrow(_combined, "digest binary, count bigint, length bigint, best_n bigint, best_id bigint")
    return pieces.groupBy(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")).applyInArrow(_shard, GROUPS)


def updated(index: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, remaining: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An index after insertions and deletions of documents.

    Deleting the row that stayed elects another of its group: for that, ``remaining`` has the documents that are left.
    """
    shards = max(1, -(-index.count() // SHARD_ROWS))
    kinds = [index.select(*index.columns, F.lit(0).alias("op"))]
    for op, docs in ((1, inserted), (2, deleted)):
        if docs is not None:
            kinds.append(source(docs, id_col, text_col).mapInArrow(_combined, "digest binary, count bigint, length bigint, best_n bigint, best_id bigint").select(*index.columns, F.lit(op).alias("op")))
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)

    def change(table: pa.Table) -> pa.Table:
        shard = ExactIndex(max(64, table.num_rows))
        for op, digest, count, n, i, length in sorted(zip(*(table.column(c).to_pylist() for c in ("op", "digest", "count", "best_n", "best_id", "length")), strict=True), key=lambda r: r[0]):
            if op < 2:
                shard.insert(digest, length, (n, i), count)
            elif shard.delete(digest, (n, i), count) == "elect":
                shard.buckets[digest[8:10]][digest][1] = (-1, None)
        rows = list(shard.rows())
        return pa.table({"digest": pa.array([r[0] for r in rows], pa.binary()), "count": pa.array([r[1] for r in rows], pa.int64()), "best_n": pa.array([r[2][0] for r in rows], pa.int64()), "best_id": pa.array([r[2][1] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64())})

    out = rows.groupBy(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")).applyInArrow(change, GROUPS)
    if remaining is None:
        return out
    elected = index_of(remaining, id_col, text_col).select("digest", F.col("best_n").alias("__n"), F.col("best_id").alias("__id"))
    lost = F.col("best_n") < 0
    return out.join(elected, "digest", "left").select("digest", "count", F.when(lost, F.col("__n")).otherwise(F.col("best_n")).alias("best_n"), F.when(lost, F.col("__id")).otherwise(F.col("best_id")).alias("best_id"), "length")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    groups = written(index_of(docs, id_col, text_col), "groups")
    total = groups.agg(F.sum("count")).first()[0] or 0
    ids = source(docs, id_col, text_col).mapInArrow(_digests, "doc_id bigint, digest binary")
    if total == 0:
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string")
    hot = hot_keys(groups, ["digest"], total)
    found = salted(ids, groups.select("digest", "count", "best_id"), ["digest"], hot, F.xxhash64("doc_id"))
    return found.select("doc_id", F.col("best_id").alias("keep_id"), F.col("count").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
