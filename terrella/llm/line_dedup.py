"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A text is split at ``\\n``; a null or empty text is one empty line.  The key of a line is the line without blanks
(``[\\x20\\x09-\\x0D]``) at its ends and with A-Z lower-cased.  The reference-count table has one row per key (a 128-bit
digest) with the number of rows whose text holds it.  Keys with at least ``min_chars`` code points and ``min_docs``
references are hot.  The filter table has one cuckoo filter a shard, of the shard's hot keys.  Both tables are kept
(:class:`LineIndex`): inserting or deleting documents changes the counts, and puts the keys that became hot into their
shard's filter and takes out those that no longer are; a filter that overflows is made anew from the stored keys.  So
lines that fall below the threshold come back.

Every line probes the filter, and what hits it is confirmed against the exact table before the line goes.  While the
filters and the hot keys have at most BROADCAST_BYTES (they are counted first) they go to the tasks, which cut texts
where they are.  Beyond that lines go to their shard's filter in groups by (shard, salt), hits alone go on to the exact
table, and what a text loses is joined to the rows with that text, with salts for lines and texts that many rows share.

Each row is a document: rows that repeat an id or have none count once each, and lose their own lines.  A document all of
whose lines go keeps an empty text.  An empty table gives an empty result.  Columns of the input beside the text are
carried along, except that the added ones (``__n_lines``, ``__n_dropped``, ``__kept``) replace any of their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm.common import BLANKS, hot_keys, salted, tune, with_added, written
from terrella.llm.cuckoo import CuckooFilter, Full, View

#: Hot keys that a shard's filter is meant to hold, and probing lines of a group.
SHARD_KEYS = 100_000
GROUP_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 16-byte key digest for each line; None for a line whose key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS).lower()  # bytes.lower() changes A-Z only
        short = len(key) < min_chars or (min_chars > 1 and len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short else hashlib.blake2b(key, digest_size=16).digest())
    return out


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _mapper(min_chars: int, with_text_key: bool):
    """The distinct keys of each text."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            owners, digests = [], []
            for k, text in enumerate(batch.column("text")):
                own = set(keys_of(text.as_py() or b"", min_chars))
                own.discard(None)
                digests.extend(own)
                owners.extend([k] * len(own))
            hl = _pairs(digests) if digests else np.zeros((0, 2), np.int64)
            cols, names = [pa.array(np.ascontiguousarray(hl[:, k])) for k in (0, 1)], ["hi", "lo"]
            if with_text_key:
                cols, names = [batch.column("tkey").take(pa.array(owners, pa.int64())), *cols], ["tkey", *names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _source(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))


def reference_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """The exact table: hi, lo (the key's digest) and refs (rows that hold the key)."""
    tune(docs.sparkSession)
    keys = _source(docs, text_col).mapInArrow(_mapper(min_chars, False), "hi bigint, lo bigint")
    return keys.groupBy("hi", "lo").agg(F.count("*").alias("refs"))


def _changed(counts: DataFrame, docs: DataFrame, sign: int, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    more = reference_counts(docs, id_col, text_col, min_chars).select("hi", "lo", (sign * F.col("refs")).alias("refs"))
    return counts.unionByName(more).groupBy("hi", "lo").agg(F.sum("refs").alias("refs")).filter("refs > 0")


def insert_documents(counts: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    return _changed(counts, docs, 1, id_col, text_col, min_chars)


def delete_documents(counts: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Counts without the given documents, which must have been inserted before."""
    return _changed(counts, docs, -1, id_col, text_col, min_chars)


@dataclass
class LineIndex:
    """The exact table (hi, lo, refs) and the filters (shard, data) of its hot keys."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @property
    def hot(self) -> DataFrame:
        return self.counts.filter(F.col("refs") >= self.min_docs)

    def save(self, path: str) -> None:
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")
        self.counts.sparkSession.createDataFrame([(self.shards, self.min_docs, self.min_chars)], "shards int, min_docs int, min_chars int").write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LineIndex:
        about = spark.read.parquet(f"{path}/about").first()
        return LineIndex(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/filters"), *about)


def _shard(shards: int):
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int").alias("shard")  # the filters use the bits of hi


def _unsigned(table: pa.Table) -> list[int]:
    return table.column("hi").to_numpy().view(np.uint64).tolist()


def _fill(table: pa.Table) -> pa.Table:
    data = CuckooFilter.of(_unsigned(table)).to_bytes()
    return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "data": pa.array([data], pa.binary())})


def _update(changes: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter after its changes; ``full`` when it has to be made anew."""
    source = filters if filters.num_rows else changes
    shard = CuckooFilter.from_bytes(filters.column("data")[0].as_py()) if filters.num_rows else CuckooFilter(64)
    full = False
    if changes.num_rows:
        up = changes.column("up").to_numpy(zero_copy_only=False)
        keys = np.array(_unsigned(changes), np.uint64)
        for key in keys[~up].tolist():
            shard.delete(key)
        try:
            for key in keys[up].tolist():
                shard.insert(key)
        except Full:
            full = True
    return pa.table({"shard": source.column("shard")[:1].cast(pa.int32()), "data": pa.array([shard.to_bytes()], pa.binary()), "full": pa.array([full])})


def _indexed(counts: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
    hot = counts.filter(F.col("refs") >= min_docs)
    shards = max(1, -(-hot.count() // SHARD_KEYS))
    filters = hot.select(_shard(shards), "hi").groupBy("shard").applyInArrow(_fill, "shard int, data binary")
    return LineIndex(counts, written(filters, "filters"), shards, min_docs, min_chars)


def index_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> LineIndex:
    """The index of all lines of ``docs``."""
    return _indexed(written(reference_counts(docs, text_col=text_col, min_chars=min_chars), "references"), min_docs, min_chars)


def updated(index: LineIndex, inserted: DataFrame | None = None, deleted: DataFrame | None = None, text_col: str = "text") -> LineIndex:
    """The index after insertions and deletions; deleted documents must have been inserted before."""
    rows = index.counts.select("hi", "lo", F.col("refs").alias("old"), F.lit(0).cast("long").alias("change"))
    for sign, docs in ((1, inserted), (-1, deleted)):
        if docs is not None:
            rows = rows.unionByName(reference_counts(docs, text_col=text_col, min_chars=index.min_chars).select("hi", "lo", F.lit(0).cast("long").alias("old"), (sign * F.col("refs")).alias("change")))
    merged = written(rows.groupBy("hi", "lo").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("change")).alias("refs")), "merged")
    counts = merged.filter("refs > 0").select("hi", "lo", "refs")
    was, now = F.col("old") >= index.min_docs, F.col("refs") >= index.min_docs
    if merged.filter(now).count() > 4 * SHARD_KEYS * index.shards:
        return _indexed(counts, index.min_docs, index.min_chars)
    changes = merged.filter(was != now).select(_shard(index.shards), "hi", now.alias("up"))
    made = written(changes.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_update, "shard int, data binary, full boolean"), "filters")
    if made.filter("full").isEmpty():
        return LineIndex(counts, made.select("shard", "data"), index.shards, index.min_docs, index.min_chars)
    keys = merged.filter(now).select(_shard(index.shards), "hi").join(made.filter("full").select("shard"), "shard", "left_semi")
    anew = keys.groupBy("shard").applyInArrow(_fill, "shard int, data binary")
    return LineIndex(counts, written(made.filter("NOT full").select("shard", "data").unionByName(anew), "filters"), index.shards, index.min_docs, index.min_chars)


class _Tables:
    """Filters and hot keys in a task."""

    def __init__(self, filters: list[tuple[int, bytes]], hi: np.ndarray, lo: np.ndarray, shards: int):
        self.views = {shard: View(data) for shard, data in filters}
        self.hi, self.lo, self.shards = hi, lo, shards

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), bool)
        shard = lo % self.shards
        for k in np.unique(shard).tolist():
            if k in self.views:
                own = np.flatnonzero(shard == k)
                hits = own[self.views[k].probe(hi[own].view(np.uint64))]
                at = np.searchsorted(self.hi, hi[hits])
                while len(hits):  # rows with an equal hi follow one another
                    at = np.minimum(at, len(self.hi) - 1)
                    same = self.hi[at] == hi[hits]
                    out[hits[same & (self.lo[at] == lo[hits])]] = True
                    go = same & ~out[hits] & (at + 1 < len(self.hi))
                    hits, at = hits[go], at[go] + 1
        return out


def _cut(body: bytes, gone: list[bool], keep_text: bool) -> tuple[int, int, str]:
    lines = body.split(b"\n")
    if any(gone):
        body = b"\n".join(line for line, g in zip(lines, gone, strict=True) if not g)
    return len(lines), sum(gone), body.decode() if keep_text else hashlib.sha256(body).hexdigest()


_ADDED = {"__n_lines": "bigint", "__n_dropped": "bigint", "__kept": "string"}


def _results(batch: pa.RecordBatch, carried: int, rows: list[tuple]) -> pa.RecordBatch:
    extra = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns[:carried], *extra], names=[*batch.schema.names[:carried], *_ADDED])


def _cutter(tables, min_chars: int, keep_text: bool):
    """Texts without their hot lines; the text is the last column of a batch."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tables.value
        for batch in stream:
            bodies = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            keys = [keys_of(body, min_chars) for body in bodies]
            real = [k for own in keys for k in own if k is not None]
            hl = _pairs(real) if real else np.zeros((0, 2), np.int64)
            hits = iter(held.holds(np.ascontiguousarray(hl[:, 0]), np.ascontiguousarray(hl[:, 1])).tolist())
            rows = [_cut(body, [k is not None and next(hits) for k in own], keep_text) for body, own in zip(bodies, keys, strict=True)]
            yield _results(batch, batch.num_columns - 1, rows)

    return run


def _probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
    """Lines of one group that their shard's filter holds."""
    hi = lines.column("hi").to_numpy()
    hits = np.flatnonzero(View(filters.column("data")[0].as_py()).probe(hi.view(np.uint64))) if filters.num_rows and len(hi) else np.zeros(0, np.int64)
    return lines.select(["tkey", "hi", "lo"]).take(pa.array(hits))


def _lost_keys(docs: DataFrame, index: LineIndex, text_col: str) -> DataFrame:
    """tkey (a text's MD5) and the keys that the text loses."""
    shard = _shard(index.shards)
    salts = index.counts.groupBy(shard).agg(F.greatest(F.lit(1), F.ceil(F.sum("refs") / GROUP_ROWS)).cast("int").alias("salts"))
    if index.shards <= 100_000:  # bounds the table, so it may be broadcast; beyond, a shuffled join
        salts = F.broadcast(salts)
    texts = docs.select(F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))).alias("tkey"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    lines = texts.mapInArrow(_mapper(index.min_chars, True), "tkey binary, hi bigint, lo bigint").withColumn("shard", shard)
    left = lines.join(salts, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("tkey", "lo"), F.coalesce("salts", F.lit(1)))).drop("salts")
    right = index.filters.join(salts, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    hits = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(_probe, "tkey binary, hi bigint, lo bigint")
    total = index.hot.agg(F.sum("refs")).first()[0] or 0
    exact = salted(hits, index.hot.select("hi", "lo"), ["hi", "lo"], hot_keys(index.hot, ["hi", "lo"], total, "refs"), F.xxhash64("tkey"))
    return exact.groupBy("tkey").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))


def _list_cutter(min_chars: int, keep_text: bool):
    """Texts without listed lines; text and list are the last two columns of a batch."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for text, gone in zip(batch.column("text"), batch.column("gone").to_pylist(), strict=True):
                body = text.as_py()
                out = {np.array([g["hi"], g["lo"]], "<i8").tobytes() for g in gone or ()}
                rows.append(_cut(body, [k is not None and k in out for k in keys_of(body, min_chars)], keep_text))
            yield _results(batch, 1, rows)

    return run


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, index: LineIndex | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The columns of ``docs`` without the text, and ``__n_lines``, ``__n_dropped``, ``__kept`` (the kept text, or its SHA-256).

    ``index`` is that of all documents which count; without one, these are ``docs``.
    """
    spark = docs.sparkSession
    tune(spark)
    index = index or index_lines(docs, min_docs, min_chars, text_col)
    kept = [docs[c] for c in docs.columns if c not in (text_col, *_ADDED)]
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text")
    size = (index.filters.agg(F.sum(F.length("data"))).first()[0] or 0) + 16 * index.hot.count()
    if size <= broadcast_bytes:
        hot = index.hot.select("hi", "lo").toArrow()  # at most broadcast_bytes
        hi, lo = (hot.column(c).to_numpy() for c in ("hi", "lo"))
        order = np.lexsort((lo, hi))
        filters = [(r["shard"], bytes(r["data"])) for r in index.filters.collect()]
        tables = spark.sparkContext.broadcast(_Tables(filters, hi[order], lo[order], index.shards))
        return docs.select(*kept, text).mapInArrow(_cutter(tables, index.min_chars, keep_text), with_added(docs.select(*kept), **_ADDED))
    rows = docs.select(F.struct(*kept, F.lit(0).alias("__none")).alias("row"), text, F.unhex(F.md5(text)).alias("tkey"))
    counts = rows.groupBy("tkey").count()
    met = salted(rows, written(_lost_keys(docs, index, text_col), "lost"), ["tkey"], hot_keys(counts, ["tkey"], docs.count()), F.monotonically_increasing_id(), "left").select("row", "text", "gone")
    out = met.mapInArrow(_list_cutter(index.min_chars, keep_text), with_added(met.select("row"), **_ADDED))
    return out.select("row.*", *_ADDED).drop("__none")
