"""Media columns stored as content-defined chunks.

A payload of 8-bit samples becomes a media object (a binary PGM image, 576 samples a row).  A rolling gear hash over the
object's bytes cuts it into chunks at places that depend on the content alone, so objects that share a passage share
chunks.  A manifest lists an object's chunk digests in order.  Spark groups the digests of all places and joins those that
have more than one place back to the manifests: the first place of each gives the bytes.  The store has each chunk once.
A chunk with several places is a row of its own under its digest; an object's other chunks lie together in one pack, as
chunks that are compressed together take much less space than one by one.  Both are compressed with a dictionary trained
on a bounded sample of the texts and kept with the store.  Reading joins the shared chunks to the objects that list them,
puts each object's chunks in order, checks the SHA-256 of the result against the object's key (the first half of its
SHA-256), and computes features from the samples that were read back.  An object that shares no chunk is read from its pack
alone, so only packs that share some are moved.

Objects that are equal are stored and read once; the rows that hold them are joined to what was read.  A digest or an
object that many rows share is joined with salts.  A task holds one object at a time.

Defined results: a null text counts as empty; an empty text has one row of padding; rows that repeat an id each get a
result; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.llm.common import hot_keys, salted, scratch, tidy, tune, written

UNIT = 576
PAD = 255
MIN_CHUNK, MAX_CHUNK = 256, 8192
#: A cut is expected each 2**9 bytes beyond the least size.
CUT_BITS = 9
LEVEL = 15
#: Texts that the compressor's dictionary is trained on, the longest of them, and its size in bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1500, 32_768, 112_640
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, np.uint32)
_CUT = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))


def media_of(text: bytes) -> bytes:
    """The media object of a text: header and samples."""
    missing = UNIT - len(text) % UNIT if not text or len(text) % UNIT else 0
    return b"P5\n%d %d\n255\n" % (UNIT, (len(text) + missing) // UNIT) + text + bytes([PAD]) * missing


def payload_of(media: bytes) -> bytes:
    """The samples of a media object."""
    head = media.split(b"\n", 3)
    width, height = map(int, head[1].split())
    if head[0] != b"P5" or head[2] != b"255" or len(head[3]) != width * height:
        raise ValueError("not a media object of this store")
    return head[3]


def chunks(data: bytes) -> list[tuple[int, int]]:
    """Starts and ends of the content-defined chunks of ``data``."""
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):  # doubling: each step makes the window of the rolling hash twice as long
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, at = [], 0
    cuts = (np.flatnonzero((h & _CUT) == 0) + 1).tolist()
    for c in [*cuts, len(data)]:
        while c - at > MAX_CHUNK:
            out.append((at, at + MAX_CHUNK))
            at += MAX_CHUNK
        if c - at >= MIN_CHUNK or c == len(data):
            if c > at:
                out.append((at, c))
            at = c
    return out


def features(payload: bytes) -> str:
    """Exact statistics of the samples: sum, sum of squares, extremes, steps along a row and down, and a histogram."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    counts = np.bincount(x.ravel(), minlength=256)
    at = np.arange(256)
    total, squares = int(counts @ at), int(counts @ (at * at))
    seen = np.flatnonzero(counts)
    along = int(np.abs(np.diff(x.astype(np.int16), axis=1)).sum(dtype=np.int64))
    down = int(np.abs(np.diff(x.astype(np.int16), axis=0)).sum(dtype=np.int64))
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))
    return f"rows={len(x)};sum={total};squares={squares};min={seen[0]};max={seen[-1]};along={along};down={down};hist={bins}"


def _key(media: bytes) -> bytes:
    return hashlib.sha256(media).digest()[:16]


def _rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        sizes, keys = [], []
        for text in batch.column("text"):
            body = text.as_py() or b""
            sizes.append(len(body))
            keys.append(_key(media_of(body)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _dictionary(src: DataFrame) -> bytes:
    """A dictionary from about SAMPLE texts of at most SAMPLE_BYTES, chosen by a hash of the id; empty where there are too few.

    It bears on the size of the store alone.
    """
    short = src.filter(F.length("text") <= SAMPLE_BYTES)
    total = short.count()
    near = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) < min(1.0, SAMPLE / max(1, total)) * 1_000_003
    texts = sorted(bytes(r["text"]) for r in short.filter(near).limit(2 * SAMPLE).collect())  # at most 2 * SAMPLE * SAMPLE_BYTES
    pieces = [m[a:b] for m in map(media_of, texts) for a, b in chunks(m)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes() if len(pieces) >= 200 else b""
    except zstandard.ZstdError:  # the sample is too small or too uniform for one
        return b""


class _Codec:
    def __init__(self, dictionary: bytes):
        own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self._pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_dict_id=False, **own)
        self._unpack = zstandard.ZstdDecompressor(**own)

    def pack(self, data: bytes) -> bytes:
        return self._pack.compress(data) if data else b""

    def unpack(self, data: bytes) -> bytes:
        return self._unpack.decompress(data) if data else b""


def _new_objects(batch: pa.RecordBatch, seen: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Key and bytes of the objects of a batch that the task sees for the first time."""
    for text in batch.column("text"):
        media = media_of(text.as_py() or b"")
        key = _key(media)
        if key not in seen:
            seen.add(key)
            yield key, media


def _placer(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of chunks: object, number, digest and size."""
    seen: set[bytes] = set()
    for batch in stream:
        cols: list[list] = [[], [], [], []]
        for key, media in _new_objects(batch, seen):
            for seq, (a, b) in enumerate(chunks(media)):
                for col, x in zip(cols, (key, seq, hashlib.blake2b(media[a:b], digest_size=16).digest(), b - a), strict=True):
                    col.append(x)
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["media", "seq", "digest", "size"])


def _packer(dictionary: bytes):
    """Whole objects, compressed."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(dictionary)
        seen: set[bytes] = set()
        for batch in stream:
            for at in range(0, batch.num_rows, 256):
                rows = [(key, codec.pack(media)) for key, media in _new_objects(batch.slice(at, 256), seen)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["media", "packed"])

    return run


_FOREIGN = pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary())]))
_STORED = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("packed", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n_foreign", pa.int32()), ("foreign", _FOREIGN)])
STORED = "kind string, key binary, packed binary, sizes array<int>, n_foreign int, foreign array<struct<seq:int,digest:binary>>"


def _splitter(dictionary: bytes):
    """Rows of the store from whole objects and the list of their chunks that have several places."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(dictionary)
        for batch in stream:
            rows = []
            for key, packed, shared in zip(batch.column("media").to_pylist(), batch.column("packed").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                if not shared:
                    rows.append(("pack", key, packed, [], 0, []))
                    continue
                media = codec.unpack(packed)
                cut = chunks(media)
                away = {x["seq"] for x in shared}
                own = [media[a:b] for seq, (a, b) in enumerate(cut) if seq not in away]
                listed = sorted(({"seq": x["seq"], "digest": x["digest"]} for x in shared), key=lambda x: x["seq"])
                rows.append(("pack", key, codec.pack(b"".join(own)), [len(c) for c in own], len(listed), listed))
                rows.extend(("chunk", x["digest"], codec.pack(media[slice(*cut[x["seq"]])]), [], 0, []) for x in shared if x["first"])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_STORED.types)], schema=_STORED)

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write under ``path``: ``manifests`` (media, seq, digest), ``chunks`` (digest, size, refs), ``store`` (packs and shared
    chunks) and ``dictionary``."""
    spark = docs.sparkSession
    tune(spark)
    src = _source(docs, id_col, text_col)
    dictionary = _dictionary(src)
    spark.createDataFrame([(dictionary,)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    with tidy(spark):
        places = src.mapInArrow(_placer, "media binary, seq int, digest binary, size int")
        places.groupBy("media", "seq").agg(F.min("digest").alias("digest"), F.min("size").alias("size")).write.option("compression", "zstd").parquet(f"{path}/manifests")
        manifests = spark.read.parquet(f"{path}/manifests")
        manifests.groupBy("digest").agg(F.min("size").alias("size"), F.count("*").alias("refs")).write.option("compression", "zstd").parquet(f"{path}/chunks")
        several = spark.read.parquet(f"{path}/chunks").filter("refs > 1").select("digest", "refs")
        total = several.agg(F.sum("refs")).first()[0] or 0
        hot = hot_keys(several, ["digest"], total, "refs")
        met = written(salted(manifests, several.select("digest"), ["digest"], hot, F.xxhash64("media", "seq")).select("media", "seq", "digest"), "shared")
        # The first place of each digest is the one that is stored.
        first = met.groupBy("digest").agg(F.min(F.struct("media", "seq")).alias("place")).select(F.col("place.media").alias("media"), F.col("place.seq").alias("seq"), F.lit(True).alias("first"))
        shared = met.join(first, ["media", "seq"], "left").groupBy("media").agg(F.collect_list(F.struct("seq", "digest", F.coalesce("first", F.lit(False)).alias("first"))).alias("shared"))
        packed = src.mapInArrow(_packer(dictionary), "media binary, packed binary").groupBy("media").agg(F.first("packed").alias("packed"))
        rows = packed.join(shared, "media", "left").select("media", "packed", "shared").mapInArrow(_splitter(dictionary), STORED)
        rows.write.option("compression", "uncompressed").partitionBy("kind").parquet(f"{path}/store")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """One row about a store: objects, objects of several chunks, places, chunks, bytes in all places and bytes saved."""
    by_object = spark.read.parquet(f"{path}/manifests").groupBy("media").agg(F.count("*").alias("n"))
    objects = by_object.agg(F.count("*").alias("objects"), F.count_if(F.col("n") > 1).alias("of_several"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"))
    pieces = spark.read.parquet(f"{path}/chunks").agg(F.count("*").alias("chunks"), F.count_if(F.col("refs") > 1).alias("shared_chunks"), F.coalesce(F.sum(F.col("size") * F.col("refs")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("size") * (F.col("refs") - 1)), F.lit(0)).alias("saved_bytes"))
    row = objects.first().asDict() | pieces.first().asDict()
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


_READ = pa.schema([("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
READ = "media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _assembler(dictionary: bytes, shared: bool):
    """Objects from their packs and, if they list any, their shared chunks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _Codec(dictionary)
        for batch in stream:
            done = []
            for x in range(batch.num_rows):
                key, own = batch.column("key")[x].as_py(), codec.unpack(batch.column("packed")[x].as_py())
                if shared:
                    listed = {f["seq"]: f["packed"] for f in batch.column("chunks")[x].as_py()}
                    parts, at, sizes = [], 0, iter(batch.column("sizes")[x].as_py())
                    for seq in range(len(listed) + len(batch.column("sizes")[x])):
                        if seq in listed:
                            parts.append(codec.unpack(listed[seq]))
                        else:
                            size = next(sizes)
                            parts.append(own[at : at + size])
                            at += size
                    own = b"".join(parts)
                digest = hashlib.sha256(own)
                if digest.digest()[:16] != key:
                    raise ValueError(f"the chunks of object {key.hex()} do not give it back")
                payload = payload_of(own)
                done.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(own), digest.hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(_READ.types)], schema=_READ)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """What is read back of each object of a store: sizes, digests and features; written beside the store."""
    tune(spark)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    rows = spark.read.schema(STORED).parquet(f"{path}/store")
    packs = rows.filter("kind = 'pack'")
    whole = packs.filter("n_foreign = 0").select("key", "packed").mapInArrow(_assembler(dictionary, False), READ)
    mixed = packs.filter("n_foreign > 0").select("key", "packed", "sizes", "foreign")
    several = spark.read.parquet(f"{path}/chunks").filter("refs > 1")
    hot = hot_keys(several, ["digest"], several.agg(F.sum("refs")).first()[0] or 0, "refs")
    places = mixed.select("key", F.explode("foreign").alias("f")).select("key", F.col("f.seq").alias("seq"), F.col("f.digest").alias("digest"))
    pieces = rows.filter("kind = 'chunk'").select(F.col("key").alias("digest"), "packed")
    served = salted(places, pieces, ["digest"], hot, F.xxhash64("key", "seq"))
    lists = served.groupBy("key").agg(F.collect_list(F.struct("seq", "packed")).alias("chunks"))
    joined = mixed.select("key", "packed", "sizes").join(lists, "key", "left").select("key", "packed", "sizes", "chunks")
    return written(whole.unionByName(joined.mapInArrow(_assembler(dictionary, True), READ)), "objects")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read it back: doc_id, n_bytes, payload and media sizes and digests, features."""
    spark = docs.sparkSession
    path = scratch(spark, "media")
    store(docs, path, id_col, text_col)
    objects = read(spark, path)
    rows = _source(docs, id_col, text_col).mapInArrow(_rows, "doc_id bigint, n_bytes bigint, media binary")
    held = written(rows, "rows")
    counts = held.groupBy("media").count()
    out = salted(held, objects, ["media"], hot_keys(counts, ["media"], held.count()), F.xxhash64("doc_id"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
