"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

A text's set is the distinct hashes of its word shingles.  Each distinct set is a node with a number of its own, so texts
with one set are never paired, and rows that share an id but not a text stay apart.  One-permutation hashing splits the
hash range into BINS and keeps the least hash of each; an empty bin is filled from a full one by optimal densification.
ROWS bins make a band, and nodes that agree in a band share a bucket.  At similarity 0.8 two nodes miss each other in all
42 bands with a probability of 3 in a million.  Sets of at most SMALL shingles fill few bins, so they also share a bucket
for each hash of their prefix (see below, in the order of hashes), which misses no link between two of them.

A bucket of n nodes gives n - 1 candidate edges, a star around its centre (the node that shares most buckets).  Edges
whose sizes or sketches rule a link out go, and the others are confirmed on the full sets.  Two members may be linked
though neither is linked with the centre.  Nodes of buckets that still lie in several components without their centre
are open, and meet in buckets of another kind: with any one order of all shingles, two sets of similarity t or more share
a shingle among the first n - ceil(t * n) + 1 of each.  The order is rarest first, by counts over the open nodes in
SLOTS hashed slots, so a passage that many texts share is at the end of it and makes no bucket, however many texts hold
it.  These buckets give stars too, of more and more centres until each bucket's rest lies in one component: so no pair is
passed over unless it is already connected.

Members of a centre are streamed past it; centres and buckets with many members are spread over salts.  Components are
found by label propagation with pointer jumping, over tables that are checkpointed in the shared folder.

Defined results: a null or empty text, or one without words, has an empty set, is linked with nothing and stays; with
fewer words than a shingle the whole sequence is the one shingle; rows that repeat an id and text share a component; rows
that repeat an id with another text are nodes of their own; a null id takes part but is nobody's component unless all of
the component are null, which gives null; kept is then true for them; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrella.llm.common import hot_keys, salted, tune, written
from terrella.llm.vectors import mix, shingles

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
#: Sets of at most so many shingles have a bucket for each hash of their prefix too.
SMALL = 80
#: Slots of the counts that order shingles.
SLOTS = 1 << 20
#: Ids from here on stand for null ids.
NO_ID = 1 << 62

_probes: list[np.ndarray] = []


def _probe_table() -> np.ndarray:
    """For each bin, the bins to look at in turn when it is empty."""
    if not _probes:
        x = mix(np.arange(BINS * 4096, dtype=np.uint64) + np.uint64(0xABCDEF)) >> np.uint64(40)
        _probes.append((x % np.uint64(BINS)).astype(np.int64).reshape(BINS, 4096))
    return _probes[0]


def signature(sets: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted, distinct, non-empty set; empty bins by optimal densification."""
    bins = (sets >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = sets[first], True
    empty = np.flatnonzero(~full)
    source = out.copy()
    for width in (16, 256, 4096):
        if not len(empty):
            break
        hit = full[_probe_table()[empty, :width]]
        found = hit.any(1)
        done = empty[found]
        out[done] = source[_probe_table()[done, hit[found].argmax(1)]]
        empty = empty[~found]
    out[empty] = sets[0]
    return out


def bands(sets: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    s = signature(sets)[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return key.view(np.int64)


def _set_key(sets: np.ndarray) -> bytes:
    n = np.uint64(len(sets))
    a = np.bitwise_xor.reduce(mix(sets + np.uint64(0x1234567))) ^ n
    b = mix(sets ^ np.uint64(0xF0E1D2C3B4A59687)).sum(dtype=np.uint64) + n
    return np.array([a, b], np.uint64).tobytes()


def prefix_size(n: int, percent: int) -> int:
    """Sets of n shingles and of similarity ``percent`` or more share one of so many first shingles in any order."""
    return n + percent * n // -100 + 1


def _keys(sets: np.ndarray, percent: int) -> np.ndarray:
    out = bands(sets)
    if len(sets) <= SMALL:
        out = np.concatenate([out, mix(sets[: prefix_size(len(sets), percent)] ^ np.uint64(0x5EED5EED)).view(np.int64)])
    return out


def _signer(words: int, percent: int):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sizes, keys, rows = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py() or b"", words)
                sizes.append(len(s))
                keys.append(_set_key(s) if len(s) else None)
                rows.append(_keys(s, percent) if len(s) else np.zeros(0, np.int64))
            flat = np.concatenate([*rows, np.zeros(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], names=["id", "tkey", "n", "set", "bands"])

    return run


def _sketcher(words: int):
    """Adds the size of a text's set and one byte of each bin of its signature."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            sketches = [mix(signature(s)).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches, pa.binary())], names=["node", "text", "n", "sketch"])

    return run


def _slot(sets: np.ndarray) -> np.ndarray:
    return (mix(sets ^ np.uint64(0x517CC1B727220A95)) % np.uint64(SLOTS)).astype(np.int64)


def _slot_counter(words: int):
    """How many sets of a task hold a shingle of each slot."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in stream:
            for text in batch.column("text"):
                np.add.at(counts, _slot(shingles(text.as_py(), words)), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "count"])

    return run


def _prefixer(words: int, percent: int, counts):
    """The rarest shingles of each set as bucket keys; those that no other set can hold are left out."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for batch in stream:
            nodes, keys = [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                s = shingles(text.as_py(), words)
                often = held[_slot(s)]
                first = np.lexsort((s, often))[: prefix_size(len(s), percent)]
                first = first[often[first] > 1]
                keys.append(s[first].view(np.int64)), nodes.append(np.full(len(first), node, np.int64))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, none])) for x in (keys, nodes)], names=["key", "node"])

    return run


def _linker(words: int, percent: int):
    """Members that are similar enough to their centre; rows come sorted by centre and salt, the centre's own first."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in stream:
            out: list[tuple[int, int]] = []
            for c, v, text in zip(batch.column("c").to_pylist(), batch.column("v").to_pylist(), batch.column("text"), strict=True):
                s = shingles(text.as_py(), words)
                if v is None:
                    centre, own = c, s
                elif c == centre:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out.append((c, v))
                else:
                    raise ValueError("a member came before its centre")
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for the nodes of undirected links (a, b)."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct().checkpoint()
    degree = edges.groupBy("b").count()
    hot = hot_keys(degree, ["b"], edges.count()).checkpoint()  # hubs of stars
    labels = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")).checkpoint()
    while True:
        met = salted(edges, labels.select(F.col("node").alias("b"), "label"), ["b"], hot, F.xxhash64("a"))
        near = met.groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        after = lower.join(jump, lower["label"] == jump["at"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")).checkpoint()
        labels = after.select("node", "label")
        if after.filter("old <> label").isEmpty():
            return labels


def _identity(id_: Column, text: Column) -> tuple[Column, Column]:
    """id (a number of its own from NO_ID on for a null one, by the text) and tkey, the text's MD5."""
    text = F.coalesce(text, F.lit(""))
    known = F.coalesce(id_.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID >> 1)))
    return known.alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("tkey")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_identity(docs[id_col], docs[text_col]), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))


def _heads(active: DataFrame, centres: int) -> DataFrame:
    """The first ``centres`` nodes of each bucket: key, c, d (its degree).  One order of nodes holds for all buckets, so a
    pair has the same centre wherever it turns up.  Tasks combine or limit their own rows before the shuffle."""
    if centres == 1:
        top = F.max(F.struct("degree", (-F.col("node")).alias("least")))
        return active.groupBy("key").agg(top.alias("top")).select("key", (-F.col("top.least")).alias("c"), F.col("top.degree").alias("d"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "node"))
    return active.withColumn("rank", rank).filter(F.col("rank") <= centres).select("key", F.col("node").alias("c"), F.col("degree").alias("d"))


_BEHIND = "d > degree OR (d = degree AND c < node)"


def _buckets(rows: DataFrame, total: int) -> DataFrame:
    """key, node and degree (how many nodes it meets) of (key, node) rows whose key has two nodes at least."""
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "sizes")
    members = written(salted(rows, sizes, ["key"], hot_keys(sizes, ["key"], total, "members"), F.xxhash64("node")), "members")
    degree = members.groupBy("node").agg(F.sum(F.col("members") - 1).alias("degree"))
    return written(members.select("key", "node", "members").join(degree, "node"), "active")


class _Search:
    """Links among nodes, found star by star."""

    def __init__(self, texts: DataFrame, words: int, percent: int):
        self.texts, self.words, self.percent = texts, words, percent
        self.links = self.labels = self.tested = None
        self.pairs = 0

    def stars(self, active: DataFrame, centres: int) -> DataFrame:
        """Tests the stars of some centres a bucket; rows of the rest of buckets that lie in several components."""
        total = active.count()
        hot = hot_keys(active.groupBy("key").agg(F.first("members").alias("members")), ["key"], total, "members")
        heads = written(_heads(active, centres), "heads")
        pairs = salted(active.select("key", "node", "degree"), heads, ["key"], hot, F.xxhash64("node")).filter(_BEHIND).select("c", F.col("node").alias("v")).distinct()
        if self.labels is not None:  # what is connected already needs no test
            ours, theirs = self.labels.select(F.col("node").alias("c"), F.col("label").alias("x")), self.labels.select(F.col("node").alias("v"), F.col("label").alias("y"))
            pairs = pairs.join(ours, "c", "left").join(theirs, "v", "left").filter("x IS NULL OR y IS NULL OR x <> y").select("c", "v")
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["c", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        self.pairs += pairs.count()
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        more = written(_confirmed(written(_plausible(pairs, self.texts, self.percent), "edges"), self.texts, self.words, self.percent), "links")
        if not more.isEmpty():
            self.links = more if self.links is None else self.links.unionByName(more)
            self.labels = components(self.links)
        # A bucket's rest is behind the last of its centres.
        last = heads.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("d", (-F.col("c")).alias("m"))).alias("last")).filter(F.col("n") == centres)
        last = last.select("key", F.col("last.d").alias("d"), (-F.col("last.m")).alias("c"))
        rest = salted(active, last, ["key"], hot, F.xxhash64("node")).filter(_BEHIND).drop("d", "c")
        rest = rest.withColumn("comp", F.col("node")) if self.labels is None else rest.join(self.labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        rest = written(rest, "rest")
        open_keys = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        return written(salted(rest, open_keys, ["key"], hot, F.xxhash64("node")).select("key", "node", "degree", "members"), "open")

    def prefixes(self, open_rows: DataFrame) -> DataFrame:
        """Buckets of the open nodes by their rarest shingles."""
        spark = open_rows.sparkSession
        held = written(self.texts.join(open_rows.select("node").distinct(), "node", "left_semi").select("node", "text"), "held")
        counts = np.zeros(SLOTS, np.int64)
        found = held.select("text").mapInArrow(_slot_counter(self.words), "slot bigint, count bigint").groupBy("slot").agg(F.sum("count").alias("count")).toArrow()  # at most SLOTS rows
        counts[found.column("slot").to_numpy()] = found.column("count").to_numpy()
        shared = spark.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))
        rows = written(held.mapInArrow(_prefixer(self.words, self.percent, shared), "key bigint, node bigint"), "prefixes")
        return _buckets(rows, rows.count())


def classes(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", search: list | None = None) -> DataFrame:
    """One row per document: id (from NO_ID on for a null one), tkey (the text's MD5), n, and of its component the number
    and the first document's id and tkey (null for a text without words).  The search is appended to ``search``."""
    spark = docs.sparkSession
    tune(spark)
    src = _source(docs, id_col, text_col)
    signed = written(src.mapInArrow(_signer(words, percent), "id bigint, tkey binary, n bigint, set binary, bands array<bigint>"), "signed")
    # One node for each distinct set, numbered as it is written.
    sets = signed.filter("n > 0").groupBy("set").agg(F.min(F.struct("id", "tkey")).alias("first"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    active = _buckets(nodes.select(F.explode("bands").alias("key"), "node"), total)
    needed = nodes.join(active.select("node").distinct(), "node", "left_semi").select("node", F.col("first.id").alias("id"), F.col("first.tkey").alias("tkey"))
    held = src.join(needed, ["id", "tkey"]).dropDuplicates(["node"]).select("node", "text")
    texts = written(held.mapInArrow(_sketcher(words), "node bigint, text binary, n int, sketch binary"), "texts")

    found = _Search(texts, words, percent)
    if not active.isEmpty():
        active = found.stars(active, 1)
        if not active.isEmpty():
            active = found.prefixes(active)
        centres = 8
        while not active.isEmpty():
            active = found.stars(active, centres)
            centres *= 8
    if search is not None:
        search.append(found)

    placed = nodes.select("set", "node", "size", "first")
    if found.labels is None:
        placed = placed.select("set", "size", F.col("node").alias("component"), "first")
    else:
        placed = written(placed.join(found.labels, "node", "left").select("set", "size", F.coalesce("label", "node").alias("component"), "first"), "labelled")
        least = written(placed.groupBy("component").agg(F.min("first").alias("first"), F.count("*").alias("count")), "least")
        spread = hot_keys(least, ["component"], least.agg(F.sum("count")).first()[0] or 0)
        placed = salted(placed.drop("first"), least.drop("count"), ["component"], spread, F.xxhash64("set"))
    placed = written(placed, "placed")
    hot = hot_keys(placed, ["set"], placed.agg(F.sum("size")).first()[0] or 0, "size")
    return salted(signed.select("id", "tkey", "n", "set"), placed.select("set", "component", "first"), ["set"], hot, F.xxhash64("id"), "left").drop("set")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", search: list | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    found = classes(docs, words, percent, id_col, text_col, search)
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    out = found.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, real("first.id")).otherwise(real("id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` for one row of each component: that with the smallest id (a null id comes last), then text.

    Rows without words are linked with nothing and all stay; of rows that repeat the id and text that stay, one does.
    """
    found = classes(docs, words, percent, id_col, text_col)
    first = found.filter("n > 0 AND id = first.id AND tkey = first.tkey").select("id", "tkey").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *_identity(docs[id_col], docs[text_col]))
    worded = F.col(f"row.`{text_col}`").rlike("[^\\x20\\x09-\\x0D]")
    some = rows.filter(worded).join(first, ["id", "tkey"]).groupBy("id", "tkey").agg(F.first("row").alias("row"))
    return some.select("row.*").unionByName(rows.filter(~F.coalesce(worded, F.lit(False))).select("row.*"))


def _plausible(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs without those whose sketches agree in far fewer bins than a link's would.

    The share of equal bins estimates the similarity; for sets as large as the sketch its standard deviation at the
    threshold t is at most sqrt(t * (1 - t) / BINS), and pairs more than five of those below t go.  Pairs with a smaller
    set all stay, but for those whose sizes alone differ too much.
    """
    t = percent / 100
    least = t - 5 * (t * (1 - t) / BINS) ** 0.5

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in ("x", "y"))
            good = ((x == y).mean(1) >= least) | np.array(batch.column("small"), bool)
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("v")], names=["c", "v"]).filter(pa.array(good))

    counts = pairs.groupBy("c").count()
    hot = hot_keys(counts, ["c"], counts.agg(F.sum("count")).first()[0] or 0)
    ours = texts.select(F.col("node").alias("c"), F.col("sketch").alias("x"), F.col("n").alias("m"))
    theirs = texts.select(F.col("node").alias("v"), F.col("sketch").alias("y"), "n")
    both = salted(pairs, ours, ["c"], hot, F.xxhash64("v")).join(theirs, "v").filter(100 * F.least("n", "m").cast("long") >= percent * F.greatest("n", "m").cast("long"))
    return both.select("c", "v", "x", "y", (F.least("n", "m") < BINS).alias("small")).mapInArrow(run, "c bigint, v bigint")


def _confirmed(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among candidate edges (c, v), by the full sets."""
    total = edges.count()
    counts = edges.groupBy("c").count()
    hot = F.broadcast(hot_keys(counts, ["c"], total))
    salt = F.coalesce("__salts", F.lit(1))
    left = edges.join(hot, "c", "left").select("c", "v", F.pmod(F.xxhash64("v"), salt).alias("salt"))
    members = left.join(texts, left["v"] == texts["node"]).select("c", "salt", "v", "text")
    heads = counts.join(hot, "c", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salt.cast("bigint") - 1)))
    heads = heads.join(texts, heads["c"] == texts["node"]).select("c", "salt", F.lit(None).cast("bigint").alias("v"), "text")
    rows = heads.unionByName(members).repartition("c", "salt").sortWithinPartitions("c", "salt", F.col("v").asc_nulls_first())
    return rows.select("c", "v", "text").mapInArrow(_linker(words, percent), "a bigint, b bigint")
