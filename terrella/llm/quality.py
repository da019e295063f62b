"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Tokens are runs of letters (lower-cased A-Z, hashed to 2**BITS rows), a shape token for each such run (its case and
length), runs of digits (their length) and runs of any other signs.  Random indexing: each row has a fixed sparse
ternary index vector; the vector of a row is its own index vector plus the length-normalised, log-damped sum of the
index vectors found within WINDOW tokens of it in the training texts.  A document is pooled to the mean of the vectors
of its tokens, the spread of them, and the share of distinct tokens and lines.  A two-layer network is trained on it
in numpy by stochastic gradient descent, and a temperature is fitted on a part kept from training.

The fit uses a bounded sample of labelled rows (``per_class`` rows a label, chosen by a hash of the id); scoring reads
every whole text.  Defined results: a null text counts as empty; an empty text pools to zeros and is scored like any
other; rows that repeat an id are all scored; documents without a label teach nothing, those with conflicting labels
teach the larger one; with no labels at all every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import tune, with_added
from terrella.llm.vectors import mix, run_hashes

BITS = 14
DIM = 32
NONZERO = 4
WINDOW = 3
HIDDEN = 24
FEATURES = 2 * DIM + 3

_kind = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other sign
_kind[[9, 10, 11, 12, 13, 32]] = 0
_kind[48:58] = 2
_kind[65:91] = _kind[97:123] = 1
_kind[128:] = 1
_upper = np.zeros(256, np.int64)
_upper[65:91] = 1
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def tokens(text: bytes) -> np.ndarray:
    """Rows of a text's tokens, in order; a run of letters gives its word and then its shape."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _kind[data]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [len(data)]])
    s, e = cut[:-1], cut[1:]
    k = kind[s]
    s, e, k = s[k > 0], e[k > 0], k[k > 0]
    if not len(s):
        return np.zeros(0, np.int64)
    size = np.minimum(e - s, 15)
    ups = np.concatenate([[0], np.cumsum(_upper[data])])
    caps = ups[e] - ups[s]
    case = np.where(caps == 0, 0, np.where(caps == e - s, 2, np.where((caps == 1) & (_upper[data[s]] == 1), 1, 3)))
    word = run_hashes(_lower[data], s, e)
    shape = mix((np.uint64(7) + case.astype(np.uint64) * np.uint64(16) + size.astype(np.uint64)) * np.uint64(64))
    digit = mix(np.uint64(1 << 20) + size.astype(np.uint64))
    first = np.where(k == 2, digit, word)
    out = np.empty(2 * len(s), np.uint64)
    out[0::2], out[1::2] = first, shape
    keep = np.ones(len(out), bool)
    keep[1::2] = k == 1
    return (out[keep] >> np.uint64(64 - BITS)).astype(np.int64)


def index_vectors(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, DIM), np.float32)
    at = rng.integers(0, DIM, (1 << BITS, NONZERO))
    sign = rng.choice(np.array([-1, 1], np.float32), (1 << BITS, NONZERO))
    np.add.at(out, (np.repeat(np.arange(1 << BITS), NONZERO), at.ravel()), sign.ravel())
    return out


def word_vectors(texts: list[np.ndarray], seed: int) -> np.ndarray:
    """Random indexing over token sequences."""
    index = index_vectors(seed)
    context = np.zeros_like(index)
    for t in texts:
        if len(t) < 2:
            continue
        sums = np.concatenate([np.zeros((1, DIM), np.float32), np.cumsum(index[t], 0, dtype=np.float32)])
        at = np.arange(len(t))
        near = sums[np.minimum(at + WINDOW + 1, len(t))] - sums[np.maximum(at - WINDOW, 0)] - index[t]
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.diff(t[order], prepend=-1))
        context[t[order][first]] += np.add.reduceat(near[order], first)
    size = np.linalg.norm(context, axis=1, keepdims=True)
    return (index / np.sqrt(NONZERO) + context / np.maximum(size, 1e-6) * np.log1p(size) / 4).astype(np.float32)


def pooled(text: bytes, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    t = tokens(text)
    if len(t):
        counts = np.bincount(t, minlength=1 << BITS)
        rows = np.flatnonzero(counts)
        share = (counts[rows] / len(t)).astype(np.float32)
        v = vectors[rows]
        mean = share @ v
        out[:DIM] = mean
        out[DIM : 2 * DIM] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        lines = text.split(b"\n")
        out[2 * DIM :] = np.log1p(len(t)) / 10, len(rows) / len(t), len(set(lines)) / len(lines)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((h @ self.w2 + self.b2) / self.temperature, -30, 30)))


def fit(texts: list[bytes], labels: list[int], held: list[bool], epochs: int = 40, rate: float = 0.05, seed: int = 11) -> Model:
    vectors = word_vectors([tokens(t) for t in texts], seed)
    zero = np.zeros(FEATURES, np.float32)
    if not texts:
        return Model(vectors, zero, zero + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    x = np.array([pooled(t, vectors) for t in texts])
    y, test = np.array(labels, np.float64), np.array(held)
    if test.all() or not test.any():
        test = np.zeros(len(y), bool)
    fitting = ~test
    shift, scale = x[fitting].mean(0), x[fitting].std(0) + 1e-3
    z = (x - shift) / scale
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0
    moving = [np.zeros_like(w1), np.zeros_like(b1), np.zeros_like(w2), 0.0]
    order = np.flatnonzero(fitting)
    steps, step = epochs * -(-len(order) // 32), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            k = order[at : at + 32]
            lr = rate * (1 - step / steps)
            step += 1
            h = np.tanh(z[k] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))
            d = (p - y[k]) / len(k)
            back = np.outer(d, w2) * (1 - h * h)
            for i, g in enumerate((z[k].T @ back + 1e-3 * w1, back.sum(0), h.T @ d + 1e-3 * w2, d.sum())):
                moving[i] = 0.9 * moving[i] + g
            w1 -= lr * moving[0]
            b1 -= lr * moving[1]
            w2 -= lr * moving[2]
            b2 -= lr * moving[3]
    # Calibration: the temperature with the least loss on the part kept from training.
    c = test if test.any() else fitting
    logit = np.tanh(z[c] @ w1 + b1) @ w2 + b2
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 10, 60):
        q = np.clip(1 / (1 + np.exp(-np.clip(logit / t, -30, 30))), 1e-9, 1 - 1e-9)
        best = min(best, (float(-(y[c] * np.log(q) + (1 - y[c]) * np.log(1 - q)).mean()), float(t)))
    return Model(vectors, shift, scale, w1, b1, w2, float(b2), best[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, max_bytes: int = 65_536, seed: int = 11) -> Model:
    """Fit on at most about ``per_class`` labelled rows a label among those where ``learn`` (over ``labels``) is true.

    Rows of more than ``max_bytes`` of text teach nothing, which bounds what the driver gets.
    """
    tune(docs.sparkSession)
    known = labels.filter(learn & labels[label_col].isin(0, 1)).groupBy(labels[id_col].cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    h = F.xxhash64(F.lit(seed), "__id")
    part = F.lit(0.0)
    for y, n in counts.items():
        part = F.when(F.col("__y") == y, F.lit(min(1.0, per_class / n))).otherwise(part)
    chosen = known.filter(F.pmod(h, F.lit(1_000_003)) < part * 1_000_003).orderBy(h).limit(3 * per_class)
    texts = docs.select(docs[id_col].cast("long").alias("__id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("__text")).filter(F.length("__text") <= max_bytes)
    # The sample has at most 3 * per_class rows, whatever repeats: of several texts with one id the first in order teaches.
    rows = texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.max("__y").alias("__y"), F.min("__text").alias("__text")).collect()
    rows.sort(key=lambda r: r["__id"])
    held = [bool(mix(np.array([r["__id"]], np.int64).view(np.uint64))[0] % np.uint64(5) == 0) for r in rows]
    return fit([bytes(r["__text"]) for r in rows], [r["__y"] for r in rows], held, seed=seed)


def score(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "__score") -> DataFrame:
    """The columns of ``docs`` and the probability that its label is 1, which replaces a column of its name."""
    if as_col == text_col:
        raise ValueError("the score needs a column of its own")
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*(docs[c] for c in docs.columns if c != as_col))
    carried = list(src.columns)
    at = carried.index(text_col)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in stream:
            x = np.array([pooled((t.as_py() or "").encode("utf-8", "surrogatepass"), m.vectors) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.scores(x).astype(np.float64), pa.float64())], names=[*carried, as_col])

    return src.mapInArrow(run, with_added(src, **{as_col: "double"}))
