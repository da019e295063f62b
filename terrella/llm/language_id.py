"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the hashed letter 1- to 4-grams of its lower-cased words (a word's edges count as a letter, so
prefixes and suffixes have n-grams of their own).  Each n-gram has an embedding; a text is the mean of them; a linear
softmax gives the language.  Both are trained together by stochastic gradient descent in numpy, on the driver, over a
bounded sample of labelled rows (``per_language`` rows a language).  A part of that sample is kept from training to fit
the temperature of the softmax and the score below which a prediction is rejected (``accepted`` is then false).

As the softmax is linear in the mean, prediction needs only the product of the embedding table and the weights: one
row of scores per hash bucket, summed over the whole text in slices of bounded memory.

Defined results: a null or empty text, or one without a letter, gives ``und`` with score 0 and accepted false; so does
every text when there is nothing to learn from.  Rows that repeat an id each get a result.  Rows without language or
with a null id teach nothing.  Ties between languages go to the one that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.llm.common import tune

ORDERS = (1, 2, 3, 4)
BITS = 15
DIM = 16
#: Buckets of a training text that are kept, chosen at random by the text: with the row bound, it bounds what the driver gets.
TRAIN_GRAMS = 8192
#: Rows that each language may have at least, however many languages there are.
FEW = 20
#: Code points of a text that are handled at once.
SLICE = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of a text's n-grams, slice by slice; nothing for a text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return
    points = np.where(_letter_table()[points], points, np.uint32(0))
    if not points.any():
        return
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    longest = max(ORDERS)
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE + longest - 1]
        h = np.zeros(len(part), np.uint32)
        inner = np.ones(len(part), bool)  # no gap inside the n-gram
        for n in ORDERS:
            size = min(len(part) - n + 1, SLICE)
            if size <= 0:
                break
            last = part[n - 1 : n - 1 + size]
            h = (h[:size] ^ (last * _MULTIPLIERS[n - 1])) * np.uint32(0x01000193) + np.uint32(n)
            if n == 1:
                ok = last != 0
            else:
                inner = inner[:size] & (part[n - 2 : n - 2 + size] != 0) if n > 2 else np.ones(size, bool)
                ok = inner & ((last != 0) | (part[:size] != 0)) if n == 2 else inner
            x = h ^ (h >> np.uint32(15))
            yield ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))[ok]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, text: str | None) -> tuple[str, float, bool]:
        total, n = np.zeros(len(self.languages), np.float64), 0
        for part in grams(text or "") if self.languages else ():
            if len(part):
                counts = np.bincount(part, minlength=1 << BITS) if len(part) > 20_000 else None
                total += counts @ self.table if counts is not None else self.table[part].sum(0, dtype=np.float64)
                n += len(part)
        if not n:
            return "und", 0.0, False
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject_below)


def _bags(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        langs, tests, idx, cnt = [], [], [], []
        for lang, test, text in zip(batch.column("lang").to_pylist(), batch.column("test").to_pylist(), batch.column("text"), strict=True):
            parts = list(grams(text.as_py() or ""))
            if parts:
                counts = np.bincount(np.concatenate(parts), minlength=1 << BITS)
                at = np.flatnonzero(counts)
                if len(at) > TRAIN_GRAMS:
                    at = np.sort(np.random.default_rng(int(counts @ np.arange(1 << BITS))).choice(at, TRAIN_GRAMS, replace=False))
                langs.append(lang), tests.append(test), idx.append(at.astype("<u2").tobytes()), cnt.append(np.minimum(counts[at], 65535).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(tests, pa.bool_()), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["lang", "test", "idx", "cnt"])


def _fit(rows: list, epochs: int, rate: float, seed: int) -> Model:
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    data = [(np.frombuffer(r["idx"], "<u2").astype(np.int64), np.frombuffer(r["cnt"], "<u2").astype(np.float32), languages.index(r["lang"]), r["test"]) for r in rows]
    train, test = [d for d in data if not d[3]] or data, [d for d in data if d[3]] or data
    L = len(languages)
    E = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    W, b = np.zeros((DIM, L), np.float32), np.zeros(L, np.float32)
    weight = np.array([len(train) / (L * max(1, n)) for n in np.bincount([d[2] for d in train], minlength=L).tolist()], np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            idx, cnt, y, _ = train[k]
            lr = rate * (1 - step / steps)
            step += 1
            if len(idx) > 8:  # a random part of the n-grams, so that short texts are learnt as well
                keep = rng.random(len(idx)) < rng.uniform(0.05, 1)
                if keep.any():
                    idx, cnt = idx[keep], cnt[keep]
            share = cnt / cnt.sum()
            e = share @ E[idx]
            z = e @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= min(weight[y], 4)
            back = W @ p
            W -= lr * np.outer(e, p)
            b -= lr * p * 0.1
            E[idx] -= (lr * 4 * share)[:, None] * back
    table = (E @ W).astype(np.float32)

    logits = np.array([(c / c.sum()) @ table[i] + b for i, c, _, _ in test])
    truth = np.array([y for _, _, y, _ in test])
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        z = logits / t
        z -= z.max(1, keepdims=True)
        loss = -(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean()
        best = min(best, (float(loss), float(t)))
    z = logits / best[1]
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == truth
    reject = float(np.quantile(p.max(1)[right], 0.01)) if right.any() else 0.0
    return Model(languages, table, b.astype(np.float64), best[1], min(reject, 0.99))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000, max_rows: int = 12_000, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit a model on rows where ``learn`` is true: at most about ``per_language`` rows for every language and
    ``max_rows`` in all (or FEW a language, where that is more), chosen by a hash of the id; a fifth calibrates."""
    tune(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    counts = docs.filter(learn & docs[lang_col].isNotNull()).groupBy(docs[lang_col].alias("lang")).count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return _fit([], epochs, rate, seed)
    per_language = min(per_language, max(FEW, max_rows // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    h = F.xxhash64(F.lit(seed), "id")
    chosen = rows.filter(F.pmod(h, F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("lang", "text", (F.pmod(F.shiftright(h, 21), F.lit(5)) == 0).alias("test"), "id")
    bags = chosen.select("lang", "test", "text").mapInArrow(_bags, "lang string, test boolean, idx binary, cnt binary")
    return _fit(sorted(bags.collect(), key=lambda r: (r["lang"], r["idx"], r["cnt"])), epochs, rate, seed)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and accepted for every row; the model (2**15 rows of scores) goes along with the tasks."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in stream:
            rows = [m.scores(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id bigint, lang_pred string, score double, accepted boolean")
