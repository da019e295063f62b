"""The two fits against numpy, and precision and recall on a generated sample whose labels are known."""

import random

import numpy as np
from pyspark.sql import functions as F
from terrella.llm.personal_data import BELIEFS, EM_ROUNDS, FIT_RATE, FIT_ROUNDS, HELD, KINDS, LOOKS, PRIOR, candidates, classifier, patterns, personal_data, reliabilities, report


def _sample(n=400, seed=4):
    """(text, span, whether it is personal data) of one span a text, beyond the base ones."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k - 2)) + "a1"
    good = [
        lambda: ("please call ", f"({rng.randint(200, 999)}) {digits(3)}-{digits(4)}", "phone"),
        lambda: ("my ssn is ", f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "ssn"),
        lambda: ("bank account ", f"DE{rng.randint(10, 99)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", "iban"),
        lambda: ("password=", hexes(20), "secret"),
        lambda: ('token = "', hexes(40), "secret"),
        lambda: ("use the key ", "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(15)) + "7", "secret"),
        lambda: ("write to ", f"jo{digits(2)} [at] host{digits(1)} [dot] org", "email"),
    ]
    bad = [
        lambda: ("see part ", f"{rng.randint(900, 999)}-00-{digits(4)}", "ssn"),
        lambda: ("order ", f"000-{rng.randint(10, 99)}-{digits(4)}", "ssn"),
        lambda: ("see page/", "the-quick-brown-fox-of-" + digits(3), "secret"),
        lambda: ("build ", f"release-candidate-{digits(2)}-final", "secret"),
    ]
    rows = []
    for _ in range(n):
        real = rng.random() < 0.75
        before, span, kind = rng.choice(good if real else bad)()
        rows.append((f"Some words {before}{span} and more words.", f"{kind}:{11 + len(before)}:{11 + len(before) + len(span)}", real))
    return rows


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_added_spans_on_labelled_texts(spark):
    rows = _sample()
    out = {r["doc_id"]: r["spans"].split(",") for r in report(personal_data(_frame(spark, [r[0] for r in rows]))).collect()}
    want = {(i, s) for i, (_, s, real) in enumerate(rows) if real}
    got = {(i, s) for i, spans in out.items() for s in spans if s}
    precision, recall = len(got & want) / len(got), len(got & want) / len(want)
    print(precision, recall)
    assert precision > 0.9 and recall > 0.9


def test_fits_equal_numpy(spark):
    spans = candidates(_frame(spark, [r[0] for r in _sample(150)]))
    one = patterns(spans).agg(F.sort_array(F.collect_list(F.struct("k", "v", "g", "n"))).alias("pats"))
    row = one.withColumn("rel", F.expr(reliabilities())).withColumn("w", F.expr(classifier())).first()
    k, v, g, n = (np.array([p[x] for p in row["pats"]]) for x in ("k", "v", "g", "n"))
    assert g.shape[1] == LOOKS
    believed = np.array(BELIEFS)
    prior, chance = PRIOR, believed.copy()
    held = HELD * n.sum()

    def posterior():
        y1, n1, y0, n0 = chance.T
        z = np.log(prior / (1 - prior)) + np.where(v == 1, np.log(y1 / y0), np.where(v == -1, np.log(n1 / n0), np.log((1 - y1 - n1) / (1 - y0 - n0)))).sum(1)
        return 1 / (1 + np.exp(-z))

    for _ in range(EM_ROUNDS):
        q = posterior()
        prior = ((n * q).sum() + held * PRIOR) / (n.sum() + held)
        chance = np.stack([(((v == vote) * (n * w)[:, None]).sum(0) + held * believed[:, c]) / ((n * w).sum() + held) for c, (w, vote) in enumerate([(q, 1), (q, -1), (1 - q, 1), (1 - q, -1)])], 1)
    rel = row["rel"]
    assert np.allclose([rel["prior"], *rel["yes"], *rel["no"], *rel["other_yes"], *rel["other_no"]], [prior, *chance.T.ravel()])
    x = np.concatenate([np.ones((len(k), 1)), np.stack([v == 1, v == -1], 2).reshape(len(k), -1), k[:, None] == np.arange(len(KINDS)), g], 1).astype(float)
    q, w = posterior(), np.zeros(x.shape[1])
    for _ in range(FIT_ROUNDS):
        w -= FIT_RATE * ((n * (1 / (1 + np.exp(-x @ w)) - q)) @ x / n.sum() + 0.001 * w)
    assert np.allclose(row["w"], w)


def test_long_runs_take_linear_time(spark):
    texts = ["a1" * 100_000, "a" * 200_000, "1" * 200_000, "a-1_" * 50_000 + "@b.org", "AB12" + "A1" * 100_000, "-" * 200_000]
    assert report(personal_data(_frame(spark, texts))).count() == len(texts)
