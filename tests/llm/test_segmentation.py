"""Sampling of segmentations against full enumeration, and exact round trips."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from terrella.llm import segmentation as S

pytestmark = pytest.mark.skipif(not os.path.exists(S.DEFAULT_MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocab():
    return S.load()


def _all(vocab, word):
    index = {p: i for i, p in enumerate(vocab.pieces) if not vocab.kinds[i]}
    text, out = S.SPACE + word, {}

    def go(i, ids, w):
        if i == len(text):
            out[tuple(ids)] = w
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in index:
                k = index[text[i:j]]
                go(j, [*ids, k], w + vocab.weights[k])

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


def test_top_k_is_sampling_without_replacement(vocab):
    vocab = S.load(piece_cost=0.0)
    truth, k, n = _all(vocab, "theing"), 3, 3000
    first, weight = Counter(), Counter()
    for s in range(n):
        got = list(S.sample_group(vocab, [(s, "theing")], k, 1))
        keys = [tuple(g[2].tolist()) for g in got]
        assert len(set(keys)) == k and [g[4] for g in got] == sorted((g[4] for g in got), reverse=True)
        for key, g in zip(keys, got, strict=True):
            assert abs(g[3] - truth[key]) < 1e-9 and 0 < g[5] <= 1
            weight[key] += 1 / g[5] / n  # each path's inverse inclusion weights add up to its expectation of one
        first[keys[0]] += 1
    for key in sorted(truth, key=lambda x: -truth[x])[:3]:
        p = math.exp(truth[key])
        assert abs(first[key] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(weight[key] - 1) < 0.25


def test_all_segmentations_of_a_short_text(vocab):
    got = list(S.sample_group(vocab, [(1, "ab")], 50, 1))
    assert {tuple(g[2].tolist()) for g in got} == set(_all(vocab, "ab")) and all(g[5] == 1 for g in got)


def test_round_trip_and_cases(spark, vocab):
    texts = [None, "", " ", "  two  spaces ", "line\nbreak\ttab", "é字😀", "▁ already ▁▁ marked", "a" * 5000, "x" * 200 + "字" * 3000, "the same", "the same"]
    df = spark.createDataFrame([(i if i < 10 else 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = S.sample(df, vocab, k=2).collect()
    assert all(r["exact"] for r in rows)
    assert sum(r["id"] == 0 for r in rows) == 1 and [r["ids"] for r in rows if r["id"] == 1] == [[]]
    same = [r for r in rows if r["id"] == 9]
    assert len(same) == 4 and same[0]["ids"] == same[2]["ids"]
    assert [r["ids"] for r in S.sample(df.repartition(3), vocab, k=2).orderBy("id", "rank").collect() if r["id"] == 3] == [r["ids"] for r in rows if r["id"] == 3]
    assert S.sample(df.limit(0), vocab).collect() == []
    enc = S.decode(S.encode(df.select("text")), vocab).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in enc if "▁" not in (r["text"] or ""))


def test_documents_of_a_group_do_not_touch_each_other(vocab):
    rows = [(i, t) for i, t in enumerate(["some words of a text", "", "more words, with 字 and é", "a" * 700, "words of a text again", None, "  two  spaces"])]
    together = list(S.sample_group(vocab, rows, 4, 9))
    alone = [(n, *g[1:]) for n, row in enumerate(rows) for g in S.sample_group(vocab, [row], 4, 9)]
    assert [(a[0], a[1], a[2].tolist()) for a in together] == [(b[0], b[1], b[2].tolist()) for b in alone]
    assert all(abs(a[j] - b[j]) < 1e-6 for a, b in zip(together, alone, strict=True) for j in (3, 4, 5))


def test_places_far_from_the_end_have_the_same_probabilities(vocab, monkeypatch):
    word = [S.SPACE + "abcdefghij" * 60]
    near, far = S.Lattice(vocab), S.Lattice(vocab)
    monkeypatch.setattr(S, "LONG", 10_000)
    near.add(word)
    monkeypatch.setattr(S, "LONG", 5)
    far.add(word)
    assert np.allclose(near.p[: near.edges], far.p[: far.edges], rtol=1e-9)
    total = np.add.reduceat(far.p[: far.edges], np.sort(far.first[: far.size]))
    assert np.allclose(total, 1)


def test_one_word_of_a_million_characters(vocab):
    text = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000))
    got = list(S.sample_group(vocab, [(1, text)], 2, 1))
    assert len(got) == 2 and all(vocab.decode(g[2]) == text for g in got) and got[0][2].tolist() != got[1][2].tolist()


def test_a_group_looks_up_each_word_once(vocab, monkeypatch):
    asked, numbers = [], S.Lattice.numbers
    monkeypatch.setattr(S.Lattice, "numbers", lambda self, words, bare: asked.append(list(words)) or numbers(self, words, bare))
    for rows in ([(1, "the same the same"), (2, ""), (3, "same words")], [(1, " the  same the  same"), (2, None), (3, "same words")]):
        got = list(S.sample_group(vocab, rows, 2, 1))
        assert [g[0] for g in got] == [0, 0, 1, 2, 2]
        assert all(vocab.decode(g[2]) == (rows[g[0]][1] or "") for g in got)
    assert asked[0] == ["the", "same", "words"] and len(asked[1]) == len(set(asked[1]))


def test_a_lattice_that_forgets_is_like_a_new_one_and_keeps_its_room(vocab):
    first, second = [(i, f"some words {i} of 字é a text ▁") for i in range(9)], [(i, f"another {i} 字") for i in range(5)]
    lattice = S.Lattice(vocab)
    S.sample_rows(lattice, first, 3, 1)
    room = lattice.p
    lattice.clear()
    a, b = S.sample_rows(lattice, second, 3, 1), S.sample_rows(S.Lattice(vocab), second, 3, 1)
    assert lattice.p is room
    assert a.ids.tolist() == b.ids.tolist() and a.ends.tolist() == b.ends.tolist() and a.perturbed == b.perturbed


def test_edges_of_a_lattice_are_all_pieces_by_length(vocab, monkeypatch):
    index = {p: i for i, p in enumerate(vocab.pieces) if not vocab.kinds[i]}
    units = [S.SPACE + w for w in ("theing", "a", "x字é\U0001f600y", "abcdefghij" * 3)]
    for near in (256, 5):
        monkeypatch.setattr(S, "LONG", near)
        lattice = S.Lattice(vocab)
        lattice.add(units)
        for unit, start in zip(units, lattice.starts.tolist(), strict=False):
            for i in range(len(unit)):
                want = [(j - i, index.get(unit[i:j], -1)) for j in range(i + 1, len(unit) + 1) if j == i + 1 or unit[i:j] in index]
                low, n = int(lattice.first[start + i]), int(lattice.count[start + i])
                edges = np.arange(low, low + n)
                assert [(int(d) - start - i, max(int(p), -1)) for d, p in zip(lattice.dst[edges], lattice.piece[edges], strict=True)] == want
                assert (lattice.src[edges] == start + i).all() and (lattice.open[edges] == (n > 1)).all()
                assert (lattice.end[edges] == (lattice.dst[edges] == start + len(unit))).all()
                assert math.isclose(lattice.p[edges].sum(), 1) and lattice.top[start + i] == lattice.p[edges].max() == lattice.p[lattice.best[start + i]]


def test_half_a_surrogate_pair_is_a_character_of_its_own(vocab):
    got = list(S.sample_group(vocab, [(1, "a \ud800 b"), (2, "plain words")], 2, 1))
    assert [vocab.decode(g[2]) for g in got] == ["a ? b"] * 2 + ["plain words"] * 2
    assert got[2][2].tolist() == list(S.sample_group(vocab, [(2, "plain words")], 2, 1))[0][2].tolist()


def test_ids_without_bytes_decode_to_nothing(vocab):
    control = int(np.flatnonzero(vocab.kinds == 2)[0])
    assert vocab.decode([control, control]) == "" == vocab.decode([])
