"""Near-duplicate components against a brute-force comparison of all pairs."""

import random

from terrella.llm.near_dedup import keep_one, near_duplicates

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, words):
    out, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in BLANK:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    if not out:
        return set()
    n = min(words, len(out))
    return {tuple(out[i : i + n]) for i in range(len(out) - n + 1)}


def brute(rows, words, percent):
    sets = [_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for g in groups.values():
        known = [rows[i][0] for i in g if rows[i][0] is not None]
        least = min(known) if known else None
        out += [(rows[i][0], len(sets[i]), (least if sets[i] else rows[i][0]), rows[i][0] == (least if sets[i] else rows[i][0])) for i in g]
    return sorted(out, key=repr)


def _rows():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, passage = [], make(90)
    for base in range(12):
        text = make(rng.choice([6, 12, 40, 150, 400]))
        rows.append(list(text))
        for _ in range(rng.randint(1, 6)):  # edits of the original, and of edits
            src = list(rng.choice(rows[-4:]) if base % 2 else text)
            for _ in range(max(1, len(src) // rng.choice([20, 40, 60]))):
                src[rng.randrange(len(src))] = rng.choice(vocab)
            rows.append(src)
    for _ in range(40):  # documents that share a passage, some near 0.8
        rows.append(passage + make(rng.choice([15, 20, 25, 60, 120])))
    texts = [" ".join(r) for r in rows]
    texts += [texts[0].upper(), texts[3] + "\n\t", texts[3].replace(" ", "  ")]
    texts += [None, "", "  \n", "one", "One", "two words", "é É", "four words are here", "four words are HERE"]
    out = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return [*out, out[5], (None, texts[0]), (None, "only null here"), (None, "")]


def test_components_equal_brute_force(spark):
    rows = _rows()
    for words in (4, 5):
        df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
        got = sorted((tuple(r) for r in near_duplicates(df, words=words).collect()), key=repr)
        assert got == brute(rows, words, 80)


def test_many_copies_are_one_node(spark):
    rows = [(i, "a copy that very many rows hold in common") for i in range(3000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert len(got) == 3000 and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_an_id_with_two_texts_is_two_nodes(spark):
    rng = random.Random(6)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    a, b = make(60), make(60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (1, " ".join(a))]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()), key=repr)
    assert got == brute(rows, 4, 80) and all(r[2] == 1 for r in got)


def test_small_sets_miss_no_link(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = [f"w{rng.randrange(100_000)}" for _ in range(rng.randint(8, 40))]
        for j in range(4):
            edit = list(text)
            if j:
                edit[rng.choice([0, -1, rng.randrange(len(edit))])] = f"x{i}{j}"
            rows.append((i * 10 + j, " ".join(edit)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1, 4):
        assert sorted((tuple(r) for r in near_duplicates(df, words=words).collect()), key=repr) == brute(rows, words, 80)


def test_texts_of_one_template_give_few_pairs(spark):
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(150)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(1 << 40)}" for _ in range(50)])) for i in range(3000)]  # similarity about 0.6
    rows += [(5000 + i, rows[i][1] + " end") for i in range(0, 3000, 100)]
    search = []
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, search=search).collect()
    assert sum(not r["kept"] for r in got) == 30 and all(r["component_id"] == r["doc_id"] % 5000 for r in got)
    assert search[0].pairs < 42 * len(rows)  # all pairs would be 4.6 million


def test_one_row_of_each_component_is_kept(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, text), (None, text), (4, text + " x"), (3, text), (3, text), (9, None), (9, None), (None, ""), (8, "a text of its own that stays here"), (None, "no id for this text at all"), (None, "no id for this text at all")]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, tkey int")
    out = keep_one(df, words=4)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(3, text), (9, None), (9, None), (None, ""), rows[8], rows[9]], key=repr)
