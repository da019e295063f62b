"""Personal data: base spans against a brute-force matcher, and the spans that weak supervision adds."""

import hashlib
import random
import re

from terrella.llm.personal_data import KINDS, personal_data, report

BRUTE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        if not 14 <= len(digits) <= 19:
            return False
        total = 0
        for i, c in enumerate(reversed(digits)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for k, (kind, rx) in enumerate(BRUTE):
        for m in re.finditer(rx, text or ""):
            if _passes(kind, m[0]):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def _texts():
    rng = random.Random(5)
    pieces = ["a@b.c", "x.y%+-@d-e.f.g", "@", "a@b", ".c", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (743) 555-3824", "+12", "+1234567890123456", " ", "-", ".", "_c@d.e", "\n", "é", "😀", "word", "12", "x@a.b_c@d.e", "+49 30 1234567 ", "5.6.7.8.9.10.11.12", "(743) 555-3824"]
    out = [None, "", " ", "a@b.c", "😀é a@b.c 1.2.3.4", "1.2.3.4.5.6.7.8", "a" * 50_000, "a" * 5_000 + "@b.cc", "1" * 20_000, "1.1.1.1 " * 2_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "+1" + " " * 20_000 + "1"]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return out


def test_base_spans_equal_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in report(personal_data(df)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        line = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (t or "")[:200]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in want) for n in range(4)]
        have = [x for x in r["spans"].split(",") if x]
        assert set(line.split(",")) - {""} <= set(have)


def test_candidates_are_added_and_repeats_kept(spark):
    good = [(i, f"please call our office, phone (212) 555-01{i % 90 + 10} or mail a{i}@b.org", "s") for i in range(40)]
    rows = [*good, (100, "call 212-555-0187 now", "s"), (100, "call 212-555-0187 now", "s"), (None, "my ssn 123-45-6789", "s"), (7, "nothing here at all", "s")]
    out = report(personal_data(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert len(out) == len(rows)
    assert sum(r["doc_id"] == 100 for r in out) == 2
    assert all("phone" in r["spans"] for r in out if r["doc_id"] is not None and r["doc_id"] < 40 and r["doc_id"] != 7 and "email" in r["spans"])
    assert [r["spans"] for r in out if r["doc_id"] == 7 and "email" not in r["spans"]] == [""]


def test_empty_table(spark):
    assert report(personal_data(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
