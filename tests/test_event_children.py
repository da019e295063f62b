"""Events of a parent and its children over whole tables, against brute force."""

import os
from collections import Counter

import pytest
from terrella.plans.catalogue import QUERIES
from terrella.streaming import maintenance as T

SF = "/root/testdata/sf0.001"


def _brute(events, parents, kids):
    hit = [e for e in events if e[0] in parents]
    return Counter([(p, None, asl) for p, asl in hit] + [(p, c, asl - off) for p, asl in hit for q, c, off in kids if q == p])


def test_events_to_children(spark):
    events = [(1, 5.0), (1, 5.0), (2, 1.0), (3, 9.0), (None, 4.0), (4, None)]
    kids = [(1, 10, 0.5), (1, 11, 2.0), (3, 12, 1.0), (5, 13, 1.0), (None, 14, 1.0)]
    args = (spark.createDataFrame(events, "parent_id long, asl double"), spark.createDataFrame([(1,), (2,), (None,), (5,)], "parent_id long"), spark.createDataFrame(kids, "parent_id long, child_id long, offset double"))
    assert Counter(tuple(r) for r in T.events_to_children(*args).collect()) == _brute(events, {1, 2, 5}, kids)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_every_event_and_child_is_joined(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    events = [(u % 40, v) for u, v in read("events", "user_id", "value")]
    kids = [(n, c, float(c % 7)) for n, c in read("customer", "c_nationkey", "c_custkey")]
    got = Counter((r["parent_id"], r["child_id"], r["asl"]) for r in QUERIES["j08_event_children"](spark, SF).collect())
    assert got == _brute(events, {n for (n,) in read("nation", "n_nationkey")}, kids)
