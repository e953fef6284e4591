"""Pulls by quotas against a loop over each source in its seeded order."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.operators import order
from quillspark.sources import instruct


@pytest.fixture(scope="module")
def hubs(spark):
    def rows(n, step):
        return [(f"k{i}", None if i % step == 0 else [("user", f"q{i}"), ("assistant", "a")]) for i in range(n)]

    schema = "id string, m array<struct<role: string, content: string>>"
    a, b = spark.createDataFrame(rows(300, 3), schema), spark.createDataFrame(rows(120, 7), schema)
    return {"a": instruct.Hub(a, "id", F.col("m")), "b": instruct.Hub(b, "id", F.col("m"), F.when(F.col("id").endswith("0"), "val").otherwise("train"))}


def by_hand(wanted, seed):
    parts = defaultdict(list)
    for i in range(300):
        parts["a", "val" if zlib.crc32(f"0|k{i}".encode()) < int(0.05 * 2**32) else "train"].append((f"k{i}", i % 3 > 0))
    for i in range(120):
        parts["b", "val" if i % 10 == 0 else "train"].append((f"k{i}", i % 7 > 0))
    taken, counters = set(), {}
    for offset, (g, n) in enumerate(wanted.items()):
        seen = out = 0
        for key, good in sorted(parts[g], key=lambda x: hashlib.md5(f"{seed + offset}|{x[0]}".encode()).hexdigest()):
            if out >= n:
                break
            seen += 1
            out += good
            if good:
                taken.add((*g, key))
        if seen:
            counters[g] = (seen, out, seen - out)
    return taken, counters


@pytest.mark.parametrize("few", [1, 10_000])
@pytest.mark.parametrize("train,val,fractions", [(100, 10, (0.5, 0.5)), (90, 6, (1.0, 0.0)), (5000, 3, (0.2, 0.6)), (0, 0, (0.5, 0.5))])
def test_quotas(hubs, monkeypatch, few, train, val, fractions):
    monkeypatch.setattr(order, "FEW", few)
    wanted = instruct.plan_quotas(("a", "b"), train, val, fractions)
    rows = instruct.gathered(hubs)
    taken, counters = by_hand(wanted, 9)
    made = instruct.pulled(rows, wanted, 9)
    assert {(r.source, r.split, r.key) for r in made.collect()} == taken and made.count() == len(taken)
    assert {(r.source, r.split): (r.rows_in, r.rows_out, r.rows_dropped) for r in instruct.pull_counters(rows, wanted, 9).collect()} == counters
    for g, n in wanted.items():
        assert sum(t[:2] == g for t in taken) <= n  # none where the quota is 0


def test_one_key_many_times(spark):
    """Rows of one key share a place; the quota holds all the same."""
    df = spark.createDataFrame([("k", [("user", "q")])] * 30 + [(None, [("user", "q")])] * 5, "id string, m array<struct<role: string, content: string>>")
    rows = instruct.gathered({"a": instruct.Hub(df, "id", F.col("m"), F.lit("train")), "b": instruct.Hub(df.limit(0), "id", F.col("m"), F.lit("train"))})
    for n in (1, 5, 6, 34, 35, 99):
        assert instruct.pulled(rows, {("a", "train"): n, ("b", "train"): 4}).count() == min(n, 35)


def test_no_shuffle_of_messages(hubs):
    plan = instruct.pulled(instruct.gathered(hubs), instruct.plan_quotas(("a", "b"), 50, 5, (0.5, 0.5)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
