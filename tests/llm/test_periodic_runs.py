"""Periodic runs against brute force, and on edge rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import periodic_runs as pr


def brute(w, least=24, times=3):
    """(start, length, period) of all runs, by comparing words one period apart."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the least period comes first
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(4)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    out = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, ["a", "b"] * 12, ["a", "b"] * 12 + ["a"], ["a", "b"] * 11 + ["a"], (["a"] * 9 + ["b"]) * 9, ["A", "a"] * 20]
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    out += [fib[-1], [c for i in range(300) for c in ("x" if bin(i).count("1") % 2 else "y")]]
    for _ in range(120):
        w = some(rng.randrange(80), rng.choice([2, 3, 400]))
        for _ in range(rng.randrange(1, 4)):
            unit = some(rng.choice([1, 2, 5, 8, 9, 13, 40]), rng.choice([2, 3, 400]))
            n = rng.randrange(1, max(2, len(unit) * rng.randrange(1, 6)) + 24)
            w += (unit * (n // len(unit) + 1))[:n] + some(rng.randrange(6), rng.choice([2, 400]))
        out.append(w)
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (40, 4)])
def test_runs(least, times):
    sample = texts()
    vocabulary = {}
    ids = np.array([vocabulary.setdefault(x, len(vocabulary)) for w in sample for x in w], np.int32)
    starts = np.cumsum([0] + [len(w) for w in sample])
    found = pr.runs_of(ids, starts, least, times)
    for w, runs in zip(sample, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == brute(w, least, times), w
    if least == 24:
        assert sum(len(r) for r in found) > 100 and max(len(r) for r in found) > 2


def test_small_trees(monkeypatch):
    """Trees of one stretch each and few leaves at once give the same runs."""
    sample = texts()
    vocabulary = {}
    ids = np.array([vocabulary.setdefault(x, len(vocabulary)) for w in sample for x in w], np.int32)
    starts = np.cumsum([0] + [len(w) for w in sample])
    whole = [r.tolist() for r in pr.runs_of(ids, starts)]
    monkeypatch.setattr(pr, "TREE_WORDS", 1)
    monkeypatch.setattr(pr, "LEAVES", 3)
    assert [r.tolist() for r in pr.runs_of(ids, starts)] == whole


def test_seed_is_exact():
    for least, times in ((24, 3), (6, 3), (40, 4), (10, 5)):
        k = pr.seed_length(least, times)
        assert all(max(least, times * q) >= 2 * q + k - 1 for q in range(1, 500)) and any(max(least, times * q) < 2 * q + k for q in range(1, 500))


def test_frame(spark):
    rows = [(i, " \n".join(w) if w else None) for i, w in enumerate(texts())] + [(3, "a \x85 a"), (None, "b " * 30), (7, ""), (8, " \t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "found_runs", "a", "p", "words", "g", "best")})
    out = pr.periodic(df)
    assert out.columns == [*df.columns, "runs_", "collapsed_"]
    got = sorted((str(r.doc_id), r.text or "", [tuple(x) for x in r["runs_"]], r["collapsed_"]) for r in out.collect())
    split = lambda t: (t or "").encode().split()
    want = sorted((str(i), t or "", brute(split(t)), b" ".join(collapse_bytes(split(t))).decode()) for i, t in rows)
    assert got == want
    assert pr.periodic(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic(df, times=2)


def collapse_bytes(w):
    gone = {i for s, n, q in brute(w) for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_best(spark):
    cases = [[], [(0, 24, 8)], [(0, 30, 10), (3, 24, 8), (50, 27, 9)], [(0, 31, 10), (9, 25, 8), (40, 3_000_000_000_1, 1_000_000_000)]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, runs array<{pr.RUN}>").select("i", pr.best(F.col("runs")).alias("b"))
    for r in df.collect():
        want = min(cases[r.i], key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (tuple(r.b) if r.b else None) == want


def test_query(spark):
    """The whole contract, on texts and ids of sf0.001 and on edge texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = []
    for r in docs.collect():
        w = [x.decode() for x in (r.text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        s, n, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(runs), s, n, q, 1000 * n // q if q else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(collapse(w, runs))))
    found = pr.op11_periodic_runs(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == sorted(want) and sum(x[1] > 0 for x in want) > 10
    assert dict(found.dtypes)["exponent_milli"] == "bigint" and dict(found.dtypes)["start"] == "bigint"


def test_damage_of_odd_rows(spark):
    rows = [(i, t) for i in range(60) for t in (None, "", " \n", "one", "one two")] + [(None, "x y")]
    out = pr.damaged(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == len(rows) and {r.text for r in out.filter("doc_id is null").collect()} == {"x y"}
