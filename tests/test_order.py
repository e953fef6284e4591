"""Numbers, carries, samples and line order against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import order, sample, windows
from quillspark.sources import readers


def test_number_with_one_first_key(spark):
    """All rows share their first key, or it is null: they are still in several ranges, and numbered without gaps."""
    rng = random.Random(1)
    rows = [(7 if i % 50 else None, rng.randrange(10**6), str(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b long, c string").withColumn("__n", F.lit("clash"))
    found = order.number(df, ["a", "b", "c"], "no", 6)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [(r.a, r.b, r.c) for r in found.orderBy("no").collect()] == want
    assert sorted(r.no for r in found.collect()) == list(range(5000)) and found.columns == [*df.columns, "no"]
    parts = order.written(df.repartitionByRange(6, "a", "b", "c").select(F.spark_partition_id().alias("p"))).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 2500
    assert order.number(df.limit(0), ["a"], "no").count() == 0


@pytest.mark.parametrize("level", [3, 4096])
def test_before(spark, monkeypatch, level):
    monkeypatch.setattr(order, "LEVEL", level)
    rng = random.Random(2)
    rows = [(i, rng.choice([None, rng.randrange(9)])) for i in range(40) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "i long, v long")
    for how in ("sum", "max", "last"):
        for r in order.before(df, "i", "v", "b", how).collect():
            seen = [v for i, v in rows if i < r.i and v is not None]
            assert r.b == (sum(seen) if how == "sum" else (max(seen) if how == "max" else seen[-1]) if seen else None)


def test_runs_over_ranges(spark):
    rng = random.Random(4)
    at, rows = 3, []
    for _ in range(300):
        rows.append((at, rng.choice([1, 1, 2, None])))
        at += rng.choice([1, 1, 40_000, 250_000])
    want, run, last = [], None, object()
    for o, d in rows:
        if d != last:
            run, last = o, d
        want.append((o, d, run))
    found = windows.runs(spark.createDataFrame(rows, "o long, d long"), "d", "o")
    assert [(r.o, r.d, r.run) for r in found.orderBy("o").collect()] == want


@pytest.mark.parametrize("few", [1, 10_000])
def test_sample(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)
    keys = [i % 700 for i in range(900)] + [None] * 5
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    placed = sorted(keys, key=lambda k: (hashlib.md5(f"4|{'' if k is None else k}".encode()).hexdigest(), k is not None, k))
    for n in (0, 1, 3, 450, 903, 904, 905, 2000):
        assert sorted((r.k for r in sample.sample(df, "k", n, 4).collect()), key=str) == sorted(placed[:n], key=str)


def test_first_rows_and_head(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7, str(i)) for i in range(1000)], "o long, t string").repartition(5)
    for n in (0, 1, 500, 1000, 2000):
        assert sorted(r.o for r in order.first_rows(df, "o", n, width=300).collect()) == [i * 7 for i in range(1000)][:n]
    monkeypatch.setattr(sample, "FEW", 10)
    assert sorted(r.o for r in sample.head(df, "o", 40).collect()) == [i * 7 for i in range(40)]


def test_ratio_mix(spark):
    base, aux = spark.createDataFrame([(i,) for i in range(70)], "b long"), spark.createDataFrame([(i + 1000,) for i in range(90)], "a long")
    rows = sample.ratio_mix(base, aux, "b", "a", 0.3, 1).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(100)) and sum(r.kind == "aux" for r in rows) == 30
    aux_slots = set(sorted(range(100), key=lambda s: (hashlib.md5(f"1|{s}".encode()).hexdigest(), s))[:30])
    assert {r.slot for r in rows if r.kind == "aux"} == aux_slots
    chosen = sorted(sorted(range(1000, 1090), key=lambda s: (hashlib.md5(f"1|{s}".encode()).hexdigest(), s))[:30])
    assert [r.key for r in rows if r.kind == "aux"] == chosen and [r.key for r in rows if r.kind == "base"] == list(range(70))
    capped = sample.ratio_mix(base, aux, "b", "a", 0.3, 1, 21).orderBy("slot").collect()  # the cap is for base rows
    assert [r.key for r in capped if r.kind == "base"] == list(range(21)) and sum(r.kind == "aux" for r in capped) == 9
    assert sample.ratio_mix(base, None, "b", "a", 0.3, 1, 25).count() == 25


def test_line_order(spark, tmp_path):
    """Two files, read in many small blocks, are numbered as one reader would; a third is empty."""
    rng = random.Random(5)
    lines = [[rng.choice(["", "  ", f"line {f} {i} " + "x" * rng.randrange(90), "é" * rng.randrange(30)]) for i in range(400)] for f in range(2)]
    for f, name in enumerate(("part-0.txt", "part-1.txt")):
        (tmp_path / name).write_text("\n".join(lines[f]) + "\n" * f, encoding="utf-8")
    (tmp_path / "part-2.txt").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = readers.ordered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 4
        every = lines[0] + lines[1]
        assert [(r.ord, r.value) for r in found.orderBy("ord").collect()] == list(enumerate(x for x in every if x.strip()))
        assert [(r.ord, r.value) for r in readers.ordered_lines(spark, str(tmp_path), blank=True).orderBy("ord").collect()] == list(enumerate(every))
        assert "Exchange hash" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_capped_documents(spark, tmp_path):
    for f in range(2):
        (tmp_path / f"{f}.jsonl").write_text("\n\n".join(json.dumps({"text": f"text {f} {i}"}) if i % 3 else "{bad" for i in range(20)))
    rows = readers.documents(spark, str(tmp_path), max_docs=25).orderBy("ord").collect()
    assert [r.doc_id for r in rows] == list(range(25)) and [r.status == "bad_json" for r in rows] == [i % 20 % 3 == 0 for i in range(25)]
    assert rows[21].text == "text 1 1"
