"""Benchmark decontamination against brute force and on edge rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination as dc

SEP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(t):
    return [w for w in SEP.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = normal(t), set(), set()
        for k, text in items:
            b = normal(text)
            for g in {tuple(b[j : j + 10]) for j in range(max(1, len(b) - 9))} if b else ():
                for j in range(len(w) - len(g) + 1):
                    if tuple(w[j : j + len(g)]) == g:
                        hit |= set(range(j, j + len(g)))
                        found.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "日本", "Σας"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)]
    items = [(i, [f"only{i}"] + w if len(w) < 10 else w) for i, w in items]
    docs = [(n, t) for n, t in enumerate([None, "", "...", "w1", "!? w1", "A" * 3000])]
    for n in range(40):
        w = some(rng.choice([5, 30, 200]))
        for _ in range(rng.randrange(4)):
            _, it = rng.choice(items)
            a = rng.randrange(len(it))
            at = rng.randrange(len(w))
            w[at:at] = it[a : a + rng.choice([9, 10, 14, 40])] if rng.random() < 0.6 else it
        docs.append((100 + n, "".join(x.upper() + rng.choice([" ", "  ", ",\n", " -- "]) if x[0] == "w" else x + " " for x in w)))
    docs += [docs[10], docs[11], (None, docs[12][1])]
    items = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "?!"), (3, "w1 w2 w3 only3 w4"), (None, "no id here")]
    return docs, items


@pytest.fixture(scope="module")
def made(spark):
    docs, items = tables()
    clash = {c: F.lit("clash") for c in ("words", "text_hash_1", "n_words", "spans", "start", "len", "h", "items", "pieces", "t1")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)


def held(df):
    return sorted(((r.doc_id, r["n_words_"], r.n_hit, list(r["items_"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [dc.BROADCAST_BYTES, 0])
def test_brute_force(made, size):
    docs, items = made
    out = dc.report(docs, items, broadcast_bytes=size)
    assert held(out) == brute(*tables())
    assert {r.n_words for r in out.collect()} == {"clash"} and all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items_"]) for r in out.collect())
    assert sum(r.n_hit > 0 for r in out.collect()) > 15


def test_common_texts_shuffled(made, monkeypatch):
    monkeypatch.setattr(dc, "SMALL", 0)
    assert held(dc.report(*made)) == brute(*tables())


def test_removal(made):
    docs, items = made
    whole = {(i, t): n for (i, t), (_, _, n, _) in zip(sorted(tables()[0], key=lambda x: str((x[0], *brute([x], tables()[1])[0][1:]))), brute(*tables()), strict=True)}
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((k for k, n in whole.items() for _ in range(tables()[0].count(k)) if not n), key=str)
    cut = dc.cut_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for r in cut.collect():
        before = [t for i, t in tables()[0] if i == r.doc_id]
        if whole[(r.doc_id, before[0])] == 0:
            assert r.text == before[0]
            continue
        w, hit = normal(before[0]), set()
        for _, text in tables()[1]:
            b = normal(text)
            for g in {tuple(b[j : j + 10]) for j in range(max(1, len(b) - 9))} if b else ():
                for j in range(len(w) - len(g) + 1):
                    if tuple(w[j : j + len(g)]) == g:
                        hit |= set(range(j, j + len(g)))
        assert normal(r.text) == [x for j, x in enumerate(w) if j not in hit]


def test_empty_tables(spark, made):
    docs, items = made
    none = dc.report(docs, items.limit(0))
    assert none.count() == docs.count() and not none.filter("contaminated").count()
    assert dc.report(docs.limit(0), items).count() == dc.cut_spans(docs.limit(0), items).count() == 0
    assert dc.cut_spans(docs, items.limit(0)).exceptAll(docs).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df = dc.op13_decontamination(spark, sf)
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in df.collect()), key=str)
    assert found == sorted(((i, n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest()) for i, n, h, k in brute(rows, items)), key=str)
    assert "Python" not in df._jdf.queryExecution().toString()
