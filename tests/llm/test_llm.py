"""Operators of quillspark.llm on edge rows and against brute force."""

import gc
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import boosting, exact_dedup, jaccard_join, kneser_ney, lbl_lm, line_dedup, minhash, mixing, packing, toxicity, url_reputation
from quillspark.llm.common import materialise, shingles, words_of
from quillspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " ", "a", "a b", "A  b", "one two three", "x" * 5000, "é ü 日本 <|endoftext|> end", "tab\tnew\nline\x0bvt\x0cff\rcr\x1cfs\x85nel\xa0nbsp", "a b"]


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus():
    """(doc_id, text): edge texts, copies, near copies, long texts, and a passage that many share."""
    rng = random.Random(1)
    texts = list(EDGE)
    passage = " ".join(words(60, 99))
    for g in range(12):
        base = words(rng.choice([9, 10, 12, 30, 120, 400]), g)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(9))
            texts.append((" " if rng.random() < 0.3 else "") + "  ".join(copy))
    texts += [" ".join(words(40, 200 + i)) + " " + passage for i in range(15)]
    texts.append(" ".join(words(20_000, 7)))
    return list(enumerate(texts, 100))


def frame(spark, rows, extra=True):
    data = [(i, t, "en" if (i or 0) % 3 else "de", f"src{(i or 0) % 4}", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("text_hash", "maybe", "h", "n", "key", "node", "score", "bucket", "mix_times", "block_0", "size", "keep")}) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def normal(t):
    out = []
    for c in t or "":
        if c in " \t\n\x0b\x0c\r":
            if not out or out[-1] != " ":
                out.append(" ")
        else:
            out.append(c)
    return "".join(out)


def test_exact_groups(spark, docs, empty):
    groups = defaultdict(list)
    for i, t in corpus():
        groups[normal(t)].append(i)
    found = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(found) == len(corpus())
    for t, ids in groups.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(x) for x in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_groups_nulls_and_ties(spark):
    df = frame(spark, [(None, "x"), (5, "x"), (5, "x"), (None, None), (None, "")])
    rows = exact_dedup.exact_groups(df).collect()
    assert sum(r.kept for r in rows) == 2 and {r.keep_id for r in rows if r.doc_id == 5} == {5}
    assert exact_dedup.drop_exact_copies(df).count() == 2


def test_filter_has_no_false_negatives(spark):
    hashes = [(i % 700) * 7919 for i in range(1000)]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    for blocks in (1, 1024, exact_dedup.MAX_BLOCKS):
        counts = Counter(hashes)
        rows = exact_dedup.possibly_repeated(df, "h", "maybe", max_blocks=blocks).collect()
        assert all(r.maybe for r in rows if counts[r.h] > 1)
    assert sum(not r.maybe for r in rows) > 300


def sets(rows, width):
    out = {}
    for i, t in rows:
        w = words_of((t or "").encode())
        k = min(width, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def brute_components(rows, width, percent):
    s = sets(rows, width)
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    links = dict.fromkeys(ids, 0)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
                links[a] += 1
                links[b] += 1
    return {i: (len(s[i]), find(i), links[i]) for i in ids}


def components_found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(docs, width, percent):
    want = brute_components(corpus(), width, percent)
    found = components_found(jaccard_join.jaccard_components(docs, width, percent))
    assert found == want


def test_jaccard_all_sizes_by_lists_or_subsets(docs, monkeypatch):
    want = brute_components(corpus(), 3, 90)
    for bound in (0, 40, 10_000):
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_, b=bound: b)
        small = docs.filter(F.length("text") < 20_000) if bound > 1000 else docs
        found = components_found(jaccard_join.jaccard_components(small))
        assert found == {i: v for i, v in want.items() if i in found} and len(found) >= len(want) - 2


def test_jaccard_edges(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0 and jaccard_join.drop_near_copies(empty).count() == 0
    df = frame(spark, [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None), (9, "q r s t")])
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.n_links) for r in jaccard_join.jaccard_components(df).collect())
    assert rows == [(-1, -1, 0), (-1, 3, 2), (3, 3, 2), (3, 3, 2), (9, 9, 0)]
    # one doc_id with different texts: each is a set of its own
    texts = [" ".join(words(40, k)) for k in range(3)]
    df = frame(spark, [(1, texts[0]), (1, texts[1]), (2, texts[1] + " more"), (3, texts[2])])
    rows = sorted((r.doc_id, r.component_id, r.n_shingles, r.n_links) for r in jaccard_join.jaccard_components(df).collect())
    assert rows == [(1, 1, 38, 0), (1, 1, 38, 1), (2, 1, 39, 1), (3, 3, 38, 0)]


def test_jaccard_links_in_large_groups(spark, monkeypatch):
    """A group of near copies over several blocks, met by parts: links inside a component are all counted."""
    rng = random.Random(4)
    rows = []
    for i in range(70):
        w = words(60, 1)
        for k in rng.sample(range(60), rng.randrange(4)):
            w[k] = f"edit{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(words(9, 2))) for i in range(5)]
    for name, n in (("LINK_BLOCK", 7), ("MEET", 4), ("BLOCK_SHINGLES", 60), ("STRIP", 2)):
        monkeypatch.setattr(jaccard_join, name, n)
    assert components_found(jaccard_join.jaccard_components(frame(spark, rows))) == brute_components(rows, 3, 90)
    assert jaccard_join.boundary({}, 0.0, 90) == 0


def test_jaccard_in_blocks(docs, monkeypatch):
    """Long lists: hardly similar sets, of which a few join only through others."""
    monkeypatch.setattr(jaccard_join, "FEW", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    want = brute_components(corpus(), 3, 70)
    found = components_found(jaccard_join.jaccard_components(docs, 3, 70))
    assert found == want


def test_boundary_is_by_cost():
    sizes = dict.fromkeys(range(9, 400), 10)
    assert jaccard_join.boundary(sizes, 0.0, 90) <= jaccard_join.boundary(sizes, 5.0, 90) <= jaccard_join.boundary(sizes, 50.0, 90)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (None, 4), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.COM:80/En/x?q#f", "x://www.example.com/en/1", "https://a.example.com/en/", "http://net", "http://b.net/fr/a", "http://notexample.com/en/", "http://u@h.co.uk/p", "http://com?x", "a://b://c/d", "http://1.2.3.4/", "http:///p"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0, None) for i in range(0)], "doc_id long, quality int, toxic int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, labels).collect()}
    assert found[0] == found[1] == ("", "", None, "allow")
    assert found[2] == ("a.example.com:80", "/En/x", None, "allow")
    assert found[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert found[4] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert found[5] == ("net", "", None, "allow") and found[6] == ("b.net", "/fr/a", "net/fr/", "block")
    assert found[7][2:] == ("com/", "allow") and found[9] == ("com", "", None, "allow") and found[10] == ("b:", "//c/d", None, "allow") and found[12] == ("", "/p", None, "allow")


def test_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 2}.org/{i}", "") for i in range(400)] + [(400, "http://bad.site1.org/new", ""), (401, "http://other.site1.org/", ""), (402, "http://x.else.org/", "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0 if i % 2 and i % 10 != 1 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in url_reputation.judge(pages, labels, rules=()).collect()}
    assert found[400].verdict == "block" and found[0].verdict == "allow" and found[402].verdict == "allow"
    assert found[402].bad_mean < found[401].bad_mean < found[400].bad_mean
    assert url_reputation.judge(pages.limit(0), labels).count() == 0
    assert url_reputation.judge(pages, labels.limit(0)).count() == 403


def fill(budget, caps, weights):
    """Shares by repeated redistribution, in exact fractions."""
    from fractions import Fraction

    share, open_ = {k: Fraction(0) for k in caps}, set(caps)
    left = Fraction(budget)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] <= left * weights[k] / total]
        if not full:
            for k in open_:
                share[k] = left * weights[k] / total
            break
        for k in full:
            share[k] = Fraction(caps[k])
        left -= sum(caps[k] for k in full)
        open_ -= set(full)
    return share


def test_share_out(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(30):
        kids = [f"k{j}" for j in range(rng.randrange(1, 7))]
        caps, weights = {k: rng.randrange(1, 100) for k in kids}, {k: rng.randrange(1, 5) for k in kids}
        budget = rng.randrange(0, sum(caps.values()) + 1)
        rows += [(g, k, caps[k], weights[k], budget) for k in kids]
        want[g] = (fill(budget, caps, weights), budget)
    df = spark.createDataFrame(rows, "g int, k string, capacity long, weight long, total long")
    found = defaultdict(dict)
    for r in mixing.share_out(df, ["g"], "k", "total").collect():
        found[r.g][r.k] = r.share
    for g, (shares, budget) in want.items():
        assert sum(found[g].values()) == budget
        assert all(abs(found[g][k] - s) <= 1 for k, s in shares.items())


def test_mix(spark, docs, empty):
    rows = mixing.plan(mixing.keys_of(docs)).collect()
    total = sum(len(words_of((t or "").encode())) for _, t in corpus())
    assert sum(r.epochs * r.n_tokens + r.taken for r in rows) == total * mixing.SHARE // 1000
    by_leaf = defaultdict(list)
    for r in rows:
        by_leaf[(r.domain, r.lang, r.source)].append(r)
    for leaf in by_leaf.values():
        left = leaf[0].budget - leaf[0].epochs * sum(r.n_tokens for r in leaf)
        for r in sorted(leaf, key=lambda r: (hashlib.md5(f"{mixing.SEED}|{r.epochs}|{r.doc_id}".encode()).hexdigest(), r.n_tokens)):
            assert r.taken == max(0, min(r.n_tokens, left))
            left -= r.n_tokens
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == Counter({r.doc_id: r.epochs + (r.taken > 0) for r in rows if r.epochs + (r.taken > 0)})
    assert mixing.mix(empty).count() == 0 and mixing.plan(mixing.keys_of(empty)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, 0), (1, "a b", None, "src0", 3)], DOCS)
    assert mixing.plan(mixing.keys_of(odd)).count() == 2 and mixing.mix(odd).count() >= 1


def test_packing(docs, empty):
    path = packing.tokenizer_path()
    model = packing.byte_bpe(path).model
    rows = packing.pack(docs, window=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in corpus():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack(empty).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(0)
    count = np.bincount(np.clip(rng.lognormal(5.5, 1, 40_000).astype(int), 1, 2047), minlength=2049)
    done = packing.plan(count)
    used = np.zeros_like(count)
    for repeats, lengths in done:
        assert repeats > 0 and sum(lengths) <= 2048
        np.add.at(used, list(lengths), repeats)
    assert (used == count).all()
    padding = sum(r * (2048 - sum(v)) for r, v in done) / sum(2048 * r for r, _ in done)
    assert padding < 0.005


def test_chunks_are_whole_texts(docs):
    rng = random.Random(5)
    bpe = packing.byte_bpe(packing.tokenizer_path())
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85\xa0\u2003\u3000aabB'st12,.é日!_<|") for _ in range(rng.randrange(40))) for _ in range(500)]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.model.encode(t, add_special_tokens=False).ids


def test_marks_make_no_new_chunks():
    bpe = packing.ByteBpe(packing.tokenizer_path())
    texts = ["one word, a word. the word! (a word) größte? größte; größte", "a word's ʼword word́ word² wordж word١ <word>"]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert ids.tolist() == bpe.model.encode(t, add_special_tokens=False).ids
    assert {c for c in bpe.known if c.startswith((" word,", " word.", " word!", " word)", " größte;"))} == set() and {" word", " größte"} <= set(bpe.known)


def test_fingerprints(spark, docs, empty):
    rows = {r.doc_id: r for r in minhash.compare(docs).collect()}
    all_docs = [(i, t or "") for i, t in corpus()]
    s = sets(all_docs, 5)
    errors = []
    for n, (i, t) in enumerate(all_docs):
        j, following = all_docs[(n + 1) % len(all_docs)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        e = sets([(0, edited)], 5)[0]
        true = len(s[i] & e) / len(s[i] | e) if s[i] | e else 1.0
        errors.append(r.near_edited - true)
        assert 0 <= r.near_next <= 1 and abs(r.near_next - (len(s[i] & s[j]) / len(s[i] | s[j]) if s[i] | s[j] else 1.0)) < 0.15
    assert np.sqrt(np.mean(np.square(errors))) < 0.04
    assert rows[104].fingerprint == rows[110].fingerprint == rows[105].fingerprint
    assert minhash.compare(empty).count() == 0
    one = minhash.compare(frame(spark, [(4, "a b c d e f")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    odd = minhash.compare(frame(spark, [(None, "x"), (None, None), (2, "y"), (2, "y")])).collect()
    assert len(odd) == 4
    made = minhash.fingerprints(docs, "print").select("doc_id", "print").collect()
    assert all(r["print"] == rows[r.doc_id].fingerprint for r in made)


def test_densification_fills_every_bin():
    for n in (1, 5, 63, 64, 200, 3000):
        s = np.unique(shingles(np.arange(n + 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 5))
        assert len(minhash.fingerprint(s)) == minhash.BINS * minhash.BITS // 4
        assert minhash.likeness(minhash.fingerprint(s), minhash.fingerprint(s)) == 1
    assert minhash.likeness("", minhash.fingerprint(s)) == 0


def test_lm(spark, docs, empty):
    rows = [(i, t) for i, t in corpus()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [*words_of((t or "").encode()), b""] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    side = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).alias("held_out"))
    for head in (lbl_lm.HEAD, 50):  # with 50, most words take the way of the join
        lbl_lm.HEAD, before = head, lbl_lm.HEAD
        trained = lbl_lm.train(side.filter("not held_out"))
        found = {r.doc_id: r for r in lbl_lm.score(side, trained).collect()}
        lbl_lm.HEAD = before
        for i, ws in tokens.items():
            r = found[i]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[i])
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
            assert r.score < 0
    nothing = lbl_lm.score(side, lbl_lm.train(side.limit(0))).collect()
    assert len(nothing) == len(rows) and all(r.score == 0 == r.base_score for r in nothing)
    none = empty.select("doc_id", "text", F.lit(False).alias("held_out"))
    assert lbl_lm.score(none, trained).count() == 0


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1, (8, 30)).astype(float)
    counts[:4, :10] += 200
    counts[4:, 20:] += 200
    r, q, b = lbl_lm.nce(counts)
    p = np.exp(lbl_lm.log_softmax(r @ q.T + b))
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    assert p[0, :10].sum() > 0.9 and p[7, 20:].sum() > 0.9


def test_toxicity(spark, empty):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        w = words(30, i)
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["rotter", "vilestuff", "vilething"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    df = frame(spark, [*rows, (None, None), (900, ""), (901, "hey you r0tter!"), (902, "word " * 30_000)])
    known = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, known.filter("doc_id < 400"))
    found = {r.doc_id: r.score for r in toxicity.score(df.select("doc_id", "text"), model).collect()}
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == 604
    assert np.mean([(found[i] >= 0.5) == (i % 4 == 0) for i in range(400, 600)]) > 0.95
    assert found[900] < 0.5 and found[902] < 0.5 and found[901] > found[900]
    assert toxicity.train(df, known.limit(0)) == 0.0
    assert toxicity.train(df, known.filter("toxic = 1")) == 1.0
    assert {r.score for r in toxicity.score(df.select("doc_id", "text"), 0.25).collect()} == {0.25}
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert (((boosting.Boosted().fit(x, y).predict(x)) > 0.5) == y).mean() > 0.9
    fitted = boosting.Isotonic().fit(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0])).predict(np.array([1, 2.0, 2.5, 3, 9]))
    assert np.allclose(fitted, [0, 0.5, 0.5, 0.5, 1])


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over trigrams, straight from its definition: a function of context and token."""
    counts = Counter(w for t in texts for w in [*t.encode().split(), b""])
    token = lambda w: w if counts[w] >= 2 or not w else kneser_ney.shape(w)
    tri = Counter()
    for t in texts:
        w = ["<", "<", *(token(x) for x in t.encode().split()), b""]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi = Counter()
    for (_, v, w), n in tri.items():
        bi[v, w] += n if v == "<" else 1
    uni = Counter(w for _, w in bi)

    def level(table, least=1):
        seen = Counter(table.values())
        d = kneser_ney.discounts([seen[k] for k in (1, 2, 3, 4)])
        total, rest = Counter(), Counter()
        for k, n in table.items():
            total[k[:-1]] += n
            rest[k[:-1]] += d[min(n, 3) - 1] if n >= least else n
        return d, total, rest

    d3, total3, rest3 = level(tri, kneser_ney.LEAST_TRIGRAM)
    d2, total2, rest2 = level(bi)
    d1, total1, rest1 = level({(w,): n for w, n in uni.items()})

    def p(u, v, w):
        out = rest1[()] / total1[()] / (len(uni) + 1) + (max(0, uni[w] - d1[min(uni[w], 3) - 1]) / total1[()] if uni[w] else 0)
        if total2[v,]:
            out = rest2[v,] / total2[v,] * out + ((bi[v, w] - d2[min(bi[v, w], 3) - 1]) / total2[v,] if bi[v, w] else 0)
        if total3[u, v]:
            out = rest3[u, v] / total3[u, v] * out + ((tri[u, v, w] - d3[min(tri[u, v, w], 3) - 1]) / total3[u, v] if tri[u, v, w] > 1 else 0)
        return out

    return p, token, list(uni)


@pytest.mark.parametrize("head", [1 << 20, 30])
def test_kneser_ney_is_its_definition(spark, head, monkeypatch):
    """With a small head most n-grams go through the sharded join."""
    monkeypatch.setattr(kneser_ney, "HEAD", head)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the a cat dog sat on mat. ran LOUD!!! x1".split()) for _ in range(rng.randrange(1, 14))) for _ in range(80)] + ["", "once only here"]
    p, token, vocabulary = brute_kneser_ney(texts)
    for u, v in (("<", "<"), ("<", b"the"), (b"the", b"cat"), (b"new", b"words"), (b"cat", b"other")):
        assert sum(p(u, v, w) for w in [*vocabulary, b"unseen"]) == pytest.approx(1)
    others = ["the cat sat on the mat.", "never seen WORDS here", "the the the", None, "a dog ran on x9 LOUD!!!"]
    rows = list(enumerate([*texts, *others]))
    model = kneser_ney.fit(frame(spark, rows[: len(texts)]))
    found = {r.doc_id: r for r in kneser_ney.score(frame(spark, rows), model).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        w = ["<", "<", *(token(x) for x in (t or "").encode().split()), b""]
        want = sum(math.log10(p(*w[k - 2 : k + 1])) for k in range(2, len(w)))
        assert found[i].n_tokens == len(w) - 2 and found[i].log10_mean * (len(w) - 2) == pytest.approx(want, abs=1e-4)


def test_quality(spark, empty):
    rows = [(i, " ".join(words(60, i))) for i in range(900)]
    junk = [(2000 + i, " ".join(w.upper() + "!!" for w in words(60, i))) for i in range(50)]
    df = frame(spark, [*rows, *junk, (None, None), (5000, ""), (5001, "alpha1 " * 20_000)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)] + [(2000, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.keep_good(df, labels)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert kept.columns == df.columns
    # thresholds are the quantiles of what was scored and not fitted on
    scored = kneser_ney.judged(df, labels, trusted=100).collect()
    assert len(scored) == df.count() and all(r.keep is not None for r in scored)
    assert len(ids & set(range(900))) >= 890 and not ids & set(range(2000, 2050))
    assert kneser_ney.keep_good(df, labels.limit(0)).count() == df.count()
    assert kneser_ney.keep_good(empty, labels).count() == 0


def test_quality_of_repeated_words(spark):
    """One word over and over is likely under the model of trusted text, and is no good text all the same."""
    rows = [(i, " ".join(words(60, i))) for i in range(900)]
    again = [(2000 + i, " ".join([words(1, i)[0]] * n)) for i, n in enumerate([20, 40, 60, 80, 200, 2000] * 5)]
    twice = [(2500 + i, " ".join(w for w in words(30, i) for _ in range(2))) for i in range(20)]
    turns = [(3000 + i, " ".join(words(3, i) * 40)) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    kept = kneser_ney.keep_good(frame(spark, [*rows, *again, *twice, *turns, (4000, "alpha1 alpha1"), (4001, rows[0][1])]), labels)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not [i for i in ids if 2000 <= i < 4000] and {4000, 4001} <= ids and len(ids & set(range(900))) >= 890


def test_repeats():
    ids, starts = np.array([0, 1, 0, 0, 0, 0, 1, 1], dtype=np.int32), np.array([0, 2, 7, 8])
    assert kneser_ney.repeats(ids, starts).tolist() == pytest.approx([0, 3 / 5, 0])


def test_lines(spark, docs, empty):
    rows = [(i, f"own {i}\n  Shared   line \n\nown {i} b" if i % 2 else None, "en", f"s{i % 12}" if i % 5 else None, 0) for i in range(60)] + [(99, "Shared line", "en", "s1", 0), (99, "Shared line", "en", "s1", 0), (98, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("n_lines", "cut_lines", "text_hash_1", "h1")})
    found = line_dedup.cut_lines(df)
    assert found.columns[: len(df.columns)] == df.columns
    for r in found.collect():
        if r.doc_id is not None and r.doc_id < 60:
            assert r.text == (f"own {r.doc_id}\n\nown {r.doc_id} b" if r.doc_id % 2 else None)
        assert r.doc_id != 99 or (r.text == "" and r.n_removed == 1)
    assert line_dedup.cut_lines(empty).count() == 0
    assert line_dedup.cut_lines(docs, min_sites=3).count() == docs.count()


def test_near_threshold_is_exact(spark):
    rows = [(i, f"line {k}", "en", f"s{s}", 0) for i, (k, s) in enumerate((k, s) for k in range(1, 40) for s in range(k))]
    lines = line_dedup.lines_of(spark.createDataFrame(rows, DOCS), "source")
    assert line_dedup.boilerplate(lines, 20).count() == 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    step, names = documents, []
    for name, stage in pipeline.STAGES:
        names.append(name)
        out = stage(spark, step, sf)
        if name == "exact_copies":
            want = {}
            for r in step.collect():
                want.setdefault(normal(r.text), []).append(r.doc_id)
            assert sorted(r.doc_id for r in out.collect()) == sorted(min(v) for v in want.values())
        if name == "near_copies":
            want = brute_components([(r.doc_id, r.text) for r in step.collect()], 5, 80)
            assert {r.doc_id for r in out.collect()} == {c for _, c, _ in want.values()}
        if name != "packing":
            assert out.columns == documents.columns
            out = out.checkpoint()
        step = out
    assert len(names) == 5
    assert step.agg(F.sum("length")).first()[0] == step.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_toxicity_features_by_brute_force():
    lexicon = {"vile": 3.0, "rott~": 2.5}
    texts = ["You are VILE, you rotter!", "a v1le thing for your own", "nothing here at all", "", "vile " * 40 + "you", "I said: tu es rotting"]
    found = toxicity.features([t.encode() for t in texts], lexicon)
    for t, x in zip(texts, found, strict=True):
        w = [v.strip(toxicity._EDGE) for v in t.lower().split()]
        plain = [v.translate(toxicity.LOOK_ALIKE) for v in w]
        hit = [max((lexicon.get(k, 0.0) for k in toxicity._keys(v)), default=0.0) or max(lexicon.get(k, 0.0) for k in toxicity._keys(p)) for v, p in zip(w, plain, strict=True)]
        n, places = len(w), [i for i, h in enumerate(hit) if h]
        said = [i for i, v in enumerate(w) if v in toxicity.SECOND_PERSON]
        near = max((1 / (1 + abs(i - j)) for i in places for j in said), default=0.0)
        want = [len(places) / max(n, 1), math.log1p(len(places)), sum(hit) / max(n, 1), max(hit, default=0.0), near, len(said) / max(n, 1)]
        assert x[[0, 1, 2, 4, 5, 6]].tolist() == pytest.approx(want)
        assert x[10] == pytest.approx(sum(c.isupper() for c in t) / max(1, len(t))) and x[13] == pytest.approx(math.log1p(n))


def test_near_copies_of_repeated_ids(spark):
    """The text decides, not the id: unlike texts under one id stay; of equal rows, and of groups without ids, one does."""
    a, b, c = (" ".join(words(60, s)) for s in (301, 302, 303))
    rows = [(1, a), (2, a + " more"), (2, b), (None, c), (None, c + " end"), (3, b + " tail"), (4, ""), (4, ""), (7, None), (5, "solo text of some words"), (5, "solo text of some words"), (1, a)]
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.drop_near_copies(frame(spark, rows), 5, 80).collect()), key=str)
    nulls = {t for i, t in kept if i is None}
    assert len(nulls) == 1 and nulls <= {c, c + " end"}
    assert [x for x in kept if x[0] is not None] == sorted([(1, a), (2, b), (4, ""), (4, ""), (7, None), (5, "solo text of some words")], key=str)


def test_mix_of_repeated_ids(spark):
    """A budget holds over rows that share an id, and rows that are equal in all are taken as often as they are together."""
    rows = [(1, f"one two three four five six seven eight nine t{i}") for i in range(10)] + [(3, "x y z u v w q r s t")] * 9
    df = frame(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("src0")})
    for share in (800, 1500, 1000):
        mixed = mixing.mix(df, share=share, max_epochs=2)
        assert mixed.columns == df.columns
        assert mixed.select(F.sum(mixing.tokens(F.col("text")))).first()[0] == -(-(190 * share // 1000) // 10) * 10  # the last document is taken to its end


def test_pipeline_on_no_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    step = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    columns = step.columns
    for name, stage in pipeline.STAGES:
        step = stage(spark, step, sf).checkpoint()
        assert step.count() == 0 and (name == "packing" or step.columns == columns)


def test_beta_quantiles(spark):
    """The incomplete beta function against a sum over a fine grid, for small and for great parameters."""
    cases = [(a, b, x) for a in (0.06, 0.5, 1.0, 3.7, 40.0, 2600.5, 150_000.0) for b in (0.9, 2.0, 17.3, 7400.0) for x in (0.01, 0.24, 0.5, 0.97)]
    df = spark.createDataFrame(cases, "a double, b double, x double").withColumn("p", url_reputation.beta_below(F.col("a"), F.col("b"), F.col("x")))
    for r in df.collect():
        low, high = -60 / min(r.a, 1) - 10, 60 / min(r.b, 1) + 10
        mid = math.log(r.a / r.b)
        width = 14 * math.sqrt((r.a + r.b) / (r.a * r.b))
        z = np.linspace(max(low, mid - width) if r.a > 30 else low, min(high, mid + width) if r.b > 30 else high, 2_000_001)
        density = -r.a * np.logaddexp(0, -z) - r.b * np.logaddexp(0, z)
        density = np.exp(density - density.max())
        assert r.p == pytest.approx(density[z <= math.log(r.x / (1 - r.x))].sum() / density.sum(), abs=2e-4)


def test_reputations_by_brute_force(spark):
    """Means are shrunk level by level, and a host that is bad for certain is blocked, one that is bad by chance isn't."""
    rng = random.Random(12)
    shares = {f"h{i}.site{i % 7}.{'org' if i % 2 else 'co.uk'}": (0.85 if i % 7 == 3 else 0.15) for i in range(40)}
    rows = [(h, int(rng.random() < p) if rng.random() < 0.8 else None) for h, p in shares.items() for _ in range(rng.choice([2, 30, 90]))]
    found = {r.host: r for r in url_reputation.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}

    def strength(groups):
        groups = [(n, k, mu) for n, k, mu in groups if n]
        n, s = sum(g[0] for g in groups), sum((k - n * mu) ** 2 / n for n, k, mu in groups)
        v, nv = sum(mu * (1 - mu) for _, _, mu in groups), sum(n * mu * (1 - mu) for n, _, mu in groups)
        share = (s - v) / ((n - len(groups)) * nv / n)
        return min(10_000.0, max(1.0, 1 / share - 1)) if share > 0 else 10_000.0

    known = defaultdict(lambda: [0, 0])
    for h, bad in rows:
        known[h][0] += bad is not None
        known[h][1] += bad or 0
    total = [sum(x[i] for x in known.values()) for i in (0, 1)]
    mean = dict.fromkeys(known, total[1] / total[0])
    for level in (lambda h: "co.uk" if h.endswith("uk") else "org", lambda h: h.split(".", 1)[1]):
        groups = {}
        for h, (n, k) in known.items():
            g = groups.setdefault(level(h), [0, 0, mean[h]])
            g[0], g[1] = g[0] + n, g[1] + k
        m = strength(groups.values())
        mean = {h: (groups[level(h)][2] * m + groups[level(h)][1]) / (m + groups[level(h)][0]) for h in known}
    m = strength([(n, k, mean[h]) for h, (n, k) in known.items()])
    for h, (n, k) in known.items():
        assert found[h].mean == pytest.approx((mean[h] * m + k) / (m + n))
        assert (found[h].below < url_reputation.RISK) == (shares[h] > 0.5)


def test_filter_in_shards(spark):
    """400,000 hashes over a bound of 1,024 blocks: repeated ones are found, and under 5 in 100 of the others with them."""
    df = spark.range(400_000).select(F.xxhash64("id").alias("h"), "id").unionByName(spark.range(0, 400_000, 40).select(F.xxhash64("id").alias("h"), "id"))
    df = df.unionByName(spark.range(30_000).select(F.xxhash64(F.lit(7).cast("long")).alias("h"), F.lit(7).cast("long").alias("id"))).withColumn("repeated_hash", F.lit("clash"))
    found = exact_dedup.possibly_repeated(df, "h", "maybe", max_blocks=1024)
    told = found.withColumn("is", (F.col("id") % 40 == 0) | (F.col("id") == 7)).groupBy("is").agg(F.count(F.lit(1)).alias("n"), F.count_if("maybe").alias("maybe")).collect()
    assert found.columns == [*df.columns, "maybe"]
    for r in told:
        assert (r.maybe == r.n) if r["is"] else r.maybe < 0.05 * r.n
    few = exact_dedup.possibly_repeated(df, "h", "maybe", max_blocks=1 << 20).filter("id % 40 <> 0 and id <> 7")
    assert few.filter("maybe").count() < 0.05 * few.count()  # the broadcast filter, too


def test_quality_is_fitted_on_all_trusted_documents(spark, monkeypatch):
    """Of 9,000 trusted documents one half is learned from, whatever its size."""
    df = frame(spark, [(i, "a text") for i in range(9_000)])
    labels = df.select("doc_id", F.lit(1).alias("quality"))
    learned = []
    monkeypatch.setattr(kneser_ney, "fit", lambda texts: learned.append(texts.count()))
    assert kneser_ney.judged(df, labels).count() == 9_000
    assert learned == [df.filter("pmod(xxhash64(doc_id, 9), 2) = 0").count()] and learned[0] > 4_000

def test_near_copies_meet_in_slices(spark):
    """Each key that two sets have is met once, in whichever slice it is."""
    rows = [(k, s) for k in range(-40, 40) for s in range(1 + k % 3)] + [(7, 5), (7, 5)]
    lists = materialise(spark.createDataFrame(rows, "key long, s long"))
    found = sorted(tuple(r) for r in jaccard_join.shared_lists(lists).collect())
    assert found == sorted({(k, s) for k, s in rows if len({b for a, b in rows if a == k}) > 1})


def test_boilerplate_is_no_reason_for_subsets(spark, monkeypatch):
    """Lists are those of shingles that aren't known as frequent, so lines that all texts have don't make them look long."""

    class Found(Exception):
        pass

    def stop(_, list_length, *__):
        raise Found(list_length)

    monkeypatch.setattr(jaccard_join, "CHUNK", 2000)
    monkeypatch.setattr(jaccard_join, "boundary", stop)
    line = " ".join(words(40, 1))
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(100)) + " " + line) for i in range(200)]
    with pytest.raises(Found) as found:
        jaccard_join.jaccard_components(frame(spark, rows))
    assert found.value.args[0] < 0.1  # 1.5 before, and more with each chunk


def test_boundary_scans_sizes_that_can_join():
    sizes = {10 * 2**k: 100 for k in range(12)}
    far = jaccard_join.boundary(sizes, 20.0, 90)
    assert far < jaccard_join.boundary({n: 100 for n in range(1000, 1012)}, 2000.0, 90)
    assert far <= 40  # 320 before: each set scanned lists of all sizes


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_lists_are_split_by_size(spark, percent):
    """Two sets of a list that can join meet once; lists of unlike sizes are gone."""
    rng = random.Random(percent)
    size = {s: rng.choice([rng.randrange(1, 40), rng.randrange(40, 3000), 90, 100, 9000, 10_000]) for s in range(60)}
    rows = [(key, s, size[s]) for key in (-4, 7) for s in size] + [(2, 100, 10), (2, 101, 100), (2, 102, 1000)]
    found = defaultdict(list)
    for r in jaccard_join.by_size(spark.createDataFrame(rows, "key long, s long, size int"), percent).collect():
        found[r.key].append(r)
    met = Counter()
    for key, members in found.items():
        assert any(r.own for r in members) and len(members) > 1
        met.update((key % 2, a.s, b.s) for a in members for b in members if a.s < b.s and (a.own or b.own))
    assert max(met.values()) == 1 and not [s for _, s, _ in met if s >= 100 and percent > 50]
    assert {(odd, a, b) for odd in (0, 1) for a in size for b in size if a < b and percent * max(size[a], size[b]) <= 100 * min(size[a], size[b])} <= set(met)


def test_pairs_share_two_shingles(spark):
    """A single list is no reason to try a pair, a list of two shingles or two lists are."""
    nodes = spark.createDataFrame([(s, 50, [0] * 16) for s in range(6)], "s long, size int, bits array<long>")
    pairs = spark.createDataFrame([(0, 1, 1), (2, 3, 1), (2, 3, 1), (4, 5, 2)], "a long, b long, weight int")
    assert sorted(tuple(r) for r in jaccard_join.possible(pairs, nodes, 90).collect()) == [(2, 3), (4, 5)]


def test_blocks_are_spread_and_tidied_by_work(spark, monkeypatch):
    """A list's comparison is little work on few bytes: no clean-up after each, and no task with all of them."""

    def tidied():
        raise AssertionError("tidied after a small list")

    monkeypatch.setattr(jaccard_join, "tidy", tidied)
    nodes = spark.createDataFrame([(s, 50, [0] * 16) for s in range(40)], "s long, size int, bits array<long>")
    members = spark.createDataFrame([(k, s, 50, True, s, 4) for k in range(10) for s in range(4 * k, 4 * k + 4)], "key long, s long, size int, own boolean, component long, members long")
    found = jaccard_join.block_pairs(members, nodes, 90, False, np.zeros(0, dtype=np.uint64))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for k in range(10) for a in range(4 * k, 4 * k + 4) for b in range(a + 1, 4 * k + 4)}


def test_written_tables_leave_no_shuffle_files(spark):
    """Without waiting for a collection of the driver's garbage; the user's setting stays."""
    from quillspark.llm.common import CLEANUP

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    gc.collect()
    before = set(tracker.shuffleStatuses().keys().mkString(",").split(","))
    made = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert set(tracker.shuffleStatuses().keys().mkString(",").split(",")) <= before | {""}
    assert made.count() == 7 and spark.conf.get(CLEANUP) == "false"


def test_bigrams_stay_where_they_are(spark, docs, monkeypatch):
    """The table of words has a bound of its own, so more of them than SMALL are still broadcast, and slices' texts go after the last slice."""
    plans, write = [], kneser_ney.materialise
    monkeypatch.setattr(kneser_ney, "SMALL", 10)
    monkeypatch.setattr(kneser_ney, "materialise", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert kneser_ney.fit(docs).table.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [p for p in plans if "Join" in p and "MapInArrow" in p and re.search(r"hashpartitioning\(w#\d+L?, ", p)]


def test_repeats_know_their_own_text_only():
    ids, starts = np.array([9, 3, 4, 5, 8, 3, 4, 5], dtype=np.int32), np.array([0, 4, 8])
    whole = kneser_ney.repeats(ids, starts)
    assert whole.tolist() == [0, 0]
    rng = np.random.default_rng(1)
    ids, starts = rng.integers(0, 12, 3000).astype(np.int32), np.arange(0, 3001, 15)
    assert kneser_ney.repeats(ids, starts).tolist() == [kneser_ney.repeats(ids[a : a + 15], np.array([0, 15]))[0] for a in starts[:-1]]


def test_scoring_meets_the_model_in_arrays(spark, docs, monkeypatch):
    """A block of texts asks each shard in one row; no n-gram is a row of a join, and each is found."""
    monkeypatch.setattr(kneser_ney, "HEAD", 0)
    model = kneser_ney.fit(docs)
    rows = model.table.collect()
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows])
    assert len(set(keys.tolist())) == len(keys) and kneser_ney.maybe_known(model.shared.value[3], keys).all()
    assert all(r["shard"] == s for r in rows for s, _ in kneser_ney.dealt(np.frombuffer(r["keys"], dtype=np.uint64), model.shards))
    plans, write = [], kneser_ney.materialise
    monkeypatch.setattr(kneser_ney, "materialise", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    assert kneser_ney.score(docs, model).count() == docs.count()
    assert len(plans) == kneser_ney.SLICES and not [p for p in plans if "Join" in p]


def test_driver_keeps_no_model(spark, monkeypatch):
    """What was broadcast for the scoring is gone with it, and the driver's JVM gives back what it has freed."""
    from quillspark.llm.common import trim_driver

    models, fit = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda texts: (models.append(fit(texts)), models[0])[1])
    rows = frame(spark, [(i, " ".join(words(9, i))) for i in range(40)])
    kept = kneser_ney.judged(rows, rows.select("doc_id", F.lit(1).alias("quality")))
    assert not os.path.exists(models[0].shared._path)
    assert kept.count() == 40
    assert trim_driver(spark).startswith("Trim native heap")
