"""Learned abbreviations against the formulas by hand, and the sentences that come of them."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.operators import segmenter as S
from quillspark.operators import windows


def corpus():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("walk", "house", "river", "green", "market", "winter") for b in ("er", "ing", "s", "ed", "al")]
    names = ["Smith", "Brown", "Jones"]
    out = []
    for i in range(80):
        parts = []
        for _ in range(12):
            w = [rng.choice(words) for _ in range(rng.randrange(4, 9))]
            w[0] = rng.choice(["The", "The", "They"])
            if rng.random() < 0.4:
                w[2:2] = [rng.choice(["Dr.", "dr.", "e.g.", "Mr."]), rng.choice(names)]
            if rng.random() < 0.1:
                w.append("etc.")
                parts.append(" ".join(w))
                continue
            if rng.random() < 0.2:
                w[3:3] = ["J.", "Smith"]
            parts.append(" ".join(w) + rng.choice(".....!?"))
        out.append((i, " ".join(parts)))
    return out + [(100, None), (101, ""), (102, "... !! ."), (103, "Dr. Brown met Mr. Jones. (The \"house\".) The river ended etc. The market walked, e.g. winters."), (104, "They met J. Smith there.\x01 The end is near now."), (104, "They met J. Smith there.\x01 The end is near now.")]


def bare(t):
    return re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9.]+$", "", t).lower()


def word(t):
    return re.sub(r"\.$", "", bare(t))


def by_hand():
    n, dots, after, total = Counter(), Counter(), Counter(), 0
    for _, text in corpus():
        tokens = [t for t in (text or "").split() if re.search("[A-Za-z0-9]", t)]
        for i, t in enumerate(tokens):
            n[word(t)] += 1
            total += 1
            if bare(t).endswith("."):
                dots[word(t)] += 1
                if i + 1 < len(tokens):
                    after[word(t), word(tokens[i + 1])] += 1
    p = sum(dots.values()) / total
    short = {}
    for w, d in dots.items():
        plain, letters = n[w] - d, len(w.replace(".", ""))
        ll = -2 * (d * math.log(p) + plain * math.log(1 - p) - d * math.log(0.99) - plain * math.log(0.01))
        score = ll * math.exp(-letters) * (w.count(".") + 1) * letters ** (-plain)
        if score >= 0.3:
            short[w] = score

    def ratio(k, a, b):
        if total <= a or k / a <= b / total:
            return 0.0
        f = lambda k, m, x: (k * math.log(x) if k else 0) + ((m - k) * math.log(1 - x) if m - k else 0)
        return 2 * (f(k, a, k / a) + f(b - k, total - a, (b - k) / (total - a)) - f(k, a, b / total) - f(b - k, total - a, b / total))

    pairs = {(w, v): ratio(k, dots[w], n[v]) for (w, v), k in after.items() if k > 1 and (w in short or re.fullmatch(r"[a-z]|\d+", w))}
    breaks = Counter()
    for (w, v), k in after.items():
        if w not in short:
            breaks[v] += k
    starts = {v: ratio(k, sum(breaks.values()), n[v]) for v, k in breaks.items()}
    starts = {v: s for v, s in starts.items() if s >= 30}
    return short, {x: s for x, s in pairs.items() if s >= 7.88 and x[1] not in starts}, starts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


@pytest.fixture(scope="module")
def learned(docs):
    return S.learn(docs)


def test_counts_and_ratios(learned):
    short, pairs, starts = by_hand()
    assert {"dr", "mr", "etc", "e.g"} <= set(short) and ("j", "smith") in pairs and "the" in starts
    assert {r.word: r.score for r in learned.abbreviations.collect()} == pytest.approx(short)
    assert {(r.word, r.next): r.score for r in learned.collocations.collect()} == pytest.approx(pairs)
    assert {r.word: r.score for r in learned.starters.collect()} == pytest.approx(starts)


def test_sentences(docs, learned, monkeypatch):
    for small in (S.SMALL, 0):  # broadcast, and by shuffled joins
        monkeypatch.setattr(S, "SMALL", small)
        found = S.sentences(docs, learned, least=1).orderBy("doc_id", "pos").collect()
        one = [r.text for r in found if r.doc_id == 103]
        assert one == ["Dr. Brown met Mr. Jones.", '(The "house".) The river ended etc.', "The market walked, e.g. winters."]
        assert [r.text for r in found if r.doc_id == 104][:1] == ["They met J. Smith there.\x01 The end is near now."]
        assert [r.pos for r in found if r.doc_id == 5] == list(range(sum(r.doc_id == 5 for r in found)))
    plain = windows.split_sentences(docs, 1).filter("doc_id < 100").count()
    assert sum(r.doc_id < 100 for r in found) < plain
    for doc_id, text in corpus()[:80]:
        assert " ".join(r.text for r in found if r.doc_id == doc_id) == text  # nothing is lost


def test_no_texts(docs):
    none = S.learn(docs.limit(0))
    assert none.abbreviations.count() == none.collocations.count() == none.starters.count() == 0
    assert S.sentences(docs, none, least=1).count() == windows.split_sentences(docs, 1).count()
