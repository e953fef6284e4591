"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features of a text: density, sum and greatest weight of lexicon words, hits only after undoing obfuscation, closeness of
hits to second-person words, rates of capitals, punctuation, digits and symbols inside words, single letters, length.

The lexicon is learnt: words and word beginnings that are much more frequent in labelled toxic texts. It, the trees and
the calibration are fitted on at most ``sample`` labelled rows (those with the least hashes of their ids), with rows held
out by the caller left aside. Lexica of one half serve for the features of the other, so the trees see honest densities.

Nulls: a null text is an empty one. Texts without words get the score of their (zero) features. Rows without a label are
never learnt from; repeated labels of a document count once (toxic if any says so). A null doc_id counts as held out.
Without labelled rows of both kinds every score is their rate of toxic ones (0 if there are none). Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.boosting import Boosted, Isotonic
from quillspark.llm.common import blocks, fold, read_table, small_batches, word_ids

#: Bounds of what is learnt from.
SAMPLE = 20_000
LEXICON = 20_000
LEAST_TEXTS = 5
LEAST_WEIGHT = 2.5
PREFIXES = (4, 5, 6)

#: Words that address someone, of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos tú ti usted ustedes vosotros tus".split())
#: Look-alikes of letters.
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasil")
_EDGE = ".,;:!?\"'()[]{}<>*#%&$|~^_=+-/\\…¡¿«»“”‘’"
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "!?"]] = 2
_CLASS[[ord(c) for c in ".,;:\"'()-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[[ord(c) for c in "0123456789"]] = 5


def _keys(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def _plain(word: str) -> str:
    """The word with look-alikes turned to letters and symbols inside it left out; "" if that changes nothing."""
    found = "".join(c for c in word.translate(LOOK_ALIKE) if c.isalpha())
    return "" if found == word or len(found) < 3 else found


def features(texts: list[bytes], lexicon: dict[str, float]) -> np.ndarray:
    """A row of 14 numbers for each text."""
    words, ids, starts = word_ids(texts)
    n = np.diff(starts)
    weight, hidden = np.zeros(len(words)), np.zeros(len(words))
    flags = np.zeros((4, len(words)))  # second person, digit inside, symbol inside, one letter
    for i, w in enumerate(words):
        raw = w.decode()
        key = raw.strip(_EDGE)
        weight[i] = max(map(lexicon.get, _keys(key), [0.0] * 4), default=0.0) if key else 0.0
        flags[0, i] = key in SECOND_PERSON
        flags[3, i] = len(key) == 1
        if not key.isalpha() and key:
            flags[1, i] = any(c.isdigit() for c in key) and any(c.isalpha() for c in key)
            flags[2, i] = any(not c.isalnum() for c in key)
            if not weight[i] and (plain := _plain(raw)):
                hidden[i] = max(map(lexicon.get, _keys(plain), [0.0] * 4))

    def total(x):
        return np.diff(np.concatenate([[0.0], np.cumsum(x[ids])])[starts])

    out = np.zeros((len(texts), 14))
    per = 1 / np.maximum(n, 1)
    both = np.maximum(weight, hidden)
    hits = total(both > 0)
    out[:, 0], out[:, 1], out[:, 2] = hits * per, np.log1p(hits), total(both) * per
    out[:, 3] = total(hidden > 0) * per
    at = np.flatnonzero(both[ids] > 0)
    where = np.searchsorted(starts, at, "right") - 1
    np.maximum.at(out[:, 4], where, both[ids][at])
    second = np.flatnonzero(flags[0][ids] > 0)
    if len(second) and len(at):
        k = np.searchsorted(second, at)
        for near in (second[np.minimum(k, len(second) - 1)], second[np.maximum(k - 1, 0)]):
            same = np.searchsorted(starts, near, "right") - 1 == where
            np.maximum.at(out[:, 5], where[same], 1 / (1 + np.abs(near - at)[same]))
    out[:, 6] = total(flags[0]) * per
    out[:, 7:10] = np.stack([total(f) * per for f in flags[1:]], axis=1)
    for i, t in enumerate(texts):
        c = np.bincount(_CLASS[np.frombuffer(t, dtype=np.uint8)], minlength=6) / max(1, len(t))
        out[i, 10:13] = c[1], c[2], c[3] + c[4]
    out[:, 13] = np.log1p(n)
    return out


def _lexicon(counts: list, fold_no: int | None, size: dict[tuple[int, int], int]) -> dict[str, float]:
    """Log odds of words and beginnings, those above the least weight, from rows (key, fold, toxic texts, others)."""
    pos, neg = Counter(), Counter()
    for r in counts:
        if fold_no is None or r.half == fold_no:
            pos[r.key] += r.pos
            neg[r.key] += r.neg
    halves = (0, 1) if fold_no is None else (fold_no,)
    p, n = (sum(size.get((h, y), 0) for h in halves) for y in (1, 0))
    found = {k: float(np.log((v + 0.5) / (p + 1)) - np.log((neg[k] + 0.5) / (n + 1))) for k, v in pos.items() if v >= LEAST_TEXTS}
    found = {k: w for k, w in found.items() if w >= LEAST_WEIGHT}
    return dict(sorted(found.items(), key=lambda x: (-x[1] * np.log1p(pos[x[0]]), x[0]))[:LEXICON])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE):
    """(lexicon, trees, calibration), or the rate of label 1 if there aren't rows of both kinds. labels: rows to learn from."""
    spark = docs.sparkSession
    known = labels.filter(f"{label} is not null and doc_id is not null").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [(r.doc_id, r.y) for r in known.collect()]  # at most ``sample``
    sides = spark.createDataFrame(rows, "doc_id long, y int") if rows else spark.createDataFrame([], "doc_id long, y int")
    taken = docs.select("doc_id", "text").join(F.broadcast(sides), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in blocks(batches):
            pos, neg = Counter(), Counter()
            for t, y, half in zip(texts, block.column("y").to_pylist(), block.column("half").to_pylist(), strict=True):
                own = {k for w in set(t.lower().split()) if (key := w.decode().strip(_EDGE)) for k in _keys(key)}
                (pos if y else neg).update((k, half) for k in own)
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([h for _, h in keys], pa.int32()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["key", "half", "pos", "neg"])

    size = {(r.half, r.y): r.n for r in taken.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, n = sum(v for (_, y), v in size.items() if y), sum(size.values())
    if not positive or positive == n:
        return positive / n if n else 0.0
    counts = small_batches(taken).mapInArrow(count, "key string, half int, pos long, neg long").groupBy("key", "half").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # candidates only: keys of enough toxic texts that are at least as often toxic as not
    counts = counts.withColumn("all_pos", F.sum("pos").over(Window.partitionBy("key"))).filter(f"all_pos >= {LEAST_TEXTS}").filter("pos > 0 or neg > 0").collect()
    halves = [_lexicon(counts, h, size) for h in (1, 0)]  # half 0 is seen with the lexicon of half 1
    lexicon = _lexicon(counts, None, size)
    shared = spark.sparkContext.broadcast(halves)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in blocks(batches):
            half = np.array(block.column("half").to_pylist())
            x = np.where(half[:, None] == 0, features(texts, shared.value[0]), features(texts, shared.value[1]))
            yield pa.RecordBatch.from_arrays([block.column("y"), block.column("half"), pa.array(list(x))], names=["y", "half", "x"])

    seen = taken.mapInArrow(describe, "y int, half int, x array<double>").toPandas()
    x, y, half = np.stack(seen["x"]), seen["y"].to_numpy(float), seen["half"].to_numpy()
    order = np.lexsort((*x.T, y))
    x, y, half = x[order], y[order], half[order]
    guess = np.full(len(y), y.mean())
    for h in (0, 1):
        if (half != h).any() and len(np.unique(y[half != h])) == 2 and (half == h).any():
            guess[half == h] = Boosted().fit(x[half != h], y[half != h]).predict(x[half == h])
    return lexicon, Boosted().fit(x, y), Isotonic().fit(guess, y)


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` (doc_id, text and flags) with the score in a column ``score``; all but text is kept."""
    if isinstance(model, float | int):
        return docs.drop("text").withColumn("score", F.lit(float(model)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, trees, calibration = shared.value
        for block, texts in blocks(batches):
            raw = trees.predict(features(texts, lexicon))
            p = 0.999 * calibration.predict(raw) + 0.001 * raw  # the trees order what calibration holds equal
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), pa.array(p, pa.float64())], names=[*names, "score"])

    kinds = dict(docs.dtypes)
    return small_batches(docs).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold(F.col("doc_id")) % 5 != 0))
    held_out = F.coalesce(fold(F.col("doc_id")) % 5 == 0, F.lit(True))
    scored = score(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
