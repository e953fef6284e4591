"""Language-model scores by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The model predicts a frequent word, or the class of a rare one, from the last common word before it. Classes go by the
last letters of a word, so they are known of unseen words too; within its class a rare word has its smoothed share of the
training counts, and all unseen words of a class share one. So probabilities add up to 1 over the known words and the
unseen one of each class. The model is trained on counts of (context, outcome) over all training tokens. The expectation
over noise is taken exactly (all outcomes weighed by their probability) instead of drawn, so training is deterministic.
Batched matrix products over all outcomes normalise the probabilities.

Words are counted by 64-bit hash. Executors get the counts of the ``HEAD`` most frequent words (16 MB); counts of all
others are met by a join of the (few) tokens that are not among them. What comes to the driver is bounded: those counts
and ``(CONTEXTS + 1) * (WORDS + CLASSES)`` pair counts.

Nulls: a null text is empty and has just the end token; a null doc_id counts as training. Repeated rows are counted and
scored each. Without training tokens both scores are 0. Texts are taken whole; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, fold, hashes, materialise, read_table, small_batches, word_ids

HEAD = 1 << 20
WORDS = 4096
CONTEXTS = 512
CLASSES = 256
SIZE = 32
NOISE = 25
STEPS = 150
#: Weight of the prior that holds vectors near 0, in tokens.
PRIOR = 15.0
#: Distinct words that a task sums up before it hands them on.
HELD = 2_000_000


def _pack(batches: Iterator[pa.RecordBatch], texts_to_counts) -> Iterator[pa.RecordBatch]:
    """Sums (key, n) over blocks in a task, handing them on whenever many are held."""
    keys, counts, size = [], [], 0

    def out():
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, np.concatenate(counts)).astype(np.int64))], names=["key", "n"])

    for _, texts in blocks(batches):
        key, n = texts_to_counts(texts)
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size >= HELD:
            yield out()
            keys, counts, size = [], [], 0
    if size:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): each distinct token's hash and count."""

    def count(part: list[bytes]):
        words, ids, _ = word_ids(part, end=True)
        return keyed(words), np.bincount(ids, minlength=len(words))

    return small_batches(texts.select("text")).mapInArrow(lambda b: _pack(b, count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def ending(words: list[bytes]) -> np.ndarray:
    """The class of each word, by its last three bytes."""
    crc = zlib.crc32
    return np.fromiter((crc(w[-3:]) % CLASSES for w in words), dtype=np.int64, count=len(words))


def keyed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes whose low bits are the class of the word."""
    return (hashes(words) & ~np.uint64(CLASSES - 1)) | ending(words).astype(np.uint64)


class Head:
    """Counts and ranks of the most frequent words, by hash."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.lexsort((key, -n))
        end = keyed([b""]).view(np.int64)[0]
        order = np.concatenate([order[key[order] == end], order[key[order] != end]])  # the end token is always among the words
        rank = np.empty(len(key), dtype=np.int64)
        rank[order] = np.arange(len(key))
        by_key = np.argsort(key)
        self.key, self.n, self.rank = key[by_key], n[by_key], rank[by_key]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether words are here, their counts (else 0) and their outcomes: ranks, or classes after them."""
        key = key.view(np.int64)
        rare = WORDS + (key & (CLASSES - 1))
        if not len(self.key):
            return np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=np.int64), rare
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[at] == key
        often = there & (self.rank[at] < WORDS)
        return there, np.where(there, self.n[at], 0), np.where(often, self.rank[at], rare)


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the last common word before it in its text, CONTEXTS if there is none."""
    if not len(tokens):
        return tokens
    last = np.maximum.accumulate(np.where(tokens < CONTEXTS, np.arange(len(tokens)), -1))
    last = np.concatenate([[-1], last[:-1]])
    begin = np.repeat(starts[:-1], np.diff(starts))
    return np.where(last >= begin, tokens[np.maximum(last, 0)], CONTEXTS)


def nce(counts: np.ndarray, steps: int = STEPS, seed: int = 0):
    """(context vectors, outcome vectors, biases) from counts[context, outcome], by noise-contrastive estimation with Adam.

    An outcome's score in a context is the product of their vectors plus the outcome's bias.
    """
    rng = np.random.default_rng(seed)
    n = counts.sum()
    p = (counts.sum(0) + 0.5) / (n + 0.5 * counts.shape[1])
    row = (counts.sum(1) / n).astype(np.float32)[:, None]
    counts = (counts / n).astype(np.float32)
    noise = (NOISE * row) * p.astype(np.float32)
    shift = np.log(NOISE * p).astype(np.float32)
    r, q, b = params = [rng.normal(0, 0.1, (counts.shape[0], SIZE)).astype(np.float32), rng.normal(0, 0.1, (counts.shape[1], SIZE)).astype(np.float32), np.log(p).astype(np.float32)]
    start = b.copy()
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(np.clip(shift - b - r @ q.T, -30, 30)))  # the chance that it is data, not noise
        g = counts - (counts + noise) * s
        slopes = g @ q - PRIOR / n * r, g.T @ r - PRIOR / n * q, g.sum(0) - PRIOR / n * (b - start)
        for x, m, u, d in zip(params, mean, square, slopes, strict=True):
            m += 0.1 * (d - m)
            u += 0.01 * (d * d - u)
            x += 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.99**t)) + 1e-12)
    return r, q, b


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


class Model:
    """Head counts, log10 probabilities [context, outcome], and for each class the log10 of its smoothed total."""

    def __init__(self, head: Head, pairs: np.ndarray, totals: np.ndarray):
        self.head = head
        r, q, b = nce(pairs)
        self.outcomes = (log_softmax(r @ q.T + b) / np.log(10)).astype(np.float32)
        self.totals = np.concatenate([np.zeros(WORDS), np.log10(totals)])

    def log10(self, outcomes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each token, without the log10 of the smoothed count of a rare word."""
        tokens = outcomes[ids]
        return self.outcomes[contexts(tokens, starts), tokens] - self.totals[tokens]


def train(texts: DataFrame):
    """(model or None, counts as a table, total, distinct) of the training texts."""
    spark = texts.sparkSession
    counts = materialise(word_counts(texts))
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return None, counts, 0, 0
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # under 1024 rows
    held, least = 0, 1 << 30
    for v, words in levels:
        held += words
        if held > HEAD:
            break
        least = v
    top = counts.filter(level >= least).toArrow()
    head = Head(top["key"].to_numpy(), top["n"].to_numpy())
    shared = spark.sparkContext.broadcast(head)
    outcomes = WORDS + CLASSES

    def pair_counts(part: list[bytes]):
        words, ids, starts = word_ids(part, end=True)
        tokens = shared.value.find(keyed(words))[2][ids]
        return np.unique(contexts(tokens, starts) * outcomes + tokens, return_counts=True)

    cells = texts.select("text").mapInArrow(lambda b: _pack(b, pair_counts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most (CONTEXTS + 1) * outcomes
    pairs = np.zeros((CONTEXTS + 1) * outcomes)
    pairs[cells["key"].to_numpy()] = cells["n"].to_numpy()
    # of each class: tokens and distinct words that are rare
    totals = np.zeros(CLASSES)
    for r in counts.groupBy(F.col("key").bitwiseAND(CLASSES - 1).alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        totals[r.g] = r.n + 0.5 * r.words
    often = head.rank < WORDS
    totals -= np.bincount(head.key[often] & (CLASSES - 1), head.n[often] + 0.5, CLASSES)
    return Model(head, pairs.reshape(CONTEXTS + 1, outcomes), totals + 0.5), counts, total, distinct


def score(docs: DataFrame, trained) -> DataFrame:
    """docs: doc_id, text, held_out. Adds n_tokens, n_known, train_tokens, base_score and score."""
    model, counts, total, distinct = trained
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = float(total + 0.5 * (distinct + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "key", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        model = shared.value
        for block, texts in blocks(batches):
            n = len(texts)
            words, ids, starts = word_ids(texts, end=True)
            key = keyed(words)
            sizes = np.diff(starts)
            rows = row + np.arange(n)
            row += n
            if model is None:
                known, first, second, missing = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n), np.zeros(0, dtype=np.int64)
            else:
                there, c, outcomes = model.head.find(key)
                # a word that is not in the head gets the log10 of its smoothed count later
                count = np.where(there, np.log10(c + 0.5), 0.0)
                known = np.add.reduceat(there[ids].astype(np.int64), starts[:-1])
                first = np.add.reduceat((count - np.log10(base))[ids], starts[:-1])
                rare = np.where(outcomes < WORDS, 0.0, count)
                second = np.add.reduceat(model.log10(outcomes, ids, starts) + rare[ids], starts[:-1])
                missing = np.flatnonzero(~there[ids])
            none = np.zeros(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), block.column(0), block.column(2), *map(pa.array, (sizes, known, first, second, none, none))], names=names)
            if len(missing):
                pair, times = np.unique((np.searchsorted(starts, missing, "right") - 1) * len(words) + ids[missing], return_counts=True)
                m = len(pair)
                zero, zeros = np.zeros(m, dtype=np.int64), np.zeros(m)
                yield pa.RecordBatch.from_arrays([pa.array(rows[pair // len(words)]), pa.nulls(m, block.schema.field(0).type), pa.nulls(m, pa.bool_()), pa.array(zero), pa.array(zero), pa.array(zeros), pa.array(zeros), pa.array(key[pair % len(words)].view(np.int64)), pa.array(times)], names=names)

    whole = materialise(small_batches(docs.select("doc_id", "text", "held_out")).mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, key long, times long"))
    # tokens that are not among the most frequent words: their counts come by a join, 0 if there are none
    rest = whole.filter("times > 0").select("row", "key", "times").join(counts, "key", "left")
    c = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"))
    out = whole.filter("times = 0").join(rest, "row", "left")
    known, more = F.col("n_known") + F.coalesce("more_known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id")) % 5 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score(docs, train(docs.filter("not held_out")))
