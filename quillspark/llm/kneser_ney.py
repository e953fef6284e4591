"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on all trusted documents of one half by hash, and those of the other half set the thresholds. Words seen twice are kept; all others become the shape of their
letters, digits and signs, so that shouting or decorated words stay unlikely.

Counts stay sharded on the executors, from the words to the probabilities: n-grams are grouped by key, and discounts,
continuation counts and back-off weights are aggregations and joins of these tables. Trigrams are counted in ``SLICES`` by
their second token, one after the other, so that the disk holds one slice's shuffle: all trigrams of a context or around a
bigram are in one slice. Documents meet the model in as many parts, for the same reason. In back-off form the log10
probability of a text is a sum over its n-grams: each adds what it changes against its shorter ones, and n-grams that the
model does not have add nothing. So a text's score is a join of its n-grams with one table (key, delta), summed by text.

That join is narrowed on the map side by two arrays of fixed size, whatever the model's: up to ``HEAD`` frequent
n-grams are summed at once, and a Bloom filter of 2^26 bits leaves out n-grams that the model does not have. What remains
(rare n-grams of the model) goes to its shard of the counts, a range of keys: a block of texts sends each shard one row
with all its n-grams there as an array, and gets back what they add to each text. The model is written as such arrays once,
and a task holds one shard of it, of some ``SHARD`` n-grams. As is usual, trigrams seen once are not in the model; their
counts go to what their context leaves to bigrams.

A document's deviation is its mean log10 probability a token less its language's median, over its spread by chance, so
that short texts may vary more. It is rejected below a low quantile (of perplexity: above a high one) of the trusted
documents of its language that the model was not fitted on, widened by ``margin``. Languages with fewer than ``least`` of
these use those of all. Low perplexity is no ground: copies of trusted text have it.

Text that says the same again and again is likely under any model, so it is judged by itself: a document's repeats are the
share of its tokens that equal the one before, or end a trigram (of whole words) that it had before. It is rejected above
a high quantile of the same trusted documents, widened by ``margin``, but never at up to ``REPEATS`` or at two tokens.

Nulls: a null text is empty and has just the end token; a null language is that of the empty name; documents with a null
id are scored but never trusted. Repeated rows are scored alike. Without trusted documents everything is kept. Texts are
read whole; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, discard, forget, free_name, hashes, materialise, mix, partitions, read_table, small_batches, tidy, word_ids

#: Parts in which trigrams are counted and documents are scored; all of them are.
SLICES = 4
LEAST_SEEN = 2
#: Trigrams seen less often are left to bigrams.
LEAST_TRIGRAM = 2
#: Words that are told apart at most; those seen least become shapes beyond it.
WORDS = 1 << 20
#: Frequent n-grams, the slots they are looked up in, and 64-bit blocks of the Bloom filter.
HEAD, SLOTS, BLOOM = 1 << 20, 1 << 21, 1 << 20
#: N-grams of the model that a task holds in scoring, more or less, and rows that are dealt to shards at once.
SHARD, DEALT = 1 << 20, 1 << 20
QUANTILE = 0.002
MARGIN = 1.4
#: Texts differ among themselves as the means of so many tokens do by chance.
OWN = 300
LEAST = 200
#: The bound on repeats is this at least.
REPEATS = 0.1
#: Rows that may be broadcast: some 20 MB as the driver holds them, for each of a few joins.
SMALL = 300_000

_SHAPE = bytes(ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else ord("p") if chr(c) in ".,;:'\"()-" else ord("s") for c in range(256))
_START = hashes([b"\1"])[0]


def shape(word: bytes) -> bytes:
    """Classes of a word's bytes, runs cut to two: b"XXss" of b"LOUD!!!"."""
    out = bytearray()
    for c in word.translate(_SHAPE):
        if out[-2:] != bytes([c, c]):
            out.append(c)
    return b"\0" + bytes(out)


_shapes: dict[bytes, int] = {}


def shape_hashes(words: list[bytes]) -> np.ndarray:
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        s = w.translate(_SHAPE)
        v = _shapes.get(s)
        if v is None:
            v = int(hashes([shape(w)])[0])
            if len(_shapes) < 100_000:
                _shapes[s] = v
        out[i] = v
    return out


def tokens(words: list[bytes], known: np.ndarray) -> np.ndarray:
    """The token of each word: its hash if known (the end, the empty word, always is), else that of its shape."""
    out = hashes(words)
    there = known[np.minimum(np.searchsorted(known, out), len(known) - 1)] == out if len(known) else np.zeros(len(out), dtype=bool)
    rare = [i for i in np.flatnonzero(~there) if words[i]]
    out[rare] = shape_hashes([words[i] for i in rare])
    return out


def _two(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) + second)


def _three(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    return mix(pair + mix(third ^ np.uint64(0x5EED)))


_START_2 = _two(np.array([_START]), np.array([_START]))[0]


def n_grams(token: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the one before it, and the keys of the bigram that it ends, of the bigram before that, and of the trigram."""
    one = np.concatenate([[_START], token[:-1]]).astype(np.uint64)
    one[starts[:-1]] = _START
    pair = _two(one, token)
    before = np.concatenate([[_START_2], pair[:-1]]).astype(np.uint64)
    before[starts[:-1]] = _START_2
    return one, pair, before, _three(before, token)


def repeats(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, the share of its tokens that equal the one before or end a trigram which the text had before."""
    n = np.diff(starts)
    text = np.repeat(np.arange(len(n)), n)
    word = ids.astype(np.int64) + 1
    one, two = np.concatenate([[0], word[:-1]]), np.concatenate([[0, 0], word[:-2]])[: len(word)]
    one[starts[:-1]] = two[starts[:-1]] = 0
    second = starts[:-1] + 1
    two[second[second < starts[1:]]] = 0
    key = mix(text.astype(np.uint64))  # not the bare number, or another text with a nearby word would have the same sum
    for part in (two, one, word):
        key = mix(key + part.astype(np.uint64))
    first = np.unique(key, return_index=True)[1]
    first = first[word[first] != one[first]]
    return 1 - np.bincount(text[first], minlength=len(n)) / n


def discounts(n: list[int]) -> list[float]:
    """What is taken from counts of 1, 2, and 3 or more, from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    y = n[0] / max(1.0, n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * (k + 1) for k in range(3)]
    return [min(max(x, 0.05), most) for x, most in zip(d, (0.95, 1.9, 2.85), strict=True)]


def _seen(rows: DataFrame, count: str) -> np.ndarray:
    """How many rows have a count of 1, 2, 3 and 4."""
    return np.array([x or 0 for x in rows.agg(*[F.count_if(F.col(count) == k) for k in (1, 2, 3, 4)]).first()])


def _discount(seen: np.ndarray, count: str) -> Column:
    """The discount of a row's count."""
    one, two, more = discounts(seen.tolist())
    return F.when(F.col(count) == 1, one).when(F.col(count) == 2, two).otherwise(more)


def _signed(x) -> int:
    return int(np.uint64(x).view(np.int64))


def keyed(rows: DataFrame, before: str) -> DataFrame:
    """(key, delta, n) of rows with these two, w and ``before``: v of a bigram, c of a trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, token = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            key = _two(first, token) if before == "v" else _three(first, token)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(2), b.column(3)], names=["key", "delta", "n"])

    return rows.select(before, "w", F.col("delta").cast("float").alias("delta"), "n").mapInArrow(run, "key long, delta float, n long")


def deltas(slices: Iterable[DataFrame]) -> tuple[DataFrame, float, float]:
    """((key, delta, n), the log10 of an unseen word's probability, what each text adds at its start).

    slices: written tables of c, v, w (key of the bigram that begins a trigram, and its last two tokens) and n; all of one v
    are in one slice. Each is deleted before the next one is made.
    """
    seen, contexts, often, both = np.zeros(4, dtype=np.int64), [], [], []
    for grams in slices:
        seen += _seen(grams, "n")
        classes = [F.count_if(F.col("n") == 1).alias("n_1"), F.count_if(F.col("n") == 2).alias("n_2"), F.count_if(F.col("n") > 2).alias("n_3")]
        contexts.append(materialise(grams.groupBy("c").agg(*classes, F.sum("n").alias("total3"), F.max("n").alias("most")).filter(F.col("most") >= LEAST_TRIGRAM).drop("most")))
        # bigrams count the distinct tokens before them; those at a text's start have none, and count themselves
        kinds = F.when(F.col("v") == _signed(_START), F.sum("n")).otherwise(F.count(F.lit(1)))
        pairs = materialise(grams.groupBy("v", "w").agg(kinds.alias("kinds"), F.sum("n").alias("n")))
        threes = bounded(grams.filter(F.col("n") >= LEAST_TRIGRAM))
        often.append(materialise(pairs.filter(F.col("n") >= LEAST_TRIGRAM).select("v", "w", "kinds").join(threes, ["v", "w"])))
        both.append(pairs)
        discard(grams, threes)
    contexts, pairs = (reduce(DataFrame.unionByName, x) for x in (contexts, both))
    taken = [d if k >= LEAST_TRIGRAM else k for k, d in enumerate(discounts(seen.tolist()), 1)]
    left = sum(F.col(f"n_{k}") * d for k, d in enumerate(taken, 1)) / F.col("total3")
    after_two = bounded(contexts.select("c", left.alias("rest3"), "total3"))
    d2, d3 = _discount(_seen(pairs, "kinds"), "kinds"), _discount(seen, "n")
    ones = materialise(pairs.groupBy("w").agg(F.count(F.lit(1)).alias("seen"), F.sum("n").alias("n")))
    ones = ones.withColumn("d", _discount(_seen(ones, "seen"), "seen"))
    sums = ones.agg(F.sum("seen").alias("seen"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("words")).first()
    unseen = sums["d"] / sums["seen"] / (sums["words"] + 1)
    # a row for each word that is told apart and each shape, at any size of the input, so bigrams need not move to meet them
    ones = bounded(ones.select("w", F.col("n").alias("n1"), ((F.col("seen") - F.col("d")) / sums["seen"] + unseen).alias("p1")), WORDS + SMALL)
    p2 = (F.col("kinds") - d2) / F.col("total2") + F.col("rest2") * F.col("p1")

    p3 = (F.col("n") - d3) / F.col("total3") + F.col("rest3") * F.col("p2")
    onward = F.coalesce(F.log10("rest3"), F.lit(0.0))
    delta, firsts = [], []
    for pairs, threes in zip(both, often, strict=True):
        after_one = bounded(pairs.groupBy("v").agg((F.sum(d2) / F.sum("kinds")).alias("rest2"), F.sum("kinds").alias("total2")))
        twos, threes_2 = (x.join(after_one, "v").join(ones.select("w", "p1"), "w").withColumn("p2", p2) for x in (pairs, threes.join(after_two, "c")))
        twos = keyed(twos.withColumn("delta", F.log10("p2") - F.log10("rest2") - F.log10("p1")), "v")
        twos = twos.join(after_two.select(F.col("c").alias("key"), "rest3"), "key", "left").select("key", (F.col("delta") + onward).cast("float").alias("delta"), "n")
        delta += [materialise(twos), materialise(keyed(threes_2.withColumn("delta", F.log10(p3) - F.log10("rest3") - F.log10("p2")), "c"))]
        firsts.append(after_one)
        discard(pairs, threes)
    after_one = reduce(DataFrame.unionByName, firsts)
    each = ones.join(after_one.withColumnRenamed("v", "w"), "w", "left")
    each = each.select(F.col("w").alias("key"), (F.log10("p1") - float(np.log10(unseen)) + F.coalesce(F.log10("rest2"), F.lit(0.0))).cast("float").alias("delta"), F.col("n1").alias("n"))
    start = after_one.filter(F.col("v") == _signed(_START)).select(F.log10("rest2").alias("x")).unionAll(after_two.filter(F.col("c") == _signed(_START_2)).select(F.log10("rest3")))
    at_start = float(start.agg(F.sum("x")).first()[0] or 0.0)
    delta.append(materialise(each))
    discard(contexts, after_two, ones, *firsts)
    return reduce(DataFrame.unionByName, delta), float(np.log10(unseen)), at_start


def bounded(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows, written; marked for a broadcast if there are at most ``most`` (SMALL) of them."""
    rows = materialise(rows)
    return F.broadcast(rows) if rows.count() <= (SMALL if most is None else most) else rows


class Model(NamedTuple):
    """shared: a broadcast of known words, head keys and deltas, and the Bloom filter. table: (shard, keys, deltas), sorted arrays."""

    shared: object
    table: DataFrame
    shards: int
    unseen: float
    start: float


def _place(key: np.ndarray) -> np.ndarray:
    """The block of the Bloom filter that a key is in: its first 20 bits, so sorted keys have sorted blocks."""
    return (key >> np.uint64(44)).astype(np.int64)


def _bits(key: np.ndarray) -> np.ndarray:
    """The three bits of a key in its block."""
    out = np.zeros(len(key), dtype=np.uint64)
    for at in (20, 26, 32):
        out |= np.uint64(1) << ((key >> np.uint64(at)) & np.uint64(63))
    return out


def dealt(key: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Each shard that has any of these sorted keys, and where they are. Shards are ranges of blocks of the Bloom filter."""
    shard = _place(key) * shards // BLOOM
    ends = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(key)]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield int(shard[lo]), slice(lo, hi)


def sharded(table: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, deltas) of a table (key, delta): arrays as bytes, sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, delta = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            order = np.argsort(key.view(np.uint64))
            key, delta = key.view(np.uint64)[order], delta[order]
            parts = list(dealt(key, shards))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *(pa.array([x[at].tobytes() for _, at in parts], pa.binary()) for x in (key, delta))], names=["shard", "keys", "deltas"])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= DEALT:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return table.select("key", "delta").mapInArrow(run, "shard int, keys binary, deltas binary")


def bloom_filter(table: DataFrame, shards: int) -> np.ndarray:
    """The Bloom filter of a sharded table; each shard makes its own range of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM, dtype=np.uint64)
        for b in batches:
            for x in b.column(0):
                key = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                at, mask = _place(key), _bits(key)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                bits[at[first]] |= np.bitwise_or.reduceat(mask, first)
        found = np.flatnonzero(bits)
        if len(found):
            lo, hi = int(found[0]), int(found[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([bits[lo:hi].tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(BLOOM, dtype=np.uint64)
    rows = table.repartitionById(shards, "shard").select("keys").mapInArrow(run, "at long, bits binary").toArrow()  # BLOOM words in all
    for at, x in zip(rows["at"].to_pylist(), rows["bits"], strict=True):
        part = np.frombuffer(x.as_buffer(), dtype=np.uint64)
        out[at : at + len(part)] |= part
    return out


def maybe_known(bloom: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = _bits(key)
    return bloom[_place(key)] & mask == mask


def fit(texts: DataFrame) -> Model | None:
    """The model of all texts, which are written first, as they are read once a slice."""
    spark = texts.sparkSession
    texts = small_batches(materialise(texts.select("text")))
    if texts.isEmpty():
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in blocks(batches):
            found, ids, _ = word_ids(part, end=True, lower=False)
            yield pa.RecordBatch.from_arrays([pa.array(hashes(found).view(np.int64)), pa.array(np.bincount(ids, minlength=len(found)))], names=["word", "n"])

    counted = texts.mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SEEN)
    counted = materialise(counted.withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    held, least = 0, 1 << 30
    for r in counted.groupBy("level").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():  # under 1024 rows
        held += r.words
        if held > WORDS:
            break
        least = r.level
    known = counted.filter(F.col("level") >= least).select("word").toArrow()["word"].to_numpy()  # at most WORDS
    known = np.unique(np.concatenate([known.view(np.uint64), hashes([b""])]))
    shared = spark.sparkContext.broadcast(known)

    def grams(at: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part in blocks(batches):
                found, ids, starts = word_ids(part, end=True, lower=False)
                token = tokens(found, shared.value)[ids]
                one, _, before, three = n_grams(token, starts)
                own = np.flatnonzero(mix(one) % np.uint64(SLICES) == at)
                _, first, count = np.unique(three[own], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[own[first]].view(np.int64)) for x in (before, one, token)), pa.array(count)], names=["c", "v", "w", "n"])

        return materialise(texts.mapInArrow(run, "c long, v long, w long, n long").groupBy("c", "v", "w").agg(F.sum("n").alias("n")))

    def slices() -> Iterator[DataFrame]:
        yield from (grams(at) for at in range(SLICES))
        discard(texts, counted)  # no slice is left to read them
        shared.destroy()

    delta, unseen, start = deltas(slices())
    # most frequent first; equal counts are told apart by 64 classes of their keys
    level = (F.floor(F.log2("n") * 16) * 64 + F.shiftrightunsigned("key", 40).bitwiseAND(63)).cast("int")
    held, least = 0, 1 << 30
    levels = delta.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("level")).collect()  # under 65,536 rows
    total = sum(r.rows for r in levels)
    for r in levels:
        held += r.rows
        if held > HEAD:
            break
        least = r.level
    top = delta.filter(level >= least).toArrow()  # at most HEAD rows
    order = np.argsort(top["n"].to_numpy(), kind="stable")  # of two in one slot the more frequent stays, the other is met by the join
    keys = top["key"].to_numpy().view(np.uint64)[order]
    key, value = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.float32)
    at = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
    key[at], value[at] = keys, top["delta"].to_numpy()[order]
    shards = max(partitions(spark), -(-total // SHARD))
    table = materialise(sharded(delta, shards))
    discard(delta)
    bloom = bloom_filter(table, shards)
    forget(spark)  # what was collected here was no write, so its shuffle files would lie beside those of the scoring
    return Model(spark.sparkContext.broadcast((known, key, value, bloom)), table, shards, unseen, start)


def text_hashes(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


#: Kinds of rows in scoring: arrays of the model, n-grams of a block of texts, and what the block knows itself.
_MODEL, _ASKED, _OWN = 0, 1, 2
_ROW = {"shard": pa.int32(), "kind": pa.int32(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary()}


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _ROW.values(), strict=True)], names=list(_ROW))


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers n-grams (a: sorted keys, b: their texts) by what they add (a: texts, b: sums), from rows of whole shards sorted by shard and kind. Rows that a block has of its own go through."""
    shard, parts, keys, values = -1, [], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32)
    for batch in batches:
        out = []
        for at, kind, block, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if at != shard:
                shard, parts, keys, values = at, [], keys[:0], values[:0]
            if kind == _MODEL:
                parts.append((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.float32)))
                continue
            if kind == _OWN:
                out.append((at, kind, block, a, b))
                continue
            if parts:
                keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                order, parts = np.argsort(keys, kind="stable"), []
                keys, values = keys[order], values[order]
            if len(keys):
                key = np.frombuffer(a, dtype=np.uint64)
                text = np.frombuffer(b, dtype=f"u{len(b) // len(key)}")
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = keys[place] == key
                added = np.bincount(text[there], weights=values[place[there]])
                to = np.flatnonzero(added)
                out.append((at, kind, block, to.astype(np.uint32).tobytes(), added[to].tobytes()))
        if out:
            yield _row_batch(out)
    tidy()


def summed(table: pa.Table) -> pa.Table:
    """The texts of one block, from its answers and its own row."""
    kind, a, b = (table[c].to_pylist() for c in ("kind", "a", "b"))
    own = kind.index(_OWN)
    t1, t2, size = np.frombuffer(a[own], dtype=np.int64).reshape(3, -1)
    total, again = np.frombuffer(b[own], dtype=np.float64).reshape(2, -1).copy()
    for k, to, added in zip(kind, a, b, strict=True):
        if k == _ASKED:
            total[np.frombuffer(to, dtype=np.uint32)] += np.frombuffer(added, dtype=np.float64)
    return pa.table({"t1": t1, "t2": t2, "log10_mean": total / size, "n_tokens": size, "repeats": again})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, t1, t2: hashes of the text, log10_mean, n_tokens, repeats) of docs: doc_id, lang, text. The end is a token."""
    shared, shards, unseen, start = model.shared, model.shards, model.unseen, model.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known, head, value, bloom = shared.value

        def found(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """What each n-gram adds as far as the head has it, and the places of those that only the table may have."""
            at = (key & np.uint64(SLOTS - 1)).astype(np.int64)
            there = head[at] == key
            rest = np.flatnonzero(~there)
            return np.where(there, value[at], 0.0), rest[maybe_known(bloom, key[rest])]

        for nth, (block, texts) in enumerate(blocks(batches)):
            words, ids, starts = word_ids(texts, end=True, lower=False)
            n, size = len(texts), np.diff(starts)
            distinct = tokens(words, known)
            _, pair, _, three = n_grams(distinct[ids], starts)
            text = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.uint32), size)
            total, where, keys = unseen * size + start, [], []
            for key, of in ((distinct, ids), (pair, None), (three, None)):
                adds, rest = found(key)
                if of is not None:  # words are looked up once
                    there = np.zeros(len(key), dtype=bool)
                    there[rest] = True
                    key, adds, rest = key[of], adds[of], np.flatnonzero(there[of])
                total += np.add.reduceat(adds, starts[:-1])
                where.append(text[rest])
                keys.append(key[rest])
            where, keys = np.concatenate(where), np.concatenate(keys)
            order = np.argsort(keys)
            where, keys = where[order], keys[order]
            number = (task << 32) + nth
            t1, t2 = (block.column(block.schema.get_field_index(c)).to_numpy() for c in ("t1", "t2"))
            own = ((task + nth) % shards, _OWN, number, np.concatenate([t1, t2, size]).tobytes(), np.concatenate([total, repeats(ids, starts)]).tobytes())
            yield _row_batch([own, *((shard, _ASKED, number, keys[at].tobytes(), where[at].tobytes()) for shard, at in dealt(keys, shards))])

    rows = ", ".join(f"{k} {'binary' if v == pa.binary() else 'long' if v == pa.int64() else 'int'}" for k, v in _ROW.items())
    table = model.table.select("shard", F.lit(_MODEL).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("keys").alias("a"), F.col("deltas").alias("b"))
    hashed = docs.select("doc_id", "lang", "text").withColumns(text_hashes(F.col("text")))
    scored = []
    for at in range(SLICES):  # equal texts are in one part
        part = hashed.select("t1", "t2", "text").filter(F.pmod("t1", F.lit(SLICES)) == at)
        asked = small_batches(part).mapInArrow(run, rows)
        told = table.unionAll(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(looked_up, rows)
        texts = told.groupBy("block").applyInArrow(summed, "t1 long, t2 long, log10_mean double, n_tokens long, repeats double")
        # equal texts have equal scores; documents meet them by the hashes of their texts
        scored.append(materialise(texts.groupBy("t1", "t2").agg(*[F.max(c).alias(c) for c in ("log10_mean", "n_tokens", "repeats")])))
        forget(docs.sparkSession)
    texts = reduce(DataFrame.unionByName, scored)
    return hashed.drop("text").join(texts, ["t1", "t2"]).select("doc_id", "lang", "t1", "t2", "log10_mean", "n_tokens", "repeats")


def _lookup(values: dict, default: float):
    """The value of the column ``lang``, or the default."""
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce("lang", F.lit(""))), F.lit(default))


class Thresholds:
    """Medians and bounds by language, from scored trusted documents that the model was not fitted on."""

    def __init__(self, calm: DataFrame, quantile: float, least: int):
        self.middle_all, self.bounds_all, self.most_all, self.middle, self.bounds, self.most = 0.0, -1e300, 1.0, {}, {}, {}
        calm = materialise(calm.withColumn("lang", F.coalesce("lang", F.lit(""))))
        whole = calm.agg(F.percentile_approx("log10_mean", 0.5, 10_000)).first()[0]
        if whole is None:  # all trusted documents were needed to fit the model
            return
        by_lang = calm.groupBy("lang").agg(F.percentile_approx("log10_mean", 0.5, 10_000).alias("m"), F.count(F.lit(1)).alias("n")).collect()  # a row per language
        self.middle_all, self.middle = whole, {r.lang: r.m for r in by_lang if r.n >= least}
        calm = calm.withColumn("d", self.deviation())
        outer = F.percentile_approx("d", quantile, 10_000).alias("low"), F.percentile_approx("repeats", 1 - quantile, 10_000).alias("most")
        self.bounds_all, self.most_all = calm.agg(*outer).first()
        rows = [r for r in calm.groupBy("lang").agg(*outer).collect() if r.lang in self.middle]
        self.bounds, self.most = {r.lang: r.low for r in rows}, {r.lang: r.most for r in rows}

    def deviation(self) -> Column:
        return (F.col("log10_mean") - _lookup(self.middle, self.middle_all)) / F.sqrt(1 / F.col("n_tokens") + 1 / OWN)

    def judge(self, scored: DataFrame, margin: float) -> DataFrame:
        """``scored`` with deviation and keep."""
        low = _lookup({k: margin * v for k, v in self.bounds.items()}, margin * self.bounds_all)
        most = _lookup({k: max(REPEATS, margin * v) for k, v in self.most.items()}, max(REPEATS, margin * self.most_all))
        again = F.col("repeats")
        return scored.withColumn("deviation", self.deviation()).withColumn("keep", (F.col("deviation") >= low) & ((again <= most) | (F.round(again * F.col("n_tokens")) <= 2)))


def judged(docs: DataFrame, labels: DataFrame, trusted: int | None = None, quantile: float = QUANTILE, least: int = LEAST, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, t1, t2, log10_mean, n_tokens, repeats, deviation, keep) of all documents.

    labels: (doc_id, quality); those of quality 1 are trusted. Each document is scored once, trusted or not. The model is
    fitted on one half of the trusted documents by hash, all of it unless a number is given.
    """
    good = materialise(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct())
    chosen = good.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0)
    chosen = bounded(chosen if trusted is None else chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted))
    model = fit(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi"))
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", *[c.alias(k) for k, c in text_hashes(F.col("text")).items()], none.alias("log10_mean"), F.lit(None).cast("long").alias("n_tokens"), none.alias("repeats"), none.alias("deviation"), F.lit(True).alias("keep"))
    scored = materialise(score(docs.select("doc_id", "lang", "text"), model))
    discard(model.table)
    model.shared.destroy()
    held = good.join(chosen, "doc_id", "left_anti")
    if good.count() <= SMALL:
        held = F.broadcast(held)
    return Thresholds(scored.join(held, "doc_id", "left_semi"), quantile, least).judge(scored, margin)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, as they are. Text and language decide, so rejects are known by their hashes."""
    names = {k: free_name(docs, k) for k in ("t1", "t2", "reject_lang")}
    bad = judged(docs, labels).filter("not keep").select(F.col("t1").alias(names["t1"]), F.col("t2").alias(names["t2"]), F.coalesce("lang", F.lit("")).alias(names["reject_lang"]))
    bad = bounded(bad.distinct())
    keys = {names[k]: c for k, c in text_hashes(F.col("text")).items()} | {names["reject_lang"]: F.coalesce("lang", F.lit(""))}
    return docs.withColumns(keys).join(bad, list(names.values()), "left_anti").select(*docs.columns)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), -F.col("log10_mean")).alias("perplexity"), "deviation", "repeats", "keep")
