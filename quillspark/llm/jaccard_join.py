"""Jaccard self-join on word n-grams: a size-aware heavy-light join, exact up to 64-bit shingle hashes.

A set is its distinct shingles. Sets are joined if 100 * |both| >= percent * |either|. In one global order, rare shingles
first, two sets that join share at least k shingles among the first |set| - ceil(percent/100 * |set|) + k of each.

* Small sets (up to a boundary) enumerate all subsets of size 2 of that prefix for k = 2: few, and hardly ever shared by
  chance.
* Large sets would have too many subsets; they go through inverted lists of their single prefix shingles, and a pair must
  meet in two lists (k = 2 again). Small sets within reach of the boundary are entered there too, so no pair across it is
  lost.
* The boundary is the size at which the total of rows written and list entries scanned is least, from the histogram of
  sizes and the mean length of lists, both taken over all documents. Lists are those of shingles that aren't known as
  frequent, as prefixes hold hardly any others, and only sizes that can join scan each other.

Lists are split by size first: two sets that join are in one band of sizes or in two that follow each other, so a shingle
that many sets of unlike sizes have makes short lists.

Equal sets are one class first. Each list then tries its members against one of them; what joins is one component, and
further steps try only pairs of a list that are still in different components: of long lists, compared in blocks, first
those that would connect them, then all that are left. So thousands of near copies cost a few checks each, while any link
between two components is found. All candidates are
checked on the sets of whole texts.

Every link is inside a component, so links are counted there: the sets of a component are told apart by how they differ
from its least one, dealt into blocks, and two blocks at a time compared by one matrix product. Each set of a pair of
blocks gets one sum; no pair is ever a row. A set that is met by very many (the least of a long list, or of a large
component) is sent to several tasks, each with a part of these.

The order uses counts of frequent shingles: those seen twice or more in a million, of which the 2^19 most frequent are
sent to executors. It changes how many candidates there are, never the result.

Before texts move, candidates are tried by the parities of their sets: each shingle flips one of 1024 bits (large sets:
one of 16384 more), so bits that differ are a lower bound of shingles that differ. What it rules out is no link for
certain.

Nulls and empty texts: an empty set, linked with nothing, its own component. A null doc_id belongs to the component of
its equals (null if all of these are null, and then linked with these only). Repeated rows are equal sets and count as
links of each other; rows with one doc_id and different texts are sets of their own. Empty tables give empty results.
Texts of any length are taken whole; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import block_shingles, blocks, discard, forget, free_name, materialise, mix, partitions, read_table, small_batches, tidy
from quillspark.llm.components import components

#: Shingles that are counted together in one task before the frequent ones are handed on.
CHUNK = 1_000_000
LEAST_COUNT = 2
FREQUENT = 1 << 19
#: Bits of the parity of a set: two sets differ in at least as many shingles as their parities in bits.
PARITY = 1024
#: Sets above the first number have as many more bits as the second says.
LARGE, WIDE = 2000, 16_384
#: Lists of up to FEW members make pairs by a join; longer ones are compared in blocks, STRIP rows of them at a time.
FEW, BLOCK, STRIP = 24, 2048, 256
#: Sets of a component whose links are counted at once.
LINK_BLOCK = 512
#: Elements that a block of differing shingles may have, if it is more than one set.
BLOCK_SHINGLES = 250_000
#: Sets that meet one set in one task.
MEET = 256
#: Parts in which the lists' keys are met; all of them are.
SLICES = 4
#: Rows of a few longs that may be broadcast: up to 32 MB.
SMALL = 1_000_000
ONE = np.uint64(1)
#: Pairs of sets that one list compares before its task gives memory back; after each list it would cost more than most lists do.
TIDY_PAIRS = 1_000_000


def least_overlap(n, percent: int):
    """The least overlap that a set of n shingles can have with one that it joins."""
    return -(-n * percent // 100)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def parity(shingles: np.ndarray) -> np.ndarray:
    def of(size: int) -> np.ndarray:
        bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        return np.packbits(bits.astype(np.uint8)).view(np.int64)

    return np.concatenate([of(PARITY), of(WIDE)]) if len(shingles) > LARGE else of(PARITY)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: (doc_id, n, s1, s2, bits) of a document; 1: (n: count, s1: shingle); 2: (n: shingles, s1: distinct ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        held: list[np.ndarray] = []
        size = 0

        def rows(k, ids, n, s1, s2, bits=None):
            bits = pa.nulls(len(n), pa.list_(pa.int64())) if bits is None else pa.ListArray.from_arrays(np.cumsum([0, *map(len, bits)]).astype(np.int32), np.concatenate(bits))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, dtype=np.int32)), ids, *(pa.array(x, pa.int64()) for x in (n, s1, s2)), bits], names=["kind", "doc_id", "n", "s1", "s2", "bits"])

        def flush():
            found, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= LEAST_COUNT
            found_often = found[often].view(np.int64)
            yield rows(1, pa.nulls(len(found_often), id_type), count[often], found_often, np.zeros_like(found_often))
            yield rows(2, pa.nulls(1, id_type), [int(count.sum())], [len(found)], [0])

        for block, texts in blocks(batches):
            id_type = block.schema.field(0).type
            n, signs, bits = [], [], []
            for s in block_shingles(texts, width):
                n.append(len(s))
                signs.append(signature(s))
                bits.append(parity(s))
                held.append(s)
                size += len(s)
            yield rows(0, block.column(0), n, [x for x, _ in signs], [x for _, x in signs], bits)
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"kind int, doc_id {kind}, n long, s1 long, s2 long, bits array<long>")


def band(size, percent: int, log=np.log, floor=np.floor):
    """The band of a size: sizes that can join are at most one band apart, also by rounded logarithms."""
    return floor(log(size) / math.log(100 / percent * (1 + 1e-9)))


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest size of sets that enumerate subsets, by least cost.

    Small sets write a row a subset; sets from 0.9 of the boundary write a row a prefix shingle; and sets beyond it scan
    those entries of the lists of these that are near them in size. list_length: other entries of all sizes in a list.
    """
    if not sizes:
        return 0
    n = np.array(sorted(sizes))
    h = np.array([sizes[v] for v in n], dtype=float)
    p = n - least_overlap(n, percent) + 1
    bands, at = np.unique(band(n, percent), return_inverse=True)
    held = np.bincount(at, weights=h * p)
    near = np.concatenate([[0], np.cumsum(held)])
    near = near[np.searchsorted(bands, bands + 1, "right")] - near[np.searchsorted(bands, bands - 1, "left")]
    scanned = np.concatenate([[0], np.cumsum(h * p * (near / held.sum())[at])])
    light = np.concatenate([[0], np.cumsum(h * p * (p + 1) / 2)])
    listed = np.concatenate([[0], np.cumsum(h * p)])
    bounds = np.concatenate([[0], n])
    reach = np.searchsorted(n, least_overlap(bounds, percent), "left")
    cost = light + (listed[-1] - listed[reach]) + list_length * (scanned[-1] - scanned)
    return int(bounds[np.argmin(cost)])


def others(occurrences: int, distinct: int, chunks: int, known: int, known_distinct: int) -> float:
    """Other sets in the list of a shingle, as seen within chunks and carried to all of them. Those of known frequent shingles
    are left out of both sums: they are last in each prefix.
    """
    rare = distinct - known_distinct
    return ((occurrences - known) / rare - 1) * chunks if rare > 0 else 0.0


def postings(docs: DataFrame, width: int, percent: int, bound: int, frequent) -> DataFrame:
    """(key, s): the lists, with s the first half of a set's signature. Keys of two shingles are odd, of one are even: see weight()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _, texts in blocks(batches):
            keys, who = [], []
            for s in block_shingles(texts, width):
                n = len(s)
                least = int(least_overlap(n, percent))
                if not n or (least == n and n * 100 // percent == n):
                    continue  # it joins equal sets only
                q = min(n, n - least + 2)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    rare = s[~often][:q]
                    if len(rare) < q:
                        rest = s[often]
                        rare = np.concatenate([rare, rest[np.argsort(counts[at[often]], kind="stable")][: q - len(rare)]])
                else:
                    rare = s[:q]
                own = []
                if n <= bound:
                    i, j = pairs[q] if q in pairs else np.triu_indices(q, 1)
                    if q <= 64:
                        pairs[q] = i, j
                    own.append(mix(mix(rare[i]) + rare[j]) | ONE)
                if n >= least_overlap(bound, percent):
                    own.append(rare & ~ONE)
                if least == 1:  # one shingle may be all that it shares
                    own.append(rare | ONE)
                sign = signature(s)[0]
                for k in own:
                    keys.append(k.view(np.int64))
                    who.append(np.full(len(k), sign))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, who)], names=["key", "s"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "key long, s long")


def weight(key: str = "key") -> Column:
    """How many shingles of their prefixes two sets are known to share by a list; those that join share two."""
    return (1 + F.pmod(key, F.lit(2))).cast("int")


def by_size(members: DataFrame, percent: int) -> DataFrame:
    """(key, s, size, own): the lists of members (key, s, size), split by bands of sizes; keys stay odd or even.

    A set is in the list of its own band and in that of the next one, where it meets sets of that band only. Lists
    without two sets, or without any of their own band, are left out: no two of them can join there.
    """
    at = band(F.col("size"), percent, F.log, F.floor)
    both = members.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", F.when(F.col("own"), at).otherwise(at + 1))
    key = F.xxhash64("key", "band").bitwiseAND(F.lit(-2)).bitwiseOR(F.pmod("key", F.lit(2)))
    both = both.select(key.alias("key"), "s", "size", "own")
    heads = both.groupBy("key").agg(F.min("s").alias("lead"), F.max("s").alias("last"), F.max("own").alias("has_own")).filter("lead <> last and has_own").select("key")
    return both.join(bounded(heads), "key")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(s, shingles) of wanted(s, doc_id): the sorted 64-bit hashes as bytes. Other texts of the same doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of this task: a doc_id that has many rows is sent on once
        for block, texts in blocks(batches):
            s, found = [], []
            for want, x in zip(block.column(0).to_pylist(), block_shingles(texts, width), strict=True):
                if want not in done and signature(x)[0] == want:
                    done.add(want)
                    s.append(want)
                    found.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(found, pa.binary())], names=["s", "shingles"])

    texts = docs.select("doc_id", "text").join(bounded(wanted.select("doc_id", "s")), "doc_id").select("s", "text")
    return small_batches(texts).mapInArrow(run, "s long, shingles binary")


def met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(b, part, first, a, shingles), by b and part: the set b first, then all sets a that pairs (a, b) has with it.

    A set b with many pairs is sent to as many parts as leave MEET of them in each.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEET).alias("parts")).filter("parts > 1")
    dealt = pairs.join(bounded(many), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).select("a", "b", "part")
    dealt = materialise(dealt)
    leads = dealt.select("b", "part").distinct().join(sets.withColumnRenamed("s", "b"), "b").select("b", "part", F.lit(False).alias("member"), F.col("b").alias("a"), "shingles")
    members = dealt.join(sets.withColumnRenamed("s", "a"), "a").select("b", "part", F.lit(True).alias("member"), "a", "shingles")
    return small_batches(leads.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", "member"))


def met_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Lists of (a, b, set a, set b) of the rows of met()."""
    lead: tuple[int, np.ndarray] | None = None
    for batch in batches:
        out = []
        for b, member, a, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            x = np.frombuffer(x, dtype=np.uint64)
            if not member:
                lead = b, x
            elif lead and lead[0] == b:
                out.append((a, b, x, lead[1]))
        yield out


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both are sorted."""
    if not len(y):
        return np.zeros(len(x), dtype=bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in met_sets(batches):
            keep = []
            for a, b, x, y in part:
                both = np.count_nonzero(common(x, y))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in keep], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return met(pairs, sets).mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, group: str, item: str, n_blocks) -> DataFrame:
    """``rows`` with lo, hi and block: each row goes to every pair of blocks of its group that has its own.

    A group of (group, lo, hi) is one block or two; all pairs of blocks are met, each in a group of its own.
    """
    n = F.greatest(n_blocks, F.lit(1)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(item), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")


def flat(col: pa.Array | pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of byte strings, one after the other, and how many of them each has."""
    found = [np.frombuffer(x, dtype=kind) for x in col.to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, dtype=kind), np.array([len(x) for x in found], dtype=np.int64)


def most_frequent(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted shingles of counted (s1, n, chunks) and their counts, at most FREQUENT: those above the least count that keeps
    within it. And the sum of their chunks.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    counted = materialise(counted)
    held, least = 0, 1 << 30
    for r in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("level")).collect():  # under 512 rows
        held += r.rows
        if held > FREQUENT:
            break
        least = r.level
    found = counted.filter(level >= least).toArrow()
    shingle = found["s1"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], found["n"].to_numpy()[order], int(found["chunks"].to_numpy().sum())


def bounded(rows: DataFrame) -> DataFrame:
    """The rows, written; marked for a broadcast if there are at most SMALL of them, and met by a shuffle if more."""
    rows = materialise(rows)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that parities do not rule out, of pairs (a, b, weight) whose weights come to two shingles or more.
    Sets of n and m that join differ in (n + m) (100 - p) / (100 + p) at most.

    Both joins have plain exchanges on both sides, so Spark splits the pairs of a set that has many.
    """
    a = nodes.select(F.col("s").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
    b = nodes.select(F.col("s").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
    narrow, wide = PARITY // 64, WIDE // 64

    def differ(first: int, n: int):
        x, y = F.slice("bits_a", first, n), F.slice("bits_b", first, n)
        return F.aggregate(F.zip_with(x, y, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    most = (F.col("size_a") + F.col("size_b")) * (100 - percent)
    both_wide = (F.size("bits_a") > narrow) & (F.size("bits_b") > narrow)
    fits = (differ(1, narrow) * (100 + percent) <= most) & (~both_wide | (differ(narrow + 1, wide) * (100 + percent) <= most))
    pairs = materialise(pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight")).filter("weight > 1").select("a", "b"))
    return pairs.join(a, "a").join(b, "b").filter(fits).select("a", "b")


def block_pairs(members: DataFrame, nodes: DataFrame, percent: int, forest: bool, tried: np.ndarray) -> DataFrame:
    """Pairs (a, b, weight) of long lists that are in different components, not ruled out by parities and not among those tried.

    members: key, s, size, own, component and members (their number in the list). Blocks of about BLOCK members are compared by
    matrix operations on their parities, so no pair that is ruled out is ever a row. With ``forest``, two blocks give only
    pairs that would connect what was not connected, those of least difference first: fewer than they have members.
    """
    shared = members.sparkSession.sparkContext.broadcast(tried)
    bits = nodes.select("s", F.slice("bits", 1, PARITY // 64).alias("bits"))
    dealt = in_blocks(members.join(bits, "s"), "key", "s", F.ceil(F.col("members") / BLOCK))

    def run(table: pa.Table) -> pa.Table:
        s, size, own, component, block, lo, hi = (table[c].to_numpy() for c in ("s", "size", "own", "component", "block", "lo", "hi"))
        bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY // 64)
        xs, y = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
        root: dict[int, int] = {}
        found_a, found_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(xs), STRIP):
            x = xs[at : at + STRIP]
            differ = np.zeros((len(x), len(y)), dtype=np.int32)
            for w in range(PARITY // 64):
                differ += np.bitwise_count(bits[x, w, None] ^ bits[None, y, w])
            big, small = np.maximum(size[x, None], size[None, y]), np.minimum(size[x, None], size[None, y])
            ok = (differ * (100 + percent) <= (big.astype(np.int64) + small) * (100 - percent)) & (component[x, None] != component[None, y]) & (percent * big <= 100 * small) & (own[x, None] | own[None, y])
            i, j = np.nonzero(ok)
            a, b = np.minimum(s[x[i]], s[y[j]]), np.maximum(s[x[i]], s[y[j]])
            new = ~common(pair_hash(a, b), shared.value)
            i, j, a, b = i[new], j[new], a[new], b[new]
            if forest:
                order = np.argsort(differ[i, j], kind="stable")
                used = order[_spanning(component[x[i[order]]].tolist(), component[y[j[order]]].tolist(), root)]
                a, b = a[used], b[used]
            found_a.append(a)
            found_b.append(b)
        if len(xs) * len(y) >= TIDY_PAIRS:
            tidy()
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    found = spread(dealt, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")
    return found.withColumn("weight", F.lit(2))  # their parities have been met


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over all shuffle partitions: blocks are few bytes and much work, so they aren't put together by bytes."""
    return rows.repartition(partitions(rows.sparkSession), *keys)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) + b.view(np.uint64))


def _spanning(a: list[int], b: list[int], root: dict[int, int]) -> list[int]:
    """Places of the edges (a, b), in their order, that connect what was not connected before, as ``root`` knows and learns."""

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(n)
    return kept


def linked_copies(found: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(s, linked): for each set of ``found`` (s, component) the copies of all other sets that it joins.

    classes: s, size, copies. sets: s, shingles, of all sets of components of three or more. A component's label is its
    least set. With D the shingles in which a set A differs from the least one R, |A and B| = |R| - |R less A| - |R less B|
    + |D_A and D_B|, so only these few are compared.
    """
    own = materialise(found.join(classes, "s").select("s", "component", "size", "copies"))
    groups = own.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("all"), F.min(F.struct((F.col("s") != F.col("component")), "size")).getField("size").alias("least_size"))
    own = materialise(own.join(groups, "component"))
    two = own.filter("members = 2").select("s", (F.col("all") - F.col("copies")).alias("linked"))
    more = own.filter("members > 2")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in met_sets(batches):
            a, missing, rows = [], [], []
            for one, _, x, r in part:
                gone = ~common(r, x)
                a.append(one)
                missing.append(int(np.count_nonzero(gone)))
                rows.append(np.concatenate([r[gone], x[~common(x, r)]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(missing, pa.int64()), pa.array(rows, pa.binary())], names=["s", "missing", "differ"])

    pairs = more.filter("s <> component").select(F.col("s").alias("a"), F.col("component").alias("b"))
    told = met(pairs, sets).mapInArrow(tell, "s long, missing long, differ binary")
    told = materialise(told.dropDuplicates(["s"]))
    rows = more.join(told, "s", "left").select("component", "members", "least_size", "s", "size", "copies", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"), F.coalesce("differ", F.lit(b"")).alias("differ"))
    rows = materialise(rows)
    weight = rows.groupBy("component").agg(F.greatest(F.ceil(F.first("members") / LINK_BLOCK), F.ceil(F.sum(F.length("differ")) / (8 * BLOCK_SHINGLES))).alias("n_blocks"))
    dealt = in_blocks(rows.drop("members").join(weight, "component"), "component", "s", F.col("n_blocks")).drop("n_blocks")

    def count(table: pa.Table) -> pa.Table:
        s, size, copies, missing, block, lo, hi, least = (table[c].to_numpy() for c in ("s", "size", "copies", "missing", "block", "lo", "hi", "least_size"))
        value, lengths = flat(table["differ"], np.uint64)
        row = np.repeat(np.arange(len(s)), lengths)
        value, row = _shared(value, row)
        x, y = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
        place = np.zeros(len(s), dtype=np.int64)
        place[x] = np.arange(len(x))
        place[y] = np.arange(len(y))
        both = np.zeros((len(x), len(y)), dtype=np.float32)
        in_x, in_y = block[row] == lo[0], block[row] == hi[0]
        step = 4096
        for at in range(0, int(value.max()) + 1 if len(value) else 0, step):  # columns of a few shingles at once
            left, right = np.zeros((len(x), step), dtype=np.float32), np.zeros((len(y), step), dtype=np.float32)
            first, last = np.searchsorted(value, [at, at + step])
            part = slice(first, last)
            for side, inside in ((left, in_x[part]), (right, in_y[part])):
                side[place[row[part][inside]], value[part][inside] - at] = 1
            both += left @ right.T
        overlap = least[0] - missing[x, None] - missing[None, y] + both.astype(np.int64)
        joins = (overlap > 0) & (100 * overlap >= percent * (size[x, None] + size[None, y] - overlap)) & (s[x, None] != s[None, y])
        out = {int(v): int(n) for v, n in zip(s[x], joins @ copies[y], strict=True)}
        if lo[0] != hi[0]:
            out |= {int(v): int(n) for v, n in zip(s[y], joins.T @ copies[x], strict=True)}
        return pa.table({"s": pa.array(out.keys(), pa.int64()), "linked": pa.array(out.values(), pa.int64())})

    counted = spread(dealt, "component", "lo", "hi").groupBy("component", "lo", "hi").applyInArrow(count, "s long, linked long").groupBy("s").agg(F.sum("linked").alias("linked"))
    return two.unionByName(counted)


def _shared(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values that two rows or more have, in order, with their rows; others can't be in two sets."""
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.diff(value, prepend=value[:1] + np.uint64(1)) != 0
    group = np.cumsum(new) - 1
    often = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
    return np.unique(group[often], return_inverse=True)[1], row[often]


def shared_lists(lists: DataFrame) -> DataFrame:
    """The distinct (key, s) of keys that two sets or more have. Keys are taken in SLICES, one after the other, so the disk
    holds the shuffle of one slice beside the lists; every key is in one.
    """
    found = []
    for at in range(SLICES):
        own = lists.filter(F.pmod(F.shiftright("key", 1), F.lit(SLICES)) == at)
        heads = own.groupBy("key").agg(F.min("s").alias("lead"), F.max("s").alias("last")).filter("lead <> last").select("key")
        heads = bounded(heads)  # far fewer than lists, as most have one member
        forget(lists.sparkSession)
        found.append(materialise(own.join(heads, "key").select("key", "s").distinct()))
        discard(heads)
    return reduce(DataFrame.unionByName, found)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and with ``links`` n_links, the documents it is linked with."""
    spark = docs.sparkSession
    profile = materialise(profiles(docs, width))
    rows = profile.filter("kind = 0")
    *known, seen = most_frequent(profile.filter("kind = 1").groupBy("s1").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks")))
    frequent = spark.sparkContext.broadcast(tuple(known))
    # sizes to 1 in 128: some 5000 rows at most
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(F.expr("shiftright(n, cast(log2(n) as int) - 7) * shiftleft(1L, cast(log2(n) as int) - 7)"))
    sizes = {r.n: r.h for r in rows.filter("n > 0").groupBy(level.alias("n")).agg(F.count(F.lit(1)).alias("h")).collect()}
    chunk = profile.filter("kind = 2").agg(F.sum("n").alias("all"), F.sum("s1").alias("distinct"), F.count(F.lit(1)).alias("chunks")).first()
    bound = boundary(sizes, others(chunk["all"] or 0, chunk["distinct"] or 0, chunk["chunks"], int(known[1].sum()), seen), percent)

    lists = materialise(postings(docs, width, percent, bound, frequent))
    shared = shared_lists(lists)
    discard(lists)

    # a class: the documents with one set, known by the first half of its signature
    first = F.first(F.struct("n", "bits"))
    classes = rows.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), first.alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.select(F.col("s1").alias("s"), "s2", "doc_id", F.col("x.n").alias("size"), F.col("x.bits").alias("bits"), "copies"))
    nodes = classes.filter("doc_id is not null").join(shared.select("s").distinct(), "s", "left_semi")
    nodes = materialise(nodes.select("s", "doc_id", F.col("size").cast("int").alias("size"), "bits"))
    members = materialise(by_size(shared.join(bounded(nodes.select("s", "size")), "s").select("key", "s", "size"), percent))
    discard(shared)
    fits = f"{percent} * greatest(size, size_b) <= 100 * least(size, size_b)"

    leads = members.filter("own").groupBy("key").agg(F.min(F.struct("s", "size")).alias("x")).select("key", F.col("x.s").alias("b"), F.col("x.size").alias("size_b"))
    star = members.join(bounded(leads), "key").filter(f"s <> b and {fits}").select(F.greatest("s", "b").alias("a"), F.least("s", "b").alias("b"), weight().alias("weight"))
    star = materialise(possible(star, nodes, percent))
    sets = materialise(sets_of(docs, nodes.join(_ends(star), "s", "left_semi"), width))
    forget(spark)
    linked = materialise(verify(star, sets, percent))
    discard(star)
    found = materialise(components(linked))

    # what is left: pairs of a list in different components. Long lists are connected by forests first, as most of their
    # pairs are in one component then; the last round tries all pairs that are left
    tried = np.zeros(0, dtype=np.uint64)
    for last in (False, True):
        placed = members.join(bounded(found.withColumnRenamed("node", "s")), "s", "left").withColumn("component", F.coalesce("component", "s"))
        placed = materialise(placed.select("key", "s", "size", "own", "component"))
        open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo <> hi").select("key", "members")
        left = materialise(placed.join(bounded(open_keys), "key"))
        rest = block_pairs(left.filter(F.col("members") > FEW), nodes, percent, not last, tried)
        if last:
            few = left.filter(F.col("members") <= FEW).drop("members")
            other = few.select("key", F.col("s").alias("b"), F.col("size").alias("size_b"), F.col("own").alias("own_b"), F.col("component").alias("component_b"))
            met_once = few.join(other, "key").filter(f"s < b and (own or own_b) and component <> component_b and {fits}")
            rest = rest.unionByName(met_once.select(F.col("s").alias("a"), "b", weight().alias("weight")))
        rest = materialise(possible(rest, nodes, percent))
        discard(left, placed)
        if rest.isEmpty():
            continue
        new = nodes.join(_ends(rest), "s", "left_semi").join(bounded(sets.select("s")), "s", "left_anti")
        sets = sets.unionByName(materialise(sets_of(docs, new, width)))
        more = materialise(verify(rest, sets, percent))
        if not last and rest.count() <= SMALL:  # beyond that, pairs that don't join may be tried again
            pairs = rest.toArrow()
            tried = np.union1d(tried, pair_hash(*(pairs[c].to_numpy() for c in ("a", "b"))))
        if not more.isEmpty():
            linked = linked.unionByName(more)
            found = materialise(components(linked))
    found = found.withColumnRenamed("node", "s")

    # documents whose class has copies or links; all others are their own component
    named = found.join(classes.select("s", "doc_id"), "s").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reach = classes.join(found.join(named, "component"), "s", "left").filter("copies > 1 or component is not null")
    reach = reach.select("s", "s2", F.coalesce("component_id", "doc_id").alias("component_id"), "copies")
    out = [F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        reach = reach.join(linked_copies(found, classes.select("s", "size", "copies"), sets, percent), "s", "left")
        out.append(F.coalesce(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).cast("long").alias("n_links"))
    reach = materialise(reach.withColumnsRenamed({"s": "s1"}))
    return rows.select("doc_id", "n", "s1", "s2").join(reach, ["s1", "s2"], "left").select("doc_id", *out)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()


def drop_near_copies(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of each group of texts that are linked, directly or through others: that with the smallest
    doc_id (nulls last, then by the text's hashes). Rows without words are linked with nothing and stay.

    A row is known by doc_id and its text's hashes, so unlike texts under one doc_id are judged apart; of rows that agree
    in both, one stays.
    """
    t1, t2, row = (free_name(docs, x) for x in ("text_hash_1", "text_hash_2", "kept_row"))
    hashed = docs.withColumns({t1: F.xxhash64("text"), t2: F.xxhash64(F.lit(1), F.col("text"))})
    whole = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(t1).alias("t1"), F.col(t2).alias("t2"))
    found = jaccard_components(hashed.select(whole.alias("doc_id"), "text"), width, percent, links=False)
    found = materialise(found.filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or component_id <> doc_id"))

    def meet(keys: DataFrame, how: str) -> DataFrame:
        keys = bounded(keys.select("doc_id.*").withColumnsRenamed({"id": f"{row}_id", "t1": f"{row}_1", "t2": f"{row}_2"}).drop("none"))
        return hashed.join(keys, F.col("doc_id").eqNullSafe(F.col(f"{row}_id")) & (F.col(t1) == F.col(f"{row}_1")) & (F.col(t2) == F.col(f"{row}_2")), how)

    out = meet(found, "left_anti").select(*docs.columns)
    again = found.filter("component_id = doc_id")  # kept, but more than one row
    if again.isEmpty():
        return out
    one = meet(again, "left_semi").groupBy("doc_id", t1, t2).agg(F.first(F.struct(*docs.columns)).alias(row))
    return out.unionByName(one.select(f"{row}.*"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w = [''] THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), n AS (
  SELECT doc_id, len(s) AS n FROM s
), e AS (
  SELECT doc_id, unnest(s) AS g FROM s
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.node
)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, min(reach.root)) AS component_id, (SELECT count(*) FROM edge WHERE edge.a = n.doc_id) AS n_links FROM n JOIN reach ON reach.node = n.doc_id GROUP BY n.doc_id, n.n
"""
