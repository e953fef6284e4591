"""Maximal periodic runs of words, by branching tandem repeats of a suffix tree.

A run is a stretch of consecutive words with smallest period q, at least ``LEAST`` words and ``TIMES`` * q long, that no
neighbour extends. Its last two periods are a tandem repeat whose next word differs: a branching one, and there is one for
each run and period. After Stoye and Gusfield, these are found at the nodes of the suffix tree: at a node of depth q, two
leaves q apart that lie below different children. Each node's leaves but those of its larger part are looked up, so a
text of n words takes O(n log n). The repeats are then rotated to the left as long as words agree, and those that reach
over the same words are one run, with the least period.

The tree is that of the intervals of equal prefixes in a suffix array, split in two at each least common prefix; the array
comes from doubling, and its ranks of blocks of 2^k words also answer how far words agree. Only stretches of words that can
lie in a run get a tree: every ``seed`` consecutive words in a run occur twice or more in the text, which is an exact test,
as a run of L >= max(LEAST, TIMES q) words has L >= 2 q + seed - 1. Stretches are taken as words of their own, a bounded
number at once or one long one.

Nulls: a null text has no words and no runs. Texts are taken whole, at any length. Rows are judged on their own, so
repeated rows, ties and empty tables need no rule. Extra columns pass through; new ones give way to names that are there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, array_blocks, fold, free_name, mix, read_table, small_batches, tidy, word_ids

LEAST, TIMES = 24, 3
#: Words of stretches that share a tree, and looked-up leaves at once: bounds of memory, not of what is found.
TREE_WORDS, LEAVES = 1 << 18, 1 << 20
RUN = "struct<start: long, length: long, period: long>"


def seed_length(least: int, times: int) -> int:
    return 1 + min(max(least, times * q) - 2 * q for q in range(1, least + 1))


def stretches(ids: np.ndarray, starts: np.ndarray, seed: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal stretches start and end that are covered by ``seed`` words which their text has twice or more."""
    n = len(ids) - seed + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    gram, have, width, at = None, 0, 1, h
    while width <= seed:  # blocks of 1, 2, 4, ... words; those of the bits of seed make up a gram
        if seed & width:
            gram = at if gram is None else mix(gram[: len(at) - have] * np.uint64(3) + at[have:])
            have += width
        if len(at) > width:
            at = mix(at[:-width] * np.uint64(5) + at[width:])
        width *= 2
    gram = mix(gram[:n] + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = np.flatnonzero(text[:n] == text[seed - 1 :])
    order = np.argsort(gram[inside])
    same = np.flatnonzero(gram[inside][order][1:] == gram[inside][order][:-1])
    found = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, inside[found], 1)
    np.add.at(edge, inside[found] + seed, -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(covered)
    cut = np.unique(np.concatenate([np.flatnonzero(change == 1), np.flatnonzero(change == -1), starts]))
    a, b = cut[:-1], cut[1:]
    long = (b - a >= least) & (covered[1:][np.minimum(a, len(ids) - 1)] > 0)
    return a[long], b[long]


def suffix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... words from each place on, until all differ. The last word must be unique."""
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int32)
    out, width = [rank], 1
    while rank.max() < n - 1:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int32)
        step[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(step, dtype=np.int32) - 1
        out.append(rank)
        width *= 2
    return out


def agree(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many words from places a and b on (or before them) are the same."""
    n, out = len(ranks[0]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = (a - out - (1 << k), b - out - (1 << k)) if left else (a + out, b + out)
        ok = (x >= 0) & (y >= 0) & (x < n) & (y < n)
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        out += ok.astype(np.int64) << k
    return out


def nodes(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place between neighbours in the suffix array, the first leaf and the end of the interval that it splits.

    Of equal common prefixes the first splits first, so children of one node are met two by two.
    """
    n = len(lcp)
    values = lcp.tolist()
    low, high, stack = [0] * n, [n] * n, [0]
    for k in range(1, n):
        v = values[k]
        while values[stack[-1]] > v:
            high[stack.pop()] = k
        low[k] = stack[-1]
        stack.append(k)
    return np.array(low), np.array(high)


def tandem_repeats(ranks: list[np.ndarray], times: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of the branching tandem repeats that may end a run of ``times`` periods."""
    rank = ranks[-1]
    n = len(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = agree(ranks, suffix[:-1], suffix[1:])
    low, high = nodes(lcp)
    split = np.flatnonzero((lcp > 0) & (high - low >= times))  # the leaves one period apart of such a run are all below
    low, high, depth = low[split], high[split], lcp[split]
    left_less = split - low <= high - split
    begin, size = np.where(left_less, low, split), np.minimum(split - low, high - split)
    other, other_end = np.where(left_less, split, low), np.where(left_less, high, split)
    ends = np.cumsum(size)
    starts, periods = [], []
    at = 0
    while at < len(split):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES, "right")))
        s = size[at:to]
        node = np.repeat(np.arange(at, to), s)
        leaf = suffix[np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + begin[node]]
        d = depth[node]
        for first, second in ((leaf, leaf + d), (leaf - d, leaf)):
            partner = second if first is leaf else first
            ok = np.flatnonzero((partner >= 0) & (partner < n))
            r = rank[partner[ok]]
            ok = ok[(r >= other[node[ok]]) & (r < other_end[node[ok]])]
            starts.append(first[ok])
            periods.append(d[ok])
        at = to
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64),) * 2


def tree_runs(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of the runs in words whose last one is unique, by start and period."""
    ranks = suffix_ranks(words)
    start, period = tandem_repeats(ranks, times)
    back = agree(ranks, start, start + period, left=True)
    end, start = start + 2 * period, start - back
    ok = end - start >= np.maximum(least, times * period)
    start, end, period = start[ok], end[ok], period[ok]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    out = np.stack([start, end - start, period], axis=1)[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each text; ids: words of all texts, starts: where each begins, and their end."""
    begin, end = stretches(ids, starts, seed_length(least, times), least)
    found = [np.zeros((0, 3), np.int64)]
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(np.cumsum(end[at:] - begin[at:]), TREE_WORDS, "right")) + at)
        a, size = begin[at:to], end[at:to] - begin[at:to]
        offset = np.cumsum(size + 1) - size - 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        # a stretch's words are its own, and each is closed by one of its own
        words = np.empty(int((size + 1).sum()), np.int64)
        words[offset + size] = np.arange(to - at) * (1 << 32) + (1 << 31)
        words[np.repeat(offset, size) + place] = np.repeat(np.arange(to - at), size) * (1 << 32) + ids[np.repeat(a, size) + place]
        runs = tree_runs(words, least, times)
        runs[:, 0] += (a - offset)[np.searchsorted(offset, runs[:, 0], "right") - 1]
        found.append(runs)
        at = to
    runs = np.concatenate(found)
    text = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[text]
    cuts = np.searchsorted(text, np.arange(len(starts)))
    return [runs[cuts[i] : cuts[i + 1]] for i in range(len(starts) - 1)]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def periodic(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length and period in words, by start and period) and ``collapsed`` (the words
    that no run repeats, joined by single spaces); new names where these are taken.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't told by their seeds")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    @F.arrow_udf(f"struct<runs: array<{RUN}>, collapsed: string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            all_runs, sizes, collapsed = [], [0], []
            for texts in array_blocks(batch):
                words, ids, starts = word_ids(texts, lower=False)
                for i, runs in enumerate(runs_of(ids, starts, least, times)):
                    own = ids[starts[i] : starts[i + 1]]
                    own = own[kept(len(own), runs)] if len(runs) else own
                    collapsed.append(b" ".join([words[w] for w in own.tolist()]))
                    all_runs.append(runs)
                    sizes.append(sizes[-1] + len(runs))
            flat = np.concatenate([np.zeros((0, 3), np.int64), *all_runs])
            runs = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind)))
            yield pa.StructArray.from_arrays([runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["runs", "collapsed"])
            tidy()

    found = free_name(docs, "found_runs")
    out = small_batches(docs).withColumn(found, of(F.col(text)))
    return out.select(*docs.columns, F.col(found)["runs"].alias(free_name(docs, "runs")), F.col(found)["collapsed"].alias(free_name(docs, "collapsed")))


def damaged(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words from one place on repeat with a period in every tenth text, by a hash of doc_id."""
    h = fold(F.col("doc_id"))
    words = F.when(h % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE + "+"), ""))
    g, n = F.floor(h / 10), F.size("words")
    rows = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), n - F.col("a"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def best(runs):
    """The run of the greatest exact length/period; of ties the first one, then the one of the least period; null if there is none."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda x, r: F.when(x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    rows = periodic(damaged(read_table(spark, sf_dir, "documents"))).drop("text").withColumn("best", best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    b = F.col("best")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), F.floor(1000 * b["length"] / b["period"]).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
