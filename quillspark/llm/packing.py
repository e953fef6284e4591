"""Packing of token ids into fixed windows by non-negative least squares over the histogram of piece lengths.

Each document is tokenised once and cut into full windows and one shorter tail. Only the histogram of tails (fewer than
``window`` counts) comes to the driver. There all combinations of up to three lengths that fill a window exactly are
enumerated, repeat counts are solved for by non-negative least squares, rounded so that running totals hold, and the
lengths left over are packed greedily, best fit first. The result is a table of slots; executors give each piece a rank
among the pieces of its length and look its slot up.

Nulls: a null text is an empty one, which has just the end id. A null doc_id is kept as such. Repeated rows are packed
once each. Texts of any length are tokenised whole. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import blocks, materialise, read_table, small_batches, tokenizer_path

WINDOW = 2048
END_ID = 1
#: Chunks that a worker remembers; beyond, those that were used least are given up.
CACHE = 250_000
#: Chunks that are encoded at once.
LEARN = 4_000

#: What the byte-level pre-tokeniser treats alike wherever it stands: a run of non-space with the space before it, and
#: white space up to the last one before a word.
_S = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Some letters; whatever the pre-tokeniser finds, a token's letters end at the first other character, so a run of these
#: is cut off before an ASCII character that is none.
_L = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_CHUNK = re.compile(rf" ?[{_L}]+(?=[\x00-@\[-`{{-\x7f]|\Z)| ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LETTERS = re.compile(rf" ?[{_L}]+")


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: itself if Latin-1 prints it, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


_SIGNS = dict(enumerate(_byte_signs()))


class ByteBpe:
    """Ids of whole texts. White space bounds every token, so chunks are encoded once and remembered.

    A chunk's ids are a slice of one flat buffer; a text's ids are gathered from it by the numbers of its chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.model.model)  # the same vocabulary without a pre-tokeniser
        self.special = [str(t) for t in (x.content for x in self.model.get_added_tokens_decoder().values())]
        self._remember([], np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))

    def _remember(self, words: list[str], size: np.ndarray, flat: np.ndarray, uses: np.ndarray) -> None:
        self.known = dict(zip(words, range(len(words)), strict=True))
        self.size, self.flat, self.uses = size, flat, uses

    def _learn(self, new: list[str]) -> None:
        """Encodes and numbers chunks; each is a text of its own. The pre-tokeniser would leave chunks of letters whole, so these go without it."""
        sizes, flat = [self.size], [self.flat]
        new.sort(key=lambda c: _LETTERS.fullmatch(c) is None)
        letters = sum(_LETTERS.fullmatch(c) is not None for c in new)
        for model, chunks in ((self.plain, new[:letters]), (self.model, new[letters:])):
            for i in range(0, len(chunks), LEARN):
                part = chunks[i : i + LEARN]
                if model is self.plain:
                    part = "\0".join(part).encode("utf-8").decode("latin-1").translate(_SIGNS).split(_SIGNS[0])
                found = model.encode(part, is_pretokenized=True, add_special_tokens=False)
                sizes.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part)))
                flat.append(np.array(found.ids, dtype="<u4"))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(flat)
        self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])

    def _forget(self) -> None:
        """Keeps the half of the chunks that were used most, counted with less weight the longer ago."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE // 2])
        words, size = list(self.known), self.size[keep]
        self._remember([words[i] for i in keep], size, self.flat[_runs((np.cumsum(self.size) - self.size)[keep], size)], self.uses[keep] // 2)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids, unsigned 32-bit."""
        cut, ends, apart = [], [0], {}
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                apart[i] = np.array(self.model.encode(t, add_special_tokens=False).ids, dtype="<u4")
            else:
                cut += _CHUNK.findall(t)
            ends.append(len(cut))
        places = np.fromiter(map(self.known.get, cut, repeat(-1)), dtype=np.int64, count=len(cut))
        if len(new := np.flatnonzero(places < 0)):
            chunks = [cut[i] for i in new]
            self._learn(list(dict.fromkeys(chunks)))
            places[new] = list(map(self.known.__getitem__, chunks))
        size = self.size[places]
        ids = self.flat[_runs((np.cumsum(self.size) - self.size)[places], size)]
        self.uses += np.bincount(places, minlength=len(self.uses))
        if len(self.known) > CACHE:
            self._forget()
        at = np.concatenate([[0], np.cumsum(size)])[ends]
        return [apart[i] if i in apart else ids[at[i] : at[i + 1]] for i in range(len(texts))]


def _runs(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


_models: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _models:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _models[path] = ByteBpe(path)
    return _models[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and a tail of each document."""
    end = np.array([end_id], dtype="<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(path)
        for block, texts in blocks(batches):
            place, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(model.encode([t.decode("utf-8") for t in texts])):
                n = len(ids) + 1
                ids = np.concatenate([ids, end]).tobytes()
                for s in range(0, n, window):
                    place.append(i)
                    start.append(s)
                    length.append(min(window, n - s))
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + window)]))
                    total.append(n)
            long = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(place, pa.int64())), *long], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(count: np.ndarray, window: int) -> np.ndarray:
    """All (a <= b <= c) with a + b + c = window of lengths that occur; pairs have a = 0."""
    have = np.flatnonzero(count)
    have = have[(have > 0) & (have < window)]
    out = []
    for a in [0, *have[have * 3 <= window]]:
        b = have[(have >= a) & (2 * have <= window - a)]
        c = window - a - b
        ok = count[c] > 0
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def solve(combos: np.ndarray, count: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - count|^2, by accelerated projected gradients.

    Rows of A are scaled by the counts' roots, so rare lengths are met as well as frequent ones.
    """
    size = len(count)
    scale = np.where(count > 0, 1 / np.sqrt(np.maximum(count, 1)), 0.0)
    scale[0] = 0
    target = np.where(scale > 0, count * scale, 0)
    i, j, k = combos.T

    def spread(x):
        return (np.bincount(i, x, size) + np.bincount(j, x, size) + np.bincount(k, x, size)) * scale

    def gather(r):
        r = r * scale
        return r[i] + r[j] + r[k]

    ones = np.ones(len(combos))
    norm = float((gather(spread(ones))).max()) or 1.0  # bounds the largest eigenvalue: A'A has no negative entries
    per = gather(spread(ones))
    x = y = np.zeros(len(combos))
    t = 1.0
    step = 1 / np.maximum(per, 1e-12 * norm)  # a diagonal that dominates A'A
    for _ in range(steps):
        z = np.maximum(0, y - step * gather(spread(y) - target))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = z + (t - 1) / t_next * (z - x)
        x, t = z, t_next
    return x


def plan(count: np.ndarray, window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of all sequences for ``count[length]`` pieces of each length up to window."""
    left = count.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[window]:
        out.append((int(left[window]), (window,)))
        left[window] = 0
    combos = combinations(left, window)
    if len(combos):
        x = solve(combos, left)
        total = np.cumsum(x)
        whole = np.diff(np.floor(total + 0.5), prepend=0).astype(np.int64)
        for n in np.flatnonzero(whole):
            lengths = tuple(int(v) for v in combos[n] if v)
            most = min(left[v] // lengths.count(v) for v in lengths)
            if repeats := int(min(whole[n], most)):
                out.append((repeats, lengths))
                for v in lengths:
                    left[v] -= repeats
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return out
        taken: dict[int, int] = {}
        lengths, space = [], window
        while space and (at := int(np.searchsorted(have, space, "right"))):
            v = next((int(v) for v in have[at - 1 :: -1] if left[v] > taken.get(int(v), 0)), 0)
            if not v:
                break
            n = min(space // v, int(left[v]) - taken.get(v, 0))
            lengths += [v] * n
            taken[v] = taken.get(v, 0) + n
            space -= v * n
        repeats = min(int(left[v]) // n for v, n in taken.items())
        out.append((repeats, tuple(lengths)))
        for v, n in taken.items():
            left[v] -= repeats * n


def slots(sequences: list[tuple[int, tuple[int, ...]]], window: int) -> dict[str, np.ndarray]:
    """For each place in a pattern: its length, the first rank it takes, repeats, first sequence and offset, by (length, rank)."""
    used = [0] * (window + 1)
    rows, base = [], 0
    for repeats, lengths in sequences:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], repeats, base, offset))
            used[v] += repeats
            offset += v
        base += repeats
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "repeats", "base", "offset"), cols, strict=True))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path or tokenizer_path(), window, end_id))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most window rows
    count = np.zeros(window + 1, dtype=np.int64)
    for v, n in counts.items():
        count[v] = n
    table = spark.sparkContext.broadcast(slots(plan(count, window), window))

    # ranks: each length is dealt out over parts, so a length that many documents share is no single task
    parts = int(max(64, min(16_384, count.sum() // 200_000)))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(parts)), F.lit(parts)))
    sums = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = materialise(sums.select("length", "part", before.alias("before")))
    if (window + 1) * parts <= 300_000:  # a bound on its rows
        before = F.broadcast(before)
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("own"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t["length"] << 48) + t["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            sequence, offset = t["base"][at] + rank - t["rank"][at], t["offset"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select(*kept, "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
