"""Document fingerprints by one-permutation MinHash with optimal densification.

The 64-bit hashes of a text's word shingles are dealt into ``BINS`` bins by their high bits; each bin keeps its least
one. An empty bin takes the value of the first filled bin in a pseudo-random order of its own, which is the same for all
texts (optimal densification). Each value is hashed once more with its bin's number, the low ``BITS`` bits are kept, packed and written as hexadecimal;
so two texts with few shingles, whose bins repeat few values, agree by chance in each bin anew and not in all at once.
Two fingerprints that agree in a share m of the bins have the likeness (m - c) / (1 - c), c = 2^-BITS: bins of different
shingles agree by chance in c of all cases.

To meet its next document, each document goes to one of a few ranges of doc_id, sorted there; the first of each range also
visits the range before it. So texts move once, and no task sees more than its range, in a stream.

Nulls: a null text is empty; texts without words have the empty fingerprint, which is like another empty one (1) and
unlike all others (0). Null doc_ids come first. Rows with one doc_id follow each other in the order of their texts'
hashes. A sole document is its own next one. Texts are taken whole at any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import block_shingles, blocks, mix, partitions, read_table, small_batches

BINS = 512
BITS = 4
WIDTH = 5
MOST_RANGES = 4096
_NUMBERS = np.arange(BINS, dtype=np.uint64) << np.uint64(20)


@lru_cache(1)
def _orders(bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """For each bin, all bins in its own pseudo-random order, and the rank of each in it."""
    keys = mix(mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x5EED)))
    order = np.argsort(keys.reshape(bins, bins), axis=1).astype(np.int32)
    rank = np.argsort(order, axis=1).astype(np.int32)
    return order, rank


def fingerprint(shingles: np.ndarray) -> str:
    """Of sorted distinct shingle hashes."""
    if not len(shingles):
        return ""
    order, rank = _orders()
    bins = (shingles >> np.uint64(64 - 9)).astype(np.int32)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted, so the first of a bin is its least
    filled = bins[first]
    value = np.zeros(BINS, dtype=np.uint64)
    value[filled] = shingles[first]
    have = np.zeros(BINS, dtype=bool)
    have[filled] = True
    empty = np.flatnonzero(~have)
    if len(filled) < 64:
        if len(empty):
            value[empty] = value[filled[np.argmin(rank[np.ix_(empty, filled)], axis=1)]]
    else:
        t = 0
        while len(empty):
            at = order[empty, t]
            ok = have[at]
            value[empty[ok]] = value[at[ok]]
            empty, t = empty[~ok], t + 1
    low = (mix(value + _NUMBERS) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << BITS | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The estimated Jaccard similarity of two texts from their fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=np.uint8) for v in (a, b))
    d = x ^ y
    same = (np.count_nonzero((d >> BITS) == 0) + np.count_nonzero((d & ((1 << BITS) - 1)) == 0)) / BINS
    c = 2.0**-BITS
    return float(max(0.0, (same - c) / (1 - c)))


def fingerprints(docs: DataFrame, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of its text in a column ``out``."""
    @F.pandas_udf("string")
    def of(text):
        import pandas as pd

        found: list[str] = []
        for at in range(0, len(text), 256):
            found += [fingerprint(s) for s in block_shingles([(t or "").encode() for t in text.iloc[at : at + 256]], WIDTH)]
        return pd.Series(found)

    return docs.withColumn(out, of(F.col("text")))


def in_ranges(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, text, part, guest), each part sorted by guest and doc_id; its guests are the rows that follow it."""
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, ranges or partitions(spark))
    row = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("cuts"), F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    least = None if row.nulls else row.least
    cuts = sorted({c for c in row.cuts or [] if row.nulls or c != row.least})  # values that occur, so no part is empty
    cut = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cut, lambda c: c <= F.col("doc_id"))))
    leads = F.when(F.col("doc_id").eqNullSafe(F.lit(least)), len(cuts)).when(F.array_contains(cut, F.col("doc_id")), part - 1)
    to = F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.when(leads.isNotNull(), F.struct(leads.alias("part"), F.lit(True).alias("guest"))))
    rows = docs.select("doc_id", "text", F.explode(F.array_compact(to)).alias("to")).select("doc_id", "text", "to.*")
    return rows.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def compare(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and how like they and the next one's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last document, which waits for its next one
        for block, texts in blocks(batches):
            ids, parts, guest = (block.column(i).to_pylist() for i in (0, 2, 3))
            prints = [fingerprint(s) for s in block_shingles(texts, WIDTH)]
            pairs = []
            for now in zip(ids, texts, prints, parts, guest, strict=True):
                if held and held[3] == now[3]:
                    pairs.append((held, now))
                held = None if now[4] else now
            edited, chars = [], []
            for (_, text, *_), (_, following, *_) in pairs:
                text = text.decode()
                half = len(text) // 2
                chars.append(len(text))
                edited.append((text[: len(text) - half] + following.decode()[:half]).encode())
            edited_prints = [fingerprint(s) for at in range(0, len(edited), 512) for s in block_shingles(edited[at : at + 512], WIDTH)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array(chars, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array([a[2] for a, _ in pairs], pa.string()),
                    pa.array(edited_prints, pa.string()), pa.array([likeness(a[2], e) for (a, _), e in zip(pairs, edited_prints, strict=True)], pa.float64()), pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return small_batches(in_ranges(docs)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare(read_table(spark, sf_dir, "documents"))
