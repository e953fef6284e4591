"""Spherical k-means: centres are unit vectors, and a vector belongs to the centre with which its product is greatest.

A step is one job. Each task multiplies its vectors with all centres, and adds up those of a centre; the sums of all tasks
are added by Spark, number by number, so what is shuffled and what reaches the driver is centres, not vectors. Sums over
their length are the next centres. A centre without vectors takes half of the centre that has most: both become that one
centre, moved apart a little, so the next step deals its vectors between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.sample import place

#: How far the two halves of a split centre move apart, as a part of each number.
APART = 1 / 256


@dataclass
class Fitted:
    """Unit centres; how many vectors each has; the mean of 1 - product at each step, at the start first."""

    centres: np.ndarray
    sizes: np.ndarray
    errors: list[float] = field(default_factory=list)
    splits: int = 0


def _sums(vectors: DataFrame, column: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and numbers of the vectors of each centre, and the sum of all products."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 2))  # each centre's sum, number and products
        for batch in batches:
            column_ = batch.column(0)
            x = column_.flatten().to_numpy(zero_copy_only=False).reshape(len(column_), d)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                scores = part @ shared.value.T
                own = np.argmax(scores, axis=1)
                np.add.at(total[:, :d], own, part)
                total[:, d] += np.bincount(own, minlength=k)
                total[:, d + 1] += np.bincount(own, scores[np.arange(len(own)), own], minlength=k)
        some = np.flatnonzero(total[:, d])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (d + 2), pa.int32()), pa.array(total[some].ravel()))], names=["v", "s"])

    parts = vectors.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "v int, s array<double>")
    rows = parts.select("v", F.posexplode("s").alias("i", "x")).groupBy("v", "i").agg(F.sum("x").alias("x")).toArrow()  # k * (d + 2) numbers
    total = np.zeros((k, d + 2))
    total[rows["v"].to_numpy(), rows["i"].to_numpy()] = rows["x"].to_numpy()
    shared.destroy()
    return total[:, :d], total[:, d].astype(np.int64), float(total[:, d + 1].sum())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def split_empty(centres: np.ndarray, sizes: np.ndarray) -> int:
    """Gives each centre without vectors half of the largest one, in place; how many were split."""
    sizes, wave = sizes.astype(float), np.where(np.arange(centres.shape[1]) % 2, 1 + APART, 1 - APART)
    empty = np.flatnonzero(sizes == 0)
    for j in empty:
        i = int(np.argmax(sizes))
        centres[j], centres[i] = centres[i] * wave, centres[i] * (2 - wave)
        sizes[j] = sizes[i] = sizes[i] / 2
    centres[:] = _unit(centres)
    return len(empty)


def first_centres(vectors: DataFrame, column: str, k: int, seed: int = 0) -> np.ndarray:
    """k different vectors, the first in a seeded order of their values; the last ones again if there are fewer."""
    x = F.col(column).cast("array<double>")
    distinct = vectors.select(x.alias("x")).filter("x is not null").withColumn("place", place(seed, F.xxhash64("x"))).groupBy("place").agg(F.first("x").alias("x"))
    rows = distinct.orderBy("place").limit(k).collect()  # k vectors
    if not rows:
        raise ValueError("there are no vectors to fit centres to")
    found = np.array([r.x for r in rows])
    return _unit(np.concatenate([found, np.repeat(found[-1:], k - len(found), axis=0)]))


def spherical_kmeans(vectors: DataFrame, column: str, k: int, niter: int = 25, seed: int = 0, start: np.ndarray | None = None) -> Fitted:
    """Centres after at most ``niter`` steps; it ends early where no product gets better. Null vectors are left out.

    The sizes and the last error are those of the centres returned.
    """
    vectors = vectors.filter(F.col(column).isNotNull())
    out = Fitted(first_centres(vectors, column, k, seed) if start is None else _unit(np.array(start, dtype=float)), np.zeros(k, np.int64))
    for step in range(niter + 1):
        sums, out.sizes, products = _sums(vectors, column, out.centres)
        out.errors.append(1 - products / max(1, out.sizes.sum()))
        if step == niter or (step and not (out.sizes == 0).any() and out.errors[-2] - out.errors[-1] <= 1e-12):
            break
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        out.centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), out.centres)
        out.splits += split_empty(out.centres, out.sizes)
    return out
