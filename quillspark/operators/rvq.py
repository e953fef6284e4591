"""Residual vector quantisation: codebooks, encoding, decoding errors and fitting.

A codebook is a table (k, v, centroid). It has K * V rows, which is bounded by its parameters, so it is broadcast.
Encoding is a pandas UDF of matrix products; ``encode_native`` says the same in array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(c: Column) -> Column:
    """The vector over its length (a zero vector stays as it is)."""
    c = c.cast("array<double>")
    size = F.sqrt(dot(c, c))
    return F.when(size > 0, F.transform(c, lambda x: x / size)).otherwise(c)


def collect_codebook(codebook: DataFrame) -> np.ndarray:
    """(K, V, d) of a codebook table, checked to be whole."""
    rows = codebook.orderBy("k", "v").collect()  # K * V rows
    ks, vs = {r.k for r in rows}, {r.v for r in rows}
    if len(rows) != len(ks) * len(vs) or not rows:
        raise ValueError("a codebook has one centroid for each k and v")
    return np.array([r.centroid for r in rows], dtype=np.float64).reshape(len(ks), len(vs), -1)


def encode_matrix(x: np.ndarray, book: np.ndarray, renorm: bool = True) -> np.ndarray:
    out = np.empty((len(x), len(book)), dtype=np.int32)
    r = x.copy()
    for k, stage in enumerate(book):
        out[:, k] = np.argmax(r @ stage.T, axis=1)  # the lowest of equals
        r = r - stage[out[:, k]]
        if renorm:
            r = r / (np.linalg.norm(r, axis=1, keepdims=True) + EPS)
    return out


def encode(vectors: DataFrame, column: str, book: np.ndarray, renorm: bool = True, out: str = "codes") -> DataFrame:
    """``vectors`` with the code tuple of each vector; null vectors have null codes."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf("array<int>")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = s.notna().to_numpy()
            made: list = [None] * len(s)
            if ok.any():
                for i, c in zip(np.flatnonzero(ok), encode_matrix(np.stack(s[ok].to_numpy()).astype(np.float64), shared.value, renorm), strict=True):
                    made[i] = c
            yield pd.Series(made, index=s.index, dtype=object)

    return vectors.withColumn(out, codes(F.col(column)))


def encode_native(vectors: DataFrame, column: str, codebook: DataFrame, renorm: bool = True, out: str = "codes") -> DataFrame:
    """The same without Python: each stage's centroids are one array, a step is one projection."""
    stages = codebook.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "centroid"))), lambda x: x["centroid"]).alias("c")).collect()
    df = vectors.withColumn("__r", F.col(column).cast("array<double>")).withColumn(out, F.array().cast("array<int>"))
    for r in sorted(stages, key=lambda r: r.k):
        one = vectors.sparkSession.createDataFrame([(r.c,)], "__c array<array<double>>")
        df = df.crossJoin(F.broadcast(one))  # one row: all centroids of a stage
        df = df.withColumn("__d", F.transform("__c", lambda c: dot(F.col("__r"), c)))
        df = df.withColumn("__i", F.array_position("__d", F.array_max("__d")).cast("int"))
        df = df.withColumn("__r", F.zip_with("__r", F.element_at("__c", F.col("__i")), lambda a, b: a - b))
        if renorm:
            df = df.withColumn("__n", F.sqrt(dot(F.col("__r"), F.col("__r"))) + EPS).withColumn("__r", F.transform("__r", lambda x: x / F.col("__n")))
        df = df.withColumn(out, F.concat(out, F.array(F.col("__i") - 1))).drop("__c", "__d", "__i", "__n")
    return df.drop("__r")


def reconstruction_errors(coded: DataFrame, column: str, book: np.ndarray, codes: str = "codes") -> DataFrame:
    """(stage from 0, mse, cosine, cos_dist): of the unit sum of the stages up to it' centroids against the vectors."""
    shared = coded.sparkSession.sparkContext.broadcast(book)
    k = len(book)

    @F.pandas_udf("array<double>")
    def errors(x: pd.Series, c: pd.Series) -> pd.Series:
        a, code = np.stack(x.to_numpy()).astype(np.float64), np.stack(c.to_numpy())
        total, cols = np.zeros_like(a), []
        for j in range(k):
            total = total + shared.value[j][code[:, j]]
            r = total / (np.linalg.norm(total, axis=1, keepdims=True) + EPS)
            cols += [((a - r) ** 2).sum(1), (a * r).sum(1)]
        return pd.Series(list(np.stack(cols, axis=1)))

    rows = coded.filter(F.col(column).isNotNull()).select(errors(column, codes).alias("e"))
    rows = rows.select(F.explode(F.array(*[F.struct(F.lit(j).alias("stage"), F.col("e")[2 * j].alias("se"), F.col("e")[2 * j + 1].alias("cos")) for j in range(k)])).alias("x")).select("x.*")
    return rows.groupBy("stage").agg(F.avg("se").alias("mse"), F.avg("cos").alias("cosine")).withColumn("cos_dist", 1 - F.col("cosine"))


def _residual(shared):
    """What is left of a unit vector after its nearest centre, made unit."""

    @F.pandas_udf("array<double>")
    def step(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy())
        x = x - shared.value[np.argmax(x @ shared.value.T, axis=1)]
        return pd.Series(list(x / (np.linalg.norm(x, axis=1, keepdims=True) + EPS)))

    return step


def fit(vectors: DataFrame, column: str, k: int, v: int, niter: int = 25, train_n: int = 1_000_000, seed: int = 0) -> DataFrame:
    """A codebook table with how it was fitted: (k, v, centroid, size, first_error, last_error).

    Each stage is a spherical k-means of what the stages before leave of the vectors, made unit; size is the number of
    training vectors of a centroid, the errors are the stage's means of 1 - product before and after its steps. Trains on
    at most ``train_n`` vectors, the first in a seeded order. A stage's residuals are a table of their own.
    """
    from quillspark.operators.kmeans import spherical_kmeans
    from quillspark.operators.sample import sample
    from quillspark.operators.tables import dropped, written

    spark = vectors.sparkSession
    rest = vectors.select(F.col(column).cast("array<double>").alias("r")).filter("r is not null").withColumn("__key", F.xxhash64("r"))
    rest = written(sample(rest, "__key", train_n, seed).select("r"))
    rows = []
    for stage in range(k):
        one = spherical_kmeans(rest, "r", v, niter, seed + stage)
        rows += [(stage, j, [float(x) for x in c], int(n), float(one.errors[0]), float(one.errors[-1])) for j, (c, n) in enumerate(zip(one.centres, one.sizes, strict=True))]
        before, rest = rest, None
        if stage < k - 1:
            rest = written(before.select(_residual(spark.sparkContext.broadcast(one.centres))("r").alias("r")))
        dropped(before)
    return spark.createDataFrame(rows, "k int, v int, centroid array<double>, size long, first_error double, last_error double")  # k * v rows


def attach_codes(sentences: DataFrame, codes: DataFrame, key: str = "sent_id") -> DataFrame:
    """Sentences with their codes, by key; an error if a sentence has no codes or codes have no sentence."""
    a, b = sentences.join(codes, key, "left_anti").count(), codes.join(sentences, key, "left_anti").count()
    if a or b:
        raise ValueError(f"{a} sentences without codes and {b} code tuples without a sentence")
    return sentences.join(codes, key)


def attach_embeddings(sentences: DataFrame, vectors: DataFrame, order: str | list[str] = "sent_id", row: str = "row_id") -> DataFrame:
    """Sentences in order with the vector of the same place (``row`` counts from 0); an error if there are too few vectors.

    Vectors that are left over are ignored, with a warning.
    """
    import warnings

    from quillspark.operators.order import number

    placed = number(sentences, [order] if isinstance(order, str) else order, row)
    lacking = placed.join(vectors, row, "left_anti").count()
    if lacking:
        raise ValueError(f"{lacking} sentences have no vector")
    over = vectors.join(placed, row, "left_anti").count()
    if over:
        warnings.warn(f"{over} vectors have no sentence and are ignored", stacklevel=2)
    return placed.join(vectors, row)
