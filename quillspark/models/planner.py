"""Stand-ins for neural parts, behind the interfaces they would use.

The planner predicts the next code tuple from counts, the encoder hashes words into a vector, and the generator (``generation``) looks up
sentences whose codes match best. A neural encoder or generator is any object with the same method.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Unit vectors of signed word hashes, pooled by the mean over words."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            words = t.lower().split()
            for w in words:
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1 if h & (1 << 31) else -1
            out[i] /= max(len(words), 1e-6)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of (batch, token, d) over tokens that count, made unit."""
    total = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-6)
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def embed(rows: DataFrame, text: str, encoder: Encoder, out: str = "embedding", batch: int = 128) -> DataFrame:
    """``rows`` with the encoder's vector of each text; the encoder is sent once to each worker."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            parts = [shared.value.encode([t or "" for t in s.iloc[i : i + batch]]) for i in range(0, len(s), batch)]
            yield pd.Series([v for p in parts for v in p], index=s.index)

    return rows.withColumn(out, run(F.col(text)))


def encoded_contexts(sentences: DataFrame, encoder: Encoder, book: np.ndarray, n: int = 6) -> DataFrame:
    """The older form of training rows with codes made on the way: (doc_id, sent_id, ctx_codes, tgt_codes, ctx_text, tgt_text)."""
    from quillspark.operators import rvq, windows

    coded = rvq.encode(embed(windows.named_sentences(sentences), "text", encoder), "embedding", book)
    made = windows.sliding(coded.drop("embedding"), "doc_id", "sent_id", {"text": "ctx", "codes": "ctx_codes"}, n)
    return made.select("doc_id", "sent_id", F.flatten("ctx_codes").alias("ctx_codes"), F.col("codes").alias("tgt_codes"), F.array_join("ctx", " ").alias("ctx_text"), F.col("text").alias("tgt_text"))


def count_planner(rows: DataFrame, k: int) -> DataFrame:
    """(head, ctx, pred, p): for each head the likeliest next code after its last context code; ctx null: after any.

    rows: ctx_codes, tgt_codes. Equal counts give the lower code.
    """
    each = rows.select(F.posexplode(F.arrays_zip(F.slice("ctx_codes", F.size("ctx_codes") - k + 1, F.lit(k)).alias("c"), F.col("tgt_codes").alias("t"))).alias("head", "x"))
    each = each.select("head", F.col("x.c").alias("ctx"), F.col("x.t").alias("code"))
    counts = each.groupBy("head", "ctx", "code").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(counts.groupBy("head", "code").agg(F.sum("n").alias("n")).withColumn("ctx", F.lit(None).cast("int")))
    total = F.sum("n").over(Window.partitionBy("head", "ctx"))
    best = F.row_number().over(Window.partitionBy("head", "ctx").orderBy(F.desc("n"), "code"))
    return counts.select("head", "ctx", F.col("code").alias("pred"), (F.col("n") / total).alias("p"), best.alias("b")).filter("b = 1").drop("b")


def plan(rows: DataFrame, planner: DataFrame, key: str, k: int) -> DataFrame:
    """(key, pred_codes) for rows with ctx_codes; unseen contexts take the head's likeliest code."""
    each = rows.select(key, F.posexplode(F.slice("ctx_codes", F.size("ctx_codes") - k + 1, F.lit(k))).alias("head", "ctx"))
    seen = planner.filter("ctx is not null").select("head", "ctx", "pred")
    any_ctx = planner.filter("ctx is null").select("head", F.col("pred").alias("default"))  # k rows
    found = each.join(seen, ["head", "ctx"], "left").join(F.broadcast(any_ctx), "head").withColumn("pred", F.coalesce("pred", "default"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("head", "pred"))), lambda x: x["pred"]).alias("pred_codes"))


def tokenize(rows: DataFrame, text: str, path: str, max_length: int, out: str = "input_ids") -> DataFrame:
    """``rows`` with ids of a tokenizer file, at most max_length of them (a parameter of the model, 0 for all)."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        for s in batches:
            ids = [e.ids for e in model.encode_batch([t or "" for t in s], add_special_tokens=False)]
            yield pd.Series([i[:max_length] if max_length > 0 else i for i in ids], index=s.index)

    return rows.withColumn(out, run(F.col(text)))


def missing_code_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """Code tokens that are not single tokens of a tokenizer: (token, pieces)."""
    return tokenize(tokens, "token", path, 0, "ids").select("token", F.size("ids").alias("pieces")).filter("pieces <> 1")
