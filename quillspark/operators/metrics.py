"""Accuracy, perplexity and agreement of predicted code tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def head_accuracy(rows: DataFrame, pred: str = "pred_codes", tgt: str = "tgt_codes") -> DataFrame:
    """(head, head_acc) of each place of the tuple."""
    each = rows.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(tgt).alias("t"))).alias("head", "x"))
    return each.groupBy("head").agg(F.avg((F.col("x.p") == F.col("x.t")).cast("double")).alias("head_acc"))


def tuple_accuracy(rows: DataFrame, pred: str = "pred_codes", tgt: str = "tgt_codes") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), (F.count_if(F.col(pred) == F.col(tgt)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("tuple_acc"))


def perplexity(rows: DataFrame, p: str = "p") -> DataFrame:
    """One row of avg_ce and perplexity from the probabilities of all heads (infinite from 50 on)."""
    each = rows.select(F.explode(p).alias("p"))
    ce = each.agg(F.coalesce(-F.avg(F.log("p")), F.lit(0.0)).alias("avg_ce"))
    return ce.withColumn("perplexity", F.when(F.col("avg_ce") < 50, F.exp("avg_ce")).otherwise(F.lit(float("inf"))))


def agreement(rows: DataFrame, pred: str = "pred_codes", gen: str = "gen_codes") -> DataFrame:
    """One row: total, skipped (rows without predicted codes), head_match and tuple_match as shares."""
    ok = F.col(pred).isNotNull() & F.col(gen).isNotNull()
    heads = F.aggregate(F.zip_with(pred, gen, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    total = F.count_if(ok)
    return rows.agg(
        total.alias("total"), F.count_if(~ok).alias("skipped"), F.coalesce(F.sum(F.when(ok, heads)) / F.greatest(F.sum(F.when(ok, F.size(pred))), F.lit(1)), F.lit(0.0)).alias("head_match"),
        (F.count_if(ok & (F.col(pred) == F.col(gen))) / F.greatest(total, F.lit(1))).alias("tuple_match"),
    )


def split_report(rows: DataFrame, is_val: str, ctx: str, tgt: str) -> DataFrame:
    """One row: rows of each part and mean characters of contexts and targets (0 of none)."""
    return rows.agg(
        F.count_if(~F.col(is_val)).alias("train"), F.count_if(F.col(is_val)).alias("val"),
        F.coalesce(F.avg(F.length(ctx)), F.lit(0.0)).alias("mean_ctx_chars"), F.coalesce(F.avg(F.length(tgt)), F.lit(0.0)).alias("mean_tgt_chars"),
    )


def stage_counters(docs: DataFrame, most_chars: int = 200_000) -> DataFrame:
    """One row: documents seen, empty (or blank), too long and written."""
    text = F.coalesce("text", F.lit(""))
    blank = T.strip(text) == ""
    long = ~blank & (F.length(text) > most_chars) if most_chars > 0 else F.lit(False)
    return docs.agg(F.count(F.lit(1)).alias("seen"), F.count_if(blank).alias("empty"), F.count_if(long).alias("too_long"), F.count_if(~blank & ~long).alias("written"))
