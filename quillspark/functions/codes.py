"""Column functions on code tuples: their texts, tokens and prompts, and the deterministic hash split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def codes_to_text(codes: Column) -> Column:
    """``c0=5 c1=12`` of [5, 12]."""
    return F.array_join(F.transform(codes, lambda c, i: F.concat(F.lit("c"), i.cast("string"), F.lit("="), c.cast("string"))), " ")


def codes_to_special(codes: Column, v: int) -> Column:
    """``<c0_05> <c1_12>``, padded to the width of v - 1; longer values are not cut."""
    form = f"<c%d_%0{len(str(v - 1))}d>"
    return F.array_join(F.transform(codes, lambda c, i: F.format_string(form, i, c)), " ")


def parse_codes(text: Column) -> Column:
    """The values after ``=`` of the words of a code text; words without a number there are skipped."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w.contains("="))
    return F.array_compact(F.transform(words, lambda w: F.try_element_at(F.split(w, "="), F.lit(2)).try_cast("int")))


def code_tokens(spark: SparkSession, k: int, v: int) -> DataFrame:
    """(k, v, token) of the whole code vocabulary, k-major."""
    width = len(str(v - 1))
    return spark.range(k * v).select(F.expr(f"cast(id div {v} as int)").alias("k"), F.expr(f"cast(id % {v} as int)").alias("v")).withColumn("token", F.format_string(f"<c%d_%0{width}d>", "k", "v"))


def format_prompt(ctx: Column, codes: Column, mode: str = "special", v: int = 1024) -> Column:
    ask = F.lit("\nWrite exactly one next sentence:")
    if mode == "none":
        return F.concat(F.lit("CTX: "), ctx, ask)
    if mode not in ("text", "special"):
        raise ValueError(f"no such code mode: {mode}")
    text = codes_to_text(codes) if mode == "text" else codes_to_special(codes, v)
    return F.concat(F.lit("CTX: "), ctx, F.lit("\nCODES: "), text, ask)


def is_val(key: Column, fraction: float = 0.05, seed: int = 0) -> Column:
    """Whether a key falls into the validation part: by CRC-32 of ``seed|key``, so it depends on nothing else."""
    if fraction <= 0 or fraction >= 1:
        return F.lit(fraction >= 1)
    return F.crc32(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")) < F.lit(int(fraction * 2**32))


def match_score(a: Column, b: Column) -> Column:
    """How many places of two code tuples agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def first_id(*columns: Column) -> Column:
    """The first that is set and neither the number 0 nor the empty string; the string "0" is an id."""
    return F.coalesce(*[F.when(F.when(F.typeof(c) == "string", c.cast("string") != "").otherwise(c.try_cast("double") != 0), c.cast("string")) for c in columns])


def pad_left(items: Column, n: int = 6) -> Column:
    """The last n items, filled up on the left by the first of these; null if there are none."""
    last = F.when(F.size(items) > n, F.slice(items, F.size(items) - n + 1, F.lit(n))).otherwise(items)
    return F.when(F.size(items) > 0, F.concat(F.array_repeat(F.element_at(last, 1), n - F.size(last)), last))
