"""Seeded order, splits, samples, ratio mixes and quotas.

All orders are by ``md5(seed|key)``: they depend on nothing but seed and key, so a lost executor changes nothing, and other
engines can repeat them. Where a rank over all rows is needed, rows fall into 4096 buckets by the first digits of the
hash, ranks within a bucket are by its own order, and a bucket's first rank comes from the bucket sizes: no task orders
all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.order import FEW, before, nth_place, number


def place(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def ranked(rows: DataFrame, key: str, seed: int, out: str = "rank") -> DataFrame:
    """``rows`` with their rank, from 1, in the seeded order of key."""
    rows = rows.withColumn("__place", place(seed, F.col(key))).withColumn("__bucket", F.substring("__place", 1, 3))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).select("__bucket", before.alias("__before"))  # at most 4096 rows
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy("__place", key))
    return rows.withColumn("__own", own).join(F.broadcast(sizes), "__bucket").withColumn(out, F.col("__before") + F.col("__own")).drop("__place", "__bucket", "__own", "__before")


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in the seeded order (a range-partitioned sort)."""
    return rows.orderBy(place(seed, F.col(key)), key)


def head(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key; all if n is not positive. Beyond some thousands, rows are numbered, so no task gathers n."""
    if n <= 0:
        return rows
    return rows.orderBy(key).limit(n) if n <= FEW else number(rows, [key], "__no").filter(F.col("__no") < n).drop("__no")


def positional_split(rows: DataFrame, key: str, fraction: float = 0.98, seed: int = 0) -> DataFrame:
    """``rows`` with is_train: the first floor(n * fraction) in the seeded order."""
    total = rows.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("__train"))
    return ranked(rows, key, seed).crossJoin(F.broadcast(total)).withColumn("is_train", F.col("rank") <= F.col("__train")).drop("__train", "rank")


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: those first in the seeded order. The place of the n-th is found by counts, so taking
    them is a filter, without a shuffle. If rows of one key straddle the end, any of them are taken. Null keys come first
    of those with their place.
    """
    if n <= 0:
        return rows.limit(0)
    at = place(seed, F.col(key))
    found = nth_place(rows, at, key, n)
    if found is None:
        return rows
    p, k = found
    ahead = (F.col(key).isNull() | (F.col(key) < F.lit(k))) if k is not None else F.lit(False)
    low = (at < p) | ((at == p) & ahead)
    same = (at == p) & F.col(key).eqNullSafe(F.lit(k))
    told = rows.agg(F.count(F.when(low, 1)).alias("low"), F.count(F.when(same, 1)).alias("same")).first()
    if told.low + told.same == n:
        return rows.filter(low | same)
    return rows.filter(low).unionByName(rows.filter(same).limit(n - told.low))


def weighted_count(n_a: int, n_b: int, weight: float) -> int:
    """How many rows of b to add to n_a rows so that they are ``weight`` of all, cut to a whole number and to n_b."""
    return min(int(n_a * weight / max(1e-9, 1.0 - weight)), n_b)


def ratio_count(n_base: int, ratio: float) -> int:
    """The same, rounded to the nearest (halves to even)."""
    if not 0.0 <= ratio < 1.0:
        raise ValueError(f"the ratio must be in [0, 1), not {ratio}")
    return round(n_base * ratio / max(1e-9, 1.0 - ratio))


def quotas(total: int, a: float, b: float) -> tuple[int, int]:
    """Rows of two sources by fractions (halves if these don't add up to more than 0); 0 means none."""
    if a + b <= 0:
        a = b = 0.5
    first = round(total * (a / (a + b)))
    return first, total - first


def ratio_mix(base: DataFrame, aux: DataFrame | None, base_key: str, aux_key: str, ratio: float = 0.3, seed: int = 0, max_rows: int = -1) -> DataFrame:
    """All base rows and a sample of aux rows, interleaved evenly, each kind in its own order: (slot, kind, key).

    Only the first max_rows base rows, by key, are taken if that is positive; the ratio holds for these.

    Of all slots, those first in the seeded order are for aux rows; the i-th aux slot gets the i-th chosen aux row. Slots
    are dense, so their numbers among those of a kind are sums over ranges.
    """
    base = _ordinal(base.select(F.col(base_key).alias("key")), "key")
    base = base.filter(F.col("ordinal") <= max_rows) if max_rows > 0 else base
    n = base.count()
    k = min(ratio_count(n, ratio), aux.count()) if aux is not None else 0
    if not k:
        return base.select((F.col("ordinal") - 1).alias("slot"), F.lit("base").alias("kind"), "key")
    slots = base.sparkSession.range(n + k).withColumnRenamed("id", "slot")
    at = place(seed, F.col("slot"))
    p, s = nth_place(slots, at, "slot", k)
    slots = slots.withColumns({"__aux": ((at < p) | ((at == p) & (F.col("slot") <= s))).cast("long"), "__part": F.floor(F.col("slot") / 100_000)})
    ahead = before(slots.groupBy("__part").agg(F.sum("__aux").alias("n")), "__part", "n", "__before").select("__part", "__before")
    so_far = F.sum("__aux").over(Window.partitionBy("__part").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("__own", so_far).join(ahead, "__part").withColumn("__n", F.col("__before") + F.col("__own"))
    slots = slots.select("slot", F.when(F.col("__aux") == 1, "aux").otherwise("base").alias("kind"), F.when(F.col("__aux") == 1, F.col("__n")).otherwise(F.col("slot") + 1 - F.col("__n")).alias("ordinal"))
    chosen = _ordinal(sample(aux.select(F.col(aux_key).alias("key")), "key", k, seed), "key")
    both = base.withColumn("kind", F.lit("base")).unionByName(chosen.withColumn("kind", F.lit("aux")))
    return slots.join(both, ["kind", "ordinal"]).select("slot", "kind", "key")


def _ordinal(rows: DataFrame, key: str) -> DataFrame:
    return number(rows, [key], "ordinal").withColumn("ordinal", F.col("ordinal") + 1)


def select_ordinals(rows: DataFrame, key: str, ordinals: DataFrame) -> DataFrame:
    """The rows whose ordinal (from 0, by key) is in ``ordinals(ordinal)``, in order."""
    numbered = _ordinal(rows, key).withColumn("ordinal", F.col("ordinal") - 1)
    return numbered.join(ordinals, "ordinal", "left_semi")


def first_best(rows: DataFrame, group: list[str], score: str, order: str) -> DataFrame:
    """Of each group the row with the greatest score, the earliest of equals; null scores come last."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(score), order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def dedup_questions(rows: DataFrame, question: str, order: list[str]) -> DataFrame:
    """One row of each lower-cased question, the first by order. Only the winner of a task is shuffled."""
    key = F.lower(question)
    return rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def union_sources(**sources: DataFrame) -> DataFrame:
    """All rows of the sources with their name in ``source``."""
    out = None
    for name, rows in sources.items():
        rows = rows.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
