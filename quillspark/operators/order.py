"""Order over whole tables: numbers without gaps, what stands before a range, the first n in a seeded order.

Rows are numbered by ranges of all their keys, so rows that share a first key are no single task's work. The sorted rows
are written once: range bounds come from samples, and a second evaluation could draw others.

What is carried from range to range (sums, maxima, last values) goes through two levels, so that the table of ranges is
not one task's work either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.tables import written

#: Ranges that one task carries values over.
LEVEL = 4096
#: Rows of a bucket that may be sorted on the driver, two columns each.
FEW = 10_000


def number(rows: DataFrame, keys: list[str], out: str, parts: int | None = None) -> DataFrame:
    """``rows`` numbered from 0 by keys (nulls first), without gaps. Rows that agree in all keys come in any order."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in its partition
    placed = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"__part": F.spark_partition_id(), "__own": own}))
    sizes = before(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__part", "__n", "__before")
    return placed.join(F.broadcast(sizes.select("__part", "__before")), "__part").withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")  # a row per partition


def before(parts: DataFrame, order: str, value: str, out: str, how: str = "sum") -> DataFrame:
    """``parts`` (one row for each number of ``order``) with the sum, greatest or last value (that isn't null) before each."""
    made = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    rows = parts.withColumn("__group", F.floor(F.col(order) / LEVEL))
    here = made(value).over(Window.partitionBy("__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    whole = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))) if how == "last" else made(value)
    groups = rows.groupBy("__group").agg(whole.alias("__v"))
    groups = groups.select("__group", made("__v").over(Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)).alias("__ahead"))
    rows = rows.withColumn("__here", here).join(groups, "__group")
    joined = {"sum": F.coalesce("__here", F.lit(0)) + F.coalesce("__ahead", F.lit(0)), "max": F.greatest("__here", "__ahead"), "last": F.coalesce("__here", "__ahead")}[how]
    return rows.withColumn(out, joined).drop("__group", "__here", "__ahead")


def nth_place(rows: DataFrame, place: Column, key: str, n: int) -> tuple[str, object] | None:
    """The place and key of the n-th row by hexadecimal place, then key; None if there are fewer."""
    return nth_places(rows, F.lit(0), place, F.col(key), {0: n})[0]


def nth_places(rows: DataFrame, group: Column, place: Column, key: Column, wanted: dict) -> dict:
    """For each group, the place and key of its n-th row by hexadecimal place, then key; None where there are fewer.

    Counts by the next three digits find the bucket that has it, for all groups in one pass, and again inside these
    buckets until they hold few rows. Groups are few: their counts, at most 4096 each a pass, are collected.
    """
    rows = rows.select(group.alias("g"), place.alias("p"), key.alias("k"))
    out = {g: None for g in wanted}
    open_ = {g: ("", n) for g, n in wanted.items() if n > 0}
    ends: dict = {}

    def inside(at: dict) -> DataFrame:
        found = F.lit(False)
        for g, (prefix, _) in at.items():
            found = found | (F.col("g").eqNullSafe(F.lit(g)) & F.col("p").startswith(prefix))
        return rows.filter(found)

    def in_order(x):
        return x.k is not None, x.k

    while open_:
        digits = len(next(iter(open_.values()))[0])
        if digits >= 32:  # very many rows of one place: of one key, but for clashes
            found = inside(open_).groupBy("g", "k").agg(F.count(F.lit(1)).alias("n")).collect()
            for g, (prefix, left) in open_.items():
                for x in sorted((x for x in found if x.g == g), key=in_order):
                    if left <= x.n:
                        out[g] = prefix, x.k
                        break
                    left -= x.n
            break
        sizes = inside(open_).groupBy("g", F.substring("p", digits + 1, 3).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        following = {}
        for g, (prefix, left) in open_.items():
            for r in sorted((r for r in sizes if r.g == g), key=lambda r: r.d):
                if left <= r.n:
                    (ends if r.n <= FEW else following)[g] = (prefix + r.d, left)
                    break
                left -= r.n
        open_ = following
    if ends:
        found = inside(ends).collect()  # at most FEW a group
        for g, (_, left) in ends.items():
            x = sorted((x for x in found if x.g == g), key=lambda x: (x.p, *in_order(x)))[left - 1]
            out[g] = x.p, x.k
    return out


def first_rows(rows: DataFrame, order: str, n: int, width: int = 100_000) -> DataFrame:
    """The first n rows by ``order``, whole numbers of which each has one row at most. No task gathers them all: counts of
    ranges tell which range has the last one, and only that one is ordered.
    """
    rows = rows.withColumn("__part", F.floor(F.col(order) / width))
    sizes = before(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__part", "__n", "__before").filter(F.col("__before") < n)
    own = F.when(F.col("__before") + F.col("__n") > n, F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    return rows.join(sizes, "__part").withColumn("__own", own).filter(F.col("__own").isNull() | (F.col("__own") <= n - F.col("__before"))).drop("__part", "__n", "__before", "__own")
