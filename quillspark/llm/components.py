"""Connected components over links, as DataFrame operations; nothing comes to the driver but one flag a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that can be reached, for each node of ``links`` (nulls and loops are left out).

    Alternates large-star and small-star steps: each hangs neighbours under the least node they know, until nothing
    changes. Links are written after each round to the shared folder. Rounds grow with the logarithm of the longest
    path. A node with very many links is a sum over its links (a minimum, combined before the shuffle).
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges = materialise(edges)
    known = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        # large star: every larger neighbour of u goes under the least one that u knows
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct())
        # small star: u and its smaller neighbours go under the least of these
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialise(small.filter("u <> v").distinct())
        before, known = known, _checksum(new)
        if before == known:
            roots = new.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        edges = new


def _checksum(edges: DataFrame) -> tuple:
    """Number of distinct links, and a sum and an exclusive or of their hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())
