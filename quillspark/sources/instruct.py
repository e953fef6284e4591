"""Instruction sets pulled from several hubs by quotas.

Every (source, split) has a quota and a seeded order of its own. Of each, the rows up to the one that fills the quota are
read, and of these the ones with usable messages are taken. Where that row is comes from counts by the first digits of
places, for all sources at once; then taking is one filter over all rows, without a shuffle, and the counters of what was
read and dropped come from the same filter.

A quota of 0 takes nothing; a source with fewer usable rows is taken whole. A source without a split of its own is split by
the hash of its keys, so no row is in both parts. Null messages are unusable; rows with a null key, or one that is there
already, are rows like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.codes import is_val
from quillspark.operators.order import nth_places
from quillspark.operators.sample import place, quotas


@dataclass(frozen=True)
class Hub:
    """Rows with a key, the array of (role, content) that a normaliser made of them (null: unusable), and perhaps a split."""

    rows: DataFrame
    key: str
    messages: Column
    split: Column | None = None  # "train" or "val"


def gathered(hubs: dict[str, Hub], val_fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """(source, split, key, messages) of all rows of all hubs; keys as texts."""
    out = None
    for name, hub in hubs.items():
        key = F.col(hub.key).cast("string")
        split = hub.split if hub.split is not None else F.when(is_val(key, val_fraction, seed), "val").otherwise("train")
        rows = hub.rows.select(F.lit(name).alias("source"), split.alias("split"), key.alias("key"), hub.messages.alias("messages"))
        out = rows if out is None else out.unionByName(rows)
    return out


def plan_quotas(names: tuple[str, str], train: int, val: int, fractions: tuple[float, float]) -> dict[tuple[str, str], int]:
    """Rows of each (source, split) of two sources by their fractions."""
    return {(name, split): n for split, total in (("train", train), ("val", val)) for name, n in zip(names, quotas(total, *fractions), strict=True)}


def read_rows(rows: DataFrame, wanted: dict[tuple[str, str], int], seed: int = 0) -> DataFrame:
    """``rows`` (source, split, key, messages) that are read to fill the quotas, with ``usable``. Of rows that share the
    place of a last one, all are read; pulled() takes exactly the quota of them.
    """
    group = F.concat_ws("|", "source", "split")
    at = F.lit(None).cast("string")
    for offset, (source, split) in enumerate(wanted):
        at = F.when(group == f"{source}|{split}", place(seed + offset, F.col("key"))).otherwise(at)
    rows = rows.withColumns({"usable": F.coalesce(F.size("messages") > 0, F.lit(False)), "__group": group, "__place": at}).filter("__place is not null")
    ends = nth_places(rows.filter("usable"), F.col("__group"), F.col("__place"), F.col("key"), {"|".join(g): n for g, n in wanted.items()})
    read = F.lit(False)
    for g, n in wanted.items():
        name = "|".join(g)
        if n > 0:
            read = read | ((F.col("__group") == name) & ((F.col("__place") <= ends[name][0]) if ends[name] else F.lit(True)))
    return rows.filter(read).drop("__group")


def pulled(rows: DataFrame, wanted: dict[tuple[str, str], int], seed: int = 0) -> DataFrame:
    """(source, split, key, messages): of each (source, split) in ``wanted`` exactly its quota of usable rows, if it has so many."""
    read = read_rows(rows, wanted, seed).filter("usable")
    have = {(r.source, r.split): r.n for r in read.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = read
    for g, n in wanted.items():
        if n > 0 and have.get(g, 0) > n:  # several rows share the last place, as they have one key
            own = (F.col("source") == g[0]) & (F.col("split") == g[1])
            last = read.filter(own).agg(F.max("__place")).first()[0]
            tied = read.filter(own & (F.col("__place") == last))
            out = out.filter(~(own & (F.col("__place") == last))).unionByName(tied.limit(n - (have[g] - tied.count())))
    return out.select("source", "split", "key", "messages")


def pull_counters(rows: DataFrame, wanted: dict[tuple[str, str], int], seed: int = 0) -> DataFrame:
    """(source, split, rows_in, rows_out, rows_dropped) of the sources that have any rows to read."""
    read = read_rows(rows, wanted, seed)
    return read.groupBy("source", "split").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if("usable").alias("rows_out"), F.count_if(~F.col("usable")).alias("rows_dropped"))
