"""Exact dedup by two-pass Bloom filtering. DataFrame operations only.

Pass 1 reads hashes of the normalised texts into a Bloom filter of 64-bit blocks that remembers which cells were hit
more than once. Pass 2 asks it for each row: a hash with all its cells hit once is unique for certain, and its row goes
straight through; only the others are grouped by SHA-256 and compared. The filter has no false negatives, so results do
not depend on its size; false positives only move a few more rows.

Each block is the result of ``bit_or``, ``bit_xor`` and ``count``, which Spark combines before the shuffle, so a text
that a third of all rows share is one row per task. The number of blocks follows the number of rows, four rows a block at
any size. Up to ``max_blocks`` blocks are broadcast. A larger filter stays where it is, in shards: hashes alone (8 bytes a
row) go to the blocks of their first probe, those that may be repeated there to the blocks of their second, and the few
that are left are counted. Repeated hashes come back as a list, broadcast if it is short.

Nulls: a null text is the empty text. A null doc_id comes after all others. Of rows that agree in text and doc_id, one
stays. Texts of any length are taken whole. Empty tables give empty results. Extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import free_name, materialise, read_table, squeeze

PROBES = 2
ROWS_PER_BLOCK = 4
MAX_BLOCKS = 1 << 20
#: Repeated hashes that may be broadcast.
SMALL = 1_000_000


def _place(h, probe: int, n_blocks: int):
    """Block and one-bit mask of a hash for one probe."""
    x = F.xxhash64(h, F.lit(probe))
    return F.pmod(x, F.lit(n_blocks)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x, F.lit(-1)), F.lit(64)).cast("int"))


def repeat_filter(df: DataFrame, hash_col: str, n_blocks: int) -> DataFrame:
    """Pass 1: (probe, block, repeated) with a set bit in ``repeated`` for each cell that two rows or more may share.

    In a block with n rows, ``seen`` has a bit for each cell hit and ``odd`` for each hit an odd number of times. Cells in
    ``seen`` but not in ``odd`` were hit twice or more. If these account for all of n, no other cell was; else any may be.
    """
    places = F.explode(F.array(*[F.struct(F.lit(p).alias("probe"), b.alias("block"), m.alias("bit")) for p in range(PROBES) for b, m in [_place(F.col(hash_col), p, n_blocks)]]))
    hit = df.select(places.alias("at")).select("at.*")
    blocks = hit.groupBy("probe", "block").agg(F.bit_or("bit").alias("seen"), F.bit_xor("bit").alias("odd"), F.count(F.lit(1)).alias("n"))
    even = F.col("seen").bitwiseAND(F.bitwise_not("odd"))
    all_told = F.bit_count("seen") + F.bit_count(even) == F.col("n")
    return blocks.select("probe", "block", F.when(all_told, even).otherwise(F.col("seen")).alias("repeated")).filter("repeated <> 0")


def possibly_repeated(df: DataFrame, hash_col: str, out: str, hashes: DataFrame | None = None, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``df`` with a boolean column ``out``: false only where no other row of ``hashes`` (default: df) has that hash."""
    hashes = df if hashes is None else hashes
    n_blocks = max(1024, hashes.count() // ROWS_PER_BLOCK)
    found = materialise(repeat_filter(hashes, hash_col, n_blocks))
    if n_blocks > max_blocks:
        return _by_shards(df, hash_col, out, hashes, found, n_blocks)
    maybe = F.lit(True)
    drop = []
    for p in range(PROBES):
        block, bit = _place(F.col(hash_col), p, n_blocks)
        key, mask = free_name(df, f"block_{p}"), free_name(df, f"mask_{p}")
        # at most max_blocks rows of two longs, whatever the input
        side = found.filter(F.col("probe") == p).select(F.col("block").alias(key), F.col("repeated").alias(mask))
        df = df.withColumn(key, block).join(F.broadcast(side), key, "left")
        maybe = maybe & (F.coalesce(F.col(mask), F.lit(0).cast("long")).bitwiseAND(bit) != 0)
        drop += [key, mask]
    return df.withColumn(out, maybe).drop(*drop)


def _by_shards(df: DataFrame, hash_col: str, out: str, hashes: DataFrame, found: DataFrame, n_blocks: int) -> DataFrame:
    """possibly_repeated() for a filter too large to broadcast. Both joins have plain exchanges, so Spark splits
    the rows of a hash that very many have; the count is combined in each task.
    """
    rows = hashes.select(F.col(hash_col).alias("h"))
    for p in range(PROBES):
        block, bit = _place(F.col("h"), p, n_blocks)
        side = found.filter(F.col("probe") == p).select("block", "repeated")
        rows = rows.withColumns({"block": block, "bit": bit}).join(side, "block").filter(F.col("repeated").bitwiseAND(F.col("bit")) != 0).select("h")
    repeated = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("h").alias(free_name(df, "repeated_hash"))))
    key = repeated.columns[0]
    side = repeated.withColumn(out, F.lit(True))
    if repeated.count() <= SMALL:
        side = F.broadcast(side)
    return df.join(side, F.col(hash_col) == F.col(key), "left").withColumn(out, F.coalesce(F.col(out), F.lit(False))).drop(key)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    text = squeeze(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h"))
    keys = materialise(rows.withColumn("row_no", F.monotonically_increasing_id()))
    flagged = possibly_repeated(keys, "h", "maybe")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("row"))).alias("first")
    groups = flagged.filter("maybe").groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialise(groups.select("text_sha256", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("n").alias("group_size")))
    alone = flagged.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shared = flagged.filter("maybe").join(groups, "text_sha256", "left")
    own = F.col("group_size").isNull()
    shared = shared.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (own | (F.col("row_no") == F.col("keep_row"))).alias("kept"), "text_sha256"
    )
    return alone.unionByName(shared)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the smallest id. Columns stay as they are.

    Rows whose hash is unique are passed through without a shuffle. Of the others, each task first keeps one row a text.
    """
    h, sha, maybe, row = (free_name(docs, x) for x in ("text_hash", "text_sha256", "maybe", "kept_row"))
    text = squeeze(F.col(text_col))
    hashed = docs.withColumn(h, F.xxhash64(text))
    flagged = possibly_repeated(hashed, h, maybe, hashed.select(h))
    alone = flagged.filter(~F.col(maybe)).select(*docs.columns)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col))  # the last: of texts with one id always the same one
    shared = flagged.filter(maybe).withColumn(sha, F.sha2(text, 256)).groupBy(sha).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return alone.unionByName(shared.select(f"{row}.*"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
