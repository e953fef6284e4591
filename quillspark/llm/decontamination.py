"""Benchmark decontamination. DataFrame operations only.

Test items are cut into windows of ``WINDOW`` consecutive normalised words (one window of all words where an item has
fewer). The hashes of all windows are broadcast; each training text's windows are hashed where the text is read and looked
up, and a hit is verified by comparing the words themselves. Only hits leave the task: they are known by two 64-bit
hashes of their text, so equal texts are one row after the map side, whatever their number. A text's hits are merged into
spans of words, and go back to the rows that hold the text.

The broadcast is measured first. Beyond ``BROADCAST_BYTES`` the windows of texts meet those of items by a shuffled join,
which adaptive execution splits where a window is very common; results are the same.

Nulls: a null text or item has no words. A null item id is the empty id. Texts are taken whole. Repeated rows are judged
alike; items that share an id count once. An empty benchmark hits nothing; empty tables give empty results. Extra columns
pass through, and names of new columns give way to those that are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import free_name, materialise, read_table

WINDOW = 10
#: What may be broadcast: windows with their words and items; results of texts.
BROADCAST_BYTES = 64 << 20
SMALL = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything but 0-9, a-z and what isn't ASCII; the second form takes A-Z for letters, too.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[0-9A-Za-z[^\x00-\x7F]]+"
TAIL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$"


def with_words(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array of its lower-cased words."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), SEPARATORS)
    col = F.col(out)
    first, size = (F.get(col, F.lit(0)) == "").cast("int"), F.size(col)
    last = ((size > 1) & (F.get(col, size - 1) == "")).cast("int")
    return df.withColumn(out, parts).withColumn(out, F.slice(col, first + 1, size - first - last))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, len, gram, items): each distinct window, with the ids of the items that have it."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    rows = with_words(benchmark.select(item.alias("item"), "text"), "text", "words").filter(F.size("words") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))).alias("at")
    cut = F.slice("words", F.col("at"), window)
    grams = rows.select("item", "words", at).select("item", F.xxhash64(cut).alias("h"), F.size(cut).alias("len"), F.array_join(cut, " ").alias("gram"))
    return grams.groupBy("h", "len", "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, windows: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(t1, t2: hashes of the text, start: first word, from 1, len, items) of each verified window of each text."""
    held = windows.agg(F.sum(F.octet_length("gram") + 64 * (2 + F.size("items"))).alias("bytes"), F.collect_set("len").alias("lens")).first()
    lens = sorted(held["lens"])  # of whole windows and of items shorter than one
    rows = with_words(docs.select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(text).alias("text")), "text", "words").drop("text")
    # Outer explosions, for inferred filters on the array would split each text again below the projection. Texts without
    # windows give a row without a start, whose null slice hits nothing.
    n = F.size("words")
    if len(lens) <= 1:
        size = F.lit(lens[0] if lens else WINDOW)
        rows = rows.select("t1", "t2", "words", F.explode_outer(F.when(n >= size, F.sequence(F.lit(1), n - (size - 1)))).alias("start")).withColumn("len", size)
    else:
        rows = rows.select("t1", "t2", "words", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n))).alias("start"))
        sizes = F.filter(F.array(*[F.lit(x) for x in lens]), lambda x: F.col("start") + x <= F.size("words") + 1)
        rows = rows.select("t1", "t2", "words", "start", F.explode_outer(sizes).alias("len"))
    cut = F.slice("words", F.col("start"), F.col("len"))
    rows, text = rows.withColumn("h", F.xxhash64(cut)), F.array_join(cut, " ")
    if (held["bytes"] or 0) <= broadcast_bytes:
        # each starts with the other: not an equality, which would become a key of the join and join the words of all windows
        same = F.col("gram").startswith(text) & text.startswith(F.col("gram"))
        found = rows.join(F.broadcast(windows.drop("len")), (rows["h"] == windows["h"]) & same)
    else:
        found = rows.filter("start is not null").select("t1", "t2", "start", "len", "h", text.alias("gram")).join(windows, ["h", "len", "gram"])
    return found.select("t1", "t2", "start", "len", "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per contaminated text: t1, t2 (its hashes), spans (array of start and end, words from 1, end excluded,
    sorted, apart from each other), n_hit (words in spans), items (sorted ids). Written to the shared folder.
    """
    windows = materialise(item_windows(benchmark, window))
    found = hits(docs, windows, text, broadcast_bytes).groupBy("t1", "t2", "start").agg(F.max("len").alias("len"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    own = Window.partitionBy("t1", "t2").orderBy("start")
    reach = F.max(F.col("start") + F.col("len")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(own))
    spans = found.groupBy("t1", "t2", "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    out = spans.groupBy("t1", "t2").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return materialise(out)


def _meet(docs: DataFrame, side: DataFrame, names: tuple[str, str], how: str, array: str | None = None) -> DataFrame:
    """Rows meet what was found of their texts: broadcast where its rows and the entries of ``array`` are few, else by a
    shuffled join, whose very common texts adaptive execution splits.
    """
    held = side.agg(F.count(F.lit(1)).alias("rows"), (F.sum(F.size(array)) if array else F.lit(0)).alias("entries")).first()
    small = held["rows"] <= SMALL and (held["entries"] or 0) <= 10 * SMALL
    return docs.join(F.broadcast(side) if small else side, list(names), how)


def _hashed(docs: DataFrame, t1: str, t2: str) -> DataFrame:
    return docs.withColumns({t1: F.xxhash64("text"), t2: F.xxhash64(F.lit(1), F.col("text"))})


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids) and contaminated (new names where these are taken)."""
    t1, t2 = (free_name(docs, x) for x in ("text_hash_1", "text_hash_2"))
    n_words, n_hit, n_items, items, flag, words = (free_name(docs, x) for x in ("n_words", "n_hit", "n_items", "items", "contaminated", "words"))
    side = contaminated(docs, benchmark, **settings).select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("n_hit").alias(n_hit), F.col("items").alias(items))
    rows = with_words(_hashed(docs, t1, t2), "text", words)
    rows = rows.withColumn(n_words, F.size(words).cast("long")).drop(words)
    out = _meet(rows, side, (t1, t2), "left", items).withColumns({n_hit: F.coalesce(F.col(n_hit), F.lit(0).cast("long")), items: F.coalesce(F.col(items), F.array().cast("array<string>"))})
    return out.withColumns({n_items: F.size(items).cast("long"), flag: F.col(n_hit) > 0}).select(*docs.columns, n_words, n_hit, n_items, items, flag)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose text holds any window of an item."""
    t1, t2 = (free_name(docs, x) for x in ("text_hash_1", "text_hash_2"))
    side = contaminated(docs, benchmark, **settings).select(F.col("t1").alias(t1), F.col("t2").alias(t2))
    return _meet(_hashed(docs, t1, t2), side, (t1, t2), "left_anti").select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` with the hit words cut from ``text``, each with what separates it from the word before; the rest stays as it is."""
    t1, t2, spans, pieces = (free_name(docs, x) for x in ("text_hash_1", "text_hash_2", "spans", "pieces"))
    side = contaminated(docs, benchmark, **settings)
    side = side.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("spans").alias(spans))
    rows = _meet(_hashed(docs, t1, t2), side, (t1, t2), "left", spans)
    text = F.col("text")
    rows = rows.withColumn(pieces, F.when(F.col(spans).isNotNull(), F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))))
    starts = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(pieces) + 1))
    kept = F.zip_with(starts, stops, lambda a, b: F.array_join(F.slice(pieces, a, b - a), ""))
    clean = F.concat(F.array_join(kept, ""), F.regexp_extract(text, TAIL, 0))
    return rows.select(*[F.when(F.col(spans).isNull(), text).otherwise(clean).alias("text") if c == "text" else c for c in docs.columns])


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = report(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, len(list_slice(w, i, i + {WINDOW - 1})) AS n, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, p.n, i, item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram
), c AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
