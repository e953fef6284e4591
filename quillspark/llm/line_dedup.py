"""Line dedup by spread over sites. DataFrame operations only.

Each line (white space squeezed, ends cut) is known by two 64-bit hashes. One aggregation merges HyperLogLog sketches of
the sites of every line. Lines whose estimate is far above or below the threshold are decided by it; those near it get an
exact distinct count of their sites. Lines on ``min_sites`` sites or more are boilerplate, and are cut from all documents.

Sketches are combined before the shuffle, so a line that most documents have is one row a task. Texts don't move with the
lines: the numbers of the lines to cut go back to the texts that have any, by the texts' hashes.

Nulls: a null text has no lines and stays null; a null site is a site of its own ("-"). Empty lines are never boilerplate.
Repeated rows are cut alike. Empty tables give empty results. Extra columns pass through. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import free_name, materialise, read_table

MIN_SITES = 6
LOG_SIZE = 10
#: Estimates within these parts of the threshold are counted exactly; the sketch's own error is about 3 %.
NEAR = (0.7, 1.4)
#: Rows that may be broadcast, and the numbers of lines in them: some 12 MB.
SMALL, PLACES = 100_000, 2_000_000


def _line(line):
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """(t1, t2: hashes of the text, pos, h1, h2: hashes of the line, site) of all lines that aren't empty."""
    text = F.col("text")
    rows = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.coalesce(F.col(site), F.lit("-")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", _line(F.col("line"))).filter("line <> ''")
    return rows.select("t1", "t2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of the lines on min_sites sites or more."""
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LOG_SIZE).alias("sites"))
    judged = materialise(sketches.select("h1", "h2", F.hll_sketch_estimate("sites").alias("n")).filter(F.col("n") >= NEAR[0] * min_sites))
    near = judged.filter(F.col("n") <= NEAR[1] * min_sites).select("h1", "h2")
    if near.count() <= SMALL:
        near = F.broadcast(near)
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
    return materialise(judged.filter(F.col("n") > NEAR[1] * min_sites).select("h1", "h2").unionByName(exact.select("h1", "h2")))


def cut_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``text`` rid of cross-site boilerplate lines, and the columns n_lines and n_removed (new names)."""
    lines = lines_of(docs, site)
    common = boilerplate(lines, min_sites)
    if common.count() <= SMALL:
        common = F.broadcast(common)
    t1, t2, cut = (free_name(docs, x) for x in ("text_hash_1", "text_hash_2", "cut_lines"))
    hits = lines.join(common, ["h1", "h2"], "left_semi").select(F.col("t1").alias(t1), F.col("t2").alias(t2), "pos").distinct()
    found = materialise(hits.groupBy(t1, t2).agg(F.collect_list("pos").alias(cut)))  # at most the lines of one text
    held = found.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(cut)).alias("places")).first()
    if held["rows"] <= SMALL and (held["places"] or 0) <= PLACES:
        found = F.broadcast(found)
    text = F.col("text")
    rows = docs.withColumns({t1: F.xxhash64(text), t2: F.xxhash64(F.lit(1), text)}).join(found, [t1, t2], "left")
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(cut, i))
    clean = F.when(F.col(cut).isNull(), text).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    counts = {free_name(docs, "n_lines"): n_lines, free_name(docs, "n_removed"): F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long")}
    rows = rows.withColumns(counts | {free_name(docs, "clean_text"): clean})
    return rows.select(*[F.col(free_name(docs, "clean_text")).alias("text") if c == "text" else c for c in docs.columns], *counts)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return cut_lines(docs.select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


OP10_SQL = rf"""
WITH l AS (
  SELECT doc_id, coalesce(source, '-') AS site, p.pos, p.line AS raw, trim(regexp_replace(p.line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'pos': i, 'line': x}})) AS p FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), c AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line IN (SELECT line FROM b)) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (line NOT IN (SELECT line FROM b)), '') AS clean FROM l GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(clean, '')) AS clean_sha256 FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""
