"""Sentences with abbreviations learned from the corpus, without a list of them (after Kiss and Strunk, 2006).

Counts over all texts say how often a word stands before a period, and what follows it. A word is an abbreviation where a
period after it is no chance by a ratio of likelihoods, weighed by its length, its inner periods and how often it lacks
the period. A period after an abbreviation ends a sentence only before a frequent sentence starter in capitals. A period
after an initial or a number doesn't where the two words are a collocation.

Counts are aggregates over words, combined in each task. Texts don't move with their words: the places where a period
ends nothing, which are few, go back to the texts that have any, by the texts' hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.tables import written

#: Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Rows that may be broadcast.
SMALL = 200_000


@dataclass(frozen=True)
class Learned:
    """Tables of words (lower-case, without the last period) and their scores."""

    abbreviations: DataFrame  # word, score
    collocations: DataFrame  # word, next, score: of initials, numbers and abbreviations, before no starter
    starters: DataFrame  # word, score


def word(token: Column) -> Column:
    """A token in small letters, without marks around it and without its last period."""
    return F.regexp_replace(_bare(token), r"\.$", "")


def _bare(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", ""))


def _dotted(token: Column) -> Column:
    return _bare(token).endswith(".")


def _is_word(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def short_kind(c: Column) -> Column:
    """Whether a word is an initial or a number."""
    return c.rlike(r"^(\p{L}|\p{N}+)$")


def _xlogy(k: Column, x: Column) -> Column:
    return F.when(k == 0, 0.0).otherwise(k * F.log(x))


def ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Twice the log ratio of the likelihoods that b follows a as often as it stands anywhere, or more often; 0 if not more often."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    one = lambda k, m, x: _xlogy(k, x) + _xlogy(m - k, 1 - x)
    value = 2 * (one(both, a, p1) + one(b - both, n - a, p2) - one(both, a, p) - one(b - both, n - a, p))
    return F.when(n <= a, 0.0).when(p1 > p, value).otherwise(0.0)


def learn(docs: DataFrame, text: str = "text") -> Learned:
    """What all texts say of their words; the tables are written."""
    tokens = docs.select(F.split(T.clean(F.col(text)), " ").alias("t"))
    # marks alone are no words; each word meets the word after it
    pairs = tokens.select(F.filter("t", lambda x: _is_word(x)).alias("t")).filter("size(t) > 0")
    # the next token matters after a period only; tokens are counted as they stand, and bared once each
    each = F.transform("t", lambda x, i: F.struct(x.alias("token"), F.when(x.contains("."), F.get("t", i + 1)).alias("next")))
    raw = pairs.select(F.explode(each).alias("x")).groupBy("x.token", "x.next").agg(F.count(F.lit(1)).alias("n"))
    bare = raw.select(word(F.col("token")).alias("word"), _dotted(F.col("token")).alias("dot"), word(F.col("next")).alias("next"), "n")
    pairs = written(bare.groupBy("word", "dot", F.when(F.col("dot"), F.col("next")).alias("next")).agg(F.sum("n").alias("n")))
    counts = written(pairs.groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dots")))
    total = counts.agg(F.sum("n").alias("all"), F.sum("dots").alias("periods"))  # one row

    letters, inner = F.length(F.replace("word", F.lit("."), F.lit(""))), F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    plain, p = F.col("n") - F.col("dots"), F.col("periods") / F.col("all")
    likely = -2 * (F.col("dots") * F.log(p) + F.when(plain == 0, 0.0).otherwise(plain * F.log(1 - p)) - F.col("dots") * F.log(F.lit(0.99)) - plain * F.log(F.lit(0.01)))
    score = likely * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -plain.cast("double"))
    judged = counts.filter("dots > 0").crossJoin(F.broadcast(total)).withColumn("score", score)
    abbreviations = written(judged.filter(F.col("score") >= ABBREVIATION).select("word", "score"))

    after = pairs.filter("dot and next is not null").groupBy("word", "next").agg(F.sum("n").alias("both"))
    of_next = counts.select(F.col("word").alias("next"), F.col("n").alias("b"))
    ends = written(after.join(_bounded(abbreviations.select("word")), "word", "left_anti").groupBy("next").agg(F.sum("both").alias("both")))
    breaks = ends.agg(F.sum("both").alias("breaks"))
    starts = ends.join(of_next, "next").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(breaks))  # one row each
    starts = starts.withColumn("score", ratio(F.col("both"), F.col("breaks"), F.col("b"), F.col("all"))).filter(F.col("score") >= STARTER)
    starts = written(starts.select(F.col("next").alias("word"), "score"))
    short = after.join(_bounded(abbreviations.select("word", F.lit(True).alias("short"))), "word", "left").filter(short_kind(F.col("word")) | F.col("short"))
    short = short.join(_bounded(starts.select(F.col("word").alias("next"))), "next", "left_anti")  # a starter goes with any word before it
    short = short.join(counts.select("word", F.col("dots").alias("a")), "word").join(of_next, "next").crossJoin(F.broadcast(total))
    short = short.withColumn("score", ratio(F.col("both"), F.col("a"), F.col("b"), F.col("all"))).filter((F.col("score") >= COLLOCATION) & (F.col("both") > 1))
    return Learned(abbreviations, written(short.select("word", "next", "score")), starts)


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def sentences(docs: DataFrame, learned: Learned, text: str = "text", least: int = 15, most: int = 300) -> DataFrame:
    """(doc_id, pos, text): sentences of least to most characters; pos counts the kept ones of a document.

    Null and empty texts have none. Repeated rows are cut alike.
    """
    rows = docs.select("doc_id", F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), F.col(text)).alias("__t2"), T.sentences(T.clean(F.col(text))).alias("__pieces"))
    at = F.transform("__pieces", lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, r"(\S+)$", 1).alias("last"), F.regexp_extract(F.get("__pieces", i + 1), r"^(\S+)", 1).alias("first")))
    places = rows.select("__t1", "__t2", F.explode(at).alias("x")).select("__t1", "__t2", "x.*").filter(F.col("first").isNotNull() & _dotted(F.col("last")))
    places = places.select("__t1", "__t2", "at", word(F.col("last")).alias("word"), word(F.col("first")).alias("next"), F.regexp_replace("first", r"^[^\p{L}\p{N}]+", "").rlike(r"^\p{Lu}").alias("capital"))
    places = places.join(_bounded(learned.abbreviations.select("word", F.lit(True).alias("short"))), "word", "left").filter(F.col("short") | short_kind(F.col("word")))
    places = places.join(_bounded(learned.collocations.select("word", "next", F.lit(True).alias("together"))), ["word", "next"], "left")
    places = places.join(_bounded(learned.starters.select(F.col("word").alias("next"), F.lit(True).alias("starts"))), "next", "left")
    together, starts = F.coalesce("together", F.lit(False)), F.coalesce("starts", F.lit(False))
    goes_on = F.when(F.col("short"), ~(starts & F.col("capital") & ~together)).otherwise(together)
    open_ = written(places.filter(goes_on).groupBy("__t1", "__t2").agg(F.collect_set("at").alias("__open")))  # at most the places of one text
    rows = rows.join(_bounded(open_), ["__t1", "__t2"], "left")
    glued = F.array_join(F.transform("__pieces", lambda x, i: F.concat(x, F.when(F.array_contains("__open", i), " ").otherwise("\n"))), "")  # a cleaned text has no line ends
    whole = F.when(F.col("__open").isNull(), F.col("__pieces")).otherwise(F.transform(F.split(glued, "\n"), lambda s: T.strip(s)))
    kept = F.filter(whole, lambda s: F.length(s).between(least, most))
    return rows.select("doc_id", F.posexplode(kept).alias("pos", "text"))
