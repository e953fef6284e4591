"""Filters that name the first rule a row breaks, so drops can be counted by reason; kept rows have a null reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def paragraph_reason(p: Column, least: int = 25, most_symbols: float = 0.35) -> Column:
    return (
        F.when(T.strip(p) == "", "empty").when(T.has_markup(p), "markup").when((T.count_of(p, "|") >= 4) | (T.count_of(p, "=") >= 6), "pipe_eq")
        .when(F.length(p) < least, "short").when(T.symbol_ratio(p) > most_symbols, "symbol_ratio")
    )


def judged_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, paragraph, reason) of all paragraphs."""
    rows = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return rows.withColumn("reason", paragraph_reason(F.col("paragraph")))


def clean_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of kept paragraphs, joined by blank lines; documents without any are dropped. No shuffle."""
    kept = F.filter(T.paragraphs(F.col("text")), lambda p: paragraph_reason(p).isNull())
    # a generator drops the empty ones: a filter would be pushed down and have the paragraphs judged twice
    text = F.filter(F.array(F.array_join(kept, "\n\n")), lambda t: t != "")
    return docs.select("doc_id", F.explode(text).alias("text"))


def answer_reason(question: Column, answer: Column, least: int = 5, most: int = 220, most_symbols: float = 0.35) -> Column:
    """Of a question and its answer, judged by the answer's first sentence."""
    s = T.first_sentence(answer)
    return (
        F.when((T.clean(question) == "") | (T.clean(answer) == ""), "missing_fields").when(s == "", "no_sentence").when(T.has_markup(s), "markup")
        .when((T.count_of(s, "|") >= 4) | (T.count_of(s, "=") >= 6), "pipe_eq").when(T.symbol_ratio(s) > most_symbols, "symbol_ratio").when(F.length(s) < least, "too_short").when(F.length(s) > most, "too_long")
    )


def keep_answer(question: Column, answer: Column) -> Column:
    """Whether a cleaned question and answer make an item: both set, 2 to 220 characters, under two pipes."""
    return (question != "") & F.length(answer).between(2, 220) & (T.count_of(answer, "|") < 2)


def clean_target(c: Column) -> Column:
    """Whether a decoder target is free of table code and has 5 characters or more."""
    c = F.coalesce(c, F.lit(""))
    return ~c.rlike(T.TABLE_CODE) & (F.length(T.strip(c)) >= 5)


def target_check(rows: DataFrame, target: str) -> DataFrame:
    """One row: rows, hits (control tokens in targets) and their share."""
    hit = F.count_if(F.coalesce(F.col(target), F.lit("")).rlike(T.CONTROL_TARGET))
    return rows.agg(F.count(F.lit(1)).alias("rows"), hit.alias("hits")).withColumn("share", F.col("hits") / F.greatest("rows", F.lit(1)))


def target_examples(rows: DataFrame, target: str, key: str, n: int = 5) -> DataFrame:
    """The first n hits of target_check by key, cut to 200 characters: a report."""
    return rows.filter(F.col(target).rlike(T.CONTROL_TARGET)).orderBy(key).limit(n).select(key, F.replace(F.substring(target, 1, 200), F.lit("\n"), F.lit("\\n")).alias("example"))


def mix_report(rows: DataFrame, target: str) -> DataFrame:
    """One row: rows, written (targets that aren't blank), skipped_empty, control_in_tgt and its percentage of written."""
    t = F.coalesce(F.col(target), F.lit(""))
    full = T.strip(t) != ""
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("written"), F.count_if(~full).alias("skipped_empty"), F.count_if(full & t.rlike(T.CONTROL_MIX)).alias("control_in_tgt"))
    return out.withColumn("control_pct", F.round(100.0 * F.col("control_in_tgt") / F.greatest("written", F.lit(1)), 4))


def sentence_reason(sentence: Column, least: int = 5, most: int = 220) -> Column:
    """Of an assistant's sentence as a target, after control tokens are taken out."""
    t = T.strip_control(sentence)
    return F.when(t == "", "control_stripped_empty").when(F.length(t) < least, "too_short").when(F.length(t) > most, "too_long")


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
