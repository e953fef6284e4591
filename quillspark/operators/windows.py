"""Numbers, runs, sliding contexts and conversation histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import chat as C
from quillspark.functions import text as T
from quillspark.operators.filters import sentence_reason
from quillspark.operators.order import before, number


def split_sentences(docs: DataFrame, least: int = 15, most: int = 300) -> DataFrame:
    """(doc_id, pos, text): sentences of least to most characters; pos counts the kept ones of a document. No shuffle."""
    kept = F.filter(T.sentences(T.clean(F.col("text"))), lambda s: F.length(s).between(least, most))
    return docs.select("doc_id", F.posexplode(kept).alias("pos", "text"))


def runs(rows: DataFrame, doc: str, order: str, out: str = "run") -> DataFrame:
    """Marks runs of consecutive rows with one document by the order of their first row; a document that comes again starts anew.

    A row starts a run where the row before it, in order, has another document. Rows are cut into ranges of the order;
    what stands before a range, and the run that is open there, come from the ranges before.
    """
    width = 100_000
    rows = rows.withColumn("__part", F.floor(F.col(order) / width))
    w = Window.partitionBy("__part").orderBy(order)
    last = before(rows.groupBy("__part").agg(F.max_by(F.struct(doc), order).alias("__end")), "__part", "__end", "__last", "last").select("__part", "__last")
    rows = rows.join(last, "__part")
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("__ahead", F.when(first, F.col("__last")[doc]).otherwise(F.lag(doc).over(w))).withColumn("__new", (first & F.col("__last").isNull()) | ~F.col(doc).eqNullSafe(F.col("__ahead")))
    rows = rows.withColumn("__start", F.when(F.col("__new"), F.col(order)))
    rows = rows.withColumn(out, F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    carry = before(rows.groupBy("__part").agg(F.max("__start").alias("__s")), "__part", "__s", "__carry", "max").select("__part", "__carry")
    return rows.join(carry, "__part").withColumn(out, F.coalesce(out, "__carry")).drop("__part", "__last", "__ahead", "__new", "__start", "__carry")


def sliding(rows: DataFrame, group: str, order: str, columns: dict[str, str], n: int = 6) -> DataFrame:
    """For rows with n rows before them in their group: the lists of ``columns`` (name: new name) of these n."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-n, -1)
    rows = rows.withColumns({new: F.collect_list(old).over(w) for old, new in columns.items()})
    return rows.filter(F.size(next(iter(columns.values()))) == n)


def context_rows(sentences: DataFrame, n: int = 6, order: str = "pos") -> DataFrame:
    """(doc_id, order, ctx_text, tgt_text): each sentence with the n before it in its document."""
    made = sliding(sentences, "doc_id", order, {"text": "ctx"}, n)
    return made.select("doc_id", order, F.array_join("ctx", " ").alias("ctx_text"), F.col("text").alias("tgt_text"))


def named_sentences(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, text) of the sentences that aren't blank, stripped; an empty text is that of ``content``, if there is
    such a column, and a missing doc_id the last one's.
    """
    # a gap is filled within its range of 100,000 sent_ids, and from the ranges before it
    width = 100_000
    part = F.floor(F.col("sent_id") / width)
    here = F.last("doc_id", ignorenulls=True).over(Window.partitionBy("__part").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, 0))
    named = sentences.withColumn("__part", part).withColumn("__here", here)
    carry = before(named.groupBy("__part").agg(F.max_by("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("sent_id"))).alias("d")), "__part", "d", "__carry", "last").select("__part", "__carry")
    named = named.join(carry, "__part").withColumn("__doc", F.coalesce("__here", "__carry"))
    text = F.coalesce(F.nullif("text", F.lit("")), *["content"] * ("content" in sentences.columns), F.lit(""))
    return named.select(F.col("__doc").alias("doc_id"), "sent_id", T.strip(text).alias("text")).filter("text <> ''")


def context_rows_stripped(sentences: DataFrame, n: int = 6) -> DataFrame:
    """The older form, over named_sentences: blank sentences neither count nor are targets.

    sentences: sent_id, doc_id, text, and perhaps content.
    """
    made = sliding(named_sentences(sentences), "doc_id", "sent_id", {"text": "ctx"}, n)
    return made.select("doc_id", "sent_id", F.array_join("ctx", " ").alias("ctx_text"), F.col("text").alias("tgt_text"))


def _turns(conversations: DataFrame, empty: str) -> DataFrame:
    made = conversations.select("conv_id", "turn", C.role_instruct(F.col("role"), empty).alias("role"), T.clean(F.col("text")).alias("content"))
    return made.filter("content <> ''")


def _joined(c: Column, over) -> Column:
    return F.array_join(F.collect_list(c).over(over), "")


def _assistant_sentences(turns: DataFrame) -> DataFrame:
    said = turns.filter("role = 'Assistant'").select("conv_id", "turn", F.posexplode(T.sentences(F.col("content"))).alias("pos", "sentence"))
    return said.withColumn("reason", sentence_reason(F.col("sentence")))


def chat_history_full(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, ctx_text, tgt_text) in the form with headings.

    The context has all turns before in full, and all sentences before in this turn, also those that are no targets.
    """
    turns = _turns(conversations, "Unknown")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    history = turns.select("conv_id", "turn", "role", _joined(C.history_block(F.col("role"), F.col("content")), earlier).alias("history")).filter("role = 'Assistant'").drop("role")
    so_far = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = _assistant_sentences(turns).withColumn("prefix", F.array_join(F.collect_list("sentence").over(so_far), " ")).filter("reason is null")
    ctx = F.concat("history", F.lit("### Assistant:\n"), "prefix", F.lit("\n"))
    return said.join(history, ["conv_id", "turn"]).select("conv_id", "turn", "pos", ctx.alias("ctx_text"), T.strip_control(F.col("sentence")).alias("tgt_text"))


def chat_history_kept(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, ctx_text, tgt_text) in the form of lines.

    The context has only sentences that are targets, in this turn and in earlier ones; assistant turns without any vanish.
    """
    turns = _turns(conversations, "User")
    said = _assistant_sentences(turns).filter("reason is null")
    kept = said.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("kept"))
    turns = turns.join(kept, ["conv_id", "turn"], "left")
    line = F.when(F.col("role") != "Assistant", C.history_line(F.col("role"), F.col("content"))).when(F.col("kept").isNotNull(), C.history_line(F.col("role"), F.col("kept")))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    history = turns.select("conv_id", "turn", "role", _joined(line, earlier).alias("history")).filter("role = 'Assistant'").drop("role")
    so_far = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    said = said.withColumn("prefix", F.array_join(F.collect_list("sentence").over(so_far), " "))
    own = F.when(F.col("prefix") != "", F.concat(F.lit("Assistant: "), "prefix", F.lit("\n"))).otherwise("")
    return said.join(history, ["conv_id", "turn"]).select("conv_id", "turn", "pos", F.concat("history", own, F.lit("Assistant:")).alias("ctx_text"), T.strip_control(F.col("sentence")).alias("tgt_text"))


def chat_counters(conversations: DataFrame) -> DataFrame:
    """(reason, rows): empty messages, conversations without assistant, and sentences by what became of them."""
    turns = _turns(conversations, "User")
    empty = conversations.select(T.clean(F.col("text")).alias("t")).filter("t = ''").select(F.lit("missing_content").alias("reason"))
    silent = turns.groupBy("conv_id").agg(F.max((F.col("role") == "Assistant").cast("int")).alias("a")).filter("a = 0").select(F.lit("no_assistant").alias("reason"))
    said = _assistant_sentences(turns).select(F.coalesce("reason", F.lit("kept")).alias("reason"))
    return empty.unionAll(silent).unionAll(said).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
