"""Readers: documents and other rows from JSON lines, plain line corpora, QA and instruction sets, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import chat as C
from quillspark.functions.text import clean_qa, strip
from quillspark.operators.filters import keep_answer
from quillspark.operators.order import before, first_rows, number
from quillspark.operators.tables import written

DOCUMENT = "doc_id string, title string, url string, text string, content string"


def ordered_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """(ord, value): lines of all files at path, numbered from 0 as one reader would: by file, then place in it. Lines of
    white space are left out unless ``blank``.

    A file is read in blocks; a block's lines follow each other in its task, and sums of the sizes of the blocks before it
    tell where they begin. Lines aren't shuffled.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("__file"), meta["file_block_start"].alias("__block"))
    if not blank:
        lines = lines.filter(strip(F.col("value")) != "")
    lines = lines.withColumn("__id", F.monotonically_increasing_id())
    blocks = written(lines.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")))
    files = blocks.groupBy("__file").agg(F.sum("__n").alias("n"))
    files = files.select("__file", F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))  # a row per file
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = written(blocks.withColumn("__inside", inside).join(files, "__file").select("__file", "__block", "__first", "__n", (F.col("__ahead") + F.col("__inside")).alias("__before")))
    if places.count() <= 100_000:
        places = F.broadcast(places)
    own = F.col("__id") - F.col("__first")
    checked = F.when((own >= 0) & (own < F.col("__n")), F.col("__before") + own).otherwise(F.raise_error(F.lit("the files were cut into other blocks than before")).cast("long"))
    return lines.join(places, ["__file", "__block"]).select(checked.alias("ord"), "value")


def json_lines(spark: SparkSession, path: str, schema: str, number: str | None = None) -> DataFrame:
    """Rows of ``schema`` with ``ord`` (numbers of lines that aren't blank, over all files) and ``bad`` (not JSON).

    With ``number``, the column is_number tells whether that name has a JSON number.
    """
    lines = ordered_lines(spark, path)
    kinds = spark.createDataFrame([], schema).schema.add("__bad", T.StringType())
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), f"$.{number}", "variant"))
    extra = [F.coalesce(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.lit(False)).alias("is_number")] if number else []
    parsed = lines.select("ord", *extra, F.from_json("value", kinds, {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("j"))
    return parsed.select("ord", *["is_number"] * bool(number), "j.*").withColumn("bad", F.col("__bad").isNotNull()).drop("__bad")


def documents(spark: SparkSession, path: str, max_docs: int = -1, max_chars: int = 200_000) -> DataFrame:
    """(ord, doc_id, title, url, text, status): invalid, empty and too long documents are marked, not dropped.

    The cap counts all documents seen. An id that is no whole number becomes the ordinal among documents seen.
    """
    rows = json_lines(spark, path, DOCUMENT, "doc_id")
    if max_docs > 0:
        rows = rows.filter(F.col("ord") < max_docs)
    return judged_documents(rows, max_chars, dense=True)


def document_id(given: Column, ordinal: Column, is_number: Column | None = None) -> Column:
    """A number cut towards 0, a string that is a whole number, else the ordinal.

    is_number tells numbers from strings where ``given`` is their text; by default that is the column's type.
    """
    number = F.typeof(given) != "string" if is_number is None else is_number
    return F.coalesce(given.try_cast("bigint"), F.when(number, given.try_cast("double").cast("bigint")), ordinal.cast("bigint"))


def judged_documents(rows: DataFrame, max_chars: int = 200_000, dense: bool = False) -> DataFrame:
    """``dense`` says that ``ord`` counts documents from 0, without gaps; else they are numbered by it."""
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("content"), F.lit(""))
    rows = rows.withColumn("text", text)
    numbered = rows.withColumn("ordinal", F.col("ord")) if dense else number(rows, ["ord"], "ordinal")
    long = (F.length("text") > max_chars) if max_chars > 0 else F.lit(False)
    status = F.when(F.col("bad"), "bad_json").when(strip(F.col("text")) == "", "empty").when(long, "too_long").otherwise("ok")
    return numbered.select("ord", document_id(F.col("doc_id"), F.col("ordinal"), F.col("is_number") if "is_number" in rows.columns else None).alias("doc_id"), "title", "url", "text", status.alias("status"))


def line_corpus(lines: DataFrame, order: str = "ord", line: str = "value") -> DataFrame:
    """(doc, text) of lines parted by blank ones: stripped and joined by spaces; doc counts documents with text.

    A document is known by the blank line before it; ranges of lines are scanned apart, and what is open at a range's end
    goes on in the next.
    """
    width = 100_000
    rows = lines.select(F.col(order).alias("ord"), strip(F.coalesce(F.col(line), F.lit(""))).alias("line")).withColumn("part", F.floor(F.col("ord") / width))
    here = F.max(F.when(F.col("line") == "", F.col("ord"))).over(Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    ends = before(rows.groupBy("part").agg(F.max(F.when(F.col("line") == "", F.col("ord"))).alias("e")), "part", "e", "before", "max").select("part", "before")
    rows = rows.withColumn("here", here).join(ends, "part").withColumn("start", F.coalesce("here", "before", F.lit(-1))).filter("line <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), " ")
    return number(rows.groupBy("start").agg(text.alias("text")), ["start"], "doc").select("doc", "text")


def export_documents(docs: DataFrame, min_chars: int = 200, max_docs: int = -1, seed: int = 0) -> DataFrame:
    """(doc_id, source_id, text): documents of min_chars or more in a seeded order, numbered; at most max_docs if positive."""
    from quillspark.operators.sample import ranked

    long = docs.filter(F.length(strip(F.coalesce("text", F.lit("")))) >= min_chars)
    out = ranked(long, "doc_id", seed).select((F.col("rank") - 1).cast("long").alias("new_id"), F.col("doc_id").alias("source_id"), "text")
    return out.filter(F.col("new_id") < max_docs) if max_docs > 0 else out


def dataset_spec(spec: str) -> list[tuple[str, str]]:
    """[(name, split)] of ``name:split,name:split``; the split is train if not given."""
    out = [tuple((part.strip() + ":train").split(":")[:2]) for part in spec.split(",") if part.strip()]
    if not out or any(not n or not s for n, s in out):
        raise ValueError(f"no dataset in {spec!r}")
    return out


def shaped_text(df: DataFrame) -> Column:
    """The text of a row by what columns there are: messages, instruction and response, or text or content."""
    has = set(df.columns)
    parts = []
    for name in ("messages", "conversations"):
        if name in has:
            parts.append(F.when(F.size(name) > 0, C.format_messages(F.col(name))))
    if {"instruction", "response"} <= has:
        parts.append(F.when(F.col("instruction").isNotNull() | F.col("response").isNotNull(), C.format_instruction(F.col("instruction"), F.col("context") if "context" in has else F.lit(None), F.col("response"))))
    parts += [F.nullif(F.col(c), F.lit("")) for c in ("text", "content") if c in has]
    return strip(F.coalesce(*parts, F.lit("")))


def qa_spans(rows: DataFrame, source: str) -> DataFrame:
    """question, answers.text, is_impossible: answerable ones with their first answer."""
    return _items(rows.filter(~F.coalesce("is_impossible", F.lit(False))), source, F.col("question"), F.try_element_at("answers.text", F.lit(1)))


def qa_lists(rows: DataFrame, source: str) -> DataFrame:
    return _items(rows, source, F.col("question"), F.try_element_at("answers", F.lit(1)))


def qa_choices(rows: DataFrame, source: str) -> DataFrame:
    """question_stem, choices (label, text), answerKey: the options follow the question; the answer is the key's text."""
    pairs = F.arrays_zip(F.col("choices.label").alias("l"), F.col("choices.text").alias("t"))
    question = F.concat("question_stem", F.lit(" "), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("("), p["l"], F.lit(") "), p["t"])), " "))
    right = F.filter(pairs, lambda p: p["l"] == F.col("answerKey"))
    return _items(rows, source, question, F.try_element_at(right, F.lit(1))["t"])


def qa_values(rows: DataFrame, source: str) -> DataFrame:
    return _items(rows, source, F.col("question"), F.coalesce(F.nullif("answer.value", F.lit("")), F.col("answer.normalized_value")))


def qa_best(rows: DataFrame, source: str) -> DataFrame:
    return _items(rows, source, F.col("question"), F.col("best_answer"))


def _items(rows: DataFrame, source: str, question: Column, answer: Column) -> DataFrame:
    made = rows.select(F.lit(source).alias("source"), clean_qa(question).alias("question"), clean_qa(answer).alias("answer"))
    return made.filter(keep_answer(F.col("question"), F.col("answer")))


def decoder_rows(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """ctx_text, tgt_text, codes: tgt_codes if there, else parsed from their text. A missing path has no rows."""
    from quillspark.functions.codes import parse_codes

    schema = "ctx_text string, tgt_text string, tgt_codes array<int>, tgt_codes_str string"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], "ord long, ctx_text string, tgt_text string, codes array<int>")
    rows = json_lines(spark, path, schema).filter("not bad")
    if max_rows > 0:
        rows = first_rows(rows, "ord", max_rows)
    return rows.select("ord", "ctx_text", "tgt_text", F.coalesce("tgt_codes", parse_codes(F.col("tgt_codes_str"))).alias("codes"))


def code_rows(rows: DataFrame, k: int, context: int = 6) -> DataFrame:
    """Rows whose ctx_codes and tgt_codes have the right lengths."""
    return rows.filter((F.size("ctx_codes") == k * context) & (F.size("tgt_codes") == k))
