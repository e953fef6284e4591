"""Named queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import chat as C
from quillspark.functions import codes as K
from quillspark.functions import text as T
from quillspark.models import generation as G
from quillspark.models import planner as P
from quillspark.operators import filters, metrics, rvq, sample, segmenter, windows
from quillspark.operators.tables import shared_dir
from quillspark.sources import arrays, instruct, readers, sinks

STAGES, CENTRES = 4, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return table(spark, d, "documents")


def _chats(spark, d):
    return table(spark, d, "conversations")


def clean_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("text"))


def clean_messages(spark, d):
    return _chats(spark, d).select("conv_id", "turn", T.clean_message(F.col("text")).alias("text"))


def clean_qa_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_qa(F.col("html")).alias("text"))


def split_sentences(spark, d):
    return windows.split_sentences(_docs(spark, d))


def _learned(spark, d):
    return segmenter.learn(_docs(spark, d))


def abbreviations(spark, d):
    """Words that the documents show to be abbreviations, with their scores, and what else they say of words around periods."""
    made = _learned(spark, d)
    named = [(made.abbreviations.withColumn("next", F.lit("")), "abbreviation"), (made.collocations, "collocation"), (made.starters.withColumn("next", F.lit("")), "starter")]
    parts = [rows.select(F.lit(kind).alias("kind"), "word", "next", F.round("score", 4).alias("score")) for rows, kind in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def learned_sentences(spark, d):
    return segmenter.sentences(_docs(spark, d), _learned(spark, d))


def sentence_ids(spark, d):
    return windows.number(windows.split_sentences(_docs(spark, d)), ["doc_id", "pos"], "sent_id")


def sentence_forms(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", T.first_sentence(t).alias("first_sentence"), T.first_dot(t).alias("first_dot"), F.size(T.inference_sentences(t)).alias("n_inference"))


def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


def clean_paragraphs(spark, d):
    return filters.clean_documents(_docs(spark, d))


def clean_reason_counts(spark, d):
    return filters.reason_counts(filters.judged_paragraphs(_docs(spark, d)))


def symbol_ratio(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.symbol_ratio(F.coalesce("text", F.lit(""))), 9).alias("symbol_ratio"))


def markup_flags(spark, d):
    return table(spark, d, "pages").select("page_id", T.has_markup(F.col("html")).alias("has_markup"), filters.clean_target(F.col("html")).alias("clean_target"))


def decoder_targets(spark, d):
    return _docs(spark, d).filter(filters.clean_target(F.col("text"))).select("doc_id")


def control_token_check(spark, d):
    coded = _coded(spark, d).select(K.codes_to_special(F.col("codes"), 10_000).alias("t")).unionByName(_chats(spark, d).select(F.col("text").alias("t")))
    return filters.target_check(coded, "t")


def mix_validation(spark, d):
    coded = _coded(spark, d).select(K.codes_to_text(F.col("codes")).alias("t")).unionByName(_chats(spark, d).select(F.col("text").alias("t")))
    return filters.mix_report(coded, "t")


def strip_control_tokens(spark, d):
    return _coded(spark, d).select("vec_id", T.strip_control(F.concat(F.lit("a  "), K.codes_to_special(F.col("codes"), CENTRES), F.lit(" c1_2 c12 b"))).alias("text"))


def role_norm(spark, d):
    r = F.col("role")
    return _chats(spark, d).select("conv_id", "turn", C.role_export(r).alias("export"), C.role_pull(r).alias("pull"), C.role_instruct(r).alias("instruct"), C.role_instruct(r, "User").alias("decoder"))


def _messages(spark, d):
    one = F.struct("turn", "role", F.col("text").alias("content"))
    sorted_turns = F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return _chats(spark, d).groupBy("conv_id").agg(sorted_turns.alias("messages"))


def conversation_docs(spark, d):
    return _messages(spark, d).select("conv_id", C.format_messages(F.col("messages")).alias("text"))


def normalized_conversations(spark, d):
    made = _messages(spark, d).select("conv_id", C.normalize_messages(F.col("messages")).alias("m")).filter("m is not null")
    return made.select("conv_id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("text"))


def prompt_of_messages(spark, d):
    return _messages(spark, d).select("conv_id", C.messages_to_prompt(F.transform("messages", lambda m: m["content"])).alias("prompt"))


def _pairs(spark, d):
    """Questions and answers: a user's turn and the assistant's turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _chats(spark, d).withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def instruction_texts(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", C.format_instruction(F.col("question"), F.lit(" "), F.col("answer")).alias("text"))


def question_messages(spark, d):
    made = _pairs(spark, d).select("conv_id", "turn", C.question_messages(F.lit("Be brief."), F.col("question"), F.col("answer")).alias("m")).filter("m is not null")
    return made.select("conv_id", "turn", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("text"))


def prompts(spark, d):
    q = T.clean(F.col("question"))
    return _pairs(spark, d).select("conv_id", "turn", C.wrap_instruction(q).alias("instruction"), C.wrap_chat(q).alias("chat"), C.wrap_chat(q, "qa").alias("qa"))


def qa_pairs_filtered(spark, d):
    rows = _pairs(spark, d).withColumn("reason", filters.answer_reason(F.col("question"), F.col("answer"))).filter("reason is null")
    return rows.select("conv_id", "turn", C.wrap_instruction(T.clean(F.col("question"))).alias("ctx_text"), T.first_sentence(F.col("answer")).alias("tgt_text"))


def qa_reason_counts(spark, d):
    return filters.reason_counts(_pairs(spark, d).select(filters.answer_reason(F.col("question"), F.col("answer")).alias("reason")))


def qa_first_dot(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", C.wrap_chat(T.clean(F.col("question"))).alias("ctx_text"), T.first_dot(T.clean(F.col("answer"))).alias("tgt_text")).filter("tgt_text <> ''")


def qa_items(spark, d):
    """Three shapes of questions and answers over the same rows, cleaned and filtered."""
    rows = _pairs(spark, d)
    spans = readers.qa_spans(rows.select("question", F.struct(F.array("answer").alias("text")).alias("answers"), (F.col("turn") > 4).alias("is_impossible")), "spans")
    lists = readers.qa_lists(rows.select("question", F.array("answer").alias("answers")), "lists")
    choices = readers.qa_choices(rows.select(F.col("question").alias("question_stem"), F.struct(F.array(F.lit("A"), F.lit("B")).alias("label"), F.array(F.lit("no"), F.col("answer")).alias("text")).alias("choices"), F.lit("B").alias("answerKey")), "choices")
    return spans.unionByName(lists).unionByName(choices)


def qa_more_items(spark, d):
    """The other two shapes: answers as a value with a normalised form, which counts where the value is empty, and best answers."""
    rows = _pairs(spark, d)
    value = F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("answer"))
    values = readers.qa_values(rows.select("question", F.struct(value.alias("value"), F.concat(F.substring("answer", 1, 40), F.lit("!")).alias("normalized_value")).alias("answer")), "values")
    return values.unionByName(readers.qa_best(rows.select("question", F.substring("answer", 1, 90).alias("best_answer")), "best"))


def shaped_documents(spark, d):
    """Texts of rows that have messages, or an instruction with a response, or a text, each by what it has."""
    chats = _messages(spark, d).select(F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 3 == 0, F.col("messages")).alias("messages"), F.when(F.col("conv_id") % 3 == 1, F.element_at("messages", 1)["content"]).alias("instruction"))
    rows = chats.select("id", "messages", "instruction", F.when(F.col("instruction").isNotNull(), "Yes. ").alias("response"), F.concat(F.lit("  plain "), "id").alias("text"))
    return rows.select("id", readers.shaped_text(rows).alias("text"))


def decoder_row_files(spark, d):
    """Decoder rows as JSON lines, some with their codes as text only, written and read again."""
    coded = _coded(spark, d).select("vec_id", "codes")
    rows = coded.select(F.concat(F.lit("ctx "), "vec_id").alias("ctx_text"), F.concat(F.lit("tgt "), "vec_id").alias("tgt_text"), F.when(F.col("vec_id") % 2 == 0, F.col("codes")).alias("tgt_codes"), K.codes_to_text(F.col("codes")).alias("tgt_codes_str"))
    path = _folder(spark, "decoder")
    sinks.write_json_lines(rows.repartitionByRange("tgt_text").sortWithinPartitions("tgt_text"), path)
    return readers.decoder_rows(spark, path).select("ord", "ctx_text", "tgt_text", "codes")


def qa_dedup(spark, d):
    rows = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("question"))
    return sample.dedup_questions(rows, "question", ["doc_id"]).select("doc_id")


def doc_hash_split(spark, d):
    return _docs(spark, d).select("doc_id", K.is_val(F.col("doc_id")).alias("is_val"))


def first_row_id(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", K.first_id(F.col("user_id") % 2, F.nullif("event_type", F.lit("click")), F.col("event_id")).alias("row_id"))


def document_ids(spark, d):
    """Whole strings, numbers and strings with a fraction (numbers negative), and words."""
    text = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    given = F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("-"), text, F.lit(".75"))).when(kind == 2, F.concat(text, F.lit(".75"))).otherwise("a-b")
    return _docs(spark, d).select("doc_id", readers.document_id(given, F.col("doc_id") + 1_000_000, kind == 1).alias("new_id"))


def stage_counters(spark, d):
    return metrics.stage_counters(_docs(spark, d))


def context_windows(spark, d):
    rows = windows.context_rows(windows.split_sentences(_docs(spark, d)))
    return rows.withColumn("is_val", K.is_val(F.col("doc_id")))


def context_windows_stripped(spark, d):
    """The older form, over all lines of the documents: blank ones don't count, and every fifth line names no document."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    lines = windows.number(lines, ["doc_id", "pos"], "sent_id")
    return windows.context_rows_stripped(lines.select("sent_id", F.when((F.col("pos") == 0) | (F.col("sent_id") % 5 != 0), F.col("doc_id")).alias("doc_id"), "text"))


def document_runs(spark, d):
    return windows.runs(table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("doc")), "doc", "event_id")


def pad_context(spark, d):
    made = windows.split_sentences(_docs(spark, d)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("s"))
    return made.select("doc_id", F.array_join(K.pad_left(F.col("s")), " ").alias("ctx_text"))


def split_report(spark, d):
    rows = context_windows(spark, d)
    out = metrics.split_report(rows, "is_val", "ctx_text", "tgt_text")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ctx_chars", "mean_tgt_chars")})


def chat_history_full(spark, d):
    return windows.chat_history_full(_chats(spark, d))


def chat_history_kept(spark, d):
    return windows.chat_history_kept(_chats(spark, d))


def chat_reason_counts(spark, d):
    return windows.chat_counters(_chats(spark, d))


def seeded_shuffle(spark, d):
    return sample.ranked(_docs(spark, d).select("doc_id"), "doc_id", 3)


def positional_split(spark, d):
    return sample.positional_split(_docs(spark, d).select("doc_id"), "doc_id")


def sample_without_replacement(spark, d):
    base, aux = _docs(spark, d).select("doc_id"), _chats(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"))
    n = sample.weighted_count(base.count(), aux.count(), 0.2)
    return sample.union_sources(base=base, aux=sample.sample(aux, "doc_id", n, 5))


def reservoir_sample(spark, d):
    return sample.sample(_docs(spark, d).select("doc_id", "n_chars"), "doc_id", 100, 7)


def select_ordinals(spark, d):
    rows = _docs(spark, d).select("doc_id")
    return sample.select_ordinals(rows, "doc_id", table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("ordinal")))


def head_limit(spark, d):
    return sample.head(_docs(spark, d).select("doc_id", "n_chars"), "doc_id", 50)


def ratio_mix(spark, d):
    return sample.ratio_mix(_docs(spark, d), _chats(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")), "doc_id", "id", 0.3, 1)


def quota_allocation(spark, d):
    n = _chats(spark, d).count()
    a, b = sample.quotas(n // 2, 0.7, 0.1)
    return spark.createDataFrame([("a", a), ("b", b)], "source string, quota long")


def export_documents(spark, d):
    return readers.export_documents(_docs(spark, d), 200, -1, 2).select("new_id", "source_id")


def rerank_top1(spark, d):
    rows = _docs(spark, d).select("lang", "source", "doc_id", (F.col("n_chars") % 50).alias("score"))
    return sample.first_best(rows, ["lang", "source"], "score", "doc_id")


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def codebook(spark, d):
    """(k, v, centroid): unit means of the vectors by their number modulo 64, as a codebook of 4 stages of 16."""
    each = _vectors(spark, d).select((F.col("vec_id") % (STAGES * CENTRES)).cast("int").alias("g"), F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("g", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    made = means.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    return made.select(F.expr(f"cast(g div {CENTRES} as int)").alias("k"), F.expr(f"cast(g % {CENTRES} as int)").alias("v"), rvq.unit(F.col("c")).alias("centroid"))


def codebook_norms(spark, d):
    return codebook(spark, d).select("k", "v", F.round(rvq.dot(F.col("centroid"), F.col("centroid")), 6).alias("norm"))


def _coded(spark, d, renorm=True):
    return rvq.encode(_vectors(spark, d), "embedding", rvq.collect_codebook(codebook(spark, d)), renorm)


def rvq_encode(spark, d):
    return _coded(spark, d).select("vec_id", "codes")


def rvq_encode_raw(spark, d):
    return _coded(spark, d, False).select("vec_id", "codes")


def rvq_encode_native(spark, d):
    return rvq.encode_native(_vectors(spark, d), "embedding", codebook(spark, d)).select("vec_id", "codes")


def rvq_recon_error(spark, d):
    book = rvq.collect_codebook(codebook(spark, d))
    out = rvq.reconstruction_errors(rvq.encode(_vectors(spark, d), "embedding", book), "embedding", book)
    return out.select("stage", *[F.round(c, 6).alias(c) for c in ("mse", "cosine", "cos_dist")])


def rvq_fit(spark, d):
    """Four stages fitted to all vectors: each centroid's length, the vectors that a stage dealt out, and that its error fell."""
    made = rvq.fit(_vectors(spark, d), "embedding", STAGES, CENTRES, niter=8)
    dealt = F.sum("size").over(Window.partitionBy("k"))  # at most CENTRES rows each
    return made.select("k", "v", F.round(rvq.dot(F.col("centroid"), F.col("centroid")), 6).alias("norm"), dealt.alias("dealt"), (F.col("last_error") < F.col("first_error")).alias("fell"))


def nearest_centroid(spark, d):
    """The nearest centroid of every stage, as a join of all vectors with the broadcast codebook."""
    book = codebook(spark, d).select("k", "v", "centroid")
    scored = _vectors(spark, d).crossJoin(F.broadcast(book)).select("vec_id", "k", "v", rvq.dot(F.col("embedding").cast("array<double>"), F.col("centroid")).alias("score"))
    return scored.groupBy("vec_id", "k").agg(F.min_by("v", F.struct(-F.col("score"), F.col("v"))).alias("code"))


def code_strings(spark, d):
    return _coded(spark, d).select("vec_id", K.codes_to_text(F.col("codes")).alias("text"), K.codes_to_special(F.col("codes"), CENTRES).alias("special"))


def parse_codes(spark, d):
    return _coded(spark, d).select("vec_id", K.parse_codes(F.concat(F.lit("x c9=y "), K.codes_to_text(F.col("codes")), F.lit(" c7="))).alias("codes"))


def special_tokens(spark, d):
    """The vocabulary of code tokens, with how many vectors use each."""
    used = _coded(spark, d).select(F.posexplode("codes").alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("uses"))
    return K.code_tokens(spark, STAGES, CENTRES).join(used, ["k", "v"], "left").select("k", "v", "token", F.coalesce("uses", F.lit(0)).alias("uses"))


def code_prompts(spark, d):
    c = F.col("codes")
    ctx = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return _coded(spark, d).select("vec_id", K.format_prompt(ctx, c, "none").alias("plain"), K.format_prompt(ctx, c, "text").alias("text"), K.format_prompt(ctx, c, "special", CENTRES).alias("special"))


def attached_codes(spark, d):
    """Every vector's row and its codes by key; vectors stand for sentences."""
    rows = _vectors(spark, d).select("vec_id", "label")
    return rvq.attach_codes(rows, _coded(spark, d).select("vec_id", "codes"), "vec_id")


def zipped_embeddings(spark, d):
    """Rows in order of label and id, as sentences, each with the vector of its place."""
    rows = _vectors(spark, d).select("label", F.col("vec_id").alias("sent_id")).filter("label is not null")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding")[0].cast("double").alias("first"))
    rows = rows.withColumn("__label", F.col("label").cast("long"))
    zipped = rvq.attach_embeddings(rows.select("__label", "sent_id"), vectors, ["__label", "sent_id"])
    return zipped.select("sent_id", F.col("row_id").cast("long").alias("row_id"), F.round("first", 6).alias("first"))


def planner_rows(spark, d):
    """Vectors of a label are a document's sentences: the six tuples before each, and its own."""
    coded = _coded(spark, d).select("label", "vec_id", "codes")
    made = windows.sliding(coded, "label", "vec_id", {"codes": "ctx"}, 6)
    return made.select("label", "vec_id", F.flatten("ctx").alias("ctx_codes"), F.col("codes").alias("tgt_codes"))


def valid_code_rows(spark, d):
    return readers.code_rows(planner_rows(spark, d), STAGES).select("vec_id")


def planner_table(spark, d):
    return P.count_planner(planner_rows(spark, d), STAGES).withColumn("p", F.round("p", 9))


def _predicted(spark, d):
    rows = planner_rows(spark, d)
    return rows.join(P.plan(rows, P.count_planner(rows, STAGES), "vec_id", STAGES), "vec_id")


def head_accuracy(spark, d):
    return metrics.head_accuracy(_predicted(spark, d)).withColumn("head_acc", F.round("head_acc", 9))


def tuple_accuracy(spark, d):
    return metrics.tuple_accuracy(_predicted(spark, d)).withColumn("tuple_acc", F.round("tuple_acc", 9))


def planner_perplexity(spark, d):
    """Of the share of each vector's codes among all with the same head."""
    codes = _coded(spark, d).select("vec_id", F.posexplode("codes").alias("head", "code"))
    share = codes.groupBy("head", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("head")))
    rows = codes.join(share, ["head", "code"]).groupBy("vec_id").agg(F.collect_list("p").alias("p"))
    return metrics.perplexity(rows).select(F.round("avg_ce", 6).alias("avg_ce"), F.round("perplexity", 4).alias("perplexity"))


def code_agreement(spark, d):
    a, b = _coded(spark, d).select("vec_id", F.col("codes").alias("pred_codes")), _coded(spark, d, False).select("vec_id", F.col("codes").alias("gen_codes"))
    rows = a.join(b, "vec_id").withColumn("pred_codes", F.when(F.col("vec_id") % 10 != 0, F.col("pred_codes")))
    return metrics.agreement(rows).withColumns({c: F.round(c, 9) for c in ("head_match", "tuple_match")})


def match_scores(spark, d):
    a, b = _coded(spark, d).select("vec_id", F.col("codes").alias("a")), _coded(spark, d, False).select("vec_id", F.col("codes").alias("b"))
    return a.join(b, "vec_id").select("vec_id", K.match_score(F.col("a"), F.col("b")).alias("score"))


def hashed_embeddings(spark, d):
    """The stand-in encoder's vector of every benchmark text, a row a number."""
    made = P.embed(table(spark, d, "benchmark"), "text", P.HashingEncoder())
    return made.select("item_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


def generated(spark, d):
    """Three steps of generation from the first context of each label's vectors, four candidates each, with all vectors as library."""
    rows, coded = planner_rows(spark, d), _coded(spark, d)
    prompts_ = rows.filter("label is not null").groupBy("label").agg(F.min_by("ctx_codes", "vec_id").alias("ctx_codes")).select(F.col("label").alias("prompt_id"), "ctx_codes")
    library = coded.select(F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), "codes")
    out = G.generate(prompts_, rows, library, STAGES, 3, temp=0.5, top_p=0.9, n_cand=4, seed=11, save_candidates=True)
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["text"], x["score"].cast("string"))), ", "))


def generated_plain(spark, d):
    """The same without candidates: the planned tuple itself is looked up."""
    rows, coded = planner_rows(spark, d), _coded(spark, d)
    prompts_ = rows.filter("label is not null").groupBy("label").agg(F.min_by("ctx_codes", "vec_id").alias("ctx_codes")).select(F.col("label").alias("prompt_id"), "ctx_codes")
    library = coded.select(F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), "codes")
    return G.generate(prompts_, rows, library, STAGES, 2, rerank=False, do_sample=False).select("prompt_id", "step", "text", "match")


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_documents(spark, d):
    """What is counted while the documents (some of them blanked) are written: one job, no second scan."""
    docs = _docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 10 == 3, " \t ").otherwise(F.col("text")))
    return spark.createDataFrame([sinks.write_documents(docs, _folder(spark, "documents"))], "seen long, empty long, too_long long, written long")


def written_reasons(spark, d):
    """Why paragraphs are dropped, counted while the others are written."""
    reasons = ["empty", "markup", "pipe_eq", "short", "symbol_ratio"]
    seen = sinks.write_reasons(filters.judged_paragraphs(_docs(spark, d)), _folder(spark, "paragraphs"), "reason", reasons)
    return spark.createDataFrame([x for x in seen.items() if x[1]], "reason string, rows long")


def written_mix(spark, d):
    """The counters of a mix of turns (some blanked) and code texts, from its writing."""
    base = _chats(spark, d).select(F.lit("base").alias("kind"), F.when(F.col("conv_id") % 9 == 2, " ").otherwise(F.col("text")).alias("tgt_text"))
    aux = _coded(spark, d).select(F.lit("aux").alias("kind"), K.codes_to_text(F.col("codes")).alias("tgt_text"))
    seen = sinks.write_mix(base.unionByName(aux), _folder(spark, "mix"))
    return spark.createDataFrame([seen], "rows_in_base long, rows_in_aux long, rows_out long, rows_out_base long, rows_out_aux long, skipped_empty long, control_in_tgt long, control_pct double")


def routed_rows(spark, d):
    """Planner and decoder rows of both splits, written in one job and read again from their four places."""
    path = _folder(spark, "routed")
    sinks.write_routed(planner_rows(spark, d).filter("label is not null").withColumn("is_val", K.is_val(F.col("label"), 0.5)), path)
    rows = spark.read.schema("label int, vec_id long, ctx_codes array<int>, tgt_codes array<int>, kind string, split string").json(path)
    return rows.select("kind", "split", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), "ctx_codes", "tgt_codes")  # planner rows have none


QUOTAS = instruct.plan_quotas(("chats", "pairs"), 150, 8, (0.3, 0.7))


def _hubs(spark, d):
    """Whole conversations, of which some have an empty turn, and questions with answers and a system text."""
    chats = _chats(spark, d).withColumn("text", F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 0), "").otherwise(F.col("text")))
    one = F.struct("turn", "role", F.col("text").alias("content"))
    chats = chats.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    pairs = _pairs(spark, d).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return instruct.gathered({"chats": instruct.Hub(chats, "conv_id", C.normalize_messages(F.col("messages"))), "pairs": instruct.Hub(pairs, "id", C.question_messages(F.lit("Be brief."), F.col("question"), F.col("answer")))})


def pulled_instruct(spark, d):
    made = instruct.pulled(_hubs(spark, d), QUOTAS, 40)
    return made.select("source", "split", "key", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("text"))


def pull_counters(spark, d):
    return instruct.pull_counters(_hubs(spark, d), QUOTAS, 40)


def array_files(spark, d):
    """The embeddings by vec_id as .npz files of 32-bit numbers, written and read again: each row's place, size and sum."""
    path = f"{shared_dir(spark)}/arrays-{uuid.uuid4().hex}"
    arrays.write_arrays(_vectors(spark, d), path, "embedding", "vec_id", member="emb")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return arrays.read_arrays(spark, path, "emb").select("row_id", F.size("vector").alias("size"), F.round(total, 5).alias("total"))


def documents_from_json_lines(spark, d):
    """The documents as JSON lines in order of doc_id, some without a text, with odd ids or no JSON at all, written and read again."""
    kind = F.col("doc_id") % 10
    given = F.when(kind == 1, F.concat(F.col("doc_id").cast("string"), F.lit(".5"))).when(kind == 2, "a-b").otherwise(F.col("doc_id").cast("string"))
    record = F.to_json(F.struct(given.alias("doc_id"), F.col("lang").alias("title"), F.when(kind == 3, " \t").otherwise(F.col("text")).alias("text")))
    lines = _docs(spark, d).orderBy("doc_id").select(F.when(kind == 4, F.concat(F.lit("{"), record)).otherwise(record).alias("value"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    made = readers.documents(spark, path)
    return made.select("ord", "doc_id", "title", F.length("text").alias("chars"), "status")


def line_corpus(spark, d):
    """Lines of all documents as one corpus; every line that starts a document follows a blank one."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), "\n")).alias("pos", "value"))
    return readers.line_corpus(windows.number(lines, ["doc_id", "pos"], "ord"))


def flagship(spark, d):
    return context_windows(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        clean_whitespace, clean_messages, clean_qa_text, split_sentences, abbreviations, learned_sentences, sentence_ids, sentence_forms, paragraphs, clean_paragraphs, clean_reason_counts, symbol_ratio, markup_flags, decoder_targets,
        control_token_check, mix_validation, strip_control_tokens, role_norm, conversation_docs, normalized_conversations, prompt_of_messages, instruction_texts, question_messages, prompts,
        qa_pairs_filtered, qa_reason_counts, qa_first_dot, qa_items, qa_more_items, shaped_documents, decoder_row_files, qa_dedup, doc_hash_split, first_row_id, document_ids, stage_counters, context_windows, context_windows_stripped, document_runs, pad_context,
        split_report, chat_history_full, chat_history_kept, chat_reason_counts, seeded_shuffle, positional_split, sample_without_replacement, reservoir_sample, select_ordinals, head_limit, ratio_mix,
        quota_allocation, export_documents, rerank_top1, codebook_norms, rvq_encode, rvq_encode_raw, rvq_encode_native, rvq_recon_error, rvq_fit, nearest_centroid, code_strings, parse_codes, special_tokens,
        code_prompts, attached_codes, zipped_embeddings, planner_rows, valid_code_rows, planner_table, head_accuracy, tuple_accuracy, planner_perplexity, code_agreement, match_scores, hashed_embeddings, generated, generated_plain, pulled_instruct, pull_counters, written_documents, written_reasons, written_mix, routed_rows, array_files, documents_from_json_lines, line_corpus,
    ]
    return {f.__name__: f for f in named}
