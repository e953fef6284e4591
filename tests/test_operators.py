"""Windows, samples, codes, metrics, readers, models and streams on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.models import planner as P
from quillspark.operators import filters, metrics, rvq, sample, windows
from quillspark.plans import queries
from quillspark.sources import readers, sinks
from quillspark.streaming import stream


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_context_counts(spark):
    sentence = "This is a long sentence number {}. "
    df = docs(spark, [(1, "".join(sentence.format(i) for i in range(6))), (2, "".join(sentence.format(i) for i in range(7))), (3, None), (4, "")])
    rows = windows.context_rows(windows.split_sentences(df)).collect()
    assert [(r.doc_id, r.pos) for r in rows] == [(2, 6)]
    assert rows[0].tgt_text.endswith("number 6.") and rows[0].ctx_text.count("number") == 6


def test_older_contexts_inherit_documents(spark):
    rows = [(i, 1 if i == 0 else None, f"s{i} ") for i in range(8)] + [(8, 2, "other"), (9, 2, "  ")]
    found = windows.context_rows_stripped(spark.createDataFrame(rows, "sent_id long, doc_id long, text string")).orderBy("sent_id").collect()
    assert [(r.doc_id, r.sent_id, r.ctx_text) for r in found] == [(1, 6, "s0 s1 s2 s3 s4 s5"), (1, 7, "s1 s2 s3 s4 s5 s6")]


def test_older_contexts_fall_back_and_encode(spark):
    """An empty text is its content; codes are made from the texts that count."""
    rows = [(i, 1, "" if i % 2 else f"a{i}", f" c{i}" if i != 3 else "  ") for i in range(9)]
    df = spark.createDataFrame(rows, "sent_id long, doc_id long, text string, content string")
    texts = [(i, (t or c).strip()) for i, _, t, c in rows if (t or c).strip()]
    found = windows.context_rows_stripped(df, 3).orderBy("sent_id").collect()
    assert [(r.sent_id, r.ctx_text, r.tgt_text) for r in found] == [(texts[j][0], " ".join(x for _, x in texts[j - 3 : j]), texts[j][1]) for j in range(3, len(texts))]
    encoder, book = P.HashingEncoder(8), np.random.default_rng(1).normal(size=(2, 4, 8))
    codes = dict(zip([i for i, _ in texts], rvq.encode_matrix(encoder.encode([t for _, t in texts]), book).tolist(), strict=True))
    coded = P.encoded_contexts(df, encoder, book, 3).orderBy("sent_id").collect()
    assert [(r.sent_id, r.ctx_text) for r in coded] == [(r.sent_id, r.ctx_text) for r in found]
    for j, r in enumerate(coded, 3):
        assert list(r.tgt_codes) == codes[r.sent_id] and list(r.ctx_codes) == [c for i, _ in texts[j - 3 : j] for c in codes[i]]


def test_runs_restart(spark):
    rows = [(0, 1), (1, 1), (2, 2), (3, 1), (99_999, 1), (100_000, 1), (100_001, 3)]
    found = windows.runs(spark.createDataFrame(rows, "o long, d long"), "d", "o").orderBy("o").collect()
    assert [r.run for r in found] == [0, 0, 2, 3, 3, 3, 100_001]


def test_number_is_dense(spark):
    rows = [(i * 7 % 101, i) for i in range(101)]
    found = windows.number(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], "n", 5).orderBy("a").collect()
    assert [r.n for r in found] == list(range(101))


def test_histories(spark):
    rows = [(1, 0, "user", "Hi there."), (1, 1, "assistant", "One two three. Ok. Four five six."), (1, 2, "user", "More?"), (1, 3, "assistant", "Yes indeed."), (2, 0, "assistant", "No."), (2, 1, "assistant", "Seven eight."), (3, 0, "user", "  ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    full = {(r.conv_id, r.turn, r.pos): r.ctx_text for r in windows.chat_history_full(df).collect()}
    assert full[(1, 1, 2)] == "### User:\nHi there.\n\n### Assistant:\nOne two three. Ok.\n"
    assert full[(1, 3, 0)] == "### User:\nHi there.\n\n### Assistant:\nOne two three. Ok. Four five six.\n\n### User:\nMore?\n\n### Assistant:\n\n"
    kept = {(r.conv_id, r.turn, r.pos): r.ctx_text for r in windows.chat_history_kept(df).collect()}
    assert kept[(1, 1, 2)] == "User: Hi there.\nAssistant: One two three.\nAssistant:"
    assert kept[(1, 3, 0)] == "User: Hi there.\nAssistant: One two three. Four five six.\nUser: More?\nAssistant:"
    assert kept[(2, 1, 0)] == "Assistant:"
    counts = {r.reason: r.rows for r in windows.chat_counters(df).collect()}
    assert counts == {"kept": 4, "too_short": 2, "missing_content": 1}


def test_mix(spark):
    base, aux = spark.range(40).withColumnRenamed("id", "b"), spark.range(100, 130).withColumnRenamed("id", "a")
    rows = sample.ratio_mix(base, aux, "b", "a", 0.2, 3).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(50))
    for kind, n in (("base", 40), ("aux", 10)):
        keys = [r.key for r in rows if r.kind == kind]
        assert len(keys) == n and keys == sorted(keys)
    assert sample.ratio_mix(base, None, "b", "a").count() == 40
    assert sample.ratio_mix(base, aux, "b", "a", 0.0).filter("kind = 'aux'").count() == 0
    assert sample.ratio_count(5, 0.5) == 5 and sample.ratio_count(1, 1 / 3) == 0  # 0.5 rounds to even
    with pytest.raises(ValueError):
        sample.ratio_count(5, 1.0)


def test_quotas_and_counts(spark):
    assert sample.quotas(10, 0, 0) == (5, 5) and sample.quotas(10, 1, 0) == (10, 0)
    assert sample.weighted_count(7, 100, 0.5) == 7 and sample.weighted_count(7, 3, 0.5) == 3
    df = spark.range(20)
    assert sample.sample(df, "id", 0).count() == 0
    assert [r.is_train for r in sample.positional_split(df, "id").collect()].count(True) == 19
    assert sample.head(df, "id", -1).count() == 20 and sample.head(df, "id", 3).count() == 3


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 2.0), ("a", 2, None), ("b", 5, None)], "g string, o int, s double")
    assert {(r.g, r.o) for r in sample.first_best(df, ["g"], "s", "o").collect()} == {("a", 0), ("b", 5)}
    q = spark.createDataFrame([(0, "Who?"), (1, "WHO?"), (2, "x")], "i int, q string")
    assert sorted(r.i for r in sample.dedup_questions(q, "q", ["i"]).collect()) == [0, 2]


def test_rvq(spark):
    rng = np.random.default_rng(0)
    book = rng.normal(size=(3, 8, 6))
    book /= np.linalg.norm(book, axis=2, keepdims=True)
    book[0, 5] = book[0, 2]  # a tie: the lower one counts
    table = spark.createDataFrame([(k, v, [float(x) for x in book[k, v]]) for k in range(3) for v in range(8)], "k int, v int, centroid array<double>")
    x = rng.normal(size=(50, 6))
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)] + [(50, None)], "i int, e array<double>")
    assert np.allclose(rvq.collect_codebook(table), book)
    for renorm in (True, False):
        want = rvq.encode_matrix(x, book, renorm).tolist()
        found = {r.i: r.codes for r in rvq.encode(df, "e", book, renorm).collect()}
        assert [found[i] for i in range(50)] == want and found[50] is None
        native = {r.i: r.codes for r in rvq.encode_native(df.filter("e is not null"), "e", table, renorm).collect()}
        assert [native[i] for i in range(50)] == want
    assert not (rvq.encode_matrix(x, book)[:, 0] == 5).any()
    with pytest.raises(ValueError):
        rvq.collect_codebook(table.filter("not (k = 1 and v = 3)"))
    fitted = rvq.collect_codebook(rvq.fit(df, "e", 2, 4, niter=3))
    assert fitted.shape == (2, 4, 6) and np.allclose(np.linalg.norm(fitted, axis=2), 1)
    with pytest.raises(ValueError):
        rvq.attach_codes(spark.range(3), spark.range(2), "id")


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "pred_codes array<int>, tgt_codes array<int>, gen_codes array<int>, p array<double>")
    assert metrics.tuple_accuracy(none).first().tuple_acc == 0
    assert metrics.agreement(none).first().total == 0
    assert metrics.perplexity(none).first().perplexity == 1
    low = spark.createDataFrame([([1e-30],)], "p array<double>")
    assert metrics.perplexity(low).first().perplexity == float("inf")
    some = spark.createDataFrame([(None, [1]), ([1], [1]), ([1], [2])], "pred_codes array<int>, gen_codes array<int>")
    r = metrics.agreement(some).first()
    assert (r.total, r.skipped, r.head_match, r.tuple_match) == (2, 1, 0.5, 0.5)


def test_document_reader(spark, tmp_path):
    lines = ['{"doc_id": 12, "text": "a"}', "", "not json", '{"doc_id": "a-b", "text": ""}', '{"text": "long text", "title": null}', '{"doc_id": 3.7, "content": "c"}']
    (tmp_path / "docs.jsonl").write_text("\n".join(lines))
    rows = readers.documents(spark, str(tmp_path / "docs.jsonl"), max_chars=5).orderBy("ord").collect()
    assert [(r.doc_id, r.status) for r in rows] == [(12, "ok"), (1, "bad_json"), (2, "empty"), (3, "too_long"), (3, "ok")]
    assert readers.documents(spark, str(tmp_path / "docs.jsonl"), max_docs=2).count() == 2


def test_line_corpus(spark):
    lines = ["", " a ", "b", "", "", "c", "", "  "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "ord long, value string")
    assert [(r.doc, r.text) for r in readers.line_corpus(df).orderBy("doc").collect()] == [(0, "a b"), (1, "c")]


def test_qa_readers(spark):
    df = spark.createDataFrame([("Stem", (["A", "B"], ["x1", "y2"]), "B"), ("Stem", (["A"], ["x1"]), "Z")], "question_stem string, choices struct<label:array<string>,text:array<string>>, answerKey string")
    assert [tuple(r) for r in readers.qa_choices(df, "c").collect()] == [("c", "Stem (A) x1 (B) y2", "y2")]
    df = spark.createDataFrame([("Q", ("", "norm"))], "question string, answer struct<value:string,normalized_value:string>")
    assert readers.qa_values(df, "v").first().answer == "norm"
    assert readers.dataset_spec("a:b, c") == [("a", "b"), ("c", "train")]
    with pytest.raises(ValueError):
        readers.dataset_spec(" ")


def test_qa_items_takes_whole_answers(spark, tmp_path):
    """Answers of 2 to 220 characters stay whole; longer ones are no items, whatever their start."""
    answers = ["x", "xy", "a" * 51, "b" * 101, "c" * 220, "d" * 221, "e" * 3000, None]
    rows = [r for i, a in enumerate(answers) for r in ((i, 0, "user", f"Q{i}"), (i, 1, "assistant", a))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {(r.source, r.question, r.answer) for r in queries.qa_items(spark, str(tmp_path)).collect()}
    kept = [(i, a) for i, a in enumerate(answers) if a and 2 <= len(a) <= 220]
    assert found == {(s, f"Q{i}", a) for s in ("spans", "lists") for i, a in kept} | {("choices", f"Q{i} (A) no (B) {a}", a) for i, a in kept}


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("é", None, [1, 2], True), ("b", "t", [3, 4], False)], "ctx_text string, tgt_text string, tgt_codes array<int>, is_val boolean").withColumn("ctx_codes", F.col("tgt_codes"))
    sinks.write_routed(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/kind=dec/split=val")).count() == 1
    sinks.write_json_lines(rows.drop("is_val"), str(tmp_path / "json"))
    assert {tuple(r.codes) for r in readers.decoder_rows(spark, str(tmp_path / "json")).collect()} == {(1, 2), (3, 4)}
    assert readers.decoder_rows(spark, str(tmp_path / "none")).count() == 0
    sinks.write_metadata(metrics.stage_counters(docs(spark, [(1, "a")])), str(tmp_path / "meta"), seed=3)
    part = next((tmp_path / "meta").glob("part-*.json"))
    assert json.loads(part.read_text()) == {"seen": 1, "empty": 0, "too_long": 0, "written": 1, "seed": 3}


def test_models(spark):
    assert np.allclose(P.masked_mean(np.ones((1, 3, 2)), np.array([[1, 1, 0]])), 2**-0.5)
    rows = spark.createDataFrame([(i, [1, 2], [3, 4]) for i in range(3)] + [(3, [1, 2], [5, 4])], "i long, ctx_codes array<int>, tgt_codes array<int>")
    planner = P.count_planner(rows, 2)
    assert {r.pred for r in planner.filter("ctx = 1").collect()} == {3}
    prompts = spark.createDataFrame([(0, [1, 2] * 6), (1, [9, 9] * 6)], "prompt_id long, ctx_codes array<int>")
    assert {tuple(r.pred_codes) for r in P.plan(prompts, planner, "prompt_id", 2).collect()} == {(3, 4)}


def test_streams(spark, tmp_path):
    df = docs(spark, [(1, "".join(f"A sentence with number {i}. " for i in range(9))), (2, "Short one here too.")])
    df.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made in (("s", stream.stream_sentences(read)), ("p", stream.stream_paragraphs(read)), ("c", stream.stream_contexts(stream.stream_sentences(read)))):
        q = made.writeStream.format("memory").queryName(f"out_{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("out_s").count() == windows.split_sentences(df).count()
    assert spark.table("out_p").count() == filters.judged_paragraphs(df).count()
    want = {(r.doc_id, r.pos, r.ctx_text) for r in windows.context_rows(windows.split_sentences(df)).collect()}
    assert {(r.doc_id, r.pos, r.ctx_text) for r in spark.table("out_c").collect()} == want and len(want) == 3


def test_plans_push_down(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("A text.").alias("text"), F.lit("x").alias("other"))
    df.write.parquet(str(tmp_path / "d"))
    plan = windows.split_sentences(spark.read.parquet(str(tmp_path / "d")).filter("doc_id > 5"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "other" not in plan.split("ReadSchema")[-1] and "Exchange" not in plan
    assert T.MARKUP


def test_codes_and_vectors_meet_by_key(spark):
    with pytest.raises(ValueError, match="1 sentences without codes and 1 code"):
        rvq.attach_codes(spark.range(3), spark.range(1, 4), "id")  # as many, but others
    said = spark.createDataFrame([(9, "b"), (4, "a")], "sent_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "row_id long, v array<double>")
    with pytest.warns(UserWarning, match="1 vectors have no sentence"):
        assert {(r.text, r.v[0]) for r in rvq.attach_embeddings(said, vectors).collect()} == {("a", 1.0), ("b", 2.0)}
    with pytest.raises(ValueError, match="1 sentences have no vector"):
        rvq.attach_embeddings(said, vectors.filter("row_id = 0"))


def test_document_ids_by_json_type(spark, tmp_path):
    lines = ['{"doc_id": -3.7, "text": "a"}', '{"doc_id": "3.75", "text": "b"}', '{"doc_id": "12", "text": "c"}', '{"doc_id": 8, "text": "d"}', '{"text": "e"}', "no json"]
    (tmp_path / "docs.jsonl").write_text("\n".join(lines))
    found = {r.text: (r.doc_id, r.status) for r in readers.documents(spark, str(tmp_path / "docs.jsonl")).collect()}
    assert found == {"a": (-3, "ok"), "b": (1, "ok"), "c": (12, "ok"), "d": (8, "ok"), "e": (4, "ok"), "": (5, "bad_json")}


def test_sample_is_by_rank(spark):
    rows = spark.range(500)
    taken = sample.sample(rows, "id", 40, 3)
    assert "TakeOrdered" not in taken._jdf.queryExecution().toString()
    want = {r.id for r in rows.orderBy(sample.place(3, F.col("id")), "id").limit(40).collect()}
    assert {r.id for r in taken.collect()} == want
    assert sample.weighted_count(10, 5, 1.0) == 5
