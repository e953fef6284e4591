"""Histories on streams against the batch operators: out of order, over a restart, and with turns that never come."""

import random
import time

import pytest

from quillspark.operators import windows
from quillspark.streaming import histories

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def stream_spark(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", histories.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def turns():
    rng = random.Random(7)
    rows = []
    for conv in range(25):
        for turn in range(rng.randrange(2, 8)):
            role = rng.choice(["user", "assistant", "assistant", "system", ""])
            said = " ".join(rng.choice(["Fine then.", "No.", "A longer sentence is here!", "Ok?", "<c1_2>.", "x " * 130 + "."]) for _ in range(rng.randrange(5)))
            rows.append((conv, turn, role, rng.choice([said, said, None])))
    return rows


def run(spark, made, tmp_path, name):
    """All that is there, into files; a query of the same name goes on where the last one stopped."""
    q = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / name))
    q.awaitTermination(60)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()))


@pytest.mark.parametrize("name", ["full", "kept"])
def test_any_order_and_a_restart(stream_spark, tmp_path, name):
    spark, rows = stream_spark, turns()
    random.Random(3).shuffle(rows)
    made = {"full": histories.stream_history_full, "kept": histories.stream_history_kept}[name]
    batch = {"full": windows.chat_history_full, "kept": windows.chat_history_kept}[name]
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    found = []
    for part in (rows[:50], rows[50:]):  # the query ends after the first part, and starts anew from its checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found.append(run(spark, made(read, wait=None), tmp_path, name))
    want = sorted(map(tuple, batch(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found[1] == want and len(want) > 10 and len(found[0]) < len(want)


def test_contexts_in_any_order(stream_spark, tmp_path):
    spark = stream_spark
    rows = [(d, p, f"s{d}.{p}") for d in range(3) for p in range(10)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, pos long, text string")
    df.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windows.context_rows(df).select("doc_id", "pos", "ctx_text", "tgt_text").collect()))
    assert run(spark, histories.stream_contexts_in_order(read, wait=None), tmp_path, "c") == want and len(want) == 12


def test_turns_that_never_come(stream_spark, tmp_path):
    """A gap is skipped once its time is over; a turn that comes after that is dropped, and one that comes again is, too."""
    spark = stream_spark

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, 0, "user", "Hello there."), (1, 2, "assistant", "The answer is late.")])
    read = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = histories.stream_history_full(read, wait=1500).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 60
        while not spark.table("late").count() and time.time() < end:
            time.sleep(0.5)
        put([(1, 1, "user", "Too late."), (1, 2, "assistant", "Once again."), (1, 3, "assistant", "And another one.")])
        while spark.table("late").count() < 2 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    found = sorted((r.turn, r.ctx_text, r.tgt_text) for r in spark.table("late").collect())
    first = "### User:\nHello there.\n\n### Assistant:\n\n"
    assert found == [(2, first, "The answer is late."), (3, "### User:\nHello there.\n\n### Assistant:\nThe answer is late.\n\n### Assistant:\n\n", "And another one.")]
