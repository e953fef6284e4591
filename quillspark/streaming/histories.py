"""Conversation histories and sliding contexts on streams whose rows come in any order, some late, some never.

Rows of a key are numbered. A row waits in keyed state until all before it have come; then it and those that waited for it
are taken in order, and what is carried (a history, the last sentences) goes on. If nothing fills a gap for ``wait``
milliseconds of processing time, the gap is skipped; rows that come after that are dropped, as what followed them has been
given out. With ``wait`` None gaps wait for good, and no timers are set: a query that is to end by itself (availableNow)
needs that, as batches for timers never end. State is in Spark's state store, so a query that stops goes on from its checkpoint.

Everything that needs one row only is done before, in columns. A key's state is what it carries and the rows that wait.
Set ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which keyed state of this kind needs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quillspark.functions import chat as C
from quillspark.functions import text as T
from quillspark.operators.filters import sentence_reason

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Takes the items of a key by their numbers, from 0; step() says what comes of each."""

    def __init__(self, wait: int | None):
        self.wait = wait

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, carried string")
        self.waiting = handle.getMapState("waiting", "n long", "item string")

    def step(self, key, n: int, carried: str, item: dict) -> tuple[str, list[Row]]:
        raise NotImplementedError

    def _at(self) -> tuple[int, str]:
        return tuple(self.place.get()) if self.place.exists() else (0, "")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, carried = self._at()
        for row in rows:
            if row.n >= n:
                self.waiting.updateValue((row.n,), (row.item,))
        yield from self._go_on(key, n, carried, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, carried = self._at()
        n = min((k[0] for k in self.waiting.keys()), default=n)
        yield from self._go_on(key, n, carried, timerValues)

    def _go_on(self, key, n: int, carried: str, timers) -> Iterator[Row]:
        while self.waiting.containsKey((n,)):
            item = json.loads(self.waiting.getValue((n,))[0])
            self.waiting.removeKey((n,))
            carried, out = self.step(key, n, carried, item)
            yield from out
            n += 1
        self.place.update((n, carried))
        if self.wait is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if next(iter(self.waiting.keys()), None) is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait)

    def close(self) -> None:
        pass


class Histories(InOrder):
    """Each target's context is the history of its conversation and its own end; then the turn's block joins the history."""

    def step(self, key, n, carried, item):
        out = [Row(conv_id=key[0], turn=n, pos=t["pos"], ctx_text=carried + t["tail"], tgt_text=t["tgt"]) for t in item["targets"]]
        return carried + item["block"], out


class Contexts(InOrder):
    """Each sentence with the ``size`` sentences before it, if there are so many."""

    def __init__(self, wait: int | None, size: int):
        super().__init__(wait)
        self.size = size

    def step(self, key, n, carried, item):
        last = json.loads(carried) if carried else []
        out = [Row(doc_id=key[0], pos=n, ctx_text=" ".join(last), tgt_text=item["text"])] if len(last) == self.size else []
        return json.dumps([*last, item["text"]][-self.size :]), out


def _targets(sentences: Column, tail) -> Column:
    """(pos, tail, tgt) of the sentences that are targets; tail: the end of a context from the sentences before and a place."""
    each = F.transform(sentences, lambda s, i: F.struct(i.alias("pos"), tail(F.slice(sentences, 1, i)).alias("tail"), T.strip_control(s).alias("tgt"), sentence_reason(s).alias("reason")))
    return F.transform(F.filter(each, lambda x: x["reason"].isNull()), lambda x: F.struct(x["pos"].alias("pos"), x["tail"].alias("tail"), x["tgt"].alias("tgt")))


def _run(rows: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    return rows.groupBy(key).transformWithState(processor, schema, "append", "None" if processor.wait is None else "ProcessingTime")


def _histories(turns: DataFrame, empty: str, wait: int | None, block, tail) -> DataFrame:
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("n"), C.role_instruct(F.col("role"), empty).alias("role"), T.clean(F.col("text")).alias("content"))
    rows = rows.withColumn("said", F.when(F.col("role") == "Assistant", T.sentences(F.col("content"))))
    none = F.array().cast("array<struct<pos: int, tail: string, tgt: string>>")
    item = F.struct(F.when(F.col("content") != "", block()).otherwise("").alias("block"), F.coalesce(_targets(F.col("said"), tail), none).alias("targets"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _run(rows.select("conv_id", "n", F.to_json(item).alias("item")), "conv_id", Histories(wait), f"conv_id {kind}, turn long, pos int, ctx_text string, tgt_text string")


def stream_history_full(turns: DataFrame, wait: int | None = 60_000) -> DataFrame:
    """The rows of windows.chat_history_full as turns arrive, numbered from 0 in each conversation."""
    def tail(before):
        return F.concat(F.lit("### Assistant:\n"), F.array_join(before, " "), F.lit("\n"))

    return _histories(turns, "Unknown", wait, lambda: C.history_block(F.col("role"), F.col("content")), tail)


def stream_history_kept(turns: DataFrame, wait: int | None = 60_000) -> DataFrame:
    """The rows of windows.chat_history_kept as turns arrive, numbered from 0 in each conversation."""
    def kept(sentences):
        return F.array_join(F.filter(sentences, lambda s: sentence_reason(s).isNull()), " ")

    def tail(before):
        return F.concat(F.when(kept(before) != "", F.concat(F.lit("Assistant: "), kept(before), F.lit("\n"))).otherwise(""), F.lit("Assistant:"))

    def block():
        said = kept(F.col("said"))
        return F.when(F.col("role") != "Assistant", C.history_line(F.col("role"), F.col("content"))).when(said != "", C.history_line(F.col("role"), said)).otherwise("")

    return _histories(turns, "User", wait, block, tail)


def stream_contexts_in_order(sentences: DataFrame, n: int = 6, wait: int | None = 60_000) -> DataFrame:
    """The rows of windows.context_rows as sentences (doc_id, pos from 0, text) arrive in any order."""
    rows = sentences.select("doc_id", F.col("pos").cast("long").alias("n"), F.to_json(F.struct("text")).alias("item"))
    kind = sentences.schema["doc_id"].dataType.simpleString()
    return _run(rows, "doc_id", Contexts(wait, n), f"doc_id {kind}, pos long, ctx_text string, tgt_text string")
