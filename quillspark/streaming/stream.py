"""The stateless stages on streams, and sliding contexts with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.filters import judged_paragraphs
from quillspark.operators.windows import split_sentences


def stream_sentences(docs: DataFrame, least: int = 15, most: int = 300) -> DataFrame:
    """split_sentences is one projection, so it runs on a stream as it is."""
    return split_sentences(docs, least, most)


def stream_paragraphs(docs: DataFrame) -> DataFrame:
    return judged_paragraphs(docs)


def stream_contexts(sentences: DataFrame, n: int = 6) -> DataFrame:
    """(doc_id, pos, ctx_text, tgt_text) as sentences of a document arrive in order; the state is its last n sentences."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = []
        for pdf in batches:
            for pos, text in pdf.sort_values("pos")[["pos", "text"]].itertuples(index=False):
                if len(last) == n:
                    rows.append((key[0], pos, " ".join(last), text))
                last = [*last, text][-n:]
        state.update((last,))
        yield pd.DataFrame(rows, columns=["doc_id", "pos", "ctx_text", "tgt_text"])

    return sentences.select("doc_id", F.col("pos").cast("long").alias("pos"), "text").groupBy("doc_id").applyInPandasWithState(step, "doc_id long, pos long, ctx_text string, tgt_text string", "last array<string>", "append", GroupStateTimeout.NoTimeout)
