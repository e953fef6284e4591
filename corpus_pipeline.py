"""A training corpus from raw documents: quality, exact copies, near copies, mixing to weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and read again as the next
one's docs. Counts as a part of ``quillspark.llm``. A stage first deletes the tables of the stages before it, but what
``docs`` reads.

Nulls: a null text is judged, matched and packed as the empty one, which the quality stage has no reason to reject; a null
doc_id is the last of its group; null languages and sources are a leaf of the mix. Of ties and repeated rows one stays in
the second and third stage. Extra columns pass through all stages but the last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, jaccard_join, kneser_ney, mixing, packing
from quillspark.llm.common import materialise, read_table, release

#: Near copies share 80 in 100 of their five-word shingles.
WORDS, PERCENT = 5, 80
#: No document is taken more often than this.
EPOCHS = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; thresholds come from labelled documents."""
    release(spark, docs)
    return kneser_ney.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of equal texts."""
    release(spark, docs)
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    release(spark, docs)
    return jaccard_join.drop_near_copies(docs, WORDS, PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents of each source up to its budget, some of them twice."""
    release(spark, docs)
    return mixing.mix(docs, max_epochs=EPOCHS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into windows."""
    release(spark, docs)
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixing", mixing_stage), ("packing", packing_stage)]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
