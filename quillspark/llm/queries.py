"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import conversation_repair, decontamination, exact_dedup, jaccard_join, kneser_ney, lbl_lm, line_dedup, minhash, mixing, packing, periodic_runs, toxicity, url_reputation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_reputation.op1_url_filters,
        "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_lm_scoring": lbl_lm.op5_lm_scoring,
        "op6_document_fingerprints": minhash.op6_document_fingerprints,
        "op7_packing": packing.op7_packing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality_classifier": kneser_ney.op9_quality_classifier,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_decontamination": decontamination.op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_reputation.OP1_SQL,
        "op2_ngram_jaccard_join": jaccard_join.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op10_line_dedup": line_dedup.OP10_SQL,
        "op12_conversation_repair": conversation_repair.OP12_SQL,
        "op13_decontamination": decontamination.OP13_SQL,
    }
