"""Sinks: counters in flight, four outputs of one job, and the cache."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import filters, metrics
from quillspark.sources import sinks


def read(path):
    return [json.loads(x) for p in sorted(Path(path).rglob("part-*")) for x in p.read_text().splitlines()]


def jobs_of(spark, group, what):
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = what()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_documents_are_counted_while_written(spark, tmp_path):
    texts = ["fine", None, "", " \t\n", "x" * 30, "é" * 9, " padded "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string")
    seen, jobs = jobs_of(spark, "docs", lambda: sinks.write_documents(df, str(tmp_path / "d"), 20))
    assert seen == {"seen": 35, "empty": 15, "too_long": 5, "written": 15} and jobs == 1
    assert metrics.stage_counters(df, 20).first().asDict() == seen and len(read(tmp_path / "d")) == 15
    assert {r["text"] for r in read(tmp_path / "d")} == {"fine", "é" * 9, " padded "}
    assert sinks.write_documents(df.limit(0), str(tmp_path / "none")) == {"seen": 0, "empty": 0, "too_long": 0, "written": 0}
    assert sinks.write_documents(df, str(tmp_path / "all"), 0)["too_long"] == 0


def test_reasons_are_counted_while_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "short\n\n" + "a long enough paragraph of words\n\n" + "{{markup}} and so on and on and on"), (2, None)], "doc_id long, text string")
    rows = filters.judged_paragraphs(docs)
    seen = sinks.write_reasons(rows, str(tmp_path / "p"), "reason", ["short", "markup", "empty"])
    assert seen == {"short": 1, "markup": 1, "empty": 0, "other": 0, "kept": 1}
    assert {k: v for k, v in seen.items() if v} == {r.reason: r.rows for r in filters.reason_counts(rows).collect()}
    assert [r["paragraph"] for r in read(tmp_path / "p")] == ["a long enough paragraph of words"]
    assert sinks.write_reasons(rows, str(tmp_path / "q"), "reason", ["short"])["other"] == 1


def test_mix_counters(spark, tmp_path):
    rows = spark.createDataFrame([("base", "a"), ("base", " "), ("base", "see <c1_2>"), ("aux", None), ("aux", "c3=4 b"), ("aux", "xc3=4")], "kind string, tgt_text string")
    seen = sinks.write_mix(rows, str(tmp_path / "m"))
    assert seen == {"rows_in_base": 3, "rows_in_aux": 3, "rows_out": 4, "rows_out_base": 2, "rows_out_aux": 2, "skipped_empty": 2, "control_in_tgt": 2, "control_pct": 50.0}
    assert len(read(tmp_path / "m")) == 4


def test_four_outputs_of_one_job(spark, tmp_path):
    seen_rows = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(x):
        seen_rows.add(1)
        return x

    rows = spark.createDataFrame([(f"t{i}", [i], [i, i], i % 4 == 0) for i in range(40)], "tgt_text string, tgt_codes array<int>, ctx_codes array<int>, is_val boolean")
    rows = rows.withColumn("tgt_text", F.when(F.col("tgt_text") == "t3", None).otherwise(once("tgt_text")))
    counts, jobs = jobs_of(spark, "routed", lambda: sinks.write_routed(rows, str(tmp_path / "r")))
    assert counts == {"lm_train": 30, "lm_val": 10, "dec_train": 30, "dec_val": 10} and jobs == 1 and seen_rows.value <= 40  # the source was computed once
    for kind in ("lm", "dec"):
        for split in ("train", "val"):
            found = read(tmp_path / "r" / f"kind={kind}" / f"split={split}")
            assert len(found) == counts[f"{kind}_{split}"] and all((r["tgt_codes"][0] % 4 == 0) == (split == "val") for r in found)
            assert all(set(r) == ({"ctx_codes", "tgt_codes"} if kind == "lm" else {"tgt_text", "tgt_codes", "ctx_codes"}) for r in found)


def test_failed_job_leaves_no_output(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i], [i], False) for i in range(20)], "i int, tgt_codes array<int>, ctx_codes array<int>, is_val boolean").repartition(4)
    bad = rows.withColumn("i", F.when(F.col("i") == 13, F.raise_error(F.lit("no luck")).cast("int")).otherwise(F.col("i")))
    with pytest.raises(Exception, match="no luck"):
        sinks.write_routed(bad, str(tmp_path / "r"))
    assert not list((tmp_path / "r").rglob("part-*"))


def test_cache(spark, tmp_path):
    source, store, built = tmp_path / "in.txt", str(tmp_path / "store"), []
    source.write_text("a\nb\n")

    def build():
        built.append(1)
        return spark.read.text(str(source)).withColumn("n", F.length("value"))

    def get(**params):
        return sorted(r.value for r in sinks.cached(spark, store, [str(source), str(tmp_path / "absent")], build, **params).collect())

    assert get(v=1) == get(v=1) == ["a", "b"] and len(built) == 1  # the second call reads
    assert get(v=2) == ["a", "b"] and len(built) == 2
    time.sleep(0.01)
    source.write_text("a\nb\nc\n")
    assert get(v=1) == ["a", "b", "c"] and len(built) == 3  # a changed file misses
    assert not [p for p in Path(store).iterdir() if p.name.startswith("_")] and len(list(Path(store).iterdir())) == 3
    with pytest.raises(Exception, match="broken"):
        sinks.cached(spark, store, [str(source)], lambda: spark.range(9).select(F.raise_error(F.lit("broken")).cast("int").alias("x")), v=9)
    assert len(list(Path(store).iterdir())) == 3  # whole tables only
    assert len(sinks.cache_key([["p", 1, 2]], k=3)) == 16 and sinks.cache_key([["p", 1, 2]]) != sinks.cache_key([["p", 1, 3]])
