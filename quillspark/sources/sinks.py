"""Writers: JSON lines, routed training sets, rows counted while they are written, one-row metadata, a cache of tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept, text stays as it is."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_counted(rows: DataFrame, path: str, counters: dict[str, Column], keep: Column | None = None) -> dict[str, int]:
    """Writes the rows that ``keep`` says as JSON lines, and counts all that pass on their way: for each name, the rows where its
    condition is true. Rows are computed and read once; a task that runs again counts once.
    """
    seen = Observation(f"written-{uuid.uuid4().hex}")
    rows = rows.observe(seen, *[F.count_if(c).alias(name) for name, c in counters.items()])
    write_json_lines(rows if keep is None else rows.filter(keep), path)
    return {name: int(seen.get[name]) for name in counters}


def write_documents(docs: DataFrame, path: str, most_chars: int = 200_000) -> dict[str, int]:
    """Writes documents that are neither blank nor longer than most_chars (0: of any length); returns seen, empty, too_long and written."""
    text = F.coalesce("text", F.lit(""))
    blank = T.strip(text) == ""
    long = ~blank & (F.length(text) > most_chars) if most_chars > 0 else F.lit(False)
    return write_counted(docs, path, {"seen": F.lit(True), "empty": blank, "too_long": long, "written": ~blank & ~long}, ~blank & ~long)


def write_reasons(rows: DataFrame, path: str, reason: str, reasons: list[str]) -> dict[str, int]:
    """Writes the rows without a reason, without that column; returns the rows of each of ``reasons``, of any other, and those kept."""
    r = F.col(reason)
    counters = {x: F.coalesce(r == x, F.lit(False)) for x in reasons} | {"other": r.isNotNull() & ~r.isin(reasons), "kept": r.isNull()}
    seen = Observation(f"reasons-{uuid.uuid4().hex}")
    rows = rows.observe(seen, *[F.count_if(c).alias(name) for name, c in counters.items()])
    write_json_lines(rows.filter(r.isNull()).drop(reason), path)
    return {name: int(seen.get[name]) for name in counters}


def write_mix(rows: DataFrame, path: str, kind: str = "kind", target: str = "tgt_text") -> dict[str, float]:
    """Writes mixed rows (kinds base and aux) whose targets aren't blank, in order of their slots where there are any.

    Returns the counters of the mix; control tokens in targets are only counted, their percentage is of rows written.
    """
    t = F.coalesce(F.col(target), F.lit(""))
    full = T.strip(t) != ""
    base = F.col(kind) == "base"
    counters = {"rows_in_base": base, "rows_in_aux": ~base, "rows_out": full, "rows_out_base": full & base, "rows_out_aux": full & ~base, "skipped_empty": ~full, "control_in_tgt": full & t.rlike(T.CONTROL_MIX)}
    out: dict[str, float] = dict(write_counted(rows, path, counters, full))
    out["control_pct"] = round(100.0 * out["control_in_tgt"] / max(1, out["rows_out"]), 4)
    return out


def write_routed(rows: DataFrame, path: str, is_val: str = "is_val") -> dict[str, int]:
    """Planner rows (codes only) and decoder rows, each parted by split, as JSON lines: kind=lm/split=train and so on.

    Each row goes to both kinds as it passes, so its source is computed once; the four outputs are one job and are committed
    together. Returns the rows of each.
    """
    split = F.when(F.col(is_val), "val").otherwise("train")
    whole = F.struct(*[c for c in rows.columns if c != is_val])
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), F.to_json(what, {"ignoreNullFields": "false"}).alias("value")) for kind, what in (("lm", F.struct("ctx_codes", "tgt_codes")), ("dec", whole))])
    seen = Observation(f"routed-{uuid.uuid4().hex}")
    routed = rows.observe(seen, F.count_if(~F.coalesce(F.col(is_val), F.lit(False))).alias("train"), F.count_if(F.col(is_val)).alias("val"))
    routed.select(split.alias("split"), F.inline(lines)).write.partitionBy("kind", "split").text(path)
    return {f"{kind}_{part}": int(seen.get[part]) for kind in ("lm", "dec") for part in ("train", "val")}


def write_metadata(counters: DataFrame, path: str, **params) -> None:
    """Parameters and counters of a stage as one JSON row."""
    one = counters.withColumns({k: F.lit(v) for k, v in params.items()})
    one.coalesce(1).write.option("ignoreNullFields", "false").json(path)


def signatures(spark: SparkSession, *paths: str) -> list[list]:
    """[path, size, time of change] of all files at the paths, in order; of a path that isn't there, [path]."""
    out = []
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            out.append([path])
            continue
        found, files = [], fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        out += sorted(found)
    return out


def cache_key(files: list[list], **params) -> str:
    """16 hexadecimal digits that change with the signatures of files or with parameters."""
    return hashlib.sha256(json.dumps([files, params], sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, store: str, inputs: list[str], build: Callable[[], DataFrame], **params) -> DataFrame:
    """The table that ``build`` makes of the files at ``inputs``, from the store if it has it.

    A table is known by the signatures of the files and the parameters. It is written under another name and then renamed,
    so the store has whole tables only; of two that build the same at once, the first one's stays.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = f"{store.rstrip('/')}/{cache_key(signatures(spark, *inputs), **params)}"
    where = jvm.org.apache.hadoop.fs.Path(final)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        trial = jvm.org.apache.hadoop.fs.Path(f"{store.rstrip('/')}/_building-{uuid.uuid4().hex}")
        try:
            build().write.parquet(trial.toString())
            if not fs.exists(where) and not fs.rename(trial, where) and not fs.exists(where):
                raise OSError(f"the table could not be moved to {final}")
        finally:
            fs.delete(trial, True)
    return spark.read.parquet(final)
