"""What the operators of this subpackage share: tables between jobs, word splitting and hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of words and of normalised texts, as a Java and a DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken in blocks of at most this many bytes (or one text), so memory does not follow the batch size.
BLOCK_BYTES = 2 << 20
#: Rows that go to Python at once.
BATCH_ROWS = 1000

#: Spark's setting under which an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where it is unset, a local one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose whole texts are about to go to Python: at most a thousand rows or 4 MB at once, so that neither the
    JVM's buffers nor the workers hold tens of thousands of texts. Session settings; lower ones of the user's stay.
    """
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(rows)) > BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if conf.get(size, "64m").lower() in ("64m", "64mb", "67108864b", "67108864"):  # Spark's own
        conf.set(size, "4m")
    return df


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing. The
    shuffle files of the write go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() after their last reader, and lets the driver forget finished jobs, whose shuffle
    files the executors then delete. What was made from these tables must have been written.
    """
    for df in tables:
        for path in {p for f in df.inputFiles() for p in _written if f"/{p.rsplit('/', 1)[1]}/" in f}:
            _written.remove(path)
            _delete(df.sparkSession, path)
    forget(tables[0].sparkSession)


def forget(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that executors delete the shuffle files of finished jobs before larger ones
    begin, and give back what it has freed: else its peak grows from job to job with what compilers and buffers leave.
    """
    tidy()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> str | None:
    """Gives memory that the driver's JVM has freed outside its heap back to the machine, as ``jcmd System.trim_native_heap`` does; what it says, or None where a JVM has no such command."""
    jvm = spark.sparkContext._jvm
    try:
        server = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")  # Py4J can't see the class behind it
        call = next(m for m in server.getMethods() if m.getName() == "invoke")
        values = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the last two stay null: no arguments
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Deletes every table that materialise() has written, but those that ``keep`` reads. Other results that still read
    them must have been saved.
    """
    files = {f for df in keep for f in df.inputFiles()}
    for path in [p for p in _written if not any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]:
        _written.remove(path)
        _delete(spark, path)
    forget(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_``, ``name__``, ... that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; null becomes the empty text. Plain single spaces are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def fold(col: Column) -> Column:
    """The 32-bit CRC of a column's text."""
    return F.crc32(col.cast("string").cast("binary"))


def tidy() -> None:
    """Gives memory that a finished task has freed back to the machine: workers live on and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8; null texts are empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
            yield batch.slice(at, to - at), [x or b"" for x in col.slice(at, to - at).to_pylist()]
            at = to
    tidy()


def array_blocks(col: pa.Array) -> Iterator[list[bytes]]:
    """The texts of an Arrow column in blocks, as blocks() has them."""
    batch = pa.RecordBatch.from_arrays([col], names=["text"])
    for _, texts in blocks([batch]):
        yield texts


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: bytes.lower() and bytes.split() know ASCII only, which is just what is asked for."""
    return text.lower().split()


def word_ids(texts: list[bytes], end: bool = False, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as places in them, and where each text starts (one more at the end).

    With ``end``, each text is closed by the empty word; without ``lower``, words keep their case.
    """
    known: dict[bytes, int] = {}
    ids: list[int] = []
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    put = known.setdefault
    for i, text in enumerate(texts):
        ids += [put(w, len(known)) for w in (words_of(text) if lower else text.split())]
        if end:
            ids.append(put(b"", len(known)))
        starts[i + 1] = len(ids)
    return list(known), np.array(ids, dtype=np.int32), starts


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words; of fewer words, one of the whole sequence; of none, none."""
    n = len(hashed)
    if not n:
        return hashed
    width = min(width, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mix(out + hashed[k : n - width + 1 + k])
    return out


def block_shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, ids, starts = word_ids(texts)
    hashed = hashes(words)[ids] if len(ids) else np.zeros(0, dtype=np.uint64)
    for i in range(len(texts)):
        yield np.unique(shingles(hashed[starts[i] : starts[i + 1]], width))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
