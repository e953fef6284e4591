"""Array files (.npy, .npz) as tables, and tables as array files.

An array of shape (rows, ...) is a table (row_id, vector). A path is a file, or a folder of files that are one array, cut
into rows in the order of their names. Headers are read when the table is planned; then each task reads a range of rows
from its place in a file, a few megabytes at a time. Only a compressed member of an .npz can't be entered in its middle, and
is one task's work.

Writing gives a folder with a file or more for each task, of rows in order. Files get their names when all tasks have succeeded;
a failed write leaves none.

Paths are opened with Arrow's file systems (local or shared folders, hdfs, s3, gs), on the driver for headers and in tasks
for rows. Null vectors and rows of other shapes than the first can't be written; an empty table gives an empty array.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of rows that a task reads at once, and by default in all.
CHUNK, PART = 4 << 20, 64 << 20
#: How numbers appear in a table: (kind, bytes) of the array, type of the column, numpy's name of it.
NUMBERS = {("f", 2): ("float", "f4"), ("f", 4): ("float", "f4"), ("f", 8): ("double", "f8"), ("i", 1): ("tinyint", "i1"), ("i", 2): ("smallint", "i2"), ("i", 4): ("int", "i4"), ("i", 8): ("bigint", "i8"), ("u", 1): ("smallint", "i2"), ("u", 2): ("int", "i4"), ("u", 4): ("bigint", "i8")}


@dataclass
class Header:
    """Where an array's numbers begin in a file, or in a member that must be unpacked from its start."""

    path: str
    member: str | None
    packed: bool
    at: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def row_bytes(self) -> int:
        return int(np.dtype(self.dtype).itemsize * np.prod(self.shape[1:], dtype=np.int64))


@dataclass
class Rows(InputPartition):
    header: Header
    start: int
    stop: int
    first: int  # row_id of start

    def __init__(self, header: Header, start: int, stop: int, first: int):
        self.header, self.start, self.stop, self.first = header, start, stop, first


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _array_header(f) -> tuple[int, tuple[int, ...], str]:
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order have no rows to read apart; save them in row order")
    if not shape or (dtype.kind, dtype.itemsize) not in NUMBERS:
        raise ValueError(f"no table of an array of shape {shape} and type {dtype}")
    return f.tell(), shape, dtype.str


def headers(path: str, member: str | None = None) -> list[Header]:
    """Of all files of an array, in order."""
    system, where = _system(path)
    info = system.get_file_info(where)
    if info.type == pafs.FileType.Directory:
        names = sorted(x.path for x in system.get_file_info(pafs.FileSelector(where)) if x.path.endswith((".npy", ".npz")))
    elif info.type == pafs.FileType.File:
        names = [where]
    else:
        raise FileNotFoundError(path)
    out = []
    for name in names:
        with system.open_input_file(name) as f:
            if not name.endswith(".npz"):
                out.append(Header(name, None, False, *_array_header(f)))
                continue
            with zipfile.ZipFile(f) as z:
                known = [x.removesuffix(".npy") for x in z.namelist()]
                if member is None and len(known) != 1:
                    raise ValueError(f"{name} has the members {', '.join(known)}; say which")
                one = z.getinfo(f"{member or known[0]}.npy")
                with z.open(one) as g:
                    at, shape, dtype = _array_header(g)
                packed = one.compress_type != zipfile.ZIP_STORED
            if not packed:  # after the member's own header: 30 bytes, its name and its extra field
                f.seek(one.header_offset)
                local = f.read(30)
                at += one.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
            out.append(Header(name, one.filename, packed, at, shape, dtype))
    if len({(h.shape[1:], np.dtype(h.dtype)) for h in out if h.shape[0]}) > 1:
        raise ValueError(f"the files of {path} differ in shape or type")
    return out


def _nested(values: np.ndarray, shape: tuple[int, ...]) -> pa.Array:
    """Rows of numbers as lists of lists."""
    out, n = pa.array(values.ravel()), values.size
    for size in reversed(shape):
        n = n // size if size else len(values)
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), out)
    return out


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, member: str | None, part: int):
        self.path, self.member, self.part = path, member, part

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for h in headers(self.path, self.member):
            step = h.shape[0] if h.packed else max(1, self.part // max(1, h.row_bytes))
            out += [Rows(h, a, min(a + step, h.shape[0]), first + a) for a in range(0, h.shape[0], max(1, step))]
            first += h.shape[0]
        return out or [Rows(Header("", None, False, 0, (0,), "<f4"), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = partition.header
        if partition.stop <= partition.start:
            return
        as_type = NUMBERS[np.dtype(h.dtype).kind, np.dtype(h.dtype).itemsize][1]
        system, _ = _system(self.path)
        with system.open_input_file(h.path) as raw:
            f = zipfile.ZipFile(raw).open(h.member) if h.packed else raw
            f.seek(h.at + partition.start * h.row_bytes)
            step = max(1, CHUNK // max(1, h.row_bytes))
            for a in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - a)
                data = f.read(n * h.row_bytes)
                if len(data) < n * h.row_bytes:
                    raise ValueError(f"{h.path} ends before its row {a + n}")
                values = np.frombuffer(data, dtype=h.dtype).reshape(n, *h.shape[1:]).astype(as_type)
                ids = np.arange(n, dtype=np.int64) + (partition.first + a - partition.start)
                yield pa.RecordBatch.from_arrays([pa.array(ids), _nested(values, h.shape[1:])], names=["row_id", "vector"])


@dataclass
class Parts(WriterCommitMessage):
    """Files that a task has written, and the names they are to get."""

    names: list[tuple[str, str]]


def _numbers(column: pa.Array, dtype: str) -> tuple[tuple[int, ...], bytes]:
    """The shape of a column's rows, and their numbers."""
    shape = []
    while pa.types.is_list(column.type):
        sizes = set(pc.list_value_length(column).to_pylist())
        if None in sizes or len(sizes) > 1:
            raise ValueError("rows of an array have one shape, and none is null")
        shape += sizes
        column = column.flatten()
    if column.null_count:
        raise ValueError("a null number has no place in an array")
    return tuple(shape), column.to_numpy(zero_copy_only=False).astype(dtype).tobytes()


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, member: str | None):
        self.path, self.dtype, self.member = path, dtype, member
        self.open = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        """A file for each PART bytes, as a header says how many rows follow it."""
        names, held, size, rows, shape = [], [], 0, 0, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            own, data = _numbers(batch.column(0), self.dtype)
            if shape not in (None, own):
                raise ValueError(f"rows of an array have one shape, not {shape} and {own}")
            shape = own
            held.append(data)
            size, rows = size + len(data), rows + batch.num_rows
            if size >= PART:
                names.append(self._file(len(names), (rows, *shape), held))
                held, size, rows = [], 0, 0
        if rows:
            names.append(self._file(len(names), (rows, *shape), held))
        return Parts(names)

    def _file(self, number: int, shape: tuple[int, ...], data: list[bytes]) -> tuple[str, str]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():06}-{number:06}" + (".npz" if self.member else ".npy")
        tried = f"{context.taskAttemptId()}-{name}"
        system, where = _system(self.path)
        system.create_dir(posixpath.join(where, self.open), recursive=True)
        with system.open_output_stream(posixpath.join(where, self.open, tried)) as out:
            if self.member:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z, z.open(f"{self.member}.npy", "w", force_zip64=True) as f:
                    self._put(f, shape, data)
            else:
                self._put(out, shape, data)
        return tried, name

    def _put(self, f, shape: tuple[int, ...], data: list[bytes]) -> None:
        np.lib.format.write_array_header_1_0(f, {"descr": np.lib.format.dtype_to_descr(np.dtype(self.dtype)), "fortran_order": False, "shape": shape})
        for one in data:
            f.write(one)

    def commit(self, messages: list[Parts | None]) -> None:
        system, where = _system(self.path)
        system.create_dir(where, recursive=True)
        for tried, name in (n for m in messages if m for n in m.names):
            system.move(posixpath.join(where, self.open, tried), posixpath.join(where, name))
        self._clear()

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, where = _system(self.path)
        at = posixpath.join(where, self.open)
        if system.get_file_info(at).type == pafs.FileType.Directory:
            system.delete_dir(at)


class Arrays(DataSource):
    """Options: path, member (of .npz files), part_bytes (read by a task), dtype (of written numbers)."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        found = headers(self.options["path"], self.options.get("member"))
        if not found:
            return "row_id bigint, vector array<float>"
        dtype = np.dtype(found[0].dtype)
        kind = NUMBERS[dtype.kind, dtype.itemsize][0]
        for _ in found[0].shape[1:]:
            kind = f"array<{kind}>"
        return f"row_id bigint, vector {kind}"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self.options.get("member"), int(self.options.get("part_bytes", PART)))

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        system, where = _system(self.options["path"])
        if system.get_file_info(where).type != pafs.FileType.NotFound:
            raise FileExistsError(self.options["path"])
        return ArrayWriter(self.options["path"], self.options.get("dtype", "<f4"), self.options.get("member"))


def read_arrays(spark: SparkSession, path: str, member: str | None = None, part_bytes: int = PART) -> DataFrame:
    """(row_id, vector): the rows of the array at path; row_id counts over all of its files."""
    spark.dataSource.register(Arrays)
    reader = spark.read.format("arrays").option("part_bytes", str(part_bytes))
    return (reader.option("member", member) if member else reader).load(path)


def write_arrays(rows: DataFrame, path: str, vector: str, order: str, dtype: str = "<f4", member: str | None = None, parts: int | None = None) -> None:
    """The vectors of all rows, by ``order``, as an array in a new folder; with ``member``, as .npz files of that member;
    written by so many tasks (as Spark sees fit by default).
    """
    rows.sparkSession.dataSource.register(Arrays)
    placed = (rows.repartitionByRange(parts, order) if parts else rows.repartitionByRange(order)).sortWithinPartitions(order).select(F.col(vector).alias("vector"))
    writer = placed.write.format("arrays").mode("append").option("dtype", dtype)
    (writer.option("member", member) if member else writer).save(path)
