"""Array files, read and written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.sources import arrays


def read(spark, path, **how):
    rows = arrays.read_arrays(spark, str(path), **how).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(len(rows)))
    return [r.vector for r in rows]


@pytest.mark.parametrize("dtype", ["<f2", "<f4", ">f8", "<i4", "u1", "<i8"])
def test_read_types(spark, tmp_path, dtype):
    x = np.arange(600).reshape(100, 6).astype(dtype)
    np.save(tmp_path / "x.npy", x)
    assert read(spark, tmp_path / "x.npy", part_bytes=200) == x.astype(float).tolist()
    kind = {"<f2": "float", "<f4": "float", ">f8": "double", "<i4": "int", "u1": "smallint", "<i8": "bigint"}[dtype]
    assert dict(arrays.read_arrays(spark, str(tmp_path / "x.npy")).dtypes) == {"row_id": "bigint", "vector": f"array<{kind}>"}


def test_shapes_and_members(spark, tmp_path):
    x, y = np.random.default_rng(1).normal(size=(7, 3, 2)), np.arange(5)
    np.savez(tmp_path / "plain.npz", centroids=x, n=y)
    np.savez_compressed(tmp_path / "packed.npz", centroids=x)
    assert read(spark, tmp_path / "plain.npz", member="centroids", part_bytes=100) == x.tolist()
    assert read(spark, tmp_path / "packed.npz", part_bytes=100) == x.tolist()
    assert read(spark, tmp_path / "plain.npz", member="n", part_bytes=8) == y.tolist()
    with pytest.raises(Exception, match="say which"):
        arrays.read_arrays(spark, str(tmp_path / "plain.npz")).count()
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="column order"):
        arrays.read_arrays(spark, str(tmp_path / "columns.npy")).count()
    np.save(tmp_path / "none.npy", np.zeros((0, 4), np.float32))
    assert read(spark, tmp_path / "none.npy") == []


def test_rows_are_read_in_ranges(spark, tmp_path):
    """Each task opens the file at its own rows; none reads all of them."""
    np.save(tmp_path / "x.npy", np.zeros((1000, 8), np.float32))
    df = arrays.read_arrays(spark, str(tmp_path / "x.npy"), part_bytes=32 * 100)
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 10 and {r["count"] for r in sizes} == {100}


@pytest.mark.parametrize("member", [None, "emb"])
def test_round_trip(spark, tmp_path, monkeypatch, member):
    x = np.random.default_rng(2).normal(size=(500, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").orderBy(F.rand(3)).repartition(7)
    path = tmp_path / "out"
    arrays.write_arrays(df, str(path), "v", "id", member=member, parts=5)
    files = sorted(p for p in path.iterdir())
    assert all(p.name.startswith("part-") and p.suffix == (".npz" if member else ".npy") for p in files) and len(files) > 1
    loaded = [np.load(p)[member] if member else np.load(p) for p in files]
    assert np.array_equal(np.concatenate(loaded), x)  # other programs read them, too
    assert read(spark, path, member=member, part_bytes=300) == x.astype(float).tolist()
    with pytest.raises(Exception, match="FileExists"):
        arrays.write_arrays(df, str(path), "v", "id")


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(40, [1.0])]
    for n, bad in enumerate((rows, [*rows[:40], (41, None)], [(1, [1.0, None])])):
        path = tmp_path / str(n)
        with pytest.raises(Exception, match="array"):
            arrays.write_arrays(spark.createDataFrame(bad, "id long, v array<double>"), str(path), "v", "id")
        assert not path.exists() or not list(path.iterdir())
    arrays.write_arrays(spark.createDataFrame([], "id long, v array<double>"), str(tmp_path / "empty"), "v", "id")
    assert read(spark, tmp_path / "empty") == []
