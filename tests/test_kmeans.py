"""Spherical k-means against plain numpy, with empty cells and few vectors."""

import numpy as np
import pytest

from quillspark.operators import kmeans, rvq


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def frame(spark, x):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<double>").repartition(5)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    middles = unit(rng.normal(size=(6, 12)))
    return unit(middles[rng.integers(0, 6, 600)] + 0.15 * rng.normal(size=(600, 12)))


def test_steps_are_lloyds(spark, cloud):
    start = cloud[:6]
    want, errors = unit(start), []
    for _ in range(4):
        own = np.argmax(cloud @ want.T, axis=1)
        errors.append(1 - (cloud * want[own]).sum(1).mean())
        want = unit(np.array([cloud[own == j].sum(0) for j in range(6)]))
    found = kmeans.spherical_kmeans(frame(spark, [*cloud, None]), "e", 6, 4, start=start)
    assert np.allclose(found.centres, want) and np.allclose(found.errors[:4], errors)
    assert found.sizes.tolist() == np.bincount(np.argmax(cloud @ want.T, axis=1), minlength=6).tolist()
    assert all(a >= b - 1e-12 for a, b in zip(found.errors, found.errors[1:], strict=False))


def test_empty_cells_are_split(spark, cloud):
    """Two starts that come again win no vector: both get vectors of the largest cells, and the error falls below that without them."""
    start = np.concatenate([cloud[:2], cloud[:2]])
    found = kmeans.spherical_kmeans(frame(spark, cloud), "e", 4, 12, start=start)
    assert found.splits >= 1 and (found.sizes > 0).all() and found.sizes.sum() == 600
    two = kmeans.spherical_kmeans(frame(spark, cloud), "e", 2, 12, start=start[:2])
    assert found.errors[-1] < two.errors[-1]
    centres, sizes = unit(np.eye(3)), np.array([10, 0, 0])
    assert kmeans.split_empty(centres, sizes) == 2 and centres[:, 0].min() > 0.99


def test_few_vectors(spark):
    few = frame(spark, [[1, 0, 0], [0, 1, 0], [1, 0, 0]])
    found = kmeans.spherical_kmeans(few, "e", 4, 5)
    assert np.allclose(np.linalg.norm(found.centres, axis=1), 1) and found.sizes.sum() == 3 and found.errors[-1] < 1e-4
    with pytest.raises(ValueError):
        kmeans.spherical_kmeans(few.limit(0), "e", 2)


def test_codebook(spark, cloud):
    """Stages are fitted to what those before leave: reconstruction gets better, and codes use many centroids."""
    df = frame(spark, cloud)
    table = rvq.fit(df, "e", 3, 8, niter=10)
    rows = table.collect()
    assert [(r.k, r.v) for r in sorted(rows)] == [(k, v) for k in range(3) for v in range(8)]
    assert all(sum(r.size for r in rows if r.k == k) == 600 for k in range(3)) and all(r.last_error <= r.first_error for r in rows)
    book = rvq.collect_codebook(table)
    coded = rvq.encode(df, "e", book)
    errors = [r.mse for r in rvq.reconstruction_errors(coded, "e", book).orderBy("stage").collect()]
    assert errors[0] < 0.5
    rest, first = cloud - book[0][np.argmax(cloud @ book[0].T, axis=1)], cloud
    assert (rest**2).sum(1).mean() < (first**2).sum(1).mean() / 2
    assert rvq.fit(df, "e", 1, 8, niter=2, train_n=50).agg({"size": "sum"}).first()[0] == 50
