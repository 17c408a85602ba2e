"""The linear fits against plain dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksentry.operators import fits


def test_columns_are_minimised_apart():
    rng = np.random.default_rng(2)
    centre, scale = rng.normal(size=(5, 4)), np.array([0.01, 1, 30, 1000])
    at = fits.minimise(lambda x: ((scale * (x - centre) ** 2).sum(axis=0) + ((x - centre) ** 4).sum(axis=0), 2 * scale * (x - centre) + 4 * (x - centre) ** 3), np.zeros((5, 4)), 200, 1e-9)
    assert np.abs(at - centre).max() < 1e-3
    still = fits.minimise(lambda x: (np.zeros(2), np.zeros((3, 2))), np.ones((3, 2)), 10)
    assert (still == 1).all()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = []
    for i in range(240):
        label = i % 3
        terms = sorted(set(rng.integers(0, 12, 4).tolist()) | {label * 4 + int(rng.integers(0, 4))})
        made.append((terms, rng.random(len(terms)).tolist() if i % 40 else [0.0] * len(terms), label, i // 3 % 2))
    made.append(([], [], 1, 0))
    path = spark.createDataFrame(made, "indices array<int>, weights array<double>, label int, _fold int")
    x = np.zeros((len(made), 12))
    for i, (terms, weights, _, _) in enumerate(made):
        x[i, terms] = weights
    return path, x, np.array([r[2] for r in made]), np.array([r[3] for r in made])


@pytest.mark.parametrize(("folds", "sums"), [([0, 1], 64), ([0, 1], 0), ([0], 64)])
def test_one_pass_serves_all_folds_and_labels(spark, rows, tmp_path, monkeypatch, folds, sums):
    monkeypatch.setattr(fits, "SUMS", max(sums, 8))
    df, x, label, fold = rows
    if len(folds) == 1:
        df, fold = df.withColumn("_fold", F.lit(0)), np.zeros_like(fold)
    df.repartition(12).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    which, c = np.array(folds), 0.7
    counts = np.array([(fold == k).sum() for k in folds], float)
    points = fits.squared_hinge(stored, 12, 3, which, c, counts, 200)
    slopes, shifts = fits.sigmoids(stored, points, 3, which)
    for j in range(len(folds) * 3):
        k, y = folds[j // 3], j % 3
        use = np.ones(len(x), bool) if len(folds) == 1 else fold != k
        side = np.where(label[use] == y, 1.0, -1.0)

        def value(p):
            lack = np.maximum(1 - side * (x[use] @ p[:-1] + p[-1]), 0)
            return 0.5 * p[:-1] @ p[:-1] + c * (lack * lack).sum()

        # a minimum: nothing near is better
        rng, best = np.random.default_rng(j), value(points[:, j])
        assert all(value(points[:, j] + 1e-2 * rng.normal(size=13)) > best * (1 - 1e-5) for _ in range(200))
        held = fold == k
        margin, hit = x[held] @ points[:-1, j] + points[-1, j], label[held] == y
        t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
        p = 1 / (1 + np.exp(-(slopes[j] * margin + shifts[j])))
        assert abs((p - t).sum()) < 1e-4 * len(t) and abs(((p - t) * margin).sum()) < 1e-4 * len(t)
