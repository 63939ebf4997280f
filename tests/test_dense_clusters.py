"""Clustering over cells against the labels of a task: sparse, dense, repeated and border points; pairs stay in proportion."""

import numpy as np
import pytest

from lotwise.operators import clustering


def frame(spark, panels):
    rows = [(name, k, float(x), float(y), float(eps)) for name, (points, eps) in panels.items() for k, (x, y) in enumerate(points, 1)]
    return spark.createDataFrame(rows, "panel_id string, idx int, x double, y double, eps double").repartition(4)


@pytest.mark.parametrize("min_samples", [1, 3, 6])
def test_cells_equal_the_matrix(spark, min_samples):
    rng = np.random.default_rng(min_samples)
    ring = np.stack([np.cos(np.linspace(0, 6.28, 200)), np.sin(np.linspace(0, 6.28, 200))], 1) * 5
    two = np.concatenate([rng.normal(size=(150, 2)) * 0.2, rng.normal(size=(150, 2)) * 0.2 + [1.9, 0], rng.uniform(-4, 4, (60, 2))])
    grid = np.array([(a, b) for a in range(12) for b in range(12)]) * 1.0  # neighbours at the radius exactly
    same = np.repeat(rng.uniform(-3, 3, (12, 2)), 20, axis=0)
    gap = np.concatenate([rng.uniform(0, 0.5, (80, 2)), rng.uniform(0, 0.5, (80, 2)) + [1.499, 0.0]])  # two clumps a radius apart, more or less
    panels = {"uniform": (rng.uniform(-9, 9, (400, 2)), 1.0), "ring": (ring, 0.3), "two": (two, 1.0), "grid": (grid, 1.0), "same": (same, 0.7), "gap": (gap, 1.0), "one": (np.zeros((1, 2)), 1.0), "large": (rng.uniform(-500, 500, (200, 2)) * 1e6, 4e7)}
    found = {(r.panel_id, r.idx): r.label for r in clustering.label_by_cells(frame(spark, panels), min_samples).collect()}
    for name, (points, eps) in panels.items():
        order = rng.permutation(len(points))  # the frame's order is the scan's
        del order
        want = clustering.label_panel(points[:, 0], points[:, 1], eps, min_samples)
        assert [found[name, k + 1] for k in range(len(points))] == want.tolist(), name


def test_a_dense_panel_makes_few_pairs(spark, monkeypatch):
    """20,000 points within a few radii have some 10^8 pairs of neighbours."""
    rng, made = np.random.default_rng(3), []
    points = np.concatenate([rng.normal(size=(10_000, 2)) * 0.4, rng.normal(size=(9_990, 2)) * 0.4 + [5, 0], rng.uniform(20, 60, (10, 2))])
    monkeypatch.setattr(clustering, "cut", lambda df, cut=clustering.cut: (made.append((out := cut(df)).count()), out)[1])
    labels = [r.label for r in clustering.label_by_cells(frame(spark, {"p": (points, 1.0)}), 3).orderBy("idx").collect()]
    assert set(labels[:10_000]) <= {0, -1} | set(range(2, 9)) and labels.count(0) > 9_000 and len(set(labels)) >= 3
    assert max(made) < 10 * len(points)
