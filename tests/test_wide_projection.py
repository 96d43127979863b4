"""Projections of wide vectors by triangles joined in a tree."""

import numpy as np
import pytest

from quernstone.operators import project
from quernstone.sources import synthetic


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("n", [2, 5, 300])
def test_equal_to_moments(spark, monkeypatch, parts, n):
    monkeypatch.setattr(project, "ROWS", 16)
    v = synthetic.clustered(spark, n, 12, noise=0.4).repartition(parts)
    small = project.fit(v)
    monkeypatch.setattr(project, "WIDE", 4)
    wide = project.fit(v)
    assert np.allclose(wide.mean, small.mean) and np.allclose(np.abs(wide.axes[0]), np.abs(small.axes[0]), atol=1e-6) and np.allclose(wide.explained, small.explained, atol=0.1)
    assert n < 3 or np.allclose(wide.axes[1], small.axes[1], atol=1e-5) and np.isclose(wide.scale, small.scale)


def test_triangle(spark):
    v = synthetic.clustered(spark, 400, 30).repartition(9)
    x = np.array([r.embedding for r in v.collect()], np.float64)
    n, mean = project.means(v, 30)
    r = project.triangle(v, mean)
    assert n == 400 and np.allclose(mean, x.mean(0)) and r.shape == (30, 30)
    assert np.allclose(r.T @ r, (x - mean).T @ (x - mean))


def test_wide(spark):
    v = synthetic.clustered(spark, 120, 2000).repartition(4)
    x = np.array([r.embedding for r in v.collect()], np.float64)
    model = project.fit(v)
    _, size, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(np.array(model.axes) @ axes[:2].T), np.eye(2), atol=1e-6)
    assert np.allclose(model.explained, 100 * size[:2] ** 2 / (size**2).sum(), atol=0.1)


def test_one_and_none(spark, monkeypatch):
    monkeypatch.setattr(project, "WIDE", 4)
    v = synthetic.clustered(spark, 1, 8)
    assert project.fit(v).explained == [100.0, 0.0] and project.fit(v.limit(0)) is None
