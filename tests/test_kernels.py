"""Numpy kernels against their definitions."""

import numpy as np
import pytest

from pulsejobs.functions import points, vec
from pulsejobs.operators.segment import WindowSpec, resample_matrix


def test_resample_of_a_tone():
    n, m = 100, 40
    x = np.sin(2 * np.pi * 3 * np.arange(n) / n)
    assert np.allclose(resample_matrix(n, m) @ x, np.sin(2 * np.pi * 3 * np.arange(m) / m), atol=1e-9)
    assert np.allclose(resample_matrix(n, n), np.eye(n), atol=1e-9)
    assert np.allclose(resample_matrix(10, 20) @ np.ones(10), 1)


def test_band_pass_is_symmetric_and_drops_the_mean():
    m = vec.band_pass_matrix(250, 0.5, 8, 125)
    x = np.exp(-(((np.arange(250) - 124.5) / 20) ** 2))
    y = m @ x
    assert np.allclose(y, y[::-1], atol=0.02)
    assert np.abs(m @ np.ones(250)).max() < 1e-6
    t = np.arange(1250) / 125
    long = vec.band_pass_matrix(1250, 0.5, 8, 125) @ np.sin(2 * np.pi * 2 * t)
    assert np.abs(long[400:850] - np.sin(2 * np.pi * 2 * t)[400:850]).max() < 0.15


def test_spline_passes_its_knots_and_gives_cubics_back():
    x = np.array([0.0, 1, 3, 4, 7, 9])
    f = lambda t: t**3 - 2 * t**2 + 5
    at = np.linspace(-1, 10, 40)
    assert np.allclose(vec.cubic_spline(x, f(x), at), f(at))
    assert np.allclose(vec.cubic_spline(x[:3], x[:3] ** 2, at), at**2)
    assert np.allclose(vec.cubic_spline(x[:2], x[:2], at), at)


def test_peaks_of_a_noisy_sine():
    t = np.arange(625) / 125
    x = np.sin(2 * np.pi * 1.2 * t) + np.random.default_rng(0).normal(0, 0.05, 625)
    (found,) = vec.ampd(x[None], 125)
    assert len(found) == 6
    assert np.abs(np.diff(found) - 125 / 1.2).max() < 10


def test_points_of_a_pulse():
    t = np.arange(100)
    cycle = np.exp(-(((t - 20) / 8.0) ** 2)) + 0.4 * np.exp(-(((t - 50) / 10.0) ** 2))
    w, y, z, a, b, c, d, e = points.points(cycle, 20)
    assert a < w < 20 < y < z
    assert a < b <= c <= d <= e
    assert points.points(np.ones(3), 0) is None


def test_window_sizes():
    assert WindowSpec.of(125, win_sec=5) == WindowSpec(625, 625)
    assert WindowSpec.of(125, win_sam=100, wait_sec=2) == WindowSpec(100, 250)
    with pytest.raises(ValueError):
        WindowSpec.of(125)
