"""Distribution kernels against known values."""

import math

import numpy as np
import pytest

from assaylake.functions import kernels as k


def test_gamma_functions():
    assert k.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert k.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    y = np.array([0.05, 0.7, 3.0, 40.0])
    assert k.trigamma_inverse(k.trigamma(y)) == pytest.approx(y, rel=1e-9)


def test_t_distribution():
    assert k.t_quantile(0.975, np.array([1.0, 10.0, np.inf])) == pytest.approx([12.706204736, 2.228138852, 1.959963985], abs=1e-6)
    assert 2 * k.t_upper(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-8)


def test_normal_tail():
    assert k.normal_upper(np.array([1.959963984540054]))[0] == pytest.approx(0.025, abs=1e-12)
    assert k.normal_quantile(np.array([0.975]))[0] == pytest.approx(1.959963984540054, abs=1e-9)
