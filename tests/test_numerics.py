import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from varloom.functions import numerics as nm


def test_known_values():
    assert nm.chi2_ppf(0.16, 1) == pytest.approx(0.0407610, abs=1e-7)
    assert nm.f_ppf(0.99, 10, 5) == pytest.approx(10.0510, abs=1e-4)
    assert nm.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert nm.digamma(7.3) - nm.digamma(6.3) == pytest.approx(1 / 6.3, abs=1e-12)
    assert nm.chi2_cdf(nm.chi2_ppf(0.3, 4.5), 4.5) == pytest.approx(0.3, abs=1e-12)


@pytest.mark.parametrize("n", [2, 3, 7])
def test_equal_weights_are_a_chi_square(n):
    assert nm.wchi2_quantile([2.0] * n, 0.16) == pytest.approx(nm.chi2_ppf(0.16, n) / n, rel=1e-12)
    nearly = [1.0 + 1e-9 * k for k in range(n)]  # by inversion
    assert nm.wchi2_quantile(nearly, 0.16) == pytest.approx(nm.chi2_ppf(0.16, n) / n, rel=1e-6)


@settings(max_examples=25, deadline=None)
@given(some.lists(some.floats(0.01, 10.0), min_size=2, max_size=12), some.floats(0.05, 0.6))
def test_quantile_inverts_the_law(w, p):
    assert nm.wchi2_cdf(w, nm.wchi2_quantile(w, p)) == pytest.approx(p, abs=1e-7)


def test_weights_without_any():
    assert nm.wchi2_quantile([0.0, -1.0], 0.16) == 1.0
    assert nm.wchi2_cdf([], 0.5) == 1.0


def test_law_by_simulation():
    rng = np.random.default_rng(0)
    w = np.array([5.0, 1.0, 0.2]) / 6.2
    q = nm.wchi2_quantile(w, 0.16)
    assert ((rng.standard_normal((400_000, 3)) ** 2 @ w) <= q).mean() == pytest.approx(0.16, abs=0.003)


def test_brent():
    assert nm.brent(math.cos, 1.0, 2.0) == pytest.approx(math.pi / 2, abs=1e-12)
    with pytest.raises(ValueError):
        nm.brent(math.cos, 0.0, 0.1)


def test_assignment():
    c = np.random.default_rng(3).random((6, 6))
    least = min(sum(c[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    assert c[np.arange(6), nm.assignment(c)].sum() == pytest.approx(least)


def test_pivoted_cholesky_of_a_singular_matrix():
    a = np.random.default_rng(4).random((7, 3))
    low, piv, rank = nm.pivoted_cholesky(a @ a.T)
    assert rank == 3
    assert np.allclose(low @ low.T, (a @ a.T)[np.ix_(piv[:3], piv[:3])])
