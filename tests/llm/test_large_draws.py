"""Draws beyond numpy's generator follow the hypergeometric law."""

import math
from collections import Counter

import numpy as np
import pytest

from quillon.llm import mixing


def law(good, bad, draw):
    return {k: math.comb(good, k) * math.comb(bad, draw - k) / math.comb(good + bad, draw) for k in range(max(0, draw - bad), min(good, draw) + 1)}


@pytest.mark.parametrize("good,bad,draw", [(3, 9, 4), (7, 2, 6), (30, 50, 40), (1, 1, 1)])
def test_small_laws(monkeypatch, good, bad, draw):
    monkeypatch.setattr(mixing, "GENERATOR_LIMIT", 0)
    rng, n = np.random.default_rng(3), 3000
    got = Counter(mixing._hypergeometric(rng, good, bad, draw) for _ in range(n))
    want = law(good, bad, draw)
    assert set(got) <= set(want)
    assert all(abs(got[k] / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 1 / n for k, p in want.items())


def test_few_of_many():
    """3 of 2e9 + 3, a quarter drawn: nearly binomial, which a rounded normal is not."""
    rng, n = np.random.default_rng(4), 4000
    got = Counter(mixing._hypergeometric(rng, 3, 2_000_000_000, 500_000_000) for _ in range(n))
    for k in range(4):
        p = math.comb(3, k) * 0.25**k * 0.75 ** (3 - k)
        assert abs(got[k] / n - p) <= 4 * (p * (1 - p) / n) ** 0.5


def test_huge_draws_have_the_laws_moments():
    rng, good, bad, draw = np.random.default_rng(5), 4 * 10**12, 6 * 10**12, 5 * 10**12
    x = np.array([mixing._hypergeometric(rng, good, bad, draw) for _ in range(1000)], dtype=float) - 2 * 10**12
    sd = (draw * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(x.mean()) <= 4 * sd / 1000**0.5 and 0.9 <= x.std() / sd <= 1.1


def test_log_factorials():
    for n in (0, 1, 5, 99, 100, 101, 1000):
        assert abs(float(mixing._log_factorial(n)) - math.lgamma(n + 1)) <= 1e-12 * max(1, math.lgamma(n + 1))
    step = mixing._log_factorial(10**12 + 1) - mixing._log_factorial(10**12)
    assert abs(float(step) - math.log(10**12 + 1)) < 1e-12
