"""The generator's sequence from any place on, against one number at a time."""

import math

import numpy as np
import pytest

from layerstack.operators import randoms
from layerstack.operators.randoms import Lcg48

# The generator as documented.
A, C, M = 0x5DEECE66D, 0xB, 1 << 48


class Slow:
    def __init__(self, seed):
        self.state, self.spare = (seed ^ A) % M, None

    def bits(self, count):
        self.state = (self.state * A + C) % M
        return self.state >> (48 - count)

    def uniform(self):
        high = self.bits(26)
        return ((high << 27) + self.bits(27)) / float(1 << 53)

    def normal(self):
        if self.spare is not None:
            value, self.spare = self.spare, None
            return value
        while True:
            u, v = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            square = u * u + v * v
            if 0 < square < 1:
                factor = math.sqrt(-2 * math.log(square) / square)
                self.spare = v * factor
                return u * factor


@pytest.mark.parametrize("seed", [0, 1, randoms.WEIGHT_SEED, randoms.MASK_SEED, (1 << 48) - 1])
def test_uniforms(seed):
    slow = Slow(seed)
    want = [slow.uniform() for _ in range(3000)]
    fast = Lcg48(seed)
    assert fast.uniforms(0, 3000).tolist() == want
    for first, count in ((0, 1), (1, 1), (7, 100), (2999, 1), (1500, 1000), (5, 0)):
        assert fast.uniforms(first, count).tolist() == want[first : first + count]


def test_far_ahead():
    """Places that no loop reaches: jumps add up."""
    fast = Lcg48(5)
    far = 10**15
    assert fast.uniforms(far, 10)[3:].tolist() == fast.uniforms(far + 3, 7).tolist()


@pytest.mark.parametrize("trials", [1, 7, 1 << 18])
def test_normals(monkeypatch, trials):
    monkeypatch.setattr(randoms, "TRIALS", trials)
    slow = Slow(42)
    want = [slow.normal() for _ in range(1001)]
    for count in (0, 1, 2, 1000, 1001):
        np.testing.assert_allclose(Lcg48(42).normals(count), want[:count], rtol=1e-14)
