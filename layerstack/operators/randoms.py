"""Seeded numbers: the linear congruential generator of the Java platform (published in
its class documentation), and a hash mask that does not depend on partitioning."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Seeds of the reference semantics.
WEIGHT_SEED = 45632988
MASK_SEED = 76835279

# Multiplier, increment and modulus of the 48-bit generator.
_LCG_MULTIPLIER = 0x5DEECE66D
_LCG_INCREMENT = 0xB
_LCG_MASK = (1 << 48) - 1


# Trials that are drawn at once.
TRIALS = 1 << 18


@lru_cache(maxsize=4)
def _jumps(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments that take the state on by 1 to `count` steps.

    Each doubling puts the steps known so far behind the last of them. Words wrap at 64 bits, a
    multiple of the 48 that count.
    """
    times, plus = np.array([_LCG_MULTIPLIER], "u8"), np.array([_LCG_INCREMENT], "u8")
    while len(times) < count:
        plus = np.concatenate([plus, times * plus[-1] + plus])
        times = np.concatenate([times, times * times[-1]])
    return times[:count], plus[:count]


class Lcg48:
    """48-bit linear congruential generator: uniform draws from any place of its sequence on."""

    def __init__(self, seed: int):
        self._start = (seed ^ _LCG_MULTIPLIER) & _LCG_MASK

    def _state(self, steps: int) -> int:
        """The state after so many steps, by repeated squaring."""
        state, times, plus = self._start, _LCG_MULTIPLIER, _LCG_INCREMENT
        while steps:
            if steps & 1:
                state = (state * times + plus) & _LCG_MASK
            plus = (times * plus + plus) & _LCG_MASK
            times = (times * times) & _LCG_MASK
            steps >>= 1
        return state

    def uniforms(self, first: int, count: int) -> np.ndarray:
        """Draws `first` to `first + count` - 1 of the sequence in [0, 1); each takes two steps."""
        times, plus = _jumps(2 * count)
        states = (np.uint64(self._state(2 * first)) * times + plus) & np.uint64(_LCG_MASK)
        high, low = states[0::2] >> np.uint64(22), states[1::2] >> np.uint64(21)
        return ((high << np.uint64(27)) + low).astype("f8") / float(1 << 53)

    def normals(self, count: int) -> np.ndarray:
        """The first normal draws, by the polar method: two from each pair of uniforms in the circle."""
        out, found, pair = np.empty(count + 1), 0, 0
        while found < count:
            trials = min(TRIALS, 16 + (count - found) * 3 // 4)
            u, v = (2 * self.uniforms(2 * pair, 2 * trials) - 1).reshape(-1, 2).T
            pair += trials
            square = u * u + v * v
            inside = (square > 0) & (square < 1)
            u, v, square = u[inside], v[inside], square[inside]
            factor = np.sqrt(-2 * np.log(square) / square)
            both = np.stack([u * factor, v * factor], axis=1).ravel()[: len(out) - found]
            out[found : found + len(both)] = both
            found += len(both)
        return out[:count]


@lru_cache(maxsize=16)
def fixed_mask(width: int) -> np.ndarray:
    """The 0/1 mask of the reference semantics: a prefix of one fixed sequence."""
    return (Lcg48(MASK_SEED).uniforms(0, width) >= 0.5).astype("f8")


# The five primes of the public 64-bit xxHash.
_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)
_P4 = np.uint64(0x85EBCA77C2B2AE63)
_P5 = np.uint64(0x27D4EB2F165667C5)
_SPARK_SEED = np.uint64(42)


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxHash of one 64-bit integer, as `xxhash64` in Spark SQL chains it."""
    h = (seed + _P5 + np.uint64(8)) ^ (_rotate(value * _P2, 31) * _P1)
    h = _rotate(h, 27)
    h *= _P1
    h += _P4
    for shift, factor in ((33, _P2), (29, _P3), (32, None)):
        h ^= h >> np.uint64(shift)
        if factor is not None:
            h *= factor
    return h


def keep_threshold(drop: float) -> int:
    """Smallest signed hash that keeps a feature when a share `drop` is masked."""
    if not 0 <= drop < 1:
        raise ValueError(f"corruption must be in [0, 1), not {drop}")
    return -(1 << 63) + int(drop * (1 << 64))


def hash_mask(
    keys: np.ndarray, width: int, drop: float, layer: int, epoch: int, seed: int
) -> np.ndarray:
    """Which features to keep (rows x width): a function of row key, feature, layer, epoch and
    seed.

    Equals `xxhash64(key, layer, epoch, seed, feature) >= threshold` in Spark SQL, all as
    bigint.
    """
    rows = mask_rows(keys, layer, epoch, seed)
    return mask_at(rows[:, None], np.arange(width)[None, :], drop)


def mask_rows(keys: np.ndarray, layer: int, epoch: int, seed: int) -> np.ndarray:
    """The part of the mask's hash that depends on the row."""
    with np.errstate(over="ignore"):
        h = _hash_long(keys.astype("u8"), np.full(len(keys), _SPARK_SEED))
        for part in (layer, epoch, seed):
            h = _hash_long(np.array(part, dtype="i8").astype("u8"), h)
    return h


def mask_at(rows: np.ndarray, features: np.ndarray, drop: float) -> np.ndarray:
    """Which of some features to keep, from the hashes of their rows."""
    with np.errstate(over="ignore"):
        h = _hash_long(features.astype("u8"), rows)
    return h.view("i8") >= keep_threshold(drop)
