"""What the fingerprint filters lose of pairs that whole sets would keep: measured, and printed with -s."""

import numpy as np
import pytest

from tracewright.llm import decontaminate as D
from tracewright.llm import simhash_similar as S
from tracewright.llm._common import mix


def prints_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of hashes."""
    ones = np.zeros((len(shingles), 64), np.int64)
    for column in shingles.T:
        ones += np.unpackbits(np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(ones * 2 > shingles.shape[1], axis=1, bitorder="little").view(np.uint64).ravel()


def pairs(rng, n: int, size: int, low: float, high: float):
    """n pairs of random sets of `size` hashes each, of a similarity from low up to high."""
    shared = np.ceil(2 * size * low / (1 + low) - 1e-9).astype(int)
    most = max(shared, int(np.floor(2 * size * high / (1 + high))))
    shared = int(rng.integers(shared, most + 1)) if most > shared else int(shared)
    one = rng.integers(0, 1 << 64, (n, size), np.uint64)
    two = np.concatenate((one[:, :shared], rng.integers(0, 1 << 64, (n, size - shared), np.uint64)), axis=1)
    return one, two, shared / (2 * size - shared)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints_of(a) ^ prints_of(b)).astype(int)


@pytest.mark.parametrize(("low", "high", "most"), [(0.8, 0.81, 0.002), (0.81, 0.85, 0.001), (0.85, 0.95, 0.0002)])
def test_radius_of_decontamination(low, high, most):
    rng = np.random.default_rng(19)
    lost = total = 0
    for size in (20, 46, 96):
        for _ in range(4):
            one, two, sim = pairs(rng, 5000, size, low, high)
            assert sim >= 0.8
            lost += int((distance(one, two) > D.RADIUS).sum())
            total += len(one)
    print(f"op2: {lost} of {total} windows of similarity {low} to {high} beyond {D.RADIUS} bits")
    assert lost <= most * total


@pytest.mark.parametrize(("low", "high"), [(0.8, 0.81), (0.81, 0.85), (0.85, 0.95)])
def test_radius_of_near_duplicates(low, high):
    rng = np.random.default_rng(22)
    lost = total = 0
    for size in (9, 10, 20, 50, 200):
        for _ in range(3):
            one, two, sim = pairs(rng, 4000, size, low, high)
            first = distance(one, two)
            both = first + distance(mix(one), mix(two))
            lost += int(((first > S.RADIUS) | (both > S.RADIUS_BOTH)).sum())
            total += len(one)
            assert sim >= 0.8
    print(f"near_dedup: {lost} of {total} pairs of similarity {low} to {high} beyond {S.RADIUS} and {S.RADIUS_BOTH} bits")
    assert lost <= 0.0002 * total


def test_prints_are_the_operators_own():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << 64, (5, 31), np.uint64)
    assert prints_of(rows).view(np.int64).tolist() == [S.simhash(np.sort(r)) for r in rows]
    assert prints_of(rows).tolist() == [int(D.pack(D.signs(r).sum(axis=0, keepdims=True))[0]) for r in rows]
