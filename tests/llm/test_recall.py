"""Recall of the bands, from the chances of drawing shingles, for sets of every size."""

from fractions import Fraction

import numpy as np

from zonecraft.llm import minhash, near_dedup


def test_minimum_and_maximum_agree_as_drawn_without_putting_back():
    """Sets of 5 and 4 shingles, 4 in common: both values of a permutation agree with 3/5, not 0.8 squared."""
    r = np.random.default_rng(3)
    n, perms = 4000, minhash.permutations(4)
    shingles = r.integers(0, 1 << 63, size=(n, 5), dtype=np.uint64)
    keys = [minhash.bands_of(shingles[:, :m].ravel(), np.repeat(np.arange(n), m), n, perms, 2, 4, both=True) for m in (5, 4)]
    assert abs((keys[0] == keys[1]).mean() - 0.6) < 0.015


def test_bands_of_near_duplicates_keep_the_recall_on_small_sets():
    rows, bands = minhash.choose_bands(0.8, near_dedup.VALUES, near_dedup.RECALL, both=True)
    assert rows % 2 == 0
    for union in range(2, 400):
        for common in range(-(-4 * union // 5), union):
            agree = Fraction(common * (common - 1), union * (union - 1)) ** (rows // 2)
            assert (1 - float(agree)) ** bands <= 1 - near_dedup.RECALL, (common, union)
