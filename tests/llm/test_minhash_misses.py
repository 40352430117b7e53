"""How often the bands miss pairs of small sets just above the threshold."""

from __future__ import annotations

import numpy as np
import pytest

from riskmon.llm import minhash


def misses(common: int, left: int, right: int, pairs: int) -> int:
    """Pairs of random sets, with so many shared and own shingles, that meet in no band."""
    rng = np.random.default_rng(common)
    out = 0
    for first in range(0, pairs, 2000):
        made = rng.integers(0, 2**64, (min(2000, pairs - first), common + left + right), dtype=np.uint64)
        a = minhash.band_hashes(minhash.signatures(list(made[:, : common + left])))
        b = minhash.band_hashes(minhash.signatures(list(made[:, np.r_[0:common, common + left : common + left + right]])))
        out += int((~(a == b).any(axis=1)).sum())
    return out


@pytest.mark.parametrize("common, left, right", [(6, 0, 1), (12, 1, 1)])
def test_small_sets_at_the_threshold_meet(common, left, right):
    # Independent coordinates miss less than one pair in a million.
    assert misses(common, left, right, 40_000) == 0
