"""The named methods take part, on all of what they are to see."""

import numpy as np

from quillon.llm import lm
from quillon.llm import simhash as S


def test_blocks_are_searched_by_a_tree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (5, S.WIDE_BITS // 64), dtype=np.uint64)
    rows = [base[i % 5] ^ np.where(rng.random(S.WIDE_BITS // 64) < 0.4, np.uint64(1) << rng.integers(0, 63, S.WIDE_BITS // 64, dtype=np.uint64), np.uint64(0)) for i in range(60)]
    fps, n = [r.tobytes() for r in rows], len(rows)
    block = S._Block(fps, [100] * n, [[0] * (S.MINIMA + S.MORE)] * n, list(range(n)), [0] * n)
    radius = max(S.radius_of(0.8, 1), S.radius_of(0.8, 64))
    apart = lambda i, j: int(np.bitwise_count(rows[i] ^ rows[j]).sum())
    assert {i: at.tolist() for i, at in block.found(True, 0, 0.8)} == {i: [j for j in range(i) if apart(i, j) <= radius] for i in range(1, n)}
    assert {i: at.tolist() for i, at in block.found(False, 25, 0.8)} == {i: [j for j in range(25) if apart(i, j) <= radius] for i in range(25, n)}


def test_steps_are_taken_on_every_training_document():
    for ids in (0, lm.ROUND_IDS - 1, 3 * lm.ROUND_IDS, 100 * lm.ROUND_IDS, 10**12):
        cut = lm.shares_of(ids, lm.ROUNDS)
        assert {r % cut for r in range(lm.ROUNDS)} == set(range(cut))
