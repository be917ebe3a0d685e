"""Hard negatives against brute force."""

import numpy as np
import pytest

from shelfmark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, no int, score long, block int"
EXTRA = ("x", 1, 2, 3)


def brute(rows, positives=5, negatives=3):
    kept = [
        (i, [int(np.floor(256 * x)) for x in v], label)
        for i, v, label in (r[:3] for r in rows)
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) and np.isfinite(256 * x) for x in v)
    ]
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for a, (anchor, q, label) in enumerate(kept):
        if anchor % 50:
            continue
        others = sorted((-score(q, v), i, own) for k, (i, v, own) in enumerate(kept) if k != a and len(v) == len(q))
        for s, i, _ in [o for o in others if o[2] == label][:positives]:
            near = [o for o in others if o[2] != label and -50 * s <= -100 * o[0] <= -95 * s][:negatives]
            out += [(anchor, i, k, o[1], -s, -o[0]) for k, o in enumerate(near, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 24))
    out = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(24) * 0.7], int(i % 4)) for i in range(600)]
    same = [0.25] * 24
    out += [(600 + i, same, i % 2) for i in range(40)]  # ties
    out += [(50, same, 1), (50, same, 1), (50, [-0.5] * 24, 0), (651, same, 1)]  # rows that share an id, equal ones too
    out += [(700, None, 1), (701, [], 1), (702, [0.0] * 24, 1), (703, [None] + [0.5] * 23, 1), (704, [float("nan")] + [0.5] * 23, 1)]
    out += [(705, [float("inf")] + [0.5] * 23, 1), (706, same, None), (None, same, 1), (750, [1.0, 2.0], 1), (751, [1.5, 2.0], 1), (752, [1.0, 1.2], 2), (800, [1.0], 7)]
    out += [(850, [1e17] * 3, 1), (851, [2e17, 1e16, -1e17], 1), (852, [1e17, 1e15, 0.5], 2), (853, [3e6, 3e6, 1.0], 2), (854, [-3e6, 3e16, 1.0], 1)]
    return [(*r, *EXTRA) for r in out]


@pytest.mark.parametrize("block", [64, 8192])
def test_as_brute_force(spark, rows, block):
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), "id % 50 = 0", block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), "id % 50 = 0").count() == 0


def test_bounds_hold_and_close():
    rng = np.random.default_rng(4)
    a, b = np.floor(256 * rng.standard_normal((40, 64))), np.floor(256 * rng.standard_normal((50, 64)))
    width = np.inf
    for n in hard_negatives.LEVELS:
        low, high = hard_negatives.bounds(hard_negatives.summaries(a, n), hard_negatives.summaries(b, n))
        assert (low <= a @ b.T).all() and (a @ b.T <= high).all()
        assert (high - low).mean() < width
        width = (high - low).mean()


def test_levels_leave_out_most_rows_of_smooth_vectors():
    """Vectors whose components differ little within a segment are decided by the coarse levels."""
    rng = np.random.default_rng(6)
    vecs = np.repeat(rng.standard_normal((4000, 8)) * 300, 8, axis=1).round() + rng.integers(-3, 4, (4000, 64))
    seen = []

    def keep(low, high, possible):
        seen.append(possible.shape[1])
        return possible & (high >= hard_negatives._kth(low, possible, 5)[:, None])

    at, possible = hard_negatives.narrowed(vecs[:1], vecs, np.ones((1, len(vecs)), bool), hard_negatives._levels(vecs), keep)
    assert set(np.argsort(-(vecs @ vecs[0]))[:5]) <= set(at) and len(at) < 100
