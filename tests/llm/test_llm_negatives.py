"""Hard negatives against a comparison of every anchor with every row."""

import math

import numpy as np
import pytest

from tableworks.llm.hard_negatives import _routes, hard_negatives, quantised, shifted_labels
from tableworks.llm.multi_index import Index, fit_codes

DDL = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], None if l is None else (l + 1) % 10 if i is not None and i % 7 == 0 else l)
            for i, v, l in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = set()
    for a, vector, label in kept:
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(vector, v)), i, l) for i, v, l in kept]
        near = sorted((s for s in scored if s[2] == label and s[1] != a), key=place)[:positives]
        for score, positive, _ in near:
            fine = sorted((s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score), key=place)
            out |= {(a, positive, n + 1, i, score, s) for n, (s, i, _) in enumerate(fine[:negatives])}
    return out


def clustered(rng, n, width, spread):
    centres = rng.normal(0, 1, (6, width))
    return [(i, [float(x) for x in centres[i % 6] + rng.normal(0, spread, width)], int(rng.integers(0, 10))) for i in range(n)]


def answers(spark, rows, **options):
    df = spark.createDataFrame(rows, DDL).repartition(3)
    found = hard_negatives(shifted_labels(quantised(df)), **options).collect()
    assert len({tuple(r) for r in found}) == len(found)
    return {tuple(r) for r in found}


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "batch": 3, "codes": 5, "sample": 100}])
def test_against_all_pairs(spark, options):
    rows = clustered(np.random.default_rng(1), 400, 8, 0.3)
    assert answers(spark, rows, **options) == brute(rows)


def test_cases(spark):
    """Common vectors, ties, missing values, vectors of several lengths, zeros, rows without identifiers."""
    rng = np.random.default_rng(2)
    rows = clustered(rng, 150, 6, 0.5)
    rows += [(200 + i, [0.5, 0.25, -0.5, 0.0, 0.125, 1.0], i % 3) for i in range(120)]
    rows += [(400, None, 1), (450, [1.0, None, 2.0], 1), (500, [float("nan")] * 6, 1), (550, [float("inf")] * 6, 2), (600, [0.5] * 6, None)]
    rows += [(650, [], 3), (700, [0.0] * 6, 3), (750, [0.5, 0.5], 3), (None, [0.5, 0.5], 4), (None, [0.4] * 6, 3), (800, [-0.5] * 6, 3)]
    want = brute(rows)
    assert answers(spark, rows, block_rows=32, codes=3) == want == answers(spark, rows)
    assert answers(spark, rows[:0]) == set() and answers(spark, rows[1:40]) == set()
    assert answers(spark, [(0, [1.0], 1)]) == set()


def test_large_components(spark):
    """Sums beyond 2^53 are made of integers."""
    rng = np.random.default_rng(3)
    rows = [(10 * i, [float(x) for x in rng.integers(1, 2 ** 17, 8)], i % 3) for i in range(60)]
    assert answers(spark, rows) == brute(rows)


def test_bounds_hold_and_fall():
    rng = np.random.default_rng(4)
    rows = np.array([v for _, v, _ in clustered(rng, 600, 10, 0.2)])
    index = Index(fit_codes(rows[:, :5], 6), fit_codes(rows[:, 5:], 6))
    cell, a, b = index.assign(rows)
    sizes = [(int(c), int((cell == c).sum()), a[cell == c].max(), b[cell == c].max()) for c in np.unique(cell)]
    blocks = index.fill(sizes, 50)
    held = {}
    for c in np.unique(cell):
        for k in range(index.block[c], index.block[c] + index.parts[c]):
            held[k] = held.get(k, 0) + index.count[c] / index.parts[c]
    assert set(held) == set(range(blocks)) and max(held.values()) <= 50
    for query in rows[:20]:
        seen = list(index.cells(query))
        assert sorted(c for c, _, _ in seen) == sorted(np.unique(cell)) and [x for _, x, _ in seen] == sorted((x for _, x, _ in seen), reverse=True)
        for c, upper, lower in seen:
            scores = rows[cell == c] @ query
            assert lower <= scores.min() and scores.max() <= upper


def test_certified_stop():
    """On clustered rows a query that knows a good score leaves most cells out."""
    rng = np.random.default_rng(5)
    rows = np.array([v for _, v, _ in clustered(rng, 2000, 16, 0.02)]) * 256
    index = Index(fit_codes(rows[:, :8], 8), fit_codes(rows[:, 8:], 8))
    cell, a, b = index.assign(rows)
    index.fill([(int(c), int((cell == c).sum()), a[cell == c].max(), b[cell == c].max()) for c in np.unique(cell)], 100)
    query = rows[0]
    best = int(np.sort(rows @ query)[-5])
    every = _routes(index, query, [(-np.inf, np.inf)], [None], 10, again=True)
    some = _routes(index, query, [(-np.inf, np.inf)], [best], 10, again=True)
    assert 0 < sum(map(len, some.values())) < 0.5 * sum(map(len, every.values()))
