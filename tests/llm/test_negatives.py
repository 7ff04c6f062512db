"""Hard negatives against brute force, and the intervals' promise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchup_graph.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    usable = [(i, [math.floor(256 * float(x)) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, va, la in usable:
        if a % 100:
            continue
        scored = sorted((-dot(va, v), i, l) for i, v, l in usable if i != a and len(v) == len(va))
        for p, pid, _ in [x for x in scored if x[2] == la][:5]:
            inside = [x for x in scored if x[2] != la and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(inside)]
    return sorted(out)


def vectors(n, width, seed, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    values = (centres[rng.integers(0, 4, n)] + rng.normal(size=(n, width))).astype(np.float32)
    if ties:  # a third of all rows are one vector, and components are coarse
        values = np.round(values)
        values[: n // 3] = values[0]
    return [(int(i), [float(x) for x in v], int(l)) for i, v, l in zip(rng.permutation(n), values, rng.integers(0, 10, n), strict=True)]


@pytest.mark.parametrize(("n", "width", "ties", "levels"), [(700, 16, False, 5), (700, 64, True, 2), (450, 70, False, 1), (350, 1, True, 5), (450, 130, False, 3)])
def test_matches_brute_force(spark, monkeypatch, n, width, ties, levels):
    monkeypatch.setattr(N, "LEVELS", levels)
    rows = vectors(n, width, n + width, ties)
    assert sorted(map(tuple, N.op13(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_blocks_of_anchors_give_the_same(spark):
    rows = vectors(600, 8, 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    label, anchor = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), F.col("vec_id") % 100 == 0
    assert sorted(map(tuple, N.hard_negatives(frame, label, anchor, block=4).collect())) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(320, 6, 4) + [(100, None, 1), (None, [1.0] * 6, 1), (1000, [1.0] * 6, None), (1100, [1.0, None] * 3, 2), (1200, [float("nan")] * 6, 2), (1300, [float("inf")] * 6, 2), (1400, [], 3), (1500, [0.5, -0.5], 3), (1501, [0.5, -0.4], 3), (1502, [0.3, -0.2], 5), (1600, [0.0] * 6, 3)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("vec", "anchor", "width", "nth", "place", "search")})
    assert sorted(map(tuple, N.op13(frame).collect())) == brute(rows)
    assert N.op13(frame.limit(0)).count() == 0 and N.op13(frame.where("vec_id % 100 <> 0")).count() == 0
    assert N.op13(frame.where("vec_id = 100 AND label IS NOT NULL")).count() == 0


def test_repeated_rows_stand_for_themselves(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    got = [tuple(r) for r in N.op13(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted([(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 2, 65536, 32768)] * 2)


def test_too_large_components_are_an_error(spark):
    rows = [(i, [1e15, 1.0], 1 + i % 2) for i in range(4)]
    with pytest.raises(Exception, match="too large"):
        N.op13(spark.createDataFrame(rows, SCHEMA)).collect()


@pytest.mark.parametrize("width", [1, 3, 64, 100])
def test_intervals_hold_the_true_value(width):
    rng = np.random.default_rng(width)
    a, b = rng.integers(-400, 400, (60, width)), rng.integers(-400, 400, (80, width))
    a[:5], b[:3], b[3:6] = 0, 0, a[10:13]
    turn, true = N.rotation(width), a @ b.T
    halves = []
    for levels in (1, 3, 5):
        low, high = N.intervals(N.Codes(a, turn, levels), N.Codes(b, turn, levels))
        assert (low <= true).all() and (true <= high).all()
        halves.append((high - low).mean())
    assert width == 1 or halves[0] > halves[1] > halves[2]
