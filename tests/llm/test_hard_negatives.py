"""Hard negatives against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanqc.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, negatives=5, window=(80, 100)):
    usable = {(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        own = sorted((-score(v, w), j) for j, other, w in usable if other == label and j != i)[:positives]
        for s, j in own:
            found = sorted((-score(v, w), k) for k, other, w in usable if other != label and window[0] * -s <= 100 * score(v, w) <= window[1] * -s)[:negatives]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(found, 1)]
    return sorted(out)


def sample(seed, n, dims, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 2) for i in range(60)]  # one vector very often
    rows += [(500_000, None, 1), (500_002, [1.0, None], 1), (500_004, [float("nan")] * dims, 2), (500_006, [float("inf")] + [0.0] * (dims - 1), 2), (None, [1.0] * dims, 1), (500_008, [1.0] * dims, None), (500_010, [], 1), (500_012, [0.5], 2)]
    return rows + rows[:5]


@pytest.mark.parametrize(("dims", "spread", "pivots", "block", "chunk"), [(3, 0.3, 2, 3, 200), (8, 1.0, 5, 512, 1 << 20), (2, 0.05, 40, 2, 100)])
def test_by_brute_force(spark, monkeypatch, dims, spread, pivots, block, chunk):
    for name, value in {"FEWEST": pivots, "BLOCK": block, "CHUNK_BYTES": chunk, "AT_ONCE": 64}.items():
        monkeypatch.setattr(H, name, value)
    rows = sample(dims, 300, dims, spread)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "key", "cell", "vec", "square", "anchor_id", "rank")})
    got = sorted(tuple(r) for r in H.hard_negatives(frame, anchors=F.col("id") % 10 == 0).collect())
    assert got == brute(rows, 10)


def test_other_numbers_and_windows(spark):
    rows = sample(9, 150, 4, 0.5)
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 7 == 0, positives=2, negatives=3, window=(50, 90)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 7, 2, 3, (50, 90))


def test_few_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)], [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]):
        got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 100 == 0).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 100)


def test_candidates_that_serve_no_anchor_stay_behind(spark, monkeypatch):
    """Where vectors lie in clumps, bounds keep a cell's chunks from most of the other cells."""
    monkeypatch.setattr(H, "FEWEST", 30)
    counts, within = [], H.within_reach

    def counted(rows, space, cells, home):
        met = within(rows, space, cells, home)
        counts.append((home, len(cells), met.select(F.sum(F.size("ids"))).head()[0]))
        return met

    monkeypatch.setattr(H, "within_reach", counted)
    rng = random.Random(3)
    rows = [(i, [10.0 * (k == i % 6) + rng.gauss(0, 0.05) for k in range(6)], i // 6 % 3) for i in range(900)]
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5)
    assert any(n < cells * len(rows) / 2 for home, cells, n in counts if not home)


def test_large_components(spark):
    rows = [(0, [2e5, 6e5], 1), (1, [4e5, 5e5], 1), (2, [4e5, 4.6e5], 2)]
    assert sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") == 0).collect()) == [r for r in brute(rows, 1) if r[0] == 0]
    for component, bits in ((1e9, 31), (4e6, 56)):
        with pytest.raises(Exception, match=f"beyond {bits} bits"):
            H.hard_negatives(spark.createDataFrame([(0, [component], 1)], SCHEMA), F.col("id") == 0)
