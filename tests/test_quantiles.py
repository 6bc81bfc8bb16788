"""Quantiles of columns with many different values."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanqc.operators import reports


def test_quantiles_are_those_of_percentile(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), float(rng.randint(0, 3)), None])) for _ in range(3000)] + [("c", None), ("d", 7.0), ("e", 1.0), ("e", 2.0)] + [("a", 1.0)] * 2000
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    for by in ((), ("g",)):
        want = frame.where("x IS NOT NULL").groupBy(*by).agg(*[F.percentile("x", F.lit(p)).alias(f"p{round(p * 100)}") for p in ps])
        key = lambda r: str(r[0])
        got, expected = (sorted(f.select(*by, *[f"p{round(p * 100)}" for p in ps]).collect(), key=key) for f in (reports.quantiles(frame, "x", ps, *by), want))
        assert len(got) == len(expected)
        for a, b in zip(got, expected, strict=True):
            assert all(x == y or abs(x - y) <= 1e-9 * abs(y) for x, y in zip(a, b, strict=True)), (a, b)
    assert reports.quantiles(frame.where("false"), "x", ps, "g").count() == 0


def test_box_plots(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), rng.gauss(0, 9), None])) for _ in range(400)] + [("one", 2.0), ("none", None)] + [("flat", 1.0)] * 9 + [("flat", 5.0)] + [("far", x) for x in (0.0, 9.0, 10.0, 11.0, 30.0, 40.0)]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "g string, x double, q1 double").drop("q1").repartition(3)

    def box(values):
        xs = sorted(values)
        at = lambda p: (lambda k: xs[int(k)] + (k - int(k)) * (xs[min(int(k) + 1, len(xs) - 1)] - xs[int(k)]))(p * (len(xs) - 1))
        q1, middle, q3 = at(0.25), at(0.5), at(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = [x for x in xs if low <= x <= high]
        return len(xs), min([q1, *inside]), q1, middle, q3, max([q3, *inside]), sum(x < low for x in xs), sum(x > high for x in xs)

    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    got = {r[0]: tuple(r)[1:] for r in reports.box_plot(frame, "x", "g").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[g], box(values), strict=True)), (g, got[g], box(values))
    whole = reports.box_plot(frame, "x").head()
    assert all(abs(x - y) < 1e-9 for x, y in zip(whole, box([x for v in groups.values() for x in v]), strict=True))
    assert reports.box_plot(frame.where("false"), "x", "g").count() == 0
