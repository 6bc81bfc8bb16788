"""Intervals, tests and confusion measures."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z = 1.96


def wilson_parts(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    p = F.try_divide(k.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    margin = z * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z * z), 4 * n), n)) / scale
    return centre, margin


def wilson_low(k: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the Wilson interval of k in n; null for n = 0."""
    centre, margin = wilson_parts(k, n, z)
    return centre - margin


def wilson_high(k: Column, n: Column, z: float = Z) -> Column:
    centre, margin = wilson_parts(k, n, z)
    return centre + margin


def accuracy_intervals(frame: DataFrame, by: str | list[str], correct: str) -> DataFrame:
    """Rows, right ones, accuracy and Wilson interval for each group."""
    k, n = F.sum(F.col(correct).cast("long")), F.count(F.lit(1))
    keys = [by] if isinstance(by, str) else by
    out = frame.groupBy(*keys).agg(n.alias("n"), k.alias("correct"), F.try_divide(k.cast("double"), n).alias("accuracy"), wilson_low(k, n).alias("ci_lower"), wilson_high(k, n).alias("ci_upper"))
    return out.withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))


def confusion(frame: DataFrame, by: list[str], flag: str, correct: str) -> DataFrame:
    """The flag as a test for wrong rows: the four counts, precision, recall and F1; null where undefined."""
    f, c = F.coalesce(F.col(flag), F.lit(False)), F.col(correct)
    counted = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f & (c == 0)).alias("tp"), F.count_if(f & (c == 1)).alias("fp"),
        F.count_if(~f & (c == 0)).alias("fn"), F.count_if(~f & (c == 1)).alias("tn"),
    )
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return counted.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def with_p(tested: DataFrame, chance: Callable[[pd.Series], float]) -> DataFrame:
    """Adds ``p``, the chance of a statistic as great; null where that is null. A row for each test, so Python is not in the way of much."""
    names = [c for c in ("z", "chi2", "dof") if c in tested.columns]

    @F.pandas_udf(DoubleType())
    def p(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([chance(r) if r.notna().all() else None for _, r in rows.iterrows()], dtype="float64")

    return tested.withColumn("p", p(F.struct(*names)))


def two_proportion_z(frame: DataFrame, by: str, correct: str, first: str, second: str) -> DataFrame:
    """The pooled z of two groups' accuracies and its two-sided p; null where they are undefined."""
    n = lambda g: F.count_if(F.col(by) == g).cast("double")
    k = lambda g: F.count_if((F.col(by) == g) & (F.col(correct) == 1)).cast("double")
    sums = frame.agg(n(first).alias("n1"), n(second).alias("n2"), k(first).alias("k1"), k(second).alias("k2"))
    pool = F.try_divide(F.col("k1") + F.col("k2"), F.col("n1") + F.col("n2"))
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    return with_p(sums.withColumn("z", F.try_divide(F.try_divide(F.col("k1"), F.col("n1")) - F.try_divide(F.col("k2"), F.col("n2")), error)), lambda r: normal_two_sided(r["z"]))


def chi_square(frame: DataFrame, a: str, b: str) -> DataFrame:
    """The statistic of independence, its degrees of freedom and p; with one degree, corrected for continuity as Yates did.

    Cells are counted first, and totals come from the cells. Cells without rows aren't made: one adds what is expected of it, so a
    row of the table adds its total's share of the columns that it doesn't meet. Null is a value like any other; an empty table gives no row.
    """
    cells = frame.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("seen"))
    rows = cells.groupBy(F.col(a).alias("_r")).agg(F.sum("seen").alias("row_total"))
    columns = cells.groupBy(F.col(b).alias("_c")).agg(F.sum("seen").alias("column_total"))
    of = lambda totals, n: totals.agg(F.count(F.lit(1)).alias(f"n_{n}"), F.sum(1 / F.col(totals.columns[1])).alias(f"inverse_{n}"), F.sum(totals.columns[1]).alias(f"total_{n}"))
    sizes = of(rows, "rows").crossJoin(of(columns, "columns"))  # one row each
    known = cells.join(rows, F.col(a).eqNullSafe(F.col("_r"))).join(columns, F.col(b).eqNullSafe(F.col("_c"))).crossJoin(F.broadcast(sizes))  # one row
    total = F.col("total_rows")
    wanted = F.col("row_total") * F.col("column_total") / total
    apart = F.abs(F.col("seen") - wanted)
    freedom = ((F.col("n_rows") - 1) * (F.col("n_columns") - 1)).alias("dof")
    line = known.groupBy(freedom, "_r", "row_total", "total_rows", "inverse_rows", "inverse_columns").agg(F.sum(apart * apart / wanted).alias("met"), F.sum("column_total").alias("columns"), F.max(apart).alias("apart"))
    plain = F.sum(F.col("met") + F.col("row_total") * (total - F.col("columns")) / total)
    # With one degree all four cells are equally far from what is expected.
    less = F.max("apart") - F.least(F.lit(0.5), F.max("apart"))
    corrected = less * less * F.max(total * F.col("inverse_rows") * F.col("inverse_columns"))
    chi = F.when(F.col("dof") == 1, corrected).otherwise(plain)
    return with_p(line.groupBy("dof").agg(chi.alias("chi2")), lambda r: chi_square_p(r["chi2"], r["dof"]))


def normal_two_sided(z: float) -> float:
    """The chance of a normal value as far from zero."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_p(statistic: float, dof: int) -> float:
    """The chance of a greater statistic, by the series and the fraction of the incomplete gamma function."""
    if statistic <= 0:
        return 1.0
    a, x = dof / 2, statistic / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def sample_size(margin: float, z: float = Z, p: float = 0.5) -> int:
    """Rows for a margin of a proportion."""
    return math.ceil(z * z * p * (1 - p) / (margin * margin))


def worst_margin(n: int, z: float = Z) -> float:
    return z * math.sqrt(0.25 / n)
