"""Exact-match and F1 scores of predictions, thresholds, and training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_path


def scored(predictions: DataFrame, references: DataFrame, strict: bool = True) -> DataFrame:
    """Predictions with their references and what each scores when kept and when blanked.

    Adds ``em_kept``, ``f1_kept``, ``em_blank`` and ``f1_blank``. A missing score counts as minus infinity.
    A prediction without a reference is an error, or is left out unless ``strict``.
    """
    ref = references.select(F.col("id").alias("_id"), "is_impossible", F.col("answers.text").alias("golds"), *[c for c in ("kind",) if c in references.columns])
    joined = predictions.join(ref, predictions.id == F.col("_id"), "left" if strict else "inner")
    if strict:
        joined = joined.withColumn("is_impossible", F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("no reference for "), F.coalesce("id", F.lit("null")))).cast("boolean")).otherwise(F.col("is_impossible")))
    said = T.or_empty("prediction_text")
    words = F.col("_words")
    em = T.best_over(F.col("golds"), lambda g: T.exact_match(words, T.tokens(g))).cast("double")
    f1 = T.best_over(F.col("golds"), lambda g: T.token_f1(words, T.tokens(g))).cast("double")
    quiet, impossible = said == "", F.col("is_impossible")
    blank = F.when(impossible, 1.0).otherwise(0.0)
    return joined.withColumn("_words", T.tokens(said)).withColumns(
        {
            "no_answer_probability": F.coalesce("no_answer_probability", F.lit(float("-inf"))),
            "em_kept": F.when(quiet, blank).when(impossible, 0.0).otherwise(em),
            "f1_kept": F.when(quiet, blank).when(impossible, 0.0).otherwise(f1),
            "em_blank": blank,
            "f1_blank": blank,
        }
    ).drop("_id", "_words", "golds")


def at_threshold(rows: DataFrame, threshold: float | Column = 0.0) -> DataFrame:
    """Each row's ``em`` and ``f1``; a prediction whose score is above the threshold is blanked."""
    limit = F.lit(threshold) if isinstance(threshold, float | int) else threshold
    off = F.col("no_answer_probability") > limit
    return rows.withColumns({"em": F.when(off, F.col("em_blank")).otherwise(F.col("em_kept")), "f1": F.when(off, F.col("f1_blank")).otherwise(F.col("f1_kept"))})


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Means and totals: all, answerable and unanswerable; the mean of nothing is 0."""
    impossible = F.col("is_impossible")
    mean = lambda c, w=None: F.coalesce(F.avg(F.when(w, F.col(c)) if w is not None else F.col(c)), F.lit(0.0))
    return rows.groupBy(*by).agg(
        mean("em").alias("exact"), mean("f1").alias("f1"), F.count(F.lit(1)).alias("total"),
        mean("em", ~impossible).alias("has_ans_exact"), mean("f1", ~impossible).alias("has_ans_f1"), F.count_if(~impossible).alias("has_ans_total"),
        mean("em", impossible).alias("no_ans_exact"), mean("f1", impossible).alias("no_ans_f1"), F.count_if(impossible).alias("no_ans_total"),
    )


def squad_metrics(predictions: DataFrame, references: DataFrame, threshold: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    return summary(at_threshold(scored(predictions, references), threshold), *by)


def stretches(frame: DataFrame, column: str, parts: int = 256) -> DataFrame:
    """One row, ``_bounds``: values of a column that cut its rows into about equally many parts."""
    at = [k / parts for k in range(1, parts)]
    return frame.agg(F.array_distinct(F.coalesce(F.percentile_approx(column, at, 10_000), F.array().cast("array<double>"))).alias("_bounds"))


def sweep(rows: DataFrame) -> DataFrame:
    """The scores at every threshold: minus infinity, each different score, infinity.

    Rows are summed for each score first; a threshold keeps the scores up to it. Different scores
    can be as many as rows, so they are cut into stretches: sums run within a stretch, and over the
    stretches' totals. What is summed is kept in the shared folder, as it is read more than once.
    """
    names = ("n", "em_kept", "f1_kept", "em_blank", "f1_blank")
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "scores")
    sums = rows.groupBy(F.col("no_answer_probability").alias("threshold")).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in names[1:]])
    sums.write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    ends = spark.createDataFrame([(float("-inf"), *[0.0] * 5), (float("inf"), *[0.0] * 5)], sums.schema)
    every = sums.unionByName(ends).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in names])
    every = every.crossJoin(F.broadcast(stretches(sums, "threshold"))).withColumn("stretch", F.size(F.filter("_bounds", lambda b: b < F.col("threshold")))).drop("_bounds")  # one row of bounds
    before, all_ = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = every.groupBy(F.col("stretch").alias("_s")).agg(*[F.sum(c).alias(c) for c in names])
    so_far = totals.select("_s", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"before_{c}") for c in names], *[F.sum(c).over(all_).alias(f"all_{c}") for c in names])
    upto = Window.partitionBy("stretch").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    summed = every.withColumns({f"upto_{c}": F.sum(c).over(upto) for c in names}).join(F.broadcast(so_far), F.col("stretch") == F.col("_s"))  # at most 256 rows

    def mean(m: str) -> Column:
        kept = F.col(f"before_{m}_kept") + F.col(f"upto_{m}_kept")
        blank = F.col(f"all_{m}_blank") - F.col(f"before_{m}_blank") - F.col(f"upto_{m}_blank")
        return (kept + blank) / F.col("all_n")

    return summed.select("threshold", mean("em").alias("exact"), mean("f1").alias("f1"))


def best_thresholds(rows: DataFrame) -> DataFrame:
    """The best exact and F1 with the least threshold that gives each."""
    best = lambda m: F.max(F.struct(F.col(m).alias("value"), (-F.col("threshold")).alias("negative")))
    return sweep(rows).agg(best("exact").alias("e"), best("f1").alias("f")).select(
        F.col("e.value").alias("best_exact"), (-F.col("e.negative")).alias("best_exact_thresh"), F.col("f.value").alias("best_f1"), (-F.col("f.negative")).alias("best_f1_thresh")
    )


def tuned(dev_history: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Test scores plainly (threshold 0), at the development set's best threshold, and at the test set's own best.

    The development threshold is that of the epoch with the best F1, the first of equals.
    """
    best = dev_history.where("eval_f1 IS NOT NULL").agg(F.max_by("eval_best_f1_thresh", F.struct("eval_f1", -F.col("epoch"))).alias("t"))
    own = best_thresholds(test_rows).select(F.col("best_f1_thresh").alias("t"))
    zero = test_rows.sparkSession.createDataFrame([(0.0,)], "t double")
    named = zero.withColumn("mode", F.lit("plain")).unionByName(best.withColumn("mode", F.lit("headline"))).unionByName(own.withColumn("mode", F.lit("oracle")))
    return summary(at_threshold(test_rows.crossJoin(F.broadcast(named)), F.col("t")), "mode", "t")  # three rows


def plateau(history: DataFrame, tolerance: float = 0.1, least_epochs: float = 3) -> DataFrame:
    """Every epoch with its change, the best F1 from it on, and whether it is the plateau: the first, from
    ``least_epochs`` on, that later ones beat by less than ``tolerance`` (in the unit of the scores)."""
    line = Window.orderBy("epoch")
    rest = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marked = history.where("eval_f1 IS NOT NULL").select(
        "epoch", "eval_f1", (F.col("eval_f1") - F.lag("eval_f1").over(line)).alias("delta"), F.max("eval_f1").over(rest).alias("future_best")
    )
    flat = (F.col("epoch") >= least_epochs) & (F.col("future_best") - F.col("eval_f1") < tolerance)
    first = F.min(F.when(flat, F.col("epoch"))).over(Window.partitionBy())
    best = F.max_by("epoch", F.struct("eval_f1", -F.col("epoch"))).over(Window.partitionBy())
    return marked.withColumns({"is_plateau": F.coalesce(F.col("epoch") == first, F.lit(False)), "is_best": F.col("epoch") == best})


def epochs_of(log: DataFrame, values: list[str]) -> DataFrame:
    """One row for each epoch of a training log; of several values the last by ``seq`` that isn't null."""
    last = [F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col("seq"))).alias(v) for v in values]
    return log.where("epoch IS NOT NULL").groupBy("epoch").agg(*last)
