"""Report tables: rates, distributions, pivots, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ANSWERED, IMPOSSIBLE, QUESTIONS_PER_CONTEXT, SENTINEL
from ..sources.shared import shared_path
from .datasets import expanded, strict, uncertain
from .validation import count_if, percent


def value_counts(frame: DataFrame, *by: str, nulls: bool = True) -> DataFrame:
    """Rows of each value; null is a value unless left out."""
    rows = frame if nulls else frame.dropna(subset=list(by))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def counts_of_counts(frame: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key")).groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("n_keys"))


def grouped(frame: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, sum, mean and share of a 0/1 or numeric column for each group."""
    return frame.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def abstention(frame: DataFrame, *by: str) -> DataFrame:
    """Answered and impossible rows, their rates, and how impossible ones are worded."""
    yes, no, n = F.col("is_impossible") == ANSWERED, F.col("is_impossible") == IMPOSSIBLE, F.count(F.lit(1))
    sentinel = F.col("answer_text") == SENTINEL
    return frame.groupBy(*by).agg(
        count_if(yes).alias("answered"), count_if(no).alias("impossible"),
        percent(count_if(yes), n, None).alias("answer_rate"), percent(count_if(no), n, None).alias("abstention_rate"),
        count_if(no & sentinel).alias("consistent_sentinel"), count_if(no & ~sentinel & (F.col("qc_status") == "no_answer_free_text")).alias("free_text_no_answer"),
        count_if(F.col("qc_status") == "imposible_but_span_present").alias("impossible_but_span_present"),
    )


def crosstab_percent(frame: DataFrame, rows: str, columns: str, values: Sequence[str], places: int = 1) -> DataFrame:
    """Shares of the column's values within each row, in percent."""
    wide = frame.groupBy(rows).pivot(columns, list(values)).count().na.fill(0)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(rows, *[T.half_even(F.try_divide(F.col(v) * F.lit(100.0), total), places).alias(v) for v in values])


def quantiles(frame: DataFrame, value: str, probabilities: Sequence[float], *by: str) -> DataFrame:
    """Exact quantiles of a column with any number of different values: ``by`` and ``p25``, ``p50``, ... as ``percentile`` has them.

    ``percentile`` keeps all different values of a group in one task. Here equal values are counted first, ranges
    of group and value are sorted in many tasks and held in the shared folder, and a value's rank is that in its range and the sizes
    of its group's ranges before; then only the two values next to each quantile are kept. Nulls don't count;
    a group of nulls alone has no row. NaN is above all numbers.
    """
    path = shared_path(frame.sparkSession, "ranges")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    counted = frame.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counted.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    held = frame.sparkSession.read.parquet(path)
    line = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    parts = held.groupBy("_g", "_part").agg(F.sum("_n").alias("_size"))  # a row for each group of each range
    before = parts.select("_g", "_part", F.coalesce(F.sum("_size").over(line), F.lit(0)).alias("_before"), F.sum("_size").over(whole).alias("_all"))
    within = Window.partitionBy("_g", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(before, ["_g", "_part"]).withColumn("_from", F.col("_before") + F.col("_in"))

    def found(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("_all") - 1)
        at = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_from") + F.col("_n")), F.col("_v")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(f"p{round(p * 100)}")

    named = [F.col(f"_g.{c}").alias(c) for c in by]
    picked = ranked.groupBy("_g").agg(*[found(p) for p in probabilities])
    return picked.select(*named, *[f"p{round(p * 100)}" for p in probabilities])


def describe(frame: DataFrame, value: str, *by: str, percentiles: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Count, mean, sample deviation, least, exact percentiles and greatest."""
    at = [F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in percentiles]
    return frame.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), *at, F.max(value).alias("max"))


def population(frame: DataFrame, value: str, *by: str, places: int = 2) -> DataFrame:
    """Mean, population deviation, least, quartiles and greatest, rounded."""
    r = lambda c, name: T.half_even(c, places).alias(name)
    return frame.groupBy(*by).agg(
        r(F.avg(value), "mean"), r(F.stddev_pop(value), "std"), F.min(value).alias("min"), r(F.percentile(value, F.lit(0.25)), "q1"),
        r(F.percentile(value, F.lit(0.5)), "median"), r(F.percentile(value, F.lit(0.75)), "q3"), F.max(value).alias("max"),
    )


def iqr_bounds(frame: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """The quartiles and the bounds ``factor`` times their distance beyond them."""
    q = frame.agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    spread = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", (F.col("q1") - factor * spread).alias("lower"), (F.col("q3") + factor * spread).alias("upper"))


def within_iqr(frame: DataFrame, value: str, most: float | None = 100) -> DataFrame:
    """Rows from the lower bound to ``most``, or to the upper bound if that is None."""
    bounds = iqr_bounds(frame, value)
    upper = F.col("upper") if most is None else F.lit(most)
    return frame.crossJoin(F.broadcast(bounds)).where((F.col(value) >= F.col("lower")) & (F.col(value) <= upper)).select(frame.columns)  # one row


def histogram(frame: DataFrame, value: str, bins: int) -> DataFrame:
    """Rows of each bin of equal width from the least value to the highest, which belongs to the last bin; values that are all equal lie in the middle of a width of 1. Nulls aren't counted."""
    v = F.col(value).cast("double")
    low, high = F.col("_low"), F.col("_high")
    middle = F.when(low == high, 0.5).otherwise(0.0)
    bounds = frame.agg(F.min(v).alias("_low"), F.max(v).alias("_high")).select((low - middle).alias("_low"), (high + middle).alias("_high"))
    bucket = F.least(F.width_bucket(v, low, high, F.lit(bins)), F.lit(bins))
    return frame.where(v.isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row of bounds


def box_plot(frame: DataFrame, value: str, *by: str, reach: float = 1.5) -> DataFrame:
    """What a box plot shows of each group: ``n``, ``q1``, ``median``, ``q3``, the whiskers ``low`` and ``high``, and how many values lie beyond them.

    A whisker ends at the last value within ``reach`` times the box's height of it, and at the box if none lies outside the box. Quartiles are
    exact, of any number of different values. Nulls don't count, a null group is one; a group of nulls alone has no box.
    """
    v = F.col(value).cast("double")
    boxes = quantiles(frame, value, (0.25, 0.5, 0.75), *by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("p25").alias("q1"), F.col("p50").alias("median"), F.col("p75").alias("q3"))
    spread = reach * (F.col("q3") - F.col("q1"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = frame.select(*by, v.alias("_v")).where(v.isNotNull())
    rows = own.join(boxes, same) if by else own.crossJoin(F.broadcast(boxes))  # one row of quartiles
    near = rows.withColumns({"_low": F.col("q1") - spread, "_high": F.col("q3") + spread})
    below, above = F.col("_v") < F.col("_low"), F.col("_v") > F.col("_high")
    whiskers = near.groupBy(*by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(~below, F.col("_v"))).alias("_least"), F.max(F.when(~above, F.col("_v"))).alias("_most"), count_if(below).alias("below"), count_if(above).alias("above"),
    )
    return whiskers.select(*by, "n", F.least("q1", "_least").alias("low"), "q1", "median", "q3", F.greatest("q3", "_most").alias("high"), "below", "above")


def length_counts(frame: DataFrame, value: str, *by: str) -> DataFrame:
    c = F.col(value)
    return frame.groupBy(*by).agg(count_if(c < 17).alias("under_17"), count_if(c < 100).alias("under_100"), count_if(c > 30).alias("over_30"), count_if(c > 100).alias("over_100"))


def duplicates_beyond_first(frame: DataFrame, value: str, *by: str) -> DataFrame:
    """Rows that repeat a value; null is a value too."""
    return frame.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def overlong(frame: DataFrame, *by: str, share: float = 0.8, quantile: float = 0.99) -> DataFrame:
    """For each question, answers longer than its quantile, than a share of the context, and than both."""
    keys = [*by, "question"]
    rows = frame.where("literal_match").select(*keys, "answer_words", T.word_count("context").alias("context_words"))
    limits = rows.groupBy(*keys).agg(F.percentile("answer_words", F.lit(quantile)).alias("p99"))
    long, wide = F.col("answer_words") > F.col("p99"), F.col("answer_words") > share * F.col("context_words")
    return rows.join(limits, keys).groupBy(*keys, "p99").agg(
        F.count(F.lit(1)).alias("positive_n"), count_if(long).alias("flagged_p99"), count_if(wide).alias("flagged_context"), count_if(long & wide).alias("flagged_combined")
    ).withColumn("p99", T.half_even(F.col("p99"), 2))


def metric_table(frame: DataFrame, contexts: int, questions: int = QUESTIONS_PER_CONTEXT, by: str = "model") -> DataFrame:
    """The measures of a generator's rows, one row each; ``contexts`` is how many there should be."""
    expected = contexts * questions
    n = F.count(F.lit(1))
    yes, no = F.col("is_impossible") == ANSWERED, F.col("is_impossible") == IMPOSSIBLE
    rate = lambda c: percent(count_if(c), n)
    return frame.groupBy(by).agg(
        F.lit(contexts).cast("long").alias("contexts_processed"), F.lit(questions).cast("long").alias("questions_per_context"), F.lit(expected).cast("long").alias("expected_pairs"),
        n.alias("generated_pairs"), percent(n, F.lit(expected)).alias("completeness"), rate(yes).alias("answer_rate"), rate(no).alias("abstention_rate"),
        rate(F.col("literal_match")).alias("literal_span_valid"), rate(F.col("provided_offset_valid")).alias("provided_offset_valid"),
        rate(F.col("qc_status") == "non_extractive_or_hallucinated").alias("non_extractive"), count_if(no & (F.col("answer_text") != SENTINEL)).alias("inconsistent_sentinel"),
        count_if(strict()).alias("strict_n"), count_if(expanded(True)).alias("expanded_n"), count_if(uncertain(True)).alias("uncertain_n"),
        count_if(F.col("semantic_heuristic_flag")).alias("heuristic_flags"),
        T.half_even(F.coalesce(F.avg(F.when(yes, F.col("answer_words"))), F.lit(0.0)), 2).alias("mean_answer_words"),
    )


def pivoted(frame: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], of: Column, fill: float | None = 0.0) -> DataFrame:
    """A pivot over stated values; missing cells are filled."""
    wide = frame.groupBy(*index).pivot(columns, list(values)).agg(of)
    return wide.na.fill(fill, list(values)) if fill is not None else wide


def melted(frame: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value", prefix: str = "") -> DataFrame:
    """A row for each id and value column, without a prefix of the columns' names."""
    long = frame.unpivot(list(ids), list(values), name, value)
    return long.withColumn(name, F.when(F.startswith(F.col(name), F.lit(prefix)), F.substr(F.col(name), F.lit(len(prefix) + 1))).otherwise(F.col(name))) if prefix else long


def deltas(frame: DataFrame, index: Sequence[str], measures: Sequence[str], mode: str = "mode", before: str = "zsl", after: str = "ft") -> DataFrame:
    """How far each measure is after, less before; null where either is missing."""
    at = lambda m, x: F.avg(F.when(F.col(mode) == x, F.col(m)))
    return frame.groupBy(*index).agg(*[(at(m, after) - at(m, before)).alias(f"delta_{m}") for m in measures])


def best_row(frame: DataFrame, by: Sequence[str], measure: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Of each group the row with the greatest measure, of equals that with the least ``order``."""
    pick = F.max_by(F.struct(*columns), F.struct(F.col(measure), -F.col(order)))
    return frame.where(F.col(measure).isNotNull()).groupBy(*by).agg(pick.alias("_r")).select(*by, "_r.*")


def first_per_group(frame: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int = 3) -> DataFrame:
    """The first ``k`` rows of each group in order, with ``place`` from 1."""
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def drop_duplicates_first(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return first_per_group(frame, keys, order, 1).drop("place")


def longest_texts(frame: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """The ``k`` longest texts in characters, of equals the least key."""
    return frame.withColumn("chars", F.length(T.or_empty(text))).orderBy(F.desc("chars"), key).limit(k)


def random_row(frame: DataFrame, seed: int, key: str) -> DataFrame:
    return frame.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(1)


def plan(spark, models: Sequence[str], datasets: Sequence[str], modes: Sequence[str], slots: int) -> DataFrame:  # noqa: ANN001
    """All combinations in order, dealt to slots in turn; three short lists given by the caller."""
    rows = [(i, m, d, mode, i % slots) for i, (m, d, mode) in enumerate((m, d, mode) for m in models for d in datasets for mode in modes)]
    return spark.createDataFrame(rows, "place int, model string, dataset string, mode string, slot int")


def plan_of(rows: DataFrame, model: str, dataset: str, modes: Sequence[str], slots: int, most: int = 10_000) -> DataFrame:
    """``plan`` of the different models and datasets that a table's rows have, each in order of code points.

    Every model runs on every dataset, whether or not they meet in a row. Nulls are left out; a table without any of
    either gives no plan, and more than ``most`` of either are an error. Values are few, so each row of the plan follows by arithmetic from their lists.
    """
    named = F.explode(F.array(F.struct(F.lit("model").alias("kind"), F.col(model).cast("string").alias("value")), F.struct(F.lit("dataset").alias("kind"), F.col(dataset).cast("string").alias("value")))).alias("_p")
    found = rows.select(named).select("_p.*").where(F.col("value").isNotNull()).distinct()
    numbered = found.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("value"))).where(F.col("at") <= most + 1)
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind)
    lists = numbered.agg(listed("model"), listed("dataset"))
    many = F.greatest(F.size("model"), F.size("dataset"))
    lists = lists.withColumn("sets", F.when(many <= most, F.size("dataset")).otherwise(F.raise_error(F.lit(f"more than {most} models or datasets")).cast("int")))
    wide = lists.select("sets", "dataset", F.posexplode("model").alias("m", "model")).select("sets", "m", "model", F.posexplode("dataset").alias("d", "dataset"))
    runs = wide.select("*", F.posexplode(F.array(*map(F.lit, modes))).alias("o", "mode"))
    place = (F.col("m") * F.col("sets") + F.col("d")).cast("long") * len(modes) + F.col("o")
    return runs.select(place.alias("place"), "model", "dataset", "mode", (place % slots).alias("slot"))


PROGRESS = r"(\d+)/(\d+)\s*\[(\d+):(\d+):(\d+)<"


def marks(text: str) -> list[Column]:
    """What a log says last of its progress, null if nothing, and how often it has each marker."""
    part = lambda g: F.when(F.contains(text, F.lit("[")), T.last_match(text, PROGRESS, g)).cast("long")  # noqa: E731, most lines tell none
    progress = F.struct(part(1).alias("processed"), part(2).alias("target"), (part(3) * 3600 + part(4) * 60 + part(5)).alias("total_seconds"))
    return [
        F.when(part(1).isNotNull(), progress).alias("progress"), T.count_hits(F.lower(T.or_empty(text)), ["fallback"]).alias("fallbacks"),
        T.count_hits(text, ["Error crítico"]).alias("critical_errors"), T.count_hits(text, ["Checkpoint guardado"]).alias("checkpoints"),
    ]


def told(marked: DataFrame, path: str, model: str) -> DataFrame:
    """Logs' marks with segment and worker by their paths."""
    parts = F.split(path, "/")
    out = marked.select(
        model, F.when(F.size(parts) == 1, "initial").otherwise(F.get(parts, F.lit(0))).alias("segment"), F.try_element_at(parts, F.lit(-1)).alias("worker"),
        F.coalesce("progress.processed", F.lit(0)).alias("processed"), "progress.target", "fallbacks", "critical_errors", "checkpoints", "progress.total_seconds",
    )
    return out.withColumn("seconds_per_context", F.try_divide(F.nullif("total_seconds", F.lit(0)).cast("double"), F.nullif("processed", F.lit(0))))


def parsed_logs(logs: DataFrame, path: str = "path", text: str = "text", model: str = "model") -> DataFrame:
    """What each worker's log says last of its progress, and how often it has its markers.

    The segment is the log's folder, or ``initial`` for logs in the root (paths are relative to it).
    """
    return told(logs.select(model, path, *marks(text)), path, model)


def grown_logs(pieces: DataFrame, path: str = "path", piece: str = "piece", text: str = "text", model: str = "model") -> DataFrame:
    """The marks of logs that come in pieces: ``model``, ``path``, ``progress`` and the markers' counts of each log so far.

    Works on a table; of a stream each batch's ``piece_marks`` are kept, and joined when they are read. The progress is that of the last piece, by its number, that tells
    any, in whatever order pieces come; of pieces with one number and different progress the greater counts. Pieces end at ends of lines, as no mark runs on into the next line; null
    texts are empty, a piece without a number counts for markers alone, and null models and paths are logs of their own. A piece that is given twice counts twice.
    """
    return joined_logs(piece_marks(pieces, path, piece, text, model), path, model)


#: What is known of a log by some of its pieces: the last piece that tells its progress, with what it tells, and the markers' counts.
COUNTS = ("fallbacks", "critical_errors", "checkpoints")


def summed_marks(rows: DataFrame, path: str, model: str) -> DataFrame:
    return rows.groupBy(model, path).agg(F.max("told").alias("told"), *[F.sum(c).alias(c) for c in COUNTS])


def piece_marks(pieces: DataFrame, path: str = "path", piece: str = "piece", text: str = "text", model: str = "model") -> DataFrame:
    """What some pieces of logs tell: a row for each log, that ``joined_logs`` puts together with those of other pieces, in any order."""
    own = pieces.select(model, path, F.col(piece).alias("_piece"), *marks(text))
    told_at = F.when(F.col("progress").isNotNull() & F.col("_piece").isNotNull(), F.struct(F.col("_piece").alias("piece"), F.col("progress")))
    return summed_marks(own.select(model, path, told_at.alias("told"), *COUNTS), path, model)


def joined_logs(marked: DataFrame, path: str = "path", model: str = "model") -> DataFrame:
    """The marks of logs by those of their pieces; sums and greatest values, so no log's pieces are held together."""
    return summed_marks(marked, path, model).select(model, path, F.col("told.progress").alias("progress"), *COUNTS)


def segment_summary(logs: DataFrame) -> DataFrame:
    spent = F.sum("total_seconds")
    return logs.groupBy("model", "segment").agg(
        F.count("worker").alias("workers"), F.sum("processed").alias("processed"), spent.alias("elapsed_seconds"), F.sum("fallbacks").alias("fallbacks"),
        F.sum("critical_errors").alias("critical_errors"), F.sum("checkpoints").alias("checkpoints"), (spent / 3600).alias("gpu_hours"),
        F.try_divide(spent.cast("double"), F.nullif(F.sum("processed"), F.lit(0))).alias("seconds_per_context"), (F.max("total_seconds") / 3600).alias("wall_clock_hours"),
        hms(F.max("total_seconds")).alias("wall_clock"),
    )


def model_summary(segments: DataFrame) -> DataFrame:
    """All segments of a model, and how long one run with the most workers seen would take."""
    spent, workers = F.sum("elapsed_seconds"), F.greatest(F.max("workers"), F.lit(1))
    return segments.groupBy("model").agg(
        F.sum("processed").alias("processed"), (spent / 3600).alias("gpu_hours"), F.try_divide(spent.cast("double"), F.nullif(F.sum("processed"), F.lit(0))).alias("seconds_per_context"),
        (spent / workers / 3600).alias("continuous_hours"), hms(spent / workers).alias("continuous"),
    )


def hms(seconds: Column) -> Column:
    """Hours, minutes and seconds, null for null."""
    whole = seconds.cast("long")
    return F.when(whole.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60))


def probe_summary(probes: DataFrame, by: str = "max_new_tokens") -> DataFrame:
    """Results, failures and the longest answers for each token budget."""
    ok = F.col("ok")
    return probes.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), count_if(ok).alias("n_ok"), count_if(~ok).alias("errors"), F.coalesce(F.max(F.when(ok, F.col("answer_chars"))), F.lit(0)).alias("max_chars"),
        F.coalesce(F.max(F.when(ok, F.col("answer_tokens"))), F.lit(0)).alias("max_tokens"),
    )


def benchmark_summary(runs: DataFrame, by: str = "model") -> DataFrame:
    """Mean seconds of the contexts that succeeded, contexts a minute, and failures."""
    mean = F.avg(F.when(F.col("ok"), F.col("elapsed_s")))
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_samples"), count_if(F.col("ok")).alias("num_success"), count_if(~F.col("ok")).alias("num_failures"),
        T.half_even(mean, 3).alias("avg_context_time_s"), T.half_even(F.try_divide(F.lit(60.0), mean), 2).alias("contexts_per_min"),
    )


def latex(frame: DataFrame, caption: str, label: str, places: int = 2, most: int = 500) -> str:
    """A report table as LaTeX; tables of more than ``most`` rows are refused."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    escape = lambda x: "".join("\\" + c if c in "&%$#_{}" else c for c in x)
    cell = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else escape(str(v))
    body = [" & ".join(cell(v) for v in row) + r" \\" for row in rows]
    head = " & ".join(escape(c) for c in frame.columns) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{'l' * len(frame.columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""])
