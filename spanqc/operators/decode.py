"""Token windows, label positions, and decoding of spans from logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def windows(tokens: Column | str, length: int = 384, overlap: int = 128) -> Column:
    """Overlapping windows of an array of tokens, each with its first index; the last one reaches the end."""
    if not 0 <= overlap < length:
        raise ValueError("the overlap must be shorter than a window")
    t = T.column(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.size(t) - overlap - 1, F.lit(0)), F.lit(length - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice(t, s + 1, F.lit(length)).alias("tokens")))


def token_windows(frame: DataFrame, text: str = "context", length: int = 384, overlap: int = 128) -> DataFrame:
    """A row for each window of each text's words; a text without words has one empty window."""
    split = F.filter(F.split(T.or_empty(text), r"(?U)\s+"), lambda t: t != "")
    return frame.withColumn("_tokens", split).select("*", F.posexplode(windows("_tokens", length, overlap)).alias("window", "_w")).select("*", "_w.*").drop("_tokens", "_w")


def span_tokens(offsets: Column, start: Column, end: Column) -> Column:
    """First and last token of a span of characters within a window's offsets (structs ``b``, ``e``); (0, 0) if it isn't inside."""
    numbered = F.transform(offsets, lambda o, i: F.struct(i.alias("i"), o["b"].alias("b"), o["e"].alias("e")))
    real = F.filter(numbered, lambda o: o["e"] > o["b"])
    inside = (F.size(real) > 0) & (F.try_element_at(real, F.lit(1))["b"] <= start) & (F.try_element_at(real, F.lit(-1))["e"] >= end) & (end > start)
    first = F.array_max(F.transform(F.filter(real, lambda o: o["b"] <= start), lambda o: o["i"]))
    last = F.array_min(F.transform(F.filter(real, lambda o: o["e"] >= end), lambda o: o["i"]))
    found = F.coalesce(inside, F.lit(False))
    return F.struct(F.when(found, first).otherwise(0).alias("start_token"), F.when(found, last).otherwise(0).alias("end_token"))


#: Characters of a bucket in which spans meet tokens.
BUCKET = 64


def window_labels(contexts: DataFrame, spans: DataFrame, length: int = 384, overlap: int = 128, before: int = 1, key: str = "context_id", text: str = "context") -> DataFrame:
    """For each span and each overlapping window of its text's words the span's first and last token: the spans' columns, ``window``, ``start_token``, ``end_token``.

    ``contexts`` has one row for each ``key``; ``spans`` has ``key``, ``start`` and ``end`` (characters, end excluded). ``before`` tokens stand before the text's
    in a window. The start belongs to the last word that begins at or before it, the end to the first that ends at or behind it; a window that
    lacks either has (0, 0), as has an empty span. Spans meet words by buckets of characters, so that work grows with the spans and
    the words, not with their product. Spans of unknown keys have no window; a text without words has one.
    """
    if not 0 <= overlap < length:
        raise ValueError("the overlap must be shorter than a window")
    step = length - overlap
    runs = contexts.select(F.col(key).alias("_key"), F.posexplode(F.regexp_extract_all(T.or_empty(text), F.lit(r"(?U)\s*\S+"), 0)).alias("i", "run"))
    order = Window.partitionBy("_key").orderBy("i")
    placed = runs.withColumn("e", F.sum(F.length("run")).over(order)).withColumn("b", F.col("e") - F.length(F.regexp_replace("run", r"(?U)^\s+", "")))
    # The starts and the ends that belong to a word.
    words = placed.withColumns({"last_start": F.coalesce(F.lead("b").over(order) - 1, F.col("e")), "first_end": F.coalesce(F.lag("e").over(order), F.lit(0)) + 1})
    buckets = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / BUCKET), F.floor(F.col(high) / BUCKET)))
    begins = words.select("_key", F.col("i").alias("first"), F.col("b").alias("low"), F.col("last_start").alias("high"), buckets("b", "last_start").alias("bucket"))
    ends = words.select("_key", F.col("i").alias("last"), F.col("first_end").alias("low"), F.col("e").alias("high"), buckets("first_end", "e").alias("bucket"))
    rows = spans.withColumn("_row", F.monotonically_increasing_id())
    own = rows.where(F.col("end") > F.col("start")).select(F.col(key).alias("_key"), "_row", "start", "end")

    def met(side: DataFrame, at: str, name: str) -> DataFrame:
        asked = own.select("_key", "_row", F.col(at).alias("_at"), F.floor(F.col(at) / BUCKET).alias("bucket"))
        return asked.join(side, ["_key", "bucket"]).where(F.col("_at").between(F.col("low"), F.col("high"))).select("_row", name)

    found = met(begins, "start", "first").join(met(ends, "end", "last"), "_row")
    counts = words.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    sized = contexts.select(F.col(key).alias("_key")).join(counts, "_key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    wide = rows.join(sized, rows[key] == sized["_key"]).drop("_key").join(found, "_row", "left")
    wide = wide.withColumn("window", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("_n") - overlap) / step).cast("int") - 1, F.lit(0)))))
    inside = F.coalesce((F.col("first") >= F.col("window") * step) & (F.col("last") < F.col("window") * step + length), F.lit(False))
    token = lambda c: F.when(inside, F.col(c) - F.col("window") * step + before).otherwise(0).cast("int")
    return wide.select(*spans.columns, "window", token("first").alias("start_token"), token("last").alias("end_token"))


def top_positions(scores: Column, n: int) -> Column:
    """The ``n`` best positions of an array with their scores, the best first; of equal ones the first."""
    return F.slice(F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("minus"), i.alias("at")))), 1, n)


def decode(features: DataFrame, examples: DataFrame, n_best: int = 20, longest: int = 100) -> DataFrame:
    """The best span of every example over its windows.

    ``features``: ``example_id``, ``window``, ``offsets`` (array of structs ``b``, ``e``), ``start_logits``,
    ``end_logits``. A span starts and ends at one of the ``n_best`` positions of a window, has fewer than
    ``longest`` tokens, no end at the offsets (0, 0), and isn't blank. Of equal scores the
    earlier window, then the earlier tokens win. The score of no answer is the least over windows of
    the first position's sum, less the best span's; infinite without a span.
    """
    offset = lambda p: F.get(F.col("offsets"), p["at"])
    real = lambda p: ~((offset(p)["b"] == 0) & (offset(p)["e"] == 0))

    def begin(p: Column) -> Column:
        """A start with its offset, and where the first character from there on stands that isn't white space, null if none does."""
        b = offset(p)["b"]
        mark = F.nullif(F.regexp_instr(F.substring("context", b + 1, F.length("context")), F.lit(r"(?U)\S")), F.lit(0))
        return F.struct(p["minus"].alias("minus"), p["at"].alias("at"), b.alias("b"), F.when(b >= 0, b + mark).alias("seen"))

    def spans(x: Column) -> Column:
        """All spans of a window that aren't blank; their texts aren't cut out, as one of them is wanted."""
        fit = lambda s: F.filter(x["ends"], lambda e: (e["at"] >= s["at"]) & (e["at"] - s["at"] < longest) & (e["e"] >= s["seen"]))
        span = lambda s, e: F.struct((-s["minus"] - e["minus"]).alias("score"), (-F.col("window")).alias("w"), (-s["at"]).alias("s"), (-e["at"]).alias("e"), s["b"].alias("first"), e["e"].alias("last"))
        return F.array_max(F.flatten(F.transform(x["starts"], lambda s: F.transform(fit(s), lambda e: span(s, e)))))

    texts = examples.select(F.col("id").alias("example_id"), "context")
    wide = features.join(texts, "example_id")
    starts = F.transform(F.filter(top_positions(F.col("start_logits"), n_best), lambda s: real(s) & (offset(s)["e"] > offset(s)["b"])), begin)
    ends = F.transform(F.filter(top_positions(F.col("end_logits"), n_best), real), lambda e: F.struct(e["minus"].alias("minus"), e["at"].alias("at"), offset(e)["e"].alias("e")))
    # Bound, as a column that is used within a function of each start would be sorted anew for each.
    best = wide.withColumn("best", T.let(spans, starts=starts, ends=ends)).select(
        "example_id", F.when(F.col("best").isNotNull(), F.struct("best.score", "best.w", "best.s", "best.e", T.slice_of("context", F.col("best.first"), F.col("best.last")).alias("text"))).alias("best"),
        (F.get("start_logits", F.lit(0)) + F.get("end_logits", F.lit(0))).alias("null_score"),
    )
    picked = best.groupBy("example_id").agg(F.max("best").alias("best"), F.min("null_score").alias("null_score"))
    out = examples.select("id").join(picked, F.col("id") == F.col("example_id"), "left")
    score = F.when(F.col("best").isNull(), F.lit(float("inf"))).otherwise(F.col("null_score") - F.col("best.score"))
    return out.select("id", F.coalesce("best.text", F.lit("")).alias("prediction_text"), score.alias("no_answer_probability"))
