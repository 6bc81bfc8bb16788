"""Span location and extractive validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ANSWERED, IMPOSSIBLE, SENTINEL


def locate(context: Column | str, answer: Column | str) -> Column:
    """First literal occurrence: start, end and whether the answer is impossible; a blank or missing one is, at (0, 0)."""
    at, size = T.find(context, answer), F.length(T.column(answer))
    found = at >= 0
    return F.struct(
        F.when(found, at).otherwise(0).alias("start"), F.when(found, at + size).otherwise(0).alias("end"), (~found).alias("impossible")
    )


def relabel(frame: DataFrame) -> DataFrame:
    """Replaces offsets and label by what the text itself says, whatever the generator claimed."""
    at = locate("context", "answer_text")
    return frame.withColumn("_at", at).withColumns(
        {
            "answer_start": F.col("_at.start"),
            "answer_end": F.col("_at.end"),
            "impossible_find_answer": F.col("_at.impossible").cast("string"),
            "is_impossible": F.when(F.col("_at.impossible"), IMPOSSIBLE).otherwise(ANSWERED),
        }
    ).drop("_at")


def valid_offset(context: Column, answer: Column, start: Column, end: Column) -> Column:
    """Whether the given offsets cut out the answer; offsets that are no numbers, negative or reversed don't."""
    a, b = start.try_cast("int"), end.try_cast("int")
    return F.coalesce((answer != "") & (a >= 0) & (b >= a) & (T.slice_of(context, a, b) == answer), F.lit(False))


def extractive_validity(frame: DataFrame, exact: bool = True, normal=None) -> DataFrame:  # noqa: ANN001
    """Classifies candidate rows into nine states.

    Adds ``literal_match``, ``norm_match``, ``literal_match_count``, ``recomputed_answer_start``
    (-1 unless literal), ``provided_offset_valid``, ``qc_status`` and ``answer_words`` (of the
    text as given). Any label but the impossible one is taken as answered. ``normal``
    is the function for the normalised comparison, by default the exact
    normal form, or the fast one; its answers are wanted only where no literal match is.
    """
    normal = normal or (lambda c: T.normalize(c, exact))
    label = F.lower(T.strip(T.or_empty("is_impossible")))

    def counted(x: Column) -> Column:
        said = ~x["impossible"] & (x["answer"] != "") & (x["answer"] != SENTINEL)
        count = T.count_overlapping(x["context"], x["answer"])
        return F.struct(x["answer"].alias("answer"), x["impossible"].alias("impossible"), said.alias("said"), count.alias("n"))

    looked = frame.withColumn("_l", T.let(counted, answer=T.strip(T.or_empty("answer_text")), impossible=label == IMPOSSIBLE, context=T.or_empty("context")))
    undecided = F.col("_l.said") & (F.col("_l.n") == 0)
    form = lambda c: F.when(undecided, normal(c))
    looked = looked.withColumns({"_nc": form(T.or_empty("context")), "_na": form(F.col("_l.answer"))})

    def decided(x: Column) -> Column:
        answer, impossible, said, n = (x["l"][name] for name in ("answer", "impossible", "said", "n"))
        literal = said & (n > 0)
        by_form = F.coalesce(said & (n == 0) & (x["na"] != "") & F.contains(x["nc"], x["na"]), F.lit(False))
        status = (
            F.when(impossible & (answer == SENTINEL), "no_answer_clean")
            .when(impossible & (answer == ""), "no_answer_empty")
            .when(impossible & (n > 0), "imposible_but_span_present")
            .when(impossible, "no_answer_free_text")
            .when(~said, "respondido_no_answer")
            .when(n == 1, "extractive_valid_unique")
            .when(n >= 2, "extractive_ambiguous")
            .when(by_form, "extractive_only_normalized")
            .otherwise("non_extractive_or_hallucinated")
        )
        return F.struct(
            literal.alias("literal_match"), (literal | by_form).alias("norm_match"), F.when(said | impossible, n).otherwise(0).alias("literal_match_count"),
            F.when(literal, T.find(x["context"], answer)).otherwise(-1).alias("recomputed_answer_start"),
            (literal & valid_offset(x["context"], answer, x["start"], x["end"])).alias("provided_offset_valid"), status.alias("qc_status"),
        )

    verdict = T.let(decided, l=F.col("_l"), nc=F.col("_nc"), na=F.col("_na"), context=T.or_empty("context"), start=F.col("answer_start"), end=F.col("answer_end"))
    names = ("literal_match", "norm_match", "literal_match_count", "recomputed_answer_start", "provided_offset_valid", "qc_status")
    out = looked.withColumn("_v", verdict).withColumns({**{name: F.col(f"_v.{name}") for name in names}, "answer_words": T.word_count("answer_text")})
    return out.drop("_l", "_nc", "_na", "_v")


def row_id(model: Column | str) -> Column:
    """``model_context-id_digits``: the digits are those of the question's MD5, the same in every run."""
    return F.concat_ws("_", T.column(model), F.col("context_id"), T.short_id(F.col("question")))


def to_squad2(frame: DataFrame, model: Column | str = "model", legacy: bool = False) -> DataFrame:
    """Classified rows as records with nested answers.

    The span's text is the stripped one, so that it stands at its start; rows whose start
    is unknown get no span. ``legacy`` keeps the text as given and a start of -1.
    """
    answered = F.lower(T.strip(T.or_empty("is_impossible"))) != IMPOSSIBLE
    span = T.or_empty("answer_text") if legacy else T.strip(T.or_empty("answer_text"))
    has = answered if legacy else answered & (F.col("recomputed_answer_start") >= 0)
    answers = F.struct(
        F.when(has, F.array(span)).otherwise(F.array().cast("array<string>")).alias("text"),
        F.when(has, F.array(F.col("recomputed_answer_start").cast("int"))).otherwise(F.array().cast("array<int>")).alias("answer_start"),
    )
    return frame.select(row_id(model).alias("id"), "context", "question", (~answered).alias("is_impossible"), answers.alias("answers"), "context_id")
