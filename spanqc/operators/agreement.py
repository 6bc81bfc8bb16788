"""Comparison and merging of two generators' answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ANSWERED, IMPOSSIBLE, SENTINEL

KEYS = ("context_id", "question")


def paired(a: DataFrame, b: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = KEYS, texts: tuple[str, ...] = ()) -> DataFrame:
    """Inner join on keys, where null meets null, with the columns as ``_a`` and ``_b``.

    ``texts`` are keys too, but long ones: rows meet by their digests and are then compared, so that no text is sorted or hashed whole by the join.
    """
    digest = F.xxhash64(*texts) if texts else F.lit(0)
    left = a.select(*keys, *texts, *[F.col(c).alias(f"{c}_a") for c in columns], digest.alias("__digest_a"))
    right = b.select(*[F.col(k).alias(f"__{k}") for k in (*keys, *texts)], *[F.col(c).alias(f"{c}_b") for c in columns], digest.alias("__digest_b"))
    same = F.col("__digest_a") == F.col("__digest_b") if texts else F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    for k in texts:  # not as an equation of two columns, which would make it a key of the join
        same = same & F.coalesce(F.col(k) == F.col(f"__{k}"), F.col(k).isNull() & F.col(f"__{k}").isNull())
    return left.join(right, same).drop("__digest_a", "__digest_b", *[f"__{k}" for k in (*keys, *texts)])


def unmatched(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys that only one of the two has, and which."""
    only = lambda x, y, name: x.select(*keys).join(y.select(*keys), list(keys), "left_anti").withColumn("only_in", F.lit(name))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def positional(a: DataFrame, b: DataFrame, columns: tuple[str, ...], context: str = "context_id", place: str = "k") -> DataFrame:
    """The two generators' rows of equal place in a context, side by side.

    Rows of a context that another number of places or another question at a place faces are an error: its answers can't be compared.
    """
    keys = (context, place)
    left = a.select(*keys, F.col("question").alias("question_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*keys, F.col("question").alias("question_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    both = left.join(right, list(keys), "full")
    wrong = F.when(~F.col("question_a").eqNullSafe(F.col("question_b")), F.raise_error(F.concat(F.lit("other questions or places in context "), F.coalesce(F.col(context).cast("string"), F.lit("null")))).cast("boolean"))
    return both.where(F.coalesce(wrong, F.lit(True))).withColumnRenamed("question_a", "question").drop("question_b")


def by_number(a: DataFrame, b: DataFrame, columns: tuple[str, ...], key: str = "context_id") -> DataFrame:
    """Rows of contexts with the same number at the end of their ids, whatever stands before it, by question; rows whose number only one side has are left out."""
    number = F.regexp_extract(F.col(key), r"(\d+)$", 1).try_cast("long")
    with_number = lambda x: x.withColumn("context_number", number).where(F.col("context_number").isNotNull())
    return paired(with_number(a), with_number(b), columns, ("context_number", "question"))


def same_answer(a: Column, b: Column, exact: bool = True) -> Column:
    """Whether two answers have one normal form and the first isn't blank."""
    return (T.normalize(a, exact) == T.normalize(b, exact)) & (T.strip(T.or_empty(a)) != "")


def agreement(a: DataFrame, b: DataFrame, exact: bool = True) -> DataFrame:
    """Every pair of rows with its kind of agreement."""
    pairs = paired(a, b, ("answer_text", "is_impossible", "qc_status"))
    yes_a, yes_b = F.col("is_impossible_a") == ANSWERED, F.col("is_impossible_b") == ANSWERED
    same = same_answer(F.col("answer_text_a"), F.col("answer_text_b"), exact)
    kind = (
        F.when(yes_a & yes_b & same, "agree_exact").when(yes_a & yes_b, "disagree_span").when(~yes_a & ~yes_b, "agree_no_answer").otherwise("disagree_answerability")
    )
    return pairs.withColumn("agreement", kind)


def agreement_rates(pairs: DataFrame) -> DataFrame:
    """Pairs, and the shares that agree: on answerability, on the answer among both answered, on none."""
    n = F.count(F.lit(1))
    of = lambda *kinds: F.count_if(F.col("agreement").isin(*kinds))
    share = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y), F.lit(0.0))
    return pairs.agg(
        n.alias("n_pairs"),
        share(of("agree_exact", "disagree_span", "agree_no_answer"), n).alias("answerability_agreement"),
        share(of("agree_exact"), of("agree_exact", "disagree_span")).alias("exact_agreement"),
        share(of("agree_no_answer"), n).alias("no_answer_agreement"),
        share(of("disagree_answerability"), n).alias("disagreement"),
    )


def similarity_agreement(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs labelled ``both_impossible``, ``agree`` (similar answers) or ``disagree``."""
    pairs = paired(a, b, ("answer_text", "impossible"))
    ratio = T.similarity("answer_text_a", "answer_text_b")
    kind = (
        F.when(F.col("impossible_a") & F.col("impossible_b"), "both_impossible").when(F.col("impossible_a") != F.col("impossible_b"), "disagree")
        .when(F.col("similarity") >= threshold, "agree").otherwise("disagree")
    )
    return pairs.withColumn("similarity", ratio).withColumn("agreement", kind)


def merged(a: DataFrame, b: DataFrame, legacy: bool = False, exact: bool = True) -> DataFrame:
    """One row for each pair of id, question and context that a policy can settle; the others are left out.

    Rows whose contexts differ are no pair, as an answer's offset is one in its own context; null is a context like any other.
    Both impossible: no answer. Same answer: that of A if A's offset is valid, else B's; where
    B's start is unknown the pair isn't settled, unless ``legacy``. Else the first of A and B that is
    answered, unique, with a valid offset and not suspected.
    """
    columns = ("answer_text", "is_impossible", "qc_status", "provided_offset_valid", "semantic_heuristic_flag", "recomputed_answer_start")
    pairs = paired(a, b, columns, texts=("context",))
    none = F.struct(F.lit("both").alias("model"), F.lit(IMPOSSIBLE).alias("is_impossible"), F.lit(SENTINEL).alias("answer_text"), F.lit(-1).alias("recomputed_answer_start"))

    def of(x: str) -> Column:
        return F.struct(F.lit(x).alias("model"), F.lit(ANSWERED).alias("is_impossible"), F.col(f"answer_text_{x}").alias("answer_text"), F.col(f"recomputed_answer_start_{x}").alias("recomputed_answer_start"))

    def good(x: str) -> Column:
        return (
            (F.col(f"is_impossible_{x}") == ANSWERED) & (F.col(f"qc_status_{x}") == "extractive_valid_unique")
            & F.col(f"provided_offset_valid_{x}") & ~F.col(f"semantic_heuristic_flag_{x}")
        )

    same = same_answer(F.col("answer_text_a"), F.col("answer_text_b"), exact)
    from_b = same if legacy else same & (F.col("recomputed_answer_start_b") >= 0)
    pick = (
        F.when((F.col("is_impossible_a") == IMPOSSIBLE) & (F.col("is_impossible_b") == IMPOSSIBLE), none)
        .when(same & F.col("provided_offset_valid_a"), of("a")).when(from_b, of("b")).when(good("a"), of("a")).when(good("b"), of("b"))
    )
    return pairs.withColumn("pick", pick).where(F.col("pick").isNotNull()).select("context_id", "context", "question", "pick.*")
