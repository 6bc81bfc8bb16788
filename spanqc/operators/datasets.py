"""Builders of curated datasets, gold sets, samples and splits."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ANSWERED, CLEAN_NO_ANSWER, EXPANDED, IMPOSSIBLE
from ..sources.shared import shared_path
from .stats import wilson_low, wilson_high


def strict() -> Column:
    """Answered, unique, with a valid offset and not suspected; or a clean non-answer."""
    answered = (F.col("is_impossible") == ANSWERED) & (F.col("qc_status") == "extractive_valid_unique") & F.col("provided_offset_valid") & ~F.col("semantic_heuristic_flag")
    return F.coalesce(answered | ((F.col("is_impossible") == IMPOSSIBLE) & F.col("qc_status").isin(*CLEAN_NO_ANSWER)), F.lit(False))


def expanded(legacy: bool = False) -> Column:
    """Six states are admitted; ``legacy`` keeps rows that match only when normalised, though their start is unknown."""
    states = EXPANDED if legacy else [s for s in EXPANDED if s != "extractive_only_normalized"]
    return F.coalesce(F.col("qc_status").isin(*states), F.lit(False))


def uncertain(legacy: bool = True) -> Column:
    return ~strict() & ~expanded(legacy)


def curated(frame: DataFrame, legacy: bool = True) -> DataFrame:
    """The frame with the sets that each row belongs to as booleans."""
    return frame.withColumns({"in_strict": strict(), "in_expanded": expanded(legacy), "in_uncertain": uncertain(legacy)})


def gold_records(frame: DataFrame) -> DataFrame:
    """Audited rows as records: an answer that isn't in the context keeps its text, at -1."""
    context, answer, impossible = T.or_empty("context"), T.strip(T.or_empty("gold_answer")), T.as_bool("gold_is_impossible")
    has = ~impossible & (answer != "")
    answers = F.struct(
        F.when(has, F.array(answer)).otherwise(F.array().cast("array<string>")).alias("text"),
        F.when(has, F.array(T.find(context, answer))).otherwise(F.array().cast("array<int>")).alias("answer_start"),
    )
    rest = [c for c in ("context_id", "model", "error_type", "human_correct") if c in frame.columns]
    return frame.select(F.concat(F.lit("gold_"), F.col("row_id").cast("string")).alias("id"), context.alias("context"), T.or_empty("question").alias("question"), impossible.alias("is_impossible"), answers.alias("answers"), *rest)


def clamped(records: DataFrame) -> DataFrame:
    """Starts below zero made zero, for export."""
    starts = F.transform("answers.answer_start", lambda s: F.greatest(s, F.lit(0)))
    return records.withColumn("answers", F.struct(F.col("answers.text").alias("text"), starts.alias("answer_start")))


def without_gold(records: DataFrame, gold: DataFrame) -> DataFrame:
    """Records whose context and question aren't a gold pair; rows with a null in either stay."""
    return records.join(gold.select("context", "question").distinct(), ["context", "question"], "left_anti")


def gold_accuracy(audited: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """For each candidate set, audited rows that it holds, how many are right, and the Wilson interval; empty sets are left out."""
    parts = [
        audited.join(s.select("context_id", "question").distinct(), ["context_id", "question"], "left_semi").select(F.lit(name).alias("dataset"), "human_correct")
        for name, s in sets.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    n, k = F.count(F.lit(1)), F.sum("human_correct")
    return every.groupBy("dataset").agg(n.alias("n"), k.alias("correct"), (k / n).alias("accuracy"), wilson_low(k, n).alias("ci_lower"), wilson_high(k, n).alias("ci_upper"))


def hash_order(seed: int, *keys: Column | str) -> Column:
    """A fixed order that looks random: the MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[T.column(k).cast("string") for k in keys]))


def hash_sample(frame: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows without replacement, the same in every run: the least in hash order."""
    return frame.orderBy(hash_order(seed, *keys), *keys).limit(n)


def exact_sample(count: int, n: int, seed: int) -> list[int]:
    """Sorted indices as the generator of Python's ``random`` draws them; for lists that fit the driver."""
    return sorted(random.Random(seed).sample(range(count), min(n, count)))


def audit_stratum() -> Column:
    """The stratum of a row; the first that fits."""
    return (
        F.when(F.col("is_impossible") == IMPOSSIBLE, "no_answer")
        .when(F.col("semantic_heuristic_flag"), "heuristic_flag")
        .when(F.col("qc_status") == "non_extractive_or_hallucinated", "non_extractive")
        .when(F.col("qc_status") == "imposible_but_span_present", "impossible_but_span")
        .otherwise("positive_clean")
    )


#: Strata of the audit sample in order, with their share of the rows.
QUOTAS = (("positive_clean", 0.40), ("no_answer", 0.20), ("heuristic_flag", 0.20), ("non_extractive", 0.10), ("span_present", 0.10))


def audit_sample(frame: DataFrame, n: int, seed: int = 42, by: str = "model") -> DataFrame:
    """A stratified sample of ``n`` rows at most for each value of ``by``.

    Strata overlap; each gives the first of its rows in hash order, at least one. A key that
    several give is kept for the first; then the first ``n`` in order of strata and hash.
    """
    member = {
        "positive_clean": F.col("literal_match") & ~F.col("semantic_heuristic_flag"),
        "no_answer": F.col("is_impossible") == IMPOSSIBLE,
        "heuristic_flag": F.col("semantic_heuristic_flag"),
        "non_extractive": F.col("qc_status") == "non_extractive_or_hallucinated",
        "span_present": F.col("qc_status") == "imposible_but_span_present",
    }
    strata = F.filter(F.array(*[F.when(F.coalesce(member[s], F.lit(False)), F.struct(F.lit(i).alias("stratum"), F.lit(max(1, int(n * q))).alias("quota"))) for i, (s, q) in enumerate(QUOTAS)]), lambda s: s.isNotNull())
    rows = frame.withColumn("_hash", hash_order(seed, "context_id", "question")).withColumn("_s", F.explode(strata)).select("*", "_s.*").drop("_s")
    most = max(max(1, int(n * q)) for _, q in QUOTAS)  # a number, so that each task keeps no more rows of a stratum before the shuffle
    in_stratum = Window.partitionBy(by, "stratum").orderBy("_hash", "context_id", "question")
    drawn = rows.withColumn("_n", F.row_number().over(in_stratum)).where((F.col("_n") <= most) & (F.col("_n") <= F.col("quota")))
    first = drawn.withColumn("_k", F.row_number().over(Window.partitionBy(by, "context_id", "question").orderBy("stratum", "_n"))).where("_k = 1")
    out = first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("stratum", "_n"))).where(F.col("place") <= n)
    return out.drop("_hash", "_n", "_k", "quota")


def check_shares(train: float, dev: float, test: float) -> None:
    if abs(train + dev + test - 1.0) > 1e-9:
        raise ValueError("the shares of the splits must add up to 1")


def ranked(ids: DataFrame, key: str, seed: int, buckets: int = 1024) -> DataFrame:
    """Ids with ``place`` from 0 in hash order, and ``n_keys``; sums over buckets of the hash, so no task sees all of them."""
    hashed = ids.withColumn("_h", hash_order(seed, key)).withColumn("_b", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    sizes = hashed.groupBy("_b").count()
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        F.col("_b").alias("_bucket"), F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("n_keys")
    )
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    placed = hashed.withColumn("_in", inside).join(F.broadcast(before), F.col("_b") == F.col("_bucket"))  # at most ``buckets`` rows
    return placed.withColumn("place", (F.col("_before") + F.col("_in")).cast("long")).drop("_h", "_b", "_bucket", "_before", "_in")


def split_by_key(frame: DataFrame, key: str = "context_id", train: float = 0.8, dev: float = 0.1, test: float = 0.1, seed: int = 42, limit: int | None = None) -> DataFrame:
    """``key`` and ``split`` of every different key, cut in hash order at the rounded shares of test, then dev.

    Keys, not rows, are split, so no context stands in two splits. ``limit`` takes the first
    keys in order of text.
    """
    check_shares(train, dev, test)
    ids = frame.select(key).where(F.col(key).isNotNull()).distinct()
    ids = ids.orderBy(key).limit(max(0, limit)) if limit is not None else ids
    tests, devs = (F.bround(F.col("n_keys") * F.lit(share), 0) for share in (test, dev))
    place = F.col("place")
    return ranked(ids, key, seed).select(key, F.when(place < tests, "test").when(place < tests + devs, "validation").otherwise("train").alias("split"))


def exact_split(ids: Sequence[str], train: float, dev: float, test: float, seed: int) -> dict[str, str]:
    """The split of ids as Python's ``random`` shuffles them sorted; for lists that fit the driver."""
    check_shares(train, dev, test)
    shuffled = sorted(set(ids))
    random.Random(seed).shuffle(shuffled)
    tests, devs = round(len(shuffled) * test), round(len(shuffled) * dev)
    return {x: "test" if k < tests else "validation" if k < tests + devs else "train" for k, x in enumerate(shuffled)}


def experiment_splits(partition: DataFrame, variant: DataFrame, whole: DataFrame, key: str = "context_id") -> DataFrame:
    """Rows to train on from a variant, to develop and test on from the whole set, all by one partition of the keys."""
    learn = variant.join(partition.where("split = 'train'"), key)
    rest = whole.join(partition.where("split <> 'train'"), key)
    return learn.unionByName(rest, allowMissingColumns=True)


def prepared_splits(parts: dict[str, DataFrame], dev: float = 0.1, test: float = 0.1, seed: int = 42, key: str = "id") -> DataFrame:
    """Rows with ``split`` from what there is: all three parts, train and test (dev is cut from train), or train alone."""
    if {"train", "validation", "test"} <= set(parts):
        out = [parts[s].withColumn("split", F.lit(s)) for s in ("train", "validation", "test")]
    else:
        left = {"train", "test"} <= set(parts)
        shares = (1 - dev / (1 - test), dev / (1 - test), 0.0) if left else (1 - dev - test, dev, test)
        cut = parts["train"].join(split_by_key(parts["train"], key, *shares, seed=seed), key)
        out = [cut, parts["test"].withColumn("split", F.lit("test"))] if left else [cut]
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def in_key_order(ids: DataFrame, key: str) -> DataFrame:
    """Different ids with ``place`` from 0 in order of the key, null first.

    Ranges of keys are sorted in many tasks and held in the shared folder; a key's place is that in its range and
    the sizes of the ranges before.
    """
    path = shared_path(ids.sparkSession, "ordered")
    sorted_ = ids.repartitionByRange(key).sortWithinPartitions(key)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_.select(key, F.spark_partition_id().alias("_part"), inside.alias("_in")).write.parquet(path)
    held = ids.sparkSession.read.parquet(path)
    upto = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy(F.col("_part").alias("_of")).count().select("_of", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(before), F.col("_part") == F.col("_of")).select(key, (F.col("_before") + F.col("_in")).cast("long").alias("place"))  # a row for each range


def shards(frame: DataFrame, key: str, workers: int, seed: int | None = None) -> DataFrame:
    """Rows with ``place`` in order and ``shard``, every ``workers``-th key alike.

    With a seed the order is that of a hash, summed over buckets; without one it is that of the keys. Rows
    without a key are left out.
    """
    ids = frame.select(key).where(F.col(key).isNotNull()).distinct()
    order = in_key_order(ids, key) if seed is None else ranked(ids, key, seed).drop("n_keys")
    return frame.join(order.withColumn("shard", F.pmod("place", F.lit(workers))), key)


def remaining(frame: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return frame.join(done.select(key).distinct(), key, "left_anti")
