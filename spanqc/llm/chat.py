"""Chat formatting with cumulative-snapshot collapse.

A conversation that is logged again and again while it grows leaves snapshots, each of
which begins like a longer one. Only DataFrame functions: every turn gets the rolling
hash of the turns up to it, which is the running sum of hashes of position, role and
text (120 bits), so equal sums stand for equal beginnings. An anti-join takes out
the conversations whose whole hash is that of a beginning of a longer one; the
maximal ones are rendered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Parts of a turn's hash: hex digits of each, so that sums of 2^23 turns stay within a long.
PARTS, DIGITS = 3, 10
#: How a turn is written; the role and text are put in.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def exact(column: str) -> Column:
    """A text with its length before it, so that no two lists of texts look alike; null differs from empty."""
    return F.coalesce(F.concat(F.length(column).cast("string"), F.lit(":"), F.col(column)), F.lit("-"))


def hash_parts(place: Column, digest: Column) -> list[Column]:
    """The hash of a turn at its place, in parts that can be summed."""
    at = F.md5(F.concat(place.cast("string"), F.lit("/"), digest))
    return [F.conv(F.substring(at, 1 + k * DIGITS, DIGITS), 16, 10).cast("long") for k in range(PARTS)]


def digest() -> Column:
    return F.md5(F.concat(exact("role"), exact("text")))


def written() -> Column:
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Adds ``place`` (from 1), ``more`` (turns follow) and the parts of the rolling hash, ``h0``, ``h1``, ..., to ``conv``, ``turn``, ``role``, ``text``."""
    line = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), F.col("digest"))
    placed = turns.withColumn("digest", digest()).withColumn("place", F.row_number().over(line))
    for k, part in enumerate(hash_parts(F.col("place"), F.col("digest"))):
        placed = placed.withColumn(f"part{k}", part)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(PARTS):
        placed = placed.withColumn(f"h{k}", F.sum(f"part{k}").over(upto)).drop(f"part{k}")
    return placed.withColumn("more", F.lead("place").over(line).isNotNull())


def without(whole: DataFrame, inner: DataFrame) -> DataFrame:
    """Whole conversations (hash and ``n_turns``) less those whose hash is that of a beginning of a longer one."""
    parts = [f"h{k}" for k in range(PARTS)]
    same = reduce(lambda a, b: a & b, [whole[p] == inner["p" + p] for p in parts], whole.n_turns == inner["p"])
    return whole.join(inner, same, "left_anti")


def beginnings(hashed: DataFrame) -> DataFrame:
    """Each beginning of a longer conversation once; cut, so that a very common one's rows can be dealt to several tasks in a join."""
    return cut(hashed.where("more").select(F.col("place").alias("p"), *[F.col(f"h{k}").alias(f"ph{k}") for k in range(PARTS)]).distinct())


def render(frame: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """The maximal conversations, each as one text.

    Turns stand by number (null last, equal numbers by a hash of role and text); each is
    rendered as opening mark, role, line break, text and closing mark. Returns ``id_column``,
    ``n_turns`` and ``rendered``. Conversations that begin a longer one are left out;
    equal ones are all kept, as none is longer. Two conversations are compared by role and
    text of their turns, not by turn numbers; null and empty differ. Null roles and
    texts are rendered as empty. A row with a null id belongs to no other row: it is a conversation of
    one turn, with a null id. Repeated rows are turns of their own; other columns are left aside;
    an empty table gives none.
    """
    turns = frame.select(
        F.col(id_column).alias("conv"), F.col(turn_column).alias("turn"), F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text")
    )
    named, parts = turns.where("conv IS NOT NULL"), [f"h{k}" for k in range(PARTS)]
    hashed = cut(prefix_hashes(named).select("conv", "place", "more", *parts))
    inner = beginnings(hashed)
    kept = without(hashed.where(~F.col("more")).select("conv", F.col("place").alias("n_turns"), *parts), inner).select(F.col("conv").alias("c"), "n_turns")
    mine = named.join(kept, named.conv == kept["c"])
    one = F.struct(F.col("turn").isNull().alias("last"), "turn", digest().alias("digest"), written().alias("written"))
    lists = mine.groupBy("conv").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(one)).alias("turns"))
    joined = lists.select("conv", F.col("n_turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("rendered"))
    alone = turns.where("conv IS NULL").select("conv", F.lit(1).alias("n_turns"), *[h.alias(p) for h, p in zip(hash_parts(F.lit(1), digest()), parts, strict=True)], written().alias("rendered"))
    every = joined.unionByName(without(alone, inner).select("conv", F.col("n_turns").cast("long").alias("n_turns"), "rendered"))
    return every.withColumnRenamed("conv", id_column)
