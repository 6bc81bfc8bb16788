"""Mixing sources to target weights by systematic sampling.

Only DataFrame functions. Each document of a source is expected ratio = target / words
of the source times. The documents of a source stand in a line; the expected
copies are summed along it, one offset is added for the source, and a
document is taken once for each whole number that its stretch of the line crosses.

The line is cut into blocks by a hash of id and size, so a hot source is summed in many
tasks; only the blocks' numbers of documents are summed along a source. Rows of one id and
size are counted before they are put in line.
Within a block documents stand by size, up in one block and down in the next,
which keeps the words taken near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all words.
SHARE = 1.5
#: A source's largest target, as a multiple of its words.
MOST = 2
#: Documents of a block while a source has fewer than the square of this.
BLOCK_ROWS = 2048
#: Rows alike that stay in one task.
STRETCH = 10_000


def unit_hash(*parts: Column) -> Column:
    """Eight hex digits of an MD5 as an integer below 2^32."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def words_of(text: Column) -> Column:
    """Runs of characters other than the blanks of ASCII; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words, documents and target of every source.

    Targets are ``weight`` times a common level, but at most ``most`` times the source's
    words; that is where resharing the excess by weight ends. Sources that
    stop come first in order of words by weight, and the level is found from the sums
    before each source in that order. The frame has a row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")).cast("double"))
    line = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    summed = (
        weighed.withColumn("at", F.row_number().over(line))
        .withColumn("total", F.sum("source_size").over(all_))
        .withColumn("stopped", F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (share * F.col("total") - most * F.col("stopped")) / F.col("weight_left"))
        # Up to the first source that the level before it doesn't stop, all stop.
        .withColumn("enough", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    )
    level = F.min(F.when(F.col("enough"), F.struct("at", "level"))).over(all_)["level"]
    target = F.least(most * F.col("source_size").cast("double"), level * F.col("weight"))
    return summed.withColumn("target", F.coalesce(target, most * F.col("source_size").cast("double"))).select("source", "source_size", "documents", "target")


def mix(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42) -> DataFrame:
    """How much the mix takes of every document.

    Returns ``id_column``, ``size`` (words), ``source_size``, ``target`` (both of its
    source), ``taken`` (words, copies counted). No document is taken more than
    ``most`` times, rounded up. Sources stand by code point, null last and a source
    of its own. Null texts have no words; null and repeated ids keep their
    rows. Where nothing has words, targets are zero.
    Other columns are left aside; an empty table gives none. Reruns agree:
    the offset comes from ``seed`` and the source.
    """
    plain = frame.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words_of(F.col(text_column).cast("string")).alias("size"))
    sized = cut(plain)
    targets = cut(source_targets(sized, weights, share, most))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("documents") / F.greatest(F.lit(BLOCK_ROWS), F.floor(F.sqrt("documents")))))
    # Rows of equal id and size can change places, so they stand as one with their number.
    alike = sized.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("rows"))
    placed = alike.join(targets, alike.source.eqNullSafe(targets.source)).select(
        "id", alike.source, "size", "source_size", "target", "rows",
        F.pmod(unit_hash(F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string")), blocks).alias("block"),
    )
    up = F.when(F.col("block") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    within = Window.partitionBy("source", "block").orderBy(up, F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("rank", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    # Documents in the blocks before; these are few rows for a source.
    sums = placed.groupBy("source", "block").agg(F.sum("rows").alias("count"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(F.col("source").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    joined = ranked.join(first, ranked.source.eqNullSafe(first["of"]) & (ranked.block == first["at"]))
    # A row for each document again; many alike are first dealt to many tasks in stretches.
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(STRETCH).cast("long")))
    dealt = joined.select("*", stretch.alias("begin")).repartition("source", "block", "begin")
    every = dealt.select("*", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + STRETCH, F.col("rows")) - 1)).alias("own"))
    offset = unit_hash(F.lit(f"offset {seed}"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))) / F.lit(float(2**32))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("before") + F.col("rank") + F.col("own")
    copies = F.floor((place + 1) * ratio + offset) - F.floor(place * ratio + offset)
    return every.select(F.col("id").alias(id_column), "size", "source_size", "target", (copies * F.col("size")).alias("taken"))
