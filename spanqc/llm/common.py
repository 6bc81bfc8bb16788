"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import io
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..sources.shared import filesystem, shared_dir, shared_path, written


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows, held in the shared folder and without lineage."""
    shared_dir(frame.sparkSession)
    held = frame.checkpoint(eager=True)
    files = held._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if files.isDefined():
        written(files.get())
    return held


def text_bytes(column: str) -> Column:
    """A text column as its UTF-8 bytes, null staying null."""
    return F.col(column).cast("string").cast("binary")


def rows_with_text(frame: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...] = (), **more: Column) -> tuple[DataFrame, str]:
    """Id, columns to keep and more columns, with the text once; and the name it has there, ``__text`` unless it is kept."""
    if text_column in keep:
        return frame.select(id_column, *keep, *[c.alias(name) for name, c in more.items()]), text_column
    return frame.select(id_column, *keep, *[c.alias(name) for name, c in more.items()], F.col(text_column).cast("string").alias("__text")), "__text"


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame's rows, written to the shared folder and read again, so that the planner knows their size.

    A join with them broadcasts them if they are below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles else.
    """
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Halvings of a hash that a draw tells apart.
LEVELS = 53


def drawn(rows: DataFrame, key: str, by: tuple[str, ...], most: int, weight: Column | None = None, heaviest: float = 0.0, keys: int = 500) -> tuple[DataFrame, dict]:
    """At least ``most`` rows of each value of ``key``, or all, and at most four times as many; and each value's number of rows.

    Rows are drawn by a hash of the columns ``by``, whatever the order they come in: one pass counts each value's
    rows by how often their hash can be halved, the draw takes those of the least hashes. Where repeated
    rows, whose hashes are equal, would make it more than that, it takes ``most`` of them in order of hash.
    With a ``weight`` the draw also ends where the weights of a value's rows sum up to ``heaviest``, about. Null
    values aren't drawn; more than ``keys`` values are an error.
    """
    number = F.shiftrightunsigned(F.xxhash64(*by), 64 - LEVELS)
    level = (LEVELS - F.floor(F.log2(number.cast("double") + 1))).cast("int")
    known = rows.where(F.col(key).isNotNull())
    counted = known.groupBy(key, level.alias("__level")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.lit(0.0) if weight is None else weight.cast("double")).alias("__weight"))
    levels: dict[object, dict[int, tuple[int, float]]] = {}
    for value, at, n, heavy in counted.limit((LEVELS + 1) * keys + 1).collect():
        levels.setdefault(value, {})[at] = n, heavy
    if len(levels) > keys:
        raise ValueError(f"more than {keys} values of {key}")
    least, crowded = F.lit(LEVELS + 1), []
    for value, own in levels.items():
        n, heavy, at = 0, 0.0, LEVELS + 1
        for at in sorted(own, reverse=True):
            n, heavy = n + own[at][0], heavy + own[at][1]
            if n >= most or weight is not None and heavy >= heaviest:
                break
        least = F.when(F.col(key) == F.lit(value), F.lit(at)).otherwise(least)
        if n > 4 * most:
            crowded.append(value)
    found = known.where(level >= least)
    if crowded:
        found = without_repeats(found, key, number, crowded, most)
    return found, {value: sum(n for n, _ in own.values()) for value, own in levels.items()}


def without_repeats(found: DataFrame, key: str, number: Column, crowded: list, most: int) -> DataFrame:
    """Of each ``crowded`` value of ``key`` the first ``most`` rows in order of ``number``.

    Rows of equal numbers are counted before they meet, so the numbers are few however often one comes. Only of the
    number at which ``most`` is reached a part of the rows is taken, at most that many from each partition.
    """
    counted = found.where(F.col(key).isin(*crowded)).groupBy(key, number.alias("__number")).count()
    counts: dict[object, list[tuple[int, int]]] = {}
    for value, at, n in counted.limit(64 * most * len(crowded)).collect():
        counts.setdefault(value, []).append((at, n))
    kept_rows, parts = ~F.col(key).isin(*crowded), []
    for value, own in counts.items():
        left = most
        for at, n in sorted(own):
            if n > left:
                break
            left -= n
        kept_rows = kept_rows | (F.col(key) == F.lit(value)) & (number < at)
        parts.append(found.where((F.col(key) == F.lit(value)) & (number == at)).limit(left))
    out = found.where(kept_rows)
    for part in parts:
        out = out.unionAll(part)
    return out


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions in the block give Python processes at most so many rows at a time; so do those that other threads run on this session meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def save(path: str, **arrays: np.ndarray) -> None:
    """Arrays as one file, which has its name only once it is whole."""
    store, name = filesystem(path)
    data = io.BytesIO()
    np.savez(data, **arrays)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data.getbuffer())
    if store.get_file_info(name).is_file:  # another attempt at the task has written the same
        store.delete_file(part)
    else:
        store.move(part, name)


def load(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file; none if there is no such file."""
    store, name = filesystem(path)
    if not store.get_file_info(name).is_file:
        return None
    with store.open_input_stream(name, compression=None) as file:
        found = np.load(io.BytesIO(file.read()), allow_pickle=False)
        return {key: found[key] for key in found.files}


def packed(words: list[bytes]) -> np.ndarray:
    """Words, which hold no blanks, as one array."""
    return np.frombuffer(b" ".join(words), np.uint8)


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from zero on in the narrowest type."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64)


T = TypeVar("T")
#: The one thing that a Python worker keeps from task to task, by its name.
KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """The worker's thing of this name; what another operator left is given up before it is made."""
    if name not in KEPT:
        keep_nothing()
        KEPT[name] = make()
    return KEPT[name]


def keep_nothing() -> None:
    """Gives up what another operator left in this worker, and gives the system back what Arrow and the C library hold for later."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def for_each_block(rows: DataFrame, by: tuple[str, ...], blocks: int, make: Callable[[int, pa.Table], None]) -> None:
    """Deals rows into blocks by a hash of the columns ``by``, and calls ``make`` on executors with each block that has rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column("block").to_numpy()
            ends = np.r_[np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for low, high in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if low < high:
                    if held and held[0].column("block")[0].as_py() != block[low]:
                        make(held[0].column("block")[0].as_py(), pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(low, high - low))
        if held:
            make(held[0].column("block")[0].as_py(), pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["done"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(blocks))).repartition(blocks, "block").sortWithinPartitions("block")
    dealt.mapInArrow(made, StructType().add("done", LongType())).count()
