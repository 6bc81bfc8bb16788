"""Phrases whose words stand together oftener than by chance, found by hierarchical pair naming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import filesystem, shared_path
from .common import for_each_block, keep_nothing, kept, load, save, stored

#: Bytes that end a piece, which no phrase crosses, and bytes between words.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
#: 0 in a word, 1 between words, 2 at the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(BREAKS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text, and rows to be counted, that a process takes at once.
SLICE, COUNTED = 1 << 22, 1 << 20
#: Bits of the filter of pairs: for each pair, at most altogether, and in one of its segments.
BITS_EACH, BITS, SEGMENT = 16, 1 << 30, 1 << 20
#: How many choices of words' names are tried until all differ.
SEEDS = 8


def multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def pair_mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mixed(right.view(np.uint64)))


class Words:
    """The words of some texts: ``data`` without what is between them, ``starts`` in it, ``row`` of each, ``ids``, and whether the next word is of the same piece (``joined``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int):
        kind, inside = KIND[data], KIND[data] == 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[begins] = inside[begins]
        at = np.flatnonzero(start)
        self.row = np.searchsorted(offsets, at, "right") - 1
        piece = np.cumsum(kind == 2)[at]
        self.joined = np.zeros(len(at), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        self.data = LOWER[data[inside]]
        self.starts = (np.cumsum(inside) - 1)[at]
        sizes = np.diff(np.r_[self.starts, len(self.data)])
        place = np.arange(len(self.data)) - np.repeat(self.starts, sizes)
        values = (self.data.astype(np.uint64) + np.uint64(1)) * multipliers(seed, int(sizes.max(initial=0)))[place]
        sums = np.add.reduceat(values, self.starts) if len(at) else np.zeros(0, np.uint64)
        self.ids = mixed(sums + langs[self.row]).view(np.int64)

    def strings(self) -> pa.Array:
        offsets = np.r_[self.starts, len(self.data)].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])


def words_of(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, pa.Array]]:
    """The words of texts, a few megabytes at a time, and the languages of the rows."""
    for batch in batches:
        langs, texts = batch.column("lang"), batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        names = [np.frombuffer(x.as_py().encode(), np.uint8) for x in langs.unique()]
        code = langs.dictionary_encode().indices.to_numpy()
        salts = mixed(np.array([((x.astype(np.uint64) + np.uint64(1)) * multipliers(seed + SEEDS, len(x))).sum(dtype=np.uint64) for x in names], np.uint64))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
            size = int(offsets[high] - offsets[low])
            if size:
                yield Words(np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[low])), offsets[low : high + 1] - offsets[low], salts[code[low:high]], seed), langs.slice(low, high - low)
            low = high


def summed(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The tables' rows with equal keys together, as far as a bounded number of rows allows; ``n`` is their sum."""
    held: pa.Table | None = None
    for table in tables:
        if not table.num_rows:
            continue
        held = pa.concat_tables([held, table]) if held else table
        if held.num_rows > COUNTED:
            held = held.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
            if held.num_rows > COUNTED // 2:
                yield from held.to_batches(10_000)
                held = None
    if held:
        yield from held.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).to_batches(10_000)


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for words, langs in words_of(batches, seed):
            yield pa.table({"lang": langs.take(pa.array(words.row)), "word": words.strings(), "id": pa.array(words.ids), "n": pa.array(np.ones(len(words.ids), np.int64))})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        return summed(tables(batches), ["lang", "word", "id"])

    rows = docs.mapInArrow(made, "lang string, word binary, id long, n long")
    return rows.groupBy("lang", "word", "id").agg(F.sum("n").alias("a"))


def counted_windows(docs: DataFrame, seed: int, size: int, filter_of: Callable[[], np.ndarray] | None = None) -> DataFrame:
    """``c0`` to ``c{size-1}``, the names of words in a row, and ``n``, how often; null beyond the end of a piece.

    Without a filter every word of a piece but the last begins a window. With one, only those do whose
    first two pairs pass it, and a window ends before a pair that doesn't. Windows are counted before anything is
    shuffled, so that a frequent phrase has few rows.
    """
    names = [f"c{k}" for k in range(size)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for words, _ in words_of(batches, seed):
            follows = words.joined.copy()
            if filter_of:
                bits = kept(filter_name, filter_of)
                at = np.flatnonzero(follows)
                place = (pair_mix(words.ids[at], words.ids[at + 1]) & np.uint64(8 * len(bits) - 1)).view(np.int64)
                follows[at] = (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            begins = np.flatnonzero(follows[:-1] & follows[1:] if filter_of else follows)
            columns, there = {"c0": pa.array(words.ids[begins])}, np.ones(len(begins), bool)
            for k in range(1, size):
                last = np.minimum(begins + k - 1, len(follows) - 1)
                there &= follows[last]
                columns[f"c{k}"] = pa.array(words.ids[np.minimum(begins + k, len(follows) - 1)], mask=~there)
            yield pa.table(columns | {"n": pa.array(np.ones(len(begins), np.int64))})

    filter_name = f"pairs {id(filter_of)} {seed}"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        return summed(tables(batches), names)

    rows = docs.mapInArrow(made, ", ".join(f"{c} long" for c in [*names, "n"]))
    return rows.groupBy(*names).agg(F.sum("n").alias("n"))


def pair_filter(pairs: DataFrame) -> Callable[[], np.ndarray]:
    """Writes a filter that all pairs pass, and few others while it has ``BITS_EACH`` bits for each of them; gives what loads it.

    Its size is at most ``BITS``, however many pairs there are. Beyond that it lets more windows through, which
    the joins with the pairs themselves then leave out.
    """
    size = SEGMENT
    while size < min(BITS, BITS_EACH * pairs.count()):
        size *= 2
    folder, segments = shared_path(pairs.sparkSession, "pair-filter"), size // SEGMENT
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (pair_mix(*(batch.column(c).to_numpy() for c in ("left", "right"))) & np.uint64(size - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array(at % SEGMENT)], ["segment", "bit"])

    def segment(block: int, table: pa.Table) -> None:
        numbers, at = table.column("segment").to_numpy(), table.column("bit").to_numpy()
        own, line = np.unique(numbers, return_inverse=True)
        bits = np.zeros((len(own), SEGMENT // 8), np.uint8)
        np.bitwise_or.at(bits, (line, at >> 3), np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        save(f"{folder}/{block}", segments=own, bits=bits)

    for_each_block(pairs.select("left", "right").mapInArrow(place, "segment long, bit long").distinct(), ("segment",), segments, segment)

    def loaded() -> np.ndarray:
        bits = np.zeros((segments, SEGMENT // 8), np.uint8)
        for block in range(segments):
            if found := load(f"{folder}/{block}"):
                bits[found["segments"]] = found["bits"]
        return bits.reshape(-1)

    return loaded


def named_pairs(rows: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Pairs of neighbouring names that stand at least ``least`` times, with an id of their own.

    ``parts`` are the names one level below. ``left`` and ``right`` point to the phrase without its last and without
    its first word; along them each pair inherits ``heads`` and ``tails``, how often its first and its last 1, 2, ...
    words stand anywhere.
    """
    pairs = rows.where(F.col("c1").isNotNull()).groupBy(F.col("c0").alias("left"), F.col("c1").alias("right")).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    left = parts.select("lang", F.col("id").alias("left"), F.col("phrase").alias("__first"), F.col("heads").alias("__heads"))
    right = parts.select(F.col("id").alias("right"), "last", F.col("tails").alias("__tails"))
    return pairs.join(left, "left").join(right, "right").select(
        "lang", F.monotonically_increasing_id().alias("id"), "left", "right", "a", F.concat_ws(" ", "__first", "last").alias("phrase"), "last",
        F.concat("__heads", F.array("a")).alias("heads"), F.concat("__tails", F.array("a")).alias("tails"),
    )


def replaced(rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Rows of ``size`` names with each two neighbours replaced by the pair's id; rows that then have fewer than two names go."""
    for k in range(size - 1):
        names = pairs.select(F.col("left").alias(f"c{k}"), F.col("right").alias(f"c{k + 1}"), F.col("id").alias(f"p{k}"))
        rows = rows.join(names, [f"c{k}", f"c{k + 1}"], "left" if k > 1 else "inner")
    kept_names = [F.col(f"p{k}").alias(f"c{k}") for k in range(size - 1)]
    return rows.groupBy(*kept_names).agg(F.sum("n").alias("n"))


def weakest_cut(words: int) -> Column:
    """Of a phrase's cuts the one with the least score, and of those the first: ``score``, ``k``, ``l``, ``r``.

    Products are exact decimals of 38 digits, enough for counts up to 10 to the 16th.
    """
    exact = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, words):
        head, tail = F.col("heads")[k - 1], F.col("tails")[words - k - 1]
        score = F.call_function("div", exact(F.col("a")) * exact(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)"), exact(head) * exact(tail))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), head.alias("l"), tail.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, held: int = 50, best: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``most_words`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase that stands ``a`` times, at least ``least``, is as good as its weakest cut into two parts that stand ``l`` and
    ``r`` times: 1,000,000 a a / (l r), rounded down. A phrase goes if ``held`` hundredths of its places, or more, lie in
    one longer phrase. A phrase of k words is a pair of phrases of k - 1 words that overlap; pairs get ids, by which
    the next level's are named, and which point back to the two. As a longer phrase never stands oftener than one in
    it, a phrase's own pairs are all that need to be asked whether they hold it.

    A word's name is a hash of 64 bits of it and its language; all names are checked to differ, and other hashes are
    taken if they don't. Null texts and texts of blanks have no words. A null language is ``und``, as are rows whose language
    is that. Repeated rows count as often as they come. Other columns are not read. Of equal scores the more
    frequent phrase comes first, then the one whose UTF-8 bytes are less. Without rows the result is empty.
    """
    if most_words < 2 or least < 1:
        raise ValueError("phrases have two words or more, and stand once or more")
    texts = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    for seed in range(SEEDS):
        words = stored(counted_words(texts, seed), "words")
        if not words.groupBy("id").count().where("count > 1").head(1):
            break
    else:
        raise ValueError("different words always have one name")
    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    word = F.col("word").cast("string")
    parts = words.where(F.col("a") >= least).select("lang", "id", word.alias("phrase"), word.alias("last"), F.array("a").alias("heads"), F.array("a").alias("tails"))
    rows, levels = counted_windows(texts, seed, 2), []
    for k in range(2, most_words + 1):
        parts = stored(named_pairs(rows, parts, least), f"phrases-{k}")
        levels.append(parts)
        if k < most_words:
            rows = stored(counted_windows(texts, seed, most_words, pair_filter(parts)), "windows") if k == 2 else rows
            rows = replaced(rows, parts, most_words - k + 2)
            rows = stored(rows, f"windows-{k}") if k + 1 < most_words else rows
    kept_levels = []
    for k, level in enumerate(levels, 2):
        scored = level.withColumn("cut", weakest_cut(k))
        if k < most_words:
            longer = levels[k - 1]
            within = longer.select(F.col("left").alias("id"), F.col("a").alias("__a")).unionAll(longer.select(F.col("right").alias("id"), F.col("a").alias("__a")))
            scored = scored.join(within.groupBy("id").agg(F.max("__a").alias("__a")), "id", "left").where(F.coalesce(100 * F.col("__a") < held * F.col("a"), F.lit(True)))
        kept_levels.append(scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.unionAll, kept_levels).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
