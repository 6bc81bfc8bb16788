"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a bounded number of words of whole texts within one partition. Words
that no benchmark item has can't lie in an occurrence, so the index holds
the stretches of other words that are long enough for one. All windows of the
benchmark are searched backwards, occurrences are located from sampled suffix
positions, and what they cover is merged into removal spans. No text leaves its
partition; the benchmark's windows lie in the shared folder in blocks of bounded size, of which
a process holds one at a time.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..sources.shared import filesystem, shared_path
from .common import for_each_block, keep_nothing, load, packed, rows_with_text, save, text_bytes
from .fm_index import FMIndex

#: A-Z to lower case; what is neither 0-9, a-z nor beyond ASCII to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in string.digits + string.ascii_lowercase else 32 for b in range(256))
#: Words of a shard, about.
SHARD_WORDS = 1_000_000
#: Bytes of a text that are cut into words at a time.
PIECE_BYTES = 4_000_000
#: Bytes of the benchmark texts that are searched at a time, about; an item is searched whole.
BLOCK_BYTES = 4_000_000


class Phrases:
    """Windows of a block of items: ``width`` words each, or an item's all if it has fewer.

    ``symbol`` numbers the words from 1. A window is a row of ``matrix``, at its end; those of window k are the items ``owners[first[k] : first[k + 1]]``.
    """

    def __init__(self, width: int, words: list[bytes], matrix: np.ndarray, lengths: np.ndarray, first: np.ndarray, owners: np.ndarray, names: pa.Array) -> None:
        self.width, self.symbol, self.matrix, self.lengths, self.first, self.owners, self.names = width, {w: k for k, w in enumerate(words, 1)}, matrix, lengths, first, owners, names
        self.shortest = int(lengths.min(initial=width))

    @staticmethod
    def arrays(names: pa.Array, texts: pa.Array, width: int) -> dict[str, np.ndarray]:
        """What is kept of a block: windows, each once, with their items."""
        symbol: dict[bytes, int] = {}
        parts, sizes, owner = [np.zeros((0, width), np.int32)], [np.empty(0, np.int8)], [np.empty(0, np.int32)]
        for k, text in enumerate(texts):
            runs = [np.fromiter((symbol.setdefault(w, len(symbol) + 1) for w in words), np.int32, len(words)) for _, _, words in pieces(text.as_py() or b"", 0)]
            words = np.concatenate([np.empty(0, np.int32), *runs])
            if len(words):
                windows = np.lib.stride_tricks.sliding_window_view(words, width) if len(words) >= width else np.r_[np.zeros(width - len(words), np.int32), words][None]
                parts.append(windows)
                sizes.append(np.full(len(windows), min(len(words), width), np.int8 if width < 128 else np.int64))
                owner.append(np.full(len(windows), k, np.int32))
        matrix, lengths, owners = np.concatenate(parts), np.concatenate(sizes), np.concatenate(owner)
        order = np.lexsort((owners, *matrix.T))  # a shorter window has zeros in front, which no other has
        matrix, lengths, owners = matrix[order], lengths[order], owners[order]
        new = np.r_[True, (matrix[1:] != matrix[:-1]).any(axis=1)][: len(matrix)]
        twice = np.r_[False, ~new[1:] & (owners[1:] == owners[:-1])][: len(matrix)]
        first = np.flatnonzero(new[~twice])
        kept = owners[~twice]
        listed = pa.array(names, pa.string())
        return {
            "words": packed(list(symbol)), "matrix": matrix[new], "lengths": lengths[new].astype(np.int64), "first": np.r_[first, len(kept)], "owners": kept,
            "names": np.frombuffer("".join(n or "" for n in listed.to_pylist()).encode(), np.uint8),
            "ends": np.cumsum([0, *(len((n or "").encode()) for n in listed.to_pylist())]), "nulls": np.array([n is None for n in listed.to_pylist()], bool),
        }

    @staticmethod
    def of(found: dict[str, np.ndarray], width: int) -> Phrases:
        words = found["words"].tobytes().split(b" ") if len(found["words"]) else []
        names = pa.array([None if none else found["names"][a:b].tobytes().decode() for a, b, none in zip(found["ends"][:-1].tolist(), found["ends"][1:].tolist(), found["nulls"].tolist(), strict=True)], pa.string())
        return Phrases(width, words, found["matrix"], found["lengths"], found["first"], found["owners"], names)

    def items(self, window: int) -> list[str]:
        """The items that have a window, but those without a name."""
        return self.names.take(pa.array(self.owners[self.first[window] : self.first[window + 1]])).drop_null().to_pylist()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence in these words: where it begins, and which window it is."""
        symbols = np.fromiter(map(self.symbol.get, words, (0,) * len(words)), np.int64, len(words))
        known = np.r_[0, (symbols > 0).astype(np.int8), 0]
        starts, ends = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = ends - starts >= self.shortest
        starts, sizes = starts[long], (ends - starts)[long]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # The stretches, each with a separator after it, and where each symbol came from.
        begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        origin = np.arange(int((sizes + 1).sum())) + np.repeat(starts - begin, sizes + 1)
        text = symbols[np.minimum(origin, len(symbols) - 1)]
        text[begin + sizes] = 0
        index = FMIndex(text, len(self.symbol))
        low, high = index.search(self.matrix, self.lengths)
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        rows = np.arange(int(count.sum())) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
        return origin[index.locate(rows)], window


def pieces(text: bytes, overlap: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """A text's words in pieces: index of the first word, how many are new, words; each repeats the last ``overlap`` words."""
    folded, done, tail = text.translate(FOLD), 0, []
    for at, end in stops(folded):
        new = folded[at:end].split()
        words = tail + new
        yield done - len(tail), len(new), words
        done, tail = done + len(new), words[len(words) - overlap :] if overlap and len(words) > overlap else words if overlap else []


def stops(folded: bytes) -> Iterator[tuple[int, int]]:
    """Where pieces of a folded text begin and end, none within a word."""
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PIECE_BYTES else folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield at, end
        at = end


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Shard:
    """Texts whose words are searched together."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words: list[bytes] = []
        self.parts: list[tuple[int, int, int]] = []  # where a piece begins in words, whose it is, and its first word's index there

    def add(self, owner: int, first: int, words: list[bytes]) -> None:
        self.parts.append((len(self.words), owner, first))
        self.words += words
        self.words.append(b"")  # no word of the benchmark: nothing runs from one piece into the next

    def search(self, phrases: Phrases, spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]]) -> None:
        at, window = phrases.find(self.words)
        if not len(at):
            return
        begins, owner, first = (np.array(x, np.int64) for x in zip(*self.parts, strict=True))
        cover = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.lengths[window], -1)
        inside = np.r_[0, (np.cumsum(cover) > 0).astype(np.int8), 0]
        a, b = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        part = np.searchsorted(begins, a, "right") - 1
        for o, x, y in zip(owner[part].tolist(), (a - begins[part] + first[part]).tolist(), (b - begins[part] + first[part]).tolist(), strict=True):
            spans.setdefault(o, []).append((x, y))
        part = np.searchsorted(begins, at, "right") - 1
        for o, w in np.unique(np.stack([owner[part], window], 1), axis=0).tolist():
            items.setdefault(o, set()).update(phrases.items(w))


def phrase_blocks(benchmark: DataFrame, item_column: str, text_column: str, width: int) -> tuple[str, int]:
    """Writes the benchmark's windows as blocks into the shared folder, on executors; gives their folder and number.

    Items that repeat an id and a text count once; the others are dealt by a hash of both.
    """
    folder = shared_path(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), text_bytes(text_column).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)
    for_each_block(items, ("item", "text"), count, lambda number, table: save(f"{folder}/{number}", **Phrases.arrays(table.column("item").combine_chunks(), table.column("text").combine_chunks(), width)))
    return folder, count


def contamination(frame: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", width: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Where texts hold windows of benchmark items.

    Words are runs of 0-9, a-z (A-Z count as lower case) and characters beyond
    ASCII. A window is ``width`` consecutive words of an item; an item of fewer,
    but not none, is one window. Returns a row for each row: ``id_column``, ``n_words``,
    ``n_hit`` (words inside any occurrence), ``items`` (the different ids, as
    strings in order, of items with an occurring window) and ``spans`` (merged
    removal spans, from word to word, end exclusive), and the columns ``keep``. Null and empty texts have
    no words, null and repeated ids keep their rows; an item without an id marks
    words but isn't listed, items that repeat an id count once; other columns
    are left aside. Either table may be empty.
    """
    folder, count = phrase_blocks(benchmark, item_column, item_text_column, width)
    span = StructType().add("start", LongType()).add("end", LongType())
    plain, text_name = rows_with_text(frame, id_column, text_column, keep)
    out = [c for c in plain.columns if c != "__text"]
    schema = StructType([plain.schema[c] for c in out]).add("n_words", LongType()).add("n_hit", LongType()).add("items", ArrayType(StringType())).add("spans", ArrayType(span))

    def block(number: int) -> Phrases | None:
        """One block at a time is held in a process."""
        found = load(f"{folder}/{number}")
        return found and Phrases.of(found, width)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        only = block(0) if count == 1 else None
        for batch in batches:
            counts: list[int] = []
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            shard = Shard(width)

            def flush(shard: Shard, spans: dict = spans, items: dict = items) -> Shard:
                for number in range(count):
                    if shard.words and (phrases := only if count == 1 else block(number)):
                        shard.search(phrases, spans, items)
                return Shard(width)

            for owner, text in enumerate(batch.column(text_name).cast(pa.binary())):
                n = 0
                for first, new, words in pieces(text.as_py() or b"", width - 1):
                    n += new
                    shard.add(owner, first, words)
                    if len(shard.words) >= SHARD_WORDS:
                        shard = flush(shard)
                counts.append(n)
            flush(shard)
            every = [merged(spans.get(k, [])) for k in range(len(counts))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in out),
                    pa.array(counts, pa.int64()),
                    pa.array([sum(b - a for a, b in own) for own in every], pa.int64()),
                    pa.array([sorted(items.get(k, ())) for k in range(len(counts))], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in own] for own in every], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                [*out, "n_words", "n_hit", "items", "spans"],
            )

    return plain.mapInArrow(searched, schema)


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The findings with the items as their number and SHA-256, and whether any word is hit."""
    listed = F.array_join("items", ",")
    return found.select(id_column, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text less the words of its spans and what stands between them."""
    words = list(re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a].start()])
        at = words[b - 1].end()
    return "".join([*out, text[at:]])
