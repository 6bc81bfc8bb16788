"""Language identification by unigrams summed over all segmentations.

Each language has probabilities of the pieces of one fixed public vocabulary. A
word's probability is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words. The probabilities come from
expectation maximisation over the same segmentations, on a bounded sample of
labelled texts. Words (runs of letters, lower case) are scored once in each
Python worker, many at a time, and remembered up to a bound.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .common import crc_mod, drawn, kept, rows_with_text, stored

#: A run of letters, and of the numbers that aren't digits; the latter are taken out afterwards.
RUN = re.compile(r"[^\W\d_]+")
#: Opens a word.
BEGIN = "▁"
#: Labelled rows of a language that are learned from, whatever their length: all if it has fewer, at most four times as many.
TRAIN_ROWS = 600
#: Different languages at most; more are an error.
MOST_LANGUAGES = 500
#: Rounds of expectation maximisation, and the weight of the pooled probabilities in each language's.
ROUNDS, POOLED = 3, 200.0
#: Words that a worker remembers; longer words are scored alone, in logarithms, and learned from in stretches of so many letters.
REMEMBERED, LONGEST = 250_000, 40
#: Expected uses are summed as whole numbers of this part of one, so that their order makes no difference.
QUANTUM = 1 << 20
#: Words scored at a time.
TOGETHER = 8_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters of a sentencepiece model in lower case, numbered from 1; 0 is any other character."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    pieces = sorted({p.piece.lower() for p in model.pieces if p.type == proto.ModelProto.SentencePiece.NORMAL and all(c.isalpha() or c == BEGIN for c in p.piece)})
    return {piece: k for k, piece in enumerate(pieces, 1)}


def letters(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return [run if run.isalpha() else "".join(c for c in run if c.isalpha()) for run in RUN.findall(text.lower())]


def stretches(word: str) -> list[str]:
    """A word with its opening mark, a long one in stretches of ``LONGEST`` letters; the mark opens the first."""
    return [BEGIN + word[:LONGEST], *(word[k : k + LONGEST] for k in range(LONGEST, len(word), LONGEST))]


class Pieces:
    """Numbered pieces as a tree of characters, which many texts are walked down at a time."""

    def __init__(self, numbers: dict[str, int]) -> None:
        chars = sorted({c for piece in numbers for c in piece})
        self.numbers, self.longest, self.width = numbers, max(map(len, numbers)), len(chars) + 1
        #: Of each code point the number of a character of the pieces, or 0.
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        code, steps, number = {c: k for k, c in enumerate(chars, 1)}, {}, [0]
        for piece, n in numbers.items():
            node = 0
            for c in piece:
                node = steps.setdefault(node * self.width + code[c], len(number))
                if node == len(number):
                    number.append(0)
            number[node] = n
        self.keys = np.array(sorted(steps), np.int64)
        self.nexts = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.number = np.array(number, np.int64)

    def walk(self, node: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each node has a branch of the character, and where it leads."""
        key = node * self.width + char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, self.nexts[at]


@lru_cache(maxsize=2)
def tree(path: str) -> Pieces:
    """The vocabulary of a model."""
    return Pieces(vocabulary(path))


class Lattice:
    """The pieces that stand in some words: of each, the word's index, start, end and number. Words that aren't ``marked`` get their opening mark."""

    def __init__(self, words: list[str], pieces: Pieces, marked: bool = False) -> None:
        words = words if marked else [BEGIN + w for w in words]
        self.sizes = np.array([len(w) for w in words], np.int64)
        char = pieces.code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(self.sizes) - self.sizes
        row = np.repeat(np.arange(len(words)), self.sizes)
        start = np.arange(len(char)) - first[row]
        # From every place all pieces that begin there; any single character is a piece.
        left, at, node = self.sizes[row] - start, np.arange(len(char)), np.zeros(len(char), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for length in range(1, pieces.longest + 1):
            here = left[at] >= length
            at, node = at[here], node[here]
            goes, node = pieces.walk(node, char[at + length - 1])
            if length == 1:
                found.append((row[at], start[at], start[at] + 1, np.where(goes, pieces.number[node], 0)))
            at, node = at[goes], node[goes]
            if length > 1:
                number = pieces.number[node]
                whole = number > 0
                found.append((row[at[whole]], start[at[whole]], start[at[whole]] + length, number[whole]))
            if not len(at):
                break
        self.row, self.start, self.end, self.number = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(self.end, kind="stable")
        self.row, self.start, self.end, self.number = (x[order] for x in (self.row, self.start, self.end, self.number))
        self.upto = np.searchsorted(self.end, np.arange(int(self.sizes.max(initial=0)) + 2))

    def forward(self, chance: np.ndarray) -> np.ndarray:
        """Chance of each beginning of each word in each language; chance is [piece, language]."""
        n, top, languages = len(self.sizes), len(self.upto) - 2, chance.shape[1]
        out = np.zeros((n, top + 1, languages))
        out[:, 0] = 1
        for e in range(1, top + 1):
            own = slice(self.upto[e], self.upto[e + 1])
            row, part = self.row[own], out[self.row[own], self.start[own]] * chance[self.number[own]]
            for k in range(languages):
                out[:, e, k] = np.bincount(row, part[:, k], n)
        return out

    def whole(self, forward: np.ndarray) -> np.ndarray:
        return forward[np.arange(len(self.sizes)), self.sizes]

    def expected(self, chance: np.ndarray, counts: np.ndarray, quantum: int = 0) -> np.ndarray:
        """How often each piece is expected in each language, over words seen ``counts`` [word, language] times; with a ``quantum`` each use is rounded to a whole number of its parts."""
        n, top, languages = len(self.sizes), len(self.upto) - 2, chance.shape[1]
        before = self.forward(chance)
        after = np.zeros_like(before)
        after[np.arange(n), self.sizes] = 1
        scale = counts / np.maximum(self.whole(before), 1e-300)
        uses = np.zeros((len(self.row), languages))
        for e in range(top, 0, -1):
            own = slice(self.upto[e], self.upto[e + 1])
            row, start = self.row[own], self.start[own]
            part = after[row, e] * chance[self.number[own]]
            uses[own] = before[row, start] * part * scale[row]
            after[row, start] += part  # of one end, no two pieces have the same word and start
        if quantum:
            uses = np.rint(uses * quantum)
        return np.stack([np.bincount(self.number, uses[:, k], len(chance)) for k in range(languages)], axis=1) if languages else np.zeros_like(chance)


class Model:
    """Languages and the chances of the pieces in each."""

    def __init__(self, languages: list[str], chance: np.ndarray, path: str) -> None:
        self.languages, self.chance, self.path = languages, chance, path

    @staticmethod
    def learn(counts: dict[str, dict[str, int]], path: str) -> Model:
        """From how often each language has each word."""
        stretched: dict[str, Counter[str]] = {name: Counter() for name in counts}
        for name, own in counts.items():
            for word, n in own.items():
                for part in stretches(word):
                    stretched[name][part] += n
        rows = [(name, list(own), list(own.values())) for name, own in sorted(stretched.items())]

        def uses(model: Model) -> Iterator[tuple[int, str, int]]:
            for name, parts, n in rows:
                found = model.uses(name, parts, np.array(n, float))
                yield from ((k, name, int(found[k])) for k in np.flatnonzero(found).tolist())

        return Model.rounds(sorted(counts), path, uses)

    @staticmethod
    def rounds(languages: list[str], path: str, uses: Callable[[Model], Iterable[tuple[int, str, int]]]) -> Model:
        """Expectation maximisation; ``uses`` gives what a model expects: piece, language and how often, in parts of ``QUANTUM``."""
        pieces = len(tree(path).numbers) + 1
        model, place = Model(languages, np.full((pieces, len(languages)), 1 / pieces), path), {name: k for k, name in enumerate(languages)}
        for _ in range(ROUNDS):
            use = np.zeros_like(model.chance)
            for piece, name, n in uses(model):
                use[piece, place[name]] += n / QUANTUM
            pooled = (use.sum(axis=1) + 0.01) / (use.sum() + 0.01 * len(use))
            model = Model(languages, (use + POOLED * pooled[:, None]) / (use.sum(axis=0) + POOLED), path)
        return model

    def uses(self, language: str, parts: list[str], n: np.ndarray) -> np.ndarray:
        """How often each piece is expected in stretches of words that a language has ``n`` times, in parts of ``QUANTUM``."""
        pieces, k = tree(self.path), self.languages.index(language)
        out = np.zeros(len(self.chance), np.int64)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        for low in range(0, len(order), TOGETHER):
            some = order[low : low + TOGETHER]
            block = Lattice([parts[i] for i in some], pieces, marked=True)
            out += block.expected(self.chance[:, k : k + 1], n[some, None], QUANTUM)[:, 0].astype(np.int64)
        return out


class Scorer(dict):
    """Numbers of words whose logarithmic chances are rows of ``table``; row 0 is for what has no letters."""

    def __init__(self, model: Model) -> None:
        super().__init__({"": 0})
        self.model = model
        self.pieces = tree(model.path)
        self.table = np.zeros((1024, len(model.languages)))
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        number = len(self)
        self[word] = number
        self.waiting.append(word)
        return number

    def alone(self, word: str) -> np.ndarray:
        """The forward algorithm in logarithms, for a word of any length."""
        marked, chance = BEGIN + word, np.log(self.model.chance)
        done = np.zeros((len(marked) + 1, chance.shape[1]))
        for e in range(1, len(marked) + 1):
            ways = [done[s] + chance[p or 0] for s in range(max(0, e - self.pieces.longest), e) if (p := self.pieces.numbers.get(marked[s:e])) is not None or s == e - 1]
            done[e] = np.logaddexp.reduce(ways, axis=0)
        return done[-1]

    def settle(self) -> None:
        """Scores the words that wait."""
        if len(self) > len(self.table):
            grown = np.zeros((2 * len(self), self.table.shape[1]))
            grown[: len(self.table)] = self.table
            self.table = grown
        first = len(self) - len(self.waiting)
        order = sorted(range(len(self.waiting)), key=lambda k: len(self.waiting[k]))
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            short = [i for i in some if len(self.waiting[i]) <= LONGEST]
            if short:
                block = Lattice([self.waiting[i] for i in short], self.pieces)
                self.table[np.array(short) + first] = np.log(np.maximum(block.whole(block.forward(self.model.chance)), 1e-300))
            for i in some[len(short) :]:
                self.table[first + i] = self.alone(self.waiting[i])
        self.waiting = []

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its logarithmic chance in each language, and whether it has a letter."""
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = 0
        numbers = [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in (letters(t) if t else [] for t in texts)]
        self.settle()
        found = [(self.table[n].sum(axis=0), bool(n.any())) for n in numbers]
        return np.array([x for x, _ in found]).reshape(len(texts), self.table.shape[1]), np.array([x for _, x in found], bool)

    def best(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its share of all languages' chances."""
        totals, lettered = self.totals(texts)
        if not self.model.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        top = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.languages[k] if ok else "und" for k, ok in zip(top.tolist(), lettered.tolist(), strict=True)], np.where(lettered, share, 0.0).tolist()


def held_out(id_column: str, modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row isn't to be learned from; a null id counts as an empty text."""
    return F.coalesce(crc_mod(id_column, modulus), F.lit(0)) == remainder


def learn(frame: DataFrame, path: str, id_column: str, text_column: str, lang_column: str, learned_rows: Column, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows for which ``learned_rows`` holds."""
    labelled = frame.where(learned_rows).select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, part) for word in letters(text or "") if word for part in stretches(word))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "part", "n"])

    sample, _ = drawn(labelled, "lang", ("id", "text"), rows, keys=MOST_LANGUAGES)
    summed = sample.select("lang", "text").mapInArrow(counted, "lang string, part string, n long").groupBy("lang", "part").agg(F.sum("n").alias("n"))
    words = stored(summed.repartition(frame.sparkSession.sparkContext.defaultParallelism), "learned-words")
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())  # at most MOST_LANGUAGES

    def uses(model: Model) -> Iterator[tuple[int, str, int]]:
        """Summed on executors; a row for each piece that a language uses."""

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs, parts = (np.array(batch.column(c).to_pylist(), object) for c in ("lang", "part"))
                n = batch.column("n").to_numpy().astype(float)
                for name in sorted(set(langs)):
                    own = np.flatnonzero(langs == name)
                    found = model.uses(name, parts[own].tolist(), n[own])
                    at = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([name] * len(at), pa.string()), pa.array(found[at])], ["piece", "lang", "n"])

        return iter(words.mapInArrow(made, "piece long, lang string, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect())

    return Model.rounds(languages, path, uses)


def identify(frame: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text.

    Learns from the text and non-null language of rows that aren't held out (crc32 of
    the id as text, modulo 4, is 2; a null id isn't held out): about
    ``TRAIN_ROWS`` of each language, drawn whatever their length and row by row where rows repeat. Returns ``id_column``, the columns ``keep``, ``held_out``,
    ``lang_pred`` (a learned language; ``und`` if the text is null or has no letter, or
    if nothing could be learned) and ``score`` (the language's share of the
    chances, 0 for ``und``; ties go to the first language in order). Null and repeated
    ids keep their rows; other columns are left aside; an empty table gives none. Words of any length count, also those of
    languages written without blanks: long ones are learned from in stretches and scored whole. No word is left out, however rare.
    """
    spark = frame.sparkSession
    model = spark.sparkContext.broadcast(learn(frame, path, id_column, text_column, lang_column, ~held_out(id_column)))

    name = f"scorer {uuid.uuid4().hex}"

    rows, text = rows_with_text(frame, id_column, text_column, keep, held_out=held_out(id_column))
    out = [c for c in rows.columns if c != "__text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(name, lambda: Scorer(model.value))
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                names, shares = scorer.best(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(names, pa.string()), pa.array(shares, pa.float64())], [*out, "lang_pred", "score"])

    schema = StructType([rows.schema[c] for c in out]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(scored, schema)
