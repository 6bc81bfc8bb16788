"""Quality classifier: a factorisation machine.

Features are hashed words, statistics of a text's structure and its recorded
length. The score of a text with features x is the logistic of

    b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)

whose last term is the sum of <v_i, v_j> x_i x_j over all pairs, in linear time. It
is learned on the driver from features of a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
import string
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructType

from .common import crc_mod, drawn, kept, rows_with_text, text_bytes

#: Buckets of hashed words, of which the first hold the statistics; factors of the interactions.
BUCKETS, FACTORS = 1 << 18, 6
#: Labelled rows of each quality that are learned from, whatever their length: all if there are fewer, at most four times as many.
TRAIN_ROWS = 3000
#: Features of each quality's rows that come to the driver, about; where rows are very long fewer of them are drawn.
TRAIN_FEATURES = 4_000_000
#: Passes over the sample and steps, both at least; texts of a step, rate, and decay of the weights.
PASSES, STEPS, STEP, RATE, DECAY = 12, 800, 64, 0.08, 1e-5
#: Scores from here on are predicted good.
THRESHOLD = 0.3

UPPER, LOWER, DIGITS = (s.encode() for s in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
STOPS, COMMAS = b".", b","
MARKS = bytes(b for b in range(33, 127) if chr(b) not in string.ascii_letters + string.digits + ".,")
TO_LOWER = bytes.maketrans(UPPER, LOWER)

STATISTICS = (
    "bytes", "words", "word_length", "longest_word", "upper", "digits", "marks", "stops", "commas", "beyond_ascii",
    "different_words", "commonest_word", "once", "entropy", "lines", "repeated_lines", "line_words", "recorded", "unrecorded",
)


def statistics(text: bytes, seen: Counter[bytes], recorded: float | None) -> list[float]:
    """Structure of a text, each value of about the size of one; all defined for an empty text."""
    counts = np.fromiter(seen.values(), np.float64, len(seen))
    total = int(counts.sum())
    size, n, different = max(1, len(text)), max(1, total), len(seen)
    lines = text.split(b"\n")
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda chars: int(bytes_[np.frombuffer(chars, np.uint8)].sum()) / size
    letters = max(1e-9, share(UPPER + LOWER))
    entropy = float(-(counts / n) @ np.log(counts / n))
    return [
        math.log1p(len(text)) / 8,
        math.log1p(total) / 6,
        len(text) / n / 8,
        math.log1p(max(map(len, seen), default=0)) / 4,
        2 * share(UPPER) / letters if letters > 1e-9 else 0.0,
        10 * share(DIGITS),
        10 * share(MARKS),
        20 * share(STOPS),
        20 * share(COMMAS),
        3 * (1 - share(bytes(range(128)))) if text else 0.0,
        different / n,
        2 * max(seen.values(), default=0) / n,
        int((counts == 1).sum()) / n,
        entropy / 6,
        math.log1p(len(lines)) / 4,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)) / 5,
        math.log1p(max(0.0, recorded)) / 8 if recorded is not None else 0.0,
        float(recorded is None),
    ]


def features(text: bytes | None, recorded: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: the statistics, then words in lower case by damped count, of length a half together."""
    text = text or b""
    seen = Counter(text.translate(TO_LOWER).split())
    values = statistics(text, seen, recorded)
    first = len(values)
    room = BUCKETS - first
    at = np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)) % room + first
    x = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
    if len(at):
        at, where = np.unique(at, return_inverse=True)
        x = np.bincount(where, x)
        x /= 2 * math.sqrt(float(x @ x))
    return np.r_[np.arange(first), at].astype(np.int32), np.r_[np.clip(values, -8, 8), x].astype(np.float32)


class Machine:
    """A factorisation machine: bias, weights [bucket], factors [bucket, factor]."""

    def __init__(self, buckets: int = BUCKETS, factors: int = FACTORS, seed: int = 42) -> None:
        self.bias = 0.0
        self.weights = np.zeros(buckets, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (buckets, factors)).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Before the logistic: values for texts whose features begin at ``starts``; also the factors' shares and sums."""
        part = self.factors[at] * x[:, None]
        sums = np.add.reduceat(part, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((part**2).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + pairs, part, sums

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        sizes = [len(at) for at, _ in rows]
        raw, _, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.r_[0, np.cumsum(sizes)[:-1]])
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -40, 40)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 42) -> Machine:
        """Logistic loss by stochastic gradients whose steps shrink with the gradients seen (AdaGrad)."""
        if not rows:
            self.factors[:] = 0  # so that every score is 0.5
            return self
        shuffle = np.random.default_rng(seed)
        of_weights, of_factors, of_bias = np.full_like(self.weights, 1e-3), np.full_like(self.factors, 1e-3), 1e-3
        for _ in range(max(PASSES, -(-STEPS * STEP // len(rows)))):
            order = shuffle.permutation(len(rows))
            for k in range(0, len(order), STEP):
                some = order[k : k + STEP]
                at, x = (np.concatenate([rows[i][j] for i in some]) for j in (0, 1))
                sizes = np.array([len(rows[i][0]) for i in some])
                raw, part, sums = self.raw(at, x, np.r_[0, np.cumsum(sizes)[:-1]])
                slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[some]) * weights[some] / len(some)
                own = np.repeat(slope, sizes).astype(np.float32)
                used, where = np.unique(at, return_inverse=True)
                gradient = np.bincount(where, own * x, len(used)).astype(np.float32) + DECAY * self.weights[used]
                each = (own * x)[:, None] * (np.repeat(sums, sizes, axis=0) - part)
                of_pairs = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(each.shape[1])], 1).astype(np.float32) + DECAY * self.factors[used]
                of_weights[used] += gradient**2
                of_factors[used] += of_pairs**2
                of_bias += float(slope.sum()) ** 2
                self.weights[used] -= RATE * gradient / np.sqrt(of_weights[used])
                self.factors[used] -= 0.5 * RATE * of_pairs / np.sqrt(of_factors[used])
                self.bias -= RATE * float(slope.sum()) / math.sqrt(of_bias)
        return self


def held_out(id_column: str, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether a row isn't to be learned from; a null id counts as an empty text."""
    return F.coalesce(crc_mod(id_column, modulus), F.lit(0)) == remainder


def recorded_length(frame: DataFrame, length_column: str | None) -> Column:
    return F.col(length_column).cast("double") if length_column in frame.columns else F.lit(None).cast("double")


def learn(frame: DataFrame, labels: DataFrame, id_column: str, text_column: str, length_column: str | None, label_id: str, label: str, rows: int = TRAIN_ROWS) -> Machine:
    """The machine learned from labelled rows that aren't held out, about ``rows`` of each label."""
    usable = labels.where(~held_out(label_id) & F.col(label).isin(0, 1)).select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    few, sizes = drawn(usable, "__label", ("__id",), rows)
    # At most four times ``rows`` of each label.
    texts = frame.select(text_bytes(text_column).alias("__text"), recorded_length(frame, length_column).alias("__recorded"), id_column)
    joined = texts.join(F.broadcast(few), texts[id_column] == F.col("__id")).select("__id", "__text", "__recorded", "__label")
    # An id may have any number of rows, so the rows are drawn once more.
    features_of = F.least(F.lit(BUCKETS), F.coalesce(F.octet_length("__text"), F.lit(0)) / 2 + len(STATISTICS))
    sample, _ = drawn(joined, "__label", ("__id", "__text"), rows, features_of, TRAIN_FEATURES)
    joined = sample.select("__text", "__recorded", "__label")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, r) for t, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32())), batch.column(2)], ["at", "x", "label"])

    schema = StructType().add("at", ArrayType(IntegerType())).add("x", ArrayType(FloatType())).add("label", IntegerType())
    found = joined.mapInArrow(made, schema).toArrow()
    at, x = ([v.values.to_numpy() for v in found.column(c)] for c in ("at", "x"))
    # In an order that doesn't depend on where the rows came from.
    order = sorted(range(len(at)), key=lambda k: (len(at[k]), at[k].tobytes(), x[k].tobytes()))
    known = np.array(found.column("label").to_pylist(), float)[order] if order else np.empty(0)
    # Each label weighs as much as it does among all rows.
    kept = {v: max(1, int((known == v).sum())) for v in sizes}
    total = sum(sizes.values())
    weight = np.array([sizes[int(v)] / total * len(order) / kept[int(v)] for v in known])
    return Machine().learn([(at[k], x[k]) for k in order], known, weight)


def score(frame: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars", label_id: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """The quality of every whole text.

    Learns from labels (0 or 1; others and null are left aside) of rows that aren't held
    out (crc32 of the id as text, modulo 5, is 0; a null id counts as an empty
    text): about ``TRAIN_ROWS`` of each, drawn whatever their length and row by row where rows
    or ids repeat, fewer where they have more than ``TRAIN_FEATURES``. Ids, languages, sources and labels are
    no inputs of a score. Returns ``id_column``, the columns ``keep``, ``held_out``, ``score`` (0 to 1,
    higher: 1 likelier) and ``predicted`` (1 from ``threshold`` on). Null texts score as
    empty ones; where the recorded length is missing it is marked so; null and
    repeated ids keep their rows; other columns are left aside; an empty table gives
    none. With no label learned from, every score is 0.5.
    """
    machine = frame.sparkSession.sparkContext.broadcast(learn(frame, labels, id_column, text_column, length_column, label_id, label))
    name = f"machine {uuid.uuid4().hex}"

    rows, text = rows_with_text(frame, id_column, text_column, keep, held_out=held_out(id_column), __recorded=recorded_length(frame, length_column))
    out = [c for c in rows.columns if c not in ("__text", "__recorded")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(name, lambda: machine.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = part.column(text).cast(pa.binary())
                rows = [features(t.as_py(), r) for t, r in zip(texts, part.column("__recorded").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(known.scores(rows), pa.float64())], [*out, "score"])

    schema = StructType([rows.schema[c] for c in out]).add("score", DoubleType())
    return rows.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
