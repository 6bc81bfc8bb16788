"""Hard negatives: the best rows of other labels, by an exact nearest-neighbour join over Voronoi partitions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_nothing, stored

#: Pivots at least and at most, and anchors for each of them.
FEWEST, MOST, ANCHORS_EACH = 8, 128, 512
#: Anchors of a block, about, bytes of a chunk of candidates, and numbers by which chunks are dealt besides their cell.
BLOCK, CHUNK_BYTES, SALTS = 512, 1 << 20, 8
#: Products that a process works out at once.
AT_ONCE = 1 << 20
#: Integers below it are exact in floating point, sums of their products too.
EXACT = 1 << 53


def usable(vector: str) -> Column:
    """Whether there is a vector and all its components are finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))


def packed(rows: DataFrame, scale: int) -> DataFrame:
    """Vectors as bytes of whole numbers, ``floor(scale * x)`` of each component, with their squared lengths."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            whole = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(whole) and np.abs(whole).max() >= 1 << 31:
                raise OverflowError("a component is beyond 31 bits")
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            squares = np.r_[0.0, np.cumsum(whole * whole)]  # only a check of the size; see Space
            vectors = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(whole.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), vectors, pa.array(squares[ends[1:]] - squares[ends[:-1]])], ["id", "label", "vec", "square"])

    return rows.mapInArrow(made, "id long, label string, vec binary, square double")


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Packed vectors as rows; what is missing at the end of a shorter one is zero."""
    out = np.zeros((len(vectors), dims))
    for k, v in enumerate(vectors):
        own = np.frombuffer(v.as_buffer(), "<i4")
        out[k, : len(own)] = own
    return out


class Space(NamedTuple):
    """Vectors with one more component, so that the largest inner product is the least distance.

    Candidates get the component that makes all equally long, anchors get zero. Pivots are candidates.
    """

    dims: int
    longest: float
    pivots: np.ndarray

    def distances(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """From each vector to each pivot."""
        own, theirs = (vectors**2).sum(1)[:, None], (self.pivots**2).sum(1)[None]
        if anchors:
            squares = own + self.longest
        else:
            squares = 2 * (self.longest - np.sqrt(np.maximum(self.longest - own, 0) * np.maximum(self.longest - theirs, 0)))
        return np.sqrt(np.maximum(squares - 2 * vectors @ self.pivots.T, 0))

    def slack(self) -> float:
        return 1e-6 * (1 + self.longest**0.5)


def placed(anchors: DataFrame, space: Space) -> DataFrame:
    """Anchors with the cell of their nearest pivot, and how far it is."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = space.distances(matrix(batch.column("vec"), space.dims), anchors=True)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "away"])

    return anchors.select("id", "label", "vec", "square", "key").mapInArrow(made, "id long, label string, vec binary, square double, key long, cell int, away double")


def within_reach(rows: DataFrame, space: Space, cells: list[tuple], home: bool) -> DataFrame:
    """Chunks of candidates for each cell whose anchors they might serve: ``cell``, ``salt``, ``ids``, ``labels``, ``vecs``.

    ``cells``: cell, least and greatest distance of its anchors from the pivot, and the greatest and least
    distance from an anchor at which a candidate is wanted. By the triangle inequality a candidate outside of these bounds
    serves no anchor of the cell. With ``home`` candidates go to the cell of their own nearest pivot alone.
    """
    numbers = [int(c[0]) for c in cells]
    near, far, most, least = (np.array([c[k] for c in cells], np.float64)[None] for k in range(1, 5))
    step = max(1, CHUNK_BYTES // (4 * space.dims + 16))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                vectors = matrix(batch.column("vec"), space.dims)
                all_away = space.distances(vectors, anchors=False)
                away = all_away[:, numbers]
                if home:
                    wanted = away <= all_away.min(1)[:, None]
                else:
                    wanted = (np.maximum(away - far, near - away) <= most + space.slack()) & (away + far >= least - space.slack())
                for k in np.flatnonzero(wanted.any(0)).tolist():
                    own = pa.array(np.flatnonzero(wanted[:, k]))
                    part = batch.take(own)
                    ids, labels = (pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(c)) for c in ("id", "label"))
                    data = vectors[own.to_numpy()].astype("<i4").tobytes()
                    salt = int(part.column("id")[0].as_py()) % SALTS
                    yield pa.RecordBatch.from_arrays([pa.array([numbers[k]], pa.int32()), pa.array([salt], pa.int32()), ids, labels, pa.array([data], pa.binary())], ["cell", "salt", "ids", "labels", "vecs"])

    return rows.mapInArrow(made, "cell int, salt int, ids array<long>, labels array<string>, vecs binary")


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each group's first rows: by score, greatest first, then by id."""
    order = np.lexsort((ids, -score, group))
    begins = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[place < most]


def products(anchors: np.ndarray, candidates: np.ndarray, longest: float) -> np.ndarray:
    """Inner products, exact."""
    if longest < EXACT:
        return (anchors @ candidates.T).astype(np.int64)
    return anchors.astype(np.int64) @ candidates.astype(np.int64).T


def best_in(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchors: pa.StructArray, space: Space, most: int, window: tuple[int, int] | None) -> pa.RecordBatch:
    """The best rows of a chunk for a block of anchors: those of the anchor's label, or with a ``window`` those of others for each of its positives."""
    keys, own_ids, own_labels = (anchors.field(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "label"))
    goals = anchors.field("goals")
    starts, goal_scores = goals.offsets.to_numpy(), goals.values.to_numpy(zero_copy_only=False)
    own = matrix(anchors.field("vec"), space.dims)
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, AT_ONCE // max(1, len(ids)))
    for low in range(0, len(keys), step):
        part = slice(low, min(len(keys), low + step))
        scores = products(own[part], vectors, space.longest)
        alike = own_labels[part][:, None] == labels[None]
        if window is None:  # the one goal is the score to beat, if there is one
            floor = np.array([goal_scores[a] if a < b else np.iinfo(np.int64).min for a, b in zip(starts[part.start : part.stop], starts[part.start + 1 : part.stop + 1], strict=True)], np.int64)
            at, row = np.nonzero(alike & (scores >= floor[:, None]) & (own_ids[part][:, None] != ids[None]))
            pick = first_of(at, scores[at, row], ids[row], most)
            found.append((keys[low + at[pick]], np.zeros(len(pick), np.int64), scores[at, row][pick], ids[row][pick]))
            continue
        for k in range(part.stop - part.start):
            own_goals = np.unique(goal_scores[starts[low + k] : starts[low + k + 1]])
            possible = np.flatnonzero(~alike[k] & (100 * scores[k] >= window[0] * own_goals[0]) & (100 * scores[k] <= window[1] * own_goals[-1]))
            for goal in own_goals.tolist():
                score = scores[k, possible]
                fits = possible[(100 * score >= window[0] * goal) & (100 * score <= window[1] * goal)]
                pick = fits[first_of(np.zeros(len(fits), int), scores[k, fits], ids[fits], most)]
                found.append((np.full(len(pick), keys[low + k]), np.full(len(pick), goal), scores[k, pick], ids[pick]))
    columns = [np.concatenate([f[c] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for c in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "goal", "score", "row"])


def round_of(rows: DataFrame, anchors: DataFrame, space: Space, most: int, window: tuple[int, int] | None = None, home: bool = False) -> DataFrame:
    """For each anchor (and goal, with a window) its first ``most`` rows of those that meet it: key, goal, score, row, place.

    ``anchors``: key, id, label, vec, cell, away, ``goals`` (scores), ``low`` and ``high`` (scores between which rows are wanted, or null).
    """
    longest = F.lit(space.longest)

    def reach(score: str) -> Column:
        """How far from the anchor a row of this score is; null if there is no score."""
        return F.when(F.col(score).isNotNull(), F.sqrt(F.greatest(F.col("square") + longest - 2 * F.col(score).cast("double"), F.lit(0.0))))

    cells = anchors.groupBy("cell").agg(
        F.min("away"), F.max("away"), F.max(F.coalesce(reach("low"), F.lit(float("inf")))), F.min(F.coalesce(reach("high"), F.lit(0.0))), F.count(F.lit(1))
    ).collect()
    if not cells:
        return anchors.sparkSession.createDataFrame([], "key long, goal long, score long, row long, place int")
    blocks = F.create_map(*[F.lit(int(x)) for c in cells for x in (c[0], -(-c[5] // BLOCK))])
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("key"), blocks[F.col("cell")]))
    groups = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("key", "id", "label", "vec", "goals")).alias("anchors"))
    groups = groups.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    met = within_reach(rows, space, [tuple(c)[:5] for c in cells], home).join(groups, ["cell", "salt"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids").slice(k, 1).flatten().to_numpy()
                labels = batch.column("labels").slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                vectors = np.frombuffer(batch.column("vecs")[k].as_buffer(), "<i4").reshape(len(ids), -1).astype(np.float64) if space.dims else np.zeros((len(ids), 0))
                block = batch.column("anchors").slice(k, 1).flatten()
                yield best_in(ids, labels, vectors, pa.StructArray.from_arrays(block.flatten(), block.type.names), space, most, window)

    best = Window.partitionBy("key", "goal").orderBy(F.desc("score"), "row")
    partial = met.select("ids", "labels", "vecs", "anchors").mapInArrow(made, "key long, goal long, score long, row long").distinct()
    return partial.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become ``floor(scale * x)``; a score is the inner product of two such vectors, greater ones come first, of equal ones
    the smaller id. An anchor's positives are its first ``positives`` other rows of its label; a negative's score lies
    between ``window`` hundredths of the positive's. ``anchors`` says by a row's id and label which rows ask.

    Vectors get one more component, which makes the largest product the least distance, and each anchor the cell of
    its nearest pivot, at most ``MOST``. Rounds of candidates that meet anchors: those of an anchor's own cell, which
    give it a score to beat; then, as the cells' bounds let them, all that may be among the positives; then all whose score may
    lie in the windows. Each row goes once to a cell whose anchors it might serve, in chunks that are dealt by cell and salt.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Rows that repeat id,
    label and vector are one; other rows of an anchor's id are not its positives. Shorter vectors end in zeros; an empty
    one scores 0. A component beyond 31 bits or a score beyond 56 is an error. Of rows with one label and vector only the smallest ids can
    be among the first, so no others are compared. Without anchors or rows the result is empty.
    """
    known = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & usable(vector))
    asks = known.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    whole = stored(packed(asks, scale).distinct(), "vectors")
    copies = Window.partitionBy("label", "vec").orderBy("id")
    compared = stored(whole.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= max(positives + 1, negatives)).select("id", "label", "vec", "square"), "candidates")
    longest, dims = compared.agg(F.max("square"), F.max(F.octet_length("vec"))).head()
    chosen = whole.where(anchors)
    asking = chosen.count()
    if not asking:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if longest >= 1 << 56:  # a hundred times a score is still a long
        raise OverflowError("scores are beyond 56 bits")
    dims, pivots = dims // 4, min(MOST, max(FEWEST, asking // ANCHORS_EACH))
    drawn = compared.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(8 * pivots).collect()
    points = matrix(pa.array(list(dict.fromkeys(bytes(v) for v, _ in drawn))[:pivots], pa.binary()), dims)
    space = Space(dims, float(longest), points)
    nothing = F.lit(None).cast("long")
    asked = stored(placed(chosen.withColumn("key", F.monotonically_increasing_id()), space), "anchors")
    home = round_of(compared, asked.withColumns({"goals": F.array().cast("array<long>"), "low": nothing, "high": nothing}), space, positives, home=True)
    beaten = home.where(F.col("place") == positives).select("key", F.col("score").alias("low"))
    first = asked.join(beaten, "key", "left").withColumns({"goals": F.when(F.col("low").isNull(), F.array().cast("array<long>")).otherwise(F.array("low")), "high": nothing})
    own = stored(round_of(compared, stored(first, "asking"), space, positives).select("key", F.col("row").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    goals = own.where(F.col("positive_score") >= 0).groupBy("key").agg(F.collect_set("positive_score").alias("goals"))
    second = asked.join(goals, "key").withColumns({
        "low": F.array_min("goals").cast("double") * window[0] / 100, "high": F.array_max("goals").cast("double") * window[1] / 100,
    })
    others = round_of(compared, stored(second, "asking"), space, negatives, window).select("key", F.col("goal").alias("positive_score"), F.col("place").alias("rank"), F.col("row").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("key", F.col("id").alias("anchor_id"))
    return own.join(others, ["key", "positive_score"]).join(named, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
