"""Near-duplicates by SimHash, with pivot distance tables.

Fingerprints that differ in at most ``radius`` of 64 bits are linked. Texts with
equal fingerprints form a class and are one node. Every node gets its row of the pivot
table once, its Hamming distances to many reference fingerprints, which then goes with it.
Nodes meet where they can be near: the 64 bits are cut into blocks, of which a pair within
the radius shares all but ``radius``, so a node goes to one place for each choice of
shared blocks. By the triangle inequality two nodes within the radius have no coordinates
further apart than that. In a place the nodes stand in order of one coordinate, and a node is
compared with those near it in that order only; the other coordinates discard pairs, and
what is left is verified bit by bit. Only a forest of a place's links leaves it, never
all pairs; whole components come from joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import cut, keep_nothing, stored, text_bytes
from .components import components
from .simhash_kernel import fingerprints

#: Reference fingerprints; any fixed ones that look random will do.
PIVOTS = np.random.default_rng(20_240_701).integers(0, 2**64, 16, np.uint64)
#: Up to so many nodes of a place are compared as a list of pairs.
FEW = 48
#: A place of more nodes is cut into parts, and each two of the parts are a place of their own.
CROWDED = 50_000
#: Pairs whose coordinates are held at a time.
AT_ONCE = 400_000


def table_columns(node: str) -> list[Column]:
    """A node's row of the pivot table, its Hamming distance to each pivot, eight of them in each column."""
    out = []
    for k in range(0, len(PIVOTS), 8):
        apart = [F.bit_count(F.col(node).bitwiseXOR(F.lit(p))).cast("long") for p in PIVOTS[k : k + 8].view(np.int64).tolist()]
        out.append(reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * i) for i, d in enumerate(apart)]).alias(f"table{k // 8}"))
    return out


TABLE = [f"table{k}" for k in range(len(PIVOTS) // 8)]


#: A one, and the highest bit, in each byte.
ONES, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def coordinates_near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For pairs of columns of the table, whether none of the eight coordinates are further apart than the radius.

    Coordinates are 64 at most, so a byte of ``x`` is a difference plus 64 + radius, and no byte carries into the next.
    """
    x = a + ONES * np.uint64(64 + radius) - b
    return (x + ONES * np.uint64(64)) & ~(x + ONES * np.uint64(63 - 2 * radius)) & HIGH == HIGH


def within(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, table: list[np.ndarray], radius: int) -> np.ndarray:
    """For pairs of indices, whether the fingerprints lie within the radius; the table discards pairs, what is left is verified."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), AT_ONCE):
        x, y = a[k : k + AT_ONCE], b[k : k + AT_ONCE]
        left = np.arange(len(x))
        for column in table:
            left = left[coordinates_near(column[x[left]], column[y[left]], radius)]
        out[k + left] = np.bitwise_count(nodes[x[left]] ^ nodes[y[left]]) <= radius
    return out


def forest(nodes: np.ndarray, table: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the near pairs of these different fingerprints connect.

    The nodes stand in order of the coordinate that differs most. Each tree grows by breadth: what it has
    reached is compared with what no tree has reached and stands within the radius of it in that order, so
    nodes that are all near each other cost one round.
    """
    plain = np.stack(table, 1).astype("<u8", copy=False).view(np.uint8)
    line = plain[:, plain.astype(np.float32).var(axis=0).argmax()]
    order = np.argsort(line, kind="stable")
    own, columns, line = nodes[order], [column[order] for column in table], line[order]
    begins = np.searchsorted(line, np.arange(-radius, 66 + radius))  # where each coordinate begins, from -radius on
    free, left, low = np.ones(len(own), bool), len(own), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while left > 1:
        low += int(np.argmax(free[low:]))  # none before it is free
        free[low] = False
        left -= 1
        reached = [low]
        while reached and left:
            centre = reached.pop()
            at = int(line[centre])
            near = slice(max(low, int(begins[at])), int(begins[at + 2 * radius + 1]))
            some = np.flatnonzero(coordinates_near(columns[0][near], columns[0][centre], radius) & free[near]) + near.start
            some = some[within(np.full(len(some), centre), some, own, columns, radius)]
            if len(some):
                free[some] = False
                left -= len(some)
                found.append((np.full(len(some), centre), some))
                reached += some.tolist()
    a, b = (order[np.concatenate([x[i] for x in found])] if found else np.empty(0, np.int64) for i in (0, 1))
    return a, b


def links_of(place: np.ndarray, nodes: np.ndarray, table: list[np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the runs of equal ``place``; each run is whole and has no node twice."""
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    sizes = np.diff(np.r_[starts, len(place)])
    few = (sizes > 1) & (sizes <= FEW)
    for size in np.unique(sizes[few]).tolist():
        one, other = np.triu_indices(size, 1)
        begin = starts[sizes == size]
        step = max(1, AT_ONCE // len(one))
        for k in range(0, len(begin), step):
            base = begin[k : k + step, None]
            a, b = (base + one).ravel(), (base + other).ravel()
            near = within(a, b, nodes, table, radius)
            yield nodes[a[near]], nodes[b[near]]
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        own = nodes[start : start + size]
        a, b = forest(own, [column[start : start + size] for column in table], radius)
        yield own[a], own[b]


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with one link a node, to the least of its tree."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(names))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(len(names)))
    return names[rest], names[root[rest]]


def blocks_for(count: int, radius: int) -> int:
    """Blocks so many that a place has about one chance node; at every number no near pair is missed."""
    blocks = radius + 2
    while blocks < radius + 8 and 2 ** (64 * (blocks - radius) / blocks) < 4 * count:
        blocks += 1
    return blocks


def places(nodes: DataFrame, count: int, radius: int) -> DataFrame:
    """A row ``choice``, ``bits``, ``node`` and its table for each place that a node goes to."""
    blocks = blocks_for(count, radius)
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in (edges[i : i + 2] for i in kept)) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (m >> 63 << 64) for m in masks]
    rows = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("node").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)])
    return nodes.select("node", *TABLE, F.explode(rows).alias("place")).select("place.*", "node", *TABLE)


def spread(rows: DataFrame, crowded: int) -> DataFrame:
    """Adds ``part``; nodes of a crowded place are dealt into parts, and go to each two parts that hold theirs."""
    counted = rows.groupBy("choice", "bits").count().where(F.col("count") > crowded).select("choice", "bits", F.ceil(F.col("count") / crowded).alias("parts"))
    hot = stored(counted, "crowded")
    if hot.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own))
    joined = rows.join(hot, ["choice", "bits"], "left")
    return joined.select("choice", "bits", "node", *TABLE, F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"))


def near_links(nodes: DataFrame, radius: int = 4, crowded: int = CROWDED) -> DataFrame:
    """Links that connect all nodes within the radius; ``nodes`` has each fingerprint once, as ``node``, with its row of the table."""
    count = nodes.count()
    rows = places(nodes, count, radius)
    rows = spread(rows, crowded) if count > crowded else rows.withColumn("part", F.lit(0).cast("long"))
    names = ("choice", "bits", "part", "node", *TABLE)
    dealt = rows.repartition(F.col("choice"), F.col("bits"), F.col("part")).sortWithinPartitions("choice", "bits", "part")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def out(columns: tuple[np.ndarray, ...]) -> None:
            choice, bits, part, node, *table = columns
            new = (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]) | (part[1:] != part[:-1])
            found.extend(links_of(np.r_[0, np.cumsum(new)], node.view(np.uint64), [t.view(np.uint64) for t in table], radius))
            if sum(len(a) for a, _ in found) > AT_ONCE:
                found[:] = [local_forest(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))]

        for batch in batches:
            if not batch.num_rows:
                continue
            new = tuple(batch.column(name).to_numpy(zero_copy_only=False) for name in names)
            # A place may go on in the next batch, so the last one waits.
            last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]) | (new[2] != new[2][-1]))
            if not len(last):
                held.append(new)
                continue
            upto = int(last[-1]) + 1
            out(tuple(np.concatenate([*(h[i] for h in held), new[i][:upto]]) for i in range(len(names))))
            held = [tuple(x[upto:] for x in new)]
        if held:
            out(tuple(np.concatenate([h[i] for h in held]) for i in range(len(names))))
        if found:
            a, b = local_forest(*(np.concatenate([x[i] for x in found]) for i in (0, 1)))
            for k in range(0, len(a), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + AT_ONCE].view(np.int64)) for x in (a, b)], ["u", "v"])

    return dealt.select(*names).mapInArrow(linked, StructType().add("u", LongType()).add("v", LongType()))


def fingerprint_table(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``id`` and the fingerprint ``node`` (its 64 bits as a signed integer) of every row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            prints = fingerprints((text.as_py() for text in batch.column(1)), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "node"])

    plain = frame.select(F.col(id_column).alias("id"), text_bytes(text_column).alias("text"))
    return plain.mapInArrow(made, StructType().add("id", frame.schema[id_column].dataType).add("node", LongType()))


def near_duplicates(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """Fingerprint and component of every row.

    Returns ``id_column``, ``fingerprint`` (16 lowercase hex digits) and
    ``component_id``, the least id that links reach, the row's own included. Null
    and empty texts have fingerprint zero and are linked like any other. Null
    ids are kept; they are never the least one, so a component of null ids alone
    has a null id. Repeated ids give a row each. Other columns are left aside;
    an empty table gives none.
    """
    prints = cut(fingerprint_table(frame, id_column, text_column, width, seed))
    nodes = cut(prints.groupBy("node").agg(F.min("id").alias("least")))
    roots = components(near_links(cut(nodes.select("node", *table_columns("node"))), radius))
    # Each side of these joins is read from the shared folder, so hot keys are split.
    linked = cut(roots.join(nodes, "node"))
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    names = cut(linked.join(least, "root").select("node", "component_id"))
    named = cut(nodes.join(names, "node", "left").select("node", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    digits = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return prints.join(named, "node").select(F.col("id").alias(id_column), digits.alias("fingerprint"), "component_id")
