"""Steps along the edges of a packed graph: Brandes' method over many sources at once, and PageRank.

A row holds a node and a block of ``WIDTH`` sources: one vector instead of one row per source, written as a mask
of 64 bits and the values that are not 0. Every undirected edge lies in one partition, that of its end of lower
degree. A node so has one partition, or, as the higher end, one per partition that holds its edges; a node of
degree d has at most sqrt(2m) edges as the lower end, so no hub fills a task. The edges of a partition are packed
once as places in its sorted nodes. A step sends the packed edges and the vectors to the partitions, adds the
vectors along the edges there, block by block, and adds the partial sums per node. Edges are held per task; of
the vectors one block of sources at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evirank.session import stored

WIDTH = 64
EDGES_AT_ONCE = 1 << 16
ROWS_OUT = 10_000
VECTORS = "node LONG, block INT, value BINARY"


#: In place of a block of sources: pieces of a partition's nodes, their degrees there, neighbours and weights.
NODES, DEGREES, NEIGHBOURS, WEIGHTS = -4, -3, -2, -1
PIECES = "part INT, block INT, node LONG, value BINARY"


@dataclass(frozen=True)
class CodedGraph:
    """``ids(node, id)``, ``edges(part, a, b)`` once each, ``places(node, part)`` by id; ``packed`` holds the edges."""

    ids: DataFrame
    edges: DataFrame
    places: DataFrame
    packed: DataFrame
    parts: int


def code_graph(nodes: DataFrame, edges: DataFrame, edges_per_task: int) -> CodedGraph:
    """Long ids for ``nodes(node, degree)`` and the partition of each edge ``(src, dst, score)``, given both ways."""
    spark = nodes.sparkSession
    ids = stored(nodes.select("node", "degree", F.monotonically_increasing_id().alias("id")))
    ends = ids.agg(F.sum("degree")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-ends // (2 * edges_per_task)))
    a = ids.select(F.col("node").alias("src"), F.col("degree").alias("_a"), F.col("id").alias("a"))
    b = ids.select(F.col("node").alias("dst"), F.col("degree").alias("_b"), F.col("id").alias("b"))
    once = edges.where(F.col("src") < F.col("dst")).select("src", "dst", F.col("score").cast("double").alias("weight"))
    once = once.join(a, "src").join(b, "dst")
    first = (F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("a") < F.col("b")))
    lower = F.when(first, F.col("a")).otherwise(F.col("b"))
    coded = once.select(F.pmod(F.xxhash64(lower), F.lit(parts)).cast("int").alias("part"), "a", "b", "weight")
    packed = stored(coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_pack, PIECES))
    places = packed.where(F.col("block") == NODES).mapInArrow(_places, "node LONG, part INT")
    return CodedGraph(ids.select("node", "id"), coded.drop("weight"), stored(places), packed, parts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its nodes, their degrees, and both ways along every edge by the node they end in."""
    for rows in _runs(batches, "part"):
        part = rows.column("part").to_numpy()
        starts = _changes(part)
        for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            a, b, weight = (rows.column(c).to_numpy()[i:j] for c in ("a", "b", "weight"))
            ids, local = np.unique(np.concatenate([a, b]), return_inverse=True)
            target = np.concatenate([local[j - i:], local[:j - i]])
            order = np.lexsort((local, target))
            held = {NODES: ids, DEGREES: np.bincount(target, minlength=len(ids)).astype(np.int32),
                    NEIGHBOURS: local[order].astype(np.int32), WEIGHTS: np.concatenate([weight, weight])[order]}
            for block, x in held.items():
                for piece, k in enumerate(range(0, len(x), EDGES_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part[i]], pa.int32()), pa.array([block], pa.int32()), pa.array([piece], pa.int64()),
                         pa.array([x[k:k + EDGES_AT_ONCE].tobytes()], pa.binary())],
                        names=["part", "block", "node", "value"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, value in zip(batch.column("part").to_pylist(), batch.column("value"), strict=True):
            ids = np.frombuffer(value.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.full(len(ids), part, np.int32))], names=["node", "part"])


def _pieces(run: pa.RecordBatch, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(run.column("value").to_pylist()), kind)


class _Edges:
    """The packed edges of the partition that a task is at, as its pieces come in."""

    def take(self, block: int, run: pa.RecordBatch) -> None:
        if block == NODES:
            self.ids = _pieces(run, np.int64)
        elif block == DEGREES:
            self.target = np.repeat(np.arange(len(self.ids), dtype=np.int32), _pieces(run, np.int32))
        elif block == NEIGHBOURS:
            self.source = _pieces(run, np.int32)
        else:
            self.weight = _pieces(run, np.float64)


def _at_parts(graph: CodedGraph, rows: DataFrame, *columns: str, weights: bool = False) -> DataFrame:
    """The packed edges, and ``rows(node, block, columns)`` at every partition that holds edges of their node."""
    types = dict(rows.dtypes)
    held = graph.packed if weights else graph.packed.where(F.col("block") != WEIGHTS)
    extra = [c for c in columns if c != "value"]
    held = held.select("part", "block", "node", "value", *[F.lit(None).cast(types[c]).alias(c) for c in extra])
    value = F.col("value") if "value" in columns else F.lit(None).cast("binary").alias("value")
    sent = rows.join(graph.places.hint("merge"), "node").select("part", "block", "node", value, *extra)
    return held.unionByName(sent).repartitionById(graph.parts, F.col("part")).sortWithinPartitions(
        "part", "block", "node")


def first_level(graph: CodedGraph, sources: DataFrame) -> DataFrame:
    """One path from each source ``(node)`` to itself; the sources are numbered by their ids."""
    numbered = sources.join(graph.ids, "node").select(
        F.col("id").alias("node"), (F.row_number().over(Window.orderBy("id")) - 1).alias("k"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy()
            x = np.zeros((len(k), WIDTH))
            x[np.arange(len(k)), k % WIDTH] = 1.0
            yield from _vectors(batch.column("node").to_numpy(), k // WIDTH, x)

    return stored(numbered.mapInArrow(unit, VECTORS))


def _dense(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix."""
    column = column.cast(pa.binary())
    x = np.zeros((len(column), WIDTH))
    if not len(column):
        return x
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    cells = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.int64)
    first = (offsets[:-1] - offsets[0]) // 8
    used = np.unpackbits(cells[first].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    values = np.ones(len(cells), bool)
    values[first] = False
    x[used] = cells[values].view(np.float64)
    return x


def _binary(x: np.ndarray) -> pa.Array:
    """Of every row a mask of the values that are not 0, and those values."""
    used = x != 0
    ends = np.cumsum(used.sum(axis=1) + 1)
    first = np.append(0, ends[:-1])
    cells = np.empty(ends[-1], np.int64)
    cells[first] = np.packbits(used, axis=1, bitorder="little").view(np.int64)[:, 0]
    values = np.ones(len(cells), bool)
    values[first] = False
    cells[values] = x[used].view(np.int64)
    offsets = np.append(0, ends * 8).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(cells)])


def _vectors(nodes: np.ndarray, blocks: np.ndarray, x: np.ndarray, **more: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(nodes), ROWS_OUT):
        cut = slice(i, i + ROWS_OUT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[cut], pa.int64()), pa.array(blocks[cut], pa.int32()), _binary(x[cut]),
             *[pa.array(v[cut], pa.float64()) for v in more.values()]], names=["node", "block", "value", *more])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """The rows again in batches that end with a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # the key of the last row, and where its run begins in this batch
        last = _changes(*[batch.column(n).to_numpy() for n in names])[-1]
        if last == 0 and held and any(batch.column(n)[0] != held[0].column(n)[0] for n in names):
            yield _joined(held)
            held = []
        if last > 0:
            yield _joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _sum_runs(x: np.ndarray, source: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``x[source]`` by run, some runs at a time."""
    out = np.empty((len(starts), WIDTH))
    ends = np.append(starts[1:], len(source))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + EDGES_AT_ONCE, "right")))
        out[i:j] = np.add.reduceat(x[source[starts[i]:ends[j - 1]]], starts[i:j] - starts[i], axis=0)
        i = j
    return out


def _parts_and_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for rows in _runs(batches, "part", "block"):
        block = rows.column("block").to_numpy()
        starts = _changes(rows.column("part").to_numpy(), block)
        for i, j in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            yield int(block[i]), rows.slice(i, j - i)


def _along_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its edges first (blocks below 0), then blocks of vectors; out come sums over neighbours."""
    edges = _Edges()
    for block, run in _parts_and_blocks(batches):
        if block < 0:
            edges.take(block, run)
            continue
        at = np.full(len(edges.ids), -1, np.int32)
        at[np.searchsorted(edges.ids, run.column("node").to_numpy())] = np.arange(run.num_rows)
        found = at[edges.source]
        reached = edges.target[found >= 0]
        runs = _changes(reached)
        sums = _sum_runs(_dense(run.column("value")), found[found >= 0], runs)
        yield from _vectors(edges.ids[reached[runs]], np.full(len(runs), block), sums)


def neighbour_sums(graph: CodedGraph, vectors: DataFrame) -> DataFrame:
    """Partial sums of ``vectors(node, block, value)`` over the edges, at the other ends."""
    return _at_parts(graph, vectors, "value").mapInArrow(_along_edges, VECTORS)


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = _Edges()
    for block, run in _parts_and_blocks(batches):
        if block < 0:
            edges.take(block, run)
            continue
        x = np.zeros(len(edges.ids))
        x[np.searchsorted(edges.ids, run.column("node").to_numpy())] = run.column("x").to_numpy()
        sums = np.bincount(edges.target, edges.weight * x[edges.source], len(edges.ids))
        for i in range(0, len(sums), EDGES_AT_ONCE):
            cut = slice(i, i + EDGES_AT_ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(edges.ids[cut]), pa.array(sums[cut])], names=["node", "x"])


def weighted_sums(graph: CodedGraph, values: DataFrame) -> DataFrame:
    """Sums of ``values(node, x)``, times the edges' weights, at the other ends: one row per node."""
    rows = values.select("node", F.lit(0).alias("block"), "x")
    partial = _at_parts(graph, rows, "x", weights=True).mapInArrow(_weighted, "node LONG, x DOUBLE")
    return partial.groupBy("node").agg(F.sum("x").alias("x"))


def _by_node(graph: CodedGraph, sums: DataFrame, known: DataFrame) -> DataFrame:
    """Partial sums behind the known vectors of the same node and block."""
    columns = ["node", "block", "value"]
    both = known.select(*columns, F.lit(0).alias("kind")).unionByName(
        sums.select(*columns, F.lit(1).alias("kind")))
    return both.repartition(graph.parts, "node").sortWithinPartitions("node", "block", "kind")


def _parts_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, block = rows.column("node").to_numpy(), rows.column("block").to_numpy()
    old = rows.column("kind").to_numpy() == 0
    return node, block, old, _dense(rows.column("value")), _changes(node, block)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, "node", "block"):
        node, block, old, x, starts = _parts_of(rows)
        seen = np.logical_or.reduceat((x != 0) & old[:, None], starts, axis=0)
        total = np.add.reduceat(np.where(old[:, None], 0.0, x), starts, axis=0)
        total[seen] = 0.0
        keep = total.any(axis=1)
        yield from _vectors(node[starts][keep], block[starts][keep], total[keep])


def next_level(graph: CodedGraph, level: DataFrame, before: DataFrame | None) -> DataFrame:
    """Path counts of the nodes one step further from each source."""
    # a neighbour of a level lies in it, in the one before, or in the next
    seen = level if before is None else level.unionByName(before)
    return _by_node(graph, neighbour_sums(graph, level), seen).mapInArrow(_fresh, VECTORS)


def _unit(sigma: np.ndarray, delta: np.ndarray | float) -> np.ndarray:
    return np.divide(1.0 + delta, sigma, out=np.zeros_like(sigma), where=sigma != 0)


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches, "node", "block"):
        node, block, old, x, starts = _parts_of(rows)
        gain = np.add.reduceat(np.where(old[:, None], 0.0, x), starts, axis=0)
        here = old[starts]  # nodes of other levels have sums only
        sigma, first = x[starts][here], starts[here]
        delta = sigma * gain[here]
        yield from _vectors(node[first], block[first], _unit(sigma, delta), delta=delta.sum(axis=1))


def _deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigma = _dense(batch.column("value"))
        yield from _vectors(batch.column("node").to_numpy(), batch.column("block").to_numpy(), _unit(sigma, 0.0),
                            delta=np.zeros(len(sigma)))


def deepest(level: DataFrame) -> DataFrame:
    """``(1 + delta) / sigma`` of the last level, where every delta is 0."""
    return level.mapInArrow(_deepest, VECTORS + ", delta DOUBLE")


def returned(graph: CodedGraph, level: DataFrame, deeper: DataFrame) -> DataFrame:
    """``(1 + delta) / sigma`` of a level from that of the next, and delta summed over the block."""
    sums = neighbour_sums(graph, deeper.select("node", "block", "value"))
    return _by_node(graph, sums, level).mapInArrow(_returned, VECTORS + ", delta DOUBLE")
