"""Hard negatives by a multiway hyperplane tree with distance ranges (a GNAT over blocks of rows).

Split points are picked far apart from a bounded sample; a row belongs to its nearest split point, twice in a
row. Every subtree stores the least and largest distance of its rows to each split point among its siblings, and
the range of their lengths. The rows of a subtree, in order of the distance to its own split point, are cut into
blocks, the exact leaves, which store such ranges too.

An inner product s of an anchor q with rows of length between m and M means a distance between
sqrt(|q|^2 + m^2 - 2 s) and sqrt(|q|^2 + M^2 - 2 s). A window of scores is so a window annulus around the
anchor, and a subtree, then a block, is eliminated where for some split point the annulus, shifted by the
anchor's distance to that point, misses the stored range. Anchors travel in chunks (those of one block) and only
to what is left for them; blocks and anchors then meet by equi-joins, and scores are exact integers.

Positives are a search for the k highest scores of the same label, from a bound that the anchor's own block
gives. Negatives are a search in the windows of all positives of an anchor at once.

Edge cases: null labels, null vectors, empty ones and those with null or non-finite components take no part, nor
do rows without an id; an anchor never meets its own id, so repeated ids are candidates for others only; equal
scores go to the smaller id; vectors of another dimension than the anchor are no candidates; windows of negative
positives are empty; scaled components and scores beyond 64 bits are cut to that range; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evirank.llm.tables import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LEAST_PERCENT, MOST_PERCENT = 50, 95
BLOCK = 1024
MAX_FANOUT = 16  # at most 16 * 16 subtrees, so the tree that is sent to every task has a bound
SAMPLE = 4096  # rows that the split points are picked from
_OPEN = -(1 << 63)
_EXACT = float(1 << 53)
_SLACK = 1e-6  # relative; above the rounding of distances, so that no row is lost

ROW_DDL = "vec_id long, label long, anchor boolean, v array<long>, branch int, own double"
BLOCK_DDL = (
    "block long, branch int, dim int, n int, ids binary, labels binary, data binary, anchors binary, bounds binary, "
    "low binary, high binary, shortest double, longest double")


@dataclass(frozen=True)
class Tree:
    """Split points of both levels; ``second[i]`` are those below ``first[i]``."""

    first: np.ndarray
    second: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.first.shape[1]

    def points(self, i: int) -> np.ndarray:
        """All points that the rows below first[i] keep ranges to."""
        return np.concatenate([self.first, self.second[i]])


def quantized(vectors: DataFrame, anchor: Column, flipped: Column | None, classes: int, scale: int) -> DataFrame:
    """(vec_id, label, anchor, v): the rows that take part; flipped rows get the next label."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("long")
    if flipped is not None:
        label = F.when(flipped, (label + 1) % classes).otherwise(label)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .where(finite & (F.size("embedding") > 0))
        .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                F.coalesce(anchor, F.lit(False)).alias("anchor"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    )


def _matrix(rows: pa.Array) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    x, points = x.astype(float), points.astype(float)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1) if len(points) else np.zeros((len(x), 0))


def _far_apart(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows: the first one, then always the one farthest from those already taken."""
    taken = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    while len(taken) < min(k, len(sample)) and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(sample, sample[taken[-1:]])[:, 0])
    return sample[taken]


def _low_hashes(rows: DataFrame, share: float) -> DataFrame:
    """About this share of the rows, those with the smallest hashes, as (v, _h, vec_id)."""
    hashed = rows.select("v", F.xxhash64("vec_id", "v").alias("_h"), "vec_id")
    return hashed if share >= 1 else hashed.where(F.col("_h") < F.lit(int(share * 2.0**64) - (1 << 63)))


def _sample(rows: DataFrame, n: int) -> pa.Array:
    """Vectors of the SAMPLE rows with the smallest hashes. Tasks send about 2 * SAMPLE rows in all, not SAMPLE each."""
    share = 2 * SAMPLE / max(n, 1)
    while True:
        found = _low_hashes(rows, share).orderBy("_h", "vec_id").limit(SAMPLE).select("v").toArrow()
        if found.num_rows == SAMPLE or share >= 1:
            return found.column("v").combine_chunks()
        share *= 4


def fit_tree(rows: DataFrame, n: int) -> Tree | None:
    """Split points from SAMPLE rows with the smallest hashes (of their commonest dimension)."""
    sample = _sample(rows, n)
    if not len(sample):
        return None
    sizes = sample.value_lengths().to_numpy()
    dims, counts = np.unique(sizes, return_counts=True)
    dim = max(zip(counts, dims, strict=True))[1]
    x = _matrix(sample.take(pa.array(np.flatnonzero(sizes == dim))))
    fanout = int(min(MAX_FANOUT, max(2, round((n / BLOCK) ** 0.5))))
    first = _far_apart(x, fanout)
    home = _distances(x, first).argmin(axis=1)
    return Tree(first, [_far_apart(x[home == i], fanout) for i in range(len(first))])


def _parts(n: int) -> int:
    """Partitions of blocks: 4 blocks each, above 128 partitions up to 64, as the driver samples keys for each of them."""
    return max(1, min(n // (4 * BLOCK), max(128, n // (64 * BLOCK))))


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    """Rows with their branch (subtree number, -1 for another dimension) and the distance to its split point."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            branch, own = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            fits = np.flatnonzero(np.diff(batch.column("v").offsets.to_numpy()) == tree.dim)
            x = _matrix(batch.column("v").take(pa.array(fits))) if len(fits) else np.zeros((0, 0), np.int64)
            home = _distances(x, tree.first).argmin(axis=1) if len(fits) else np.zeros(0, np.int64)
            for i in np.unique(home).tolist():
                here = np.flatnonzero(home == i)
                far = _distances(x[here], tree.second[i])
                branch[fits[here]] = i * MAX_FANOUT + far.argmin(axis=1)
                own[fits[here]] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(branch), pa.array(own)], names=[*batch.schema.names, "branch", "own"])

    return rows.mapInArrow(assign, ROW_DDL)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b, cut to 64 bits."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _OPEN, (1 << 63) - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _blocks(assigned: DataFrame, tree: Tree, parts: int, k: int) -> DataFrame:
    """Exact leaves with their ranges; ``anchors`` are places inside the block, ``bounds`` their k-th best score there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            branch = batch.column("branch").to_numpy()
            dims = np.diff(batch.column("v").offsets.to_numpy())
            cuts = np.flatnonzero((np.diff(branch) != 0) | (np.diff(dims) != 0)) + 1
            runs = zip([0, *cuts], [*cuts, batch.num_rows], strict=True)
            for low in (p for a, b in runs for p in range(a, b, BLOCK)):
                high = min([low + BLOCK, batch.num_rows, *cuts[cuts > low][:1]])
                part = batch.slice(low, high - low)
                x, ids = _matrix(part.column("v")), part.column("vec_id").to_numpy()
                labels = part.column("label").to_numpy()
                lengths = np.sqrt((x.astype(float) ** 2).sum(axis=1))
                home = int(branch[low])
                to_points = _distances(x, tree.points(home // MAX_FANOUT)) if home >= 0 else np.zeros((len(x), 0))
                anchors = np.flatnonzero(part.column("anchor").to_numpy(zero_copy_only=False))
                bounds = np.full(len(anchors), _OPEN)
                for m, (a, score) in enumerate(zip(anchors, products(x[anchors], x), strict=True)):
                    same = np.sort(score[(labels == labels[a]) & (ids != ids[a])])
                    if len(same) >= k:
                        bounds[m] = same[-k]
                yield pa.RecordBatch.from_pylist([{
                    "block": number, "branch": home, "dim": x.shape[1], "n": len(x), "ids": ids.tobytes(),
                    "labels": labels.tobytes(), "data": x.tobytes(), "anchors": anchors.tobytes(),
                    "bounds": bounds.tobytes(), "low": to_points.min(axis=0).tobytes(),
                    "high": to_points.max(axis=0).tobytes(), "shortest": lengths.min(), "longest": lengths.max(),
                }], schema=pa.schema([
                    ("block", pa.int64()), ("branch", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()),
                    *[(c, pa.binary()) for c in ("ids", "labels", "data", "anchors", "bounds", "low", "high")],
                    ("shortest", pa.float64()), ("longest", pa.float64())]))
                number += 1

    dealt = assigned.repartitionByRange(parts, "branch", F.size("v"), "own", "vec_id")
    return dealt.sortWithinPartitions("branch", F.size("v"), "own", "vec_id").mapInArrow(pack, BLOCK_DDL)


@dataclass(frozen=True)
class Ranges:
    """Of one subtree: distances to its split points and lengths of its rows."""

    low: np.ndarray
    high: np.ndarray
    shortest: float
    longest: float


def _subtrees(blocks: DataFrame) -> dict[int, Ranges]:
    """Ranges of every subtree, at most MAX_FANOUT ** 2 of them and one for other dimensions."""
    points = F.posexplode(F.arrays_zip("lows", "highs"))
    numbers = blocks.select("branch", "shortest", "longest", "low", "high").mapInArrow(
        _as_arrays, "branch int, shortest double, longest double, lows array<double>, highs array<double>")
    lengths = numbers.groupBy("branch").agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    ranges = (
        numbers.select("branch", points).groupBy("branch", "pos")
        .agg(F.min("col.lows").alias("low"), F.max("col.highs").alias("high"))
        .groupBy("branch").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("r"))
    )
    return {
        r["branch"]: Ranges(np.array([p["low"] for p in r["r"] or []]), np.array([p["high"] for p in r["r"] or []]),
                            r["shortest"], r["longest"])
        for r in lengths.join(ranges, "branch", "left").collect()
    }


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [pa.array([np.frombuffer(x.as_py()) for x in batch.column(c)], pa.list_(pa.float64())) for c in ("low", "high")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("branch", "shortest", "longest")), *lists],
            names=["branch", "shortest", "longest", "lows", "highs"])


def may_hold(
    to_points: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray,
    high: np.ndarray, shortest: float, longest: float,
) -> np.ndarray:
    """For every anchor: can a row with these ranges have a score between ``least`` and ``most``?

    ``to_points`` holds the anchors' distances to the points of the ranges.
    """
    scale = length * length + longest * longest + 1.0
    # scores are those of integers, distances of the same integers, so both are rounded alike
    near = np.sqrt(np.maximum(length**2 + shortest**2 - 2 * most - _SLACK * scale, 0.0))
    # a row of any length in the range reaches at most length * longest
    far2 = length**2 + longest**2 - 2 * least + _SLACK * scale
    far = np.sqrt(np.maximum(far2, 0.0))
    slack = _SLACK * np.sqrt(scale)
    least_to_point = np.maximum(near[:, None] - to_points, to_points - far[:, None]) - slack[:, None]
    most_to_point = to_points + far[:, None] + slack[:, None]
    met = (least_to_point <= high) & (most_to_point >= low)
    reach = length * longest * (1 + _SLACK) + _SLACK
    return met.all(axis=1) & (far2 >= 0) & (least <= reach) & (most >= -reach)


def _anchors(blocks: DataFrame) -> DataFrame:
    """One row per block with anchors: their ids, labels, vectors and the window that positives lie in."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                places = np.frombuffer(r["anchors"], np.int64)
                if len(places):
                    x = np.frombuffer(r["data"], np.int64).reshape(r["n"], -1)[places]
                    bounds = np.frombuffer(r["bounds"], np.int64)
                    out.append({
                        "chunk": r["block"], "dim": r["dim"], "q_ids": np.frombuffer(r["ids"], np.int64)[places].tobytes(),
                        "q_labels": np.frombuffer(r["labels"], np.int64)[places].tobytes(), "q_data": x.tobytes(),
                        "q_windows": np.stack([bounds, np.full(len(bounds), (1 << 63) - 1)], axis=1).tobytes(),
                        "q_positives": None,
                    })
            yield pa.RecordBatch.from_pylist(out, schema=CHUNK_SCHEMA)

    return blocks.select("block", "dim", "n", "ids", "labels", "data", "anchors", "bounds").mapInArrow(take, CHUNK_DDL)


CHUNK_DDL = "chunk long, dim int, q_ids binary, q_labels binary, q_data binary, q_windows binary, q_positives binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("dim", pa.int32()), *[
    (c, pa.binary()) for c in ("q_ids", "q_labels", "q_data", "q_windows", "q_positives")]])


def _envelope(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most over the windows of every anchor (windows: anchors x 2, or anchors x places x 2)."""
    w = windows.reshape(len(windows), -1, 2)
    used = w[:, :, 0] <= w[:, :, 1]
    least = np.where(used, w[:, :, 0], (1 << 62)).min(axis=1).astype(float)
    most = np.where(used, w[:, :, 1], -(1 << 62)).max(axis=1).astype(float)
    return least, most


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row["q_ids"], np.int64)
    x = np.frombuffer(row["q_data"], np.int64).reshape(len(ids), -1)
    windows = np.frombuffer(row["q_windows"], np.int64).reshape(len(ids), -1)
    return ids, np.frombuffer(row["q_labels"], np.int64), x, windows


def _routed(chunks: DataFrame, tree: Tree, subtrees: dict[int, Ranges]) -> DataFrame:
    """Chunks, once per subtree that may hold rows in a window of one of their anchors."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, x, windows = _unpacked(row)
                least, most = _envelope(windows)
                length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
                out = []
                to_first = _distances(x, tree.first) if x.shape[1] == tree.dim else None
                for branch, held in subtrees.items():
                    if (branch >= 0) != (to_first is not None):
                        continue
                    to_points = np.concatenate([to_first, _distances(x, tree.second[branch // MAX_FANOUT])], axis=1) \
                        if branch >= 0 else np.zeros((len(x), 0))
                    if may_hold(to_points, length, least, most, held.low, held.high, held.shortest, held.longest).any():
                        out.append({**row, "branch": branch})
                yield pa.RecordBatch.from_pylist(out, schema=CHUNK_SCHEMA.append(pa.field("branch", pa.int32())))

    return chunks.mapInArrow(route, CHUNK_DDL + ", branch int")


def _met(routed: DataFrame, blocks: DataFrame, tree: Tree, negatives: bool, k: int) -> DataFrame:
    """(chunk, place, positive, score, vec_id): what every leaf offers to the anchors that reach it.

    Block ranges meet the chunks first; only pairs that they leave over draw the block's rows.
    """

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.select(["q_ids", "q_labels", "q_data", "q_windows", "branch", "low", "high", "shortest", "longest"]).to_pylist():
                if row["low"] is None:
                    keep.append(False)
                    continue
                _, _, x, windows = _unpacked(row)
                least, most = _envelope(windows)
                length = np.sqrt((x.astype(float) ** 2).sum(axis=1))
                home = row["branch"]
                to_points = _distances(x, tree.points(home // MAX_FANOUT)) if home >= 0 else np.zeros((len(x), 0))
                keep.append(bool(may_hold(to_points, length, least, most, np.frombuffer(row["low"]),
                                          np.frombuffer(row["high"]), row["shortest"], row["longest"]).any()))
            yield batch.filter(pa.array(keep, pa.bool_())).select([*CHUNK_SCHEMA.names, "block"])

    about = blocks.select("block", "branch", "dim", "low", "high", "shortest", "longest")
    # a left join is never built on the routed chunks, which the planner takes for as few as the chunks themselves
    left = routed.join(about, ["branch", "dim"], "left").mapInArrow(prune, CHUNK_DDL + ", block long")
    rows = blocks.select("block", "n", "ids", "labels", "data")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_labels, x, windows = _unpacked(row)
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                scores = products(x, np.frombuffer(row["data"], np.int64).reshape(row["n"], -1))
                positives = np.frombuffer(row["q_positives"], np.int64).reshape(len(x), -1) if negatives else None
                out: list[list[int]] = []
                for m, score in enumerate(scores):
                    fits = (labels != q_labels[m]) if negatives else (labels == q_labels[m])
                    fits &= ids != q_ids[m]
                    for w, (least, most) in enumerate(windows[m].reshape(-1, 2)):
                        places = np.flatnonzero(fits & (score >= least) & (score <= most))
                        places = places[_best(score[places], ids[places], k)]
                        positive = int(positives[m, w]) if negatives else 0
                        out += [[row["chunk"], m, int(q_ids[m]), w if negatives else 0, positive, int(score[p]), int(ids[p])]
                                for p in places]
                columns = np.array(out, np.int64).reshape(-1, 7).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=FOUND_NAMES)

    return left.join(rows, "block").mapInArrow(verify, ", ".join(f"{c} long" for c in FOUND_NAMES))


FOUND_NAMES = ["chunk", "place", "anchor_id", "window", "positive_id", "score", "vec_id"]


def _first(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("chunk", "place", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_windows(chunks: DataFrame, positives: DataFrame, least: int, most: int) -> DataFrame:
    """The anchors again, with one window per positive; a chunk has at most BLOCK anchors."""
    lists = positives.groupBy("chunk").agg(F.collect_list(F.struct("place", "rank", "vec_id", "score")).alias("found"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, k = len(row["q_ids"]) // 8, max(f["rank"] for f in row["found"])
                windows = np.tile(np.array([1, 0], np.int64), (n, k, 1))
                ids = np.zeros((n, k), np.int64)
                for f in row.pop("found"):
                    p, score = f["place"], f["score"]
                    ids[p, f["rank"] - 1] = f["vec_id"]
                    windows[p, f["rank"] - 1] = (-(-least * score // 100), most * score // 100)
                out.append({**row, "q_windows": windows.tobytes(), "q_positives": ids.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=CHUNK_SCHEMA)

    return chunks.join(lists, "chunk").select(*CHUNK_SCHEMA.names, "found").mapInArrow(put, CHUNK_DDL)


def hard_negatives(
    vectors: DataFrame, anchor: Column, flipped: Column | None = None, classes: int = 10, scale: int = SCALE,
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST_PERCENT, most: int = MOST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every anchor row and each of its ``n_positives`` best rows of the same label: the ``n_negatives`` best rows
    of other labels with a score of ``least`` to ``most`` percent of the positive's.
    """
    rows = stored(quantized(vectors, anchor, flipped, classes, scale))
    n = rows.count()
    tree = fit_tree(rows, n)
    if tree is None:
        tree = Tree(np.zeros((0, 0), np.int64), [])
    blocks = stored(_blocks(_assigned(rows, tree), tree, _parts(n), n_positives))
    subtrees = _subtrees(blocks)
    chunks = stored(_anchors(blocks))
    positives = stored(_first(_met(_routed(chunks, tree, subtrees), blocks, tree, False, n_positives), n_positives))
    asked = stored(_with_windows(chunks, positives, least, most))
    found = _first(_met(_routed(asked, tree, subtrees), blocks, tree, True, n_negatives), n_negatives)
    known = positives.select("chunk", "place", (F.col("rank") - 1).cast("long").alias("window"),
                             F.col("score").alias("positive_score"))
    return found.join(known, ["chunk", "place", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
