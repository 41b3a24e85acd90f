"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(SCALE * x). Candidates are range-partitioned by length and packed
into blocks of ``BLOCK`` vectors of similar length; queries are packed in blocks too. A first
pass over the longest vectors gives every query a lower bound of its k-th score. With the
largest length of a block that bound is a local cosine threshold, and decides for each query
and block: above 1 the block is skipped; above ``COORDINATE_FROM`` candidates are pruned by the
feasible range of the query's largest coordinates; else by length alone. What is left is
verified with exact integer products. Only the k best of a block that reach the bound leave it.

The query set is a stated share of the table, so the work grows with queries x rows; blocks
meet by an equi-join on the slice of lengths that a block lies in, never as one group. A block of
queries is sent only to slices whose longest vector times its own longest reaches its least bound.

Edge cases: null vectors and those with null or non-finite components take no part, nor do rows
without an id; products are exact for components of any size below 2**63 after scaling (larger
ones count as that), scores beyond a long count as its ends; vectors of another dimension than the
query are no candidates; equal scores go to the smaller id; repeated ids are separate candidates, but a
query never meets its own id; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evirank.session import cut_lineage

SCALE = 1024
K = 10
BLOCK = 1024
QUERY_BLOCK = 256
SEEDS = 1024
COORDINATE_FROM = 0.6
FOCUS = 3
SLICES = 1024  # lengths of the longest vectors, by which query blocks choose where to go
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

BLOCK_DDL = "block long, dim int, n int, longest double, least double, ids binary, data binary, bound binary"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, norm2): rows that take part."""
    component = lambda x: F.floor(x.cast("double") * scale)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", component)
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite & (F.size("embedding") > 0))
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    )


def _packed(vectors: DataFrame, size: int, with_bound: bool) -> DataFrame:
    """Vectors of each partition packed into blocks of equal dimension, in the order given."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            dims = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for low in range(0, len(rows), size):
                    part = batch.take(pa.array(rows[low:low + size]))
                    data = part.column("v").flatten().to_numpy()
                    if data.min() >= -(1 << 31) and data.max() < 1 << 31:
                        data = data.astype(np.int32)
                    ids = part.column("vec_id").to_numpy().astype(np.int64)
                    bound = part.column("bound").to_numpy().astype(np.int64) if with_bound else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
                        pa.array([float(np.sqrt(part.column("norm2").to_numpy().max()))]),
                        pa.array([float(bound.min()) if len(bound) else 0.0]),
                        pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()),
                        pa.array([bound.tobytes()], pa.binary()),
                    ], names=["block", "dim", "n", "longest", "least", "ids", "data", "bound"])
                    number += 1

    return vectors.mapInArrow(pack, BLOCK_DDL)


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids, data = np.frombuffer(row[f"{side}_ids"], np.int64), row[f"{side}_data"]
    wide = len(data) == 8 * len(ids) * row["dim"]
    return ids, np.frombuffer(data, np.int64 if wide else np.int32).reshape(len(ids), -1).astype(np.int64)


def exact_products(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows with the query; beyond 64 bits the ends of a long."""
    if not len(block):
        return np.zeros(0, np.int64)
    reach = np.abs(block.astype(float)).max() * np.abs(query.astype(float)).max() * len(query)
    if reach < 1 << 53:  # every partial sum is exact in doubles
        return (block.astype(float) @ query.astype(float)).astype(np.int64)
    if reach < 1 << 62:
        return block @ query
    return np.array([min(max(x, _LEAST), _MOST) for x in block.astype(object) @ query.astype(object)], np.int64)


def survivors(query: np.ndarray, length: float, block: np.ndarray, lengths: np.ndarray, bound: float) -> np.ndarray:
    """Places of the block's vectors that may reach ``bound`` with the query."""
    if bound <= 0 or length == 0:
        return np.arange(len(block)) if bound <= 0 else np.zeros(0, np.int64)
    slack = 1 - 1e-9  # rounding of lengths and cosines must not lose a candidate
    cosine = bound * slack / (length * max(float(lengths[0]), 1e-300))
    if cosine > 1:
        return np.zeros(0, np.int64)
    # lengths descend: beyond this place even a cosine of 1 is too little
    places = np.arange(int(np.searchsorted(-lengths, -(bound * slack / length), side="right")))
    if cosine < COORDINATE_FROM:
        return places
    for f in np.argsort(-np.abs(query))[:FOCUS]:
        q = float(query[f]) / length
        reach = np.sqrt(max(0.0, 1 - q * q)) * np.sqrt(max(0.0, 1 - cosine * cosine))
        c = block[places, f] / np.maximum(lengths[places], 1e-300)
        # tolerance well above double rounding
        places = places[(c >= q * cosine - reach - 1e-9) & (c <= 1.0)] if q > 0 else places[
            (c <= q * cosine + reach + 1e-9) & (c >= -1.0)]
    return places


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, queries = _unpacked(row, "q")
                bounds = np.frombuffer(row["q_bound"], np.int64)
                ids, block = _unpacked(row, "c")
                near = block.astype(np.float64)  # for pruning, which allows for rounding
                lengths = np.sqrt((near * near).sum(axis=1))
                order = np.lexsort((ids, -lengths))
                ids, block, near, lengths = ids[order], block[order], near[order], lengths[order]
                out_q, out_v, out_s = [], [], []
                for n, query in enumerate(queries):
                    rough = query.astype(np.float64)
                    places = survivors(rough, float(np.sqrt(rough @ rough)), near, lengths, float(bounds[n]))
                    places = places[ids[places] != query_ids[n]]
                    if not len(places):
                        continue
                    score = exact_products(block[places], query)
                    keep = score >= bounds[n]
                    places, score = places[keep], score[keep]
                    best = np.lexsort((ids[places], ~score))[:k]  # ~ turns the order and cannot overflow
                    out_q += [int(query_ids[n])] * len(best)
                    out_v += ids[places[best]].tolist()
                    out_s += score[best].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"]
                )

    return search


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Scores of all block pairs of equal dimension whose lengths can reach the query block's least bound."""
    part = F.shiftright("block", 40)  # blocks are packed from slices of descending length
    c = candidates.select(
        part.alias("part"), "dim", *[F.col(x).alias(f"c_{x}") for x in ("ids", "data", "longest")],
    )
    parts = candidates.agg(F.coalesce(F.max(part), F.lit(0)) + 1).first()[0]
    width = -(-parts // SLICES)
    longest = dict(candidates.groupBy((part / width).cast("int").alias("of"))
                   .agg(F.max("longest")).collect())  # at most SLICES rows
    reach = F.array([F.lit(float(longest.get(i, 0.0))) for i in range(-(-parts // width))])
    # slices in reach of the block; without a bound above zero all of them
    slack = 1 - 1e-9
    inside = F.transform(reach, lambda x: (F.col("least") <= 0) | (x * F.col("longest") >= F.col("least") * slack))
    q = queries.withColumn("inside", inside).select(
        F.posexplode("inside").alias("of", "in_reach"), "dim",
        *[F.col(x).alias(f"q_{x}") for x in ("ids", "data", "bound", "longest", "least")],
    ).where("in_reach").select(
        F.explode(F.sequence(F.col("of") * width, F.least((F.col("of") + 1) * width, F.lit(parts)) - 1)).alias("part"),
        "*",
    ).withColumn("part", F.col("part").cast("long"))
    pairs = (
        q.join(c, ["part", "dim"])
        .where((F.col("q_least") <= 0) | (F.col("c_longest") * F.col("q_longest") >= F.col("q_least") * slack))
        .select("dim", "q_ids", "q_data", "q_bound", "c_ids", "c_data")
    )
    return pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query row."""
    rows = cut_lineage(quantized(vectors, scale))
    n = rows.count()
    parts = max(1, -(-n // BLOCK))
    blocks = cut_lineage(_packed(rows.repartitionByRange(parts, F.desc("norm2"), "vec_id")
                                 .sortWithinPartitions(F.desc("norm2"), "vec_id"), BLOCK, False))
    queries = rows.where(is_query)
    # the longest vectors: SEEDS rows, a bounded table
    seeds = cut_lineage(_packed(rows.orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).coalesce(1), SEEDS, False))
    open_bound = F.lit(_LEAST).alias("bound")
    query_parts = max(1, -(-n // (BLOCK * 16)))
    first = _packed(queries.select("*", open_bound).repartition(query_parts, F.xxhash64("vec_id")), QUERY_BLOCK, True)
    reached = (
        _ranked(_meet(first, seeds, k), k).where(F.col("rank") == k)
        .select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    )
    bounded = queries.join(reached.groupBy("vec_id").agg(F.min("bound").alias("bound")), "vec_id", "left").select(
        "vec_id", "v", "norm2", F.coalesce("bound", F.lit(_LEAST)).alias("bound")
    )
    packed = cut_lineage(_packed(bounded.repartition(query_parts, F.xxhash64("vec_id")), QUERY_BLOCK, True))
    return _ranked(_meet(packed, blocks, k), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
