"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the sources share all words by weight; a target stops at ``MAX_REPEATS`` times its
source and the excess goes to the others by weight. A source is taken whole as often as
its target allows, and once more in part: documents are dealt into permuted blocks by a
keyed hash, and the part takes the permuted blocks in turn, passing over those that would
exceed the target; the first one passed over is filled up by its permuted slices in the same
way. The exact numbers of block copies of each source
are then dealt to the output shards by a splitting tree: a node splits its quotas
between two halves of its shards with a multivariate hypergeometric draw, so every shard
gets a random mixture and all quotas add up exactly. Shard i of a source holds the next
disjoint run of its permuted block copies; inside a shard rows are shuffled by a hash.

All choices are hashes of the document and the seed, so reruns agree. Only tables with a
row per source, or per source and block number (``BLOCKS`` at most), reach the driver or a
broadcast; the number of sources is checked.

Edge cases: a null text has size 0; a document of size 0 is taken 0 words and belongs to no
shard unless it is covered by whole repeats; a null source is a source of its own, last in
order; an empty table gives an empty mix; rows equal in id and text are decided alike;
extra columns pass through ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCKS = 1024  # blocks of a source; also slices of a block
SHARDS = 64
MAX_SOURCES = 1000
SEED = 17


def targets(sizes: list[int], weights: list[float], most: int = MAX_REPEATS) -> list[float]:
    """Words that each source should give: shares by weight, capped, the excess reshared."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    while free:
        left = total - sum(out)
        share = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / share > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / share
            return out
        for i in over:
            out[i] = float(most * sizes[i])
        free = [i for i in free if i not in set(over)]
        if left <= 0:
            break
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many block copies of each source every shard gets, columns exact."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        draw = int(round(have.sum() * (middle - low) / (high - low)))
        left = np.zeros_like(have)
        rest = int(have.sum())
        for s in range(len(have)):  # conditional hypergeometrics make the multivariate draw
            if have[s] and draw:
                # numpy's generator takes populations below 1e9; BLOCKS * MAX_SOURCES stays below
                left[s] = rng.hypergeometric(int(have[s]), rest - int(have[s]), draw)
            rest -= int(have[s])
            draw -= int(left[s])
        todo += [(low, middle, left), (middle, high, have - left)]
    return out


@dataclass
class Plan:
    """What is taken of each source: whole repeats, and a part of one more."""

    sources: list[str | None]
    size: list[int]
    target: list[float]
    repeats: list[int]
    places: list[list[int]]  # of each block, its place among the blocks that hold documents
    ranks: list[list[int]]  # of each block, its place among the blocks of the part, or -1
    border: list[int]  # the block that is taken by slices
    slices: list[list[bool]]  # of each slice of that block, whether it is taken

    def quotas(self) -> np.ndarray:
        """Block copies that each source gives to the mix."""
        return np.array([
            r * (max(p) + 1) + max(k) + 1 + any(s)
            for r, p, k, s in zip(self.repeats, self.places, self.ranks, self.slices, strict=True)
        ], np.int64)


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def dealt(docs: DataFrame, seed: int, *columns: str) -> DataFrame:
    """Adds _size, _source, _block and _slice: hash order of blocks and slices is their permutation."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(seed))
    return docs.select(
        *columns, F.col("source").cast("string").alias("_source"), word_count().alias("_size"),
        F.pmod(key, F.lit(BLOCKS)).cast("int").alias("_block"),
        F.pmod(F.shiftright(key, 20), F.lit(BLOCKS)).cast("int").alias("_slice"),
        F.pmod(F.shiftright(key, 40), F.lit(1 << 23)).cast("int").alias("_order"),
    )


def _fill(words: list[tuple[int, int]], wanted: float) -> tuple[list[int], int, float]:
    """(numbers taken in turn without exceeding ``wanted``, first one passed over, words left)."""
    taken, passed = [], -1
    for number, n in sorted(words):
        if n <= wanted:
            taken.append(number)
            wanted -= n
        elif passed < 0:
            passed = number
    return taken, passed, wanted


def make_plan(placed: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> Plan:
    """Plan from ``dealt`` rows: one pass for the blocks, one over the border blocks."""
    if (found := placed.select("_source").distinct().limit(MAX_SOURCES + 1).count()) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources ({found}); they are meant to be corpora")
    words: dict[str | None, list[tuple[int, int]]] = {}
    # at most BLOCKS rows for each source
    for r in placed.groupBy("_source", "_block").agg(F.sum("_size").alias("n")).toLocalIterator():
        words.setdefault(r["_source"], []).append((r["_block"], r["n"]))
    # the order of Python strings is by code point; null last
    sources = sorted(words, key=lambda s: (s is None, s or ""))
    size = [sum(n for _, n in words[s]) for s in sources]
    plan = Plan(sources, size, targets(size, [weights[i % len(weights)] for i in range(len(sources))]),
                [], [], [], [], [])
    left = []
    for s, n, t in zip(sources, size, plan.target, strict=True):
        whole = min(int(t // n), MAX_REPEATS) if n else 0
        open_part = n and whole < MAX_REPEATS
        taken, passed, rest = _fill(words[s], t - whole * n) if open_part else ([], -1, 0.0)
        ranks = [-1] * BLOCKS
        for k, b in enumerate(taken):
            ranks[b] = k
        places = [-1] * BLOCKS
        for k, (b, _) in enumerate(sorted(words[s])):
            places[b] = k
        plan.repeats.append(whole)
        plan.places.append(places)
        plan.ranks.append(ranks)
        plan.border.append(passed)
        left.append(rest)
    lookup = placed.sparkSession.createDataFrame(
        list(zip(range(len(sources)), sources, plan.border, strict=True)), "number int, name string, border int"
    )
    slices: dict[int, list[tuple[int, int]]] = {}
    rows = (
        placed.join(F.broadcast(lookup), placed["_source"].eqNullSafe(lookup["name"])  # MAX_SOURCES rows
                    & (placed["_block"] == lookup["border"]))
        .groupBy("number", "_slice").agg(F.sum("_size").alias("n"))
    )
    for r in rows.toLocalIterator():  # at most BLOCKS rows for each source
        slices.setdefault(r["number"], []).append((r["_slice"], r["n"]))
    for i, rest in enumerate(left):
        taken, _, rest = _fill(slices.get(i, []), rest)
        chosen = set(taken)
        # one slice more if that ends nearer to the target
        over = min(((n, k) for k, n in slices.get(i, []) if k not in chosen), default=(0, -1))
        if over[1] >= 0 and over[0] - rest < rest:
            chosen.add(over[1])
        plan.slices.append([k in chosen for k in range(BLOCKS)])
    return plan


def with_shards(placed: DataFrame, plan: Plan, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds source_size, target and _shards (the output shard of every copy) to ``dealt`` rows."""
    # block copies of every source up to and including each shard
    ends = np.cumsum(splitting_tree(plan.quotas(), shards, seed), axis=0)
    lookup = placed.sparkSession.createDataFrame(
        [
            (s, n, t, r, p, max(p) + 1, k, max(k) + 1, b, c, ends[:, i].tolist())
            for i, (s, n, t, r, p, k, b, c) in enumerate(zip(
                plan.sources, plan.size, plan.target, plan.repeats, plan.places, plan.ranks, plan.border,
                plan.slices, strict=True))
        ],
        "name string, source_size long, target double, repeats int, places array<int>, held int,"
        " ranks array<int>, whole int, border int, slices array<boolean>, ends array<long>",
    )
    joined = placed.join(F.broadcast(lookup), placed["_source"].eqNullSafe(lookup["name"]))  # MAX_SOURCES rows
    # number of each copy among its source's block copies: whole repeats first, then the part
    numbers = F.expr("""
        concat(
          CASE WHEN repeats > 0 THEN transform(sequence(0, repeats - 1), c -> c * held + places[_block])
               ELSE cast(array() as array<int>) END,
          CASE WHEN ranks[_block] >= 0 THEN array(repeats * held + ranks[_block])
               WHEN _block = border AND slices[_slice] THEN array(repeats * held + whole)
               ELSE cast(array() as array<int>) END)""")
    return (
        joined.withColumn("_numbers", numbers)
        .withColumn("_shards", F.expr("transform(_numbers, n -> size(filter(ends, e -> e <= n)))"))
        .drop("name", "repeats", "places", "held", "ranks", "whole", "border", "slices", "ends", "_numbers")
    )


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards for every document."""
    placed = cut_lineage(dealt(docs.withColumn("doc_id", F.col("doc_id").cast("long")), SEED, "doc_id"))
    return with_shards(placed, make_plan(placed)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.size("_shards")).alias("taken"), F.col("_shards").alias("shards"),
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: every copy of every taken document, with its shard, shuffled inside shards.

    Adds ``mix_shard``, ``mix_copy`` and ``mix_order`` (the place inside a shard is by this hash);
    columns that already have one of these names are replaced.
    Write it partitioned by ``mix_shard``; sorting by ``mix_order`` inside a shard is the shuffle.
    """
    names = ["mix_shard", "mix_copy", "mix_order"]
    docs = docs.drop(*names)
    plan = make_plan(cut_lineage(dealt(docs, seed)))
    own = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    placed = dealt(own, seed, "_row")
    copies = with_shards(placed, plan, shards, seed).select(
        "_row", "_order", F.posexplode("_shards").alias("mix_copy", "mix_shard")
    )
    return copies.select(
        "_row.*", "mix_shard", "mix_copy",
        F.xxhash64("_order", "mix_copy", "mix_shard", F.lit(seed)).alias("mix_order"),
    )
