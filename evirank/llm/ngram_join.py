"""N-gram Jaccard self-join with an LSH forest of MinHash signatures.

Every document becomes the set of its five-word shingles. Documents with equal sets form
one class at once, so copies cost nothing further. Each of ``trees`` sorted tries orders
the class representatives by a MinHash signature; two of them are candidates if they share
a prefix in any trie. The prefix starts at ``max_depth`` and is shortened until a pair
exactly at the threshold is found with probability ``target_recall``; every pair above the
threshold is found more surely. Candidates are verified on the whole shingle sets.

A prefix group of any size is split into blocks of ``BLOCK`` members; a task compares
two blocks and returns one row per member (its links and its component inside the task),
never the pairs. Prefix groups that hold the same members in several tries are compared
once. A group of n *different* near copies therefore costs n^2 / BLOCK shuffled rows and
n^2 comparisons, but only n rows of output.

Edge cases: a text of fewer than five words is one shingle; null and empty texts have no
shingles, stay alone and have no links; rows with the same doc_id and text are copies of
each other; a null doc_id gets the row's hash as its class id where it is the least member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.components import connected_components
from evirank.llm.words import mix, shingle_hashes, word_pieces
from evirank.session import cut_lineage

WIDTH = 5
THRESHOLD = 0.8
TREES = 7
MAX_DEPTH = 8
TARGET_RECALL = 0.99
BLOCK = 128
_SLAB = 4096  # shingles compared at once: bounds the matrix to 2 * BLOCK x _SLAB


def prefix_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """Longest prefix that still finds a pair at the threshold with the target probability."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def signatures(docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, row, set_a, set_b, n, tries): set digest and one prefix hash per trie."""
    rng = np.random.default_rng(20)
    factor = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, words in word_pieces(batch.column("text")):
                shingles, text = shingle_hashes(words, width)
                rows = len(words.first) - 1
                # distinct shingles of each text, sorted
                order = np.lexsort((shingles, text))
                shingles, text = shingles[order], text[order]
                new = np.ones(len(text), bool)
                new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
                shingles, text = shingles[new], text[new]
                n = np.bincount(text, minlength=rows)
                full = np.flatnonzero(n)
                at = np.searchsorted(text, full)
                tries = np.zeros((rows, trees), np.uint64)
                digest = np.zeros((rows, 2), np.uint64)
                if len(full):
                    for t in range(trees):
                        prefix = np.full(len(full), t + 1, np.uint64)
                        for d in range(depth):
                            k = t * depth + d
                            least = np.minimum.reduceat(shingles * factor[k] + offset[k], at)
                            prefix = mix(prefix ^ mix(least))
                        tries[full, t] = prefix
                    # order-free digests of the set: sums of independent hashes
                    for k in range(2):
                        digest[full, k] = mix(
                            np.add.reduceat(mix(shingles ^ np.uint64(0xA5A5 + k)), at) + n[full].astype(np.uint64)
                        )
                parts.append((digest, n, tries))
            digest = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 2), np.uint64)
            n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            tries = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, trees), np.uint64)
            flat = pa.array(np.ascontiguousarray(tries).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"),
                pa.array(np.ascontiguousarray(digest[:, 0]).view(np.int64)),
                pa.array(np.ascontiguousarray(digest[:, 1]).view(np.int64)),
                pa.array(n.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * trees), flat),
            ], names=["doc_id", "row", "set_a", "set_b", "n", "tries"])

    return keyed(docs).mapInArrow(
        sign, "doc_id long, row long, set_a long, set_b long, n long, tries array<long>"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` identifies the document by its id and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("row", F.xxhash64("doc_id", "text"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[value]
    value, owner = number[value[keep]], owner[keep]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), _SLAB):
        a, b = np.searchsorted(value, [low, low + _SLAB])
        slab = np.zeros((len(sets), _SLAB), np.float32)
        slab[owner[a:b], value[a:b] - low] = 1
        total += slab @ slab.T
    return total.astype(np.int64)


def _compare(tile: pa.Table, width: int, threshold: float) -> pa.Table:
    """Links and local component of every member of two blocks of one prefix group."""
    tree = tile.column("tree")[0].as_py()
    low, high = tile.column("low")[0].as_py(), tile.column("high")[0].as_py()
    sets: list[np.ndarray] = []
    for chunk in tile.column("text").chunks:
        for _, _, words in word_pieces(chunk):
            shingles, text = shingle_hashes(words, width)
            cuts = np.searchsorted(text, np.arange(1, len(words.first) - 1))
            sets += [np.unique(s) for s in np.split(shingles, cuts)]
    size = np.array([len(s) for s in sets])
    common = _intersections(sets)
    union = size[:, None] + size[None, :] - common
    linked = (common >= threshold * union - 1e-9) & ~np.eye(len(sets), dtype=bool)
    block = tile.column("block").to_numpy()
    if low != high:
        linked &= block[:, None] != block[None, :]
    tries = np.array(tile.column("tries").to_pylist())
    first = (tries[:, None, :] == tries[None, :, :]).argmax(axis=2) == tree
    copies = tile.column("copies").to_numpy()
    links = ((linked & first) * copies[None, :]).sum(axis=1)
    label = np.arange(len(sets))
    while True:  # least member reached over links
        best = np.where(linked, label[None, :], len(sets)).min(axis=1)
        new = label[np.minimum(label, best)]
        if (new == label).all():
            break
        label = new
    keep = pa.array(linked.any(axis=1))
    node = tile.column("node").combine_chunks()
    return pa.table({
        "node": node, "least": node.take(pa.array(label)), "links": pa.array(links.astype(np.int64)),
    }).filter(keep)


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    max_depth: int = MAX_DEPTH,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """One row per document: ``doc_id, row, class_id, n_links, n_copies, kept``.

    ``n_links`` counts the other documents whose similarity reaches the threshold, copies
    included; ``class_id`` is the least doc_id of the connected component; ``kept`` marks the
    one document of each component that a deduplication keeps.
    """
    depth = prefix_depth(threshold, trees, max_depth, target_recall)
    signed = cut_lineage(signatures(docs, width, trees, depth))
    node = F.struct("doc_id", "row")
    classes = cut_lineage(
        signed.where("n > 0").groupBy("set_a", "set_b")
        .agg(F.min(node).alias("node"), F.count(F.lit(1)).alias("copies"), F.first("tries").alias("tries"))
    )
    held = classes.select("node", "copies", "tries", F.posexplode("tries").alias("tree", "prefix"))
    mark = F.xxhash64("node")
    groups = (
        held.groupBy("tree", "prefix")
        .agg(F.count(F.lit(1)).alias("members"), F.bit_xor(mark).alias("mark_a"),
             F.bit_xor(F.xxhash64(mark, F.lit(7))).alias("mark_b"))
        .where("members > 1")
        .groupBy("members", "mark_a", "mark_b")
        .agg(F.min(F.struct("tree", "prefix")).alias("at"))
        .select("at.tree", "at.prefix", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = cut_lineage(
        held.join(groups, ["tree", "prefix"])
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        .select("node", "copies", "tries", "tree", "prefix", "block", other.alias("other"))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("other")
    )
    wanted = tiles.select(F.col("node.row").alias("row")).distinct()
    texts = keyed(docs).join(wanted, "row", "left_semi").dropDuplicates(["row"]).select("row", "text")
    found = cut_lineage(
        tiles.withColumn("row", F.col("node.row")).join(texts, "row").drop("row")
        .groupBy("tree", "prefix", "low", "high")
        .applyInArrow(
            lambda tile: _compare(tile, width, threshold),
            "node struct<doc_id: long, row: long>, least struct<doc_id: long, row: long>, links long",
        )
    )
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    solved = (
        classes.select("set_a", "set_b", "node", "copies")
        .join(labels, "node", "left").join(links, "node", "left")
        .select("set_a", "set_b", "copies", F.coalesce("label", "node").alias("label"),
                F.coalesce("links", F.lit(0)).alias("links"))
    )
    return (
        signed.select("doc_id", "row", "set_a", "set_b", "n")
        .join(solved, ["set_a", "set_b"], "left")
        .select(
            "doc_id", "row",
            F.coalesce("label.doc_id", "label.row", "doc_id", "row").alias("class_id"),
            F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
            F.coalesce("copies", F.lit(1)).alias("n_copies"),
            ((F.col("n") == 0) | (F.col("label.row") == F.col("row"))).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, all columns as they were; texts without words all stay."""
    kept = near_duplicates(docs, **options).where("kept").select("row").distinct()
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
        F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False)).alias("words"),
    ).join(kept, "row", "left_semi")
    one = packed.where("words").dropDuplicates(["row"])
    return one.unionByName(packed.where("NOT words")).select("doc.*")
