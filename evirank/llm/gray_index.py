"""SimHash near duplicates: a hierarchical index in Gray order over the distinct fingerprints.

Fingerprints are sorted by Gray rank, so that neighbours in the order share most bits, and packed into tiles of
``TILE``. A node of the index stands for consecutive fingerprints and holds the bits on which all of them agree
(mask and pattern); ``FANOUT`` nodes in a row make a node of the level above. The search is a self-join of the
index from the root down: a pair of nodes accumulates the differing bits among those that both fix, and is
dropped with everything below once there are more than ``MAX_DIFFERING``. Pairs of tiles that are left are
split once more into leaves of ``LEAF`` fingerprints, pruned alike, and compared bit by bit.

A pair of tiles returns a spanning forest of its links, never all pairs of a cluster, and components follow by
rounds of joins. With D fingerprints a node that fixes k bits meets about C(k, 0..3) others, so the work is
D times a power of log D. Exact copies share a fingerprint and are one entry of the index.

Edge cases: null and wordless texts have fingerprint zero and are linked like others; fewer than three words
are one shingle; repeated rows stay rows; a null id never names a component, unless all of its ids are null;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.components import connected_components
from evirank.llm.tables import stored

WORDS = 3
SEED = 42
MAX_DIFFERING = 3
TILE = 8192
LEAF = 32
FANOUT_BITS = 4
_SHINGLES_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 256


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """SimHash of the text's word shingles: a bit is 1 if more than half of the hashes have it."""
    words = text.lower().split()  # for bytes: ASCII letters and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    borders = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    n = max(1, len(words) - width + 1)
    start = np.concatenate([[0], borders + 1])[:n].tolist()
    end = np.concatenate([borders, [len(joined)]])[-n:].tolist()
    set_bits = np.zeros(64, np.int64)
    for low in range(0, n, _SHINGLES_AT_ONCE):
        spans = zip(start[low:low + _SHINGLES_AT_ONCE], end[low:low + _SHINGLES_AT_ONCE], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(doc_id, code): the fingerprint of every row as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            codes = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, shifted so that signed order is the order of places."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _tiles(codes: DataFrame, parts: int) -> DataFrame:
    """(part, tile, ands, ors, codes): consecutive codes in Gray order, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)

        def row(tile: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "part": part, "tile": number, "ands": int(np.bitwise_and.reduce(tile)),
                "ors": int(np.bitwise_or.reduce(tile)), "codes": tile.tobytes(),
            }], schema=pa.schema([("part", pa.int64()), ("tile", pa.int64()), ("ands", pa.int64()),
                                  ("ors", pa.int64()), ("codes", pa.binary())]))

        for batch in batches:
            held = np.concatenate([held, batch.column("code").to_numpy()])
            while len(held) >= TILE:
                yield row(held[:TILE])
                number, held = number + 1, held[TILE:]
        if len(held):
            yield row(held)

    order = codes.select("code", gray_rank(F.col("code")).alias("rank")).repartitionByRange(parts, "rank")
    return order.sortWithinPartitions("rank").select("code").mapInArrow(
        pack, "part long, tile long, ands long, ors long, codes binary")


def _fixed(nodes: DataFrame) -> DataFrame:
    """(id, mask, pattern): the bits on which all codes of a node agree."""
    mask = F.bitwise_not(F.col("ands").bitwiseXOR(F.col("ors")))
    return nodes.select("id", mask.alias("mask"), F.col("ands").alias("pattern"))


def _levels(tiles: DataFrame) -> list[DataFrame]:
    """Node tables (id, ands, ors) from the tiles up to one root; a parent's id is the child's without its last bits."""
    last = tiles.agg(F.max("id")).first()[0]
    levels = [tiles.select("id", "ands", "ors")]
    while last > 0:
        last >>= FANOUT_BITS
        above = levels[-1].groupBy(F.shiftright("id", FANOUT_BITS).alias("id")).agg(
            F.bit_and("ands").alias("ands"), F.bit_or("ors").alias("ors"))
        levels.append(stored(above))
    return levels


def _close_tiles(levels: list[DataFrame], most: int) -> DataFrame:
    """(a, b): pairs of tiles, a <= b, that no level of the index could tell apart."""
    spark = levels[0].sparkSession
    pairs = spark.range(1).select(
        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("joint"), F.lit(0).alias("differing"))
    for nodes in levels[-2::-1]:
        fixed = _fixed(nodes).withColumn("parent", F.shiftright("id", FANOUT_BITS))
        one, two = ([F.col(c).alias(f"{side}_{c}") for c in ("id", "mask", "pattern")] for side in "ab")
        joint = F.col("a_mask").bitwiseAND(F.col("b_mask"))
        # only bits that neither level above had fixed on both sides can add differences
        new = joint.bitwiseAND(F.bitwise_not("joint"))
        more = F.bit_count(F.col("a_pattern").bitwiseXOR(F.col("b_pattern")).bitwiseAND(new))
        pairs = stored(
            pairs.join(fixed.select(F.col("parent").alias("a"), *one), "a")
            .join(fixed.select(F.col("parent").alias("b"), *two), "b")
            .where(F.col("a_id") <= F.col("b_id"))
            .select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), joint.alias("joint"),
                    (F.col("differing") + more).alias("differing"))
            .where(F.col("differing") <= most))
    return pairs.select("a", "b")


def _merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its set) after joining the sets of i and j."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while True:
            nearer = labels[labels]
            if np.array_equal(nearer, labels):
                break
            labels = nearer


def _leaves(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as leaves (the last one filled up with its last code), their masks and patterns."""
    rows = -(-len(codes) // LEAF)
    filled = np.concatenate([codes, np.repeat(codes[-1:], rows * LEAF - len(codes))]).reshape(rows, LEAF)
    ands = np.bitwise_and.reduce(filled, axis=1)
    return filled, ~(ands ^ np.bitwise_or.reduce(filled, axis=1)), ands


def linked(first: np.ndarray, second: np.ndarray | None, most: int = MAX_DIFFERING) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or inside one) as (code, code)."""
    # numpy counts the bits of a signed number's absolute value, so codes are compared unsigned
    first = first.view(np.uint64)
    second = None if second is None else second.view(np.uint64)
    a, a_mask, a_pattern = _leaves(first)
    if second is None:
        b, b_mask, b_pattern, codes, shift = a, a_mask, a_pattern, a.reshape(-1), 0
    else:
        b, b_mask, b_pattern = _leaves(second)
        codes, shift = np.concatenate([a.reshape(-1), b.reshape(-1)]), a.size
    differing = np.bitwise_count((a_pattern[:, None] ^ b_pattern) & a_mask[:, None] & b_mask)
    close = differing <= most
    if second is None:
        close = np.triu(close)
    rows, columns = np.nonzero(close)
    labels = np.arange(len(codes))
    for low in range(0, len(rows), _PAIRS_AT_ONCE):
        r, c = rows[low:low + _PAIRS_AT_ONCE], columns[low:low + _PAIRS_AT_ONCE]
        n, x, y = np.nonzero(np.bitwise_count(a[r][:, :, None] ^ b[c][:, None, :]) <= most)
        labels = _merged(labels, r[n] * LEAF + x, shift + c[n] * LEAF + y)
    joined = (labels != np.arange(len(codes))) & (codes != codes[labels])
    return codes[joined].view(np.int64), codes[labels[joined]].view(np.int64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for same, first, second in zip(*(batch.column(k) for k in range(3)), strict=True):
            a = np.frombuffer(first.as_py(), np.int64)
            found = linked(a, None if same.as_py() else np.frombuffer(second.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])


def code_links(codes: DataFrame) -> DataFrame:
    """(a, b): links that connect what differs in few bits, enough of them for the components. ``codes`` is distinct."""
    n = codes.count()
    packed = stored(_tiles(codes, max(1, n // (TILE << FANOUT_BITS))))
    last = packed.agg(F.max("tile")).first()[0]
    if last is None:
        return codes.select(F.col("code").alias("a"), F.col("code").alias("b"))
    tiles = packed.withColumn("id", F.col("part") * (1 << int(last).bit_length()) + F.col("tile"))
    pairs = _close_tiles(_levels(tiles), MAX_DIFFERING)
    one, two = (tiles.select(F.col("id").alias(side), F.col("codes").alias(f"{side}_codes")) for side in "ab")
    met = pairs.join(one, "a").join(two, "b").select((F.col("a") == F.col("b")).alias("same"), "a_codes", "b_codes")
    return met.mapInArrow(_link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row; the component is named by its smallest id."""
    rows = stored(fingerprints(docs, id_col, text_col))
    by_code = stored(rows.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    labels = stored(connected_components(code_links(by_code.select("code"))))
    member = by_code.join(labels.select(F.col("node").alias("code"), "label"), "code", "left")
    named = member.select("code", F.coalesce("label", "code").alias("label"), "first_id")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_code = named.select("code", "label").join(least, "label").select("code", "component_id")
    return rows.join(of_code, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
