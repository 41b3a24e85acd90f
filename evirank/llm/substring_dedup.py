"""Repeated passages by content-defined chunking with a gear rolling hash.

Each text is cut into chunks of words where a gear hash over the last four words is the
least among its ``REACH`` neighbours on both sides: cuts depend on nearby words only, so
an insertion shifts no later cut. Chunks are deduplicated by digest over all documents. Runs
of repeated chunks that follow each other in the same partner document are passages; a run
that is shorter than ``min_words`` is extended by comparing all windows of ``min_words``
words around it by digest. A window whose own words settle fewer than two cuts (text that
repeats itself every few words has none) may hold no whole chunk, so all such windows are
compared by digest too. Any other window holds a whole chunk wherever it stands, so short
repeated lines and passages are told apart exactly.

Windows go through one exchange. Of equal windows in one block of texts only those of its
least document are sent, so a passage that every document holds puts one row per block into its
task; there the sorted rows pass by as a stream and no group is held.

Edge cases: null and empty texts have no words and no passages; a text shorter than
``min_words`` never has one; repeats inside one document alone do not count; rows with the
same doc_id and text are one document (they share the result); extra columns are ignored by
``repeated_passages`` and passed through by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.words import Words, mix, range_hash, word_pieces

MIN_WORDS = 50
REACH = 5
_GEAR_WORDS = 4
_SLACK = REACH + _GEAR_WORDS  # words beyond a chunk's end that decide on its cut
_GEAR_SHIFT = 8  # bits that the 32-bit hash moves per word, so that it forgets after four

# Passages found (without digest) and windows still to compare, packed since they are shuffled:
# ``tail`` is a second digest of 32 bits above the first word, ``size`` the number of words above the
# bits "own" and "known" (repeated in its own block). 96 bits tell 10**13 windows apart.
PROPOSAL_DDL = "row long, digest long, tail long, size long"
PASSAGE_DDL = "row long, start int, end int, own boolean"


def _gear(words: Words) -> np.ndarray:
    """Rolling gear hash at every word: the last four words, older ones shifted out."""
    value = (words.hash & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = value.copy()
    for k in range(1, _GEAR_WORDS):
        out[k:] += value[:-k] << np.uint32(_GEAR_SHIFT * k)
    return mix(out.astype(np.uint64)).astype(np.uint32)


def chunk_ends(words: Words) -> np.ndarray:
    """Ends (exclusive) of all chunks, in order; every text ends a chunk."""
    n = len(words)
    gear = _gear(words)
    cut = np.ones(n, bool)
    for k in range(1, REACH + 1):
        cut[k:] &= gear[k:] < gear[:-k]
        cut[:-k] &= gear[:-k] <= gear[k:]
    cut[:REACH] = cut[n - REACH:] = False
    ends = np.union1d(np.flatnonzero(cut) + 1, words.first[1:])
    return ends[ends > 0]


def chunks(docs: DataFrame) -> DataFrame:
    """(row, digest, at, size): chunks of at least ``REACH`` words of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, last, words in word_pieces(batch.column("text")):
                if not len(words):
                    continue
                ends = chunk_ends(words)
                starts = np.concatenate([[0], ends[:-1]])
                text = np.searchsorted(words.first, starts, side="right") - 1
                keep = ends - starts >= REACH
                starts, ends, text = starts[keep], ends[keep], text[keep]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row[first:last][text]),
                    pa.array(range_hash(words.hash, starts, ends).view(np.int64)),
                    pa.array((starts - words.first[text]).astype(np.int32)),
                    pa.array((ends - starts).astype(np.int32)),
                ], names=["row", "digest", "at", "size"])

    return keyed(docs).select("row", "text").mapInArrow(cut, "row long, digest long, at int, size int")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("row", F.xxhash64("doc_id", "text"))


def _runs(found: list[dict]) -> list[tuple[int, int, int, list[int]]]:
    """(start, end, partner, turns) of maximal runs of adjoining chunks in step with one partner.

    ``turns`` are the places inside the run where the set of documents that hold the chunks changes.
    """
    out: list[list] = []
    step = holders = None
    for c in sorted(found, key=lambda c: c["at"]):
        here = (c["partner"], c["partner_at"] - c["at"])
        if out and out[-1][1] == c["at"] and here == step:
            if c["holders"] != holders:
                out[-1][3].append(c["at"])
            out[-1][1] += c["size"]
        else:
            out.append([c["at"], c["at"] + c["size"], c["partner"], []])
            step = here
        holders = c["holders"]
    return [tuple(r) for r in out]


def _passages(
    row: int, found: list[dict], hashes: np.ndarray, cuts: np.ndarray, min_words: int
) -> Iterator[tuple]:
    """(start, end, own, digest_a, digest_b): settled passages without digests, else windows to compare.

    A passage may reach past its whole chunks on both sides, so windows over the next chunk,
    and over the words that can still move a cut, are compared there too. Where the holders of
    a settled passage change, another document's passage may begin or end: the windows
    around that place are sent so that it finds them.
    """
    n = len(hashes)
    windows: set[int] = set()
    for start, end, partner, turns in _runs(found):
        # the nearest cuts with a whole chunk in between: smaller ones are in no run
        before = cuts[max(np.searchsorted(cuts, start - REACH, side="right") - 1, 0)]
        after = cuts[min(np.searchsorted(cuts, end + REACH), len(cuts) - 1)]
        low = max(0, min(before, start) - _SLACK)
        high = min(n, max(after, end) + _SLACK) - min_words  # last window that ends there
        if end - start >= min_words:
            yield start, end, row < partner, None, None
            windows.update(range(low, start))
            windows.update(range(end - min_words + 1, high + 1))
            for turn in turns:
                windows.update(range(max(start, turn - min_words), min(turn, n - min_words) + 1))
        else:
            windows.update(range(max(0, min(low, end - min_words)), min(n - min_words, max(high, start)) + 1))
    for start, end, a, b in _merged(hashes, np.array(sorted(windows), np.int64), min_words):
        yield start, end, None, a, b


def _merged(hashes: np.ndarray, at: np.ndarray, min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, digest_a, digest_b) of the windows at the sorted places ``at``.

    Equal windows that overlap (filler that repeats itself) go as one range.
    """
    if not len(at):
        return
    pair = [range_hash(hashes, at, at + min_words, seed).view(np.int64).tolist() for seed in (11, 12)]
    open_ranges: dict[tuple[int, int], list[int]] = {}
    for s, a, b in zip(at.tolist(), *pair, strict=True):
        last = open_ranges.get((a, b))
        if last and s <= last[1]:
            last[1] = s + min_words
            continue
        if last:
            yield *last, a, b
        open_ranges[a, b] = [s, s + min_words]
    for (a, b), (s, e) in open_ranges.items():
        yield s, e, a, b


def _proposals(found: list[tuple]) -> pa.RecordBatch:
    """Proposals of one block of texts from (row, start, end, own, digest_a, digest_b) tuples.

    Equal windows of several documents are settled here, apart from those of the least document.
    """
    row, start, end, own, digest_a, digest_b = (list(c) for c in zip(*found, strict=True))
    is_window = np.array([a is not None for a in digest_a])
    known = np.zeros(len(found), bool)
    settled = ~is_window
    at = np.flatnonzero(is_window)
    if len(at):
        a, b, r = (np.array([c[i] for i in at], np.int64) for c in (digest_a, digest_b, row))
        order = np.lexsort((r, b, a))
        a, b, r = a[order], b[order], r[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(first) - 1
        least = r[first]
        most = r[np.append(np.flatnonzero(first)[1:], len(r)) - 1]
        known[at[order]] = (least < most)[group]
        settled[at[order]] = r != least[group]
    start, end = np.array(start, np.int64), np.array(end, np.int64)
    second = np.array([0 if b is None else b for b in digest_b], np.int64)
    own = np.array([bool(o) for o in own])  # windows are owned, or not, once they are compared
    return pa.RecordBatch.from_arrays([
        pa.array(row, pa.int64()),
        pa.array(np.array([0 if a is None else a for a in digest_a], np.int64), mask=settled),
        pa.array(second << 32 | start), pa.array((end - start) << 2 | own.astype(np.int64) << 1 | known),
    ], names=["row", "digest", "tail", "size"])


def stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """Windows whose own words settle fewer than two cuts, as proposals."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for first, last, words in word_pieces(batch.column("text")):
                if not len(words):
                    continue
                at = _unsettled(words, chunk_ends(words), min_words)
                text = np.searchsorted(words.first, at, side="right") - 1
                out = []
                for some in np.split(at, np.flatnonzero(np.diff(text)) + 1) if len(at) else ():
                    k = int(np.searchsorted(words.first, some[0], side="right")) - 1
                    a, b = words.first[k:k + 2]
                    out += [(int(row[first + k]), *w[:2], None, *w[2:])
                            for w in _merged(words.hash[a:b], some - a, min_words)]
                if out:
                    yield _proposals(out)

    return keyed(docs).select("row", "text").mapInArrow(scan, PROPOSAL_DDL)


def _unsettled(words: Words, ends: np.ndarray, min_words: int) -> np.ndarray:
    """Starts of the windows inside one text in which fewer than two cuts depend on its words alone."""
    at = np.arange(max(len(words) - min_words + 1, 0))
    text_end = words.first[np.searchsorted(words.first, at, side="right")]
    at = at[at + min_words <= text_end]
    cuts = np.searchsorted(ends, at + min_words - REACH, side="right") - np.searchsorted(ends, at + _SLACK)
    return at[cuts < 2]


def _propose(docs: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Passages and windows of the documents that hold repeated chunks."""
    lists = found.groupBy("row").agg(
        F.collect_list(F.struct("at", "size", "partner", "partner_at", "holders")).alias("found")
    )
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.column("row").to_pylist(), batch.column("found")
            for first, last, words in word_pieces(batch.column("text")):
                ends = chunk_ends(words)
                out = []
                for k in range(first, last):
                    a, b = words.first[k - first:k - first + 2]
                    cuts = np.concatenate([[0], ends[np.searchsorted(ends, a, side="right"):
                                                     np.searchsorted(ends, b, side="right")] - a])
                    found = lists[k].as_py()
                    out += [(rows[k], *p) for p in _passages(rows[k], found, words.hash[a:b], cuts, min_words)]
                if out:
                    yield _proposals(out)

    texts = keyed(docs).select("row", "text").join(lists, "row").dropDuplicates(["row"])
    return texts.select("row", "text", "found").mapInArrow(propose, PROPOSAL_DDL)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages found, and windows that two documents hold, of proposals sorted by digests and row.

    Only the rows of the last digest's least document wait for the next batch.
    """

    def passages(row, start, size, own):
        end = (start + (size >> 2)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(row), pa.array(start.astype(np.int32)), pa.array(end), pa.array(own)],
            names=["row", "start", "end", "own"],
        )

    waiting = None  # arrays of the rows carried over, and whether each was sent already
    for batch in batches:
        window = batch.column("digest").is_valid()
        row, tail, size = (batch.filter(pc.invert(window)).column(c).to_numpy() for c in ("row", "tail", "size"))
        if len(row):
            yield passages(row, tail & 0xFFFFFFFF, size, (size & 2) > 0)
        rest = batch.filter(window)
        if not len(rest):
            continue
        columns = [rest.column(c).to_numpy() for c in ("digest", "tail", "row", "size")]
        columns.append(np.zeros(len(rest), bool))
        if waiting is not None:
            columns = [np.concatenate(c) for c in zip(waiting, columns, strict=True)]
        digest, tail, row, size, sent = columns
        second = tail >> 32
        first = np.concatenate([[True], (digest[1:] != digest[:-1]) | (second[1:] != second[:-1])])
        group, begin = np.cumsum(first) - 1, np.flatnonzero(first)
        least = row[begin]
        most = row[np.append(begin[1:], len(row)) - 1]
        # a row that was sent stands for a group known to be repeated
        repeated = (most != least) | np.logical_or.reduceat((size & 1 > 0) | sent, begin)
        keep = repeated[group] & ~sent
        if keep.any():
            yield passages(row[keep], tail[keep] & 0xFFFFFFFF, size[keep], (row == least[group])[keep])
        last = np.arange(begin[-1], len(row))
        last = last[:1] if repeated[-1] else last  # one sent row keeps the least document in mind
        waiting = [c[last] for c in columns]
        waiting[4] = np.full(len(last), bool(repeated[-1]))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, start, end, own): word ranges of ``min_words`` or more that another document repeats.

    ``own`` marks the passages that a deduplication keeps in this document because no
    document with a smaller row hash is their partner. Ranges may overlap; ``row`` is
    ``xxhash64(doc_id, text)``.
    """
    # cut twice rather than stored: the chunk table would be larger than the texts
    cut = chunks(docs)
    place = F.struct("row", "at")
    repeated = (
        cut.groupBy("digest").agg(
            F.min(place).alias("low"), F.max(place).alias("high"),
            F.hash(F.bit_xor("row"), F.count("row")).alias("holders"),
        )
        .where("low.row < high.row")
    )
    partner = F.when(F.col("low.row") == F.col("row"), F.col("high")).otherwise(F.col("low"))
    found = (
        cut.join(repeated, "digest")
        .select("row", "at", "size", "holders", partner.alias("p"))
        .select("row", "at", "size", "holders", F.col("p.row").alias("partner"),
                F.col("p.at").alias("partner_at"))
    )
    proposed = _propose(docs, found, min_words).unionByName(stretches(docs, min_words))
    return (
        proposed.repartition(F.coalesce("digest", "row"))
        .sortWithinPartitions("digest", F.shiftright("tail", 32), "row")
        .mapInArrow(_compare, PASSAGE_DDL)
    )


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Union of (start, end) ranges as disjoint sorted ranges."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def summarize(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, words in repeated passages, passages, their word ranges."""
    merged = merged_passages(repeated_passages(docs, min_words))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
        )
        .join(merged, "row", "left")
        .select(
            "doc_id",
            F.expr("coalesce(aggregate(spans, 0L, (s, x) -> s + x.end - x.start), 0L)").alias("n_repeated"),
            F.expr("coalesce(aggregate(extra, 0L, (s, x) -> s + x.end - x.start), 0L)").alias("n_removed"),
            F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_passages"),
            F.expr("coalesce(array_join(transform(spans, x -> concat(x.start, ':', x.end)), ','), '')")
            .alias("spans"),
            F.coalesce(F.size("spans") > 0, F.lit(False)).alias("repeated"),
        )
    )


def merged_passages(passages: DataFrame) -> DataFrame:
    """(row, spans, extra): merged ranges of each document; ``extra`` without those it keeps."""
    # ranges of a document: bounded by its words
    merged = """
        aggregate(array_sort({spans}), cast(array() as array<struct<start:int,end:int>>), (out, x) ->
          CASE WHEN size(out) > 0 AND x.start <= element_at(out, -1).end
               THEN concat(slice(out, 1, size(out) - 1), array(named_struct(
                      'start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, x.end))))
               ELSE concat(out, array(x)) END)"""
    span = F.struct(F.col("start"), F.col("end"))
    return (
        passages.groupBy("row")
        .agg(F.collect_set(span).alias("all"), F.collect_set(F.when(~F.col("own"), span)).alias("some"))
        .select("row", F.expr(merged.format(spans="all")).alias("spans"),
                F.expr(merged.format(spans="some")).alias("extra"))
    )


def _without(text: str, spans: list[dict], words: Words, k: int) -> str:
    """The text without the word ranges; ``k`` is its number among the texts of ``words``."""
    raw = text.encode()
    first = int(words.first[k])
    origin = int(words.at[k])
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at:int(words.start[first + s["start"]]) - origin])
        at = int(words.end[first + s["end"] - 1]) - origin
    return (b"".join(kept) + raw[at:]).decode()


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated passages cut out of ``text``, except in their first owner."""
    merged = merged_passages(repeated_passages(docs, min_words)).select("row", "extra")
    text_at = docs.columns.index("text")
    packed = docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
    ).join(merged, "row", "left").select("doc", "extra")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, extra = batch.column("doc").flatten(), batch.column("extra").to_pylist()
            texts = columns[text_at].to_pylist()
            for first, last, words in word_pieces(columns[text_at]):
                for k in range(first, last):
                    if extra[k]:
                        texts[k] = _without(texts[k], extra[k], words, k - first)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return packed.mapInArrow(remove, docs.schema)
