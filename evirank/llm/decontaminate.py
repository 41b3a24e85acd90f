"""Benchmark decontamination with suffix arrays of the training text.

The documents' words are the shards: every run of rows that a task holds becomes a
suffix array (sorted word suffixes), and every benchmark suffix is found in it by binary
search. Only suffixes that can match are sorted: a match of m words consists of benchmark
words alone, so a suffix must start at least m benchmark words in a row. That is exact,
and it leaves a few hundredths of all positions. Shards are independent, so documents
are never shuffled; a document is always whole inside one shard.

Edge cases: a null or empty text has no words and is clean; an item without words is
ignored; equal items all count; documents are judged row by row, so repeated rows and
repeated or null ids each keep their own result; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evirank.llm.words import Words, word_pieces

WINDOW = 10
#: A benchmark is collected to the driver and sent to every task; larger ones are refused.
MAX_BENCHMARK_BYTES = 256 << 20

FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ("longest_match", pa.int64()), ("hit_spans", pa.string()),
])
FOUND_DDL = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string,"
    " contaminated boolean, longest_match long, hit_spans string"
)


class Suffixes:
    """The benchmark's suffixes, each cut to one window and ready for binary search."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        ids = [i for i, _ in items]
        pieces = list(word_pieces(pa.array([t for _, t in items], pa.string()), limit=1 << 62))
        words = pieces[0][2] if pieces else None
        hashes = words.hash if words is not None else np.zeros(0, np.uint64)
        self.vocabulary, index = np.unique(hashes, return_index=True)
        self.spelling = [words.spelled(i) for i in index] if words is not None else []
        number = (np.searchsorted(self.vocabulary, hashes) + 1).astype(">u4")
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        keys, lengths, owners = [], [], defaultdict(list)
        for t in range(len(ids)):
            first, last = (int(words.first[t]), int(words.first[t + 1]))
            size = min(window, last - first)
            for at in range(first, last - size + 1) if size else ():
                key = number[at:at + size].tobytes().ljust(4 * window, b"\0")
                owners[key, size].append((ids[t], at - first))
        for (key, size), _ in owners.items():
            keys.append(key)
            lengths.append(size)
        order = sorted(range(len(keys)), key=lambda i: (keys[i], lengths[i]))
        self.window = window
        self.owners = [owners[keys[i], lengths[i]] for i in order]
        self.length = np.array([lengths[i] for i in order], np.int64)
        self.low = np.array([keys[i] for i in order], f"S{4 * window}")
        self.high = np.array(
            [keys[i][:4 * lengths[i]].ljust(4 * window, b"\xff") for i in order], f"S{4 * window}"
        )
        self.shortest = int(self.length.min()) if len(self.length) else 0

    def numbers(self, words: Words) -> np.ndarray:
        """Number of each word in the benchmark's vocabulary, 0 for all others."""
        out = np.zeros(len(words), np.uint32)
        maybe = np.flatnonzero(self.known[(words.hash >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.vocabulary, words.hash[maybe])
            at[at == len(self.vocabulary)] = 0
            same = self.vocabulary[at] == words.hash[maybe]
            out[maybe[same]] = at[same] + 1
        return out

    def suffix_array(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and places of the suffixes that start a long enough run of known words."""
        number = self.numbers(words)
        known = np.flatnonzero(number)
        breaks = np.union1d(np.flatnonzero(number == 0), words.first[1:])
        run = breaks[np.searchsorted(breaks, known, side="right")] - known
        place, run = known[run >= self.shortest], run[run >= self.shortest]
        step = np.arange(self.window)
        padded = np.concatenate([number, np.zeros(self.window, np.uint32)])
        table = np.where(step < run[:, None], padded[place[:, None] + step], 0)
        keys = np.ascontiguousarray(table.astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        return keys[order], place[order]

    def occurrences(self, words: Words) -> list[tuple[int, np.ndarray]]:
        """(window, places where it starts) for every window found, compared word by word."""
        if not self.shortest or not len(words):
            return []
        keys, place = self.suffix_array(words)
        first = np.searchsorted(keys, self.low, side="left")
        last = np.searchsorted(keys, self.high, side="right")
        out = []
        for w in np.flatnonzero(last > first):
            spelled = [
                self.spelling[int.from_bytes(self.low[w].ljust(4 * self.window, b"\0")[4 * k:4 * k + 4]) - 1]
                for k in range(self.length[w])
            ]
            same = [
                p for p in place[first[w]:last[w]].tolist()
                if all(words.spelled(p + k) == s for k, s in enumerate(spelled))
            ]
            if same:
                out.append((int(w), np.array(same)))
        return out


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True))


def _judge(words: Words, suffixes: Suffixes) -> Iterator[tuple]:
    """(words, hit words, items, longest verbatim match, hit spans) of every text."""
    hit_edges = np.zeros(len(words) + 1, np.int64)
    text = words.text_of()
    items: dict[int, set[str]] = defaultdict(set)
    diagonals: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
    for w, places in suffixes.occurrences(words):
        size = int(suffixes.length[w])
        np.add.at(hit_edges, places, 1)
        np.add.at(hit_edges, places + size, -1)
        for p, t in zip(places.tolist(), text[places].tolist(), strict=True):
            for owner, offset in suffixes.owners[w]:
                items[t].add(owner)
                diagonals[t][owner, p - offset, size].append(p)
    hit = np.cumsum(hit_edges)[:-1] > 0
    for t in range(len(words.first) - 1):
        a, b = int(words.first[t]), int(words.first[t + 1])
        longest = 0
        for (_, _, size), places in diagonals[t].items() if t in diagonals else ():
            places = np.unique(places)
            longest = max(longest, size - 1 + max(
                len(run) for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
            ))
        yield b - a, int(hit[a:b].sum()), sorted(items.get(t, ())), longest, _spans(hit[a:b])


def _suffixes(benchmark: DataFrame, window: int) -> Suffixes:
    """Collect the benchmark after checking its size; items without an id keep the id ''."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("string").alias("text"),
    ).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes of text; the bound is {MAX_BENCHMARK_BYTES}")
    return Suffixes([(r.item, r.text) for r in items.toLocalIterator()], window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words inside any occurrence of a benchmark window.

    A window is ``window`` consecutive words of an item (``item_id``, ``text``); an item of
    fewer words is one window. Adds the longest verbatim match in words and the hit word
    ranges (``start:end``, comma-joined) to the counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_suffixes(benchmark, window))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = shared.value
        for batch in batches:
            rows = []
            for first, _, words in word_pieces(batch.column("text")):
                for k, (n, n_hit, items, longest, spans) in enumerate(_judge(words, suffixes)):
                    rows.append((
                        batch.column("doc_id")[first + k].as_py(), n, n_hit, len(items),
                        hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, longest,
                        ",".join(f"{a}:{b}" for a, b in spans),
                    ))
            columns = list(zip(*rows, strict=True)) or [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(judge, FOUND_DDL)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(_suffixes(benchmark, window))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, _, words in word_pieces(batch.column(at)):
                for _, places in shared.value.occurrences(words):
                    clean[first + words.text_of()[places]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
