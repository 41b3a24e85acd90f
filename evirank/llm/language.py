"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text per language. A text is
parsed from left to right into the longest phrases that occur in the sample; the fewer
phrases per letter a language needs, the closer it is (Ziv and Merhav's cross parsing).
The automaton is a dense transition table, and a task parses many pieces of many texts
at once: texts are cut into pieces of ``PIECE`` symbols, every symbol is read, and phrases
are summed over the pieces.

Edge cases: a null text or one without a Unicode letter is ``und`` with score 0; ties go to the
language that sorts first; without labelled rows every text is ``und``; rows are judged one
by one, so repeated rows agree; a null doc_id is never learned from and not held out.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample the model is fitted on; predictions read all rows whole.
SAMPLE_DOCS = 60  # per language, chosen by hash
SAMPLE_SYMBOLS = 24_000  # per language, the same share of each sampled text
MAX_LANGUAGES = 200
PIECE = 512
_LANES = 1 << 15  # pieces parsed at once
_SPACE = 0


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _without_stray(text: str, marks: set[str]) -> str:
    """The text with a space for every mark that follows no letter, as after an emoji or a digit."""
    out, after = list(text), False
    for i, c in enumerate(text):
        if c not in marks:
            after = c.isalpha()
        elif not after:
            out[i] = " "
    return "".join(out)


def letters_of(text: str | None) -> bytes:
    """Lower-cased letters (with their marks) in UTF-8, each run of anything else as one space."""
    if not text:
        return b""
    if not text.isascii():
        kinds = {c: unicodedata.category(c)[0] for c in set(text) if not c.isascii()}
        text = text.translate({ord(c): " " for c, kind in kinds.items() if kind not in "LM"})
        if marks := {c for c, kind in kinds.items() if kind == "M"}:
            text = _without_stray(text, marks)
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    keep = (raw >= 0x80) | ((raw >= 0x61) & (raw <= 0x7A))
    out = np.where(keep, raw, np.uint8(0x20))
    keep[1:] |= keep[:-1]
    return out[keep].tobytes()


@dataclass
class Parser:
    """Transition tables of one suffix automaton per language over a shared byte alphabet."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, the last symbol is "never seen"
    tables: list[np.ndarray]  # [state, symbol] -> state, -1 where the phrase ends

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases that each language needs for each text."""
        total = np.zeros((len(texts), len(self.tables)), np.int64)
        pieces = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), PIECE)]
        for low in range(0, len(pieces), _LANES):
            some = pieces[low:low + _LANES]
            # longest first, so that the pieces still being read are always a prefix
            some.sort(key=lambda p: p[1] + PIECE - len(texts[p[0]]))
            size = np.array([min(PIECE, len(texts[i]) - at) for i, at in some])
            grid = np.full((len(some), PIECE), 0x20, np.uint8)
            for k, (i, at) in enumerate(some):
                grid[k, :size[k]] = np.frombuffer(texts[i], np.uint8, size[k], at)
            grid = np.ascontiguousarray(self.symbol[grid].T)
            alive = np.searchsorted(-size, -np.arange(PIECE), side="left")
            owner = np.array([i for i, _ in some])
            for n, table in enumerate(self.tables):
                flat, width = table.ravel(), table.shape[1]
                state = np.zeros(len(some), np.int32)
                count = np.ones(len(some), np.int32)  # the phrase that is open at the end
                for step in range(int(size[0])):
                    m = alive[step]
                    symbol = grid[step, :m]
                    state_m = flat[state[:m] * width + symbol]
                    ended = state_m < 0
                    count[:m] += ended
                    np.copyto(state_m, np.maximum(flat[symbol], 0), where=ended)
                    state[:m] = state_m
                total[:, n] += np.bincount(owner, count, len(texts)).astype(np.int64)
        return total


def suffix_automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transition table of the automaton that accepts all substrings; -1 means none."""
    size = 2 * len(symbols) + 2
    table = np.full((size, width), -1, np.int32)
    link, length, last, made = [-1] * size, [0] * size, 0, 1
    for c in symbols.tolist():
        new, made = made, made + 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and table[p, c] < 0:
            table[p, c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = int(table[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy, made = made, made + 1
                length[copy], link[copy] = length[p] + 1, link[q]
                table[copy] = table[q]
                while p != -1 and table[p, c] == q:
                    table[p, c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return table[:made]


def _excerpt(letters: bytes, size: int, place: int) -> bytes:
    """``size`` bytes from a place that the hash ``place`` picks, moved on to where a character begins."""
    at = place // 5 % (max(len(letters) - size, 0) + 1)
    while at < len(letters) and letters[at] & 0xC0 == 0x80:
        at += 1
    return letters[at:at + size]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Parser:
    """Fit one automaton per label on a bounded sample of the rows that are not held out.

    Rows are chosen by a hash against a rate from the label counts; the sampled texts come
    to the driver (at most about ``SAMPLE_DOCS`` excerpts for each label).
    """
    known = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    ).where(
        F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id")
    )
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels; they are meant to be languages")
    if not counts:
        return Parser([], np.zeros(256, np.uint8), [])
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * SAMPLE_DOCS / r["count"]))])
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # excerpts keep the driver's share bounded whatever the texts are; they begin at a hashed
    # place, so that headers that documents share are no more of the sample than of the texts
    room = F.greatest(F.length("text") - 4 * SAMPLE_SYMBOLS, F.lit(0)) + 1
    begin = F.pmod(F.xxhash64("id", F.lit(6)), room).cast("int") + 1
    chosen = known.where(place < rate[F.col("lang")]).select(
        "lang", "id", F.substring("text", begin, F.lit(4 * SAMPLE_SYMBOLS)).alias("text")
    ).collect()
    samples: dict[str, list[bytes]] = defaultdict(list)
    places: dict[str, list[int]] = defaultdict(list)
    for r in sorted(chosen, key=lambda r: (r["lang"], r["id"])):
        if (letters := letters_of(r["text"])) and len(samples[r["lang"]]) < 2 * SAMPLE_DOCS:
            samples[r["lang"]].append(letters)
            places[r["lang"]].append(crc32(r["id"].encode()))
    languages = sorted(k for k, v in samples.items() if v)
    joined = {}
    for name in languages:
        longest = max(map(len, samples[name]))
        share = SAMPLE_SYMBOLS // len(samples[name]) + 1
        while share < longest and sum(min(share, len(t)) for t in samples[name]) < SAMPLE_SYMBOLS:
            share *= 2
        joined[name] = b" ".join(
            _excerpt(t, share, at) for t, at in zip(samples[name], places[name], strict=True)
        )[:SAMPLE_SYMBOLS]
    seen = sorted(set(b"".join(joined.values())) | {0x20})
    symbol = np.full(256, len(seen), np.uint8)
    symbol[seen] = np.arange(len(seen))
    tables = [
        suffix_automaton(symbol[np.frombuffer(joined[name], np.uint8)], len(seen) + 1) for name in languages
    ]
    return Parser(languages, symbol, tables)


def _judged(parser: Parser, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Predicted label and score of every text.

    The score is how far the second language's phrases exceed the winner's: 0 for a tie,
    near 1 where any other language needs many times the phrases.
    """
    letters = [letters_of(t) for t in texts]
    empty = np.array([not t.strip() for t in letters], bool)
    if not parser.languages or not texts:
        return ["und"] * len(texts), [0.0] * len(texts)
    phrases = parser.phrases(letters)
    best = np.where(empty, len(parser.languages), phrases.argmin(axis=1))
    ranked = np.sort(phrases, axis=1)
    score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if len(parser.languages) > 1 else np.ones(len(texts))
    names = np.array([*parser.languages, "und"], object)[best]
    return names.tolist(), np.where(empty, 0.0, score).tolist()


_ROWS = 1000  # texts parsed together


def identify(docs: DataFrame, parser: Parser | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; fits the parser if none is given."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if parser is None else parser)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for low in range(0, batch.num_rows, _ROWS):
                some = _judged(shared.value, batch.column("text")[low:low + _ROWS].to_pylist())
                names += some[0]
                scores += some[1]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("held_out"),
                pa.array(names, pa.string()), pa.array(scores, pa.float64()),
            ], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(
        F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, parser: Parser | None = None) -> DataFrame:
    """The documents whose text has a language, all columns as they were; ``und`` is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if parser is None else parser)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[bool] = []
            for low in range(0, batch.num_rows, _ROWS):
                names, _ = _judged(shared.value, batch.column(at)[low:low + _ROWS].to_pylist())
                kept += [n != "und" for n in names]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
