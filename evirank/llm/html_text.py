"""Main text of web pages by the maximum-scoring contiguous subsequence of tokens.

A page is a sequence of words and tags. Words score positive, the more so the more often
words of that context (innermost block, in a link or not) belong to the main region of
labelled pages; tags score negative, the more so the more often they stand outside. One
linear scan finds the contiguous region with the highest sum. Labelled pages are those
of the table that mark their main region themselves (``article``, ``main``, ``role=main``,
``itemprop=articleBody``); a small fixed prior stands for them where there are none. Inside
the region, elements that are never main text are left out.

Edge cases: null or empty html, or a page without words, gives an empty text; broken markup
(unclosed elements, cut tags, comments or scripts) is read as browsers do, to the end of
the page; pages are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample that the weights are fitted on; all pages are read for the result.
SAMPLE_PAGES = 3000
MAX_FEATURES = 5000
TAG_COST = 4.0  # what a tag that is always outside costs, in words that are always inside
_FLOOR = 0.02

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre"
    " section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("nav aside footer form head button dialog menu".split())
_CLOSED_BY = {  # an open element (key) ends where one of these begins
    "p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
#: Parts of class, id and role values that mark menus, notices, adverts and reader comments.
_NEVER_WORD = frozenset(
    "ad ads adbox adslot advert adverts advertisement banner sponsor sponsored promo promotion"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc"
    " sidebar aside footer masthead topbar toolbar search searchbox searchform"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup"
    " login share sharing social related recommended recommendations trending popular widget"
    " comment comments commentlist disqus replies respond reply complementary contentinfo".split()
)
#: (inside, outside) counts that the table's own labelled pages are added to.
_PRIOR = {
    "w:p": (20, 1), "w:h1": (6, 1), "w:h2": (4, 1), "w:h3": (4, 2), "w:li": (2, 2), "w:blockquote": (8, 1),
    "w:pre": (6, 1), "w:td": (2, 2), "w:div": (3, 3), "w:article": (8, 1), "w:main": (6, 1),
    "w:section": (4, 2), "w:body": (2, 2), "w:a": (1, 3), "w:footer": (0, 8), "w:nav": (0, 8),
    "w:aside": (0, 8), "w:header": (1, 4), "t:p": (20, 2), "t:b": (4, 1), "t:i": (4, 1), "t:em": (4, 1),
    "t:strong": (4, 1), "t:br": (4, 2), "t:h1": (4, 2), "t:h2": (4, 2), "t:li": (2, 4), "t:a": (2, 4),
    "t:div": (1, 4), "t:nav": (0, 8), "t:footer": (0, 8), "t:ul": (1, 4), "t:article": (1, 2),
}


def _marks(attrs: str) -> list[str]:
    """Words of the class, id, role and itemprop values."""
    if "=" not in attrs:
        return []
    values = [
        a or b or c for name, a, b, c in _ATTR.findall(attrs)
        if name.lower() in ("class", "id", "role", "itemprop")
    ]
    return re.split(r"[^a-z0-9]+", " ".join(values).lower()) if values else []


def _is_main(name: str, marks: list[str]) -> bool:
    return name in ("article", "main") or "articlebody" in marks or "main" in marks


class _Element:
    __slots__ = ("name", "context", "never", "main")

    def __init__(self, name: str, context: str, never: bool, main: bool):
        self.name, self.context, self.never, self.main = name, context, never, main


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(feature, text, never, main): text nodes have a w: feature, tags a t: feature and no text.

    ``never`` tells whether the token stands in an element that is no main text; ``main``
    whether it stands in a region that the page marks as its main one.
    """
    stack = [_Element("#page", "body", False, False)]
    links, at, n = 0, 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        end = found.start() if found else n
        if end > at:
            top = stack[-1]
            yield ("w:a" if links else f"w:{top.context}"), page[at:end], top.never, top.main
        if not found:
            return
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        closing = bool(found["close"] or found["close2"])
        if name in _RAW and not closing:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else n
            continue
        if closing:
            yield f"t:{name}", "", stack[-1].never, stack[-1].main
            if name == "a":
                links = max(0, links - 1)
            if name in _BLOCK:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].name == name), 0)
                if depth:
                    del stack[depth:]
            continue
        if name == "a":
            links += 1
        if name in _BLOCK:
            links = links if name != "li" else 0
            while len(stack) > 1 and name in _CLOSED_BY.get(stack[-1].name, ()):
                stack.pop()
            marks = _marks(found["attrs"] or found["attrs2"] or "")
            top, first = stack[-1], next((m for m in marks if m), "")
            never = top.never or name in _NEVER or (name == "header" and not top.main) or (
                name not in ("html", "body", "article", "main") and not _NEVER_WORD.isdisjoint(marks)
            )
            if name not in _VOID:
                context = f"{name}.{first}" if first else name
                stack.append(_Element(name, context, never, top.main or _is_main(name, marks)))
            yield f"t:{name}", "", never, top.main
        else:
            yield f"t:{name}", "", stack[-1].never, stack[-1].main


def page_counts(page: str) -> Counter:
    """(feature, inside) counts of a page that marks its main region, else nothing."""
    seen: Counter = Counter()
    marked = False
    for feature, text, never, main in tokens(page):
        inside = main and not never
        marked |= main
        if text:
            if n := len(text.split()):
                seen[feature, inside] += n
        else:
            seen[feature, inside] += 1
    return seen if marked else Counter()


def learn(pages: DataFrame) -> dict[str, float]:
    """Share inside the main region of every feature, from a bounded sample of labelled pages."""
    total = pages.count()
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    marked = F.col("html").rlike(r"(?i)<(article|main)[\s>]|articleBody|role=.?main")
    sample = pages.where(place <= min(1.0, SAMPLE_PAGES / max(total, 1))).where(marked).select(
        F.col("html").cast("string").alias("html")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                seen.update(page_counts(page))
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()),
            pa.array(list(seen.values()), pa.int64()),
        ], names=["feature", "inside", "n"])

    counted = (
        sample.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature")
        .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "feature").limit(MAX_FEATURES)
    )
    counts = {k: [i + 0.5, i + o + 1.0] for k, (i, o) in _PRIOR.items()}
    for r in counted.collect():
        into = counts.setdefault(r["feature"], [0.5, 1.0])
        into[0] += r["inside"]
        into[1] += r["n"]
    return {k: i / n for k, (i, n) in counts.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, after the last) of the contiguous range with the highest positive sum; (0, 0) if none."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def main_text(page: str | None, shares: dict[str, float]) -> str:
    """Blocks of the best region, joined by an empty line."""
    seen, scores = [], []
    for token in tokens(page or ""):
        feature, text, never, main = token
        share = shares.get(feature)
        if share is None:
            share = shares.get(feature.partition(".")[0], 0.5)
        if text:
            words = len(text.split())
            scores.append(0.0 if never else words * max(share, _FLOOR))
        else:
            # an advert or form in the middle of a marked main region does not end it
            outside = float(not main) if never else 1 - share
            scores.append(-TAG_COST * max(outside, _FLOOR))
        seen.append(token)
    first, last = best_region(scores)
    blocks: list[str] = []
    open_block: list[str] = []
    for feature, text, never, _ in seen[first:last]:
        if text:
            if not never:
                open_block.append(text)
        elif feature[2:] in _BLOCK:
            blocks.append("".join(open_block))
            open_block = []
        elif feature == "t:br":
            open_block.append(" ")
    blocks.append("".join(open_block))
    spaced = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in spaced if b)


def extract(pages: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    shared = pages.sparkSession.sparkContext.broadcast(learn(pages) if shares is None else shares)
    narrow = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array(list(map(len, texts)), pa.int64()),
            ], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "html")
    return narrow.mapInArrow(read, f"{kinds}, text string, n_chars long")
