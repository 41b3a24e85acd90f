"""Personal data by weak supervision.

Candidates come from the strict patterns and from looser ones. Labelers (pattern, checksum,
gazetteer, context and border) vote on every candidate: for, against or nothing. The votes of
all documents are counted by pattern; expectation-maximisation over those counts estimates
how reliable each labeler is for each kind, and a logistic span classifier is trained on
the resulting soft labels. Only the counts reach the driver (their number is bounded by the
vote patterns), never spans or texts.

The strict ("base") spans always stay; the classifier adds spans that overlap none of them.

Edge cases: a null text is empty; an empty table or one without candidates gives base spans
only; texts are read whole; rows are judged one by one, so repeated rows agree; positions are
code points, ends exclusive; extra columns are ignored by ``find`` and passed through by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "national_id")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "border")
THRESHOLD = 0.5
CONTEXT = 40  # characters before a candidate in which cue words count

# Fixed values of the base spans. Where a run of the class cannot end otherwise, it is taken
# possessively, and a number is only tried at its first digit: same matches, linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE_PHONE = re.compile(r"(?:\([0-9]{2,5}\)[ ]?|0[0-9]{1,4}[ ./-]|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}")
_NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NUMBERS = re.compile(r"\(?[0-9][0-9 ()./-]*[0-9]")
_SPELLED_MAIL = re.compile(
    r"[A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\)|\sat\s)\s?[A-Za-z0-9-]++(?:\s?(?:\[dot\]|\(dot\)|\sdot\s|\.)\s?[A-Za-z0-9-]++)++"
)
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur", "Mme")
_TITLED = re.compile(rf"\b(?:{'|'.join(_TITLES)})\.?\s([A-ZÀ-Þ][a-zß-ÿ'-]+(?:\s[A-ZÀ-Þ][a-zß-ÿ'-]+)?)")

_GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan"
    " joseph jessica thomas sarah charles karen anna maria peter paul hans klaus jürgen sabine ute"
    " jean pierre marie claire luc jose juan carmen luis ana carlos".split()
)
_TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz ch at it nl us ca au".split())
_CUES = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel", "kontakt"),
    "ip": ("ip", "server", "host", "address", "login", "adresse", "servidor"),
    "card": ("card", "visa", "master", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "ruf", "llam", "appel"),
    "name": ("name", "signed", "dear", "contact", "author", "von", "par", "por"),
    "national_id": ("ssn", "social", "security", "insurance", "sozial", "seguro", "sécurité"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ascii_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(accepted, refused) spans of the strict patterns, each sorted by start and kind."""
    good: list[tuple[int, int, str]] = []
    bad: list[tuple[int, int, str]] = []
    if "@" in text:
        good += [(a, b, "email") for a, b in _emails(text)]
    for m in _CARD.finditer(text):
        digits = _ascii_digits(m[0])
        if len(digits) >= 8:
            ok = 12 <= len(digits) <= 19 and _luhn(digits)
            (good if ok else bad).append((m.start(), m.end(), "card"))
    if "." in text:
        for m in _IP.finditer(text):
            ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (good if ok else bad).append((m.start(), m.end(), "ip"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 9 <= len(_ascii_digits(m[0])) <= 15 else bad).append((m.start(), m.end(), "phone"))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(good, key=lambda s: (s[0], order[s[2]])), bad


def _loose_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 9:
            continue
        for kind, pattern in (("national_id", _NATIONAL_ID), ("phone", _LOOSE_PHONE)):
            if found := pattern.fullmatch(m[0]):
                yield m.start(), m.start() + found.end(), kind
                break
    if "[at]" in text or "(at)" in text or " dot " in text:
        for m in _SPELLED_MAIL.finditer(text):
            yield m.start(), m.end(), "email"
    if any(t in text for t in _TITLES):
        for m in _TITLED.finditer(text):
            yield m.start(1), m.end(1), "name"


def candidates(text: str) -> tuple[list[tuple], list[tuple]]:
    """(base spans, other candidates that overlap none of them)."""
    base, refused = base_spans(text)
    out, at = [], 0
    taken = sorted(base)
    for span in sorted({*refused, *_loose_spans(text)}):
        while at < len(taken) and taken[at][1] <= span[0]:
            at += 1
        if (at == len(taken) or taken[at][0] >= span[1]) and (not out or out[-1][1] <= span[0]):
            out.append(span)
    return base, out


def votes(text: str, span: tuple[int, int, str], strict: bool) -> tuple[int, ...]:
    """One vote of 1, 0 or -1 by every labeler."""
    start, end, kind = span
    body = text[start:end]
    digits = _ascii_digits(body)
    checksum = gazetteer = 0
    if kind == "card":
        checksum = 1 if _luhn(digits) and 12 <= len(digits) <= 19 else -1
        gazetteer = 1 if digits[:1] in "3456" and len(digits) in (14, 15, 16) else -1
    elif kind == "ip":
        checksum = 1 if strict else -1
        gazetteer = 1 if digits and not body.startswith(("0.", "127.")) else -1
    elif kind == "phone":
        checksum = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if body[:1] in "+(0" else 0
    elif kind == "email":
        gazetteer = 1 if body.rsplit(".", 1)[-1].strip().lower() in _TOP_DOMAINS else 0
    elif kind == "name":
        gazetteer = 1 if body.split()[0].lower() in _GIVEN_NAMES else 0
    elif kind == "national_id":
        checksum = -1 if body[:3] in ("000", "666") or body[0] == "9" or "00" in (body[4:6],) else 1
    before = text[max(0, start - CONTEXT):start].lower()
    context = 1 if any(c in before for c in _CUES[kind]) else 0
    outside = text[start - 1:start] + text[end:end + 1]
    border = -1 if any(c.isalnum() or c in "_=/" for c in outside) else 1
    return (1 if strict else -1 if kind in BASE_KINDS else 1, checksum, gazetteer, context, border)


@dataclass
class SpanModel:
    """Labeler reliabilities from EM and the weights of the span classifier."""

    reliability: dict[str, dict[str, float]] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def probability(self, kind: str, vote: tuple[int, ...]) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(_features(kind, vote) @ self.weights, -30, 30))))


def _features(kind: str, vote: tuple[int, ...]) -> np.ndarray:
    """One-hot kind, then for/against of every labeler."""
    out = np.zeros(len(KINDS) + 2 * len(LABELERS))
    out[KINDS.index(kind)] = 1
    for k, v in enumerate(vote):
        if v:
            out[len(KINDS) + 2 * k + (v < 0)] = 1
    return out


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict, dict]:
    """(probability of every (kind, votes), reliability of each labeler by kind).

    Each labeler of a kind has P(vote | personal) and P(vote | not); both start from the
    majority vote and are smoothed, so a labeler that never votes keeps no influence.
    """
    soft, reliability = {}, {}
    for kind in KINDS:
        pattern = [v for k, v in counts if k == kind]
        if not pattern:
            continue
        n = np.array([counts[kind, v] for v in pattern], float)
        vote = np.array(pattern)
        p = 1 / (1 + np.exp(-vote.sum(axis=1).astype(float)))
        hot = np.stack([vote == x for x in (-1, 0, 1)], axis=2).astype(float)
        for _ in range(rounds):
            share = {}
            for side, w in ((1, n * p), (0, n * (1 - p))):
                mass = np.einsum("i,ijv->jv", w, hot)
                share[side] = (mass + 1) / (mass.sum(axis=1, keepdims=True) + 3)
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            odds = np.log(prior / (1 - prior)) + np.einsum(
                "ijv,jv->i", hot, np.log(share[1]) - np.log(share[0])
            )
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        soft |= {(kind, v): float(x) for v, x in zip(pattern, p, strict=True)}
        right = (n[:, None] * (p[:, None] * (vote == 1) + (1 - p)[:, None] * (vote == -1))).sum(axis=0)
        cast = (n[:, None] * (vote != 0)).sum(axis=0)
        reliability[kind] = dict(zip(LABELERS, ((right + 1) / (cast + 2)).tolist(), strict=True))
    return soft, reliability


def train_classifier(soft: dict[tuple, float], counts: dict[tuple, int], ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on the soft labels, weighted by counts, by Newton steps."""
    x = np.array([_features(*k) for k in soft])
    y = np.array(list(soft.values()))
    n = np.sqrt(np.array([counts[k] for k in soft], float))  # frequent patterns do not drown the rest
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame) -> SpanModel:
    """Count the vote patterns of all documents, then EM and the classifier on those counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    base, other = candidates(text)
                    seen.update((s[2], votes(text, s, True)) for s in base)
                    seen.update((s[2], votes(text, s, False)) for s in other)
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in seen], pa.string()),
            pa.array([list(v) for _, v in seen], pa.list_(pa.int32())),
            pa.array(list(seen.values()), pa.int64()),
        ], names=["kind", "vote", "n"])

    narrow = docs.select(F.col("text").cast("string").alias("text"))
    counted = narrow.mapInArrow(count, "kind string, vote array<int>, n long")
    # at most len(KINDS) * 3 ** len(LABELERS) rows
    rows = counted.groupBy("kind", "vote").agg(F.sum("n").alias("n")).collect()
    counts = {(r["kind"], tuple(r["vote"])): r["n"] for r in sorted(rows, key=lambda r: (r["kind"], r["vote"]))}
    if not counts:
        return SpanModel()
    soft, reliability = expectation_maximisation(counts)
    return SpanModel(reliability, train_classifier(soft, counts))


def all_spans(text: str, model: SpanModel) -> tuple[list[tuple], list[tuple]]:
    """(base spans, spans that the classifier adds)."""
    base, other = candidates(text)
    added = [s for s in other if model.probability(s[2], votes(text, s, False)) >= THRESHOLD]
    return base, added


def _joined(spans: list[tuple]) -> str:
    order = {k: n for n, k in enumerate(KINDS)}
    ordered = sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def find(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans, n_added for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = all_spans(text or "", shared.value)
                kinds = Counter(s[2] for s in base)
                rows.append((
                    doc_id, *(kinds[k] for k in BASE_KINDS),
                    hashlib.sha256(_joined(base).encode()).hexdigest(), _joined([*base, *added]), len(added),
                ))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return narrow.mapInArrow(scan, schema)


def masked(text: str, spans: list[tuple]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The documents with personal data masked; ``n_chars``, if present, follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if model is None else model)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t and masked(t, [s for part in all_spans(t, shared.value) for s in part])
                for t in batch.column(at).to_pylist()
            ]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(scan, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
