"""Licence scan: a trained paragraph classifier over sparse word n-grams.

Fitting (on a bounded sample): sentences of known licence families and ordinary paragraphs of the
corpus become binary n-gram vectors; a multinomial logistic regression with an L1 penalty
keeps a few hundred n-grams. The class "unknown" is calibrated on held-out rows: a family is
only believed above the probability that at most ``UNKNOWN_RATE`` of the held-out ordinary
paragraphs reach. Scanning uses DataFrame functions inside one projection: paragraphs without
any n-gram of the model are skipped (they score the bias, which is "unknown"), the others are
scored, and a family is confirmed by comparing the paragraph's trigrams with its templates.

Paragraphs are lines. Edge cases: a null or empty text has no paragraphs and no licence; an empty
table is fitted on the built-in sentences alone; ties go to the family that sorts first; rows
are judged one by one, so repeated rows agree; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.license_templates import LOOKALIKES, TEMPLATES
from evirank.session import cut_lineage

#: Bounds of the labelled sample and of the vocabulary.
SAMPLE_PARAGRAPHS = 3000
COMMON_SHARE = 0.002  # n-grams in more of the ordinary paragraphs tell nothing
UNKNOWN_RATE = 0.002
CONFIRM = 0.5  # share of the shorter side's trigrams that a template must have in common
MAX_N = 3
SHORT_WORDS = ("bsd", "cc", "cc0", "gnu", "gpl", "mit", "nc", "spdx")  # tell a family by themselves
UNKNOWN = "unknown"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _strings(values: list[str]) -> str:
    """SQL array of n-grams, which consist of letters, digits and spaces."""
    return f"array({','.join(repr(v) for v in values)})"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: higher-order functions share no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased letter and digit runs."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def ngrams(w: Column, n: int) -> Column:
    grams = F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")
    )
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def all_ngrams(w: Column) -> Column:
    return F.array_distinct(F.concat(*[ngrams(w, n) for n in range(1, MAX_N + 1)]))


def trigrams(w: Column) -> Column:
    """Trigrams; the whole paragraph if it is shorter."""
    return F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(ngrams(w, 3)))


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _pieces(sentence: str) -> list[str]:
    """A sentence, and both of its halves where they are long enough to tell a family."""
    w = _words_of(sentence)
    half = len(w) // 2
    return [" ".join(w)] + ([" ".join(w[:half + 2]), " ".join(w[half - 2:])] if len(w) >= 12 else [])


@dataclass
class LicenseModel:
    classes: list[str]  # families, then unknown
    bias: list[float]
    weights: dict[str, list[float]]  # n-gram -> weight for each class
    anchors: list[str]  # the rarest word of every n-gram: a paragraph without one scores the bias
    threshold: float


def labelled(docs: DataFrame) -> DataFrame:
    """(label, w, fold): built-in sentences, and a hash sample of the corpus's own paragraphs."""
    known = [(family, piece) for family, texts in TEMPLATES.items() for t in texts for piece in _pieces(t)]
    known += [(UNKNOWN, " ".join(_words_of(t))) for t in LOOKALIKES]
    fixed = docs.sparkSession.createDataFrame(
        [(label, text.split(" "), 0) for label, text in known], "label string, w array<string>, fold int"
    )
    rows = docs.count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    # one paragraph each of about SAMPLE_PARAGRAPHS documents
    some = docs.select(F.col("text").cast("string").alias("text")).where(
        place <= min(1.0, SAMPLE_PARAGRAPHS / max(rows, 1))
    )
    lines = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    line = F.get(lines, F.pmod(F.xxhash64("text", F.lit(3)), F.greatest(F.size(lines), F.lit(1))).cast("int"))
    seen = F.expr(_strings(_template_trigrams_flat()))
    # checkpointed, as the words would be found again for every trigram otherwise
    sampled = cut_lineage(some.select(
        words(line).alias("w"), F.pmod(F.xxhash64("text", F.lit(4)), F.lit(3)).cast("int").alias("fold")
    ))
    own = (
        sampled.where("w IS NOT NULL AND size(w) > 0")
        .where(~F.arrays_overlap(trigrams(F.col("w")), seen))  # licences of the corpus are no examples of unknown
        .select(F.lit(UNKNOWN).alias("label"), "w", "fold")
    )
    return fixed.unionByName(own)


def _trigrams_of(text: str) -> list[str]:
    w = _words_of(text)
    return sorted({" ".join(w[i:i + 3]) for i in range(len(w) - 2)}) or [" ".join(w)]


def _template_trigrams_flat() -> list[str]:
    return sorted({g for texts in TEMPLATES.values() for t in texts for g in _trigrams_of(t)})


def fit(docs: DataFrame) -> LicenseModel:
    """Fit and calibrate on ``labelled``; at most a few thousand rows."""
    # a few thousand rows: one partition makes the many small steps of the fit short
    rows = cut_lineage(labelled(docs).select("label", "fold", all_ngrams(F.col("w")).alias("grams")).coalesce(1))
    ordinary = max(rows.where(F.col("label") == UNKNOWN).count(), 1)
    counts = rows.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.sum((F.col("label") != UNKNOWN).cast("int")).alias("in_templates"),
        F.sum((F.col("label") == UNKNOWN).cast("int")).alias("in_others"),
    )
    # bounded by the n-grams of TEMPLATES
    counted = {r["gram"]: r["in_others"] for r in counts.where("in_templates > 0").collect()}
    vocabulary = sorted(
        g for g, n in counted.items() if n <= max(2.0, COMMON_SHARE * ordinary)
        and any(len(w) >= 5 or w in SHORT_WORDS for w in g.split())
    )
    classes = [*sorted(TEMPLATES), UNKNOWN]
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(
        rows.withColumn("index", index.cast("double"))
    )
    # the corpus's paragraphs outnumber the sentences; both sides weigh the same
    share = F.when(F.col("label") == UNKNOWN, 1.0 / ordinary).otherwise(
        1.0 / (max(rows.where(F.col("label") != UNKNOWN).count(), 1))
    )
    training = vectors.where("fold <> 1").withColumn("share", share * ordinary)
    model = LogisticRegression(
        featuresCol="features", labelCol="index", weightCol="share", family="multinomial",
        elasticNetParam=1.0, regParam=2e-4, maxIter=100, standardization=False,
    ).fit(training)
    matrix = model.coefficientMatrix.toArray()
    bias = model.interceptVector.toArray().tolist()
    weights = {
        gram: [round(float(x), 6) for x in matrix[:, k]]
        for k, gram in enumerate(vocabulary) if abs(matrix[:, k]).max() > 1e-6
    }
    anchors = sorted({min(g.split(), key=lambda w: (w not in SHORT_WORDS and len(w) < 5, counted[w], -len(w), w)) for g in weights})
    found = LicenseModel(classes, [round(b, 6) for b in bias], weights, anchors, 0.5)
    held = rows.where((F.col("fold") == 1) & (F.col("label") == UNKNOWN)).select(
        _best(_probabilities(F.col("grams"), found), found)["p"].alias("p")
    )
    reached = held.agg(F.percentile("p", 1 - UNKNOWN_RATE)).first()[0]
    found.threshold = min(0.95, max(0.5, reached or 0.0))
    return found


def _probabilities(present: Column, model: LicenseModel) -> Column:
    """Class probabilities from the n-grams of a paragraph that the model has."""
    if not model.weights:
        return F.array(*[F.lit(0.0) for _ in model.bias[:-1]], F.lit(1.0))
    table = F.expr("map(" + ",".join(
        f"{g!r}, array({','.join(f'{x}D' for x in w)})" for g, w in model.weights.items()
    ) + ")")
    start = F.expr(f"array({','.join(f'{b}D' for b in model.bias)})")
    known = F.array_intersect(present, F.expr(_strings(list(model.weights))))
    total = F.aggregate(
        known, start, lambda s, g: F.zip_with(s, F.element_at(table, g), lambda a, b: a + b)
    )
    return _bind(total, lambda t: _bind(
        _bind(F.array_max(t), lambda top: F.transform(t, lambda x: F.exp(x - top))),
        lambda e: _bind(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda n: F.transform(e, lambda x: x / n)),
    ))


def _best(p: Column, model: LicenseModel) -> Column:
    """The likeliest family and its probability (unknown competes only through its share)."""
    names = F.expr(_strings(model.classes[:-1]))
    return _bind(F.slice(p, 1, len(model.classes) - 1), lambda families: _bind(
        F.array_max(families),
        lambda top: F.struct(
            F.element_at(names, F.array_position(families, top).cast("int")).alias("family"), top.alias("p")
        ),
    ))


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row per document: its licences, the paragraphs that state them, and suspects.

    ``license`` is the most probable confirmed family, ``families`` all of them, ``paragraphs``
    their ``line:family`` list; ``n_suspect`` counts paragraphs that the classifier takes for a
    licence but no template confirms.
    """
    model = fit(docs) if model is None else model
    anchors = F.expr(_strings(model.anchors or [""]))
    templates = F.expr("map(" + ",".join(
        f"{f!r}, array({','.join(_strings(_trigrams_of(t)) for t in texts)})" for f, texts in TEMPLATES.items()
    ) + ")")
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    tokens = F.transform(lines, lambda p, i: F.struct(i.alias("line"), words(p).alias("w")))
    # a paragraph without the rarest word of some n-gram scores the bias alone
    candidates = F.when(
        F.arrays_overlap(F.split(F.lower(F.col("text").cast("string")), NOT_WORD), anchors),
        F.filter(tokens, lambda x: F.arrays_overlap(x["w"], anchors)),
    ).otherwise(F.expr("array()"))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(F.filter(lines, lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"),
        candidates.alias("candidates"),
    )

    def judged(x: Column) -> Column:
        best = _best(_probabilities(all_ngrams(x["w"]), model), model)
        return F.struct(x["line"].alias("line"), best.alias("best"), trigrams(x["w"]).alias("tri"))

    def confirmed(x: Column) -> Column:
        return F.struct(
            x["line"].alias("line"), x["best"]["family"].alias("family"), x["best"]["p"].alias("p"),
            F.exists(
                F.element_at(templates, x["best"]["family"]),
                lambda t: F.size(F.array_intersect(t, x["tri"])) >= CONFIRM * F.least(F.size(t), F.size(x["tri"])),
            ).alias("sure"),
        )

    believed = F.filter(F.transform("candidates", judged), lambda x: x["best"]["p"] >= model.threshold)
    checked = narrow.withColumn(
        "found", F.when(F.size("candidates") > 0, F.transform(believed, confirmed))
    ).withColumn("sure", F.filter("found", lambda x: x["sure"]))
    by_weight = F.array_sort("sure", lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
                             .when(a["family"] < b["family"], -1).when(a["family"] > b["family"], 1)
                             .when(a["line"] < b["line"], -1).otherwise(1))
    return checked.select(
        "doc_id", "n_paragraphs",
        F.get(by_weight, F.lit(0))["family"].alias("license"),
        F.round(F.get(by_weight, F.lit(0))["p"], 4).alias("confidence"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ","),
                   F.lit("")).alias("families"),
        F.coalesce(F.array_join(F.transform("sure", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"])), ","),
                   F.lit("")).alias("paragraphs"),
        F.coalesce(F.size(F.filter("found", lambda x: ~x["sure"])), F.lit(0)).cast("long").alias("n_suspect"),
    )
