"""Spelling variants, SimHash near duplicates and hard negatives against brute force and on odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evirank.llm import gray_index, hyperplane_tree, spelling

DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df):
    for name in ("w", "n", "word", "node", "code", "label", "branch", "rank", "part", "id", "run", "h"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and long rows with clashing names."""
    rnd = random.Random(1)
    long = " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 12))) for _ in range(20_000))
    rows = [(None, None), (1, ""), (1, ""), (2, "... !"), (3, "Variants variants VARIANTS"), (3, "Variants variants VARIANTS"),
            (4, long), (5, long + " tail"), (6, "z" * 20), (7, "z" * 20), (None, "variant variant"), (8, "one two")]
    return clashing(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_DDL))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(((-words[v], v) for v in near[w]), default=(0, None))
        form[w] = best[1] if best[1] is not None and -best[0] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants_of(df):
    return {tuple(r) for r in spelling.spelling_variants(df).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_equal_brute_force(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdé") for _ in range(n)) for n in (7, 8, 12) for _ in range(4)]
    words = []
    for w in base:
        words += [w] * 400 + [w[:3] + "x" + w[3:]] * 30 + [w[:3] + "xy" + w[3:]] * 2 + [w[:-1]] * 2 + [w.upper()] * 3
        for _ in range(10):
            i = rnd.randrange(len(w) + 1)
            words += [rnd.choice((w[:i] + rnd.choice("abÿ") + w[i:], w[:i] + w[i + 1:], w[:i] + "é" + w[i + 1:]))] * 2
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    got = variants_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_variants(rows)
    assert any(form and root != form for _, form, root, *_ in got)


def test_every_pair_is_found_at_any_length(spark):
    rnd = random.Random(5)
    words = set()
    for n in (7, 8, 13, 20):
        w = "".join(rnd.choice("ab") for _ in range(n))
        words.add(w)
        for i in (0, 1, n // 2 - 1, n // 2, n // 2 + 1, n - 1, n):
            words |= {w[:i] + "é" + w[i:], w[:i] + w[i + 1:], w[:i] + "c" + w[i + 1:], w[:i] + w[i:i + 1] * 2 + w[i + 1:]}
    words = sorted(w for w in words if len(w) >= 7)
    got = {(r["word"], r["near"]) for r in spelling.near_pairs(
        spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}


def test_variants_of_odd_rows(odd):
    assert variants_of(odd) == brute_variants([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert variants_of(odd.where("doc_id < 0")) == set()


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, codes):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(find(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return Counter((r[0], format(codes[i], "016x"), least[find(i)]) for i, r in enumerate(rows))


def simhash_of(df):
    return Counter(tuple(r) for r in gray_index.near_duplicates(df).select(
        "doc_id", "fingerprint", "component_id").collect())


def test_simhash_of_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert simhash_of(odd) == brute_components(rows, [plain_fingerprint(t) for _, t in rows])
    assert simhash_of(odd.where("doc_id < 0")) == Counter()


@pytest.mark.parametrize(("tile", "leaf"), [(8192, 32), (32, 4)])
def test_components_of_clustered_codes(spark, monkeypatch, tile, leaf):
    """Random codes with chains of near ones; small tiles make an index of several levels."""
    monkeypatch.setattr(gray_index, "TILE", tile)
    monkeypatch.setattr(gray_index, "LEAF", leaf)
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist()
    for c in codes[:100]:
        for _ in range(5):
            c ^= sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 5))))
            codes.append(c)
    codes = sorted(set(codes) | {0, (1 << 64) - 1})
    frame = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "code long")
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    got = {c: c for c in codes}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in gray_index.code_links(frame).collect():
        a, b = (int(np.int64(v).astype(np.uint64)) for v in r)
        assert find(a) == find(b)
        got[root(a)] = root(b)
    assert len({root(c) for c in codes}) == len({find(c) for c in codes})


def test_gray_neighbours_differ_in_one_bit(spark):
    rows = spark.range(-50, 50).select(F.col("id").alias("place"), F.col("id").bitwiseXOR(F.lit(-(1 << 63))).alias("r"))
    code = F.col("r").bitwiseXOR(F.shiftrightunsigned("r", 1))
    got = rows.select("place", code.alias("code"), gray_index.gray_rank(code).alias("rank")).orderBy("place").collect()
    assert [r["rank"] for r in got] == [r["place"] for r in got]
    assert all(((a["code"] ^ b["code"]) & ((1 << 64) - 1)).bit_count() == 1 for a, b in zip(got, got[1:]))


def brute_negatives(rows):
    v = []
    for i, e, label in rows:
        if None in (i, e, label) or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in e]))
    out = Counter()
    for i, label, e in v:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, m) for j, m, f in v if j != i and len(f) == len(e))
        for p, j, m in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out.update((i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits[:3]))
    return out


def negatives_of(df):
    return Counter(tuple(r) for r in hyperplane_tree.hard_negatives(
        df, F.col("vec_id") % 50 == 0, F.col("vec_id") % 7 == 0).collect())


@pytest.mark.parametrize("block", [1024, 16])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hyperplane_tree, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] * rng.uniform(0.2, 3) + rng.normal(size=6) * 0.2).tolist(), int(rng.integers(0, 10)))
            for i in range(600)]
    rows[50] = (50, [1e6, -2e6, 3e6, 0.5, 0.0, 1.0], 3)  # products beyond doubles
    rows[51] = (51, [9e5, -2e6, 3e6, 0.25, 0.0, 1.0], 3)
    got = negatives_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got == brute_negatives(rows) and len(got) > 20


def test_negatives_of_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0, 0.5 * (i % 3)], i % 3) for i in range(0, 300, 5)]
    rows += [(None, [1.0, 2.0, 3.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, None, 2.0], 1), (4, [1.0, float("nan"), 2.0], 1),
             (6, [float("inf"), 1.0, 1.0], 2), (7, [1.0, 1.0, 1.0], None), (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1),
             (402, [1.0, 1.0], 5), (403, [0.0, 0.0, 0.0], 1), (450, [0.0, 0.0, 0.0], 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert negatives_of(df) == brute_negatives(rows)
    assert negatives_of(df.where("vec_id < 0")) == Counter()


def test_split_points_come_from_few_rows(spark, monkeypatch):
    monkeypatch.setattr(hyperplane_tree, "SAMPLE", 16)
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("vec_id"), F.array("id", F.col("id") + 1).alias("v"))
    want = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(16).collect()]
    assert hyperplane_tree._sample(rows, 4000).to_pylist() == want
    # each of the 8 tasks sent 16 rows before
    assert 16 <= hyperplane_tree._low_hashes(rows, 2 * 16 / 4000).count() < 64
    # copies of one hash are asked for again, and no row is asked for beyond those there are
    copies = rows.withColumn("vec_id", F.lit(1).cast("long")).withColumn("v", F.array(F.lit(3).cast("long")))
    assert hyperplane_tree._sample(copies, 4000).to_pylist() == [[3]] * 16
    assert len(hyperplane_tree._sample(rows.limit(5), 5)) == 5
    assert [hyperplane_tree._parts(n) for n in (10, 40_960, 4_000_000, 15_000_000)] == [1, 10, 128, 228]
