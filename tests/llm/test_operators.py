"""Training-data operators on small cases: brute force, edge cases, round trips."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evirank.llm import (
    decontaminate, html_text, language, licenses, mixing, ngram_join, pii, substring_dedup, top_k, url_filter, words,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def frame(spark, texts, source="s", lang="en"):
    return spark.createDataFrame(
        [(i, t, lang, source, len(t or "")) for i, t in enumerate(texts)], DOC_DDL
    )


def clashing(df):
    """Columns named like the operators' inner ones."""
    for name in ("row", "_row", "doc", "score", "lang_pred", "mix_shard", "found", "node", "_size", "key"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and long rows with clashing names."""
    long = sentence(1, 30_000)
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "...", "en", "a", 3),
            (3, "Ab Cd", "en", "a", 5), (3, "Ab Cd", "en", "a", 5), (4, long, "en", "b", len(long)),
            (5, long, "en", "b", len(long)), (None, "some text", "fr", "b", 9)]
    return clashing(spark.createDataFrame(rows, DOC_DDL))


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["Ab-cd é1", None, "", "ÉA b", "x", "--", "a\x7fb[c`d{e"]
    for limit in (1, 1 << 20):
        got = []
        for first, last, w in words.word_pieces(pa.array(texts), limit):
            for t in range(last - first):
                got.append([w.spelled(i).decode() for i in range(w.first[t], w.first[t + 1])])
        assert got == [words_of(t) for t in texts]


def test_decontamination_against_brute_force(spark):
    item = sentence(5, 25)
    short = "only four words here"
    texts = [sentence(6, 40) + " " + item + " " + sentence(7, 5), "x " + short.upper() + " y", sentence(8, 60),
             " ".join(item.split()[3:12]), " ".join(item.split()[3:13]), None, ""]
    bench = spark.createDataFrame([(1, item), (2, short), (10, item), (3, None), (4, "")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, texts), bench).collect()}
    for i, text in enumerate(texts):
        w, hit, items = words_of(text), set(), set()
        for item_id, t in ((1, item), (2, short), (10, item)):
            v = words_of(t)
            size = min(10, len(v))
            windows = {tuple(v[k:k + size]) for k in range(len(v) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    items.add(str(item_id))
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items) == (len(w), len(hit), len(items))
        assert rows[i].items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert rows[0].longest_match == 25 and rows[4].longest_match == 10
    kept = decontaminate.remove_contaminated(frame(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 6}


def brute_components(texts):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)) if w) for w in map(words_of, texts)]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and len(a & b) >= 0.8 * len(a | b):
                links[i].add(j)
    label = list(range(len(texts)))
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(texts))]
        if new == label:
            return links, label
        label = new


def test_ngram_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)  # the near copies need several blocks
    rng = np.random.default_rng(3)
    base = sentence(1, 150).split()
    near = []
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, 150, k % 5):
            w[at] = f"edit{k}"
        near.append(" ".join(w))
    texts = near + near[:5] + [sentence(100 + k, 80) for k in range(20)] + [None, "", "a b"]
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    links, label = brute_components(texts)
    assert [rows[i].class_id for i in range(len(texts))] == label
    found, true = sum(r.n_links for r in rows.values()), sum(map(len, links.values()))
    assert 0.98 * true <= found <= true
    assert sorted(i for i, r in rows.items() if r.kept) == sorted(set(label))
    assert ngram_join.drop_near_duplicates(frame(spark, texts)).count() == len(set(label))


def test_prefixes_shorten_until_the_recall_is_met():
    depth = ngram_join.prefix_depth(0.8, 7, 8, 0.99)
    assert 1 - (1 - 0.8 ** depth) ** 7 >= 0.99 > 1 - (1 - 0.8 ** (depth + 1)) ** 7


def test_repeated_passages(spark):
    passage, line = sentence(9, 56), sentence(10, 12)
    texts = [sentence(20 + k, 90) for k in range(6)]
    texts[0] = texts[0] + " " + passage + " " + sentence(40, 30)
    texts[1] = sentence(41, 17) + " " + passage
    texts[2:5] = [t + " " + line for t in texts[2:5]]
    texts.append(passage + " " + passage)
    rows = {r.doc_id: r for r in substring_dedup.summarize(frame(spark, texts)).collect()}
    assert {i for i, r in rows.items() if r.repeated} == {0, 1, 6}
    assert rows[1].spans == "17:73"
    out = substring_dedup.remove_repeats(frame(spark, texts))
    assert sum(passage in r.text for r in out.collect()) == 1
    assert out.columns == frame(spark, texts).columns


def test_repeated_passages_against_brute_force(spark):
    """Overlapping passages of several partners: word ranges equal those of all windows."""
    rng = np.random.default_rng(3)
    pool = [sentence(100 + k, 400).split() for k in range(4)]
    texts = []
    for k in range(60):
        parts = [sentence(200 + k, int(rng.integers(0, 40)))]
        for _ in range(3):
            source = pool[rng.integers(len(pool))]
            at = int(rng.integers(0, 380))
            parts += [" ".join(source[at:at + int(rng.integers(20, 160))]), sentence(int(rng.integers(1e6)), 5)]
        texts.append(" ".join(parts))
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        w = words_of(t)
        for at in range(len(w) - 49):
            holders[tuple(w[at:at + 50])].add(i)
    want = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        want[i] = {p for at in range(len(w) - 49) if len(holders[tuple(w[at:at + 50])]) > 1
                   for p in range(at, at + 50)}
    assert sum(map(len, want.values())) > 2000
    for r in substring_dedup.summarize(frame(spark, texts)).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        assert {p for a, b in spans for p in range(a, b)} == want[r.doc_id], r.doc_id


def test_compared_windows_across_batches():
    """A digest whose rows lie in several batches, unrepeated digests, settled rows, blocks that knew."""
    rows = [(4, None, 7, 60 << 2 | 2)]
    rows += [(r, 5, 9 << 32 | r, 50 << 2) for r in (1, 1, 2, 3, 3, 8)]
    rows += [(1, 6, 9 << 32 | 2, 50 << 2), (2, 6, -9 << 32 | 2, 50 << 2), (7, 8, 1 << 32 | 3, 51 << 2 | 1)]
    rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] >> 32, r[0]))
    want = {(4, 7, 67, True), (7, 3, 54, True)} | {(r, r, r + 50, r == 1) for r in (1, 2, 3, 8)}
    table = pa.table(dict(zip(("row", "digest", "tail", "size"), zip(*rows, strict=True), strict=True)),
                     pa.schema([(c, pa.int64()) for c in ("row", "digest", "tail", "size")]))
    for step in (1, 2, 3, 20):
        got = [tuple(r.values()) for b in substring_dedup._compare(iter(table.to_batches(step))) for r in b.to_pylist()]
        assert set(got) == want and len(got) == 8


@pytest.mark.parametrize("length", [51, 100, 400])
def test_repeated_passages_of_periodic_text(spark, length):
    """Text that repeats every few words has no cuts: pairs that share it at other offsets are found."""
    texts, want = [], {}
    for period in range(1, 6):
        for k in range(6):
            passage = " ".join(f"p{length}x{period}x{k}x{i % period}" for i in range(length))
            for side in range(2):
                seed = 1000 * period + 10 * k + side
                before = sentence(seed, 20 + 7 * k + 13 * side)
                want[len(texts)] = f"{len(before.split())}:{len(before.split()) + length}"
                texts.append(f"{before} {passage} {sentence(seed + 5, 30)}")
    rows = {r.doc_id: r for r in substring_dedup.summarize(frame(spark, texts)).collect()}
    assert {i: r.spans for i, r in rows.items()} == want


def test_language_held_out_accuracy_and_und(spark):
    def text(seed, syllables):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(40))

    a, b = ["the", "ing", "er", "on"], ["lei", "que", "eau", "ou"]
    rows = [(i, text(i, a if i % 2 else b), "en" if i % 2 else "fr") for i in range(80)] + [
        (100, None, "en"), (101, "12 !!", "fr"), (None, text(1, a), "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [r for i, r in out.items() if r.held_out and i is not None and i < 100]
    assert held and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert out[100].lang_pred == out[101].lang_pred == "und" and out[100].score == 0
    assert {r.lang_pred for r in out.values()} <= {"en", "fr", "und"}
    assert language.keep_identified(docs).count() == 81


def test_language_needs_letters():
    for text in ("12 \u2014 34 \u2026", "\U0001F642 \u2764\uFE0F", "\u00a0", "\u201c7\u201d", "\u3002\u3001", "3\u0301 \u00bd"):
        assert not language.letters_of(text).strip(), text
    assert language.letters_of("\u201cH\u00e9\u201d\u2014e\u0301") == "h\u00e9 e\u0301".encode()
    assert language.letters_of("\u0939\u093f\u0928\u094d\u0926\u0940\u0964") == "\u0939\u093f\u0928\u094d\u0926\u0940 ".encode()


def test_language_learns_beyond_a_shared_header(spark):
    def text(seed, syllables, n):
        rng = np.random.default_rng(seed)
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))

    header = text(7, ["zo", "ku", "mi"], 700)
    kinds = {"aa": ["the", "ing", "er", "on"], "bb": ["lei", "que", "eau", "ou"]}
    docs = spark.createDataFrame(
        [(i, header + " " + text(i, kinds[k], 1500), k) for i, k in enumerate(list(kinds) * 40)],
        "doc_id long, text string, lang string")
    parser = language.learn(docs)
    plain = [text(1000 + i, kinds[k], 30) for i, k in enumerate(list(kinds) * 10)]
    assert language._judged(parser, plain)[0] == list(kinds) * 10


def test_cross_parsing_against_a_plain_parser():
    sample, text = "abracadabra ab", b"abrabab zz racad"
    seen = sorted(set(sample.encode()))
    symbol = np.full(256, len(seen), np.uint8)
    symbol[seen] = np.arange(len(seen))
    table = language.suffix_automaton(symbol[np.frombuffer(sample.encode(), np.uint8)], len(seen) + 1)
    got = language.Parser(["x"], symbol, [table]).phrases([text, b""])
    count, phrase = 1, ""
    for c in text.decode():
        if phrase + c in sample:
            phrase += c
        else:
            count, phrase = count + 1, c if c in sample else ""
    assert got[0, 0] == count and got[1, 0] == 0


def test_pii_base_spans_and_mask(spark):
    text = "mail a.b@c-d.org or x@y, ip 10.0.0.1 and 10.0.0.256, card 4111 1111 1111 1111, tel +1 (212) 555-0100."
    docs = frame(spark, [text, None, "", "4111 1111 1111 1112"])
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 1, 1, 1)
    spans = [s.split(":") for s in rows[0].spans.split(",")]
    assert [text[int(a):int(b)] for k, a, b in spans if k == "email"] == ["a.b@c-d.org"]
    assert rows[1].spans == rows[2].spans == "" and rows[3].n_card == 0
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert "<EMAIL>" in masked[0].text and "a.b@c" not in masked[0].text
    assert masked[0].n_chars == len(masked[0].text) and masked[1].text is None


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    counts = defaultdict(int)
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = tuple(int(1 if (rng.random() < right) == true else -1) for right in (0.95, 0.9, 0.85, 0.5, 0.8))
        counts["card", vote] += 1
    soft, reliability = pii.expectation_maximisation(dict(counts))
    assert reliability["card"]["pattern"] > 0.9 > 0.6 > reliability["card"]["context"]
    model = pii.SpanModel(reliability, pii.train_classifier(soft, dict(counts)))
    assert model.probability("card", (1, 1, 1, 1, 1)) > 0.5 > model.probability("card", (-1, -1, -1, 1, -1))


def test_mixing_targets_and_tree(spark):
    sizes, weights = [1000, 10, 500], [5.0, 2.0, 1.0]
    got = mixing.targets(sizes, weights)
    assert got[1] == 30 and abs(sum(got) - sum(sizes)) < 1e-6 and got[0] / got[2] == pytest.approx(5)
    quotas = np.array([1000, 3, 0, 77])
    tree = mixing.splitting_tree(quotas, 7)
    assert (tree.sum(axis=0) == quotas).all() and np.ptp(tree.sum(axis=1)) <= 3
    docs = spark.createDataFrame(
        [(i, " ".join(["w"] * (5 + i % 9)), "en", "abc"[i % 3 if i % 7 else 0], 0) for i in range(600)], DOC_DDL
    )
    rows = mixing.taken_words(docs).collect()
    for target in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == target) - target) <= 15
    assert all(r.taken <= 3 * r.size and r.taken == r.size * len(r.shards) for r in rows)
    mixed = mixing.mix(docs)
    again = mixing.mix(docs)
    assert mixed.count() == sum(len(r.shards) for r in rows)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * rng.choice([0.1, 1, 5], (400, 1))
    x[50:90] = x[50]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(1024 * x.astype(np.float32).astype(float)).astype(int)
    got = defaultdict(list)
    for r in top_k.exact_top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for i in range(0, 400, 20):
        s = q @ q[i]
        want = sorted(((int(s[j]), j) for j in range(400) if j != i), key=lambda p: (-p[0], p[1]))[:10]
        assert got[i] == want
    assert set(got) == set(range(0, 400, 20))


def test_top_k_of_large_components_is_exact(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 4)) * rng.choice([1, 1e3, 1e6, 1e9], (300, 1)), 3)
    x[7], x[8], x[9] = [1, 0, 0, 0], [20000, 0, 0, 0], [30000, 0, 0, 0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, [1.0, 2.0]), (501, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [[int(np.floor(1024 * v)) for v in r] for r in x]
    got = defaultdict(list)
    wanted = F.col("vec_id").isin(7, 20, 40, 60, 80, 500)
    for r in top_k.exact_top_k(df, wanted).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for i in (7, 20, 40, 60, 80):
        exact = [(sum(a * b for a, b in zip(q[i], q[j])), j) for j in range(300) if j != i]
        clipped = [(min(max(s, -(1 << 63)), (1 << 63) - 1), j) for s, j in exact]
        assert got[i] == sorted(clipped, key=lambda p: (-p[0], p[1]))[:10]
    assert got[500] == [(1024 * 1024 * 11, 501)]


def test_top_k_with_clashing_names_and_one_row(spark):
    one = spark.createDataFrame([(100, [1.0], 3, 4)], "vec_id long, embedding array<float>, block int, score int")
    assert top_k.exact_top_k(one, F.lit(True)).count() == 0
    two = one.unionByName(spark.createDataFrame([(5, [2.0], 0, 0)], one.schema))
    assert [tuple(r) for r in top_k.exact_top_k(two, F.col("vec_id") == 100).collect()] == [(100, 1, 5, 2 << 20)]


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(4)
    block = rng.normal(size=(500, 6))
    block[:50] = block[0] + rng.normal(size=(50, 6)) * 0.1
    lengths = np.sqrt((block ** 2).sum(axis=1))
    order = np.argsort(-lengths)
    block, lengths = block[order], lengths[order]
    query = block[7]
    length = float(np.sqrt(query @ query))
    for share in (0.2, 0.7, 0.95):
        bound = share * length * lengths[0]
        kept = set(top_k.survivors(query, length, block, lengths, bound).tolist())
        assert set(np.flatnonzero(block @ query >= bound).tolist()) <= kept


def test_main_text():
    page = (
        "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Big &amp; bold</h1>"
        "<p>First  line<br>goes on here.<p>Second <b>block</b> of words.</p><aside>See also this</aside>"
        "<form><input>Sign up</form><script>var a='</p>';</script><p>Third block with many words in it.</p>"
        "<div class='comments'><p>A reader says hello there</p></div></article><footer>Imprint</footer>"
    )
    shares = {k: (i + 0.5) / (i + o + 1) for k, (i, o) in html_text._PRIOR.items()}
    text = html_text.main_text(page, shares)
    assert text == "Big & bold\n\nFirst line goes on here.\n\nSecond block of words.\n\nThird block with many words in it."
    for empty in (None, "", "<p>", "<!-- x", "<script>a"):
        assert html_text.main_text(empty, shares) == ""
    assert html_text.best_region([-1, 2, -1, 3, -9, 4]) == (1, 4)


def test_page_extraction_keeps_every_row(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<article><p>Many good words stand here</p></article>"), (2, None, None), (None, "v", "")],
        "page_id long, url string, html string",
    )
    rows = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(rows) == 3 and rows[1].text == "Many good words stand here" and rows[2].n_chars == 0
    assert html_text.extract(pages.limit(0)).count() == 0


def test_url_rules(spark):
    rules = spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/1", "http://a.net/es/1#t",
            "http://net/fr/", "http://b.org/es/1", "http://a.com", "nothing", None, "x://", "http://acom/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert rows[0] == ("a.com", "com/", "allow") and rows[1] == ("example.com", "example.com/en/", "block")
    assert rows[2] == ("www.example.com", "www.example.com/en/", "allow") and rows[3][1:] == ("net/es/", "block")
    assert rows[4][1:] == ("net/fr/", "block") and rows[5] == ("b.org", None, "allow")
    assert rows[6][1:] == (None, "allow") and rows[7][0] == rows[8][0] == rows[9][0] == "" and rows[10][1] is None
    assert url_filter.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_BITS", 8)  # many false positives: several levels
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substring(key, -1) = '7'")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 2
    held = universe.where(cascade.holds(F.col("key")))
    assert held.count() == 300 and held.where("substring(key, -1) <> '7'").count() == 0


def test_license_scan(spark):
    texts = [sentence(200 + k, 30) + "\n" + sentence(300 + k, 20) for k in range(40)]
    texts[0] += "\nReleased under the MIT License."
    texts[1] = "Licensed under the Apache License, Version 2.0.\n" + texts[1]
    texts[2] += "\nYou need a driving license to rent a car."
    texts += [None, ""]
    rows = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert (rows[0].license, rows[1].license, rows[2].license) == ("mit", "apache", None)
    assert rows[0].paragraphs == "2:mit" and rows[40].n_paragraphs == rows[41].n_paragraphs == 0
    assert all(rows[i].license is None for i in range(3, 42))


def test_odd_rows_keep_every_operator_whole(spark, odd):
    n = odd.count()
    bench = spark.createDataFrame([(1, "ab cd")], "item_id long, text string")
    assert decontaminate.find_contamination(odd, bench).count() == n
    assert decontaminate.remove_contaminated(odd, bench).count() == n - 2
    assert ngram_join.near_duplicates(odd).count() == n
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1
    rows = substring_dedup.summarize(odd).collect()
    assert len(rows) == n and {r.doc_id for r in rows if r.repeated} == {4, 5}
    assert substring_dedup.remove_repeats(odd).columns == odd.columns
    assert language.identify(odd).count() == n and pii.find(odd).count() == n
    assert language.keep_identified(odd).columns == odd.columns
    assert mixing.taken_words(odd).count() == n and licenses.scan(odd).count() == n
    assert {"doc_id", "text", "mix_shard"} <= set(mixing.mix(odd).columns)


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (decontaminate.find_contamination(none, bench), ngram_join.near_duplicates(none),
                substring_dedup.summarize(none), language.identify(none), pii.find(none), mixing.taken_words(none),
                mixing.mix(none), pii.mask(none), ngram_join.drop_near_duplicates(none)):
        assert out.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.exact_top_k(vectors, F.lit(True)).count() == 0
