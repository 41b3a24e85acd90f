"""Spelling variants: words one edit apart, found by a frontier of states over a distributed trie.

Words are the maximal letter runs of whole texts, A-Z lower-cased. The vocabulary becomes a trie as an edge
table: a node is a prefix, an edge carries the label to the next level, the count of the word that ends there
and two 64-bit masks of what lies below (next letters, whole remainders). A state is (word, position, node,
edits). Level by level all states join the level's edges on their node: without an edit so far the label may
match exactly or take the one edit (letter replaced, inserted or left out); after it only exact labels go on.
A state that the child's masks rule out is dropped before it is shuffled. States with one edit that end at the
end of the word and at a word of the trie are its neighbours.

Every word is also entered spelled backwards. One edit leaves either the first or the last half of a word
alone, so edits are tried beyond the middle only, where nodes have few children, and every edge belongs to
one level, so it is shuffled once. Labels hold one letter up to ``SINGLE`` and grow by a quarter from there,
so the number of levels grows with the logarithm of the longest word.

Edge cases: a null text has no words; a null id counts as an empty one in the checksum; repeated rows count
again; equal counts go to the smaller word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.tables import stored

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
DROP_EVERY = 31
SINGLE = 12
START = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FORWARD, _BACKWARD = ">", "<"  # first symbol of every spelled word; the two tries share one table


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, drop_every: int = DROP_EVERY,
) -> DataFrame:
    """(word, n): words of at least ``min_length`` letters; where the checksum of id and run says so, a letter is left out.

    Leaving a letter out shortens a run, so shorter runs are never looked at.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % min_length), F.lit(0))
    run = F.col("run")
    checksum = F.crc32(F.concat(F.col("id"), F.lit(":"), run).cast("binary"))
    place = (F.col("h") % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + F.lit(2)))
    return (
        docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
        .withColumn("h", checksum)
        .select(F.when(F.col("h") % drop_every == 0, shorter).otherwise(run).alias("word"))
        .where(F.length("word") >= min_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )


def level_ends(longest: int) -> list[int]:
    """Depths at which trie levels end: single letters first, longer labels deeper down."""
    ends = [START]
    while ends[-1] < longest:
        ends.append(ends[-1] + (1 if ends[-1] < SINGLE else ends[-1] // 4))
    return ends


def _bit(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int")


def _one_bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), _bit(x))


def _spelled(words: DataFrame) -> DataFrame:
    """(w, n, size, half): each word forwards and backwards; edits are tried from ``half`` letters on."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    forward = words.select(F.concat(F.lit(_FORWARD), "word").alias("w"), "n", size.alias("size"), half.alias("half"))
    backward = words.select(
        F.concat(F.lit(_BACKWARD), F.reverse("word")).alias("w"), "n", size.alias("size"), (size - half).alias("half"))
    return forward.unionByName(backward)


def _unspelled(w: Column) -> Column:
    bare = F.substr(w, F.lit(2))
    return F.when(w.startswith(_FORWARD), bare).otherwise(F.reverse(bare))


def trie_edges(spelled: DataFrame, ends: list[int]) -> DataFrame:
    """(level, child, n, next_mask, rest_mask); the parent is the prefix of the level before.

    A level above which no word of similar length looks for edits is left out.
    """
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        for k, (low, high) in enumerate(zip(ends, ends[1:], strict=False))
    ])
    child = F.substr("w", F.lit(1), F.least(F.col("high"), F.col("size")) + F.lit(1))
    rest = F.substr("w", F.length("child") + F.lit(1))
    return (
        spelled.select("w", "n", "size", "half", F.inline(levels))
        .where((F.col("low") < F.col("size")) & (F.col("high") >= F.col("half") - 1))
        .select("level", child.alias("child"), "w", "n", "size")
        .select(
            "level", "child", F.when(F.length("child") == F.col("size") + 1, F.col("n")).alias("n"),
            _one_bit(F.substr(rest, F.lit(1), F.lit(1))).alias("next_bit"), _one_bit(rest).alias("rest_bit"),
        )
        .groupBy("level", "child")
        .agg(F.max("n").alias("n"), F.bit_or("next_bit").alias("next_mask"), F.bit_or("rest_bit").alias("rest_mask"))
    )


def _advance(states: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """(w, n, size, node, pos, near_n): what one level makes of the states, all with their one edit made.

    ``pos`` is the number of letters of the word that are used; ``near_n`` the count of the word that ends at
    the new node, if one does. ``width`` is the length of the level's labels; one-letter labels need no edit
    distance. Cheap tests come first, since most pairs of a state and an edge fail them.
    """
    label, pos = F.col("label"), F.col("pos")
    used = F.lit(1) if width == 1 else F.length("label")
    fresh = F.col("edits") == 0

    def letter(ahead: int) -> Column:
        return F.substr("w", pos + F.lit(ahead + 2), F.lit(1))

    def piece(extra: int) -> Column:
        return F.substr("w", pos + F.lit(2), used + F.lit(extra))

    def one_edit(extra: int) -> Column:
        if width > 1:
            return F.levenshtein(piece(extra), label, 1) == 1
        if extra < 0:
            return F.lit(True)
        if extra == 0:
            return letter(0) != label
        # the first of two letters is left out; the second only at the end, else the next level does it
        return (letter(1) == label) | ((pos + 2 == F.col("size")) & (letter(0) == label))

    def possible(extra: int) -> Column:
        step = fresh & one_edit(extra)
        if extra == 0:
            step = step | (~fresh & (piece(0) == label))
        at = pos + used + F.lit(extra)
        # does the subtree below the child hold what is left of the word, as far as the masks tell?
        following = F.getbit("next_mask", _bit(F.substr("w", at + F.lit(2), F.lit(1)))) == 1
        remainder = F.getbit("rest_mask", _bit(F.substr("w", at + F.lit(2)))) == 1
        return (at <= F.col("size")) & step & following & remainder

    inserted, replaced, left_out = (possible(extra) for extra in (-1, 0, 1))
    out = F.array(*[F.when(ok, F.lit(extra)) for ok, extra in ((inserted, -1), (replaced, 0), (left_out, 1))])
    near = edges.select("node", "label", F.col("child"), F.col("n").alias("near_n"), "next_mask", "rest_mask")
    return (
        states.join(near, "node").where(inserted | replaced | left_out)
        .select("w", "n", "size", "child", "near_n", (pos + used).alias("at"), F.explode(out).alias("extra"))
        .where(F.col("extra").isNotNull())
        .select("w", "n", "size", F.col("child").alias("node"), (F.col("at") + F.col("extra")).alias("pos"), "near_n")
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words one edit apart, once."""
    words = stored(words.select("word", "n"))
    ends = level_ends(words.agg(F.max(F.length("word"))).first()[0] or 0)
    if len(ends) == 1:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where(F.lit(False))
    spelled = stored(_spelled(words))
    edges = stored(trie_edges(spelled, ends).sortWithinPartitions("level"))
    carried, found = None, []
    for k, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
        level = edges.where(F.col("level") == k).select(
            F.substr("child", F.lit(1), F.lit(low + 1)).alias("node"),
            F.substr("child", F.lit(low + 2)).alias("label"), "child", "n", "next_mask", "rest_mask")
        begun = spelled.where((F.col("size") >= low) & (F.col("half") < high)).select(
            "w", "n", "size", F.substr("w", F.lit(1), F.lit(low + 1)).alias("node"),
            F.lit(low).alias("pos"), F.lit(0).alias("edits"))
        states = begun if carried is None else begun.unionByName(carried)
        step = stored(_advance(states, level, high - low))
        at_end = F.col("pos") == F.col("size")
        found.append(step.where(at_end & F.col("near_n").isNotNull()))
        carried = step.where(~at_end & (F.length("node") == high + 1)).select(
            "w", "n", "size", "node", "pos", F.lit(1).alias("edits"))
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    named = pairs.select(
        _unspelled(F.col("w")).alias("word"), "n", _unspelled(F.col("node")).alias("near"), "near_n")
    # both tries, and runs of one letter, find a pair more than once
    return named.repartition("word").groupBy("word", "near").agg(F.max("n").alias("n"), F.max("near_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Counts grow at every step, so jumps over jumps end soon."""
    roots = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stored(roots.join(further, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; words are distinct).

    ``form`` is the near word of largest count if that is at least ``ratio`` times the word's own.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = stored(near_pairs(words))
    best = (
        pairs.repartition("word").groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))
    )
    is_form = F.col("near_n") >= F.lit(ratio) * F.col("n")
    judged = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the documents with their forms and roots."""
    return group_variants(word_counts(docs, id_col, text_col))
