"""URL rules with exact membership by a cascade of Bloom filters.

The list holds keys of a host and a path prefix. Every url of the corpus asks for a bounded
number of keys: its host cut to as many labels, and its path cut to as many characters, as some
listed key has (the list's "shapes"). Those keys are the complete key universe. Level 1 of
the cascade encodes the listed keys; the universe's false positives are encoded by level 2,
the listed keys that level 2 wrongly holds by level 3, and so on until a level has none.
A key is listed exactly if the number of levels it passes in a row is odd, so urls are judged
without a join: the filters are constants of the plan.

All steps are DataFrame functions. Level 1 takes as many hashes as make its false positives
about as many as the listed keys, however large the universe is; each later level halves what
passes. So every filter has some ``MAX_LISTED`` keys at most and one hash more for each doubling of
the universe: more listed keys, or more than ``MAX_PASSED`` false positives, are refused, which
bounds what a task receives.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; an
empty path does not start with "/"; repeated rules count once; if two rules of one key differ,
block wins; the longest rule (host and path together) wins, then the longer host; without rules
every url gets the default verdict; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.session import cut_lineage

LEAST_BITS = 1 << 14  # two hashes make too few different patterns in a smaller filter
MAX_LISTED = 2_000_000
MAX_PASSED = 2 * MAX_LISTED
MAX_LEVELS = 40

#: Fixed rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a url; both empty without ``://``."""
    url = F.coalesce((F.col(url) if isinstance(url, str) else url).cast("string"), F.lit(""))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), *_LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Bloom:
    """One level: the bits of its keys as a binary constant, tested with column functions."""

    def __init__(self, keys: DataFrame, n: int, salt: int, hashes: int):
        """``n`` keys; a stranger passes with a probability of about 2 ** -hashes."""
        self.salt, self.hashes = salt, hashes
        self.bytes = -(-max(LEAST_BITS, math.ceil(n * hashes / math.log(2))) // 8)
        bits = keys.select(F.explode(self._bits(F.col("key"))).alias("bit"))
        packed = (
            bits.groupBy((F.col("bit") / 8).cast("int").alias("byte"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))).alias("value"))
        )
        values = bytearray(self.bytes)
        for r in packed.toLocalIterator():  # at most as many rows as the filter has bytes
            values[r["byte"]] = r["value"]
        self.values = bytes(values)

    def _bits(self, key: Column) -> Column:
        """Positions of a key's bits: two hashes give all; the shifts keep the sums inside a long."""
        pair = F.struct(
            F.shiftright(F.xxhash64(key, F.lit(self.salt)), 8).alias("first"),
            F.shiftright(F.xxhash64(key, F.lit(self.salt), F.lit(1)), 8).alias("step"),
        )
        size = F.lit(self.bytes * 8).cast("long")
        return _bind(pair, lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(self.hashes - 1)), lambda k: F.pmod(h["first"] + k * h["step"], size)
        ))

    def holds(self, key: Column) -> Column:
        def is_set(bit: Column) -> Column:
            byte = F.substring(F.lit(self.values), (bit / 8).cast("int") + 1, F.lit(1))
            value = F.conv(F.hex(byte), 16, 10).cast("int")
            return F.call_function("shiftright", value, (bit % 8).cast("int")).bitwiseAND(1) == 1

        # the hash of a null is a number too
        return key.isNotNull() & F.forall(self._bits(key), is_set)


class Cascade:
    """Exact membership for every key of the universe it was built with."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        """Both have a column ``key``, each key once."""
        self.levels: list[Bloom] = []
        listed = cut_lineage(listed)
        if (n := listed.count()) > MAX_LISTED:
            raise ValueError(f"{n} listed keys; the bound is {MAX_LISTED}")
        if n == 0:
            return
        # as many strangers as listed keys pass level 1; half of the keys asked pass each later one
        hashes = max(2, math.ceil(math.log2(max(universe.count() / n, 1))))
        inside, outside = listed, None
        while True:
            level = Bloom(inside, n, len(self.levels), hashes)
            self.levels.append(level)
            if outside is None:
                passed = universe.where(level.holds(F.col("key"))).join(listed, "key", "left_anti")
            else:
                passed = outside.where(level.holds(F.col("key")))
            passed = cut_lineage(passed)
            n, hashes = passed.count(), 2
            if n == 0:
                return
            if n > MAX_PASSED or len(self.levels) == MAX_LEVELS:
                raise RuntimeError(f"level {len(self.levels)} lets {n} keys pass; are keys repeated?")
            inside, outside = passed, inside

    def holds(self, key: Column) -> Column:
        """True if the key is listed: it passes an odd number of levels in a row."""
        if not self.levels:
            return F.lit(False)
        # from the last level inwards: passing level i means "not what level i + 1 says"
        found = self.levels[-1].holds(key)
        for level in reversed(self.levels[:-1]):
            found = level.holds(key) & ~found
        return found


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _labels(host: Column, n: int) -> Column:
    """The host's last n labels; the whole host if it has n, null if fewer."""
    return F.when(F.size(F.split(host, r"\.")) >= n, F.substring_index(host, ".", -n))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every url; ``rules`` has verdict, host, path.

    A rule fits its host and all subdomains where the path starts with the rule's.
    """
    rules = rules.select(
        F.coalesce("verdict", F.lit("block")).alias("verdict"),
        F.translate(F.coalesce("host", F.lit("")), *_LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
    ).where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({
        "key": _key(F.col("host"), F.col("path")),
        "labels": F.size(F.split("host", r"\.")), "letters": F.length("path"),
    })
    # distinct shapes of the list: few, whatever its length
    shapes = sorted((r["labels"], r["letters"]) for r in rules.select("labels", "letters").distinct().collect())
    host, path = host_and_path("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = [
        _key(_labels(F.col("host"), labels), F.substring("path", 1, letters))
        for labels, letters in shapes
    ]
    asked = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
    universe = urls.select(F.explode(asked).alias("key")).distinct()
    listed = Cascade(rules.select("key"), universe)
    blocked = Cascade(rules.where("verdict = 'block'").select("key"), universe)
    # one expression for all shapes; the longest wins, then the longer host
    fitting = F.transform(F.filter(asked, listed.holds), lambda k: F.struct(
        F.length(k).alias("size"), F.length(F.substring_index(k, "\n", 1)).alias("host"), k.alias("key")
    ))
    best = F.array_max(fitting)["key"]
    return urls.withColumn("_best", best).select(
        "page_id", "host", "path", F.replace("_best", F.lit("\n"), F.lit("")).alias("rule"),
        F.when(F.col("_best").isNull(), F.lit(default))
        .when(blocked.holds(F.col("_best")), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )
