"""Text and identifier expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier formats and the one query stopword.
GENE_ID_PATTERN = r"^ENSG\d{11}(\.\d+)?$"
BARE_GENE_ID_PATTERN = r"^ENSG\d{11}$"
VERSION_SUFFIX = r"\.\d+$"
QUERY_STOPWORDS = ("tissue",)


def strip_version(c: Column) -> Column:
    """Remove a trailing ``.<digits>`` only; blank becomes null."""
    bare = F.regexp_replace(F.trim(c), VERSION_SUFFIX, "")
    return F.when(bare != "", bare)


def normalize_id(c: Column) -> Column:
    """Trim, upper-case and drop the version suffix."""
    return strip_version(F.upper(c))


def is_gene_id(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike(GENE_ID_PATTERN), F.lit(False))


def normalize_text(c: Column) -> Column:
    """Lower-case, drop apostrophes, turn other runs of punctuation into one blank."""
    bare = F.translate(F.lower(c), "'’", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    parts = F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
    drop = F.array(*[F.lit(w) for w in ("", *stopwords)])
    return F.array_except(parts, drop)


def unpack(c: Column, separator: str = "|") -> Column:
    """Elements of a packed field: trimmed, upper-cased, blanks dropped."""
    parts = F.split(c, re.escape(separator))
    cleaned = F.transform(parts, lambda x: F.upper(F.trim(x)))
    return F.filter(cleaned, lambda x: x != "")


def matches_substring(c: Column, normalized_query: str) -> Column:
    return F.coalesce(normalize_text(c).contains(normalized_query), F.lit(False))


def matches_prefix(c: Column, normalized_query: str) -> Column:
    return F.coalesce(normalize_text(c).startswith(normalized_query), F.lit(False))


def normalized_literal(text: str) -> str:
    """Driver-side twin of :func:`normalize_text` for one query string."""
    bare = text.lower().translate(str.maketrans("", "", "'’"))
    return re.sub("[^a-z0-9]+", " ", bare).strip()


def search_url(base: str, *phrases: Column) -> Column:
    """``base`` plus a form-encoded ``"a" AND "b"`` query."""
    quoted = [F.concat(F.lit('"'), p, F.lit('"')) for p in phrases]
    return F.concat(F.lit(base), F.url_encode(F.concat_ws(" AND ", *quoted)))


def snake_case(field: str) -> str:
    """camelCase to snake_case for one schema field."""
    return re.sub("(?<=.)([A-Z])", r"_\1", field).lower()
