"""Registered queries with their oracle SQL, on the benchmark tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """A shared SQL building block; blocks may use the ones registered before them."""
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    """Prefix the building blocks that the statement uses, directly or not."""
    needed: set[str] = set()
    texts = [sql]
    while texts:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", texts.pop()))
        for name in CTES:
            if name in words and name not in needed:
                needed.add(name)
                texts.append(CTES[name])
    if not needed:
        return sql.strip()
    blocks = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in CTES if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {blocks},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {blocks},\n{body[5:].strip()}"
    return f"WITH {blocks}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


def load() -> None:
    """Import every catalog module so that its queries register."""
    from evirank.catalog import (  # noqa: F401
        evidence_queries,
        feature_queries,
        graph_queries,
        identifier_queries,
        label_queries,
        metric_queries,
        model_queries,
        product_queries,
        score_queries,
        source_queries,
    )
