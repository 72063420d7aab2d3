"""Query registry and the shared SQL of the check side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """Put the shared named queries that ``body`` needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    head = ",\n".join(f"{n} AS (\n{CTES[n].strip()}\n)" for n in needed)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"


def query(name: str, oracle: str | None = None):
    """Register a query function and, if given, the SQL that must agree with it."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_ctes(oracle)
        return fn

    return add
