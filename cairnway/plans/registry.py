"""Where queries are registered, each with the SQL its result must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnway.sources.tables import Tables
from cairnway.sources.views import ORACLE_ONLY, SHARED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _definitions() -> dict[str, str]:
    plain = {name: re.sub(r"\{(\w+)\}", r"\1", sql) for name, sql in SHARED.items()}
    return {**plain, **ORACLE_ONLY}


def with_views(sql: str) -> str:
    """Put the definitions of every view a statement names in front of it."""
    needed: list[str] = []
    known = _definitions()

    def visit(fragment: str) -> None:
        for name in re.findall(r"\bv_\w+\b", fragment):
            if name in known and name not in needed:
                visit(known[name])
                needed.append(name)

    visit(sql)
    views = ",\n".join(f"{name} AS ({known[name].strip()})" for name in needed)
    body = sql.strip()
    recursive = bool(re.match(r"with\s+recursive", body, re.I))
    own = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if own:
        body = body[own.end():]
    if not needed:
        return sql.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{views}{',' if own else ''}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register a function of the tables under an operator's key."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
