"""Named queries: a Spark plan over the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.plans.facts import SHARED_SQL, Facts

_SPARK_TYPE = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}
_SQL_TYPE = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}
DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Facts], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Facts(spark, sf_dir)).select(*[_spark_column(n, t) for n, t in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(_sql_column(n, t) for n, t in self.columns)
        return f"{with_clause(self.sql)}SELECT {picked} FROM ({self.sql}) AS answer"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Registers a plan. ``columns``: "name:type …" with types s, i, d, b; doubles are rounded."""
    parsed = tuple(tuple(c.rsplit(":", 1)) for c in columns.split())

    def wrap(build: Callable[[Facts], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, parsed, build, sql.strip() if sql else None)
        return build

    return wrap


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "d":
        c = c.cast("double")
        c = F.when(~F.isnan(c), F.round(c, DIGITS) + F.lit(0.0))
    else:
        c = c.cast(_SPARK_TYPE[kind])
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "d":
        return f"CASE WHEN isnan(CAST({name} AS DOUBLE)) THEN NULL ELSE round(CAST({name} AS DOUBLE), {DIGITS}) + 0.0 END AS {name}"
    return f"CAST({name} AS {_SQL_TYPE[kind]}) AS {name}"


def with_clause(sql: str) -> str:
    """The shared subqueries the text mentions, and those they mention, in order."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in SHARED_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    parts = [f"{name} AS ({body})" for name, body in SHARED_SQL.items() if name in needed]
    return f"WITH {', '.join(parts)} " if parts else ""
