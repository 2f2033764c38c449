"""Query registry: each entry names its input tables and views by parameter, and may carry reference SQL.

Views are fixture inputs derived from the base tables. Their SQL runs on Spark and on DuckDB alike, with
``TS'...'`` standing for a timestamp literal without zone; a view may also be built by a Spark function
with separate reference SQL. ``{name}`` refers to a table or view.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.corpus import spread_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}
VIEWS: dict[str, tuple[str | Callable[..., DataFrame], str]] = {}

# Tables whose rows cost much to process (long texts, answers to score).
WIDE_ROWS = {"documents", "pages", "orders"}
_REF = re.compile(r"\{([a-z_]+)\}")


def add_view(name: str, sql: str) -> None:
    VIEWS[name] = (sql, sql)


def built_view(sql: str):
    """A view made by a Spark function, with its DuckDB definition."""

    def wrap(fn):
        VIEWS[fn.__name__] = (fn, sql)
        return fn

    return wrap


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread_scan(table) if name in WIDE_ROWS else table
    spec = VIEWS[name][0]
    if callable(spec):
        return spec(**{p: load(spark, sf_dir, p) for p in inspect.signature(spec).parameters})
    deps = dict.fromkeys(_REF.findall(spec))
    text = spec.replace("TS'", "TIMESTAMP_NTZ '").replace("{", "{{").replace("}", "}}")
    text = re.sub(r"\{(\{[a-z_]+\})\}", r"\1", text)
    return spark.sql(text, **{d: load(spark, sf_dir, d) for d in deps})


def duckdb_sql(sql: str) -> str:
    """Reference SQL with the views it needs put in front as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_REF.findall(text)):
            if name in VIEWS and name not in order:
                visit(VIEWS[name][1])
                order.append(name)

    visit(sql)
    body = _REF.sub(r"\1", sql).replace("TS'", "TIMESTAMP '").strip()
    if not order:
        return body
    ctes = [f"{n} AS ({_REF.sub(chr(92) + '1', VIEWS[n][1])})".replace("TS'", "TIMESTAMP '") for n in order]
    head = "WITH " + ",\n".join(ctes)
    if body.upper().startswith("WITH RECURSIVE "):
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[len("WITH "):]
    return head + "\n" + body


def query(op: str, sql: str | None = None, name: str | None = None):
    """Register ``fn`` as a query for the operator ids ``op``; parameters name its inputs."""

    def wrap(fn):
        key = name or fn.__name__
        params = list(inspect.signature(fn).parameters)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(**{p: load(spark, sf_dir, p) for p in params})

        assert key not in QUERIES, key
        QUERIES[key] = run
        OPERATORS[key] = op
        if sql:
            ORACLES[key] = duckdb_sql(sql)
        return fn

    return wrap


def path_query(op: str, sql: str | None = None):
    """Register a query that opens its inputs itself: ``fn(spark, sf_dir)``."""

    def wrap(fn):
        assert fn.__name__ not in QUERIES, fn.__name__
        QUERIES[fn.__name__] = fn
        OPERATORS[fn.__name__] = op
        if sql:
            ORACLES[fn.__name__] = duckdb_sql(sql)
        return fn

    return wrap
