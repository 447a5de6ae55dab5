"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def joined(queries: dict[str, Callable], oracles: dict[str, str], name: str, *columns: str) -> None:
    """Lists of strings in the columns of a query as one string each, here and in SQL: rows are compared by plain values."""
    f, sql = queries[name], oracles.get(name)

    def run(spark, sf_dir):
        out = f(spark, sf_dir)
        return out.withColumns({c: F.array_join(c, "|") for c in columns})

    queries[name] = run
    if sql:
        oracles[name] = f"SELECT * REPLACE ({', '.join(f'''array_to_string({c}, '|') AS {c}''' for c in columns)}) FROM ({sql})"


def exploded(queries: dict[str, Callable], oracles: dict[str, str], name: str, column: str = "samples") -> None:
    """A row for each number of a list, with its place, here and in SQL."""
    f, sql = queries[name], oracles.get(name)

    def run(spark, sf_dir):
        out = f(spark, sf_dir)
        return out.select(*[c for c in out.columns if c != column], F.posexplode(column).alias("place", "value"))

    queries[name] = run
    if sql:
        oracles[name] = f"SELECT * EXCLUDE ({column}), CAST(generate_subscripts({column}, 1) - 1 AS INTEGER) AS place, unnest({column}) AS value FROM ({sql})"
