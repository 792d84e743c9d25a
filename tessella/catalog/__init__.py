"""Named queries over the driver's tables, each with the SQL that another engine answers it by."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules whose queries are offered.
MODULES = ("labels", "metrics", "ranking", "statistics", "texts", "structure", "judging", "linking", "studies", "files", "draws", "more", "sources", "live", "learning", "details")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, signed: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one.

    `signed` names columns of doubles that can be -0.0, which both sides give as 0.0.
    """

    def register(f: Query) -> Query:
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: df[c] + 0.0 for c in signed})

        QUERIES[f.__name__] = plain if signed else f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{c} + CAST(0 AS DOUBLE) AS {c}' for c in signed)}) FROM ({sql})" if signed else sql
        return f

    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tessella.catalog.{m}")
