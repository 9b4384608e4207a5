"""Queries over the operators with their SQL: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, rounded: Sequence[str] = ()) -> Callable:
    """Registers a function under its name; ``rounded`` columns are compared to 6 places, since sums of doubles depend on their order."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(spark, sf_dir)
            return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in rounded}) if rounded else found

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
        return f

    return register
