"""Names of all queries of the engine and the SQL for each that SQL can say.

The queries run the operators over whole tables: ``events`` stands for a log (event_id the sequence, user_id the
connection, ts the clock, event_type the record's kind, value the size in hundredths), ``orders`` and ``customer`` for
recordings and their catalog, ``lineitem`` for fragments, ``pages`` for HTTP exchanges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that returns the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from flowloom.plans import connection_queries, continuation_queries, exchange_queries, log_queries, recorder_queries, recording_queries, recovery_queries, view_queries, wire_queries  # noqa: E402,F401
