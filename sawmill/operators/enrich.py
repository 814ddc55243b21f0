"""Columns that follow from an entry's message. Each pattern is evaluated once, and all of it in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.functions import patterns as P
from sawmill.functions import text as X
from sawmill.schema import LOG_ENTRY


def enrich(entries: DataFrame) -> DataFrame:
    """Fills duration_ms, query, error_code, phase and query_type; a query or code that is already there stays."""
    have = set(entries.columns)
    blank = {c: F.lit(None).cast(LOG_ENTRY[c].dataType) for c in LOG_ENTRY.fieldNames() if c not in have}
    rows = entries.withColumns(blank) if blank else entries
    m = F.col("message")
    query = F.coalesce(
        F.nullif(F.col("query"), F.lit("")), X.found(m, P.DURATION_STATEMENT, 2), F.trim(X.found(m, P.STATEMENT_ONLY)), X.found(m, P.PHASE_STATEMENT)
    )
    # remote_host and application_name stand in the message where the line prefix leaves them out.
    return (
        rows.withColumns(
            {
                "duration_ms": F.coalesce("duration_ms", X.number(m, P.DURATION)),
                "query": query,
                "error_code": F.coalesce(F.nullif(F.col("error_code"), F.lit("")), X.found(m, P.SQLSTATE), X.found(m, P.CODE_IN_BRACKETS)),
                "phase": X.phase(m),
                "remote_host": F.coalesce("remote_host", X.found(m, r"(?i)\bhost=(\S+)")),
                "application_name": F.coalesce("application_name", X.found(m, r"(?i)\bapplication_name=(\S+)")),
            }
        )
        .withColumn("query_type", X.query_type(F.coalesce("query", m)))
        .select(*[F.col(c).cast(LOG_ENTRY[c].dataType) for c in LOG_ENTRY.fieldNames()])
    )
