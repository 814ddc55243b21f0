"""The canonical table of log entries."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("user", T.StringType()),
        T.StructField("database", T.StringType()),
        T.StructField("application_name", T.StringType()),
        T.StructField("remote_host", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("query", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("query_type", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
COLUMNS = [f.name for f in LOG_ENTRY.fields]
