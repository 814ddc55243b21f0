"""Grouped statistics over log entries. All aggregates are partial before their shuffle; percentiles are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sawmill.functions import patterns as P
from sawmill.functions import text as X
from sawmill.operators import extract
from sawmill.operators.filters import is_error, is_slow


def keyed_queries(entries: DataFrame, threshold_ms: float, numbered: bool = False) -> DataFrame:
    """Slow entries with their statement and fingerprint. Long statements group by the whole of their shape: what is over
    500 characters is cut for display, ended by a hash of all of it."""
    shape = X.fingerprint_numbered if numbered else X.fingerprint
    text = F.coalesce("query", "message")
    rows = entries.filter(is_slow(threshold_ms)).withColumn("statement", text).withColumn("fingerprint", shape(text))
    short = F.concat(F.substring("fingerprint", 1, 483), F.lit("#"), F.substring(F.md5(F.col("fingerprint").cast("binary")), 1, 16))
    return rows.withColumn("fingerprint", F.when(F.length("fingerprint") > 500, short).otherwise(F.col("fingerprint")))


def slow_queries(entries: DataFrame, threshold_ms: float = 1000.0, top: int | None = 25, numbered: bool = False, approximate: bool = False) -> DataFrame:
    """Statement statistics by fingerprint, the largest total first; ties go by fingerprint.

    approximate: percentile_approx in place of exact percentiles, for groups of too many distinct durations."""
    rows = keyed_queries(entries, threshold_ms, numbered)
    quantiles = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    p = F.percentile_approx("duration_ms", [0.5, 0.95, 0.99], 10_000) if approximate else F.percentile("duration_ms", quantiles)
    phase = {f"{name}_ms": F.sum(F.when(F.col("phase") == name, F.col("duration_ms"))) for name in ("parse", "bind", "execute")}
    out = rows.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("count"), X.exact_sum(F.col("duration_ms")).alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        p.alias("p"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.array_sort(F.collect_set("database")).alias("databases"), F.array_sort(F.collect_set("user")).alias("users"),
        F.array_sort(F.collect_set("application_name")).alias("applications"), F.min_by("query_type", "seq").alias("query_type"), F.min_by(F.substring("statement", 1, 2000), F.col("seq")).alias("sample"),
        F.count_if(F.col("message").rlike(P.CANCELLED)).alias("cancellations"), *[c.alias(n) for n, c in phase.items()],
    )
    out = out.withColumns({"p50_ms": F.col("p")[0], "p95_ms": F.col("p")[1], "p99_ms": F.col("p")[2]}).drop("p")
    return out.orderBy(F.desc("total_ms"), "fingerprint").limit(top) if top else out


def samples(entries: DataFrame, threshold_ms: float = 1000.0, most: int = 3) -> DataFrame:
    """Up to `most` distinct statements of each fingerprint, first seen first."""
    rows = keyed_queries(entries, threshold_ms).groupBy("fingerprint", F.substring("statement", 1, 2000).alias("sample")).agg(F.min("seq").alias("seq"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("fingerprint").orderBy("seq"))).filter(F.col("nth") <= most)


def error_patterns(entries: DataFrame, top: int | None = 20) -> DataFrame:
    """Errors by pattern; code and category of the first; counts by hour of the day as a map."""
    rows = entries.filter(is_error()).withColumn("pattern", X.pattern_key(F.col("message")))
    hours = rows.groupBy("pattern", F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.min(F.struct("seq", "error_code", F.substring("message", 1, 500).alias("sample"), "log_level")).alias("head"),
        F.collect_set("user").alias("users"), F.collect_set("database").alias("databases"),
    )
    hour = F.struct(F.coalesce("hour", F.lit(0)).alias("key"), F.col("n").alias("value"))
    out = hours.groupBy("pattern").agg(
        F.sum("n").alias("count"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.min("head").alias("head"), F.map_from_entries(F.array_sort(F.collect_list(hour))).alias("hourly"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("users")))).alias("users"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("databases")))).alias("databases"),
    )
    out = out.withColumns({"error_code": F.col("head.error_code"), "sample": F.col("head.sample"), "log_level": F.col("head.log_level"), "category": X.category(F.col("head.sample"))}).drop("head")
    return out.orderBy(F.desc("count"), "pattern").limit(top) if top else out


def error_hours(entries: DataFrame) -> DataFrame:
    return entries.filter(is_error()).groupBy(X.pattern_key(F.col("message")).alias("pattern"), F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def error_categories(entries: DataFrame) -> DataFrame:
    return entries.filter(is_error()).groupBy(X.category(F.col("message")).alias("category")).agg(F.count(F.lit(1)).alias("count"))


def connection_class(entries: DataFrame) -> Column:
    """connect, disconnect, auth_failure or null: an entry counts once. Received lines are not counted with the authorized ones."""
    of = lambda kind: extract.is_a(entries, kind)
    return F.when(of("authorized"), "connect").when(of("disconnected"), "disconnect").when(of("auth_failed"), "auth_failure")


def auth_failed(entries: DataFrame) -> Column:
    return connection_class(entries) == "auth_failure"


def connections_by(entries: DataFrame, dimension: str) -> DataFrame:
    """Connections by hour, user, database, host or application."""
    key = {"hour": X.hour(F.col("timestamp")), "user": F.col("user"), "database": F.col("database"), "host": F.col("remote_host"), "application": F.col("application_name")}[dimension]
    return entries.filter(connection_class(entries) == "connect").groupBy(key.alias(dimension)).agg(F.count(F.lit(1)).alias("connections")).filter(F.col(dimension).isNotNull())


def connection_summary(entries: DataFrame) -> DataFrame:
    kind = connection_class(entries)
    return entries.agg(*[F.count_if(kind == k).alias(n) for k, n in (("connect", "connections"), ("disconnect", "disconnections"), ("auth_failure", "auth_failures"))])


def query_types(entries: DataFrame, *by: str) -> DataFrame:
    """Entries by query type and the columns given; cancellations are left out."""
    rows = entries.filter(~extract.is_a(entries, "cancelled"))
    return rows.groupBy(*by, "query_type").agg(F.count(F.lit(1)).alias("count"))


def query_type_rollup(entries: DataFrame) -> DataFrame:
    rows = entries.filter(~extract.is_a(entries, "cancelled"))
    return rows.rollup("database", "query_type").agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))


def dml_over_time(entries: DataFrame) -> DataFrame:
    rows = entries.filter(F.col("query_type").isin("insert", "update", "delete") & ~extract.is_a(entries, "cancelled"))
    return rows.groupBy(X.hour(F.col("timestamp")).alias("hour"), "query_type").agg(F.count(F.lit(1)).alias("count"))


def phase_totals(entries: DataFrame) -> DataFrame:
    rows = entries.filter(F.col("phase").isNotNull() & F.col("duration_ms").isNotNull())
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_ms"))


def top_of_phase(entries: DataFrame, phase: str, top: int = 25) -> DataFrame:
    """The statements with the largest total in a phase."""
    rows = entries.filter((F.col("phase") == phase) & F.col("duration_ms").isNotNull())
    sums = rows.groupBy(F.substring(F.coalesce("query", "message"), 1, 200).alias("statement")).agg(F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_ms"))
    return sums.orderBy(F.desc("total_ms"), "statement").limit(top)


def pooler_summary(entries: DataFrame) -> DataFrame:
    return extract.pooler_events(entries).agg(
        F.count(F.lit(1)).alias("events"), F.count("duration_ms").alias("requests"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("total_ms"),
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.countDistinct("error").alias("distinct_errors"),
    )


def pooler_errors(entries: DataFrame, top: int = 20) -> DataFrame:
    return extract.pooler_events(entries).filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first")).orderBy(F.desc("count"), "first").limit(top)


def pooler_by(entries: DataFrame, dimension: str) -> DataFrame:
    return extract.pooler_events(entries).filter(F.col(dimension).isNotNull()).groupBy(dimension).agg(F.count(F.lit(1)).alias("events"))


def checkpoint_summary(entries: DataFrame) -> DataFrame:
    done = extract.checkpoint_events(entries)
    often = entries.agg(F.count_if(extract.is_a(entries, "checkpoint_often")).alias("warnings"))
    return done.agg(
        F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.avg("buffers").alias("avg_buffers"),
        F.sum("wal_added").alias("wal_added"), F.sum("wal_removed").alias("wal_removed"), F.sum("wal_recycled").alias("wal_recycled"), F.avg("distance_kb").alias("avg_distance_kb"), F.avg("estimate_kb").alias("avg_estimate_kb"),
    ).crossJoin(often)  # fmt: skip  # two rows of one


def checkpoint_types(entries: DataFrame) -> DataFrame:
    return extract.checkpoint_causes(entries).groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def autovacuum_frequency(entries: DataFrame) -> DataFrame:
    runs = extract.autovacuum_runs(entries).withColumn("name", F.concat_ws(".", "schema", "table"))
    return runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.avg("duration_ms").alias("avg_ms")).orderBy(F.desc("runs"), "name")


def hourly_timeline(entries: DataFrame, threshold_ms: float = 1000.0) -> DataFrame:
    of = lambda kind: extract.is_a(entries, kind)
    return entries.groupBy(X.hour(F.col("timestamp")).alias("hour")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(is_error()).alias("errors"), F.count_if(is_slow(threshold_ms)).alias("slow"), F.count_if(of("authorized")).alias("connections"),
        F.count_if(of("lock_wait") | of("deadlock")).alias("locks"), F.count_if(of("checkpoint")).alias("checkpoints"), F.count_if(of("autovacuum")).alias("autovacuums"),
    )


def throughput(entries: DataFrame, threshold_ms: float = 0.0) -> DataFrame:
    """Entries, statements, errors and their rates over the span of time (at least a second)."""
    sums = entries.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(is_slow(threshold_ms)).alias("statements"), F.count_if(is_error()).alias("errors"), F.min("timestamp").alias("from"), F.max("timestamp").alias("to")
    )
    span = F.unix_micros("to") / 1e6 - F.unix_micros("from") / 1e6
    span = F.when(span > 0, span).otherwise(1.0)
    return sums.withColumns({"span_s": span, "statements_per_s": F.bround(F.col("statements") / span, 4), "errors_per_min": F.bround(F.col("errors") / (span / 60), 4), "statements_per_min": F.bround(F.col("statements") / (span / 60), 4)})


def pool_efficiency(entries: DataFrame) -> DataFrame:
    """Peak of concurrent sessions as a share of all connections, in percent; 100 without connections."""
    from sawmill.operators import ordered

    both = ordered.peak_concurrent(entries).crossJoin(connection_summary(entries).select("connections"))  # one row each
    share = F.when(F.col("connections") > 0, F.bround(F.least(F.lit(100.0), 100.0 * F.col("peak") / F.col("connections")), 1)).otherwise(100.0)
    return both.select(F.col("peak").cast("long").alias("peak"), "connections", share.alias("efficiency"))
