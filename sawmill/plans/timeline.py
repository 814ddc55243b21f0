"""Incident timeline: one frame for each detector, in one schema, united and ordered by time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.operators import aggregate, extract, ordered
from sawmill.operators.filters import is_error, is_fatal
from sawmill.plans.rules import Thresholds, rank


def _event(rows: DataFrame, kind: str | Column, severity: Column | str, at: str, value: Column | str, until: str | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    v = F.col(value) if isinstance(value, str) else value
    return rows.select(F.col(at).alias("timestamp"), lit(kind).alias("event_type"), lit(severity).alias("severity"), v.cast("double").alias("value"), (F.col(until) if until else F.lit(None).cast("timestamp")).alias("until"))


def steps(c: str, *bounds: tuple[float, str], otherwise: str | None = None) -> Column:
    """The first label whose bound the column reaches."""
    out = F.lit(otherwise)
    for bound, label in reversed(bounds):
        out = F.when(F.col(c) >= bound, label).otherwise(out)
    return out


def detectors(entries: DataFrame, t: Thresholds | None = None) -> dict[str, DataFrame]:
    """Events by detector. A burst counts the errors of its own minute, so one late in the log is seen too (not all
    errors of the patterns that were first seen in that minute)."""
    t = t or Thresholds()
    mb = 1024 * 1024
    bursts = entries.filter(is_error()).groupBy(F.date_trunc("minute", "timestamp").alias("minute")).agg(F.count(F.lit(1)).alias("errors")).filter(F.col("errors") >= t.burst_medium)
    locks = extract.lock_events(entries)
    done = extract.checkpoint_events(entries).filter(F.col("duration_ms") >= t.checkpoint_slow_ms)
    vacuums = extract.autovacuum_runs(entries).filter(F.col("duration_ms") >= t.vacuum_long_ms)
    peak = ordered.concurrency(entries).agg(F.max("open").alias("peak"), F.max_by("timestamp", F.struct("open", -F.col("seq"))).alias("at")).filter(F.col("peak") >= t.connection_warn)
    # Failures and the log's span come from one pass.
    failures = entries.agg(F.count_if(aggregate.auth_failed(entries)).alias("auth_failures"), F.min("timestamp").alias("from"), F.max("timestamp").alias("to")).filter(F.col("auth_failures") >= t.auth_spike)
    fatal = entries.filter(is_fatal())
    kind = F.when(extract.is_a(entries, "out_of_memory"), "oom").when(extract.is_a(entries, "disk_full"), "disk_full").when(F.col("log_level") == "PANIC", "panic").otherwise("fatal")
    cancelled = extract.cancelled_queries(entries).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("from"), F.max("timestamp").alias("to")).filter(F.col("n") >= t.cancelled_wave)
    lag = extract.replication_lag(entries).filter((F.col("lag_bytes") >= t.lag_event_mb * mb) | (F.col("lag_seconds") >= t.lag_event_s))
    spikes = aggregate.slow_queries(entries, t.slow_ms, t.spike_patterns).filter(F.col("max_ms") >= t.spike_ms)
    return {
        "error_burst": _event(bursts, "error_burst", steps("errors", (t.burst_critical, "critical"), (t.burst_high, "high"), otherwise="medium"), "minute", "errors"),
        "deadlock": _event(locks.filter("is_deadlock"), "deadlock", "high", "timestamp", F.lit(1)),
        "lock_wave": _event(ordered.islands(locks.filter(~F.col("is_deadlock")), t.wave_gap, t.wave_least), "lock_wave", steps("members", (t.wave_high, "high"), otherwise="medium"), "from", "members", "to"),
        "checkpoint_spike": _event(done, "checkpoint_spike", F.when(F.col("duration_ms") > t.checkpoint_spike_high_ms, "high").otherwise("medium"), "timestamp", "duration_ms"),
        "autovacuum": _event(vacuums, "autovacuum", steps("duration_ms", (t.vacuum_high_ms, "high"), otherwise="medium"), "timestamp", "duration_ms"),
        "connection_storm": _event(peak, "connection_storm", steps("peak", (t.connection_critical, "critical"), otherwise="high"), "at", "peak"),
        "auth_failure_spike": _event(failures, "auth_failure_spike", steps("auth_failures", (t.auth_spike_critical, "critical"), otherwise="high"), "from", "auth_failures", "to"),
        "fatal": _event(fatal, kind, F.when(F.col("log_level") == "PANIC", "critical").otherwise("high"), "timestamp", F.lit(1)),
        "cancellation_wave": _event(cancelled, "cancellation_wave", steps("n", (t.cancelled_wave_high, "high"), otherwise="medium"), "from", "n", "to"),
        "replication_lag": _event(lag, "replication_lag", F.when(F.col("lag_bytes") > t.lag_critical_mb * mb, "critical").otherwise("high"), "timestamp", F.coalesce("lag_bytes", "lag_seconds")),
        "slow_query_spike": _event(spikes, "slow_query_spike", steps("max_ms", (t.spike_high_ms, "high"), otherwise="medium"), "first_seen", "max_ms", "last_seen"),
    }


def build(entries: DataFrame, t: Thresholds | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, detectors(entries, t).values()).orderBy("timestamp", "event_type", "value")


def within(events: DataFrame, start, end) -> DataFrame:
    return events.filter(F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def by_severity(events: DataFrame) -> DataFrame:
    return events.orderBy(rank(F.upper("severity")), "timestamp", "event_type")


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("events"))
