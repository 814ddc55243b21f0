"""Extractors: log entries to typed events. Each is a filter and a projection; nulls where a part is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions import patterns as P
from sawmill.functions import text as X

M = F.col

#: The kinds of events, by name. An entry may be of several.
KINDS = {
    "authorized": P.AUTHORIZED, "connected": P.CONNECTED, "disconnected": P.DISCONNECTED, "auth_failed": P.AUTH_FAILED, "deadlock": P.DEADLOCK, "lock_wait": P.LOCK_WAIT,
    "checkpoint": P.CHECKPOINT, "checkpoint_done": P.CHECKPOINT_DONE, "checkpoint_often": P.CHECKPOINT_OFTEN, "checkpoint_cause": P.CHECKPOINT_CAUSE, "autovacuum": P.AUTOVACUUM,
    "autovacuum_table": P.AUTOVACUUM_TABLE, "temporary_file": P.TEMPORARY_FILE, "replication_lag": P.REPLICATION_LAG, "out_of_memory": P.OUT_OF_MEMORY, "disk_full": P.DISK_FULL,
    "ssl": P.SSL, "cancelled": P.CANCELLED, "plan": P.PLAN_START,
}


def marked(entries: DataFrame) -> DataFrame:
    """The entries with their kinds as bits in `marks`. To be kept (persisted or written): each pattern is then tried once on an
    entry, however many consumers ask."""
    out = F.lit(0)
    for i, pattern in enumerate(KINDS.values()):
        out = out.bitwiseOR(F.when(M("message").rlike(pattern), 1 << i).otherwise(0))
    return entries.withColumn("marks", out)


def is_a(entries: DataFrame, kind: str) -> Column:
    """Whether an entry is of a kind: by its mark if entries are marked, else by the kind's pattern."""
    if "marks" in entries.columns:
        return M("marks").bitwiseAND(1 << list(KINDS).index(kind)) != 0
    return M("message").rlike(KINDS[kind])


def lock_events(entries: DataFrame) -> DataFrame:
    """Lock waits and deadlocks. The holder is the first blocking process, of the message or its DETAIL."""
    m = M("message")
    wait, dead = is_a(entries, "lock_wait"), is_a(entries, "deadlock")
    blocking = F.coalesce(F.trim(F.get(F.split(X.found(m, P.LOCK_WAIT, 4), ","), 0)), X.found(m, P.LOCK_HOLDER))
    return entries.filter(wait | dead).select(
        "seq", "timestamp", F.when(wait, X.whole(m, P.LOCK_WAIT, 1)).otherwise(M("pid")).cast("int").alias("waiting_pid"), blocking.try_cast("int").alias("blocking_pid"),
        X.found(m, P.LOCK_WAIT, 2).alias("lock_type"), X.found(m, P.LOCK_WAIT, 3).alias("relation"), X.number(m, P.LOCK_WAIT, 5).alias("wait_duration_ms"), dead.alias("is_deadlock"), "database", "user",
    )


def checkpoint_events(entries: DataFrame) -> DataFrame:
    """Completed checkpoints; the cause is that of the last start before each."""
    m = M("message")
    group = lambda i: X.number(m, P.CHECKPOINT_DONE, i)
    done = entries.filter(is_a(entries, "checkpoint_done")).select(
        "seq", "timestamp", group(1).cast("long").alias("buffers"), group(2).alias("buffers_percent"), group(3).cast("long").alias("wal_added"), group(4).cast("long").alias("wal_removed"),
        group(5).cast("long").alias("wal_recycled"), group(6).alias("write_s"), group(7).alias("sync_s"), (group(8) * 1000).alias("duration_ms"),
        X.whole(m, P.CHECKPOINT_DISTANCE, 1).alias("distance_kb"), X.whole(m, P.CHECKPOINT_DISTANCE, 2).alias("estimate_kb"),
    )
    return done


def checkpoint_causes(entries: DataFrame) -> DataFrame:
    """Starts: cause by word, and type: immediate (also requested) or scheduled."""
    cause = F.lower(X.found(M("message"), P.CHECKPOINT_CAUSE))
    kind = F.when(cause.isin("immediate", "requested", "force"), "immediate").when(cause.isin("shutdown", "end"), "shutdown").otherwise("scheduled")
    return entries.filter(is_a(entries, "checkpoint_cause")).select("seq", "timestamp", cause.alias("cause"), kind.alias("type"))


def autovacuum_runs(entries: DataFrame) -> DataFrame:
    m = M("message")
    parts = F.split(F.regexp_replace(X.found(m, P.AUTOVACUUM_TABLE, 2), '"', ""), r"\.")
    n = F.size(parts)
    zero = {k: F.coalesce(X.number(m, p), F.lit(0.0)) for k, p in P.AUTOVACUUM_NUMBERS.items()}
    doubles = ("cpu_user_s", "cpu_sys_s")
    counts = [(c if k in doubles else c.cast("long")).alias(k) for k, c in zero.items() if k != "elapsed_s"]
    return entries.filter(is_a(entries, "autovacuum_table")).select(
        "seq", "timestamp", F.lower(X.found(m, P.AUTOVACUUM_TABLE, 1)).alias("operation"), F.get(parts, n - 1).alias("table"),
        F.when(n >= 2, F.get(parts, n - 2)).otherwise("public").alias("schema"), (zero["elapsed_s"] * 1000).alias("duration_ms"), *counts,
    )


def temporary_files(entries: DataFrame) -> DataFrame:
    size = X.whole(M("message"), P.TEMPORARY_FILE, 2)
    return entries.filter(is_a(entries, "temporary_file")).select("seq", "timestamp", "pid", "session_id", "database", "user", size.alias("size_bytes"), F.bround(size / (1024 * 1024), 2).alias("size_mb"))


def replication_lag(entries: DataFrame) -> DataFrame:
    """Lag in bytes, or in seconds where the unit says so. No unit counts as bytes."""
    m = M("message")
    n, unit = X.number(m, P.REPLICATION_LAG, 1), F.lower(F.coalesce(X.found(m, P.REPLICATION_LAG, 2), F.lit("bytes")))
    scale = F.when(unit == "mb", 1024.0**2).when(unit == "gb", 1024.0**3).otherwise(1.0)
    seconds = unit.startswith("s")
    return entries.filter(is_a(entries, "replication_lag")).select("seq", "timestamp", F.when(~seconds, (n * scale).cast("long")).alias("lag_bytes"), F.when(seconds, n).alias("lag_seconds"))


def cancelled_queries(entries: DataFrame) -> DataFrame:
    m = M("message")
    return entries.filter(is_a(entries, "cancelled")).select(
        "seq", "timestamp", F.substring(F.coalesce("query", m), 1, 500).alias("query"), F.coalesce(X.found(m, P.CANCEL_REASON), F.lit("unknown")).alias("reason"), "database", "user", "pid"
    )


def pooler_events(entries: DataFrame) -> DataFrame:
    m = M("message")
    own = entries.filter(F.coalesce(M("raw_line"), F.lit("")).rlike(P.POOLER) | m.rlike(P.POOLER))
    return own.select(
        "seq", "timestamp", F.lower(X.found(m, P.POOLER_EVENT, 1)).alias("event"), F.coalesce(X.found(m, P.POOLER_EVENT, 2), M("database")).alias("database"),
        F.coalesce(X.found(m, P.POOLER_EVENT, 3), M("user")).alias("user"), F.trim(X.found(m, P.POOLER_QUERY, 1)).alias("query"), X.number(m, P.POOLER_MS).alias("duration_ms"),
        X.found(m, P.POOLER_ERROR).alias("error"), X.whole(m, P.POOLER_IN).alias("bytes_in"), X.whole(m, P.POOLER_OUT).alias("bytes_out"),
    )


def plan_format(plan: Column) -> Column:
    p = F.ltrim(plan)
    return F.when(p.startswith("{"), "json").when(p.startswith("<"), "xml").when(p.startswith("---") | (p.startswith("!") & p.contains("!!")), "yaml").otherwise("text")
