"""Root-cause rules: predicates over one row of metrics, evaluated together as one projection.

A rule is a condition and a severity as columns; custom rules of rule packs are SQL expressions over the same
row. A rule pack may override severities, switch rules off and name patterns to ignore."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import patterns as P
from sawmill.functions import text as X
from sawmill.operators import aggregate, extract, ordered
from sawmill.operators.filters import is_error, is_fatal, is_slow


@dataclass
class Thresholds:
    """Every threshold of every rule and timeline detector."""

    slow_ms: float = 1000.0
    connection_warn: int = 80
    connection_critical: int = 150
    checkpoint_often: int = 3
    checkpoint_slow_ms: float = 60_000.0
    lock_warn: int = 10
    lock_critical: int = 50
    deadlock_warn: int = 2
    temporary_mb: float = 100.0
    temporary_high_mb: float = 1024.0
    auth_warn: int = 5
    auth_critical: int = 50
    autovacuum_warn: int = 10
    autovacuum_high: int = 20
    lag_critical_mb: float = 100.0
    long_warn_ms: float = 300_000.0
    long_critical_ms: float = 3_600_000.0
    idle_ratio: float = 0.70
    dml_ratio: float = 0.40
    dml_locks: int = 5
    parse_ratio: float = 0.20
    storm: int = 50
    cancelled: int = 20
    wal_bytes: int = 100 * 1024 * 1024
    host_share: float = 0.60
    pool_errors: int = 10
    disk_events: int = 3
    burst_medium: int = 10
    burst_high: int = 20
    burst_critical: int = 50
    wave_gap: str = "5 minutes"
    wave_least: int = 3
    wave_high: int = 10
    checkpoint_spike_high_ms: float = 300_000.0
    vacuum_long_ms: float = 60_000.0
    vacuum_high_ms: float = 300_000.0
    auth_spike: int = 20
    auth_spike_critical: int = 100
    cancelled_wave: int = 5
    cancelled_wave_high: int = 20
    lag_event_mb: float = 1.0
    lag_event_s: float = 10.0
    spike_patterns: int = 10
    spike_ms: float = 30_000.0
    spike_high_ms: float = 60_000.0

    @classmethod
    def of(cls, given: dict | None) -> Thresholds:
        """From a mapping; unknown names are ignored."""
        known = {f.name: f.type for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in known})


def metrics_row(entries: DataFrame, t: Thresholds | None = None, platform: str | None = None) -> DataFrame:
    """One row with all that rules look at."""
    t = t or Thresholds()
    m = F.col("message")
    n = F.count(F.lit(1))
    statement = F.coalesce("query", "message")
    of = lambda kind: extract.is_a(entries, kind)
    typed = ~of("cancelled")
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    waits, dead = of("lock_wait"), of("deadlock")
    file_mb = F.when(of("temporary_file"), F.bround(X.whole(m, P.TEMPORARY_FILE, 2) / (1024 * 1024), 2))
    lag_unit = F.lower(F.coalesce(X.found(m, P.REPLICATION_LAG, 2), F.lit("bytes")))
    lag = F.when(of("replication_lag") & ~lag_unit.startswith("s"), X.number(m, P.REPLICATION_LAG, 1) * F.when(lag_unit == "mb", 1024.0**2).when(lag_unit == "gb", 1024.0**3).otherwise(1.0))
    pooled = F.coalesce(F.col("raw_line"), F.lit("")).rlike(P.POOLER) | m.rlike(P.POOLER)
    # All that needs no grouping is one pass.
    base = entries.agg(
        n.alias("entries"), F.count_if(is_error()).alias("errors"), F.count_if(is_fatal()).alias("fatals"), F.count_if(of("authorized")).alias("connections"),
        F.count_if(of("auth_failed") & ~of("authorized") & ~of("disconnected")).alias("auth_failures"), F.count_if(of("checkpoint_often")).alias("checkpoint_warnings"),
        F.count_if(is_fatal() & of("out_of_memory")).alias("out_of_memory"), F.count_if(is_fatal() & of("ssl")).alias("ssl_fatals"),
        F.count_if(is_error() & of("disk_full")).alias("disk_full"), F.count_if(of("cancelled")).alias("cancelled"),
        F.coalesce(F.max("duration_ms"), F.lit(0.0)).alias("longest_ms"), F.count_if(is_slow(t.slow_ms)).alias("slow"),
        F.count_if(typed & F.col("query_type").isin("delete", "update")).alias("changes"), F.count_if(typed & F.col("query_type").isin("select", "insert", "update", "delete", "copy", "ddl", "other") & statement.isNotNull()).alias("typed"),
        F.coalesce(F.sum(F.when(F.col("phase") == "parse", F.col("duration_ms"))), F.lit(0.0)).alias("parse_ms"), F.coalesce(F.sum(F.when(F.col("phase") == "execute", F.col("duration_ms"))), F.lit(0.0)).alias("execute_ms"),
        F.count_if(waits & ~dead).alias("lock_waits"), F.count_if(dead).alias("deadlocks"), F.count_if(of("checkpoint_done")).alias("checkpoints"), zero(F.avg(F.when(of("checkpoint_done"), X.number(m, P.CHECKPOINT_DONE, 8) * 1000)), "double").alias("checkpoint_avg_ms"),
        F.count_if(file_mb >= t.temporary_mb).alias("large_files"), zero(F.max(file_mb), "double").alias("largest_mb"), zero(F.max(lag.cast("long")), "long").alias("most_lag_bytes"),
        F.countDistinct(F.when(pooled, X.found(m, P.POOLER_ERROR))).alias("pool_errors"),
    )
    parts = [
        ordered.peak_concurrent(entries).select(F.col("peak").cast("long").alias("peak_concurrent")),
        extract.autovacuum_runs(entries).groupBy("schema", "table").agg(n.alias("runs"), F.max("wal_bytes").alias("wal")).agg(zero(F.max("runs"), "long").alias("most_autovacuums"), zero(F.max("wal"), "long").alias("most_wal_bytes")),
        ordered.idle_ratio(entries).select(zero(F.col("idle_ratio"), "double").alias("idle_ratio")),
        ordered.error_storm_by_hour(entries, 5, t.storm).select("in_window"),
        aggregate.connections_by(entries, "host").agg(zero(F.max("connections"), "double").alias("top_host"), zero(F.sum("connections"), "double").alias("all_hosts")).select(F.coalesce(X.ratio(F.col("top_host"), F.col("all_hosts")), F.lit(0.0)).alias("host_share")),
        ordered.regressions(aggregate.keyed_queries(entries, t.slow_ms)).agg(F.count_if("regressing").alias("regressing")),
    ]
    out = base
    for p in parts:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("platform", F.lit(platform).cast("string"))


@dataclass
class Rule:
    id: str
    title: str
    condition: Callable[[Thresholds], Column]
    severity: Callable[[Thresholds], Column | str]
    advice: list[str]
    detail: Callable[[Thresholds], Column] | None = None


RULES: list[Rule] = []


def rule(id: str, title: str, advice: list[str], severity, detail: str | None = None):
    """Registers a condition as a rule. severity: a name or a function of the thresholds; detail: a column to report."""

    def add(condition):
        sev = severity if callable(severity) else (lambda t: F.lit(severity))
        RULES.append(Rule(id, title, condition, sev, advice, (lambda t: F.col(detail).cast("string")) if detail else None))
        return condition

    return add


def _steps(column: str, critical, high: str = "HIGH", top: str = "CRITICAL"):
    return lambda t: F.when(F.col(column) >= critical(t), top).otherwise(high)


C = F.col
rule("HIGH_CHECKPOINT_FREQUENCY", "Checkpoints follow each other too fast", ["Raise max_wal_size", "Look for bulk writes at the times of the warnings"], "HIGH", "checkpoint_warnings")(lambda t: C("checkpoint_warnings") >= t.checkpoint_often)
rule("SLOW_CHECKPOINTS", "Checkpoints take very long", ["Spread them: checkpoint_completion_target near 0.9", "Look at the storage's write latency"], "MEDIUM", "checkpoint_avg_ms")(lambda t: (C("checkpoints") > 0) & (C("checkpoint_avg_ms") > t.checkpoint_slow_ms))
rule("CONNECTION_EXHAUSTION", "Many sessions at once", ["Put a pooler before the server", "Look for clients that do not close sessions"], _steps("peak_concurrent", lambda t: t.connection_critical), "peak_concurrent")(lambda t: C("peak_concurrent") >= t.connection_warn)
rule("LOCK_STORMS", "Sessions wait for each other's locks", ["Keep transactions short", "Update rows in one order", "Set lock_timeout"], _steps("lock_waits", lambda t: t.lock_critical), "lock_waits")(lambda t: C("lock_waits") >= t.lock_warn)
rule("DEADLOCK_PATTERN", "Deadlocks come back", ["Take locks in one order everywhere", "Retry transactions that were chosen as victims"], "HIGH", "deadlocks")(lambda t: C("deadlocks") >= t.deadlock_warn)
rule("TEMP_FILE_ABUSE", "Statements spill large temporary files", ["Raise work_mem for those sessions", "Add indexes for their sorts and joins"], _steps("largest_mb", lambda t: t.temporary_high_mb, "MEDIUM", "HIGH"), "largest_mb")(lambda t: C("large_files") > 0)
rule("AUTOVACUUM_LAGGING", "Tables need vacuum again and again", ["Lower the table's autovacuum_vacuum_scale_factor", "Raise autovacuum_vacuum_cost_limit"], _steps("most_autovacuums", lambda t: t.autovacuum_high, "MEDIUM", "HIGH"), "most_autovacuums")(lambda t: C("most_autovacuums") >= t.autovacuum_warn)
rule("AUTH_FAILURES_SPIKE", "Many failed logins", ["Check pg_hba.conf and deployed passwords", "Block unknown sources"], _steps("auth_failures", lambda t: t.auth_critical), "auth_failures")(lambda t: C("auth_failures") >= t.auth_warn)
rule("REPLICATION_LAG", "A standby falls behind", ["Look at its network and disk", "Drop slots nobody uses"], _steps("most_lag_bytes", lambda t: t.lag_critical_mb * 1024 * 1024), "most_lag_bytes")(lambda t: C("most_lag_bytes") > 0)
rule("OOM_KILLER", "The server ran out of memory", ["Lower work_mem or the number of sessions", "Check the host's overcommit settings"], "CRITICAL", "out_of_memory")(lambda t: C("out_of_memory") > 0)
rule("SLOW_QUERY_REGRESSION", "Statements get slower call by call", ["Compare their plans over time", "Run ANALYZE on their tables"], "HIGH", "regressing")(lambda t: C("regressing") > 0)
rule("ERROR_STORM", "Errors come in storms", ["Find the first error of the storm", "Look at what was deployed before it"], "CRITICAL", "in_window")(lambda t: C("in_window") >= t.storm)
rule("SSL_FATAL_ERRORS", "TLS sessions fail", ["Check certificates and their dates"], "HIGH", "ssl_fatals")(lambda t: C("ssl_fatals") > 0)
rule("DISK_FULL", "The disk is full", ["Free space at once", "Watch WAL, temporary and log directories"], "CRITICAL", "disk_full")(lambda t: C("disk_full") >= t.disk_events)
rule("LONG_RUNNING_TRANSACTIONS", "Statements run for minutes or hours", ["Set statement_timeout", "Run reports on a standby"], _steps("longest_ms", lambda t: t.long_critical_ms), "longest_ms")(lambda t: C("longest_ms") >= t.long_warn_ms)
rule("HIGH_SESSION_IDLE_TIME", "Sessions mostly idle", ["Pool sessions by transaction", "Set idle_session_timeout"], "MEDIUM", "idle_ratio")(lambda t: C("idle_ratio") > t.idle_ratio)
rule("QUERY_TYPE_IMBALANCE", "Updates and deletes dominate and wait for locks", ["Batch the changes", "Check that foreign keys are indexed"], "HIGH", "changes")(lambda t: (C("typed") > 0) & (C("changes") / F.greatest(C("typed"), F.lit(1)) > t.dml_ratio) & (C("lock_waits") + C("deadlocks") >= t.dml_locks))
rule("PREPARE_PHASE_BOTTLENECK", "Much time goes into parsing", ["Use prepared statements", "Simplify generated SQL"], "MEDIUM", "parse_ms")(lambda t: (C("execute_ms") > 0) & (C("parse_ms") / F.greatest(C("execute_ms"), F.lit(1e-9)) > t.parse_ratio))
rule("AUTOVACUUM_WAL_AMPLIFICATION", "A vacuum wrote much WAL", ["Vacuum more often, less at a time", "Raise max_wal_size"], "HIGH", "most_wal_bytes")(lambda t: C("most_wal_bytes") > t.wal_bytes)
rule("CONNECTION_STORM_BY_HOST", "One host opens most sessions", ["Pool at that host"], "HIGH", "host_share")(lambda t: C("host_share") > t.host_share)
rule("MANAGED_PLATFORM_DETECTED", "The server is a managed service", ["Settings go through the provider's parameter groups"], "INFO", "platform")(lambda t: C("platform").isin("rds", "redshift"))
rule("PGBOUNCER_POOL_EXHAUSTION", "The pooler reports many kinds of errors", ["Raise default_pool_size", "Look at server-side limits"], "CRITICAL", "pool_errors")(lambda t: C("pool_errors") > t.pool_errors)
rule("CANCELLED_QUERY_STORM", "Many statements are cancelled", ["Find what makes them slow before raising timeouts"], "HIGH", "cancelled")(lambda t: C("cancelled") > t.cancelled)


@dataclass
class CustomRule:
    """condition: a SQL expression over the metrics row, as in `deadlocks > 3 and errors > 100`."""

    id: str
    condition: str
    severity: str = "MEDIUM"
    title: str = ""
    description: str = ""
    advice: list[str] = field(default_factory=list)
    enabled: bool = True


@dataclass
class RulePack:
    name: str = ""
    severity_overrides: dict[str, str] = field(default_factory=dict)
    ignored_errors: list[str] = field(default_factory=list)
    ignored_queries: list[str] = field(default_factory=list)
    custom: list[CustomRule] = field(default_factory=list)


def rank(severity: Column) -> Column:
    out = F.lit(len(P.SEVERITIES))
    for i, s in enumerate(P.SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def findings(metrics: DataFrame, t: Thresholds | None = None, pack: RulePack | None = None) -> DataFrame:
    """rule_id, severity, title, detail, advice, in order of severity and then of the rules. metrics: one row."""
    t, pack = t or Thresholds(), pack or RulePack()
    rows = []
    for i, r in enumerate(RULES):
        severity = F.lit(pack.severity_overrides[r.id].upper()) if r.id in pack.severity_overrides else r.severity(t)
        severity = F.lit(severity) if isinstance(severity, str) else severity
        rows.append((i, r.id, r.condition(t), severity, r.title, r.detail(t) if r.detail else F.lit(None).cast("string"), r.advice))
    for i, c in enumerate(c for c in pack.custom if c.enabled):
        rows.append((len(RULES) + i, c.id, F.expr(c.condition), F.lit(pack.severity_overrides.get(c.id, c.severity).upper()), c.title or c.id, F.lit(c.description), c.advice))
    one = lambda i, id, when, sev, title, detail, advice: F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(F.lit(i).alias("nth"), F.lit(id).alias("rule_id"), sev.alias("severity"), F.lit(title).alias("title"), detail.alias("detail"), F.array(*[F.lit(a) for a in advice]).cast("array<string>").alias("advice")),
    )
    hits = F.filter(F.array(*[one(*r) for r in rows]), lambda x: x.isNotNull())
    return metrics.select(F.explode(hits).alias("f")).select("f.*").orderBy(rank(F.col("severity")), "nth")


def recommendations(found: DataFrame) -> DataFrame:
    """Distinct advice in order of its first finding."""
    each = found.select("severity", "nth", F.posexplode("advice").alias("at", "advice"))
    return each.groupBy("advice").agg(F.min(F.struct(rank(F.col("severity")), "nth", "at")).alias("first")).orderBy("first").select("advice")


def run(entries: DataFrame, t: Thresholds | None = None, pack: RulePack | None = None, platform: str | None = None) -> DataFrame:
    from sawmill.operators.filters import without_ignored

    kept = without_ignored(entries, pack.ignored_errors, pack.ignored_queries) if pack else entries
    return findings(metrics_row(kept, t, platform), t, pack)


def describe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, r.id, r.title) for i, r in enumerate(RULES)], "nth int, rule_id string, title string")
