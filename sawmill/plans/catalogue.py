"""Named queries over the driver's tables, each with the same question in plain SQL.

Queries on the log run on the events table read as a server log (sawmill.sources.events). Times go out as
text, floating-point sums rounded, so that results of two engines can be compared."""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import patterns as P
from sawmill.functions import text as X
from sawmill.operators import aggregate, compare, extract, filters, ordered, snapshot
from sawmill.plans import oracle as O
from sawmill.plans import roundtrip, rules, timeline
from sawmill.sources.events import log_entries

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Slow from here on in the catalogue: the events' values are small.
SLOW = 100.0


def on_log(sql: str | None = None, *ctes: str, scans: int = 1):
    """Registers a query on log entries under its function's name. scans: how often it reads them; entries that
    are read several times are marked with their kinds and kept (spilling to disk) until the next such query."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(log_entries(spark, sf_dir) if scans == 1 else _kept(log_entries(spark, sf_dir)))
        if sql:
            SQL[f.__name__] = O.over_entries(sql, *ctes)
        return f

    return add


_last: list[DataFrame] = []


def _kept(entries: DataFrame) -> DataFrame:
    while _last:
        _last.pop().unpersist()
    _last.append(extract.marked(entries.drop("raw_line")).withColumn("raw_line", F.lit(None).cast("string")).persist(StorageLevel.MEMORY_AND_DISK))
    return _last[0]


def on_tables(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else X.stamp(F.col(c)).alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes])


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
HOUR = "strftime(ts, '%Y-%m-%d %H:00')"
ERROR = "log_level in ('ERROR', 'FATAL', 'PANIC', 'WARNING')"
TYPED = f"not {O.has('message', P.CANCELLED)}"
has = lambda p: O.has("message", p)
part = lambda p, i=1: O.extract("message", p, i)

_SLOW = f"slow as (select *, {O.fingerprint('statement')} as fingerprint from e where duration_ms >= {SLOW})"


# --- statements -----------------------------------------------------------------------------------------------


@on_log(
    """select fingerprint, count(*) as count, round(sum(duration_ms), 4) as total_ms, round(avg(duration_ms), 4) as avg_ms, min(duration_ms) as min_ms, max(duration_ms) as max_ms,
  round(quantile_cont(duration_ms, 0.5), 4) as p50_ms, round(quantile_cont(duration_ms, 0.95), 4) as p95_ms, round(quantile_cont(duration_ms, 0.99), 4) as p99_ms,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, count(distinct database) as n_databases, count(distinct "user") as n_users,
  arg_min(query_type, seq) as query_type, arg_min(statement, seq) as sample
from slow group by fingerprint order by sum(duration_ms) desc, fingerprint limit 5""",
    _SLOW,
)
def slow_query_topk(e):
    out = aggregate.slow_queries(e, SLOW, 5)
    return rounded(out.withColumns({"n_databases": F.size("databases").cast("long"), "n_users": F.size("users").cast("long")}).select(
        "fingerprint", "count", "total_ms", "avg_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms", "first_seen", "last_seen", "n_databases", "n_users", "query_type", "sample"))


@on_log("select fingerprint, phase, count(*) as count, round(sum(duration_ms), 4) as total_ms from slow where phase is not null group by all", _SLOW)
def slow_query_phases(e):
    return rounded(aggregate.keyed_queries(e, SLOW).filter("phase is not null").groupBy("fingerprint", "phase").agg(F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_ms")))


@on_log(
    """select fingerprint, sample, nth from (
  select fingerprint, sample, row_number() over (partition by fingerprint order by seq) as nth from (select fingerprint, substr(statement, 1, 2000) as sample, min(seq) as seq from slow group by all)
) where nth <= 3""",
    _SLOW,
)
def slow_query_samples(e):
    return aggregate.samples(e, SLOW).select("fingerprint", "sample", F.col("nth").cast("long").alias("nth"))


@on_log("select query_type, count(*) as count, round(sum(duration_ms), 4) as total_ms, max(duration_ms) as max_ms from e where duration_ms is not null group by all")
def slow_query_by_type(e):
    return rounded(e.filter("duration_ms is not null").groupBy("query_type").agg(F.count(F.lit(1)).alias("count"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms")))


@on_log(
    """select fingerprint, count(*) as count, round(avg(duration_ms), 4) as avg_ms from slow group by fingerprint having count(*) >= 60 and avg(duration_ms) >= 100""",
    _SLOW,
)
def dump_filtered(e):
    return rounded(aggregate.slow_queries(e, SLOW, None).filter((F.col("count") >= 60) & (F.col("avg_ms") >= 100)).select("fingerprint", "count", "avg_ms"))


@on_log(
    f"""select fingerprint, count, round(avg_ms, 4) as avg_ms, round(slope, 6) as slope, count >= 5 and slope > 0.01 * avg_ms as regressing from (
  select fingerprint, count(*) as count, avg(duration_ms) as avg_ms, coalesce(regr_slope(duration_ms, nth), 0) as slope from (
    select *, row_number() over (partition by fingerprint order by seq) - 1 as nth from (select *, {O.fingerprint("statement")} as fingerprint from e where duration_ms >= 0)
  ) group by fingerprint)"""
)
def query_regression(e):
    out = ordered.regressions(aggregate.keyed_queries(e, 0.0))
    return out.select("fingerprint", "count", F.round("avg_ms", 4).alias("avg_ms"), F.round(F.coalesce("slope", F.lit(0.0)), 6).alias("slope"), "regressing")


@on_log(
    f"""select seq, pid, text as query from (
  select seq, pid, takes, lag(opens) over w as was, lag(query) over w as text from (
    select seq, pid, query, query is not null and duration_ms is null as opens, query is null and duration_ms is not null as takes from e
    where (query is not null) <> (duration_ms is not null) or {has(P.CONNECTED)}
  ) window w as (partition by pid order by seq)
) where takes and was"""
)
def pid_statement_correlation(e):
    before = e.filter("query is null and duration_ms is not null").select("seq")
    return ordered.correlate_statements(e).join(before, "seq", "left_semi").filter("query is not null").select("seq", F.col("pid").cast("long").alias("pid"), "query")


@on_log(
    r"""select seq, regexp_replace(regexp_replace(message, '''(?:[^''\\]|\\.)*''', '''?''', 'g'), '(^|[^\w$.])\d+(?:\.\d+)?\b', '\10', 'g') as message from e"""
)
def anonymized_messages(e):
    return e.select("seq", X.anonymize(F.col("message")).alias("message"))


# --- errors ---------------------------------------------------------------------------------------------------

_ERRORS = f"errors as (select *, {O.pattern_key('message')} as pattern from e where {ERROR})"


@on_log(
    f"""select pattern, count(*) as count, {STAMP("min(ts)")} as first_seen, {STAMP("max(ts)")} as last_seen, arg_min(log_level, seq) as log_level, count(distinct "user") as n_users,
  {O.first_match("arg_min(message, seq)", P.CATEGORIES, "unknown")} as category, arg_min({part(P.SQLSTATE)}, seq) as error_code
from errors group by pattern order by count(*) desc, pattern limit 20""",
    _ERRORS,
)
def error_patterns(e):
    out = aggregate.error_patterns(e).withColumn("n_users", F.size("users").cast("long"))
    return rounded(out.select("pattern", "count", "first_seen", "last_seen", "log_level", "n_users", "category", "error_code"))


@on_log(f"select {O.first_match('message', P.CATEGORIES, 'unknown')} as category, count(*) as count from e where {ERROR} group by 1")
def error_categories(e):
    return aggregate.error_categories(e)


@on_log("select pattern, hour(ts)::int as hour, count(*) as count from errors group by 1, 2", _ERRORS)
def error_hour_histogram(e):
    return aggregate.error_hours(e)


@on_log(f"select max(n) as busiest, (max(n) * 5 // 60)::bigint as in_window, max(n) * 5 // 60 >= 50 as storm from (select count(*) as n from e where {ERROR} group by hour(ts))")
def error_storms_hour(e):
    return ordered.error_storm_by_hour(e)


@on_log(
    f"""select {STAMP("s")} as "from", {STAMP("s + interval 1 hour")} as "to", count(*) as errors
from (select ts, unnest([time_bucket(interval '30 minutes', ts) - interval 30 minutes, time_bucket(interval '30 minutes', ts)]) as s from e where {ERROR}) group by s having count(*) >= 8"""
)
def error_storms_sliding(e):
    return rounded(ordered.error_storms(e, "1 hour", "30 minutes", 8))


# --- connections and sessions ---------------------------------------------------------------------------------

_CONNECTS = has(P.AUTHORIZED)
for _name, _key in (("hour", HOUR), ("user", '"user"'), ("database", "database"), ("host", "host"), ("application", "application")):

    def _by(spark, sf_dir, name=_name):
        return aggregate.connections_by(log_entries(spark, sf_dir), name)

    QUERIES[f"connections_by_{_name}"] = _by
    SQL[f"connections_by_{_name}"] = O.over_entries(f'select {_key} as "{_name}", count(*) as connections from e where {_CONNECTS} group by 1')


@on_log(f"select count(*) filter (where {_CONNECTS}) as connections, count(*) filter (where {has(P.DISCONNECTED)}) as disconnections, count(*) filter (where {has(P.AUTH_FAILED)}) as auth_failures from e")
def connection_summary(e):
    return aggregate.connection_summary(e)


_SECONDS = " + ".join(f"{part(P.SESSION_TIME, i)}::double * {f}" for i, f in ((1, 3600000), (2, 60000), (3, 1000)))
_BUCKET = "case " + " ".join(f"when ms < {b} then '{n}'" for b, n in P.SESSION_BUCKETS) + f" else '{P.LAST_SESSION_BUCKET}' end"
_SESSIONS = f"""sessions as (
  select *, case when ms is null then null else {_BUCKET} end as bucket from (
    select seq, pid, coalesce(case when was = 1 then was_db end, database) as database, coalesce(case when was = 1 then was_host end, host) as host, case when was = 1 then was_ts end as started,
           case when {_SECONDS} > 0 then {_SECONDS} end as ms
    from (select *, lag(kind) over w as was, lag(database) over w as was_db, lag(host) over w as was_host, lag(ts) over w as was_ts
          from (select *, case when {has(P.DISCONNECTED)} then -1 else 1 end as kind from e where {has(P.DISCONNECTED)} or {has(P.CONNECTED)}) window w as (partition by pid order by seq))
    where kind = -1))"""


@on_log(f"select seq, pid, database, host, {STAMP('started')} as started, round(ms, 4) as duration_ms from sessions", _SESSIONS)
def session_pairs(e):
    return rounded(ordered.sessions(e).select("seq", F.col("pid").cast("long").alias("pid"), "database", F.col("remote_host").alias("host"), "started", "duration_ms"))


@on_log("select bucket, count(*) as sessions from sessions where bucket is not null group by 1", _SESSIONS)
def session_histogram(e):
    return ordered.sessions(e).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("sessions"))


@on_log("select database, host, count(*) as sessions, round(sum(ms), 4) as total_ms, grouping(database, host)::bigint as level from sessions group by grouping sets ((database), (host))", _SESSIONS)
def session_marginals(e):
    out = ordered.sessions(e).withColumnRenamed("remote_host", "host").groupingSets([[F.col("database")], [F.col("host")]], "database", "host")
    return rounded(out.agg(F.count(F.lit(1)).alias("sessions"), F.sum("duration_ms").alias("total_ms"), F.grouping_id("database", "host").cast("long").alias("level")))


@on_log("select count(*) as sessions, round(sum(ms), 4) as total_ms, round(sum(ms) / count(*), 4) as avg_ms from sessions", _SESSIONS)
def session_summary(e):
    return rounded(ordered.session_summary(e))


_OPEN = f"""open as (
  select seq, ts, kind, sum(step) over (order by seq rows unbounded preceding) as open from (
    select *, case when coalesce(lag(kind) over (partition by pid order by seq), -1) <> kind then kind else 0 end as step
    from (select *, case when {has(P.DISCONNECTED)} then -1 else 1 end as kind from e where {has(P.DISCONNECTED)} or {has(P.CONNECTED)})))"""


@on_log("select coalesce(max(open), 0)::bigint as peak from open where kind = 1", _OPEN)
def peak_concurrent(e):
    return ordered.peak_concurrent(e)


@on_log(f"select {HOUR} as hour, max(open)::bigint as peak from open where kind = 1 group by 1", _OPEN)
def peak_by_hour(e):
    return ordered.peak_by_hour(e)


# --- statement types and phases -------------------------------------------------------------------------------


@on_log(f"select database, query_type, count(*) as count from e where {TYPED} group by 1, 2")
def query_type_marginals(e):
    return aggregate.query_types(e, "database")


@on_log(f"select application as application_name, query_type, count(*) as count from e where {TYPED} group by 1, 2")
def query_type_by_application(e):
    return aggregate.query_types(e, "application_name")


@on_log(f"select database, query_type, count(*) as count, grouping(database, query_type)::bigint as level from e where {TYPED} group by rollup (database, query_type)")
def type_by_database_rollup(e):
    return aggregate.query_type_rollup(e).withColumn("level", F.col("level").cast("long"))


@on_log(f"select {HOUR} as hour, query_type, count(*) as count from e where {TYPED} and query_type in ('insert', 'update', 'delete') group by 1, 2")
def dml_over_time(e):
    return aggregate.dml_over_time(e)


@on_log("select phase, count(*) as count, round(sum(duration_ms), 4) as total_ms from e where phase is not null and duration_ms is not null group by 1")
def phase_totals(e):
    return rounded(aggregate.phase_totals(e))


for _phase in ("parse", "bind"):

    def _top(spark, sf_dir, phase=_phase):
        return rounded(aggregate.top_of_phase(log_entries(spark, sf_dir), phase))

    QUERIES[f"top_{_phase}_queries"] = _top
    SQL[f"top_{_phase}_queries"] = O.over_entries(
        f"select substr(statement, 1, 200) as statement, count(*) as count, round(sum(duration_ms), 4) as total_ms from e where phase = '{_phase}' and duration_ms is not null group by 1 order by sum(duration_ms) desc, 1 limit 25"
    )


# --- server events --------------------------------------------------------------------------------------------

_LOCKS = f"""locks as (
  select seq, ts, case when {has(P.LOCK_WAIT)} then {part(P.LOCK_WAIT, 1)}::bigint else pid end as waiting_pid, trim(split_part({part(P.LOCK_WAIT, 4)}, ',', 1))::bigint as blocking_pid,
         {part(P.LOCK_WAIT, 2)} as lock_type, {part(P.LOCK_WAIT, 3)} as relation, {has(P.DEADLOCK)} as is_deadlock
  from e where {has(P.LOCK_WAIT)} or {has(P.DEADLOCK)})"""


@on_log("select seq, waiting_pid, blocking_pid, lock_type, relation, is_deadlock from locks", _LOCKS)
def lock_events(e):
    return extract.lock_events(e).select("seq", F.col("waiting_pid").cast("long").alias("waiting_pid"), F.col("blocking_pid").cast("long").alias("blocking_pid"), "lock_type", "relation", "is_deadlock")


@on_log("select count(*) as deadlocks, count(distinct waiting_pid) as processes from locks where is_deadlock", _LOCKS)
def deadlocks(e):
    return extract.lock_events(e).filter("is_deadlock").agg(F.count(F.lit(1)).alias("deadlocks"), F.countDistinct("waiting_pid").alias("processes"))


@on_log(
    f"""select count(*) as members, {STAMP("min(ts)")} as "from", {STAMP("max(ts)")} as "to" from (
  select *, sum(case when ts - was <= interval 5 hours then 0 else 1 end) over (order by seq) as wave from (select *, lag(ts) over (order by ts, seq) as was from locks where not is_deadlock)
) group by wave having count(*) >= 3""",
    _LOCKS,
)
def lock_waves(e):
    return rounded(ordered.islands(extract.lock_events(e).filter(~F.col("is_deadlock")), "5 hours", 3))


_DONE = f"""done as (
  select seq, ts, {part(P.CHECKPOINT_DONE, 1)}::bigint as buffers, {part(P.CHECKPOINT_DONE, 2)}::double as buffers_percent, {part(P.CHECKPOINT_DONE, 3)}::bigint as wal_added, {part(P.CHECKPOINT_DONE, 4)}::bigint as wal_removed,
         {part(P.CHECKPOINT_DONE, 5)}::bigint as wal_recycled, {part(P.CHECKPOINT_DONE, 6)}::double as write_s, {part(P.CHECKPOINT_DONE, 7)}::double as sync_s, {part(P.CHECKPOINT_DONE, 8)}::double * 1000 as duration_ms,
         {part(P.CHECKPOINT_DISTANCE, 1)}::bigint as distance_kb, {part(P.CHECKPOINT_DISTANCE, 2)}::bigint as estimate_kb
  from e where {has(P.CHECKPOINT_DONE)})"""


@on_log("select seq, buffers, buffers_percent, wal_added, wal_removed, wal_recycled, write_s, sync_s, round(duration_ms, 4) as duration_ms, distance_kb, estimate_kb from done", _DONE)
def checkpoint_events(e):
    return rounded(extract.checkpoint_events(e).drop("timestamp"))


@on_log(
    f"""select count(*) as count, round(sum(duration_ms), 4) as total_ms, round(avg(duration_ms), 4) as avg_ms, round(max(duration_ms), 4) as max_ms, round(avg(buffers), 4) as avg_buffers,
  sum(wal_added)::bigint as wal_added, sum(wal_removed)::bigint as wal_removed, sum(wal_recycled)::bigint as wal_recycled, round(avg(distance_kb), 4) as avg_distance_kb, round(avg(estimate_kb), 4) as avg_estimate_kb,
  (select count(*) from e where {has(P.CHECKPOINT_OFTEN)}) as warnings from done""",
    _DONE,
)
def checkpoint_summary(e):
    return rounded(aggregate.checkpoint_summary(e))


@on_log(
    f"select type, count(*) as count from (select case when c in ('immediate', 'requested', 'force') then 'immediate' when c in ('shutdown', 'end') then 'shutdown' else 'scheduled' end as type from (select lower({part(P.CHECKPOINT_CAUSE)}) as c from e where {has(P.CHECKPOINT_CAUSE)})) group by 1"
)
def checkpoint_types(e):
    return aggregate.checkpoint_types(e)


_NUMBERS = ", ".join(f"coalesce({part(p)}::double, 0){'' if k in ('elapsed_s', 'cpu_user_s', 'cpu_sys_s') else '::bigint'} as {k}" for k, p in P.AUTOVACUUM_NUMBERS.items())
_VACUUMS = f"""vacuums as (
  select seq, lower({part(P.AUTOVACUUM_TABLE, 1)}) as operation, split_part({part(P.AUTOVACUUM_TABLE, 2)}, '.', -1) as "table", split_part({part(P.AUTOVACUUM_TABLE, 2)}, '.', -2) as "schema", {_NUMBERS}
  from e where {has(P.AUTOVACUUM_TABLE)})"""


@on_log(
    """select seq, operation, "table", "schema", round(elapsed_s * 1000, 4) as duration_ms, """ + ", ".join(k for k in P.AUTOVACUUM_NUMBERS if k != "elapsed_s") + " from vacuums",
    _VACUUMS,
)
def autovacuum_runs(e):
    return rounded(extract.autovacuum_runs(e).drop("timestamp"))


@on_log("""select "schema" || '.' || "table" as name, count(*) as runs, round(avg(elapsed_s * 1000), 4) as avg_ms from vacuums group by 1""", _VACUUMS)
def autovacuum_frequency(e):
    return rounded(aggregate.autovacuum_frequency(e))


@on_log(
    f"""select seq, "user", database, {part(P.TEMPORARY_FILE, 2)}::bigint as size_bytes, round_even({part(P.TEMPORARY_FILE, 2)}::double / 1048576, 2) as size_mb from e where {has(P.TEMPORARY_FILE)} order by 4 desc, seq limit 50"""
)
def temp_files_topk(e):
    return extract.temporary_files(e).select("seq", "user", "database", "size_bytes", "size_mb").orderBy(F.desc("size_bytes"), "seq").limit(50)


@on_log(
    f"""select seq, case when unit not like 's%' then (n * case unit when 'mb' then 1048576 when 'gb' then 1073741824 else 1 end)::bigint end as lag_bytes, case when unit like 's%' then n end as lag_seconds
from (select seq, {part(P.REPLICATION_LAG, 1)}::double as n, lower(coalesce({part(P.REPLICATION_LAG, 2)}, 'bytes')) as unit from e where {has(P.REPLICATION_LAG)})"""
)
def replication_lag(e):
    return extract.replication_lag(e).select("seq", "lag_bytes", "lag_seconds")


@on_log(f"""select reason, database, count(*) as count from (select database, coalesce({part(P.CANCEL_REASON)}, 'unknown') as reason from e where {has(P.CANCELLED)}) group by 1, 2""")
def cancelled_queries(e):
    return extract.cancelled_queries(e).groupBy("reason", "database").agg(F.count(F.lit(1)).alias("count"))


_POOLER = f"""pooler as (
  select seq, coalesce({part(P.POOLER_EVENT, 2)}, database) as database, coalesce({part(P.POOLER_EVENT, 3)}, "user") as "user", {part(P.POOLER_MS)}::double as ms, {part(P.POOLER_ERROR)} as error
  from e where {has(P.POOLER)})"""


@on_log("select count(*) as events, count(ms) as requests, round(avg(ms), 4) as avg_ms, max(ms) as max_ms, sum(ms) as total_ms, count(distinct error) as distinct_errors from pooler", _POOLER)
def pgbouncer_summary(e):
    return rounded(aggregate.pooler_summary(e).drop("bytes_in", "bytes_out"))


@on_log("""select database, "user", count(*) as events from pooler group by 1, 2""", _POOLER)
def pgbouncer_by_database(e):
    return extract.pooler_events(e).groupBy("database", "user").agg(F.count(F.lit(1)).alias("events"))


@on_log(
    f"""select seq, trim({part(P.PLAN_START)}) as query, {O.fingerprint(f"trim({part(P.PLAN_START)})")} as fingerprint, trim(regexp_extract(message, '(?is)Query Text:[^\\n]*\\n(.*)$', 1)) as plan, duration_ms, database
from e where {has(P.PLAN_START)}"""
)
def auto_explain_plans(e):
    return ordered.plan_blocks(e).select("seq", "query", "fingerprint", "plan", "duration_ms", "database")


@on_log("select error, count(*) as count, min(seq) as first from pooler where error is not null group by 1 order by 2 desc, 3 limit 20", _POOLER)
def pgbouncer_errors(e):
    return aggregate.pooler_errors(e)


@on_log("select max(open)::bigint as peak, n as connections, case when n > 0 then round_even(least(100.0, 100.0 * max(open) / n), 1)::double else 100.0 end as efficiency from open, (select count(*) filter (where " + _CONNECTS + ") as n from e) where kind = 1 group by n", _OPEN)
def pool_efficiency(e):
    return aggregate.pool_efficiency(e)


_PLANS = f"""plans as (
  select {O.fingerprint(f"trim({part(P.PLAN_START)})")} as fingerprint, trim(regexp_extract(message, '(?is)Query Text:[^\n]*\n(.*)$', 1)) as plan, duration_ms from e where {has(P.PLAN_START)})"""


@on_log("select fingerprint, n as count, coalesce(p, 0) as plans from (select fingerprint, count(*) as n from slow group by 1) left join (select fingerprint, count(*) as p from plans group by 1) using (fingerprint)", _SLOW, _PLANS)
def slow_queries_with_plans(e):
    return ordered.with_plans(aggregate.slow_queries(e, SLOW, None), ordered.plan_blocks(e)).select("fingerprint", "count", F.coalesce("plans", F.lit(0)).alias("plans"))


# --- rates, filters, health -----------------------------------------------------------------------------------


@on_log(
    f"""select {HOUR} as hour, count(*) as entries, count(*) filter (where {ERROR}) as errors, count(*) filter (where duration_ms >= {SLOW}) as slow, count(*) filter (where {_CONNECTS}) as connections,
  count(*) filter (where {has(P.LOCK_WAIT)} or {has(P.DEADLOCK)}) as locks, count(*) filter (where {has(P.CHECKPOINT)}) as checkpoints, count(*) filter (where {has(P.AUTOVACUUM)}) as autovacuums from e group by 1"""
)
def hourly_timeline(e):
    return aggregate.hourly_timeline(e, SLOW)


_SPAN = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)"


@on_log(
    f"""select count(*) as entries, count(*) filter (where duration_ms >= 0) as statements, count(*) filter (where {ERROR}) as errors, {STAMP("min(ts)")} as "from", {STAMP("max(ts)")} as "to", round({_SPAN}, 4) as span_s,
  round_even(count(*) filter (where duration_ms >= 0) / {_SPAN}, 4) as statements_per_s, round_even(count(*) filter (where {ERROR}) / ({_SPAN} / 60), 4) as errors_per_min, round_even(count(*) filter (where duration_ms >= 0) / ({_SPAN} / 60), 4) as statements_per_min from e"""
)
def throughput_summary(e):
    return rounded(aggregate.throughput(e))


_FROM, _TO = dt.datetime(2024, 1, 5, tzinfo=dt.UTC), dt.datetime(2024, 1, 20, tzinfo=dt.UTC)


@on_log(
    """select database, query_type, count(*) as entries from e where database in ('db1', 'db2') and "user" not in ('u1', 'u2') and ts between timestamp '2024-01-05' and timestamp '2024-01-20'
  and regexp_matches(statement, '(?i)cart|sales') and not regexp_matches(statement, '(?i)delete') group by 1, 2"""
)
def filtered_entries_strict(e):
    own = filters.EntryFilter(databases=["db1", "db2"], exclude_users=["u1", "u2"], from_time=_FROM, to_time=_TO, include=["cart|sales"], exclude=["delete"])
    return own.apply(e).groupBy("database", "query_type").agg(F.count(F.lit(1)).alias("entries"))


@on_log("""select count(*) as entries, count(session) as with_session from (select *, case when pid % 2 = 0 then 's1' end as session from e) where session is null or session = 's1'""")
def filtered_entries_lenient(e):
    rows = e.withColumn("session_id", F.when(F.col("pid") % 2 == 0, "s1"))
    return filters.EntryFilter(sessions=["s1"], strict=False).apply(rows).agg(F.count(F.lit(1)).alias("entries"), F.count("session_id").alias("with_session"))


@on_log(f"select database, count(*) as errors from e where {ERROR} group by 1")
def errors_by_database(e):
    return e.filter(filters.is_error()).groupBy("database").agg(F.count(F.lit(1)).alias("errors"))


# --- before and after, snapshot -------------------------------------------------------------------------------

_HALVES = "where ts {} timestamp '2024-01-16'"


def _halves(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    middle = F.lit("2024-01-16").cast("timestamp")
    return e.filter(F.col("timestamp") < middle), e.filter(F.col("timestamp") >= middle)


def _statements(name: str, op: str) -> str:
    return f"{name} as (select fingerprint, count(*) as count, avg(duration_ms) as avg_ms, quantile_cont(duration_ms, 0.95) as p95_ms, sum(duration_ms) as total_ms from slow {_HALVES.format(op)} group by 1)"


def _status(before: str, after: str, share: float, up: str, down: str) -> str:
    r = f"case when coalesce({before}, 0) = 0 then 1.0 else {after} / {before}::double end"
    return f"case when a.count is null then 'new' when b.count is null then 'disappeared' when {r} > {1 + share} then '{up}' when {r} < {1 - share} then '{down}' else 'unchanged' end"


@on_log(
    f"""select fingerprint, a.count as count_before, b.count as count_after, round(a.p95_ms, 4) as p95_before, round(b.p95_ms, 4) as p95_after, {_status("a.p95_ms", "b.p95_ms", 0.10, "slower", "faster")} as status
from a full outer join b using (fingerprint)""",
    _SLOW, _statements("a", "<"), _statements("b", ">="),
)
def diff_queries(e):
    a, b = (aggregate.slow_queries(x, SLOW, None) for x in _halves(e))
    out = compare.diff_queries(a, b)
    return rounded(out.select("fingerprint", "count_before", "count_after", F.col("p95_ms_before").alias("p95_before"), F.col("p95_ms_after").alias("p95_after"), "status"))


@on_log(
    f"""select pattern, a.count as count_before, b.count as count_after, {_status("a.count", "b.count", 0.20, "increased", "decreased")} as status from a full outer join b using (pattern)""",
    _ERRORS, f"a as (select pattern, count(*) as count from errors {_HALVES.format('<')} group by 1)", f"b as (select pattern, count(*) as count from errors {_HALVES.format('>=')} group by 1)",
)
def diff_errors(e):
    a, b = (aggregate.error_patterns(x, None) for x in _halves(e))
    return compare.diff_errors(a, b)


def _scalars(op: str) -> str:
    w = _HALVES.format(op)
    return f"""select unnest(['entries', 'errors', 'fatals', 'slow_statements', 'slow_ms', 'lock_events', 'deadlocks', 'checkpoints', 'autovacuums', 'temporary_files', 'connections', 'auth_failures']) as metric,
      unnest([count(*), count(*) filter (where {ERROR}), count(*) filter (where log_level in ('FATAL', 'PANIC')), count(*) filter (where duration_ms >= {SLOW}), sum(duration_ms) filter (where duration_ms >= {SLOW}),
              count(*) filter (where {has(P.LOCK_WAIT)} or {has(P.DEADLOCK)}), count(*) filter (where {has(P.DEADLOCK)}), count(*) filter (where {has(P.CHECKPOINT_DONE)}), count(*) filter (where {has(P.AUTOVACUUM_TABLE)}),
              count(*) filter (where {has(P.TEMPORARY_FILE)}), count(*) filter (where {_CONNECTS}), count(*) filter (where {has(P.AUTH_FAILED)})]::double[]) as value from e {w}"""


@on_log(
    'select metric, round(a.value, 4) as "before", round(b.value, 4) as "after", round(b.value - a.value, 4) as delta from a join b using (metric)', f"a as ({_scalars('<')})", f"b as ({_scalars('>=')})"
)
def diff_metrics(e):
    a, b = _halves(e)
    return rounded(compare.diff_metrics(a, b, SLOW).filter(~F.col("metric").isin("checkpoint_avg_ms", "temporary_bytes")).drop("change"))


def _snapshot(e: DataFrame) -> DataFrame:
    """A snapshot made of the log itself: half of its statements, in the snapshot's notation, and one of its own."""
    rows = e.filter(filters.is_slow(SLOW)).withColumn("q", F.regexp_replace(X.fingerprint(F.coalesce("query", "message")), r"\?", r"\$1"))
    some = rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), X.exact_sum(F.col("duration_ms")).alias("ms")).filter(F.col("n") % 2 == 0)
    own = some.select(F.col("n").alias("queryid"), F.col("q").alias("query"), (F.col("n") * 2).alias("calls"), (F.col("ms") / 2).alias("total_exec_time"))
    one = e.sparkSession.range(1).select(F.lit(-1).cast("long").alias("queryid"), F.lit("VACUUM ANALYZE only_here").alias("query"), F.lit(3).cast("long").alias("calls"), F.lit(9.5).alias("total_exec_time"))
    both = own.unionByName(one)
    return both.withColumns({"mean_exec_time": F.col("total_exec_time") / F.col("calls"), "rows": F.col("calls"), "shared_blks_hit": F.col("calls") * 3, "shared_blks_read": F.col("calls"), "temp_blks_written": F.lit(0).cast("long")})


_SNAPSHOT = "snapshot as (select fingerprint, count(*) as n, sum(duration_ms) as ms from slow group by 1 having count(*) % 2 = 0)"
_LOGGED = "logged as (select fingerprint, count(*) as n, sum(duration_ms) as ms from slow group by 1)"


@on_log(
    "select fingerprint, l.n as log_calls, s.n * 2 as calls, round(l.ms, 2) as log_ms, round(s.ms / 2, 2) as snapshot_ms, 0.5::double as call_ratio, 75.0::double as cache_hit_ratio from logged l join snapshot s using (fingerprint)",
    _SLOW, _SNAPSHOT, _LOGGED,
)
def snapshot_matched(e):
    out = snapshot.matched(aggregate.slow_queries(e, SLOW, None), _snapshot(e))
    return rounded(out.select("fingerprint", "log_calls", "calls", "log_ms", "snapshot_ms", "call_ratio", "cache_hit_ratio"), 2)


@on_log("select fingerprint, n as count from logged where fingerprint not in (select fingerprint from snapshot)", _SLOW, _SNAPSHOT, _LOGGED)
def snapshot_log_only(e):
    return snapshot.log_only(aggregate.slow_queries(e, SLOW, None), _snapshot(e)).select("fingerprint", "count")


@on_log("select 'VACUUM ANALYZE only_here' as fingerprint, 3::bigint as calls")
def snapshot_only(e):
    return snapshot.snapshot_only(aggregate.slow_queries(e, SLOW, None), _snapshot(e)).select("fingerprint", "calls")


@on_log("select (select count(*) from logged) as log_queries, (select count(*) from snapshot) as matched, round((select count(*) from snapshot) / (select count(*) from logged), 4) as match_rate", _SLOW, _SNAPSHOT, _LOGGED)
def snapshot_match_rate(e):
    return rounded(snapshot.match_rate(aggregate.slow_queries(e, SLOW, None), _snapshot(e)))


@on_log("select 'VACUUM ANALYZE only_here' as query, 3::bigint as calls")
def snapshot_by_id(e):
    return snapshot.by_id(_snapshot(e), -1).select("query", "calls")


@on_log("select count(*) + 1 as queries, sum(n * 2)::bigint + 3 as calls from snapshot", _SLOW, _SNAPSHOT)
def snapshot_totals(e):
    return snapshot.totals(_snapshot(e)).select("queries", "calls")


# --- rules, timeline, summary ---------------------------------------------------------------------------------

_T = rules.Thresholds(slow_ms=SLOW)
_ROW = f"""row as (select
  (select count(*) from locks where not is_deadlock) as lock_waits, (select count(*) from locks where is_deadlock) as deadlocks, (select max(open) from open where kind = 1) as peak,
  (select count(*) from e where {has(P.CHECKPOINT_OFTEN)}) as often, (select avg(duration_ms) from done) as checkpoint_ms, (select max({part(P.TEMPORARY_FILE, 2)}::double / 1048576) from e where {has(P.TEMPORARY_FILE)}) as largest_mb,
  (select max(n) from (select count(*) as n from vacuums group by "schema", "table")) as most_vacuums, (select max(wal_bytes) from vacuums) as wal, (select count(*) from e where {has(P.AUTH_FAILED)}) as auth,
  (select max({part(P.REPLICATION_LAG, 1)}::double * case lower(coalesce({part(P.REPLICATION_LAG, 2)}, 'bytes')) when 'mb' then 1048576 when 'gb' then 1073741824 when 's' then 0 else 1 end) from e where {has(P.REPLICATION_LAG)}) as lag_bytes,
  (select count(*) from e where log_level in ('FATAL', 'PANIC') and {has(P.OUT_OF_MEMORY)}) as oom, (select count(*) from e where {ERROR} and {has(P.DISK_FULL)}) as disk, (select count(*) from e where {has(P.CANCELLED)}) as cancelled,
  (select max(n) * 5 // 60 from (select count(*) as n from e where {ERROR} group by hour(ts))) as storm, (select count(*) from e where log_level in ('FATAL', 'PANIC') and {has(P.SSL)}) as ssl, (select max(duration_ms) from e) as longest,
  (select sum(duration_ms) filter (where phase = 'parse') / sum(duration_ms) filter (where phase = 'execute') from e) as parse_ratio,
  (select count(*) filter (where query_type in ('update', 'delete')) / count(*)::double from e where {TYPED} and query_type <> 'vacuum') as dml_ratio,
  (select max(n) / sum(n)::double from (select count(*) as n from e where {_CONNECTS} group by host)) as host_share,
  (select sum(ms) from sessions) as session_ms, (select sum(duration_ms) from e where pid in (select pid from sessions)) as busy_ms
)"""


def _found(t: rules.Thresholds, platform: str = "") -> str:
    """The 23 rules as the survey lists them, with their thresholds."""
    mb = 1024 * 1024
    grown = "select *, row_number() over (partition by fingerprint order by seq) - 1 as nth from slow"
    some = [
        ("HIGH_CHECKPOINT_FREQUENCY", "'HIGH'", f"often >= {t.checkpoint_often}"),
        ("SLOW_CHECKPOINTS", "'MEDIUM'", f"checkpoint_ms > {t.checkpoint_slow_ms}"),
        ("CONNECTION_EXHAUSTION", f"case when peak >= {t.connection_critical} then 'CRITICAL' else 'HIGH' end", f"peak >= {t.connection_warn}"),
        ("LOCK_STORMS", f"case when lock_waits >= {t.lock_critical} then 'CRITICAL' else 'HIGH' end", f"lock_waits >= {t.lock_warn}"),
        ("DEADLOCK_PATTERN", "'HIGH'", f"deadlocks >= {t.deadlock_warn}"),
        ("TEMP_FILE_ABUSE", f"case when largest_mb >= {t.temporary_high_mb} then 'HIGH' else 'MEDIUM' end", f"largest_mb >= {t.temporary_mb}"),
        ("AUTOVACUUM_LAGGING", f"case when most_vacuums >= {t.autovacuum_high} then 'HIGH' else 'MEDIUM' end", f"most_vacuums >= {t.autovacuum_warn}"),
        ("AUTH_FAILURES_SPIKE", f"case when auth >= {t.auth_critical} then 'CRITICAL' else 'HIGH' end", f"auth >= {t.auth_warn}"),
        ("REPLICATION_LAG", f"case when lag_bytes >= {t.lag_critical_mb * mb} then 'CRITICAL' else 'HIGH' end", "lag_bytes > 0"),
        ("OOM_KILLER", "'CRITICAL'", "oom > 0"),
        ("SLOW_QUERY_REGRESSION", "'HIGH'", f"exists (select 1 from ({grown}) group by fingerprint having count(*) >= 5 and regr_slope(duration_ms, nth) > 0.01 * avg(duration_ms))"),
        ("ERROR_STORM", "'CRITICAL'", f"storm >= {t.storm}"),
        ("SSL_FATAL_ERRORS", "'HIGH'", "ssl > 0"),
        ("DISK_FULL", "'CRITICAL'", f"disk >= {t.disk_events}"),
        ("LONG_RUNNING_TRANSACTIONS", f"case when longest >= {t.long_critical_ms} then 'CRITICAL' else 'HIGH' end", f"longest >= {t.long_warn_ms}"),
        ("HIGH_SESSION_IDLE_TIME", "'MEDIUM'", f"(session_ms - busy_ms) / session_ms > {t.idle_ratio}"),
        ("QUERY_TYPE_IMBALANCE", "'HIGH'", f"dml_ratio > {t.dml_ratio} and lock_waits + deadlocks >= {t.dml_locks}"),
        ("PREPARE_PHASE_BOTTLENECK", "'MEDIUM'", f"parse_ratio > {t.parse_ratio}"),
        ("AUTOVACUUM_WAL_AMPLIFICATION", "'HIGH'", f"wal > {t.wal_bytes}"),
        ("CONNECTION_STORM_BY_HOST", "'HIGH'", f"host_share > {t.host_share}"),
        ("MANAGED_PLATFORM_DETECTED", "'INFO'", f"'{platform}' in ('rds', 'redshift')"),
        ("PGBOUNCER_POOL_EXHAUSTION", "'CRITICAL'", f"(select count(distinct error) from pooler) > {t.pool_errors}"),
        ("CANCELLED_QUERY_STORM", "'HIGH'", f"cancelled > {t.cancelled}"),
    ]
    return "findings as (\n  " + "\n  union all ".join(f"select '{id}' as rule_id, {severity} as severity from row where {when}" for id, severity, when in some) + "\n)"


_BEFORE_RULES = (_SLOW, _LOCKS, _OPEN, _DONE, _VACUUMS, _SESSIONS, _POOLER, _ROW)
_RULE_CTES = (*_BEFORE_RULES, _found(_T))
#: Thresholds by which every rule and detector finds something in the events.
_LOW = rules.Thresholds(
    slow_ms=SLOW, checkpoint_slow_ms=1000.0, storm=1, long_warn_ms=100.0, dml_ratio=0.05, parse_ratio=0.01, wal_bytes=1_000_000, host_share=0.05, pool_errors=1, checkpoint_spike_high_ms=100_000.0, vacuum_long_ms=1000.0,
    vacuum_high_ms=100_000.0, wave_gap="5 hours", wave_high=5, lag_event_s=5.0, spike_ms=120.0, spike_high_ms=190.0, idle_ratio=0.1, connection_warn=5, temporary_mb=10.0, burst_medium=2, burst_high=3, burst_critical=4, auth_spike=2, cancelled_wave=2,
)


@on_log("select * from findings", *_BEFORE_RULES, _found(_LOW, "rds"), scans=12)
def rca_every_rule(e):
    return rules.run(e, _LOW, platform="rds").select("rule_id", "severity")


@on_log("select * from findings", *_RULE_CTES, scans=12)
def rca_findings(e):
    return rules.run(e, _T).select("rule_id", "severity")


@on_log("select rule_id, case rule_id when 'OOM_KILLER' then 'LOW' when 'LOCK_STORMS' then 'MEDIUM' else severity end as severity from findings", *_RULE_CTES, scans=12)
def rca_with_overrides(e):
    return rules.run(e, _T, rules.RulePack(severity_overrides={"OOM_KILLER": "low", "LOCK_STORMS": "MEDIUM"})).select("rule_id", "severity")


@on_log("select 'MANY_DEADLOCKS' as rule_id, 'HIGH' as severity from row where deadlocks > 20 and auth > 2", *_RULE_CTES, scans=12)
def custom_rules(e):
    pack = rules.RulePack(custom=[rules.CustomRule("MANY_DEADLOCKS", "deadlocks > 20 and auth_failures > 2", "HIGH"), rules.CustomRule("NEVER", "errors < 0"), rules.CustomRule("OFF", "errors >= 0", enabled=False)])
    return rules.run(e, _T, pack).filter(F.col("rule_id").isin("MANY_DEADLOCKS", "NEVER", "OFF")).select("rule_id", "severity")


_ADVICE = ", ".join(f"({O.quoted(r.id)}, {O.quoted(a)})" for r in rules.RULES for a in r.advice)


@on_log(f"select distinct advice from findings join (values {_ADVICE}) a(rule, advice) on rule = rule_id", *_RULE_CTES, scans=12)
def distinct_recommendations(e):
    return rules.recommendations(rules.run(e, _T))


def _happened(t: rules.Thresholds) -> str:
    """The detectors as the survey lists them, but that a burst counts the errors of its own minute."""
    number, unit = t.wave_gap.split()
    fatal = "log_level in ('FATAL', 'PANIC')"
    amount = f"select ts, {part(P.REPLICATION_LAG, 1)}::double as n, lower(coalesce({part(P.REPLICATION_LAG, 2)}, 'bytes')) as unit from e where {has(P.REPLICATION_LAG)}"
    waves = f"select *, sum(case when ts - was <= interval {number} {unit} then 0 else 1 end) over (order by ts, seq) as wave from (select *, lag(ts) over (order by ts, seq) as was from locks where not is_deadlock)"
    top = f"select max(duration_ms) as most, min(ts) as first from e_slow group by fingerprint order by sum(duration_ms) desc, fingerprint limit {t.spike_patterns}"
    top = top.replace("e_slow", f"(select *, {O.fingerprint('statement')} as fingerprint from e where duration_ms >= {t.slow_ms})")
    return f"""events_found as (
  select 'error_burst' as event_type, case when n >= {t.burst_critical} then 'critical' when n >= {t.burst_high} then 'high' else 'medium' end as severity, moment from (select date_trunc('minute', ts) as moment, count(*) as n from errors group by 1) where n >= {t.burst_medium}
  union all select 'deadlock', 'high', ts from locks where is_deadlock
  union all select 'lock_wave', case when count(*) >= {t.wave_high} then 'high' else 'medium' end, min(ts) from ({waves}) group by wave having count(*) >= {t.wave_least}
  union all select 'checkpoint_spike', case when duration_ms > {t.checkpoint_spike_high_ms} then 'high' else 'medium' end, ts from done where duration_ms >= {t.checkpoint_slow_ms}
  union all select 'autovacuum', case when elapsed_s * 1000 >= {t.vacuum_high_ms} then 'high' else 'medium' end, ts from vacuums join e using (seq) where elapsed_s * 1000 >= {t.vacuum_long_ms}
  union all select 'connection_storm', case when max(open) >= {t.connection_critical} then 'critical' else 'high' end, arg_max(ts, open - seq / 1e9) from open where kind = 1 having max(open) >= {t.connection_warn}
  union all select 'auth_failure_spike', case when count(*) filter (where {has(P.AUTH_FAILED)}) >= {t.auth_spike_critical} then 'critical' else 'high' end, min(ts) from e having count(*) filter (where {has(P.AUTH_FAILED)}) >= {t.auth_spike}
  union all select case when {has(P.OUT_OF_MEMORY)} then 'oom' when {has(P.DISK_FULL)} then 'disk_full' when log_level = 'PANIC' then 'panic' else 'fatal' end, case when log_level = 'PANIC' then 'critical' else 'high' end, ts from e where {fatal}
  union all select 'cancellation_wave', case when count(*) >= {t.cancelled_wave_high} then 'high' else 'medium' end, min(ts) from e where {has(P.CANCELLED)} having count(*) >= {t.cancelled_wave}
  union all select 'replication_lag', case when bytes > {t.lag_critical_mb * 1024 * 1024} then 'critical' else 'high' end, ts from (
    select ts, case when unit not like 's%' then n * case unit when 'mb' then 1048576 when 'gb' then 1073741824 else 1 end end as bytes, case when unit like 's%' then n end as secs from ({amount})
  ) where bytes >= {t.lag_event_mb * 1024 * 1024} or secs >= {t.lag_event_s}
  union all select 'slow_query_spike', case when most >= {t.spike_high_ms} then 'high' else 'medium' end, first from ({top}) where most >= {t.spike_ms}
)"""


_BEFORE_EVENTS = (_ERRORS, _LOCKS, _DONE, _VACUUMS, _OPEN)


@on_log(f"select event_type, severity, {STAMP('moment')} as timestamp from events_found", *_BEFORE_EVENTS, _happened(rules.Thresholds()), scans=11)
def timeline_events(e):
    return timeline.build(e).select("event_type", "severity", X.stamp(F.col("timestamp")).alias("timestamp"))


@on_log(f"select event_type, severity, {STAMP('moment')} as timestamp from events_found", *_BEFORE_EVENTS, _happened(_LOW), scans=11)
def timeline_every_detector(e):
    return timeline.build(e, _LOW).select("event_type", "severity", X.stamp(F.col("timestamp")).alias("timestamp"))


@on_log("select event_type, severity, count(*) as events from events_found where moment between timestamp '2024-01-10' and timestamp '2024-01-20' group by 1, 2", *_BEFORE_EVENTS, _happened(rules.Thresholds()), scans=11)
def timeline_in_window(e):
    return timeline.counts(timeline.within(timeline.build(e), "2024-01-10", "2024-01-20"))


@on_log(
    "select case when count(*) filter (where severity = 'CRITICAL') > 0 then 2 when count(*) filter (where severity = 'HIGH') > 0 then 1 else 0 end as exit_code, count(*) as findings, count(*) filter (where severity = 'CRITICAL') as critical from findings",
    *_RULE_CTES,
    scans=12,
)
def summary_health(e):
    from sawmill.plans.report import health

    return health(rules.run(e, _T))


def queries() -> dict:
    return QUERIES | roundtrip.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | roundtrip.oracle_sql()
