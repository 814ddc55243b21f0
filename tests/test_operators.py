import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sawmill.functions import text as X
from sawmill.operators import aggregate, compare, extract, filters, ordered, snapshot
from sawmill.operators.enrich import enrich

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "seq long, timestamp timestamp, pid int, log_level string, user string, database string, message string"


def entries(spark, rows):
    return enrich(spark.createDataFrame([(i, T0 + dt.timedelta(seconds=r[0]), r[1], r[2], r[3] if len(r) > 4 else "u", r[4] if len(r) > 4 else "d", r[-1]) for i, r in enumerate(rows)], SCHEMA))


def test_statements_meet_durations_as_in_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(6), "LOG", rng.choice(["statement: SELECT %d" % i, "duration: %d ms" % i, "duration: 1 ms  statement: SELECT 9", "hello"])) for i in range(1500)]
    open_, want = {}, {}
    for i, (_, pid, _, m) in enumerate(rows):
        if m.startswith("statement"):
            open_[pid] = m.split(": ")[1]
        elif m.startswith("duration") and "statement" not in m:
            if pid in open_:
                want[i] = open_.pop(pid)
    got = {r["seq"]: r["query"] for r in ordered.correlate_statements(entries(spark, rows)).collect() if rows[r["seq"]][3].startswith("duration") and "statement" not in rows[r["seq"]][3] and r["query"]}
    assert got == want


def test_concurrency_as_in_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), "LOG", rng.choice(["connection authorized: user=a", "disconnection: session time: 0:00:01.5 user=a database=b host=c", "x"])) for i in range(2000)]
    open_, want = set(), {}
    for i, (_, pid, _, m) in enumerate(rows):
        if m.startswith("connection"):
            open_.add(pid)
            want[i] = len(open_)
        elif m.startswith("disconnection"):
            open_.discard(pid)
    e = entries(spark, rows)
    assert {r["seq"]: r["open"] for r in ordered.concurrency(e, bucket=37).collect()} == want
    assert ordered.peak_concurrent(e).first()["peak"] == max(want.values())
    assert ordered.peak_by_hour(e).first()["peak"] == max(want.values())


def test_sessions(spark):
    e = entries(spark, [(0, 1, "LOG", "connection authorized: user=a"), (5, 1, "LOG", "disconnection: session time: 0:00:09.000 user=a"), (6, 1, "LOG", "disconnection: session time: later"), (7, 2, "LOG", "connection received: host=h"), (9, 2, "LOG", "disconnection: session time: soon")])
    got = [(r["pid"], r["duration_ms"], r["started"] is None) for r in ordered.sessions(e).orderBy("seq").collect()]
    assert got == [(1, 9000.0, False), (1, None, True), (2, 2000.0, False)]
    s = ordered.session_summary(e).first()
    assert s["sessions"] == 3 and abs(s["avg_ms"] - 11000 / 3) < 1e-9


def test_islands_join_at_the_very_gap(spark):
    rows = [(x,) for x in (0, 300, 600, 901, 902, 903, 5000)]
    d = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for (s,) in rows], "timestamp timestamp")
    assert sorted(r["members"] for r in ordered.islands(d, "5 minutes", 1).collect()) == [1, 3, 3]
    assert ordered.islands(d, "5 minutes", 4).count() == 0


def test_plans(spark):
    rows = [(0, 1, "LOG", "duration: 5 ms  plan:\nQuery Text: SELECT 1\nSeq Scan on t"), (1, 1, "LOG", "Query Text: SELECT 2"), (2, 1, "LOG", "Sort  (cost=1)"), (3, 2, "LOG", "x"), (4, 1, "LOG", "->  Index Scan on t"), (5, 1, "LOG", "other"), (6, 1, "LOG", "Query Text: nothing")]
    got = [(r["query"], r["plan"], r["duration_ms"]) for r in ordered.plan_blocks(entries(spark, rows)).orderBy("seq").collect()]
    assert got == [("SELECT 1", "Seq Scan on t", 5.0), ("SELECT 2", "Sort  (cost=1)\n->  Index Scan on t", None)]
    formats = spark.createDataFrame([("{",), ("<a>",), ("--- x",), ("Sort",)], "p string").select(extract.plan_format(F.col("p")).alias("f")).collect()
    assert [r["f"] for r in formats] == ["json", "xml", "yaml", "text"]


def test_extractors(spark):
    rows = [
        (0, 5, "LOG", "process 7 still waiting for ShareLock on transaction 9 after 1000.5 ms\nDETAIL: Process holding the lock: 8. Wait queue: 7."), (1, 5, "ERROR", "deadlock detected"),
        (2, 5, "LOG", "checkpoint complete: wrote 10 buffers (1.5%); 0 WAL file(s) added, 1 removed, 2 recycled; write=0.5 s, sync=0.1 s, total=2.5 s; distance=100 kB, estimate=200 kB"),
        (3, 5, "LOG", 'automatic vacuum of table "db.s.t": index scans: 2 pages: 3 removed, 4 remain tuples: 5 removed elapsed: 1.5 s'), (4, 5, "LOG", 'temporary file: path "p", size 10485760'),
        (5, 5, "LOG", 'replication slot "x" lag: 2 MB'), (6, 5, "LOG", 'replication slot "x" lag = 12 s'), (7, 5, "ERROR", "canceling statement due to user request"), (8, 5, "LOG", "checkpoint starting: immediate"),
    ]
    e = entries(spark, rows)
    locks = extract.lock_events(e).orderBy("seq").collect()
    assert (locks[0]["waiting_pid"], locks[0]["blocking_pid"], locks[0]["wait_duration_ms"], locks[0]["lock_type"]) == (7, 8, 1000.5, "ShareLock") and (locks[1]["waiting_pid"], locks[1]["is_deadlock"]) == (5, True)
    c = extract.checkpoint_events(e).first()
    assert (c["buffers"], c["duration_ms"], c["distance_kb"], c["estimate_kb"]) == (10, 2500.0, 100, 200)
    v = extract.autovacuum_runs(e).first()
    assert (v["schema"], v["table"], v["duration_ms"], v["pages_removed"], v["tuples_removed"], v["index_scans"], v["wal_bytes"]) == ("s", "t", 1500.0, 3, 5, 2, 0)
    assert extract.temporary_files(e).first()["size_mb"] == 10.0
    assert [(r["lag_bytes"], r["lag_seconds"]) for r in extract.replication_lag(e).orderBy("seq").collect()] == [(2097152, None), (None, 12.0)]
    assert extract.cancelled_queries(e).first()["reason"] == "user request" and extract.checkpoint_causes(e).first()["type"] == "immediate"
    marked = extract.marked(e).orderBy("seq").collect()
    names = list(extract.KINDS)
    kinds = [{n for i, n in enumerate(names) if r["marks"] >> i & 1} for r in marked]
    assert kinds == [{"lock_wait"}, {"deadlock"}, {"checkpoint", "checkpoint_done"}, {"autovacuum", "autovacuum_table"}, {"temporary_file"}, {"replication_lag"}, {"replication_lag"}, {"cancelled"}, {"checkpoint", "checkpoint_cause"}]
    assert extract.lock_events(extract.marked(e)).count() == 2


def test_vacuum_counters_of_the_servers_text(spark):
    text = """automatic vacuum of table "shop.public.orders": index scans: 1
\tpages: 12 removed, 340 remain, 5 skipped due to pins, 60 skipped frozen
\ttuples: 700 removed, 8000 remain, 91 are dead but not yet removable, oldest xmin: 1234
\tbuffer usage: 1500 hits, 26 misses, 37 dirtied
\tWAL usage: 48 records, 5 full page images, 61234 bytes
\tsystem usage: CPU: user: 0.12 s, system: 0.03 s, elapsed: 61.70 s"""
    v = extract.autovacuum_runs(entries(spark, [(0, 1, "LOG", text)])).first().asDict()
    want = {"index_scans": 1, "pages_removed": 12, "skipped_pins": 5, "skipped_frozen": 60, "tuples_removed": 700, "dead_tuples": 91, "buffer_hits": 1500, "buffer_misses": 26, "buffers_dirtied": 37}
    want |= {"wal_records": 48, "wal_fpi": 5, "wal_bytes": 61234, "cpu_user_s": 0.12, "cpu_sys_s": 0.03, "duration_ms": 61700.0}
    assert {k: v[k] for k in want} == want


def test_processes_of_two_files_are_apart(spark):
    rows = [(0, 1, "LOG", "statement: SELECT 1", "a"), (1, 1, "LOG", "duration: 5 ms", "b"), (2, 1, "LOG", "duration: 6 ms", "a"), (3, 2, "LOG", "statement: SELECT 2", "a"), (4, 2, "LOG", "connection authorized: user=x", "a"), (5, 2, "LOG", "duration: 7 ms", "a")]
    e = enrich(spark.createDataFrame(rows, "seq long, pid int, log_level string, message string, source_file string"))
    got = {r["seq"]: r["query"] for r in ordered.correlate_statements(e).collect()}
    assert got[2] == "SELECT 1" and got[1] is None and got[5] is None


def test_islands_over_edges_of_buckets(spark):
    import random

    rng = random.Random(3)
    at, times = 0.0, []
    for _ in range(400):
        at += rng.choice([1, 30, 60, 61, 200, 4000])
        times.append(at)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, s double").select("seq", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("timestamp"))
    want, run = [], [times[0]]
    for t in times[1:]:
        if t - run[-1] <= 60:
            run.append(t)
        else:
            want.append(run)
            run = [t]
    want = sorted((len(r), r[0], r[-1]) for r in [*want, run] if len(r) >= 3)
    for bucket in (60, 300, 3600, 10**7):
        got = ordered.islands(d, "1 minute", 3, bucket_s=bucket).select("members", F.unix_micros("from").alias("a"), F.unix_micros("to").alias("b")).collect()
        assert sorted((r["members"], r["a"] / 1e6, r["b"] / 1e6) for r in got) == want


def test_regression(spark):
    d = spark.createDataFrame([("up", i, 100.0 * (i + 1)) for i in range(10)] + [("flat", i, 50.0) for i in range(10)] + [("few", i, 10.0**i) for i in range(4)], "fingerprint string, seq long, duration_ms double")
    got = {r["fingerprint"]: (r["slope"], r["regressing"]) for r in ordered.regressions(d).collect()}
    assert got["up"] == (100.0, True) and got["flat"] == (0.0, False) and not got["few"][1]


def test_filters(spark):
    e = entries(spark, [(0, 1, "LOG", "a", "x", "statement: SELECT 1"), (10, 2, "ERROR", "b", None, "boom"), (20, None, "LOG", "a", "y", "statement: DELETE FROM t")])
    ids = lambda **k: [r["seq"] for r in filters.EntryFilter(**k).apply(e).orderBy("seq").collect()]
    assert ids(databases=["x"]) == [0] and ids(databases=["x"], strict=False) == [0, 1] and ids(pids=[2]) == [1]
    assert ids(exclude_users=["a"]) == [1] and ids(select_only=True) == [0] and ids(include=["select|delete"]) == [0, 2] and ids(exclude=["BOOM"]) == [0, 2]
    assert ids(from_time=T0 + dt.timedelta(seconds=10)) == [1, 2] and ids() == [0, 1, 2]
    assert filters.without_ignored(e, ["bo+m"], ["delete"]).count() == 1
    now = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    assert filters.relative_time("2h", now) == filters.relative_time("-120m", now) == now - dt.timedelta(hours=2)
    assert filters.relative_time("2024-01-01T05:00:00").tzinfo is dt.UTC
    with pytest.raises(ValueError):
        filters.relative_time("soon")


def test_error_patterns(spark):
    e = entries(spark, [(i, 1, "ERROR", f"u{i % 2}", "d", f'relation "t{i}" does not exist (42P01)') for i in range(5)] + [(4000, 1, "FATAL", "z", "d", "out of memory")])
    got = aggregate.error_patterns(e).collect()
    assert (got[0]["count"], got[0]["error_code"], got[0]["category"], got[0]["hourly"], got[0]["users"]) == (5, "42P01", "query", {0: 5}, ["u0", "u1"])
    assert got[1]["hourly"] == {1: 1}


def test_totals_do_not_hang_on_the_order_of_rows(spark):
    """Halves of a total lie on ties of two decimals, so the least error of a sum shows after rounding."""
    rng = random.Random(12)
    ms = [rng.randrange(100_000, 900_000) for _ in range(3001)]
    ms[0] += 1 - sum(ms) % 2
    rows = [(i, 1, "LOG", f"duration: {m // 100}.{m % 100:02d} ms  statement: SELECT {i}") for i, m in enumerate(ms)]
    for e in (entries(spark, rows), entries(spark, rows[::-1]).repartition(7)):
        q = aggregate.slow_queries(e, 1000, None)
        assert q.first()["total_ms"] == sum(ms) / 100
        assert q.select(F.round(F.col("total_ms") / 2, 2).alias("half")).first()["half"] == (sum(ms) // 2 + 1) / 100
    odd = spark.createDataFrame([(1, 1e300), (1, 0.25), (2, float("nan")), (3, None), (4, 1e-9), (4, 2e-9)], "k int, x double")
    got = {r["k"]: r["s"] for r in odd.groupBy("k").agg(X.exact_sum(F.col("x")).alias("s")).collect()}
    assert got[1] == 1e300 and got[2] != got[2] and got[3] is None and abs(got[4] - 3e-9) < 1e-15


def test_diff_and_snapshot(spark):
    q = lambda rows: spark.createDataFrame(rows, "fingerprint string, count long, avg_ms double, p95_ms double, total_ms double")
    d = {r["fingerprint"]: r["status"] for r in compare.diff_queries(q([("a", 1, 1.0, 100.0, 1.0), ("b", 1, 1.0, 100.0, 1.0), ("c", 1, 1.0, 0.0, 1.0), ("gone", 1, 1.0, 1.0, 1.0)]), q([("a", 1, 1.0, 111.0, 1.0), ("b", 1, 1.0, 89.0, 1.0), ("c", 1, 1.0, 50.0, 1.0), ("new", 1, 1.0, 1.0, 1.0)])).collect()}
    assert d == {"a": "slower", "b": "faster", "c": "unchanged", "gone": "disappeared", "new": "new"}
    e = entries(spark, [(0, 1, "LOG", "duration: 2000 ms  statement: SELECT a FROM t WHERE b = 'x' AND c IN (1, 2)")])
    s = spark.createDataFrame([(1, "select a from t where b = $1 and c in ($2, $3)", 4, 1000.0, 250.0, 1, 3, 1, 0), (2, "vacuum", 1, 1.0, 1.0, 0, 0, 0, 0)], "queryid long, query string, calls long, total_exec_time double, mean_exec_time double, rows long, shared_blks_hit long, shared_blks_read long, temp_blks_written long")
    queries = aggregate.slow_queries(e, 1000, None)
    m = snapshot.matched(queries, s).first()
    assert (m["call_ratio"], m["time_delta_ms"], m["cache_hit_ratio"]) == (0.25, 1000.0, 75.0)
    assert snapshot.log_only(queries, s).count() == 0 and [r["query"] for r in snapshot.snapshot_only(queries, s).collect()] == ["vacuum"]
    assert snapshot.match_rate(queries, s).first()["match_rate"] == 1.0 and snapshot.enriched(queries, s).first()["snapshot_calls"] == 4
