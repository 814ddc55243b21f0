import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sawmill.plans import analysis, catalogue, report, rules, timeline
from sawmill.sources import config
from sawmill.sources.events import log_entries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    c.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return c


def plain(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()) == got


@pytest.fixture(scope="module")
def entries(spark):
    return log_entries(spark, DATA).persist()


def test_analysis_and_reports(spark, entries):
    a = analysis.Analysis(entries, rules.Thresholds(slow_ms=50.0), keep=False)
    own = a.sections()
    parts = report.sections({k: own[k] for k in ("findings", "slow_queries", "errors", "throughput", "timeline", "recommendations")}, {"timeline": 5})
    assert len(parts["timeline"]) <= 5 and parts["slow_queries"]
    assert json.loads(report.render(parts, "json"))["errors"] == json.loads(json.dumps(parts["errors"], default=str))
    md, html, text = (report.render(parts, k) for k in ("markdown", "html", "text"))
    assert "## Slow queries" in md and "<h2>Errors</h2>" in html and "== findings" in text and "<script" not in html
    with pytest.raises(ValueError):
        report.render(parts, "pdf")
    summary, code = a.summary()
    assert len(summary.split("\n")) == 5 and code in (0, 1, 2)
    assert analysis.index_candidates(own["slow_queries"]).filter("table_name = 'cart'").count() >= 1
    assert len(analysis.context(a, 200).split(" ")) <= 200 and analysis.explain(a, lambda p: p[:7]) == "You adv"


def test_rules_and_packs(spark, entries):
    row = rules.metrics_row(entries).persist()
    pack = config.rule_pack(config.yaml(config.EXAMPLE_PACK))
    assert pack.severity_overrides == {"OOM_KILLER": "HIGH"} and pack.custom[0].id == "MANY_ERRORS" and pack.ignored_errors == ["duplicate key"]
    pack.custom.append(rules.CustomRule("ANY", "errors > 0", "INFO", advice=["x", "x"]))
    found = rules.findings(row, rules.Thresholds(deadlock_warn=1, storm=1), pack).collect()
    ids = [r["rule_id"] for r in found]
    assert "ANY" in ids and len(ids) == len(set(ids)) and len(rules.RULES) == 23
    ranks = [["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"].index(r["severity"]) for r in found]
    assert ranks == sorted(ranks)
    assert rules.Thresholds.of({"lock_warn": 3, "unknown": 1}).lock_warn == 3
    assert {r["rule_id"] for r in rules.findings(row.withColumn("platform", F.lit("rds"))).collect()} >= {"MANAGED_PLATFORM_DETECTED"}


def fired(spark, **values):
    base = {c: 0 for c in "entries errors fatals connections auth_failures checkpoint_warnings out_of_memory ssl_fatals disk_full cancelled longest_ms slow changes typed parse_ms execute_ms peak_concurrent lock_waits deadlocks checkpoints checkpoint_avg_ms large_files largest_mb most_autovacuums most_wal_bytes most_lag_bytes idle_ratio in_window host_share pool_errors regressing".split()}
    d = spark.createDataFrame([tuple(float(v) for v in (base | values).values())], ", ".join(f"{c} double" for c in base)).withColumn("platform", F.lit(None).cast("string"))
    return {r["rule_id"]: r["severity"] for r in rules.findings(d).collect()}


@pytest.mark.parametrize(
    "values, rule, severity",
    [
        ({"checkpoint_warnings": 3}, "HIGH_CHECKPOINT_FREQUENCY", "HIGH"), ({"checkpoints": 1, "checkpoint_avg_ms": 60001}, "SLOW_CHECKPOINTS", "MEDIUM"), ({"peak_concurrent": 80}, "CONNECTION_EXHAUSTION", "HIGH"),
        ({"peak_concurrent": 150}, "CONNECTION_EXHAUSTION", "CRITICAL"), ({"lock_waits": 50}, "LOCK_STORMS", "CRITICAL"), ({"deadlocks": 2}, "DEADLOCK_PATTERN", "HIGH"), ({"large_files": 1, "largest_mb": 1024}, "TEMP_FILE_ABUSE", "HIGH"),
        ({"most_autovacuums": 10}, "AUTOVACUUM_LAGGING", "MEDIUM"), ({"auth_failures": 50}, "AUTH_FAILURES_SPIKE", "CRITICAL"), ({"most_lag_bytes": 1}, "REPLICATION_LAG", "HIGH"), ({"out_of_memory": 1}, "OOM_KILLER", "CRITICAL"),
        ({"regressing": 1}, "SLOW_QUERY_REGRESSION", "HIGH"), ({"in_window": 50}, "ERROR_STORM", "CRITICAL"), ({"ssl_fatals": 1}, "SSL_FATAL_ERRORS", "HIGH"), ({"disk_full": 3}, "DISK_FULL", "CRITICAL"), ({"longest_ms": 3.6e6}, "LONG_RUNNING_TRANSACTIONS", "CRITICAL"),
        ({"idle_ratio": 0.71}, "HIGH_SESSION_IDLE_TIME", "MEDIUM"), ({"changes": 5, "typed": 10, "lock_waits": 5}, "QUERY_TYPE_IMBALANCE", "HIGH"), ({"parse_ms": 3, "execute_ms": 10}, "PREPARE_PHASE_BOTTLENECK", "MEDIUM"),
        ({"most_wal_bytes": 104857601}, "AUTOVACUUM_WAL_AMPLIFICATION", "HIGH"), ({"host_share": 0.61}, "CONNECTION_STORM_BY_HOST", "HIGH"), ({"pool_errors": 11}, "PGBOUNCER_POOL_EXHAUSTION", "CRITICAL"), ({"cancelled": 21}, "CANCELLED_QUERY_STORM", "HIGH"),
    ],
)
def test_each_rule_alone(spark, values, rule, severity):
    assert fired(spark, **values) == {rule: severity}


def test_nothing_fires_on_nothing(spark):
    assert fired(spark) == {}


def test_saved_analysis_and_diff(spark, entries, tmp_path):
    a = analysis.Analysis(entries.filter("seq < 400"), rules.Thresholds(slow_ms=50.0), keep=False)
    b = analysis.Analysis(entries.filter("seq >= 400"), rules.Thresholds(slow_ms=50.0), keep=False)
    own = {k: v for k, v in a.sections().items() if k in ("errors", "slow_queries")}
    config.save(own, str(tmp_path / "s"), "before")
    frames, manifest = config.saved(spark, str(tmp_path / "s"))
    assert manifest["label"] == "before" and {n: f.count() for n, f in frames.items()} == {n: f.count() for n, f in own.items()}
    d = a.against(b)
    assert {r["status"] for r in d["errors"].collect()} <= {"new", "disappeared", "increased", "decreased", "unchanged"} and d["metrics"].count() == 14
    assert sum(f.count() for f in a.by_database().values()) == 400


def test_timeline_order(entries):
    rows = timeline.build(entries).collect()
    times = [r["timestamp"] for r in rows]
    assert times == sorted(times)
    severities = [r["severity"] for r in timeline.by_severity(timeline.build(entries)).collect()]
    order = ["critical", "high", "medium", "low"]
    assert severities == sorted(severities, key=order.index)


def test_configuration(tmp_path, monkeypatch):
    text = "a: 1\nb:\n  c: [x, 'y z', 3.5]\n  d:\n  - e: true\n    f: \"#not a comment\"\n  - plain # comment\nempty:\n"
    assert config.yaml(text) == {"a": 1, "b": {"c": ["x", "y z", 3.5], "d": [{"e": True, "f": "#not a comment"}, "plain"]}, "empty": None}
    monkeypatch.setenv("SECRET", "s")
    assert config.substituted({"k": ["${SECRET}-${NONE}"]}) == {"k": ["s-"]}
    (tmp_path / "x.toml").write_text("[thresholds]\nlock_warn = 2\n")
    assert config.load(str(tmp_path / "x.toml")) == {"thresholds": {"lock_warn": 2}} and config.yaml("") == {}


def test_snapshots(spark, tmp_path):
    from sawmill.sources import snapshots as S

    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    one = {"queryid": 1, "query": "select $1", "calls": 2, "total_time": 1.5}
    for name, text in (("l", json.dumps([one])), ("w", json.dumps({"rows": [one]})), ("o", json.dumps(one)), ("c", 'queryid,query,calls,total_exec_time\n1,"select $1",2,1.5\n'), ("t", " queryid | query | calls | total_exec_time\n---+---+---+---\n 1 | select $1 | 2 | 1.5\n(1 row)\n")):
        r = S.read_snapshot(spark, put(name, text), time_unit="s").collect()
        assert [(x["queryid"], x["query"], x["calls"], x["total_exec_time"], x["rows"]) for x in r] == [(1, "select $1", 2, 1500.0, None)], name
    assert json.loads(S.exported(S.read_snapshot(spark, put("l2", json.dumps([one])))))[0]["calls"] == 2
