import pytest
from pyspark.sql import functions as F

from sawmill.functions import text as X


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_fingerprint(spark):
    got = column(spark, ["select * from t where a = 'x''y' and b in (1, 2,3);", "SELECT *  FROM t WHERE a = 'zz' AND b IN (7);", "select a from t group by b order by 1.5", "insert into t values ($1, $2)", None], X.fingerprint)
    assert got == ["SELECT * FROM t WHERE a = ?? AND b IN (?)", "SELECT * FROM t WHERE a = ? AND b IN (?)", "SELECT a FROM t GROUP BY b ORDER BY ?", "INSERT INTO t VALUES (?)", None]


def test_numbered_fingerprint(spark):
    got = column(spark, ["select 1, 'a'", "select a from t where b in (1, 2)", "select 'x'"], X.fingerprint_numbered)
    # strings come first, and the digits of placed parameters are numbers again
    assert got == ["SELECT $2, $$3", "SELECT a FROM t WHERE b IN ($3)", "SELECT $$2"]


def test_anonymize(spark):
    assert column(spark, ["id = 5 and n = 'Bob' or x1 = $3", "1.5 a2"], X.anonymize) == ["id = 0 and n = '?' or x1 = $3", "0 a2"]


def test_pattern_key(spark):
    got = column(spark, ['duplicate key value violates unique constraint "a_b" DETAIL: Key (x)=(1) already exists.', "a  1\t'q'", "Key (a)=(b) 12"], X.pattern_key)
    assert got == ['duplicate key value violates unique constraint "X"', "a N ?", "Key (col)=(val) N"]


@pytest.mark.parametrize(
    "message, name",
    [("connection reset", "connection"), ("deadlock detected", "lock"), ("duplicate key", "constraint"), ("could not extend file", "disk"), ("standby gone", "replication"), ("syntax error", "query"), ("out of memory", "memory"), ("could not serialize", "serialization"), ("bloat", "autovacuum"), ("boo", "unknown")],
)
def test_category(spark, message, name):
    assert column(spark, [message], X.category) == [name]


def test_types_phases_levels(spark):
    types = column(spark, ["WITH x AS (SELECT 1)\nSELECT 2", " insert into t", "update t set", "delete from t", "copy t", "truncate t", "vacuum", "begin", None], X.query_type)
    assert types == ["select", "insert", "update", "delete", "copy", "ddl", "vacuum", "other", None]
    phases = column(spark, ["duration: 1 ms  parse s1: x", "duration: 1 ms  bind s1: x", "duration: 1 ms  statement: x", "bind a: b", "hello"], X.phase)
    assert phases == ["parse", "bind", "execute", "bind", None]
    assert column(spark, ["debug3", "Error", "odd", None], X.level) == ["DEBUG", "ERROR", "LOG", "LOG"]


def test_sessions(spark):
    assert column(spark, ["session time: 1:02:03.500 user=x", "none"], X.session_ms) == [3723500.0, None]
    rows = spark.createDataFrame([(x,) for x in (0.0, 499.0, 500.0, 59_999.0, 28_800_000.0, None)], "ms double").select(X.session_bucket(F.col("ms")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["<500ms", "<500ms", "<1s", "<1m", ">=8h", None]
