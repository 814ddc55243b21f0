import pytest

from sawmill.sources import prefix as P


@pytest.mark.parametrize(
    "text, line, fields",
    [
        ("%m [%p] %q%u@%d ", "2031-11-30 23:59:58.017 UTC [40213] kiosk@till LOG:  opened", {"timestamp_ms": "2031-11-30 23:59:58.017 UTC", "pid": "40213", "user": "kiosk", "database": "till"}),
        ("%m [%p] %q%u@%d ", "2031-11-30 23:59:58.017 UTC [40213] LOG:  opened", {"timestamp_ms": "2031-11-30 23:59:58.017 UTC", "pid": "40213"}),
        ("%t [%p]: [%l-1] user=%u,db=%d,app=%a,client=%h ", "1999-07-04 00:30:00 CET [808]: [19-1] user=,db=,app=,client= LOG:  closed", {"timestamp": "1999-07-04 00:30:00 CET", "pid": "808", "line_num": "19"}),
        ("%t:%r:%u@%d:[%p]:", "2042-02-28 12:00:00 UTC:172.16.9.4(40022):etl@stage:[77]:LOG: vacuumed", {"timestamp": "2042-02-28 12:00:00 UTC", "remote_host_port": "172.16.9.4(40022)", "user": "etl", "database": "stage", "pid": "77"}),
        ("%n %-8u %e %c ", "86400.25 carol    22012 1a2b3c.9d LOG: divided", {"timestamp_epoch": "86400.25", "user": "carol", "sql_state": "22012", "session_id": "1a2b3c.9d"}),
        ("100%% %p %p ", "100% 1 2 LOG: x", {"pid": "1", "pid_2": "2"}),
    ],
)
def test_parse(text, line, fields):
    assert P.Prefix(text).parse(line) == fields


def test_what_a_prefix_lacks():
    assert len(P.Prefix("%u ").warnings()) == 2 and P.Prefix("%t [%p]").warnings() == []
    assert P.Prefix("%m [%p] %q%u@%d ").description() == "timestamp_ms, pid [user, database]"
    assert P.Prefix("x").parse("y") is None and P.common("nothing") is None and P.common("debian").has("line_num")


def test_detect_needs_the_level_too():
    lines = [f"2031-11-30 23:59:5{i}.500 UTC [{40 + i}] kiosk@till LOG:  opened" for i in range(4)] + ["2031-11-30 23:59:59.750 UTC [9] LOG:  idle"]
    assert P.detect(lines).text == "%m [%p] %q%u@%d "
    assert P.detect(["nothing", "like it"]) is None and P.detect([]) is None
    assert P.detect(lines[:3] + ["bad"] * 4) is None


def test_likely_fields(spark):
    d = spark.createDataFrame([("user=a,db=b LOG: x",), ("user=c LOG: host=z",)], "text string")
    got = {r["field"]: r["present"] for r in P.likely_fields(d).collect()}
    assert got["user"] and got["database"] and not got["host"]
