import bz2
import datetime as dt
import gzip
import lzma
import zipfile

import pytest

from sawmill.sources import logfiles as L

STDERR = """2024-01-15 08:00:01.234 UTC [12] app@shop LOG:  connection authorized: user=app database=shop host=10.1.1.1
2024-01-15 08:00:02 UTC [12] app@shop LOG:  duration: 1500.5 ms  statement: SELECT *
\tFROM t
2024-01-15 08:00:03 UTC [12] app@shop ERROR:  duplicate key value (SQLSTATE: 23505)
DETAIL:  Key (id)=(5) already exists.
2024-01-15 08:00:04 UTC [99] LOG:  checkpoint starting: time
2024-01-15 08:00:05 UTC [12] app@FATAL:  broken header
"""


@pytest.fixture
def files(tmp_path):
    def put(name, text, opener=None):
        path = tmp_path / name
        if opener:
            with opener(path, "wt", encoding="utf-8") as f:
                f.write(text)
        else:
            path.write_text(text, encoding="utf-8")
        return str(path)

    return put


def rows(df):
    return df.orderBy("seq").collect()


def test_stderr(spark, files):
    got = rows(L.read_logs(spark, [files("a.log", STDERR)]))
    assert [r["line_number"] for r in got] == [1, 2, 4, 6]
    assert got[0]["timestamp"] == dt.datetime(2024, 1, 15, 8, 0, 1, 234000) and got[0]["remote_host"] == "10.1.1.1"
    assert (got[1]["duration_ms"], got[1]["query"], got[1]["query_type"], got[1]["phase"]) == (1500.5, "SELECT *\n\tFROM t", "select", "execute")
    assert (got[2]["log_level"], got[2]["error_code"]) == ("ERROR", "23505") and "Key (id)=(5)" in got[2]["message"]
    assert (got[3]["pid"], got[3]["user"]) == (99, None)
    health = L.parse_health(L.read_logs(spark, [files("b.log", STDERR)], keep_failed=True)).first()
    assert (health["entries"], health["failed"], health["suspicious"]) == (5, 1, True)


def test_strict_continuation(spark, files):
    text = "2024-01-15 08:00:01 UTC [1] LOG:  a\nwrapped line\n2024-01-15 08:00:02 UTC [1] LOG:  b\n"
    assert [r["message"] for r in rows(L.read_logs(spark, [files("a.log", text)]))] == ["a\nwrapped line", "b"]
    assert [r["message"] for r in rows(L.read_logs(spark, [files("b.log", text)], lenient=False))] == ["a", "b"]


@pytest.mark.parametrize("name, opener", [("x.log.gz", gzip.open), ("x.log.bz2", bz2.open), ("x.log.xz", lzma.open)])
def test_packed(spark, files, name, opener):
    got = rows(L.read_logs(spark, [files(name, STDERR, opener)]))
    assert [r["pid"] for r in got] == [12, 12, 12, 99] and got[1]["query"] == "SELECT *\n\tFROM t"


def test_zip_and_zstd(spark, tmp_path):
    import zstandard

    with zipfile.ZipFile(tmp_path / "x.log.zip", "w") as z:
        z.writestr("x.log", STDERR)
    (tmp_path / "y.log.zst").write_bytes(zstandard.ZstdCompressor().compress(STDERR.encode()))
    assert L.read_logs(spark, [str(tmp_path / "x.log.zip"), str(tmp_path / "y.log.zst")]).count() == 8


def test_syslog(spark, files):
    text = (
        "Apr 10 18:11:23 host postgres[12]: [5-1] user=bob,db=shop,app=psql,client=10.0.0.1 LOG:  duration: 5 ms  statement: SELECT#0111#359\n"
        "Apr  9 18:11:24 host postgres[12]: [6] 2024-04-10 18:11:24 UTC [45]: [3-1] user=amy,db=crm,sessid=6617.1f ERROR:  bad\n"
    )
    got = rows(L.read_logs(spark, [files("s.log", text)], base_year=2023))
    assert got[0]["timestamp"] == dt.datetime(2023, 4, 10, 18, 11, 23) and got[0]["query"] == "SELECT\t1#359" and got[0]["application_name"] == "psql"
    assert (got[1]["pid"], got[1]["session_id"], got[1]["timestamp"]) == (45, "6617.1f", dt.datetime(2024, 4, 10, 18, 11, 24))
    two = rows(L.read_logs(spark, [files("s2.log", "<134>" + text.split("\n")[0] + "\n")], base_year=2023))
    assert two[0]["user"] == "bob"


def test_other_formats(spark, files):
    csv = '2024-01-15 08:00:01.234 UTC,"app","shop",77,"1.2.3.4:55",s1,1,"SELECT",2024-01-15 08:00:00 UTC,1/2,0,ERROR,42P01,"relation ""t"" does\nnot exist",,,,,,"select * from t",15,,"psql"\nshort,row\n'
    json = '{"timestamp":"2024-01-15 08:00:01 UTC","error_severity":"ERROR","pid":5,"message":"boom","user":"u","dbname":"d"}\nnot json\n'
    cloud = '{"textPayload":"2024-01-15 08:00:01 UTC [55] u@d LOG:  duration: 9 ms","timestamp":"2024-01-15T08:00:01Z"}\n{"jsonPayload":{"message":"plain"},"timestamp":"2024-01-15T08:00:02Z","resource":{"labels":{"database_id":"p:inst"}}}\n'
    rds = "2024-01-15 14:23:01 UTC:192.168.1.1(54321):u@d:[1234]:LOG: duration: 12 ms\n"
    pooler = "2024-01-15 14:23:01.234 UTC [1] LOG client login attempt: db=shop user=app tls=no\n"
    plex = "2024-01-15T14:23:01+00:00 app[postgres.1]: [1-1] user=u,db=d,app=a,client=9.9.9.9 LOG: hi\n"
    paths = [files(n, t) for n, t in (("c.csv", csv), ("j.json", json), ("g.json", cloud), ("r.log", rds), ("p.log", pooler), ("h.log", plex))]
    got = rows(L.read_logs(spark, paths))
    assert [(r["pid"], r["user"], r["database"], r["log_level"]) for r in got] == [(77, "app", "shop", "ERROR"), (5, "u", "d", "ERROR"), (55, "u", "d", "LOG"), (None, None, "inst", "LOG"), (1234, "u", "d", "LOG"), (1, "app", "shop", "LOG"), (None, "u", "d", "LOG")]
    assert got[0]["message"] == 'relation "t" does\nnot exist' and got[0]["error_code"] == "42P01" and got[3]["message"] == "plain"
    assert got[4]["remote_host"] == "192.168.1.1:54321" and got[6]["remote_host"] == "9.9.9.9"
    assert len({r["seq"] for r in got}) == len(got)
    red = rows(L.read_logs(spark, [files("d.log", "2024-01-15 14:23:01.234 [12] LOG: hi\n")], log_format="redshift"))
    assert red[0]["pid"] == 12


def test_a_prefix(spark, files):
    got = rows(L.read_logs(spark, [files("a.log", STDERR)], prefix="%m [%p] %q%u@%d "))
    assert [(r["pid"], r["user"]) for r in got][:1] == [(12, "app")]
    got = rows(L.read_logs(spark, [files("b.log", "1700000000.5 [7] ERROR:  x\n")], prefix="%n [%p] "))
    assert got[0]["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20, 500000) and got[0]["pid"] == 7


def test_splits_of_one_file(spark, files):
    """A file read in many splits has the entries and numbers of one read whole."""
    text = "".join(f"2024-01-15 08:00:{i % 60:02d} UTC [{i}] LOG:  statement: SELECT {i}\n" + "\tmore\n" * (i % 4) for i in range(3000))
    path = files("big.log", text)
    whole = [(r["line_number"], r["pid"], r["message"]) for r in rows(L.read_logs(spark, [path]))]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert L.raw_lines(spark, [path]).select("block").distinct().count() > 10
        assert [(r["line_number"], r["pid"], r["message"]) for r in rows(L.read_logs(spark, [path]))] == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(whole) == 3000 and whole[7][2].count("more") == 3


def test_discover_and_empty(spark, files, tmp_path):
    files("a.log", STDERR)
    files("a.log.1", STDERR)
    files("notes.md", "x")
    (tmp_path / "sub").mkdir()
    files("sub/b.csv", "x")
    assert {r["path"].rsplit("/", 1)[-1] for r in L.discover(spark, [str(tmp_path)], recursive=True).collect()} == {"a.log", "a.log.1", "b.csv"}
    assert L.read_logs(spark, [files("e.log", "")]).count() == 0
    with pytest.raises(ValueError):
        L.raw_lines(spark, [])
    lines = L.from_lines(spark, STDERR.split("\n"))
    assert L.assembled(L.numbered_lines(lines)).count() == 5


def test_remote(spark, tmp_path, files):
    import functools
    import http.server
    import threading

    from sawmill.sources import remote

    files("a.log", STDERR)
    files("b.log.gz", STDERR, gzip.open)
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        urls = [f"http://127.0.0.1:{server.server_port}/{n}" for n in ("a.log", "b.log.gz")]
        lines = remote.http_lines(spark, urls)
        assert L.assembled(L.numbered_lines(lines)).count() == 10
    finally:
        server.shutdown()
    own = remote.command_lines(spark, {"x": ["cat", str(tmp_path / "a.log")]})
    assert [r["text"] for r in own.orderBy("id").collect()] == STDERR.split("\n")[:-1]
    assert remote.ssh_command("h", "/l/a b.gz", "u")[-2:] == ["u@h", "zcat '/l/a b.gz'"]
