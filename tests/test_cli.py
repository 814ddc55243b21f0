import json

import pytest

from sawmill import cli

LOG = "".join(f"2024-01-15 08:00:{i:02d}.000 UTC [{i % 3}] app@shop {'FATAL:  out of memory' if i == 7 else f'LOG:  duration: {i * 200} ms  statement: SELECT * FROM t WHERE id = {i}'}\n" for i in range(30))


@pytest.fixture
def log(tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    return str(tmp_path / "a.log")


def test_summary_and_dump(spark, log, capsys, tmp_path):
    assert cli.main(["summary", log]) == 2
    assert "health: critical" in capsys.readouterr().out
    cli.main(["dump", log, "--output", "json", "--out", str(tmp_path / "d.json")])
    rows = json.loads((tmp_path / "d.json").read_text())["slow_queries"]
    assert rows[0]["fingerprint"] == "SELECT * FROM t WHERE id = ?" and rows[0]["count"] == 29
    cli.main(["dump", log, "--output", "json", "--min-count", "99", "--out", str(tmp_path / "e.json")])
    assert json.loads((tmp_path / "e.json").read_text())["slow_queries"] == []


def test_other_commands(spark, log, capsys, tmp_path):
    for argv in (["version"], ["rules", "list"], ["rules", "init"], ["config", "show"], ["prefixes"]):
        assert cli.main(argv) == 0
    assert "OOM_KILLER" in capsys.readouterr().out
    assert cli.main(["timeline", log, "--output", "markdown"]) == 0 and "oom" in capsys.readouterr().out
    assert cli.main(["diff", log, log, "--output", "json", "--out", str(tmp_path / "x.json")]) == 0
    assert {r["status"] for r in json.loads((tmp_path / "x.json").read_text())["queries"]} == {"unchanged"}
    assert cli.main(["index-advisor", log]) == 0 and "CREATE INDEX ON t (id)" in capsys.readouterr().out
    assert cli.main(["analyze", log, "--anonymize", "--output", "jsonl", "--out", str(tmp_path / "j")]) == 0
    with pytest.raises(SystemExit):
        cli.main(["diff", log])


def test_a_custom_prefix_is_found(spark, tmp_path, capsys):
    """Lines that the built-in header does not fit are read by the common prefix that fits them."""
    from sawmill.sources import logfiles, prefix

    text = prefix.COMMON["debian"] if "%l" in prefix.COMMON["debian"] else next(t for t in prefix.COMMON.values() if "%l" in t)
    assert text
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("".join(f"2031-11-30 23:59:{i:02d} UTC:10.1.2.{i % 4}(900):kiosk@till:[{i}]:{'ERROR' if i % 5 == 0 else 'LOG'}:  opened {i}\n" for i in range(30)))
    (folder / "b.log").write_text("".join(f"user=kiosk,db=till,app=pos,client=10.0.0.7 2031-11-30 23:58:{i:02d} UTC [{i}] LOG:  closed {i}\n" for i in range(20)))
    (folder / "notes.md").write_text("not a log")
    own = logfiles.read_logs(spark, [str(folder / "a.log")])
    assert own.filter("database = 'till' and user = 'kiosk'").count() == 30
    assert cli.main(["analyze", str(folder / "a.log"), "--output", "json", "--out", str(tmp_path / "r.json")]) == 0
    assert "MANAGED_PLATFORM_DETECTED" in {r["rule_id"] for r in json.loads((tmp_path / "r.json").read_text())["findings"]}
    assert len(logfiles.expanded(spark, [str(folder)])) == 2


def test_state_databases_and_standard_input(spark, log, tmp_path, monkeypatch, capsys):
    import io

    state = tmp_path / "state.json"
    argv = ["analyze", log, "--output", "json", "--state", str(state), "--out"]
    assert cli.main([*argv, str(tmp_path / "one.json")]) == 0 and cli.main([*argv, str(tmp_path / "two.json")]) == 0
    entries = [json.loads((tmp_path / f).read_text())["throughput"][0]["entries"] for f in ("one.json", "two.json")]
    assert entries == [30, 0]
    assert cli.main(["analyze", log, "--by-database", "--output", "json", "--out", str(tmp_path / "d.json")]) == 0
    assert json.loads((tmp_path / "d-shop.json").read_text())["throughput"][0]["entries"] == 30
    monkeypatch.setattr("sys.stdin", io.StringIO(LOG))
    assert cli.main(["summary", "-"]) == 2


def test_watch_tails_a_file(spark, log, tmp_path, capsys):
    assert cli.main(["watch", log, "--checkpoint", str(tmp_path / "c"), "--once", "--from-start", "--slow-ms", "4000"]) == 0
    out = capsys.readouterr().out
    assert "slow_query" in out and out.count("slow_query") == 10
