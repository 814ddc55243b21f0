import datetime as dt

from sawmill.sources import logfiles
from sawmill.streaming import watch

LINES = [f"2024-01-15 08:{i // 60:02d}:{i % 60:02d}.000 UTC [{i % 3}] app@shop {'ERROR:  deadlock detected' if i % 10 == 0 else f'LOG:  duration: {i * 100} ms'}" for i in range(120)]


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def drain(spark, rows, name, checkpoint, mode="append"):
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_row_alerts_equal_batch_and_go_on_from_the_checkpoint(spark, tmp_path):
    put(tmp_path / "logs", "a.log", LINES[:60])
    seen = []
    run = lambda: watch.start(watch.row_alerts(watch.entries_from(watch.lines_from(spark, str(tmp_path / "logs"))), 5000.0), str(tmp_path / "cp"), lambda df, i: seen.extend(df.collect()), once=True).awaitTermination()
    run()
    first = len(seen)
    put(tmp_path / "logs", "b.log", LINES[60:])
    run()
    batch = watch.row_alerts(logfiles.read_logs(spark, [str(tmp_path / "logs" / n) for n in ("a.log", "b.log")]), 5000.0).collect()
    key = lambda r: (r["timestamp"], r["kind"], r["value"])
    assert 0 < first < len(seen) and sorted(map(key, seen)) == sorted(map(key, batch))


def test_windows(spark, tmp_path):
    put(tmp_path / "logs", "a.log", [*LINES, "2024-01-15 09:59:00.000 UTC [1] app@shop ERROR:  later"])
    entries = lambda: watch.entries_from(watch.lines_from(spark, str(tmp_path / "logs")))
    rate = drain(spark, watch.error_rate(entries(), 6, "1 minute", "1 minute", "1 minute"), "rate", tmp_path / "c1")
    assert [r["value"] for r in sorted(rate)] == [6.0, 6.0]
    c = drain(spark, watch.counts(entries(), late="1 minute"), "counts", tmp_path / "c2")
    assert sum(r["entries"] for r in c) == 120 and sum(r["errors"] for r in c) == 12
    b = drain(spark, watch.bursts(entries(), "30 seconds", "1 minute"), "bursts", tmp_path / "c3")
    assert [(r["database"], r["errors"]) for r in b] == [("shop", 12)]


def test_distinct_and_correlated(spark, tmp_path):
    lines = ["2024-01-15 08:00:01.000 UTC [1] a@b LOG:  statement: SELECT 1", "2024-01-15 08:00:02.000 UTC [2] a@b LOG:  duration: 7 ms", "2024-01-15 08:00:03.000 UTC [1] a@b LOG:  duration: 5 ms", "2024-01-15 08:00:04.000 UTC [1] a@b LOG:  duration: 6 ms"]
    put(tmp_path / "logs", "a.log", lines * 2)
    entries = lambda: watch.entries_from(watch.lines_from(spark, str(tmp_path / "logs")))
    assert len(drain(spark, watch.distinct_lines(entries()), "once", tmp_path / "c1")) == 4
    put(tmp_path / "logs2", "a.log", lines)
    rows = watch.entries_from(watch.lines_from(spark, str(tmp_path / "logs2")))
    got = {(r["pid"], r["duration_ms"], r["query"]) for r in drain(spark, watch.correlate(rows), "joined", tmp_path / "c2")}
    assert got == {(1, 5.0, "SELECT 1"), (1, 6.0, None), (2, 7.0, None)}


def test_json_lines(spark, tmp_path):
    put(tmp_path / "logs", "a.log", LINES[:5])
    e = logfiles.read_logs(spark, [str(tmp_path / "logs" / "a.log")])
    watch.json_lines(e, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 5 and "error_code" not in back.columns
    assert isinstance(e.first()["timestamp"], dt.datetime)


def test_tail_of_a_growing_and_rotated_file(spark, tmp_path):
    from sawmill.streaming.tail import tail

    path = tmp_path / "live.log"
    path.write_text("\n".join(LINES[:3]) + "\n" + "half a li")
    seen = []
    run = lambda: tail(spark, str(path), from_end=False).writeStream.foreachBatch(lambda df, i: seen.extend(r["text"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp"))
    q = run().trigger(processingTime="1 second").start()
    try:
        q.processAllAvailable()
        assert seen == LINES[:3]
        with path.open("a") as f:
            f.write("ne\n" + LINES[3] + "\n")
        q.processAllAvailable()
        assert seen == [*LINES[:3], "half a line", LINES[3]]
        path.write_text(LINES[4] + "\n")
        q.processAllAvailable()
        assert seen[-1] == LINES[4] and len(seen) == 6
    finally:
        q.stop()


def test_sinks(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, i), "deadlock", "HIGH", "m", 1.0) for i in range(5)], watch.ALERT)
    r, sent = watch.Recent(3), []
    r(d, 0)
    assert [x["timestamp"].second for x in r.alerts] == [2, 3, 4]
    watch.webhook("http://x", post=lambda url, body: sent.append((url, body)))(d, 7)
    watch.webhook("http://x", post=lambda url, body: sent.append((url, body)))(d.limit(0), 8)
    assert len(sent) == 1 and b'"batch": 7' in sent[0][1]
