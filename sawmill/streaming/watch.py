"""Live alerts on Structured Streaming, with event-time windows, late data and restart by checkpoint.

The same parsing and predicates as in batch. A directory of (rotated) log files is the source; every alert is
one row of one schema, whatever the sink."""

from __future__ import annotations

import json
import urllib.request
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import patterns as P
from sawmill.operators.enrich import enrich
from sawmill.operators.filters import is_error, is_slow
from sawmill.sources.logfiles import decoded, line_format
from sawmill.sources.prefix import Prefix

ALERT = "timestamp timestamp, kind string, severity string, message string, value double"


def lines_from(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a directory as source_file, line_number (0: a stream has no numbers), text."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return rows.select(F.col("_metadata.file_path").alias("source_file"), F.lit(0).cast("long").alias("line_number"), F.col("value").alias("text"))


def entries_from(lines: DataFrame, prefix: str | None = None) -> DataFrame:
    """Entries of single lines; the format is told line by line, lines that begin none are left out."""
    from sawmill.sources.logfiles import with_prefix

    if prefix:
        ready = with_prefix(lines, Prefix(prefix))
    else:
        ready = decoded(lines.withColumn("log_format", line_format(F.col("text"))).filter("log_format is not null"))
    return enrich(ready.filter("parse_ok"))



def row_alerts(entries: DataFrame, slow_ms: float = 5000.0) -> DataFrame:
    """Slow statements, deadlocks and failed logins, each as it comes."""
    m = F.col("message")
    hit = F.array_compact(
        F.array(
            F.when(is_slow(slow_ms), F.struct(F.lit("slow_query").alias("kind"), F.lit("WARNING").alias("severity"), F.col("duration_ms").alias("value"))),
            F.when(m.rlike(P.DEADLOCK), F.struct(F.lit("deadlock").alias("kind"), F.lit("HIGH").alias("severity"), F.lit(1.0).alias("value"))),
            F.when(m.rlike(P.AUTH_FAILED), F.struct(F.lit("auth_failure").alias("kind"), F.lit("WARNING").alias("severity"), F.lit(1.0).alias("value"))),
        )
    )
    return entries.select("timestamp", F.substring("message", 1, 500).alias("message"), F.explode(hit).alias("a")).select("timestamp", "a.kind", "a.severity", "message", "a.value")


def error_rate(entries: DataFrame, errors: int = 10, window: str = "1 minute", slide: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Windows of event time with at least so many errors; complete when the watermark, which all entries move, has passed them."""
    rows = entries.withWatermark("timestamp", late).groupBy(F.window("timestamp", window, slide).alias("w")).agg(F.count_if(is_error()).alias("n"))
    return rows.filter(F.col("n") >= errors).select(F.col("w.end").alias("timestamp"), F.lit("error_rate").alias("kind"), F.lit("HIGH").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" errors since "), F.col("w.start").cast("string")).alias("message"), F.col("n").cast("double").alias("value"))


def counts(entries: DataFrame, window: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entries, errors and slow statements by window of event time, tumbling or sliding."""
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return entries.withWatermark("timestamp", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(is_error()).alias("errors"), F.avg("duration_ms").alias("avg_ms")).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "entries", "errors", "avg_ms")


def bursts(entries: DataFrame, gap: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Error bursts by database: session windows that end when nothing comes for `gap`."""
    rows = entries.filter(is_error()).withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("w"), "database").agg(F.count(F.lit(1)).alias("errors"))
    return rows.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "database", "errors")


def distinct_lines(entries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Entries that were read twice (a file copied while it rotated) once."""
    return entries.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["timestamp", "pid", "message"])


def correlate(entries: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Statement lines joined to their process's next duration line on a stream, by state kept per process.

    Rows of a micro-batch are taken in the order of their time; a statement waits for its duration until the
    watermark has passed it by `late`."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        (open_,) = state.get if state.exists else (None,)
        if state.hasTimedOut:
            state.remove()
            return
        out, last = [], None
        for b in batches:
            for r in b.sort_values(["timestamp", "seq"], kind="stable").itertuples():
                last = r.timestamp
                query = None if pd.isna(r.query) else r.query
                duration = None if pd.isna(r.duration_ms) else r.duration_ms
                if duration is None:
                    open_ = query or open_
                else:
                    out.append((key[0], r.timestamp, duration, query or open_))
                    open_ = open_ if query else None
        state.update((open_,))
        if last is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + 600_000)
        yield pd.DataFrame(out, columns=["pid", "timestamp", "duration_ms", "query"])

    rows = entries.filter("pid is not null and (query is not null or duration_ms is not null)").select("pid", "timestamp", "seq", "query", "duration_ms")
    return rows.withWatermark("timestamp", late).groupBy("pid").applyInPandasWithState(step, "pid int, timestamp timestamp, duration_ms double, query string", "query string", "append", GroupStateTimeout.EventTimeTimeout)


def start(alerts: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str = "console", once: bool = False, every: str = "5 seconds", mode: str = "append"):
    """Runs alerts into a sink: a function of (frame, batch number), as for a webhook, or the name of a format.

    once: all that is there now, then end; the checkpoint makes the next run go on from there."""
    w = alerts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.foreachBatch(sink) if callable(sink) else w.format(sink)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def json_lines(entries: DataFrame, path: str, checkpoint: str | None = None):
    """Entries as one JSON object a line, nulls left out; a stream needs a checkpoint."""
    out = entries.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in entries.columns])).alias("value"))
    if entries.isStreaming:
        return out.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return out.write.mode("overwrite").text(path)


class Recent:
    """A sink that keeps the last alerts on the driver."""

    def __init__(self, most: int = 100):
        self.alerts: deque = deque(maxlen=most)

    def __call__(self, alerts: DataFrame, batch: int) -> None:
        rows = alerts.orderBy(F.desc("timestamp")).limit(self.alerts.maxlen).collect()
        self.alerts.extend(reversed(rows))


def webhook(url: str, most: int = 100, timeout: float = 5.0, post: Callable[[str, bytes], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that posts each batch's alerts (the latest `most`) as JSON; post(url, body) may stand in for the request."""

    def send(address: str, body: bytes) -> None:
        request = urllib.request.Request(address, body, {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()

    def sink(alerts: DataFrame, batch: int) -> None:
        rows = alerts.orderBy(F.desc("timestamp")).limit(most).select(F.to_json(F.struct(*alerts.columns))).collect()
        if rows:
            (post or send)(url, json.dumps({"batch": batch, "alerts": [json.loads(r[0]) for r in rows]}).encode())

    return sink
