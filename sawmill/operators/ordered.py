"""Operators that depend on the order of entries (seq): correlation, sessions, concurrency, trends, islands.

Per-session logic is a window over the session's process id. Logic over all entries (concurrency) is a
two-level prefix sum: entries are cut into buckets of seq, each bucket's sum gives the next one's start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sawmill.functions import patterns as P
from sawmill.functions import text as X
from sawmill.operators import extract
from sawmill.operators.filters import is_error


def by_pid():
    """The entries of a process in order. Two servers' logs may hold the same process id, so the file counts too."""
    return Window.partitionBy("source_file", "pid").orderBy("seq")


def correlate_statements(entries: DataFrame) -> DataFrame:
    """Gives a duration-only entry the statement its process logged just before; a statement is used once.

    Among a process's statement-only and duration-only entries, a duration takes the statement that comes
    directly before it, unless a new session began between them. Only the narrow columns are windowed by process, so a process
    with much of the log is no long task for the rest of it."""
    only_statement = F.col("query").isNotNull() & F.col("duration_ms").isNull()
    only_duration = F.col("query").isNull() & F.col("duration_ms").isNotNull()
    begins = extract.is_a(entries, "connected")
    mine = entries.filter(F.col("pid").isNotNull() & (only_statement | only_duration | begins)).select("seq", "source_file", "pid", "query", only_statement.alias("opens"), only_duration.alias("takes"))
    given = mine.withColumns({"was": F.lag("opens").over(by_pid()), "text": F.lag("query").over(by_pid())}).filter(F.col("takes") & F.col("was")).select(F.col("seq").alias("at"), "text")
    out = entries.join(given, F.col("seq") == F.col("at"), "left").withColumn("query", F.coalesce("query", "text")).drop("at", "text")
    return out.withColumn("query_type", X.query_type(F.coalesce("query", "message")))


def sessions(entries: DataFrame) -> DataFrame:
    """Ended sessions: the disconnection with the process's last connection, if that was not ended before.

    duration_ms is the time the message tells, else the time since the connection."""
    kind = F.when(extract.is_a(entries, "disconnected"), "end").when(extract.is_a(entries, "connected"), "start")
    own = ("timestamp", "database", "user", "remote_host", "application_name")
    rows = entries.filter(F.col("pid").isNotNull()).withColumn("kind", kind).filter("kind is not null").select("seq", "source_file", "pid", "kind", "message", *own)
    before = rows.withColumn("opened", F.lag(F.struct("kind", *own)).over(by_pid())).filter("kind = 'end'")
    start = F.when(F.col("opened.kind") == "start", F.col("opened"))
    pick = lambda c: F.coalesce(start[c], F.col(c))
    told = X.session_ms(F.col("message"))
    since = F.when(start["timestamp"].isNotNull(), (F.unix_micros("timestamp") - F.unix_micros(start["timestamp"])) / 1000.0)
    ms = F.coalesce(told, since)
    return before.select(
        "seq", "source_file", "pid", start["timestamp"].alias("started"), F.col("timestamp").alias("ended"), F.when(ms > 0, ms).alias("duration_ms"),
        pick("database").alias("database"), pick("user").alias("user"), pick("remote_host").alias("remote_host"), pick("application_name").alias("application_name"),
    ).withColumn("bucket", X.session_bucket(F.col("duration_ms")))


def session_summary(entries: DataFrame) -> DataFrame:
    """avg_ms divides by all sessions, those of unknown length included."""
    return sessions(entries).agg(F.count(F.lit(1)).alias("sessions"), F.sum("duration_ms").alias("total_ms")).withColumn("avg_ms", X.ratio(F.col("total_ms"), F.col("sessions")))


def idle_ratio(entries: DataFrame) -> DataFrame:
    """total session time, statement time of the processes that had sessions, and the idle share."""
    own = sessions(entries).groupBy("source_file", "pid").agg(F.sum("duration_ms").alias("session_ms"))
    busy = entries.filter("duration_ms is not null").groupBy(F.col("source_file").alias("file"), F.col("pid").alias("process")).agg(F.sum("duration_ms").alias("busy_ms"))
    sums = own.join(busy, F.col("source_file").eqNullSafe(F.col("file")) & (F.col("pid") == F.col("process")), "left").agg(F.sum("session_ms").alias("session_ms"), F.sum("busy_ms").alias("busy_ms"))
    return sums.withColumn("idle_ratio", X.ratio(F.greatest(F.lit(0.0), F.col("session_ms") - F.coalesce("busy_ms", F.lit(0.0))), F.col("session_ms")))


def concurrency(entries: DataFrame, bucket: int = 100_000) -> DataFrame:
    """seq, timestamp, open: sessions open after each connection. A second connection of an open process does not count."""
    kind = F.when(extract.is_a(entries, "disconnected"), -1).when(extract.is_a(entries, "connected"), 1)
    rows = entries.filter(F.col("pid").isNotNull()).select("seq", "source_file", "pid", "timestamp", kind.alias("kind")).filter("kind is not null")
    was = F.coalesce(F.lag("kind").over(by_pid()), F.lit(-1))
    steps = rows.withColumn("step", F.when(was != F.col("kind"), F.col("kind")).otherwise(0)).withColumn("bucket", F.floor(F.col("seq") / bucket))
    sums = steps.groupBy("bucket").agg(F.sum("step").alias("n"))
    first = sums.select(F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("own", F.sum("step").over(own)).join(first, F.col("bucket") == F.col("b"))
    return out.filter("kind = 1").select("seq", "timestamp", (F.col("first") + F.col("own")).alias("open"))


def peak_concurrent(entries: DataFrame) -> DataFrame:
    return concurrency(entries).agg(F.coalesce(F.max("open"), F.lit(0)).alias("peak"))


def peak_by_hour(entries: DataFrame) -> DataFrame:
    return concurrency(entries).groupBy(X.hour(F.col("timestamp")).alias("hour")).agg(F.max("open").alias("peak"))


def regressions(rows: DataFrame, key: str = "fingerprint", least: int = 5, share: float = 0.01) -> DataFrame:
    """Slope of duration over arrival (least squares); a group regresses if it grows by more than share of its mean a call."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1
    out = rows.select(key, "duration_ms", nth.alias("nth")).groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.avg("duration_ms").alias("avg_ms"), F.regr_slope("duration_ms", "nth").alias("slope"))
    return out.withColumn("regressing", (F.col("count") >= least) & F.coalesce(F.col("slope") > share * F.col("avg_ms"), F.lit(False)))


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def islands(rows: DataFrame, gap: str, least: int, at: str = "timestamp", bucket_s: int = 3600) -> DataFrame:
    """Runs of events at most `gap` ("5 minutes") apart, of at least `least` events.

    Events are cut into buckets of time no shorter than the gap, so the event before one stands in its bucket or the last one;
    runs are found within buckets and joined over their edges. Only one row for each bucket is ever ordered as a whole."""
    n, unit = gap.split()
    wide = int(float(n) * SECONDS[unit.rstrip("s")] * 1_000_000)
    bucket = F.floor(F.col("m") / max(wide, bucket_s * 1_000_000))
    events = rows.filter(F.col(at).isNotNull()).select(F.unix_micros(at).alias("m")).withColumn("bucket", bucket)
    ends = events.groupBy((F.col("bucket") + 1).alias("next")).agg(F.max("m").alias("ended"))
    own = Window.partitionBy("bucket").orderBy("m")
    before = F.coalesce(F.lag("m").over(own), F.col("ended"))
    begins = F.coalesce(F.col("m") - before > wide, F.lit(True)).cast("long")
    flagged = events.join(ends, F.col("bucket") == F.col("next"), "left").withColumn("begins", begins)
    # Run 0 of a bucket goes on from a bucket before.
    parts = flagged.withColumn("run", F.sum("begins").over(own.rangeBetween(Window.unboundedPreceding, 0))).groupBy("bucket", "run").agg(F.count(F.lit(1)).alias("members"), F.min("m").alias("from"), F.max("m").alias("to"))
    heads = parts.groupBy(F.col("bucket").alias("b")).agg(F.max("run").alias("last"))
    head = F.last(F.when(F.col("last") > 0, F.struct(F.col("b").alias("bucket"), F.col("last").alias("run"))), ignorenulls=True)
    heads = heads.select("b", head.over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("of"))
    joined = parts.join(heads, F.col("bucket") == F.col("b")).withColumn("of", F.when(F.col("run") > 0, F.struct("bucket", "run")).otherwise(F.col("of")))
    out = joined.groupBy("of").agg(F.sum("members").alias("members"), F.timestamp_micros(F.min("from")).alias("from"), F.timestamp_micros(F.max("to")).alias("to"))
    return out.filter(F.col("members") >= least).drop("of")


def error_storm_by_hour(entries: DataFrame, minutes: int = 5, threshold: int = 50) -> DataFrame:
    """The errors of the busiest hour of the day, scaled to a window of minutes, against a threshold."""
    hours = entries.filter(is_error()).groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.agg(F.coalesce(F.max("n"), F.lit(0)).alias("busiest")).withColumn("in_window", F.floor(F.col("busiest") * minutes / 60).cast("long")).withColumn("storm", F.col("in_window") >= threshold)


def error_storms(entries: DataFrame, window: str = "5 minutes", slide: str = "1 minute", threshold: int = 50) -> DataFrame:
    """Sliding windows with at least `threshold` errors."""
    out = entries.filter(is_error()).groupBy(F.window("timestamp", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("errors"))
    return out.filter(F.col("errors") >= threshold).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "errors")


def plan_blocks(entries: DataFrame) -> DataFrame:
    """Plans that auto-explain logged: the entry with the statement, its own lines below it, and the plan entries of the
    same process that follow until another kind of entry."""
    m = F.col("message")
    opens = extract.is_a(entries, "plan")
    t = F.trim(m)
    line = ~opens & (t != "") & (t.rlike(P.PLAN_LINE) | t.rlike(r"^(?:->|Plan|\{|<)"))
    rows = entries.select("seq", "source_file", "pid", "timestamp", "database", "user", "duration_ms", "message", opens.alias("opens"), line.alias("line"))
    block = rows.withColumn("block", F.sum(F.when(F.col("opens") | ~F.col("line"), 1).otherwise(0)).over(by_pid())).filter(F.col("opens") | F.col("line"))
    below = F.regexp_extract("message", r"(?is)Query Text:[^\n]*\n(.*)$", 1)
    text = F.when(F.col("opens"), F.trim(below)).otherwise(F.trim("message"))
    head = lambda c: F.min_by(F.when(F.col("opens"), F.col(c)), F.when(F.col("opens"), F.col("seq")))
    out = block.groupBy("source_file", "pid", "block").agg(
        F.max("opens").alias("opened"), F.min("seq").alias("seq"), head("timestamp").alias("timestamp"), head("database").alias("database"), head("user").alias("user"), head("duration_ms").alias("duration_ms"),
        head("message").alias("message"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("text")))), lambda x: F.nullif(x["text"], F.lit(""))), "\n").alias("plan"),
    )
    out = out.filter(F.col("opened") & (F.col("plan") != ""))
    return out.withColumn("query", F.trim(X.found(F.col("message"), P.PLAN_START))).withColumn("fingerprint", X.fingerprint(F.col("query"))).drop("opened", "block", "message", "source_file")


def with_plans(queries: DataFrame, plans: DataFrame) -> DataFrame:
    """Statement statistics with the number of logged plans and the slowest one, null where none was logged."""
    own = plans.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("plans"), F.max_by("plan", F.coalesce("duration_ms", F.lit(0.0))).alias("slowest_plan"))
    return queries.join(own, "fingerprint", "left")
