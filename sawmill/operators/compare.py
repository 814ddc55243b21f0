"""Before and after: full outer joins of two sides' statistics, untruncated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions import text as X
from sawmill.operators import aggregate, extract
from sawmill.operators.filters import is_error, is_fatal, is_slow


def change(before: Column, after: Column, share: float, up: str, down: str) -> Column:
    """new, disappeared, up, down or unchanged. A side that is 0 or null beforehand counts as a change of 0 %."""
    relative = F.when(before.isNull() | (before == 0), 1.0).otherwise(after / before)
    return F.when(relative > 1 + share, up).when(relative < 1 - share, down).otherwise("unchanged")


def diff_queries(before: DataFrame, after: DataFrame, share: float = 0.10) -> DataFrame:
    """before, after: slow_queries() of either side. Status by the 95th percentile."""
    own = ("count", "avg_ms", "p95_ms", "total_ms")
    a = before.select("fingerprint", *[F.col(c).alias(f"{c}_before") for c in own])
    b = after.select("fingerprint", *[F.col(c).alias(f"{c}_after") for c in own])
    status = F.when(F.col("count_before").isNull(), "new").when(F.col("count_after").isNull(), "disappeared").otherwise(change(F.col("p95_ms_before"), F.col("p95_ms_after"), share, "slower", "faster"))
    return a.join(b, "fingerprint", "full_outer").withColumn("status", status).withColumn("p95_change", X.ratio(F.col("p95_ms_after") - F.col("p95_ms_before"), F.col("p95_ms_before"), percent=True))


def diff_errors(before: DataFrame, after: DataFrame, share: float = 0.20) -> DataFrame:
    """before, after: error_patterns() of either side. Status by count."""
    a = before.select("pattern", F.col("count").alias("count_before"))
    b = after.select("pattern", F.col("count").alias("count_after"))
    status = F.when(F.col("count_before").isNull(), "new").when(F.col("count_after").isNull(), "disappeared").otherwise(change(F.col("count_before"), F.col("count_after"), share, "increased", "decreased"))
    return a.join(b, "pattern", "full_outer").withColumn("status", status)


def metrics(entries: DataFrame, threshold_ms: float = 1000.0) -> DataFrame:
    """metric, value: the scalars that two runs are compared by."""
    locks, done, vacuums, files = extract.lock_events(entries), extract.checkpoint_events(entries), extract.autovacuum_runs(entries), extract.temporary_files(entries)
    one = lambda d, **what: d.agg(*[c.cast("double").alias(n) for n, c in what.items()])
    parts = [
        one(entries, entries=F.count(F.lit(1)), errors=F.count_if(is_error()), fatals=F.count_if(is_fatal()), slow_statements=F.count_if(is_slow(threshold_ms)), slow_ms=F.sum(F.when(is_slow(threshold_ms), F.col("duration_ms")))),
        one(locks, lock_events=F.count(F.lit(1)), deadlocks=F.count_if("is_deadlock")),
        one(done, checkpoints=F.count(F.lit(1)), checkpoint_avg_ms=F.avg("duration_ms")),
        one(vacuums, autovacuums=F.count(F.lit(1))),
        one(files, temporary_files=F.count(F.lit(1)), temporary_bytes=F.sum("size_bytes")),
        one(aggregate.connection_summary(entries), connections=F.sum("connections"), auth_failures=F.sum("auth_failures")),
    ]
    out = None
    for p in parts:
        long = p.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in p.columns]), F.array(*[F.col(c) for c in p.columns]))).alias("metric", "value"))
        out = long if out is None else out.unionByName(long)
    return out.withColumn("value", F.coalesce("value", F.lit(0.0)))


def diff_metrics(before: DataFrame, after: DataFrame, threshold_ms: float = 1000.0) -> DataFrame:
    a = metrics(before, threshold_ms).withColumnRenamed("value", "before")
    b = metrics(after, threshold_ms).withColumnRenamed("value", "after")
    return a.join(b, "metric").withColumns({"delta": F.col("after") - F.col("before"), "change": X.ratio(F.col("after") - F.col("before"), F.col("before"), percent=True)})
