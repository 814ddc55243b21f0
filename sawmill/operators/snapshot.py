"""Correlation of logged statements with a statement-statistics snapshot, by canonical fingerprint on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.functions import text as X

COLUMNS = ("queryid", "query", "calls", "total_exec_time", "mean_exec_time", "min_exec_time", "max_exec_time", "rows", "shared_blks_hit", "shared_blks_read", "temp_blks_read", "temp_blks_written", "blk_read_time", "blk_write_time")


def keyed(snapshot: DataFrame) -> DataFrame:
    """One row for each fingerprint; of several the one with the largest queryid. With the cache hit ratio in percent."""
    hit, read = F.coalesce("shared_blks_hit", F.lit(0)), F.coalesce("shared_blks_read", F.lit(0))
    rows = snapshot.withColumn("fingerprint", F.substring(X.fingerprint(F.col("query")), 1, 500)).withColumn("cache_hit_ratio", F.when(hit + read > 0, hit / (hit + read) * 100).otherwise(0.0))
    own = F.struct(*[F.col(c) for c in rows.columns if c != "fingerprint"])
    return rows.groupBy("fingerprint").agg(F.max_by(own, F.coalesce("queryid", F.lit(0))).alias("s")).select("fingerprint", "s.*")


def matched(queries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Statements on both sides, the largest difference in total time first. queries: slow_queries(top=None)."""
    s = keyed(snapshot)
    both = queries.select("fingerprint", F.col("count").alias("log_calls"), F.col("total_ms").alias("log_ms"), F.col("avg_ms").alias("log_avg_ms")).join(
        s.select("fingerprint", "queryid", "calls", F.col("total_exec_time").alias("snapshot_ms"), F.col("mean_exec_time").alias("snapshot_avg_ms"), "rows", "cache_hit_ratio"), "fingerprint"
    )
    out = both.withColumns({"call_ratio": X.ratio(F.col("log_calls"), F.col("calls"), 2), "time_delta_ms": F.bround(F.col("log_ms") - F.col("snapshot_ms"), 2)})
    return out.orderBy(F.desc("time_delta_ms"), "fingerprint")


def log_only(queries: DataFrame, snapshot: DataFrame) -> DataFrame:
    return queries.join(keyed(snapshot), "fingerprint", "left_anti")


def snapshot_only(queries: DataFrame, snapshot: DataFrame) -> DataFrame:
    return keyed(snapshot).join(queries, "fingerprint", "left_anti")


def enriched(queries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """queries with the snapshot's columns, null where it has none."""
    s = keyed(snapshot)
    return queries.join(s.select("fingerprint", *[F.col(c).alias(f"snapshot_{c}") for c in ("queryid", "calls", "total_exec_time", "mean_exec_time", "rows", "cache_hit_ratio", "temp_blks_written")]), "fingerprint", "left")


def match_rate(queries: DataFrame, snapshot: DataFrame) -> DataFrame:
    s = keyed(snapshot).select(F.col("fingerprint").alias("f"))
    out = queries.select("fingerprint").join(s, F.col("fingerprint") == F.col("f"), "left").agg(F.count(F.lit(1)).alias("log_queries"), F.count("f").alias("matched"))
    return out.withColumn("match_rate", F.coalesce(X.ratio(F.col("matched"), F.col("log_queries")), F.lit(0.0)))


def totals(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.count(F.lit(1)).alias("queries"), F.sum("calls").alias("calls"), F.sum("total_exec_time").alias("exec_ms"))


def by_id(snapshot: DataFrame, queryid: int) -> DataFrame:
    return snapshot.filter(F.col("queryid") == queryid)
