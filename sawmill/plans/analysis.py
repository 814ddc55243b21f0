"""A whole analysis: named frames over one set of entries, which are kept once for all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.functions import text as X
from sawmill.operators import aggregate, compare, extract, ordered, snapshot
from sawmill.operators.filters import is_fatal, without_ignored
from sawmill.plans import report, rules, timeline


class Analysis:
    """Sections are built when asked for. entries: enriched, in canonical columns."""

    def __init__(self, entries: DataFrame, thresholds: rules.Thresholds | None = None, pack: rules.RulePack | None = None, platform: str | None = None, top: int = 25, keep: bool = True):
        self.thresholds, self.pack, self.platform, self.top = thresholds or rules.Thresholds(), pack, platform, top
        rows = ordered.correlate_statements(without_ignored(entries, pack.ignored_errors, pack.ignored_queries) if pack else entries)
        self.entries = extract.marked(rows).persist(StorageLevel.MEMORY_AND_DISK) if keep else rows

    def close(self) -> None:
        self.entries.unpersist()

    @cached_property
    def findings(self) -> DataFrame:
        return rules.findings(rules.metrics_row(self.entries, self.thresholds, self.platform), self.thresholds, self.pack)

    def sections(self) -> dict[str, DataFrame]:
        e, t = self.entries, self.thresholds
        return {
            "findings": self.findings,
            "recommendations": rules.recommendations(self.findings),
            "throughput": aggregate.throughput(e),
            "slow_queries": aggregate.slow_queries(e, t.slow_ms, self.top),
            "regressions": ordered.regressions(aggregate.keyed_queries(e, t.slow_ms)).filter("regressing"),
            "errors": aggregate.error_patterns(e, 50),
            "error_categories": aggregate.error_categories(e),
            "connections": aggregate.connection_summary(e),
            "connections_by_hour": aggregate.connections_by(e, "hour").orderBy("hour"),
            "connections_by_host": aggregate.connections_by(e, "host").orderBy(F.desc("connections"), "host"),
            "peak_concurrent": ordered.peak_concurrent(e),
            "sessions": ordered.session_summary(e),
            "session_lengths": ordered.sessions(e).groupBy("bucket").agg(F.count(F.lit(1)).alias("sessions")),
            "locks": extract.lock_events(e).orderBy("seq"),
            "checkpoints": aggregate.checkpoint_summary(e),
            "checkpoint_events": extract.checkpoint_events(e).orderBy(F.desc("timestamp")),
            "autovacuum": aggregate.autovacuum_frequency(e),
            "temporary_files": extract.temporary_files(e).orderBy(F.desc("size_bytes"), "seq"),
            "replication_lag": extract.replication_lag(e).orderBy("seq"),
            "query_types": aggregate.query_types(e),
            "phases": aggregate.phase_totals(e),
            "cancelled": extract.cancelled_queries(e).orderBy("seq"),
            "pooler": aggregate.pooler_summary(e),
            "pooler_errors": aggregate.pooler_errors(e),
            "pool_efficiency": aggregate.pool_efficiency(e),
            "plans": ordered.plan_blocks(e).orderBy(F.desc("duration_ms"), "seq"),
            "planned_queries": ordered.with_plans(aggregate.slow_queries(e, t.slow_ms, self.top), ordered.plan_blocks(e)).filter("plans > 0"),
            "fatal": e.filter(is_fatal()).select("seq", "timestamp", "log_level", "message").orderBy("seq").limit(50),
            "timeline": timeline.build(e, t),
        }

    def report(self, kind: str = "text", only: list[str] | None = None) -> str:
        own = self.sections()
        return report.render(report.sections({k: v for k, v in own.items() if not only or k in only}), kind)

    def summary(self) -> tuple[str, int]:
        """Five lines and the exit code: 2 with a critical finding, 1 with a high one, else 0."""
        h = report.health(self.findings).first()
        t = aggregate.throughput(self.entries, self.thresholds.slow_ms).first()
        lines = [f"entries: {t['entries']}", f"errors: {t['errors']}", f"slow statements: {t['statements']}", f"findings: {h['findings']} ({h['critical']} critical)", f"health: {('good', 'degraded', 'critical')[h['exit_code']]}"]
        return "\n".join(lines), int(h["exit_code"])

    def by_database(self) -> dict[str, DataFrame]:
        """Entries of each database; writers may use partitionBy('database') instead."""
        return {r[0]: self.entries.filter(F.col("database") == r[0]) for r in self.entries.select("database").filter("database is not null").distinct().orderBy("database").collect()}

    def against(self, other: Analysis) -> dict[str, DataFrame]:
        """Differences from this run (before) to another (after)."""
        t = self.thresholds
        q = [aggregate.slow_queries(x.entries, t.slow_ms, None) for x in (self, other)]
        p = [aggregate.error_patterns(x.entries, None) for x in (self, other)]
        return {
            "queries": compare.diff_queries(*q).orderBy(F.desc_nulls_last("p95_change"), "fingerprint"),
            "errors": compare.diff_errors(*p).orderBy(F.desc_nulls_last("count_after"), "pattern"),
            "metrics": compare.diff_metrics(self.entries, other.entries, t.slow_ms).orderBy("metric"),
        }

    def with_snapshot(self, snap: DataFrame) -> dict[str, DataFrame]:
        q = aggregate.slow_queries(self.entries, self.thresholds.slow_ms, None)
        return {"matched": snapshot.matched(q, snap), "log_only": snapshot.log_only(q, snap), "snapshot_only": snapshot.snapshot_only(q, snap), "match_rate": snapshot.match_rate(q, snap), "enriched": snapshot.enriched(q, snap), "snapshot_totals": snapshot.totals(snap)}


def index_candidates(queries: DataFrame) -> DataFrame:
    """table_name, columns, total_ms, statements: columns that slow statements filter or join on, as `create index` text.

    Read off the statements' text: comparisons behind WHERE, AND, ON of statements on one table."""
    q = F.col("fingerprint")
    name = F.lower(F.coalesce(X.found(q, r"(?i)\bFROM\s+([\w.\"]+)"), X.found(q, r"(?i)\bUPDATE\s+([\w.\"]+)")))
    where = X.found(q, r"(?is)\bWHERE\b(.*?)(?:\bGROUP BY\b|\bORDER BY\b|\bLIMIT\b|$)")
    columns = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(where, F.lit(r"([A-Za-z_][\w.]*)\s*(?:=|<|>|IN\b|LIKE\b|BETWEEN\b)"), 1), lambda c: F.lower(F.substring_index(c, ".", -1)))))
    rows = queries.select(name.alias("table_name"), columns.alias("columns"), "total_ms", "count").filter((F.size("columns") > 0) & F.col("table_name").isNotNull())
    out = rows.groupBy("table_name", "columns").agg(F.sum("total_ms").alias("total_ms"), F.sum("count").alias("calls"))
    return out.withColumn("statement", F.concat(F.lit("CREATE INDEX ON "), F.col("table_name"), F.lit(" ("), F.array_join("columns", ", "), F.lit(")"))).orderBy(F.desc("total_ms"), "table_name")


def context(analysis: Analysis, most_tokens: int = 3000) -> str:
    """What a language model is told about an analysis: the leading rows of each section, cut to a number of tokens (words x 1.3)."""
    parts = report.sections({k: v for k, v in analysis.sections().items() if k in ("findings", "throughput", "slow_queries", "errors", "checkpoints", "locks")}, {"slow_queries": 10, "errors": 10, "locks": 5})
    words = report.as_text(parts).split(" ")
    return " ".join(words[: int(most_tokens / 1.3)])


def explain(analysis: Analysis, ask: Callable[[str], str], question: str = "What should be done first, and why?") -> str:
    """Asks a model that the caller brings; its errors are its caller's."""
    return ask(f"You advise on a database server.\n\n{context(analysis)}\n\n{question}")
