"""Predicates and filters over log entries."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions import patterns as P


def is_slow(threshold_ms: float) -> Column:
    return F.col("duration_ms") >= F.lit(float(threshold_ms))


def is_error() -> Column:
    return F.col("log_level").isin(*P.ERROR_LEVELS)


def is_fatal() -> Column:
    return F.col("log_level").isin(*P.FATAL_LEVELS)


def relative_time(text: str, now: dt.datetime | None = None) -> dt.datetime:
    """2h, 30m, 7d, 45s, each also with a minus before it, counted back from now; or an ISO time. UTC where no zone is given."""
    now = now or dt.datetime.now(dt.UTC)
    if m := re.fullmatch(r"\s*-?\s*(\d+)\s*([smhdw])\s*", text):
        unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
        return now - dt.timedelta(**{unit: int(m[1])})
    at = dt.datetime.fromisoformat(text.strip())
    return at if at.tzinfo else at.replace(tzinfo=dt.UTC)


@dataclass
class EntryFilter:
    """Every condition given must hold. strict: an entry whose column is null fails an inclusion; else it passes."""

    from_time: dt.datetime | None = None
    to_time: dt.datetime | None = None
    databases: list[str] = field(default_factory=list)
    users: list[str] = field(default_factory=list)
    applications: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    pids: list[int] = field(default_factory=list)
    sessions: list[str] = field(default_factory=list)
    exclude_databases: list[str] = field(default_factory=list)
    exclude_users: list[str] = field(default_factory=list)
    select_only: bool = False
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    strict: bool = True

    def condition(self) -> Column:
        null = lambda c: F.lit(not self.strict) if not self.strict else F.lit(False)
        out = F.lit(True)
        for c, some in (("database", self.databases), ("user", self.users), ("application_name", self.applications), ("remote_host", self.hosts), ("pid", self.pids), ("session_id", self.sessions)):
            if some:
                out &= F.coalesce(F.col(c).isin(*some), null(c))
        if self.from_time:
            out &= F.coalesce(F.col("timestamp") >= F.lit(self.from_time), null("timestamp"))
        if self.to_time:
            out &= F.coalesce(F.col("timestamp") <= F.lit(self.to_time), null("timestamp"))
        for c, some in (("database", self.exclude_databases), ("user", self.exclude_users)):
            if some:
                out &= ~F.coalesce(F.col(c).isin(*some), F.lit(False))
        text = F.coalesce("query", "message")
        if self.select_only:
            out &= text.rlike(P.TYPES[0][1])
        for p in self.include:
            out &= text.rlike(f"(?i){p}")
        for p in self.exclude:
            out &= ~text.rlike(f"(?i){p}")
        return out

    def apply(self, entries: DataFrame) -> DataFrame:
        return entries.filter(self.condition())


def without_ignored(entries: DataFrame, errors: list[str] = (), queries: list[str] = ()) -> DataFrame:
    """Drops errors whose message, and entries whose statement, match one of the patterns."""
    out = entries
    for p in errors:
        out = out.filter(~(is_error() & F.col("message").rlike(f"(?i){p}")))
    for p in queries:
        out = out.filter(~F.coalesce(F.col("query").rlike(f"(?i){p}"), F.lit(False)))
    return out
