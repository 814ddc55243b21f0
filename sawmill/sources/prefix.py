"""Line prefixes: a server's log_line_prefix becomes a Java pattern with positional groups.

Escapes before %q are required, those behind it may be missing (background processes print none of them)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sawmill.functions import text as X

# Escapes of log_line_prefix, the field each stands for and what it may look like.
ESCAPES = {
    "a": ("application_name", r"[^\s\[]+"),
    "u": ("user", r"[^\s@\[,]+"),
    "d": ("database", r"[^\s\[,/]+"),
    "r": ("remote_host_port", r"[\w.\-:]+(?:\(\d+\))?"),
    "h": ("remote_host", r"[\w.\-:]+"),
    "b": ("backend_type", r"\w+(?: \w+)*"),
    "p": ("pid", r"\d+"),
    "P": ("parallel_leader_pid", r"\d+"),
    "t": ("timestamp", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?: [A-Z]{2,5}[+\-]?\d*)?"),
    "m": ("timestamp_ms", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+(?: [A-Z]{2,5}[+\-]?\d*)?"),
    "n": ("timestamp_epoch", r"\d+\.\d+"),
    "i": ("command_tag", r"\w*"),
    "e": ("sql_state", r"[A-Z0-9]{5}"),
    "c": ("session_id", r"[0-9a-f]+\.[0-9a-f]+"),
    "l": ("line_num", r"\d+"),
    "s": ("session_start", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?: [A-Z]{2,5})?"),
    "v": ("virtual_txid", r"\d+/\d+"),
    "x": ("txid", r"\d+"),
    "Q": ("query_id", r"-?\d+"),
}
# Prefixes in common use.
COMMON = {
    "default_pg10": "%m [%p] ",
    "default_legacy": "%t [%p]: ",
    "with_user_db": "%m [%p] %q%u@%d ",
    "with_user_db_app": "%m [%p] %q%u@%d/%a ",
    "debian": "%t [%p-%l] %q%u@%d ",
    "edb_recommended": "%m [%p]: [%l-1] user=%u,db=%d,app=%a,client=%h ",
    "edb_syslog": "%t [%p]: [%l-1] user=%u,db=%d,sessid=%c ",
    "pgbadger_classic": "%t [%p]: [%l-1] ",
    "rds": "%t:%r:%u@%d:[%p]:",
    "full": "%m [%p] %q[user=%u,db=%d,app=%a,client=%h] ",
}
LEVEL = r"(DEBUG\d?|INFO|NOTICE|WARNING|ERROR|FATAL|PANIC|LOG|DETAIL|HINT|CONTEXT|STATEMENT|QUERY):\s*"
_ESCAPE = re.compile(r"%(-?\d*)([a-zA-Z%])")
# Escapes that key=value prefixes print as nothing.
EMPTY_AFTER = "="


@dataclass
class Prefix:
    """pattern matches a whole line: the prefix, an optional [label], the level and the message."""

    text: str
    pattern: str = ""
    fields: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        out, at, optional = ["^"], 0, False
        for m in _ESCAPE.finditer(self.text):
            literal = self.text[at : m.start()]
            out.append(self._literal(literal))
            at = m.end()
            code = m[2]
            if code == "%":
                out.append("%")
            elif code == "q":
                if not optional:
                    out.append("(?:")
                    optional = True
            elif code in ESCAPES:
                name, shape = ESCAPES[code]
                nth = sum(f == name or f.startswith(f"{name}_") and f[len(name) + 1 :].isdigit() for f in self.fields)
                self.fields.append(name if not nth else f"{name}_{nth + 1}")
                empty = "?" if literal.endswith(EMPTY_AFTER) else ""
                pad = r"\s*" if m[1] else ""
                out.append(f"{pad}({shape}){empty}{pad}")
            else:
                out.append(re.escape(m[0]))
        out.append(self._literal(self.text[at:]))
        if optional:
            out.append(")?")
        self.head = "".join(out)
        self.pattern = f"(?s){self.head}\\s*(?:\\[[^\\]]*\\]\\s*)?{LEVEL}(.*)$"

    @staticmethod
    def _literal(text: str) -> str:
        return "".join(r"\s*" if c.isspace() else re.escape(c) for c in text)

    @property
    def level_group(self) -> int:
        return len(self.fields) + 1

    def has(self, name: str) -> bool:
        return name in self.fields

    def warnings(self) -> list[str]:
        out = []
        if not {"timestamp", "timestamp_ms", "timestamp_epoch"} & set(self.fields):
            out.append("no time (%t, %m or %n): entries will have no timestamp")
        if not {"pid", "session_id"} & set(self.fields):
            out.append("no process or session (%p or %c): sessions and two-line statements cannot be told apart")
        return out

    def description(self) -> str:
        before, _, behind = self.text.partition("%q")
        names = lambda t: ", ".join(ESCAPES[m[2]][0] for m in _ESCAPE.finditer(t) if m[2] in ESCAPES)
        return names(before) + (f" [{names(behind)}]" if behind else "")

    def parse(self, line: str) -> dict[str, str] | None:
        """A line's fields on the driver; None where the prefix does not match."""
        m = re.match(self.head.replace("(?s)", ""), line)
        return None if m is None else {f: v.strip() for f, v in zip(self.fields, m.groups(), strict=True) if v and v.strip()}

    def column(self, line: Column, name: str) -> Column:
        return F.trim(X.found(line, self.pattern, self.fields.index(name) + 1)) if name in self.fields else F.lit(None).cast("string")


def common(name: str) -> Prefix | None:
    return Prefix(COMMON[name]) if name in COMMON else None


def detect(lines: list[str], least: float = 0.5) -> Prefix | None:
    """The common prefix that makes most lines parse, up to their level; more fields win a tie. None if under half do."""
    some = [x for x in lines if x.strip() and not x[:1].isspace()]
    best, score = None, (0, 0)
    for text in COMMON.values():
        p = Prefix(text)
        whole = re.compile(p.pattern)
        got = [m for m in map(whole.match, some) if m]
        filled = sum(sum(g is not None for g in m.groups()) for m in got)
        if (len(got), filled) > score:
            best, score = p, (len(got), filled)
    return best if some and score[0] > least * len(some) else None


def likely_fields(lines: DataFrame, column: str = "text", least: float = 0.3) -> DataFrame:
    """field, share, present: which fields the lines seem to carry before their level."""
    shapes = {
        "user": r"user=|(?:^|\s)\w+@\w+", "database": r"db=|@\w+(?:/|\s|$)", "application": r"app=|/\w+\s", "host": r"client=|host=|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
        "session_id": r"[0-9a-f]{8,}\.[0-9a-f]+", "sqlstate": r"\b[A-Z0-9]{5}\b",
    }
    head = F.substring(F.regexp_replace(F.col(column), rf"(?is){LEVEL}.*$", ""), 1, 120)
    out = lines.agg(*[F.avg(head.rlike(p).cast("double")).alias(n) for n, p in shapes.items()])
    long = out.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in shapes]), F.array(*[F.col(n) for n in shapes]))).alias("field", "share"))
    return long.withColumn("present", F.coalesce(F.col("share") > least, F.lit(False)))
