"""The events log written out as each log format's files and read back: readers, headers, prefixes and compression.

What is written follows the servers' own documentation of the formats; the SQL asks the events for the same columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.functions import text as X
from sawmill.plans import oracle as O
from sawmill.session import work_folder
from sawmill.sources import logfiles
from sawmill.sources.events import log_entries

PREFIX = "%t|%p|%u|%d|%a|%h|"
#: What a reader of each format can know besides time, level and message.
FIELDS = {
    "stderr": ("pid", "user", "database"), "rds": ("pid", "user", "database"), "syslog": ("pid", "user", "database", "application_name", "remote_host"), "logplex": ("user", "database", "application_name", "remote_host"),
    "redshift": ("pid",), "pgbouncer": ("pid",), "csvlog": ("pid", "user", "database", "application_name", "remote_host"), "jsonlog": ("pid", "user", "database", "application_name", "remote_host"),
    "cloudsql": ("pid", "user", "database"), "prefix": ("pid", "user", "database", "application_name", "remote_host"),
}
FIELDS |= {"syslog2": FIELDS["syslog"], "stderr_gzip": FIELDS["stderr"], "stderr_bzip2": FIELDS["stderr"]}
SQL_NAMES = {"user": '"user"', "application_name": "application", "remote_host": "host"}


def _at(form: str) -> Column:
    return F.date_format("timestamp", form)


def _line(kind: str) -> Column:
    M, L = F.col("message"), F.col("log_level")
    pid, user, database, app, host = (F.col(c).cast("string") for c in ("pid", "user", "database", "application_name", "remote_host"))
    stderr = F.concat(_at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC ["), pid, F.lit("] "), user, F.lit("@"), database, F.lit(" "), L, F.lit(":  "), M)
    keys = F.concat(F.lit("user="), user, F.lit(",db="), database, F.lit(",app="), app, F.lit(",client="), host, F.lit(" "))
    syslog = F.concat(_at("MMM "), F.lpad(_at("d"), 2, " "), _at(" HH:mm:ss"), F.lit(" db1 postgres["), pid, F.lit("]: [7-1] "), keys, L, F.lit(":  "), F.replace(M, F.lit("\n"), F.lit("#012")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    empty = F.lit("")
    csv = [_at("yyyy-MM-dd HH:mm:ss.SSS 'UTC'"), quoted(user), quoted(database), pid, quoted(host), empty, F.lit("1"), empty, empty, empty, empty, L, F.lit("00000"), quoted(M), *[empty] * 8, quoted(app), empty]
    iso = _at("yyyy-MM-dd HH:mm:ss.SSS 'UTC'")
    own = F.struct(iso.alias("timestamp"), F.col("pid"), F.col("user"), F.col("database").alias("dbname"), F.col("application_name"), F.col("remote_host"), L.alias("error_severity"), M.alias("message"))
    return {
        "stderr": stderr,
        "rds": F.concat(_at("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC:"), host, F.lit("(5000):"), user, F.lit("@"), database, F.lit(":["), pid, F.lit("]:"), L, F.lit(":  "), M),
        "syslog": syslog,
        "syslog2": F.concat(F.lit("<134>"), syslog),
        "logplex": F.concat(_at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 app[postgres.21]: [3-1] "), keys, L, F.lit(":  "), M),
        "redshift": F.concat(F.lit("'"), _at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("' ["), pid, F.lit("] "), L, F.lit(":  "), M),
        "pgbouncer": F.concat(_at("yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC ["), pid, F.lit("] "), L, F.lit(" "), M),
        "csvlog": F.concat_ws(",", *csv),
        "jsonlog": F.to_json(own),
        "cloudsql": F.to_json(F.struct(stderr.alias("textPayload"), iso.alias("timestamp"))),
        "prefix": F.concat(_at("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC|"), pid, F.lit("|"), user, F.lit("|"), database, F.lit("|"), app, F.lit("|"), host, F.lit("|"), L, F.lit(":  "), M),
    }[kind]


def _query(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    form, _, packed = kind.partition("_")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = log_entries(spark, sf_dir)
        e = e.filter("log_level <> 'PANIC'") if form == "pgbouncer" else e
        path = f"{work_folder(spark)}/sawmill/log-{kind}-{uuid.uuid4().hex}"
        rows = e.select(_line(form).alias("value")).write
        (rows.option("compression", packed) if packed else rows).text(path)
        read = logfiles.read_logs(spark, [path], prefix=PREFIX if form == "prefix" else None, base_year=2024)
        out = {c: F.col(c).cast("long") if c == "pid" else F.col(c) for c in FIELDS[kind]}
        if form == "rds":
            out["remote_host"] = F.substring_index("remote_host", ":", 1)
        return read.select(X.stamp(F.col("timestamp")).alias("at"), "log_level", "message", "duration_ms", *[c.alias(n) for n, c in out.items()])

    return run


def _sql(kind: str) -> str:
    fields = [*FIELDS[kind], *(["remote_host"] if kind == "rds" else [])]
    own = ", ".join(f"{SQL_NAMES.get(c, c)}{'::bigint' if c == 'pid' else ''} as \"{c}\"" for c in fields)
    return O.over_entries(f"select strftime(ts, '%Y-%m-%d %H:%M:%S') as at, log_level, message, duration_ms, {own} from e{' where log_level <> ' + O.quoted('PANIC') if kind == 'pgbouncer' else ''}")


def queries() -> dict:
    return {f"read_{kind}": _query(kind) for kind in FIELDS}


def oracle_sql() -> dict[str, str]:
    return {f"read_{kind}": _sql(kind) for kind in FIELDS}
