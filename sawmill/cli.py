"""Command line: python -m sawmill.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from functools import reduce
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from sawmill import session
from sawmill.functions import text as X
from sawmill.operators import aggregate
from sawmill.operators.filters import EntryFilter, relative_time
from sawmill.plans import analysis, report, rules, timeline
from sawmill.sources import config, logfiles, prefix, remote, snapshots
from sawmill.streaming import tail, watch

VERSION = "0.1.0"


def options() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("sawmill")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, files: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help)
        if files:
            p.add_argument("paths", nargs="+")
            p.add_argument("--format")
            p.add_argument("--log-line-prefix")
            p.add_argument("--config")
            p.add_argument("--rules")
            p.add_argument("--platform")
            p.add_argument("--slow-ms", type=float)
            p.add_argument("--top", type=int, default=25)
            p.add_argument("--base-year", type=int)
            p.add_argument("--recursive", action="store_true")
            p.add_argument("--from-time")
            p.add_argument("--to-time")
            for n in ("database", "user", "application", "host", "session", "exclude-database", "exclude-user", "include-query", "exclude-query"):
                p.add_argument(f"--{n}", action="append", default=[])
            p.add_argument("--pid", action="append", type=int, default=[])
            p.add_argument("--select-only", action="store_true")
            p.add_argument("--anonymize", action="store_true")
            p.add_argument("--output", choices=("text", "json", "markdown", "html", "jsonl", "csv"), default="text")
            p.add_argument("--out")
        return p

    p = command("analyze", "full report; paths: files, directories, http(s)://, ssh://[user@]host[:port]/path, - for standard input")
    p.add_argument("--snapshot")
    p.add_argument("--by-database", action="store_true", help="a report for each database, to --out with its name before the suffix")
    p.add_argument("--state", help="a file that remembers the last time seen: only later entries count")
    command("summary", "five lines; exit code 0, 1 or 2")
    command("timeline", "incident timeline")
    p = command("dump", "statement statistics")
    p.add_argument("--min-count", type=int, default=1)
    p.add_argument("--min-ms", type=float, default=0.0)
    command("save", "keep an analysis for later comparison").add_argument("--label", default="")
    command("diff", "compare two logs: before, after")
    command("index-advisor", "columns that slow statements filter on")
    p = command("watch", "alerts on a directory of log files")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--once", action="store_true")
    p.add_argument("--from-start", action="store_true", help="a single file: from its first line, not only what is appended")
    p.add_argument("--errors-per-minute", type=int, help="alert on so many errors within a minute")
    p.add_argument("--webhook", help="an address that each batch of alerts is posted to")
    p = command("rules", "list rules or write an example pack", files=False)
    p.add_argument("action", choices=("list", "init"))
    p.add_argument("--out")
    p = command("config", "show thresholds or write them", files=False)
    p.add_argument("action", choices=("show", "init"))
    command("prefixes", "known line prefixes", files=False)
    command("version", "print the version", files=False)
    return top


def lines_of(spark, paths: list[str]):
    """Raw lines of paths that are no files: standard input, or other hosts'. None if all are files."""
    elsewhere = [p for p in paths if p == "-" or p.startswith(("http://", "https://", "ssh://"))]
    if not elsewhere:
        return None
    parts = [logfiles.raw_lines(spark, own)] if (own := logfiles.expanded(spark, [p for p in paths if p not in elsewhere])) else []
    if "-" in elsewhere:
        parts.append(logfiles.from_lines(spark, sys.stdin.readlines(), "stdin"))
    if urls := [p for p in elsewhere if p.startswith("http")]:
        parts.append(remote.http_lines(spark, urls))
    if hosts := [urlsplit(p) for p in elsewhere if p.startswith("ssh://")]:
        parts.append(remote.command_lines(spark, {u.geturl(): remote.ssh_command(u.hostname, u.path, u.username, u.port or 22) for u in hosts}))
    return reduce(lambda x, y: x.unionByName(y), parts)


def watched(spark, a, t: rules.Thresholds) -> None:
    """Alerts on a directory's new files, or on what is appended to one file: rows as they come and, if asked for, the rate of errors."""
    lines = tail.tail(spark, a.paths[0], not a.from_start) if Path(a.paths[0]).is_file() else watch.lines_from(spark, a.paths[0])
    rows = watch.entries_from(lines, a.log_line_prefix)
    recent = watch.Recent()
    post = watch.webhook(a.webhook) if a.webhook else None

    def sink(alerts, batch: int) -> None:
        seen = len(recent.alerts)
        recent(alerts, batch)
        for r in list(recent.alerts)[seen if seen < recent.alerts.maxlen else -1 :]:
            print(f"{r['timestamp']} {r['severity']} {r['kind']}: {r['message']}", flush=True)
        if post:
            post(alerts, batch)

    running = [watch.start(watch.row_alerts(rows, t.slow_ms), f"{a.checkpoint}/rows", sink, once=a.once)]
    if a.errors_per_minute:
        running.append(watch.start(watch.error_rate(rows, a.errors_per_minute), f"{a.checkpoint}/rate", sink, once=a.once))
    for q in running:
        q.awaitTermination()


def entries_of(spark, a, paths: list[str]):
    e = logfiles.read_logs(spark, paths, a.format, a.log_line_prefix, base_year=a.base_year, recursive=a.recursive, lines=lines_of(spark, paths))
    at = lambda t: relative_time(t) if t else None
    own = EntryFilter(at(a.from_time), at(a.to_time), a.database, a.user, a.application, a.host, a.pid, a.session, a.exclude_database, a.exclude_user, a.select_only, a.include_query, a.exclude_query)
    e = own.apply(e)
    if a.anonymize:
        e = e.withColumns({c: X.anonymize(F.col(c)) for c in ("message", "query", "raw_line")})
    return e


def put(text: str, out: str | None) -> None:
    if out:
        Path(out).write_text(text, encoding="utf-8")
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    a = options().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "prefixes":
        print("\n".join(f"{n}\t{t}\t{prefix.Prefix(t).description()}" for n, t in prefix.COMMON.items()))
        return 0
    if a.command == "rules":
        put("\n".join(f"{r.id}\t{r.title}" for r in rules.RULES) if a.action == "list" else config.EXAMPLE_PACK, a.out)
        return 0
    if a.command == "config":
        print(json.dumps({"thresholds": asdict(rules.Thresholds())}, indent=2))
        return 0
    spark = session.get_session()
    settings = a.config or config.discover_config()
    given = config.load(settings) if settings else {}
    t = rules.Thresholds.of(given.get("thresholds"))
    if a.slow_ms is not None:
        t.slow_ms = a.slow_ms
    pack = config.rule_pack(config.load(a.rules)) if a.rules else None
    if a.command == "watch":
        watched(spark, a, t)
        return 0
    if a.command == "diff":
        if len(a.paths) != 2:
            raise SystemExit("diff takes two logs")
        before, after = (analysis.Analysis(entries_of(spark, a, [p]), t, pack) for p in a.paths)
        put(report.render(report.sections(before.against(after)), a.output if a.output in ("json", "markdown", "html") else "text", "Before and after"), a.out)
        return 0
    e = entries_of(spark, a, a.paths)
    state = Path(a.state) if getattr(a, "state", None) else None
    if state and state.exists():
        e = e.filter(F.col("timestamp") > F.lit(json.loads(state.read_text())["last"]).cast("timestamp"))
    if a.output == "jsonl":
        if not a.out:
            raise SystemExit("--output jsonl needs --out")
        watch.json_lines(e, a.out)
        return 0
    files = all(p != "-" and "://" not in p for p in a.paths)
    platform = a.platform or given.get("platform") or (logfiles.platform(spark, logfiles.expanded(spark, a.paths, a.recursive), a.format) if files else None)
    run = analysis.Analysis(e, t, pack, platform, a.top)
    form = a.output if a.output in ("json", "markdown", "html") else "text"
    if a.command == "analyze":
        parts = run.sections() | (run.with_snapshot(snapshots.read_snapshot(spark, a.snapshot)) if a.snapshot else {})
        if a.by_database:
            for name, own in run.by_database().items():
                one = analysis.Analysis(own, t, pack, platform, a.top, keep=False)
                put(report.render(report.sections(one.sections()), form, name), str(Path(a.out).with_name(f"{Path(a.out).stem}-{name}{Path(a.out).suffix}")) if a.out else None)
        else:
            put(report.render(report.sections(parts), form), a.out)
        if state and (last := run.entries.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]):
            state.write_text(json.dumps({"last": last}))
    elif a.command == "summary":
        text, code = run.summary()
        put(text, a.out)
        return code
    elif a.command == "timeline":
        put(report.render(report.sections({"timeline": timeline.build(run.entries, t)}), form, "Timeline"), a.out)
    elif a.command == "dump":
        rows = aggregate.slow_queries(run.entries, 0.0, None).filter(f"count >= {a.min_count} and avg_ms >= {a.min_ms}")
        if a.output == "csv" and a.out:
            rows.drop("databases", "users", "applications").write.mode("overwrite").option("header", True).csv(a.out)
        else:
            put(report.render(report.sections({"slow_queries": rows}, {"slow_queries": 10_000}), form), a.out)
    elif a.command == "save":
        if not a.out:
            raise SystemExit("save needs --out")
        config.save(run.sections(), a.out, a.label)
    elif a.command == "index-advisor":
        put(report.render(report.sections({"index_candidates": analysis.index_candidates(aggregate.slow_queries(run.entries, t.slow_ms, None))}), form, "Indexes"), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
