"""Log files to canonical entries.

Lines carry their file and the file split they come from. A split's lines are numbered within the split and
shifted by the counts of the splits before it, so that one large file is not one task; entries that span two
splits meet by their entry number."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sawmill.functions import patterns as P
from sawmill.functions import text as X
from sawmill.operators.enrich import enrich
from sawmill.sources.prefix import Prefix, detect

# How lines of each format begin, tried in this order.
_TIME = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
_LEVELS = r"(DEBUG\d?|INFO|NOTICE|WARNING|ERROR|FATAL|PANIC|LOG|DETAIL|HINT|CONTEXT|STATEMENT)"
FORMATS = (
    ("jsonlog", r"^\s*\{(?!.*(?:textPayload|jsonPayload|cloudsql_database)).*\"timestamp\""),
    ("cloudsql", r"^\s*\{.*(?:textPayload|jsonPayload|cloudsql_database)"),
    ("csvlog", rf"^{_TIME}\.\d+[^,]*,\"?[^,]*\"?,\"?[^,]*\"?,\d*,"),
    ("rds", rf"^{_TIME}(?: UTC)?:[\d.]+\(\d+\):\w+@\w+:\[\d+\]:"),
    ("pgbouncer", rf"^{_TIME}\.\d+\s+UTC\s+\[\d+\]\s+(?:LOG|WARNING|ERROR|NOTICE|FATAL)(?!:)\s"),
    ("stderr", rf"^{_TIME}(?:\.\d+)?\s*(?:UTC|[A-Z]{{2,5}}[+-]?\d{{0,2}})?\s+\[\d+"),
    ("logplex", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[+\-]\d{2}:\d{2}\s+app\[postgres"),
    ("redshift", rf"^'?{_TIME}\.\d+'?\s+\[\d+\]\s+"),
    ("syslog2", rf"^<\d+>{_MONTH}"),
    ("syslog", rf"^{_MONTH}"),
)
# Headers by format, and the group of each field.
_KEYS = r"(?:user=([^,]*),db=([^,]*),(?:app=([^,]*),)?(?:client=([^,\s]*),?)?\s*)?"
HEADERS: dict[str, tuple[str, dict[str, int]]] = {
    "stderr": (rf"(?s)^({_TIME}(?:\.\d+)?(?:\s*(?:UTC|[A-Z]{{2,5}}[+-]?\d{{0,2}}))?)\s+\[(\d+)[^\]]*\]:?\s+(?:\[[\d-]+\]\s+)?(?:([^@\s]+)@(\S+)\s+|([a-zA-Z_]\w*)\s+)?{_LEVELS}:\s*(.*)", {"timestamp": 1, "pid": 2, "user": 3, "database": 4, "only_user": 5, "level": 6, "message": 7}),
    "syslog_double": (
        rf"(?s)^(?:<\d+>)?\w{{3}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+\S+\s+(?:postgres|postgresql|edb|postmaster)\[\d+\]:\s+\[[\d-]+\]\s+({_TIME}(?:\.\d+)?(?:\s+[A-Z]{{2,5}})?)\s+\[(\d+)\]:\s+\[\d+-\d+\]\s+user=([^,]*),db=([^,]*),(?:app=([^,]*),)?(?:sessid=([^,\s]*))?(?:\S+)?\s*{_LEVELS}:\s+(.*)",
        {"timestamp": 1, "pid": 2, "user": 3, "database": 4, "application_name": 5, "session_id": 6, "level": 7, "message": 8},
    ),
    "syslog": (rf"(?s)^(?:<\d+>)?(\w{{3}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+\S+\s+(?:postgres|postgresql|edb|postmaster)\[(\d+)\]:\s+(?:\[[\d-]+\]\s+)?{_KEYS}{_LEVELS}:\s*(.*)", {"timestamp": 1, "pid": 2, "user": 3, "database": 4, "application_name": 5, "remote_host": 6, "level": 7, "message": 8}),
    "rds": (rf"(?s)^({_TIME}(?: UTC)?):([\d.]+\(\d+\)):(\w+)@(\w+):\[(\d+)\]:{_LEVELS}:\s*(.*)", {"timestamp": 1, "remote_host": 2, "user": 3, "database": 4, "pid": 5, "level": 6, "message": 7}),
    "logplex": (rf"(?s)^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}[+\-]\d{{2}}:\d{{2}})\s+app\[postgres[^\]]*\]:\s+(?:\[[\d-]+\]\s+)?(?:user=([^,]+),db=([^,]+),(?:app=([^,]+),)?(?:client=([^,\s]*))?[,\s]*)?{_LEVELS}:\s*(.*)", {"timestamp": 1, "user": 2, "database": 3, "application_name": 4, "remote_host": 5, "level": 6, "message": 7}),
    "redshift": (rf"(?s)^'?({_TIME}(?:\.\d+)?)'?\s+\[(\d+)\]\s+{_LEVELS}:\s*(.*)", {"timestamp": 1, "pid": 2, "level": 3, "message": 4}),
    "pgbouncer": (rf"(?s)^({_TIME}(?:\.\d+)?\s+UTC)\s+\[(\d+)\]\s+(LOG|WARNING|ERROR|NOTICE|FATAL|DEBUG)\s+(.*)", {"timestamp": 1, "pid": 2, "level": 3, "message": 4}),
}
CONTINUED = r"^\t|^(?:DETAIL|HINT|CONTEXT|QUERY|STATEMENT|LOCATION|WHERE):"
# The columns of csvlog, in order.
CSV_COLUMNS = (
    "log_time user_name database_name process_id connection_from session_id session_line_num command_tag session_start_time virtual_transaction_id transaction_id "
    "error_severity sql_state_code message detail hint internal_query internal_query_pos context query query_pos location application_name backend_type"
).split()
CSV_LEAST = 14
#: Suffixes that Spark's text reader opens itself; the others are unpacked by unpacked_lines().
SPARK_SUFFIXES, PACKED_SUFFIXES = (".gz", ".bz2"), (".xz", ".zip", ".zst", ".zstd", ".lz4")


def discover(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """path, modified, size of every log file below the paths, each once; oldest first."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    named = F.col("path").rlike(r"(?i)\.(?:log|csv|json|txt|out)(?:\.\d+)?(?:\.(?:gz|bz2|xz|zip|zst|zstd|lz4))?$|/postgresql[^/]*$")
    return own.filter(named).distinct().orderBy("modified", "path")


def expanded(spark: SparkSession, paths: list[str], recursive: bool = False) -> list[str]:
    """The paths with each directory replaced by the log files in it, oldest first."""
    out = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not any(c in p for c in "*?[{") and fs.exists(where) and fs.getFileStatus(where).isDirectory():
            out += [r["path"] for r in discover(spark, [p], recursive).collect()]
        else:
            out.append(p)
    return out


def unpacked_lines(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of whole files (path, content), in blocks; zip: all members, one after another. What has no reader here is an error."""

    def opened(path: str, content: bytes) -> list:
        raw = io.BytesIO(content)
        if path.lower().endswith(".zip"):
            import zipfile

            z = zipfile.ZipFile(raw)
            return [z.open(n) for n in z.namelist() if not n.endswith("/")]
        return [one(path.lower(), raw)]

    def one(name: str, raw):
        if name.endswith(".xz"):
            import lzma

            return lzma.open(raw)
        if name.endswith((".zst", ".zstd")):
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(raw)
        if name.endswith(".lz4"):
            import lz4.frame  # not in every installation

            return lz4.frame.open(raw)
        return raw

    for batch in files:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            at = 0
            for member in opened(path, content):
                text = io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="\n")
                while lines := text.readlines(4_000_000):
                    lines = [x.rstrip("\r\n") for x in lines]
                    yield pd.DataFrame({"source_file": path, "block": 0, "id": range(at, at + len(lines)), "text": lines})
                    at += len(lines)


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, block, id, text: id orders the lines of a block, blocks those of a file."""
    plain = [p for p in paths if not p.lower().endswith(PACKED_SUFFIXES)]
    packed = [p for p in paths if p.lower().endswith(PACKED_SUFFIXES)]
    out = None
    if plain:
        text = spark.read.option("encoding", "UTF-8").text(plain)
        out = text.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    if packed:
        files = spark.read.format("binaryFile").load(packed).select("path", "content")
        more = files.mapInPandas(unpacked_lines, "source_file string, block long, id long, text string")
        out = more if out is None else out.unionByName(more)
    if out is None:
        raise ValueError("no log files")
    return out


def line_format(line: Column) -> Column:
    return X.first_match(F.ltrim(line), FORMATS, None)


def detected_formats(numbered: DataFrame) -> DataFrame:
    """source_file, log_format: the first line of the first 20 with text that has a known beginning decides; else stderr."""
    some = numbered.filter((F.col("line_number") <= 40) & (F.trim("text") != "")).withColumn("f", line_format(F.col("text")))
    return some.groupBy("source_file").agg(F.coalesce(F.min_by("f", F.when(F.col("f").isNotNull(), F.col("line_number"))), F.lit("stderr")).alias("log_format"))


def numbered_lines(lines: DataFrame, prefix: Prefix | None = None, lenient: bool = True) -> DataFrame:
    """Adds line_number (from 1) and entry: the number of the entry a line belongs to in its file, 0 before the first.

    lenient: whatever does not begin like an entry continues the one before; else only tabs and DETAIL: and its like do."""
    begins = F.col("text").rlike(prefix.head) if prefix else line_format(F.col("text")).isNotNull()
    head = begins if lenient else ~F.col("text").rlike(CONTINUED)
    rows = lines.withColumn("head", F.coalesce(head, F.lit(False)).cast("int"))
    own = Window.partitionBy("source_file", "block").orderBy("id")
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_file", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("head").alias("h"))
    first = sums.select(F.col("source_file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("heads_before"))
    local = rows.withColumns({"nth": F.row_number().over(own), "heads": F.sum("head").over(own.rowsBetween(Window.unboundedPreceding, 0))})
    both = local.join(first, (F.col("source_file") == F.col("f")) & (F.col("block") == F.col("b")))
    return both.select("source_file", (F.col("lines_before") + F.col("nth")).alias("line_number"), (F.col("heads_before") + F.col("heads")).alias("entry"), "text")


def assembled(numbered: DataFrame, headless: bool = False) -> DataFrame:
    """source_file, line_number (of the first line), text: the lines of each entry, joined by line breaks. headless: each line before
    a file's first entry is one of its own, which no header will match."""
    lines = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    own = numbered.withColumn("entry", F.when(F.col("entry") > 0, F.col("entry")).otherwise(-F.col("line_number"))) if headless else numbered.filter("entry > 0")
    out = own.groupBy("source_file", "entry").agg(lines.alias("lines"))
    return out.select("source_file", F.col("lines")[0]["line_number"].alias("line_number"), F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def timestamp(text: Column, base_year: int | None = None) -> Column:
    """Times of all formats. A zone counts if Spark knows it, else the session's; years missing in syslog are base_year or this year."""
    year = F.lit(str(base_year)) if base_year else F.date_format(F.current_date(), "yyyy")
    plain = F.regexp_replace(text, r"\s+[A-Z]{2,5}[+-]?\d*$", "")
    syslog = F.try_to_timestamp(F.concat_ws(" ", year, F.regexp_replace(text, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return F.coalesce(text.try_cast("timestamp"), plain.try_cast("timestamp"), F.when(text.rlike(r"^[A-Z][a-z]{2}\s"), syslog), F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("long")) if base_year == 0 else F.lit(None).cast("timestamp"))


def decode_syslog(message: Column) -> Column:
    """#012 and its like (three octal digits) to their characters; other numbers behind # stay."""
    parts = F.split(F.regexp_replace(message, r"#([0-3][0-7]{2})", "\u0001$1\u0002"), "\u0001")
    code = lambda x: F.conv(F.substring_index(x, "\u0002", 1), 8, 10).cast("int")
    rest = lambda x: F.substring_index(x, "\u0002", -1)
    return F.array_join(F.transform(parts, lambda x: F.when(x.contains("\u0002"), F.concat(F.char(code(x)), rest(x))).otherwise(x)), "")


def _by_format(text: Column, formats: Column, name: str) -> Column:
    out = F.lit(None).cast("string")
    for fmt, (pattern, groups) in HEADERS.items():
        if name in groups and fmt != "syslog_double":
            value = X.found(text, pattern, groups[name])
            if fmt == "syslog":
                double, own = HEADERS["syslog_double"]
                twice = text.rlike(double)
                value = F.when(twice, X.found(text, double, own[name]) if name in own else F.lit(None)).otherwise(value)
                out = F.when(formats.isin("syslog", "syslog2"), value).otherwise(out)
            else:
                out = F.when(formats == fmt, value).otherwise(out)
        elif fmt == "syslog_double" and name in groups and name not in HEADERS["syslog"][1]:
            out = F.when(formats.isin("syslog", "syslog2"), X.found(text, pattern, groups[name])).otherwise(out)
    return out


def decoded(entries: DataFrame, base_year: int | None = None) -> DataFrame:
    """Assembled entries with log_format to raw fields; parse_ok says whether the header matched."""
    t, f = F.col("text"), F.col("log_format")
    get = lambda name: _by_format(t, f, name)
    message = get("message")
    message = F.when(f.isin("syslog", "syslog2"), decode_syslog(message)).otherwise(message)
    pooler = P.POOLER_EVENT
    m = F.col("message")
    out = entries.withColumns({"message": F.trim(message), "level": get("level"), "stamp": get("timestamp"), "process": get("pid")})
    return out.select(
        "source_file", "line_number", "log_format", timestamp(F.col("stamp"), base_year).alias("timestamp"), X.level(F.col("level")).alias("log_level"), get("session_id").alias("session_id"),
        F.col("process").try_cast("int").alias("pid"), F.coalesce(get("user"), get("only_user"), F.when(f == "pgbouncer", X.found(m, pooler, 3))).alias("user"),
        F.coalesce(get("database"), F.when(f == "pgbouncer", X.found(m, pooler, 2))).alias("database"), get("application_name").alias("application_name"),
        F.regexp_replace(get("remote_host"), r"^([\d.]+)\((\d+)\)$", "$1:$2").alias("remote_host"), F.coalesce("message", "text").alias("message"), F.col("text").alias("raw_line"), F.col("level").isNotNull().alias("parse_ok"),
    )


def with_prefix(entries: DataFrame, p: Prefix) -> DataFrame:
    """Assembled entries by a given prefix. Milliseconds before seconds before epoch times."""
    t = F.col("text")
    col = lambda name: p.column(t, name)
    epoch = F.timestamp_micros((col("timestamp_epoch").try_cast("double") * 1_000_000).cast("long"))
    host = F.coalesce(col("remote_host"), F.regexp_replace(col("remote_host_port"), r"\(\d+\)$", ""))
    return entries.select(
        "source_file", "line_number", F.lit("prefix").alias("log_format"), F.coalesce(timestamp(col("timestamp_ms")), timestamp(col("timestamp")), epoch).alias("timestamp"), X.level(X.found(t, p.pattern, p.level_group)).alias("log_level"),
        col("session_id").alias("session_id"), col("pid").try_cast("int").alias("pid"), col("user").alias("user"), col("database").alias("database"), col("application_name").alias("application_name"), host.alias("remote_host"),
        col("sql_state").alias("error_code"), F.coalesce(F.trim(F.regexp_extract(t, p.pattern, p.level_group + 1)), t).alias("message"), t.alias("raw_line"), t.rlike(p.pattern).alias("parse_ok"),
    )


def _json_text(line: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(line, f"$.{n}"), F.lit("")) for n in names])


def json_entries(lines: DataFrame) -> DataFrame:
    """One object a line; what is no object is dropped."""
    t = F.col("text")
    get = lambda *n: _json_text(t, *n)
    return lines.filter(F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*\{")).select(
        "source_file", "line_number", F.lit("jsonlog").alias("log_format"), timestamp(get("timestamp")).alias("timestamp"), X.level(F.coalesce(get("error_severity", "level"), F.lit("LOG"))).alias("log_level"), get("session_id").alias("session_id"),
        get("process_id", "pid").try_cast("int").alias("pid"), get("user", "user_name").alias("user"), get("dbname", "database_name").alias("database"), get("application_name").alias("application_name"),
        get("remote_host", "connection_from").alias("remote_host"), get("sql_state_code", "state_code").alias("error_code"), F.coalesce(get("message"), F.lit("")).alias("message"), get("query", "statement").alias("query"), t.alias("raw_line"), F.lit(True).alias("parse_ok"),
    )


def cloud_entries(lines: DataFrame) -> DataFrame:
    """Envelopes around stderr lines; an inner text without a header keeps the envelope's time and database."""
    t = F.col("text")
    own = lines.withColumns({"envelope": t, "inner": _json_text(t, "textPayload", "jsonPayload.message")}).filter("inner is not null")
    ready = decoded(own.select("source_file", "line_number", F.lit("stderr").alias("log_format"), F.col("inner").alias("text"), "envelope").drop("envelope"))
    envelope = own.select(F.col("source_file").alias("sf"), F.col("line_number").alias("ln"), "envelope")
    both = ready.join(envelope, (F.col("source_file") == F.col("sf")) & (F.col("line_number") == F.col("ln")))
    db = F.nullif(F.substring_index(_json_text(F.col("envelope"), "resource.labels.database_id"), ":", -1), F.lit(""))
    return both.withColumns({"timestamp": F.coalesce("timestamp", timestamp(_json_text(F.col("envelope"), "timestamp"))), "database": F.coalesce("database", db), "raw_line": F.trim("envelope"), "log_format": F.lit("cloudsql"), "parse_ok": F.lit(True)}).drop("sf", "ln", "envelope")


def csv_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """csvlog files; quoted fields may hold line breaks, rows of fewer than 14 columns are dropped, further columns ignored."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
    rows = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(paths).select("*", F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("nth"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    # Several files may share a task, and so its row numbers: each file, which is one task's, counts from its own first.
    first = rows.groupBy(F.col("source_file").alias("sf")).agg(F.min("nth").alias("first"))
    rows = rows.join(first, F.col("source_file") == F.col("sf"))
    return rows.filter(F.col(CSV_COLUMNS[CSV_LEAST - 1]).isNotNull()).select(
        "source_file", (F.col("nth") - F.col("first") + 1).alias("line_number"), F.lit("csvlog").alias("log_format"), timestamp(F.col("log_time")).alias("timestamp"), X.level(F.coalesce("error_severity", F.lit("LOG"))).alias("log_level"), some("session_id").alias("session_id"),
        F.col("process_id").try_cast("int").alias("pid"), some("user_name").alias("user"), some("database_name").alias("database"), some("application_name").alias("application_name"), some("connection_from").alias("remote_host"),
        some("sql_state_code").alias("error_code"), F.coalesce("message", F.lit("")).alias("message"), some("query").alias("query"), F.concat_ws(",", *CSV_COLUMNS).alias("raw_line"), F.lit(True).alias("parse_ok"),
    )


def with_seq(entries: DataFrame, files: list[str] | None = None) -> DataFrame:
    """Adds seq: the order of files (as given, else by name) and of lines within. Files are few, so their ranks are a small table."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    names = entries.select("source_file").distinct()
    spark = entries.sparkSession
    whole = [spark._jvm.org.apache.hadoop.fs.Path(f).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(".").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())).toString() if "://" not in f else f for f in files or []]
    given = spark.createDataFrame(list({f: (f, i) for i, f in reversed(list(enumerate(whole)))}.values()), "given string, place int")
    placed = names.join(F.broadcast(given), plain(F.col("source_file")) == plain(F.col("given")), "left").withColumn("place", F.coalesce("place", F.lit(len(whole))))
    ranks = placed.select(F.col("source_file").alias("f"), (F.row_number().over(Window.orderBy("place", "source_file")) - 1).alias("nth"))
    return entries.join(ranks, F.col("source_file") == F.col("f")).withColumn("seq", F.col("nth").cast("long") * (1 << 40) + F.col("line_number")).drop("f", "nth")


def detected_prefixes(numbered: DataFrame, lines: int = 50) -> dict[str, Prefix]:
    """The files whose lines the built-in header does not fit, but a common prefix does. numbered: of files without another format."""
    header = re.compile(HEADERS["stderr"][0])
    some: dict[str, list[str]] = {}
    for r in numbered.filter((F.col("line_number") <= lines) & (F.trim("text") != "")).select("source_file", "line_number", F.substring("text", 1, 500).alias("text")).orderBy("source_file", "line_number").collect():
        some.setdefault(r["source_file"], []).append(r["text"])
    out = {}
    for file, text in some.items():
        own = [x for x in text if not x[:1].isspace()]
        if 2 * sum(header.match(x) is not None for x in own) <= len(own) and (p := detect(own)) is not None:
            out[file] = p
    return out


def platform(spark: SparkSession, paths: list[str], log_format: str | None = None) -> str | None:
    """rds, redshift or cloudsql if a file is of that format."""
    found = [log_format] if log_format else [r["log_format"] for r in detected_formats(numbered_lines(raw_lines(spark, paths))).select("log_format").distinct().collect()]
    return next((f for f in ("rds", "redshift", "cloudsql") if f in found), None)


def read_logs(
    spark: SparkSession, paths: list[str], log_format: str | None = None, prefix: str | Prefix | None = None, lenient: bool = True, base_year: int | None = None, keep_failed: bool = False, recursive: bool = False,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Enriched entries of log files in any of the formats, detected for each file unless one is given. Directories stand for the log files in them.

    prefix: a log_line_prefix; where neither it nor a format is given, files that no header fits are tried with the common
    prefixes. keep_failed: adds log_format and parse_ok and keeps entries whose header did not match. lines: raw lines from
    elsewhere (a stream at hand, another host) in place of paths."""
    p = Prefix(prefix) if isinstance(prefix, str) else prefix
    paths = [] if lines is not None else expanded(spark, paths, recursive)
    lines = raw_lines(spark, paths) if lines is None else lines
    numbered = numbered_lines(lines, p, lenient)
    if p:
        ready = with_prefix(assembled(numbered, keep_failed), p)
    else:
        kinds = detected_formats(numbered)
        if log_format:
            kinds = kinds.withColumn("log_format", F.lit(log_format))
        known = {r["source_file"]: r["log_format"] for r in kinds.collect()}  # a row for each file
        tagged = numbered.join(kinds.select(F.col("source_file").alias("kf"), "log_format"), F.col("source_file") == F.col("kf")).drop("kf")
        plain = [f for f, k in known.items() if k == "stderr"]
        own = detected_prefixes(tagged.filter("log_format = 'stderr'")) if plain and not log_format else {}
        parts = []
        for text in sorted({x.text for x in own.values()}):
            q = Prefix(text)
            files = [f for f, x in own.items() if x.text == text]
            parts.append(with_prefix(assembled(numbered_lines(lines.filter(F.col("source_file").isin(files)), q, lenient), keep_failed), q))
        formats = {k for f, k in known.items() if f not in own} or {"stderr"}
        if own:
            tagged = tagged.filter(~F.col("source_file").isin(list(own)))
        if text := formats - {"csvlog", "jsonlog", "cloudsql"}:
            files = assembled(tagged.drop("log_format"), keep_failed).join(kinds.select(F.col("source_file").alias("kf"), "log_format"), F.col("source_file") == F.col("kf")).drop("kf")
            parts.append(decoded(files.filter(F.col("log_format").isin(*text)), base_year))
        if "jsonlog" in formats:
            parts.append(json_entries(tagged.filter("log_format = 'jsonlog'")))
        if "cloudsql" in formats:
            parts.append(cloud_entries(tagged.filter("log_format = 'cloudsql'")))
        if "csvlog" in formats:
            parts.append(csv_entries(spark, [f for f, k in known.items() if k == "csvlog"]))
        ready = parts[0]
        for x in parts[1:]:
            ready = ready.unionByName(x, allowMissingColumns=True)
    health = ready.select("source_file", "line_number", "log_format", "parse_ok")
    whole = with_seq(ready if keep_failed else ready.filter("parse_ok"), paths)
    out = enrich(whole)
    if keep_failed:
        out = out.join(health.withColumnsRenamed({"source_file": "hf", "line_number": "hl"}), (F.col("source_file") == F.col("hf")) & (F.col("line_number") == F.col("hl"))).drop("hf", "hl")
    return out


def parse_health(entries: DataFrame) -> DataFrame:
    """Entries tried and failed by file, and whether 5 % or more failed. entries: read_logs(keep_failed=True)."""
    out = entries.groupBy("source_file", "log_format").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("parse_ok")).alias("failed"))
    return out.withColumn("suspicious", F.col("failed") >= 0.05 * F.col("entries"))


def from_lines(spark: SparkSession, lines: list[str], name: str = "stream") -> DataFrame:
    """Lines at hand (standard input, a socket) as raw_lines()."""
    return spark.createDataFrame([(name, 0, i, x.rstrip("\r\n")) for i, x in enumerate(lines)], "source_file string, block long, id long, text string")


