"""Statement-statistics snapshots: JSON (a list, {"rows": [...]} or one object), CSV with a header, or psql's aligned text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.operators.snapshot import COLUMNS

TEXT_COLUMNS = ("query",)
SCHEMA = ", ".join(f"{c} {'string' if c == 'query' else 'double' if c.endswith(('time',)) else 'bigint'}" for c in COLUMNS)
#: What exports a snapshot, for each form.
EXPORT_SQL = {
    "json": "SELECT json_agg(s) FROM (SELECT * FROM pg_stat_statements ORDER BY total_exec_time DESC) s",
    "csv": "COPY (SELECT * FROM pg_stat_statements ORDER BY total_exec_time DESC) TO STDOUT WITH CSV HEADER",
    "text": "SELECT queryid, query, calls, total_exec_time, mean_exec_time, rows FROM pg_stat_statements ORDER BY total_exec_time DESC",
}


def form_of(text: str) -> str:
    """json, csv or text by the first characters."""
    t = text.lstrip()
    if t[:1] in ("[", "{"):
        return "json"
    first = t.split("\n", 1)[0]
    return "csv" if "," in first and "|" not in first else "text"


def typed(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """All columns of a snapshot in their types, null where missing. scale: of the times, 1000 where they are seconds."""
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    lower = {c.lower().strip(): c for c in rows.columns}
    alias = {"total_exec_time": "total_time", "mean_exec_time": "mean_time", "min_exec_time": "min_time", "max_exec_time": "max_time"}
    out = []
    for c, kind in kinds.items():
        own = lower.get(c) or lower.get(alias.get(c, c))
        value = F.col(f"`{own}`") if own else F.lit(None)
        if kind == "double":
            value = value.cast("string").try_cast("double") * scale
        elif kind == "bigint":
            value = value.cast("string").try_cast("bigint")
        out.append(value.cast(kind).alias(c))
    return rows.select(*out)


def read_snapshot(spark: SparkSession, path: str, form: str | None = None, time_unit: str = "ms") -> DataFrame:
    """time_unit: ms (what the view reports) or s."""
    scale = {"ms": 1.0, "s": 1000.0}[time_unit]
    lines = spark.read.text(path)
    if form is None:
        head = lines.filter(F.trim("value") != "").limit(1).collect()
        form = form_of(head[0][0]) if head else "csv"
    if form == "json":
        # allowed to span lines; a wrapper's rows are taken out
        rows = spark.read.option("multiLine", True).json(path)
        if "rows" in rows.columns and rows.schema["rows"].dataType.typeName() == "array":
            rows = rows.select(F.explode("rows").alias("r")).select("r.*")
        return typed(rows, scale)
    if form == "csv":
        return typed(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), scale)
    parts = F.split("value", r"\|")
    table = lines.filter(F.col("value").contains("|") & ~F.col("value").rlike(r"^[\s+|-]*$")).select(F.transform(parts, lambda x: F.trim(x)).alias("c"))
    names = next(iter(table.limit(1).collect()), None)
    if names is None:
        return spark.createDataFrame([], SCHEMA)
    head = [x.lower() for x in names["c"]]
    rows = table.filter(F.col("c") != F.array(*[F.lit(x) for x in names["c"]])).select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(head)])
    return typed(rows, scale)


def exported(snapshot: DataFrame, top: int = 100) -> str:
    """The first `top` statements as JSON."""
    rows = snapshot.orderBy(F.desc("total_exec_time"), "query").limit(top)
    return json.dumps([json.loads(r[0]) for r in rows.select(F.to_json(F.struct(*[F.col(c) for c in COLUMNS]))).collect()])
