"""Configuration and rule packs from YAML, TOML or JSON, and saved analyses.

YAML is read by a small reader of its own: nested mappings and lists by indentation, inline lists, quoted and
plain scalars, comments. ${NAME} stands for an environment variable."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.plans.rules import CustomRule, RulePack

VERSION = 1


def scalar(text: str):
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    if t.startswith("[") and t.endswith("]"):
        return [scalar(x) for x in re.split(r",(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", t[1:-1]) if x.strip()]
    if t == "{}":
        return {}
    low = t.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            continue
    return t


def yaml(text: str):
    """Mappings, lists and scalars."""
    lines = []
    for raw in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", raw) if not re.search(r"[\"'].*#.*[\"']", raw) else raw
        if bare.strip() and bare.strip() != "---":
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, depth: int):
        if at >= len(lines):
            return None, at
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("-"):
                rest = lines[at][1][1:].strip()
                inner = depth + len(lines[at][1]) - len(rest) if rest else depth + 2
                if not rest:
                    value, at = block(at + 1, lines[at + 1][0])
                elif re.match(r"^[\w.\-]+:(\s|$)", rest):
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                else:
                    value, at = scalar(rest), at + 1
                out.append(value)
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == depth and not lines[at][1].startswith("- "):
            key, _, rest = lines[at][1].partition(":")
            key = key.strip().strip("\"'")
            if rest.strip():
                out[key], at = scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > depth or (lines[at + 1][0] == depth and lines[at + 1][1].startswith("-"))):
                out[key], at = block(at + 1, lines[at + 1][0])
            else:
                out[key], at = None, at + 1
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def substituted(x, env: dict | None = None):
    """${NAME} in strings; unknown names become empty."""
    env = os.environ if env is None else env
    if isinstance(x, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], ""), x)
    if isinstance(x, dict):
        return {k: substituted(v, env) for k, v in x.items()}
    return [substituted(v, env) for v in x] if isinstance(x, list) else x


def parsed(text: str, name: str) -> dict:
    if name.endswith(".toml"):
        return tomllib.loads(text)
    return json.loads(text) if name.endswith(".json") else (yaml(text) or {})


def load(path: str) -> dict:
    return substituted(parsed(Path(path).read_text(encoding="utf-8"), path))


def discover_config(start: str = ".", names: tuple[str, ...] = ("sawmill.yaml", "sawmill.yml", "sawmill.toml")) -> str | None:
    """The first configuration found here, in the home folder or in its .config."""
    for folder in (Path(start), Path.home(), Path.home() / ".config"):
        for n in names:
            if (folder / n).is_file():
                return str(folder / n)
    return None


def rule_pack(data: dict) -> RulePack:
    ignore = data.get("ignore_patterns") or {}
    custom = [
        CustomRule(c["rule_id"], c["condition"], str(c.get("severity", "MEDIUM")).upper(), c.get("title", ""), c.get("description", ""), list(c.get("recommendations") or []), bool(c.get("enabled", True)))
        for c in data.get("custom_rules") or []
    ]
    return RulePack(data.get("name", ""), {k: str(v).upper() for k, v in (data.get("severity_overrides") or {}).items()}, list(ignore.get("errors") or []), list(ignore.get("queries") or []), custom)


EXAMPLE_PACK = """name: example
severity_overrides:
  OOM_KILLER: HIGH
ignore_patterns:
  errors:
    - "duplicate key"
  queries: []
custom_rules:
  - rule_id: MANY_ERRORS
    severity: HIGH
    title: More errors than the service promises
    condition: "errors > 1000 and errors > 0.01 * entries"
    recommendations: ["Look at the error patterns"]
    enabled: true
"""


def save(result: dict[str, DataFrame], path: str, label: str = "") -> None:
    """Every frame as Parquet below the path, and a manifest."""
    spark = next(iter(result.values())).sparkSession
    for name, df in result.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"version": VERSION, "label": label, "created_at": dt.datetime.now(dt.UTC).isoformat(), "frames": sorted(result)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def saved(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The frames and the manifest of save(); types are as they were."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").filter(F.col("value") != "").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in manifest["frames"]}, manifest
