"""Reports: JSON, Markdown, HTML and plain text over collected top rows, and the summary line's exit code.

What is collected here is limited by the reports' own row caps."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each section.
CAPS = {"findings": 100, "slow_queries": 100, "errors": 50, "locks": 30, "autovacuum": 50, "temporary_files": 20, "plans": 20, "connections": 15, "timeline": 200}


def health(found: DataFrame) -> DataFrame:
    """exit_code 2 with a critical finding, 1 with a high one, else 0; and the numbers of findings."""
    is_ = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(
        F.when(is_("CRITICAL") > 0, 2).when(is_("HIGH") > 0, 1).otherwise(0).alias("exit_code"), F.count(F.lit(1)).alias("findings"), is_("CRITICAL").alias("critical")
    )


def sections(result: dict[str, DataFrame], caps: dict[str, int] | None = None) -> dict[str, list[dict]]:
    """The rows that a report shows. result: frames by section, each in its order."""
    caps = CAPS | (caps or {})
    return {name: [json.loads(r[0]) for r in df.limit(caps.get(name, 100)).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).collect()] for name, df in result.items()}


def as_json(parts: dict[str, list[dict]]) -> str:
    return json.dumps(parts, indent=2, sort_keys=True, default=str)


def _columns(rows: list[dict]) -> list[str]:
    return list(dict.fromkeys(k for r in rows for k in r))


def _cell(x) -> str:
    return "" if x is None else f"{x:.2f}" if isinstance(x, float) else json.dumps(x) if isinstance(x, list | dict) else str(x)


def as_markdown(parts: dict[str, list[dict]], title: str = "Log analysis") -> str:
    out = [f"# {title}", ""]
    for name, rows in parts.items():
        out += [f"## {name.replace('_', ' ').capitalize()}", ""]
        if not rows:
            out += ["Nothing found.", ""]
            continue
        columns = _columns(rows)
        clean = lambda x: _cell(x).replace("|", "\\|").replace("\n", " ")
        out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(clean(r.get(c)) for c in columns) + " |" for r in rows], ""]
    return "\n".join(out)


def as_text(parts: dict[str, list[dict]]) -> str:
    out = []
    for name, rows in parts.items():
        out.append(f"== {name.replace('_', ' ')} ({len(rows)})")
        out += ["  " + ", ".join(f"{k}={_cell(v)}" for k, v in r.items()) for r in rows]
    return "\n".join(out) + "\n"


def _bars(rows: list[dict]) -> str:
    """The first numeric column as bars against the first text column."""
    if not rows:
        return ""
    label = next((k for k, v in rows[0].items() if isinstance(v, str)), None)
    value = next((k for k, v in rows[0].items() if isinstance(v, int | float) and not isinstance(v, bool)), None)
    if not label or not value:
        return ""
    most = max(abs(float(r.get(value) or 0)) for r in rows) or 1.0
    return "".join(f'<div class="bar"><i style="width:{100 * abs(float(r.get(value) or 0)) / most:.1f}%"></i><span>{html.escape(str(r.get(label))[:80])}: {_cell(r.get(value))}</span></div>' for r in rows[:15])


def as_html(parts: dict[str, list[dict]], title: str = "Log analysis") -> str:
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;vertical-align:top}.bar{position:relative;height:1.4em;margin:2px;max-width:60em}.bar i{position:absolute;height:100%;background:#cde}.bar span{position:relative}"
    body = []
    for name, rows in parts.items():
        columns = _columns(rows)
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        lines = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(r.get(c)))}</td>" for c in columns) + "</tr>" for r in rows)
        body.append(f'<section id="{html.escape(name)}"><h2>{html.escape(name.replace("_", " ").capitalize())}</h2>{_bars(rows)}<table><tr>{head}</tr>{lines}</table></section>')
    links = " ".join(f'<a href="#{html.escape(n)}">{html.escape(n.replace("_", " "))}</a>' for n in parts)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1><nav>{links}</nav>{''.join(body)}</body></html>"


def render(parts: dict[str, list[dict]], kind: str = "text", title: str = "Log analysis") -> str:
    forms = {"json": lambda: as_json(parts), "markdown": lambda: as_markdown(parts, title), "html": lambda: as_html(parts, title), "text": lambda: as_text(parts)}
    if kind not in forms:
        raise ValueError(f"unknown report form {kind}; one of {', '.join(forms)}")
    return forms[kind]()
