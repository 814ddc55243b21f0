"""The events table as log entries in plain SQL, and SQL forms of the scalar functions, for checking queries."""

from __future__ import annotations

from sawmill.functions import patterns as P
from sawmill.sources.events import LEVEL, MESSAGE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def extract(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, {group}), '')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"


def first_match(text: str, choices, otherwise: str | None) -> str:
    return "case " + " ".join(f"when {has(text, p)} then {quoted(n)}" for n, p in choices) + f" else {quoted(otherwise) if otherwise else 'null'} end"


def keywords(text: str) -> str:
    out = text
    for word in [*P.KEYWORDS, *P.KEYWORD_PAIRS]:
        out = replace(out, rf"(?i)\b{word}\b", word)
    return out


def fingerprint(text: str) -> str:
    q = f"trim({replace(replace(f'trim({text})', r'[;\s]+$', ''), r'\s+', ' ')})"
    for pattern, by in ((P.STRING_LITERAL, "?"), (r"\$\d+", "?"), (P.NUMBER, "?"), (r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)")):
        q = replace(q, pattern, by)
    q = keywords(q)
    return f"(select case when length(q) > 500 then substr(q, 1, 483) || '#' || substr(md5(q), 1, 16) else q end from (select {q} as q))"


def pattern_key(message: str) -> str:
    m = message
    for tail in P.MESSAGE_TAILS:
        m = f"case when instr({m}, {quoted(tail)}) > 1 then substr({m}, 1, instr({m}, {quoted(tail)}) - 1) else {m} end" if tail == " DETAIL:" else m
    for pattern, by in ((P.STRING_LITERAL, "?"), (P.NUMBER, "N"), (r'"[^"]{1,80}"', '"X"'), (r"Key \([^)]+\)=\([^)]*\)", "Key (col)=(val)"), (r"\s+", " ")):
        m = replace(m, pattern, by)
    return f"substr(trim({m}), 1, 200)"


ENTRIES = f"""base as (
  select event_id as seq, ts, user_id as u, event_type, cast(value as decimal(18,2)) as v, cast(json_extract_string(props, '$.k') as bigint) as k from events
), raw as (
  select seq, ts, u as pid, {LEVEL} as log_level, 'u' || (u % 20)::varchar as "user", 'db' || (u % 5)::varchar as database, 'app' || (k % 3)::varchar as application,
         '10.0.0.' || (k % 8)::varchar as host, {MESSAGE} as message
  from base
), parsed as (
  select *, {extract("message", P.DURATION)}::double as duration_ms,
         coalesce({extract("message", P.DURATION_STATEMENT, 2)}, {extract("message", P.STATEMENT_ONLY)}, {extract("message", P.PHASE_STATEMENT)}) as query,
         {first_match("message", P.PHASES, None)} as phase
  from raw
), e as (
  select *, coalesce(query, message) as statement, {first_match("coalesce(query, message)", P.TYPES, "other")} as query_type from parsed
)"""


def over_entries(select: str, *ctes: str) -> str:
    return "with " + ",\n".join([ENTRIES, *ctes]) + "\n" + select
