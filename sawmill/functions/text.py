"""Scalar functions over log text, all as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return found(text, pattern, group).try_cast("double")


def whole(text: Column, pattern: str, group: int = 1) -> Column:
    return found(text, pattern, group).try_cast("double").try_cast("long")


def first_match(text: Column, choices, otherwise: str | None) -> Column:
    """The name of the first (name, pattern) that matches."""
    out = F.lit(otherwise)
    for name, pattern in reversed(list(choices)):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def level(text: Column) -> Column:
    """Canonical level: upper case, DEBUG1 to DEBUG5 folded, unknown ones LOG."""
    plain = F.regexp_replace(F.upper(text), r"\d+$", "")
    return F.when(plain.isin(*P.LEVELS), plain).otherwise("LOG")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _keywords(text: Column) -> Column:
    """Keywords in upper case, in one pass over the words and one for each pair."""
    words = F.transform(F.split(text, r"(?<=\W)|(?=\W)"), lambda w: F.when(F.upper(w).isin(*P.KEYWORDS), F.upper(w)).otherwise(w))
    return reduce(lambda t, pair: F.regexp_replace(t, rf"(?i)\b{pair}\b", pair), P.KEYWORD_PAIRS, F.array_join(words, ""))


def _statement(text: Column) -> Column:
    return collapse(F.regexp_replace(F.trim(text), r"[;\s]+$", ""))


def fingerprint(text: Column) -> Column:
    """Canonical statement: literals and numbered parameters become ?, lists of them (?), keywords upper case.

    Statements that differ in literals or list lengths share it, and so do logged statements and those of a
    statistics snapshot, which come with $1, $2, ... in place of literals."""
    q = F.regexp_replace(_statement(text), P.STRING_LITERAL, "?")
    q = F.regexp_replace(q, r"\$\d+", "?")
    q = F.regexp_replace(q, P.NUMBER, "?")
    q = F.regexp_replace(q, r"\(\s*\?(?:\s*,\s*\?)+\s*\)", "(?)")
    return F.substring(_keywords(q), 1, 2000)


def _numbered(text: Column, pattern: str, base: Column) -> tuple[Column, Column]:
    """Matches replaced by $base, $base + 1, ...; and the base for what follows."""
    parts = F.split(F.regexp_replace(text, pattern, "\u0001"), "\u0001")
    n = F.size(parts) - 1
    marked = F.transform(parts, lambda x, i: F.when(i < n, F.concat(x, F.lit("$"), (i + base).cast("string"))).otherwise(x))
    return F.array_join(marked, ""), base + n


def fingerprint_numbered(text: Column) -> Column:
    """The numbered form: strings and then numbers become $1, $2, ... (digits of placed parameters count as numbers
    again), a list of parameters becomes ($n) with the next free n."""
    q, base = _numbered(_statement(text), P.STRING_LITERAL, F.lit(1))
    q, base = _numbered(q, P.NUMBER, base)
    parts = F.split(F.regexp_replace(q, r"\(\s*\$\d+(?:\s*,\s*\$\d+)+\s*\)", "\u0001"), "\u0001")
    q = F.call_function("array_join", parts, F.concat(F.lit("($"), base.cast("string"), F.lit(")")))
    return F.substring(_keywords(q), 1, 2000)


def anonymize(text: Column) -> Column:
    """Text without its literals: strings become '?', numbers that are no parameters 0."""
    q = F.regexp_replace(text, P.STRING_LITERAL, "'?'")
    return F.regexp_replace(q, r"(^|[^\w$.])\d+(?:\.\d+)?\b", "$10")


def pattern_key(message: Column) -> Column:
    """What messages of one kind share: tails cut off, literals, numbers and quoted names folded."""
    m = message
    for tail in P.MESSAGE_TAILS:
        at = F.instr(m, tail)
        m = F.when(at > 1, F.substring(m, F.lit(1), at - 1)).otherwise(m)
    m = F.regexp_replace(m, P.STRING_LITERAL, "?")
    m = F.regexp_replace(m, P.NUMBER, "N")
    m = F.regexp_replace(m, r'"[^"]{1,80}"', '"X"')
    m = F.regexp_replace(m, r"Key \([^)]+\)=\([^)]*\)", "Key (col)=(val)")
    return F.substring(collapse(m), 1, 200)


def category(message: Column) -> Column:
    return first_match(message, P.CATEGORIES, "unknown")


def query_type(text: Column) -> Column:
    return F.when(text.isNotNull(), first_match(text, P.TYPES, "other"))


def phase(message: Column) -> Column:
    return first_match(message, P.PHASES, None)


def session_bucket(ms: Column) -> Column:
    out = F.lit(P.LAST_SESSION_BUCKET)
    for bound, label in reversed(P.SESSION_BUCKETS):
        out = F.when(ms < bound, label).otherwise(out)
    return F.when(ms.isNotNull(), out)


def session_ms(message: Column) -> Column:
    """Milliseconds of `session time: H:MM:SS.mmm`."""
    h, m, s = (number(message, P.SESSION_TIME, i) for i in (1, 2, 3))
    return (h * 3600 + m * 60 + s) * 1000


def ratio(a: Column, b: Column, digits: int | None = None, percent: bool = False) -> Column:
    """a / b, null where b is 0 or null; rounded half to even if digits are given."""
    out = F.when((b != 0) & b.isNotNull(), a / b * (100 if percent else 1))
    return out if digits is None else F.bround(out, digits)


def exact_sum(x: Column) -> Column:
    """Sum of a double column, the same in any order of rows: six decimals are summed exactly, what a value has beyond them as a double."""
    part = F.when(x.isNotNull(), F.coalesce(x.try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)")))
    return F.sum(part).cast("double") + F.sum(x - part.cast("double"))


def hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:00")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
