"""Operator 6: quality rules with cross-document line frequency.

Every line is normalised (A-Z to lower case, runs of white space to one blank) and hashed. For each host
(source) the distinct documents that hold a line are counted; documents are distinct if their texts are, so
copies of one document count once. A line is above the limit if more than max(min_docs, share x the
host's distinct documents) hold it. Such lines are removed, and a document that loses more than half of
its words this way is depleted and rejected, as is one that fails the word count or repetition rules.

Scale: a task sees its texts once and gives hashes; counting shuffles 24 bytes a line after
deduplication, and hot lines meet as partial counts. The lines above the limit are broadcast only if
they are at most `broadcast_lines`, else joined by shuffle.

Defined cases: null text has no words and fails the base rules; null sources form one host; repeated rows
are judged alike; a line without a word is never counted or removed; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import same_text_key, small_batches, table, written

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, sizes array<int>"


def repeated(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    put = ids.setdefault
    x = np.array([put(w, len(ids)) for w in words], dtype=np.int64)
    pairs = x[:-1] * len(ids) + x[1:]
    if len(ids) > 1_000_000:  # three factors would not fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(ids) + x[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def line_key(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def features(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        if own := line.lower().split():
            dup += line in seen
            seen.add(line)
            key = line_key(own)
            lines[key] = lines.get(key, 0) + len(own)
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeated(words), list(lines), list(lines.values()))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        got = pd.DataFrame([features(t) for t in batch["text"]], columns=names)
        yield pd.concat([batch.drop(columns=["text"]).reset_index(drop=True), got], axis=1)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One narrow row for each document, written to the shared folder: rid, id, key, host, text_key, features."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.select("doc_id", "host", *same_text_key("doc_id", "host", "text"), F.xxhash64("text").alias("text_key"), "text")
    kind = keyed.drop("text").schema.simpleString()[len("struct<") : -1]
    return written(keyed.mapInPandas(_measure, f"{kind}, {FEATURES}").withColumn("rid", F.monotonically_increasing_id()), "quality")


def common_lines(rows: DataFrame, min_docs: int, share: float) -> DataFrame:
    """host, line: lines above their host's limit."""
    held = rows.select("host", "text_key", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    hosts = rows.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    both = held.withColumnRenamed("host", "h").join(hosts, F.col("h").eqNullSafe(F.col("host")))
    return both.filter(F.col("n") > share * F.col("docs")).select("host", "line")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, share: float = 0.10, max_lost: float = 0.5, broadcast_lines: int = 500_000) -> DataFrame:
    """All rows' features with removed_words, removed (line hashes), base_failed and kept; keyed by k1, k2."""
    rows = measured(docs, id_col, text_col, host_col)
    common = written(common_lines(rows, min_docs, share), "common-lines").withColumnRenamed("host", "h").withColumnRenamed("line", "common")
    if common.limit(broadcast_lines + 1).count() <= broadcast_lines:
        common = F.broadcast(common)
    own = rows.select("rid", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x")).select("rid", "host", "x.lines", "x.sizes")
    lost = own.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("lines") == F.col("common"))).groupBy("rid").agg(F.sum("sizes").alias("removed_words"), F.collect_list("lines").alias("removed"))
    out = rows.join(lost, "rid", "left").withColumns({"removed_words": F.coalesce("removed_words", F.lit(0)).cast("long"), "removed": F.coalesce("removed", F.array().cast("array<long>"))})
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_lost * F.col("n_words")))


def clean(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, without the lines above the limits; the columns of docs. A column n_chars follows the text."""
    host = options.get("host_col", "source")
    verdict = judge(docs, text_col=text_col, **options).filter("kept").select("k1", "k2", "removed").dropDuplicates(["k1", "k2"])
    keyed = docs.select("*", *same_text_key_of(docs, options.get("id_col", "doc_id"), host, text_col))
    kept = keyed.join(verdict.withColumnRenamed("k1", "v1").withColumnRenamed("k2", "v2"), (F.col("__k1") == F.col("v1")) & (F.col("__k2") == F.col("v2"))).drop("v1", "v2", "__k1", "__k2")
    without_lines = F.pandas_udf(_without_lines, StringType())
    fixed = F.when(F.size("removed") > 0, without_lines(F.col(text_col).cast("string"), F.col("removed"))).otherwise(F.col(text_col))
    out = kept.withColumn(text_col, fixed).drop("removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def same_text_key_of(docs: DataFrame, id_col: str, host_col: str, text_col: str) -> list:
    own = [F.col(id_col), F.col(host_col).cast("string"), F.col(text_col).cast("string")]
    return [F.xxhash64(*own).alias("__k1"), F.xxhash64(F.lit(7), *own).alias("__k2")]


def _without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    def one(t, r):
        if t is None or r is None or not len(r):
            return t
        gone = set(r)
        return "\n".join(x for x in t.split("\n") if not (own := x.encode("utf-8", "surrogatepass").lower().split()) or line_key(own) not in gone)

    return pd.Series([one(t, r) for t, r in zip(text, removed, strict=True)], dtype=object)


def op6(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


OP6_SQL = r"""with docs as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, text as raw,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words
  from documents
), windows as (
  select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
  from (select rid, words, unnest(range(1, len(words) - 1)) as i from docs)
), twice as (
  select rid, i from (select *, count(*) over (partition by rid, a, b, c) as n from windows) where n > 1
), covered as (
  select rid, count(distinct i + j) as n_repeat_words from twice, (select unnest([0, 1, 2]) as j) group by rid
), lines as (
  select rid, source, raw, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as at from docs
), wordy as (
  select *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n
  from lines where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0
), dups as (
  select rid, count(*) - count(distinct line) as n_dup_lines from wordy group by rid
), hosts as (
  select source, count(distinct raw) + max((raw is null)::int) as docs from docs group by source
), common as (
  select w.source, w.norm from wordy w join hosts h on w.source is not distinct from h.source
  group by w.source, w.norm, h.docs having count(distinct w.raw) > 20 and count(distinct w.raw) > 0.10 * h.docs
), lost as (
  select w.rid, sum(w.n) as removed_words from wordy w join common c on w.source is not distinct from c.source and w.norm = c.norm group by w.rid
), judged as (
  select d.rid, d.doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         coalesce(removed_words, 0)::bigint as removed_words
  from docs d left join dups using (rid) left join covered using (rid) left join lost using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and removed_words <= 0.5 * n_words as kept
from judged"""
