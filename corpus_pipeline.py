"""A training corpus in five stages. Each stage's table is written as Parquet to the shared folder and reread.

Quality rules drop documents and take lines above the limits out of the rest; near-duplicate groups keep
their document with the smallest id; passages that stand in several documents stay in one; sources are mixed
to their target weights, repeated documents being repeated rows; the mix is encoded as sampled subwords.

Defined cases: null, empty and wordless texts fail the quality rules and go, so later stages see words; a null
source is a source and a null doc_id a document of its own, which never stands for a group that has an id; of equal
texts the smallest doc_id stays (the first of rows that repeat id and text), and of texts that share a passage the one with the least
text hash keeps it; very long texts are read whole; empty tables give empty tables; the columns are those of
documents up to the last stage, whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawmill.llm import mixing, near_dedup, quality_rules, substring_dedup, subword_sampling
from sawmill.llm.common import discard, scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers share their executor with what earlier stages left in memory: smaller tables, equal results.
    return subword_sampling.encode(docs, cached=120_000)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("mixing", mix),
    ("sentencepiece", subwords),
]

#: Sampled encodings are drawn from hashes that SQL does not have; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder goes once the next one's table is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            now = written(stage(spark, docs, sf_dir), name)
            keep(now)
        if before is not None:
            discard(before)
        docs = before = now
    return STAGES[-1][1](spark, docs, sf_dir)
