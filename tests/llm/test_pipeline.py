import os

import pytest

import corpus_pipeline as C
from sawmill.llm import common, subword_sampling


def test_stages(spark, docs, tmp_path):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    now, ids = common.table(spark, str(tmp_path), "documents"), {}
    for name, stage in C.STAGES[:-1]:
        out = common.written(stage(spark, now, str(tmp_path)), name)
        assert out.columns == rows.columns
        ids[name] = {r["doc_id"] for r in out.collect()}
        now = out
    assert {1, 2, 3, 8, 9, 12} <= ids["quality_rules"] and not ids["quality_rules"] & {5, 6, 10, 11, 13}
    assert ids["near_dedup"] == ids["quality_rules"] - {2, 3}
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert ids["mixing"] <= ids["substring_dedup"] <= ids["near_dedup"]
    # Worked out plainly from the stage's input: of the two texts with the passage one keeps it, whole; the other has what stood around it.
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    passage = before[8].split("\n")[1]
    assert passage in before[9] and sorted(passage in texts[i] for i in (8, 9)) == [False, True]
    cut = next(i for i in (8, 9) if passage not in texts[i])
    assert texts[cut].split() == before[cut].replace(passage, "").split()
    assert all(texts[i] == before[i] for i in texts if i != cut and not set(before[i].split("\n")) - set(texts[i].split("\n")))
    if os.path.exists(subword_sampling.MODEL):
        out = C.run(spark, str(tmp_path))
        got = {r["doc_id"]: r["decoded"] for r in subword_sampling.decode(out).collect()}
        assert got == texts


def test_empty(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    now = common.table(spark, str(tmp_path), "documents")
    for name, stage in C.STAGES:
        if name == "sentencepiece" and not os.path.exists(subword_sampling.MODEL):
            pytest.skip("the public vocabulary is not installed")
        now = common.written(stage(spark, now, str(tmp_path)), name)
        assert now.count() == 0
