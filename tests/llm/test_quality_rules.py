import re
from collections import Counter

import duckdb

from sawmill.llm import quality_rules as Q

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_features(texts):
    for _, t, *_ in texts:
        assert Q.features(t)[:5] == brute(t)
    assert Q.features("a b c a b c\na b c a b c\n \n")[:5] == (12, 12, 0, 1, 12)


def test_against_sql(spark, docs, texts):
    line = "common line of this host"
    rows = list(texts) + [(100 + i, f"{line}\n" + " ".join(f"u{i}x{j}" for j in range(60 if i % 2 else 4)), "en", "a") for i in range(30)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, null)", [list(r) for r in rows])
    cur = con.execute(Q.OP6_SQL)
    names = [c[0] for c in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()), key=str)
    d = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in Q.judge(d).select(*COLUMNS).collect()), key=str)
    assert got == want and any(r[8] for r in got)
    assert sorted((tuple(r) for r in Q.judge(d, broadcast_lines=0).select(*COLUMNS).collect()), key=str) == want
    kept = Q.clean(d)
    assert kept.columns == d.columns and kept.count() == sum(r[7] for r in want)
    assert not [r for r in kept.collect() if line in r["text"].split("\n")]


def test_copies_count_once(spark):
    text = "\n".join(f"line {i} " + " ".join(f"w{i}_{j}" for j in range(9)) for i in range(12))
    d = spark.createDataFrame([(i, text, "a") for i in range(60)], "doc_id long, text string, source string")
    assert Q.judge(d).filter("kept").count() == 60


def test_depleted(spark):
    lines = [" ".join(f"s{i}{c}" for c in "abcdef") for i in range(20)]
    d = spark.createDataFrame([(i, "\n".join(lines) + f"\nown{i}", "a") for i in range(40)], "doc_id long, text string, source string")
    got = Q.judge(d).collect()
    assert all(not r["kept"] and not r["base_failed"] and r["removed_words"] == 120 for r in got)


def test_empty(none):
    assert Q.judge(none).count() == 0 and Q.clean(none).count() == 0
