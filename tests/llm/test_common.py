import random

import numpy as np

from sawmill.llm import common as C


def test_word_hashes_are_those_of_the_words(monkeypatch):
    rng = random.Random(0)
    words = ["".join(rng.choice("abcXYZé☃_-\x85\xa0") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = "".join(w + rng.choice([" ", "\n", "\t\r", "\x0b", "  \x0c"]) for w in words)
    for t in (text, " " + text.strip(), text.strip()):
        got = C.word_hashes(t.encode())
        assert len(got) == len(words)
        by = {}
        for w, h in zip(words, got.tolist(), strict=True):
            by.setdefault(w.encode().lower(), set()).add(h)
        assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by)
    assert not len(C.word_hashes(b"")) and not len(C.word_hashes(None)) and not len(C.word_hashes(b" \n "))
    whole = C.word_hashes(text.encode())
    monkeypatch.setattr(C, "_PIECE", 7)
    assert np.array_equal(C.word_hashes(text.encode()), whole) and len(C.word_hashes(b"x" * 100)) == 1


def test_scratch_tables_go(spark):
    import os

    with C.scratch(spark) as keep:
        a, b = C.written(spark.range(3), "a"), C.written(spark.range(4), "b")
        with C.scratch(spark) as inner:
            c, d = C.written(spark.range(5), "c"), C.written(spark.range(6), "d")
            inner(c)
        keep(b)
        there = [os.path.exists(x._written_at.removeprefix("file://")) for x in (a, b, c, d)]
    assert there == [True, True, True, False]
    assert [os.path.exists(x._written_at.removeprefix("file://")) for x in (a, b, c)] == [False, True, False] and b.count() == 4
