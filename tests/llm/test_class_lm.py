import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sawmill.llm import class_lm as B


def test_counts_base_and_gain(spark):
    rng = random.Random(1)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(x for _ in range(30) for x in (rng.choice(nouns), rng.choice(verbs)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "unseen WORDS n1"), (503, "N1 v1"), (503, "N1 v1"), (None, "n2 " * 5000)]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    held = F.coalesce((F.col("doc_id") % 7 == 2) | (F.col("doc_id") == 502), F.lit(False))
    train = [t for i, t in rows if i is None or (i % 7 != 2 and i != 502)]
    c = Counter(w for t in train for w in (t or "").lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    for dictionary in (10**6, 20, 0):
        got = B.score(d, held, k=6, units=50, dictionary=dictionary).collect()
        assert len(got) == len(rows)
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r)
        for i, t in rows:
            w = (t or "").lower().split()
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
            r = by[i][0]
            assert r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(c[x] > 0 for x in w) + 1 and r["train_tokens"] == n
            assert abs(r["base_score"] - base) < 1e-6 and r["score"] <= 0
        held_rows = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
        if dictionary:
            assert all(r["score"] > r["base_score"] for r in held_rows)


@pytest.mark.parametrize("units, dictionary", [(1000, 1000), (7, 1000), (7, 20), (0, 0)])
def test_scores_and_probabilities_by_brute_force(spark, monkeypatch, units, dictionary):
    """The classes come from the model; counts, probabilities and scores are worked out here word by word."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(int(rng.random() ** 3 * 9)) for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, "A0 never a0 Seen never")]
    own: dict = {}
    tagged = B.tagged

    def caught(encoded, others, classes, logs, unseen):
        words = [r["word"] for r in others.collect()]
        own.update({r["word"]: r["class"] for r in others.collect()}, unseen=unseen)
        known = caught.known
        own.update({w: int(c) for w, c in zip(known, classes, strict=True)})
        assert not set(words) & set(known[: min(units, len(known))])
        return tagged(encoded, others, classes, logs, unseen)

    frequent = B.frequent

    def first(vocabulary, most):
        caught.known, counts = frequent(vocabulary, most)
        return caught.known, counts

    monkeypatch.setattr(B, "tagged", caught)
    monkeypatch.setattr(B, "frequent", first)
    k, pull = 4, 10.0
    got = {r["doc_id"]: r for r in B.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 2, k=k, units=units, dictionary=dictionary, pull=pull).collect()}
    unseen = own.pop("unseen")
    train = [(t or "").lower().encode().split() for i, t in rows if i % 5 != 2]
    count = Counter(w for t in train for w in t)
    assert set(own) == set(count)
    cls = lambda w: own.get(w, unseen)
    weight = [sum(n + 1 for w, n in count.items() if own[w] == c) + (c == unseen) for c in range(k)] + [len(train) + 2]
    pairs = Counter(x for t in train for x in zip([k, *map(cls, t)], [*map(cls, t), k], strict=True))
    move = lambda a, b: (pairs[a, b] + pull * weight[b] / sum(weight)) / (sum(pairs[a, x] for x in range(k + 1)) + pull)
    emit = lambda w: (count[w] + 1) / weight[cls(w)]
    for before in range(k + 1):
        assert abs(sum(move(before, own[w]) * emit(w) for w in count) + move(before, unseen) / weight[unseen] + move(before, k) - 1) < 1e-9
    for i, t in rows:
        w = (t or "").lower().encode().split()
        c = [k, *map(cls, w), k]
        want = sum(math.log10(move(a, b)) for a, b in zip(c, c[1:], strict=False)) + sum(math.log10(emit(x)) for x in w)
        assert abs(got[i]["score"] - want) < 1e-6


def test_exchange_raises_the_likelihood(spark, monkeypatch):
    """Gains are those of the class bigram likelihood worked out from word pairs, rounds never lower it, and true classes are found."""
    rng = random.Random(7)
    true = [rng.randrange(3) for _ in range(45)]
    by = [[w for w in range(45) if true[w] == c] for c in range(3)]
    texts = []
    for _ in range(400):
        c, t = rng.randrange(3), []
        for _ in range(12):
            t.append(rng.choice(by[c]))
            c = (c + 1) % 3 if rng.random() < 0.9 else rng.randrange(3)
        texts.append(t)
    known = [f"w{i:02}".encode() for i in range(45)]
    rows = spark.createDataFrame([(i, False, " ".join(known[w].decode() for w in t).encode()) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text binary")
    train = B.encoded(rows, known)
    classes = np.minimum(np.arange(45), 2)
    counts = B.contexts(train, classes, 3)
    words = np.zeros((46, 46))
    for t in texts:
        for a, b in zip([45, *t], [*t, 45], strict=True):
            words[a, b] += 1

    def of(c):
        onto = np.zeros((46, 5))
        onto[np.arange(46), [*c, 4]] = 1
        return B.likelihood(onto.T @ words @ onto)

    assert abs(of(classes) - B.likelihood(counts[3])) < 1e-6 and counts[2].sum() == np.trace(words[:45, :45])
    for w in (0, 3, 44):  # the gain of one move, alone
        one = [x.copy() for x in counts]
        for i in (0, 1, 2):
            one[i][np.arange(45) != w] = 0
        moved, gain = B.exchange(*one, classes, 3, 1)
        assert abs(of(moved) - of(classes) - gain[w]) < 1e-6
    monkeypatch.setattr(B, "seeded", lambda train, n, k: classes)  # from a poor beginning
    got, pairs, best = B.cluster(train, 45, 3, 6)
    assert all(a < b for a, b in zip(best, best[1:], strict=False)) and len(best) > 1 and abs(best[-1] - of(got)) < 1e-6
    monkeypatch.undo()
    got, pairs, best = B.cluster(train, 45, 3, 6)
    assert best[-1] >= of(np.array(true)) - 1e-6 and sum(Counter(true[w] for w in range(45) if got[w] == c).most_common(1)[0][1] for c in set(got.tolist())) >= 43


def test_frequent_is_bounded(spark):
    words = spark.createDataFrame([(f"w{i}".encode(), n) for i, n in enumerate([100, 90, 5, 5, 5, 1, 1])] + [(b"x" * 300, 1000)], "word binary, n long")
    assert B.frequent(words, 5)[0] == [b"w0", b"w1", b"w2", b"w3", b"w4"] and B.frequent(words, 4)[0] == [b"w0", b"w1"] and B.frequent(words, 0)[0] == []


def test_empty(none, docs):
    assert B.score(none, F.lit(False), k=2, units=4).count() == 0
    r = B.score(docs, F.lit(True), k=2, units=4).collect()
    assert all(x["n_known"] == 0 and x["train_tokens"] == 0 and np.isfinite(x["score"]) for x in r)


@pytest.mark.parametrize("text, n", [("a  b\tc\x0b\x0c\r\nd", 4), ("é\xa0x \x85", 2)])
def test_words(text, n):
    assert len(text.encode().lower().split()) == n
