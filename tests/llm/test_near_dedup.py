import itertools
import random

import numpy as np
import pytest

from sawmill.llm import near_dedup as N
from sawmill.llm.components import components


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def brute(rows, width, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [own] * (own is not None)
        least = min(ids, default=None)
        out.append((own, len(sets[i]), least, own == least))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(docs, texts, width):
    assert got(N.near_duplicates(docs, width=width)) == brute([(i, t) for i, t, *_ in texts], width)


def family(rng, n, changes, words=60):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_large_torn_groups(spark):
    """Copies near the threshold: buckets hold several components, and some are above the size that goes to blocks."""
    rng = random.Random(5)
    rows = list(enumerate(family(rng, 90, 1) + family(rng, 60, 2) + family(rng, 40, 3) + [" ".join(f"z{i}_{j}" for j in range(40)) for i in range(20)]))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert len({r[2] for r in want}) > 25
    assert got(N.near_duplicates(d, width=4)) == want
    assert got(N.near_duplicates(d, width=4, block=8, broadcast_keys=0)) == want


def test_blocks_find_what_joins():
    import pandas as pd

    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64))
    sets = [base, np.unique(np.concatenate((base[:95], rng.integers(0, 1 << 60, 3).astype(np.uint64)))), np.unique(rng.integers(0, 1 << 60, 100).astype(np.uint64))]
    own = pd.DataFrame({"side": 0, "same": True, "sid": [b"a", b"b", b"c"], "g": [b"a", b"b", b"c"], "s": [s.tobytes() for s in sets]})
    assert N.block_links(own, 80) == [(b"a", b"b")]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 3000):
        every = np.unique(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        a, b = every[: int(1.5 * n)], every[int(0.5 * n) :]
        j = len(np.intersect1d(a, b)) / len(every)
        bins = 2000
        same = (N.sketch(a, bins) == N.sketch(b, bins)).mean()
        assert abs(same - j) < 0.06
        assert (N.sketch(a, bins) == N.sketch(a[::-1].copy(), bins)).all()


def test_components_on_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and out[101] == 100 and len(out) == 43


def test_the_stage(docs, none, texts):
    out = N.deduplicate(docs)
    assert out.columns == docs.columns
    kept = {r[0] for r in brute([(i, t) for i, t, *_ in texts], 5) if r[3]}
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(kept | {None}, key=str)
    assert N.deduplicate(none).count() == 0 and N.near_duplicates(none).count() == 0
