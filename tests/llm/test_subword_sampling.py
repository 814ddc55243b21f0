import collections
import os

import numpy as np
import pytest

from sawmill.llm import subword_sampling as S
from sawmill.llm.common import mix

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="the public vocabulary is not installed")


@pytest.fixture(scope="module")
def v():
    return S.Vocabulary(S.MODEL)


def segmentations(v, text):
    s = " " + text
    out = []

    def go(a, ids, p):
        if a == len(s):
            out.append((tuple(ids), p))
            return
        for b in range(a + 1, min(len(s), a + v.longest) + 1):
            i = v.ids.get(s[a:b])
            if i is not None:
                go(b, [*ids, i], p + v.logp[i])
            elif b == a + 1:
                raw = s[a].encode()
                go(b, ids + [v.byte[x] for x in raw], p + len(raw) * v.logp[S.NONE])

    go(0, [], 0.0)
    total = np.logaddexp.reduce([p for _, p in out])
    return {ids: float(np.exp(p - total)) for ids, p in out}


@pytest.mark.parametrize("text", ["ab cat", "tion e", "ñ ☃x"])
def test_distribution_against_all_segmentations(v, text):
    p, n, k = segmentations(v, text), 6000, 3
    got = S.sample(S.Lattices(v), [text] * n, mix(np.arange(n, dtype=np.uint64) * np.uint64(77777) + np.uint64(5)), k)
    most = min(k, sum(x > 1e-11 for x in p.values()))
    assert all(len({tuple(x[0].tolist()) for x in g}) == len(g) == most for g in got)
    assert all(abs(np.exp(x[1]) - p[tuple(x[0].tolist())]) < 1e-9 for g in got[:300] for x in g)
    assert all(g[i][2] > g[i + 1][2] for g in got for i in range(len(g) - 1))
    first, second = (collections.Counter(tuple(g[r][0].tolist()) for g in got if len(g) > r) for r in (0, 1))
    for s in sorted(p, key=p.get)[-4:]:
        assert abs(first[s] / n - p[s]) < 5 * (p[s] * (1 - p[s]) / n) ** 0.5 + 1e-3
        q = sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s and p[a] < 1)
        if most > 1:
            assert abs(second[s] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 2e-3
    estimate = np.mean([sum(np.exp(x[1]) / x[3] for x in g) for g in got])  # inclusion scores make sums unbiased
    assert abs(estimate - 1) < 0.05


def test_slices_do_not_matter(v):
    texts = ["some text here", "", "another  one\n\nwith lines", "x" * 300, "日本語 ▁ é\t."]
    keys = mix(np.arange(5, dtype=np.uint64))
    whole = S.sample(S.Lattices(v), texts, keys, 4)
    one = S.Lattices(v)
    for i, t in enumerate(texts):
        alone = S.sample(one, [t], keys[i : i + 1], 4)[0]
        assert [(a[0].tolist(), round(a[1], 9), round(a[2], 9), round(a[3], 9)) for a in alone] == [(a[0].tolist(), round(a[1], 9), round(a[2], 9), round(a[3], 9)) for a in whole[i]]
        assert all(v.decode(a[0]) == t for a in alone) and len({tuple(a[0].tolist()) for a in alone}) == len(alone)


def test_shrinking_keeps_units_usable(v, monkeypatch):
    monkeypatch.setattr(S, "CACHED_UNITS", 50)
    monkeypatch.setattr(S, "KEPT_UNITS", 20)
    a, b = S.Lattices(v), S.Lattices(v)
    rng = np.random.default_rng(0)
    for r in range(6):
        text = " ".join(f"wd{rng.integers(60)}" for _ in range(40))
        monkeypatch.setattr(S, "CACHED_UNITS", 50)
        x = S.sample(a, [text], mix(np.array([r], dtype=np.uint64)), 2)[0]
        monkeypatch.setattr(S, "CACHED_UNITS", 10**9)
        y = S.sample(b, [text], mix(np.array([r], dtype=np.uint64)), 2)[0]
        assert [i[0].tolist() for i in x] == [i[0].tolist() for i in y]


def test_decodes_like_the_library(v):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    for text in ("Hello  wörld\n", "日本 x", " lead and trail "):
        ids = S.sample(S.Lattices(v), [text], mix(np.array([1], dtype=np.uint64)), 1)[0][0][0].tolist()
        assert sp.decode(ids) == text == v.decode(ids)
        assert v.decode(sp.encode(text)) == text


def test_rows(docs, none, texts):
    out = S.decode(S.encode(docs, k=3)).collect()
    want = collections.Counter((i, t or "") for i, t, *_ in texts)
    got = collections.Counter((r["doc_id"], r["decoded"]) for r in out if r["rank"] == 1)
    assert got == want and all(r["n_pieces"] == len(r["ids"]) and 0 <= r["inclusion"] <= 1 for r in out)
    assert {(r["rank"], r["log_prob"], r["inclusion"]) for r in out if r["doc_id"] == 6} == {(1, 0.0, 1.0)}
    again = S.encode(docs.repartition(3), k=3).collect()
    assert sorted((str(r["doc_id"]), r["rank"], r["ids"]) for r in again) == sorted((str(r["doc_id"]), r["rank"], r["ids"]) for r in out)
    assert S.encode(none).count() == 0
