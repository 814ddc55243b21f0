import random

import numpy as np
import pytest

from sawmill.llm import substring_dedup as S


def tree(h, t):
    """The Cartesian tree's nodes whose subtrees hold t positions: (l, c, r), by recursion."""
    out, todo = [], [(0, len(h) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 >= t:
            c = lo + int(h[lo : hi + 1].argmin())
            out.append((lo, c, hi))
            todo += [(lo, c - 1), (c + 1, hi)]
    return out


def test_centres_are_the_trees_nodes():
    rng = np.random.default_rng(0)
    for n, t in ((60, 5), (30, 30), (29, 30), (100, 1), (500, 21)):
        h = rng.permutation(n).astype(np.uint64) << np.uint64(40)
        assert sorted(set(S.centres(h, t).tolist())) == sorted(c for _, c, _ in tree(h, t))


def test_every_run_shares_its_cell():
    """Two texts that share any run of core shingles have a key in common, at the run's place; so have slices of long ones."""
    rng = np.random.default_rng(1)
    for n in (21, 30, 200):
        for _ in range(40):
            run = rng.integers(0, 1 << 62, 21).astype(np.uint64)
            texts = [np.concatenate((rng.integers(0, 1 << 62, rng.integers(0, n)).astype(np.uint64), run, rng.integers(0, 1 << 62, n).astype(np.uint64))) for _ in range(2)]
            places = [int(np.flatnonzero(x == run[0])[0]) for x in texts]
            both = [{(k, c - at) for k, c in zip(*(y.tolist() for y in S.cells(x, 21, 46)), strict=True) if 0 <= c - at < 21} for x, at in zip(texts, places, strict=True)]
            assert both[0] & both[1]


def test_slices_of_long_texts(monkeypatch):
    h = np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64)
    whole = S.centres(h, 21).tolist()
    monkeypatch.setattr(S, "SLICE", 512)
    assert S.centres(h >> np.uint64(0), 21).tolist() == whole


def test_cells_of_repeating_text_are_few():
    s = np.array([3, 1] * 2000, dtype=np.uint64)
    assert len(S.cells(s, 21, 46)[0]) < 200


def prose(rng, n, mark):
    return [f"{mark}{rng.randrange(3000)}" for _ in range(n)]


def uncovered(rows, out, length=50):
    """Runs of words that stand in several documents, and for each in how many it is not covered by a span."""
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    cover: dict = {}
    for r in out:
        cover.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    holders: dict = {}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            holders.setdefault(tuple(w[k : k + length]), {}).setdefault(i, []).append(any(a <= k and k + length <= b for a, b in cover.get(i, [])))
    return {x: sum(not all(c) for c in by.values()) for x, by in holders.items() if len(by) > 1}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    shared, other = prose(rng, 55, "s"), prose(rng, 120, "t")
    near = list(other)
    near[60] = "swapped"
    rows = [(i, " ".join(prose(rng, 100, "a") + (shared if i % 3 == 0 else []) + prose(rng, 40, "b"))) for i in range(30)]
    rows += [(100, " ".join(other)), (101, " ".join(prose(rng, 60, "c") + near)), (102, " ".join(prose(rng, 49, "d"))), (103, " ".join(shared[:40]) + " " + " ".join(prose(rng, 60, "e")))]
    return rows + [(104, None), (105, ""), (106, " ".join(other)), (107, "again " * 4000)]


def test_shared_passages(spark, rows):
    out = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = uncovered(rows, out)
    assert left and max(left.values()) == 1
    found = {r["doc_id"] for r in out} | {r["other_doc_id"] for r in out}
    assert found == {i for i in range(30) if i % 3 == 0} | {100, 101, 106}
    near = [r for r in out if {r["doc_id"], r["other_doc_id"]} == {100, 101}] + [r for r in out if {r["doc_id"], r["other_doc_id"]} == {101, 106}]
    assert near and all(r["end"] - r["start"] >= 110 for r in near)
    slow = S.repeats(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_keys=0).collect()
    assert sorted(map(tuple, slow)) == sorted(map(tuple, out))


def test_fragments_of_other_texts_do_not_hide_a_passage(spark):
    rng = random.Random(8)
    rows = []
    for n in (50, 55, 60, 70):
        for _ in range(5):
            run = prose(rng, n, f"r{n}_")
            pieces = [run, run] + [p for _ in range(4) for p in (run[:44], run[-44:], run[(n - 44) // 2 :][:44])]
            rows += [(len(rows) + k, " ".join(prose(rng, 40, "f") + p + prose(rng, 40, "g"))) for k, p in enumerate(pieces)]
    out = S.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = uncovered(rows, out)
    assert left and max(left.values()) == 1
    own = {i: t.split() for i, t in rows}
    grams = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in own.items()}
    assert all(tuple(own[r["doc_id"]][r["start"] :][:50]) in grams[r["other_doc_id"]] for r in out)


def near_links(rows):
    """Brute force: the documents with a passage near to another text's, and the pairs, from whole shingle sequences."""
    full = {i: S.shingle_hashes(S.word_hashes(t.encode()), 5) for i, t in rows}
    out = set()
    for i in full:
        for j in full:
            if i != j and S.agreed(full[i], full[j], 46, 41):
                out.add(frozenset((i, j)))
    return out


def families(seed, sizes, lengths, edits=1):
    rng, rows = random.Random(seed), []
    for n in lengths:
        for holders in sizes:
            base = prose(rng, n, f"p{n}_{holders}_")
            for _ in range(holders):
                own = list(base)
                for _ in range(edits):
                    at, kind = rng.randrange(len(own)), rng.randrange(3)
                    own[at : at + 1] = [[f"x{rng.random()}"], [], [own[at], f"y{rng.random()}"]][kind]
                rows.append((len(rows), " ".join(prose(rng, rng.randrange(40), "a") + own + prose(rng, rng.randrange(40), "b"))))
    return rows


@pytest.mark.parametrize("small, block, large", [(256, 256, 8192), (3, 4, 10**6), (3, 4, 6)])
def test_families_of_near_passages(spark, small, block, large):
    """One or two edits a holder: every document with a near passage in another is found, and nearly every link by way of the others."""
    rows = families(5, (2, 3, 8, 20), (52, 60, 100, 150)) + [(1000 + i, t) for i, t in families(6, (5, 20), (80, 150), 2)]
    want = near_links(rows)
    out = S.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small=small, block=block, large=large).collect()
    got = {frozenset((r["doc_id"], r["other_doc_id"])) for r in out}
    assert got <= want  # nothing that brute force refutes
    docs, found = {i for p in want for i in p}, {i for p in got for i in p}
    assert len(docs & found) / len(docs) == 1.0

    def classes(links):
        of = {i: i for p in links for i in p}
        for _ in of:
            for a, b in map(tuple, links):
                of[a] = of[b] = min(of[a], of[b])
        return of

    a, b = classes(want), classes(got)
    together = [p for p in want if b[min(p)] == b[max(p)]]
    assert len(together) >= 0.99 * len(want) and set(a) == set(b)


def test_near_passages_behind_a_common_phrase(spark):
    """Texts that all share one passage, and a phrase too short to be one; by the phrase, near passages of three texts each, of one edit.

    Their cells lie within the phrase, so they meet in groups of all texts only, which are over `large`."""
    rng = random.Random(21)
    linked, phrase = prose(rng, 80, "l"), prose(rng, 30, "p")
    rows = []
    for k in range(14):
        left, tail = prose(rng, 20, f"c{k}_"), prose(rng, 3, f"d{k}_")
        for gap in ([], ["x"], ["y", "z"])[: 2 + k % 2]:
            rows.append((len(rows), " ".join(linked + prose(rng, 60, f"a{len(rows)}_") + left + gap + tail + phrase + prose(rng, 60, f"b{len(rows)}_"))))
    out = S.repeats(spark.createDataFrame(rows, "doc_id long, text string"), large=6, small=3, block=4).collect()
    at = {i: t.split().index(phrase[0]) for i, t in rows}
    full = {i: S.shingle_hashes(S.word_hashes(t.encode()), 5)[80:] for i, t in rows}
    near = [(i, j) for i in full for j in full if i < j and (S.agreed(full[i], full[j], 46, 41) or S.agreed(full[j], full[i], 46, 41))]
    assert len(near) == 7 + 7 * 3
    of = {i: i for i in full}
    got = {frozenset((r["doc_id"], r["other_doc_id"])) for r in out if r["start"] <= at[r["doc_id"]] < r["end"]}
    for _ in of:
        for p in got:
            of[min(p)] = of[max(p)] = min(of[x] for x in p)
    assert got <= {frozenset(p) for p in near} and all(of[i] == of[j] for i, j in near)


def test_the_rarest_shingles_meet_every_near_run():
    rng = np.random.default_rng(5)
    for _ in range(300):
        base = rng.integers(0, 40, 80).astype(np.int32)
        x, y = base.copy(), base.copy()
        for own in (x, y):
            places = rng.integers(0, 80, 4)
            own[places] = rng.integers(40, 60, 4)
        held = {int(v): int(rng.integers(2, 50)) for v in np.intersect1d(x, y)}
        if S.agreed(x, y, 46, 41):
            assert set(S.rarest(x, held, 46, 41).tolist()) & set(y.tolist())


def test_the_stage(spark, rows):
    d = spark.createDataFrame([(i, t, "x", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, w string, n_chars long")
    out = S.without_repeats(d)
    assert out.columns == d.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    whole = {i: t for i, t in rows}
    assert set(whole) - set(texts) <= {100, 106}
    assert not [x for x, n in uncovered([(i, t) for i, t in texts.items() if i != 106], []).items() if n > 1]
    assert all(texts[i] == whole[i] for i in range(30) if i % 3) and texts[104] is None and texts[107] == whole[107]


def test_edges(docs, none, texts):
    out = S.repeats(docs).collect()
    pairs = {frozenset((r["doc_id"], r["other_doc_id"])) for r in out}
    assert {frozenset((1, 2)), frozenset((8, 9))} <= pairs
    assert not {i for p in pairs for i in p} & {5, 6, 10, 11, 13, 4}
    assert S.repeats(none).count() == 0 and S.without_repeats(none).count() == 0
    assert S.without_repeats(docs).count() <= len(texts)


def test_cut():
    text = "a b  c\nd e"
    assert S.cut(text.encode(), [(1, 3)]) == "a d e" and S.cut(text.encode(), [(0, 5)]) == "" and S.cut(text.encode(), [(3, 5)]) == "a b  c\n"
