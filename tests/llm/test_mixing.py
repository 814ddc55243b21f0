import itertools
import re
from collections import defaultdict

import duckdb
import pytest

from sawmill.llm import mixing as M


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_stop_and_share_anew():
    got = M.targets({"a": 10, "b": 500, "c": 490, None: 0})
    assert got["a"] == 30 and got[None] == 0
    assert abs(got["b"] / got["c"] - 2.0) < 1e-9 and abs(sum(got.values()) - 1000) < 1e-9


def best_cost(patterns, quotas, most):
    """All whole flows, tried."""
    arcs = [(p, s) for p in patterns for s in p]
    best = None
    for flow in itertools.product(*[range(min(patterns[p] * most, quotas[s]) + 1) for p, s in arcs]):
        out, into = defaultdict(int), defaultdict(int)
        for (p, s), x in zip(arcs, flow, strict=True):
            out[p] += x
            into[s] += x
        if all(out[p] <= most * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            cost = sum(sum((i // patterns[p]) ** 2 for i in range(out[p])) for p in patterns)
            key = (-sum(flow), cost)
            best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("patterns, quotas", [({("a",): 2, ("a", "b"): 3}, {"a": 5, "b": 4}), ({("a",): 1, ("b",): 2, ("a", "b"): 2}, {"a": 4, "b": 3}), ({("a",): 2}, {"a": 9, "b": 1})])
def test_flow_is_cheapest(patterns, quotas):
    got = M.route(patterns, quotas, 3)
    total = {p: sum(got.get(p, {}).values()) for p in patterns}
    cost = sum(sum((i // patterns[p]) ** 2 for i in range(total[p])) for p in patterns)
    assert (-sum(total.values()), cost) == best_cost(patterns, quotas, 3)


def test_rows_against_sql(docs, texts):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, null)", [list(r) for r in texts])
    want = sorted(con.execute(M.OP3_SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in M.mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken", "copies").collect()), key=str)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert all(r[4] <= 3 * r[1] for r in got)


def test_overlapping_sources_and_reruns(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    one, two = (sorted((r["doc_id"], r["copies"], tuple(r["taken_by"])) for r in M.mix_documents(d, weights=(3.0, 1.0)).collect()) for _ in range(2))
    assert one == two
    taken = defaultdict(int)
    sizes = {i: size(t) for i, t, _ in rows}
    for i, n, by in one:
        assert len(by) == n <= 3
        for s in by:
            taken[s] += sizes[i]
    total = sum(sizes.values())
    both = sum(sizes[i] for i, _, m in rows if len(m) == 2)
    assert abs(taken["a"] + taken["b"] - (total + both)) < 60 and abs(taken["a"] / (total + both) - 0.75) < 0.03


def test_the_mix_itself(docs, none, texts):
    mixed = {}
    for r in M.mix_documents(docs).collect():
        mixed[r["place"]] = mixed.get(r["place"], 0) + r["copies"]
    out = M.repeat_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(mixed.values())
    assert M.repeat_documents(none).count() == 0 and M.mix_documents(none).count() == 0


def test_too_many_patterns(docs):
    with pytest.raises(ValueError):
        M.mix_documents(docs, max_patterns=1).count()
