import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sawmill.llm import sharding as S


def test_all_rows_gapless_and_by_key(docs, texts):
    rows = S.shard_documents(docs, 7).collect()
    assert len(rows) == len(texts)
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 10}) == 1
    want = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in texts}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == want


def test_empty(none):
    assert S.shard_documents(none).count() == 0


def test_weights_and_growth(spark):
    tree = [S.Region("r0", [S.Rack("a", {0: 1.0, 1: 3.0}), S.Rack("b", {2: 2.0})]), S.Region("r1", [S.Rack("c", {3: 2.0})])]
    keys = spark.range(40000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select("k", *[c.alias(n) for n, c in S.place(F.col("k"), tree).items()], S.place(F.col("k"), S.grow(tree, 2.0))["shard"].alias("grown")).collect()
    n = Counter(r["shard"] for r in rows)
    for shard, weight in {0: 1, 1: 3, 2: 2, 3: 2}.items():
        assert abs(n[shard] / 40000 - weight / 8) < 5 * math.sqrt(weight / 8 / 40000)
    moved = [r for r in rows if r["shard"] != r["grown"]]
    assert {r["grown"] for r in moved} == {4} and abs(len(moved) / 40000 - 0.2) < 0.02


def test_a_changed_weight_moves_keys_only_there(spark):
    tree, heavier = S.balanced_tree(12, 2, 3), S.balanced_tree(12, 2, 3)
    rack = heavier[1].racks[0]
    heavier[1].racks[0] = S.Rack(rack.name, {s: 2.0 for s in rack.shards})
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    a, b = S.place(F.col("k"), tree), S.place(F.col("k"), heavier)
    rows = keys.select(a["region"].alias("r1"), b["region"].alias("r2"), a["rack"].alias("k1"), b["rack"].alias("k2"), a["shard"].alias("s1"), b["shard"].alias("s2")).collect()
    across = [r for r in rows if r["r1"] != r["r2"]]
    within = [r for r in rows if r["r1"] == r["r2"] and r["k1"] != r["k2"]]
    assert across and all(r["r2"] == heavier[1].name for r in across)
    assert within and all(r["k2"] == rack.name for r in within)
    assert all(r["s1"] == r["s2"] for r in rows if r["k1"] == r["k2"])


def test_bad_trees():
    with pytest.raises(ValueError):
        S.place(F.lit("x"), [])
    with pytest.raises(ValueError):
        S.place(F.lit("x"), [S.Region("r", [S.Rack("k", {0: 0.0})])])


def test_placement_by_brute_force(spark):
    """Each level's draw is worked out here: log(u) / weight, u from the chained 64-bit hash of key and child."""
    import xxhash

    tree = [S.Region("r0", [S.Rack("a", {0: 1.0, 1: 3.0}), S.Rack("b", {2: 2.0})]), S.Region("r1", [S.Rack("c", {3: 2.0, 4: 0.5})])]
    hashed = lambda text, seed: xxhash.xxh64_intdigest(text.encode(), seed=seed)

    def winner(key, children):
        draw = lambda i, w: (math.log((hashed(i, hashed(key, 42)) % (1 << 52) + 0.5) / (1 << 52)) / w, i)
        return max(draw(i, w) for i, w in children)[1]

    def signed(key):  # the engine's remainder is of the signed value, which differs by a multiple of 2 ** 52
        region = winner(key, [(g.name, g.weight) for g in tree])
        racks = next(g for g in tree if g.name == region).racks
        rack = winner(key, [(k.name, k.weight) for k in racks])
        return region, rack, int(winner(key, [(f"shard{i}", w) for i, w in next(k for k in racks if k.name == rack).shards.items()])[5:])

    keys = ["", "é", *map(str, range(500))]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *[c.alias(n) for n, c in S.place(F.col("k"), tree).items()]).collect()
    assert all((r["region"], r["rack"], r["shard"]) == signed(r["k"]) for r in rows) and len(rows) == len(keys)
