"""Operator 1: hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards with weights. A key descends from the root; at each
level every child draws ln(u) / weight, where u in (0, 1) is a hash of key and child, and the child with
the largest draw takes the key. A child is so chosen in proportion to its weight, and when weights
change, keys move only into subtrees whose weight grew and out of those whose weight shrank.

Growth adds a region with one rack that holds the new shard. No other weight changes at any level, so
every key that moves goes into the new shard: the law `key`.

Defined cases: a null key is a key of its own; equal keys share a shard; null text counts as empty;
weights must be positive; an empty table gives an empty table. Columns of the input other than the ones
named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Rack:
    name: str
    shards: dict[int, float]

    @property
    def weight(self) -> float:
        return sum(self.shards.values())


@dataclass(frozen=True)
class Region:
    name: str
    racks: list[Rack] = field(default_factory=list)

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


Tree = list[Region]


def balanced_tree(n_shards: int, regions: int = 2, racks: int = 4, weight: float = 1.0) -> Tree:
    """Shards 0 to n - 1 dealt over regions x racks in runs whose lengths are at most one apart."""
    cells = min(n_shards, regions * racks)
    runs = [list(range(n_shards * i // cells, n_shards * (i + 1) // cells)) for i in range(cells)]
    tree: Tree = []
    for r in range(min(regions, cells)):
        own = [i for i in range(cells) if i * min(regions, cells) // cells == r]
        tree.append(Region(f"region{r}", [Rack(f"region{r}/rack{i}", {s: weight for s in runs[i]}) for i in own]))
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, numbered next, in a region of its own."""
    new = 1 + max((s for g in tree for k in g.racks for s in k.shards), default=-1)
    return [*tree, Region(f"grown{new}", [Rack(f"grown{new}/rack", {new: weight})])]


def _winner(key: Column, children: Column) -> Column:
    """The id among array<struct<id string, weight double>> whose draw is the largest."""

    def draw(c: Column) -> Column:
        u = (F.pmod(F.xxhash64(key, c["id"]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        return F.struct((F.log(u) / c["weight"]).alias("draw"), c["id"].alias("id"))

    return F.array_max(F.transform(children, draw))["id"]


def _children(items: list[tuple[str, float]]) -> Column:
    if any(w <= 0 for _, w in items):
        raise ValueError("weights must be positive")
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in items])


def place(key: Column, tree: Tree) -> dict[str, Column]:
    """Columns region, rack and shard of a string key. Three draws of the levels' fan-outs, all in the JVM."""
    if not tree:
        raise ValueError("the tree has no shard")
    racks = F.create_map(*[x for g in tree for x in (F.lit(g.name), _children([(k.name, k.weight) for k in g.racks]))])
    shards = F.create_map(*[x for g in tree for k in g.racks for x in (F.lit(k.name), _children([(f"shard{s}", w) for s, w in k.shards.items()]))])
    region = _winner(key, _children([(g.name, g.weight) for g in tree]))
    rack = _winner(key, F.element_at(racks, region))
    return {"region": region, "rack": rack, "shard": F.substring(_winner(key, F.element_at(shards, rack)), 6, 10).cast("int")}


def shard_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\u0000null"))


def with_slots(placed: DataFrame, tie: list[str], buckets: int = 1024) -> DataFrame:
    """Adds slot: 0, 1, 2, ... within each shard without a task that holds a shard.

    Rows are numbered within (shard, bucket of their hash); the buckets' counts, at most shards x buckets
    rows, give each bucket its first slot and are broadcast."""
    cut = placed.withColumn("bucket", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy(*tie)
    return (
        cut.withColumn("own", F.row_number().over(own) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])
        .withColumn("slot", (F.col("first") + F.col("own")).cast("long"))
        .drop("first", "own", "bucket")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None, buckets: int = 1024) -> DataFrame:
    """All rows with region, rack, shard, slot and the shard that one more shard would give."""
    tree = tree or balanced_tree(n_shards)
    key = shard_key(id_col)
    at, grown = place(F.col("key"), tree), place(F.col("key"), grow(tree))
    bytes_ = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), (F.length(bytes_) + 16).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"))
    placed = rows.withColumns({**at, "grown_shard": grown["shard"]})
    return with_slots(placed, ["key", "text_crc32", "size"], buckets).drop("key")


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
