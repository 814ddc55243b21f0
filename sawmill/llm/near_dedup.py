"""Operator 9: near-duplicate documents by fast similarity sketching.

A document is the set of hashes of its word shingles. The sketch has one slot for each of bands x rows
bins: in round i every element is hashed to a bin and a value, and a bin keeps the least value of the first
round that reached it; from round `bins` on, round bins + j serves bin j alone, so all bins fill at last.
Bands of `rows` bins are hashed; sets that share a band are candidates; every link is confirmed on the full
sets. 32 bands of 5 rows miss a pair at similarity 0.8 with probability 3e-6.

Scale. Equal sets are one node. In each bucket of a band every set is compared with a centre, picked by a
hash that differs between bands, so a bucket of m sets gives m - 1 pairs. Confirmed links are joined to
components, and buckets that still hold several components get a second centre. What is torn even then is
compared in full across its components: buckets of up to 16 sets as pairs, larger ones in pairs of blocks
of 256 sets whose intersections are one matrix product each, of which only links that join components
leave the task. Nothing is capped: no link that would join two components is left unchecked, while links
within a component need not be listed.

Defined cases: null or wordless texts have no shingle, link with nothing and are components of their own;
texts shorter than a shingle are one shingle; equal sets are linked; a null doc_id takes part but never
names a component that has another id (a component of null ids only has null, and its rows are kept);
repeated rows share their result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, mix, quiet, scratch, shingle_hashes, small_batches, table, text_bytes, tidy, word_hashes, written
from .components import components

BANDS, ROWS = 32, 5


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """One value of 56 bits for each bin (9 of the round, 47 of the hash). elements: distinct uint64, at least one."""
    out = np.zeros(bins, dtype=np.uint64)
    empty = np.ones(bins, dtype=bool)
    n, done = len(elements), 0
    with quiet():
        while done < bins and empty.any():
            rounds = np.arange(done, min(bins, done + max(1, int(bins * (np.log(bins) + 2) / n) + 1)), dtype=np.uint64)
            x = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            at = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            key = (at << np.uint64(56) | rounds[:, None] << np.uint64(47) | mix(x) >> np.uint64(17)).ravel()
            key.sort()
            bin_ = (key >> np.uint64(56)).astype(np.int64)
            first = np.concatenate(([True], bin_[1:] != bin_[:-1]))
            got, value = bin_[first], key[first] & np.uint64((1 << 56) - 1)
            new = empty[got]
            out[got[new]] = value[new]
            empty[got] = False
            done = int(rounds[-1]) + 1
        for j in np.flatnonzero(empty):  # rounds bins .. 2 * bins - 1
            x = mix(elements + np.uint64(bins + j + 1) * np.uint64(0x9E3779B97F4A7C15))
            out[j] = np.uint64(bins + j) << np.uint64(47) | (mix(x) >> np.uint64(17)).min()
    return out


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with quiet():
        x = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for column in values.reshape(bands, rows).T:
            x = mix(x * np.uint64(0x9FB21C651E98DF25) + column)
    return x.view(np.int64)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), width))


def set_id(s: np.ndarray) -> bytes:
    """16 bytes that name a set, whatever the order of its elements."""
    with quiet():
        a = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
        b = int(np.bitwise_xor.reduce(mix(s + np.uint64(0x14057B7EF767814F))))
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2 (of the text), n_shingles, sid, bands, written to the shared folder."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingles(text, width)
                if not len(s):
                    out.append((0, None, None))
                    continue
                values = sketch(s, bands * rows)
                out.append((len(s), set_id(s), band_hashes(values, bands, rows)))
            got = pd.DataFrame(out, columns=["n_shingles", "sid", "bands"])
            yield pd.concat([batch.drop(columns=["text"]).reset_index(drop=True), got], axis=1)

    keyed = own.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"), "text")
    return written(keyed.mapInPandas(tidy(run), f"doc_id {kind}, k1 long, k2 long, n_shingles long, sid binary, bands array<long>"), "sketches")


def full_sets(asked: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, width: int, broadcast_keys: int) -> DataFrame:
    """sid, s (the set's hashes in order) of the asked set ids s. sets: sid, k1, k2 of a text that has the set."""
    keys = written(sets.join(asked, F.col("sid") == F.col("s")).select("sid", "k1", "k2"), "asked")
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    bytes_ = text_bytes(text_col)
    texts = docs.select(F.xxhash64(bytes_).alias("t1"), F.xxhash64(F.lit(7), bytes_).alias("t2"), bytes_.alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sid": batch["sid"], "s": [shingles(t, width).tobytes() for t in batch["text"]]})

    found = texts.join(F.broadcast(keys) if few else keys, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))).select("sid", "text")
    return written(found.dropDuplicates(["sid"]).mapInPandas(tidy(hashed), "sid binary, s binary"), "sets")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose full sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]

    left = pairs.select("a", "b").join(full.select(F.col("sid").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(full.select(F.col("sid").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    return written(both.mapInPandas(tidy(check), "a binary, b binary"), "links")


def block_links(own: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links (a, b) that join components among the sets of two blocks. own: side, sid, g, s. Intersections are
    matrix products over slices of the blocks' elements."""
    sides = [own[own["side"] == k] for k in (0, 1)]
    if own["same"].iloc[0]:
        sides[1] = sides[0]
    sets = [[np.frombuffer(x, dtype=np.uint64) for x in side["s"]] for side in sides]
    if not sets[0] or not sets[1]:
        return []
    every = np.unique(np.concatenate([np.concatenate(x) for x in sets]))
    both = np.zeros((len(sets[0]), len(sets[1])), dtype=np.float32)
    places = [(np.repeat(np.arange(len(x)), [len(y) for y in x]), np.searchsorted(every, np.concatenate(x))) for x in sets]
    for at in range(0, len(every), 8192):
        part = []
        for (row, place), x in zip(places, sets, strict=True):
            m = np.zeros((len(x), min(8192, len(every) - at)), dtype=np.float32)
            here = (place >= at) & (place < at + 8192)
            m[row[here], place[here] - at] = 1
            part.append(m)
        both += part[0] @ part[1].T
    n, m = (np.array([len(y) for y in x], dtype=np.float64) for x in sets)
    both = both.astype(np.float64)
    ids, groups = [side["sid"].tolist() for side in sides], [side["g"].tolist() for side in sides]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(100 * both >= percent * (n[:, None] + m[None, :] - both)):
        a, b = find(groups[0][i]), find(groups[1][j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[0][i], ids[1][j]))
    return out


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 256, broadcast_keys: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(sketches of all rows, sid -> component sid for the sets that are linked). All other tables written on the way are deleted."""
    with scratch(docs.sparkSession) as keep:
        all_rows, groups = _linked(docs, id_col, text_col, width, percent, bands, rows, block, broadcast_keys)
        keep(all_rows)
        keep(groups)
    return all_rows, groups


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int, block: int, broadcast_keys: int) -> tuple[DataFrame, DataFrame]:
    sketches = sketched(docs, id_col, text_col, width, bands, rows)
    all_rows = written(sketches.select("doc_id", "k1", "k2", "n_shingles", "sid"), "texts")
    sets = written(
        sketches.filter("n_shingles > 0").groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .select("sid", "k.k1", "k.k2", "n", "bands"), "distinct-sets",
    )
    discard(sketches)
    each = sets.select("sid", "n", F.posexplode("bands").alias("band", "h"))
    order = F.struct(F.xxhash64("sid", "band").alias("o"), F.col("sid").alias("c"), F.col("n").alias("cn"))
    buckets = each.groupBy("band", "h").agg(F.min(order).alias("lo"), F.max(F.struct(F.xxhash64("sid", "band"), "sid")).alias("hi")).filter("lo.c != hi.sid").select("band", "h", "lo.c", "lo.cn")
    members = written(each.join(buckets, ["band", "h"]), "buckets")
    fits = lambda p, q: (100 * F.least(p, q) >= percent * F.greatest(p, q))
    star = members.filter(F.col("sid") != F.col("c")).filter(fits(F.col("n"), F.col("cn"))).select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()
    names = sets.select("sid", "k1", "k2")
    full = full_sets(members.select(F.col("sid").alias("s")).distinct(), names, docs, text_col, width, broadcast_keys)
    links = confirmed(written(star, "pairs"), full, percent)
    links, groups = again(links, components(links))

    def torn(groups: DataFrame) -> DataFrame:
        """The members of buckets that hold several components, with their component g."""
        now = members.select("band", "h", "sid", "n").join(groups.select(F.col("node").alias("sid"), F.col("component").alias("g")), "sid", "left").withColumn("g", F.coalesce("g", "sid"))
        other = F.struct(F.xxhash64(F.lit(1), "sid", "band").alias("o"), F.col("sid").alias("c"), F.col("n").alias("cn"), F.col("g").alias("cg"))
        found = now.groupBy("band", "h").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.count(F.lit(1)).alias("size"), F.min(other).alias("m")).filter("g1 != g2")
        return written(now.join(found.select("band", "h", "size", "m.c", "m.cn", "m.cg"), ["band", "h"]), "torn")

    some = torn(groups)
    second = some.filter((F.col("g") != F.col("cg")) & fits(F.col("n"), F.col("cn"))).select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b")).distinct()
    links, groups = again(links.union(confirmed(written(second, "pairs"), full, percent)), None)

    some = torn(groups)
    left, right = (some.filter(F.col("size") <= 16).select("band", "h", *[F.col(c).alias(f"{c}{i}") for c in ("sid", "n", "g")]) for i in (1, 2))
    across = left.join(right, ["band", "h"]).filter((F.col("sid1") < F.col("sid2")) & (F.col("g1") != F.col("g2")) & fits(F.col("n1"), F.col("n2")))
    few = confirmed(written(across.select(F.col("sid1").alias("a"), F.col("sid2").alias("b")).distinct(), "pairs"), full, percent)
    more = in_blocks(some.filter(F.col("size") > 16), full, percent, block)
    # Every pair across components that can be a link has now been confirmed or refuted.
    new = written(few.union(more), "links")
    if new.limit(1).count():
        links, groups = again(links.union(new), None)
    return all_rows, groups


def again(links: DataFrame, groups: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    return links, written(components(links) if groups is None else groups, "components")


def in_blocks(some: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """Links that join components within large buckets; a bucket of m sets is (m / block) ** 2 / 2 tasks' groups."""
    cut = some.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit(3), "sid"), "blocks").cast("int"))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = each.select("band", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("own") == F.col("other")).alias("same"), "sid", "g")
    rows = keyed.join(full, "sid")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(own, percent), columns=["a", "b"])

    return rows.groupBy("band", "h", "i", "j").applyInPandas(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id (the smallest doc_id reachable) and kept, a row for each row."""
    rows, groups = linked(docs, id_col, text_col, **options)
    named = rows.select("doc_id", "k1", "k2", "n_shingles", "sid").join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("g", F.coalesce("component", "sid"))
    least = named.filter("n_shingles > 0").groupBy(F.col("g").alias("of")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, F.col("g") == F.col("of"), "left")
    return out.select(
        "doc_id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component, with the columns of docs; of rows that repeat id and text, one."""
    keep = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("__id"), F.col("k1").alias("__t1"), F.col("k2").alias("__t2")).distinct()
    text = text_bytes(text_col)
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit(7), text)})
    kept = keyed.join(keep, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__k1") == F.col("__t1")) & (F.col("__k2") == F.col("__t2")))
    one = Window.partitionBy(id_col, "__k1", "__k2").orderBy(F.lit(1))
    return kept.withColumn("__nth", F.row_number().over(one)).filter("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = r"""with recursive docs as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), places as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [1] else range(1, len(w) - 2) end) as i, w from docs
), sets as (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]) end as s from places
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * s.n >= 80 * (x.n + y.n - s.n)
), both_ways as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as node, doc_id as least from docs
  union
  select e.b, r.least from reach r join both_ways e on e.a = r.node where r.least < e.b
)
select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, m.least as component_id, d.doc_id = m.least as kept
from docs d left join sizes z using (doc_id) join (select node, min(least) as least from reach group by node) m on m.node = d.doc_id"""
