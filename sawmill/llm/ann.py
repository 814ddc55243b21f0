"""Operator 5: approximate nearest neighbours by cross-polytope hashing.

Each of `tables` hash tables turns unit vectors by rounds of random signs and a fast Hadamard transform
(vectors padded to a power of two) and hashes them to the nearest signed axis, by as many concatenated
hashes as make the number of buckets follow the number of rows (`shape`). A query probes, in each table, the
buckets whose axes are nearest to it together; what it compares grows as the 0.43th power of the rows. Where norms
differ, vectors get one more coordinate that makes their norms equal, so that the nearest axis follows the inner product.

Scale: buckets travel in groups of about 256 rows, a query once to each group it probes in, as 16-bit vectors whose
inner products are taken for the probed buckets alone; the best 2 k are ranked again by id on the original vectors.
Groups of over `block` rows or queries are cut into blocks (their list is broadcast if it is short). A query that finds fewer than k
rows is searched for in all rows, block by block, so none stays short.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite components take no part;
vectors of another length than a query's are no candidates of it; ties go to the smaller vec_id, then the
earlier row; repeated rows are candidates of each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep norms."""
    n, p = x.shape
    h = 1
    while h < p:
        x = x.reshape(n, p // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, p)
        h *= 2
    return x / np.sqrt(p)


def rotate(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng([seed, number, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def prepared(v: np.ndarray, largest: float, even: bool, query: bool) -> np.ndarray:
    """Unit vectors, padded; unless norms are even, with the coordinate that equals them (0 for queries)."""
    n, d = v.shape
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    if query or even:
        unit, more = v / norm, np.zeros((n, 1))
    else:
        unit = v / largest
        more = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
    d += not even
    out = np.zeros((n, 1 << max(0, d - 1).bit_length()))
    out[:, : v.shape[1]] = unit
    if not even:
        out[:, v.shape[1]] = more[:, 0]
    return out


def signed(y: np.ndarray, axes: int) -> np.ndarray:
    """Inner products with the first axes and their opposites: the columns are the codes of one hash."""
    return np.concatenate((y[:, :axes], -y[:, :axes]), axis=1)


def shape(n: int, padded: int, tables: int, spread: float = 1.6, share: float = 0.3125, fall: float = 0.57, rows: int = 256) -> tuple[list[int], int, int]:
    """For n rows: the axes of the concatenated hashes of a table, the buckets a query probes in it, and the buckets of one group.

    There are about spread * n buckets, whatever n is: as many whole cross-polytopes as fit, the last one over fewer axes. A query
    probes share * (2000 / n) ** fall of them over all tables, so what it compares grows as n ** 0.43; a group holds about `rows` rows."""
    axes, buckets = [padded], 2 * padded
    while (left := spread * n / buckets) >= 2 and padded > 1:
        more = min(padded, 1 << max(0, int(np.log2(left)) - 1))
        axes.append(more)
        buckets *= 2 * more
    probes = int(np.ceil(buckets * min(1.0, share * (2000 / max(1, n)) ** fall) / tables * (1 if n > 2000 else 1.5)))
    group = 1 << int(max(0, min(np.log2(buckets), np.log2(max(1.0, rows * buckets / max(1, n))))))
    return axes, min(buckets, max(probes, 1)), group


def nearest_buckets(each: list[np.ndarray], most: int) -> np.ndarray:
    """The `most` buckets whose hashes' inner products have the largest sum, for each row. each: signed products of one hash."""
    order = [np.argsort(-y, axis=1, kind="stable") for y in each]
    combos = np.zeros((1, 0), dtype=np.int64)
    for y in each:  # the m-th best has ranks (from 1) whose product is at most m
        size = (combos + 1).prod(axis=1)
        combos = np.concatenate([np.column_stack((combos[size * (r + 1) <= most], np.full(int((size * (r + 1) <= most).sum()), r))) for r in range(min(most, y.shape[1]))])
    total = sum(np.take_along_axis(y, o, 1)[:, combos[:, i]] for i, (y, o) in enumerate(zip(each, order, strict=True)))
    code = np.zeros(total.shape, dtype=np.int64)
    for i, (y, o) in enumerate(zip(each, order, strict=True)):
        code = code * y.shape[1] + o[:, combos[:, i]]
    most = min(most, total.shape[1])
    top = np.argpartition(-total, most - 1, axis=1)[:, :most]
    return np.take_along_axis(code, top, 1)


def usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 32, block: int = 1024, seed: int = 5, broadcast_groups: int = 100_000) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest rows found of each query row."""
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    v = F.col(vector_col).cast("array<double>")
    rows = written(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter(usable(F.col("v"))).withColumn("rid", F.monotonically_increasing_id()), "ann")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ends = rows.agg(F.max(norm).alias("most"), F.min(norm).alias("least"), F.count(F.lit(1)).alias("n")).first()
    most, n = float(ends["most"] or 1.0), int(ends["n"])
    even = float(ends["least"] or 1.0) >= most * (1 - 1e-5)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, own in batch.groupby(batch["v"].map(len)):
                x = np.array(own["v"].tolist(), dtype=np.float64).reshape(len(own), size)
                q = own["is_query"].to_numpy(dtype=bool)
                unit, asked = prepared(x, most, even, False), prepared(x[q], most, even, True)
                axes, probes, group = shape(n, unit.shape[1], tables)
                buckets, probed = np.zeros((len(own), tables), dtype=np.int64), []
                for t in range(tables):
                    turned = []
                    for i, d in enumerate(axes):
                        number = t * len(axes) + i
                        buckets[:, t] = buckets[:, t] * 2 * d + signed(rotate(unit, number, seed), d).argmax(1)
                        if len(asked):
                            turned.append(signed(rotate(asked, number, seed), d))
                    if len(asked):
                        probed.append(np.sort(nearest_buckets(turned, probes), axis=1))
                scale = np.abs(x).max(axis=1) / 32767
                small = np.rint(x / scale[:, None]).astype(np.int16)
                out = own[["rid", "vec_id", "is_query"]].copy()
                out["dim"], out["scale"], out["w"] = np.int32(size), scale, [r.tobytes() for r in small]
                out["g"], out["b"] = list(buckets // group), list((buckets % group).astype(np.int32))
                asks = iter(range(len(asked)))
                out["probes"] = [_by_group([p[i] for p in probed], group) if yes and (i := next(asks)) is not None else None for yes in q]
                yield out

    kept = "rid long, vec_id long, is_query boolean, dim int, scale double, w binary, g array<long>, b array<int>"
    index = written(rows.mapInPandas(hashed, f"{kept}, probes array<struct<t:int,g:long,some:binary>>"), "ann-index")

    items = index.select("rid", "vec_id", "w", "scale", "dim", F.posexplode(F.arrays_zip("g", "b")).alias("t", "at")).select("rid", "vec_id", "w", "scale", "dim", "t", "at.g", "at.b")
    asks = index.filter("is_query").select("rid", "w", "scale", "dim", F.explode("probes").alias("p")).select("rid", "w", "scale", "dim", "p.t", "p.g", "p.some")
    near = matched(items, asks, k, block, broadcast_groups)
    # Products of 16-bit vectors err by about 1e-5: twice as many rows are ranked again on the original vectors.
    near = ranked(near, 2 * k).select("q_rid", "rid")
    mine, theirs = rows.select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("query_id"), F.col("v").alias("q_v")), rows.select("rid", "vec_id", "v")
    product = F.aggregate(F.zip_with("q_v", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    exact = written(near, "ann-near").join(mine, "q_rid").join(theirs, "rid").select("q_rid", "query_id", "rid", "vec_id", product.alias("score"))
    found = written(ranked(exact, k), "ann-found")
    # Queries that found fewer than k look at every row.
    whole = rows.withColumn("dim", F.size("v"))
    short = whole.filter("is_query").select("rid").join(found.groupBy("q_rid").agg(F.count(F.lit(1)).alias("n")), F.col("rid") == F.col("q_rid"), "left").filter(F.coalesce("n", F.lit(0)) < k).select(F.col("rid").alias("short"))
    short = written(short, "ann-short")
    if short.limit(1).count():
        every = whole.select("rid", "vec_id", "v", "dim")
        rest = ranked(pairs(every, every.join(short, F.col("rid") == F.col("short"), "left_semi"), k, block), k)
        found = found.join(short, F.col("q_rid") == F.col("short"), "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")


def _by_group(probes: list[np.ndarray], group: int) -> list[dict]:
    """Sorted buckets of each table as (t, g, buckets within the group)."""
    out = []
    for t, p in enumerate(probes):
        g, at = np.unique(p // group, return_index=True)
        out += [{"t": t, "g": int(a), "some": b.tobytes()} for a, b in zip(g, np.split((p % group).astype(np.int32), at[1:]), strict=True)]
    return out


def products(q: pd.DataFrame, x: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and x, and inner products, of the rows in buckets that a query probes: of more than k, the nearest k."""
    bucket = x["b"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    asked = [np.frombuffer(s, dtype=np.int32) for s in q["some"]]
    who, what = np.repeat(np.arange(len(q)), [len(a) for a in asked]), np.concatenate(asked)
    lo, hi = np.searchsorted(bucket, what), np.searchsorted(bucket, what, side="right")
    n = hi - lo
    who, at = np.repeat(who, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    a, b = (np.frombuffer(b"".join(w), dtype=np.int16).reshape(len(w), -1) for w in (q["q_w"], x["w"]))
    b = b[order]
    score = np.empty(len(who))
    for i in range(0, len(who), 16_384):  # sums of 16-bit products are whole numbers, so equal vectors have equal scores
        score[i : i + 16_384] = np.einsum("ij,ij->i", a[who[i : i + 16_384]].astype(np.float64), b[at[i : i + 16_384]].astype(np.float64))
    at = order[at]
    score *= q["q_scale"].to_numpy()[who] * x["scale"].to_numpy()[at]
    keep = q["q_rid"].to_numpy()[who] != x["rid"].to_numpy()[at]
    who, at, score = who[keep], at[keep], score[keep]
    if len(who) > k:
        best = np.lexsort((x["vec_id"].to_numpy()[at], -score, who))
        who, at, score = who[best], at[best], score[best]
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        nth = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        who, at, score = who[nth < k], at[nth < k], score[nth < k]
    return who, at, score


def matched(items: DataFrame, asks: DataFrame, k: int, block: int, broadcast_groups: int) -> DataFrame:
    """q_rid, rid, vec_id, score of the rows in probed buckets. Groups of over block rows or queries are cut into blocks."""
    keys = ["dim", "t", "g"]
    sizes = items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("i_of"), F.lit(1).alias("q_of")).filter("i_of > 1")
    asked = asks.groupBy(*keys).agg(F.lit(1).alias("i_of"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q_of")).filter("q_of > 1")
    hot = written(sizes.union(asked).groupBy(*keys).agg(F.max("i_of").alias("i_of"), F.max("q_of").alias("q_of")), "ann-hot")
    cuts = F.broadcast(hot) if hot.limit(broadcast_groups + 1).count() <= broadcast_groups else hot
    here = lambda own: F.pmod(F.xxhash64("rid"), F.coalesce(F.col(own), F.lit(1))).cast("int")
    each = lambda other: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    left = asks.join(cuts, keys, "left").withColumn("qb", here("q_of")).withColumn("ib", each("i_of"))
    right = items.join(cuts, keys, "left").withColumn("ib", here("i_of")).withColumn("qb", each("q_of"))

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"q_rid": pd.Series(dtype="int64"), "rid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        who, at, score = products(q, x, 2 * k)
        return pd.DataFrame({"q_rid": q["q_rid"].to_numpy()[who], "rid": x["rid"].to_numpy()[at], "vec_id": x["vec_id"].to_numpy()[at], "score": score})

    by = [*keys, "qb", "ib"]
    left = left.select(F.col("rid").alias("q_rid"), F.col("w").alias("q_w"), F.col("scale").alias("q_scale"), "some", *[F.col(c).alias(f"of_{c}") for c in by])
    right = right.select("rid", "vec_id", "w", "scale", "b", *by)
    return left.groupBy(*[f"of_{c}" for c in by]).cogroup(right.groupBy(*by)).applyInPandas(best, "q_rid long, rid long, vec_id long, score double")


def pairs(items: DataFrame, asks: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest items of each ask (rid, vec_id, v, dim) within each pair of blocks of all rows of its length."""
    count = lambda d, name: d.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    cuts = F.broadcast(count(items, "i_of").join(count(asks, "q_of"), "dim"))  # a row for each length of vectors
    here = lambda own: F.pmod(F.xxhash64("rid"), F.col(own)).cast("int")
    each = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    left = asks.join(cuts, "dim").withColumn("qb", here("q_of")).withColumn("ib", each("i_of")).drop("q_of", "i_of")
    right = items.join(cuts, "dim").withColumn("ib", here("i_of")).withColumn("qb", each("q_of")).drop("q_of", "i_of")

    def best(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        names = ["q_rid", "query_id", "rid", "vec_id", "score"]
        if q.empty or x.empty:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        x = x.sort_values(["vec_id", "rid"], kind="stable")
        a, b = np.array(q["q_v"].tolist()), np.array(x["v"].tolist())
        ids, rids, near = x["vec_id"].to_numpy(), x["rid"].to_numpy(), a @ b.T
        at, scores, n = [], [], []
        for i, rid in enumerate(q["q_rid"]):
            s = near[i]
            s[rids == rid] = -np.inf
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            some = np.flatnonzero(s >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else s > -np.inf)
            exact = (a[i] * b[some]).sum(axis=1)
            order = np.argsort(-exact, kind="stable")[:k]
            at.append(some[order])
            scores.append(exact[order])
            n.append(len(order))
        at = np.concatenate(at)
        return pd.DataFrame({"q_rid": np.repeat(q["q_rid"].to_numpy(), n), "query_id": np.repeat(q["query_id"].to_numpy(), n), "rid": rids[at], "vec_id": ids[at], "score": np.concatenate(scores)})

    by = ["dim", "qb", "ib"]
    left = left.select(F.col("rid").alias("q_rid"), F.col("vec_id").alias("query_id"), F.col("v").alias("q_v"), *[F.col(c).alias(f"of_{c}") for c in by])
    return left.groupBy(*[f"of_{c}" for c in by]).cogroup(right.groupBy(*by)).applyInPandas(best, "q_rid long, query_id long, rid long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    keys = [c for c in found.columns if c != "score"]
    once = found.groupBy(*keys).agg(F.max("score").alias("score"))
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op5(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
