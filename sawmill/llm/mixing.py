"""Operator 3: mixing sources to target weights by min-cost flow.

A document belongs to one or more sources. Documents are aggregated by membership pattern; a pattern
offers its words `max_repeats` times, at a cost that rises with each repetition, to the sources it is
member of, and each source asks for its target. The cheapest flow says how many words each source takes
of each pattern, so that single passes are used before repeats and overlapping documents go where words
are scarce.

Documents of a pattern stand in a seeded order (md5 of seed, id and text) on a line of words, one lap for
each repetition; the flow's sources own successive stretches of the laps. A copy is taken if it ends
within the flow, and goes to the source that owns its middle. What is then still missing is filled by the
one untaken copy whose size is nearest to the gap, so a source comes as near its target as one document
allows. Reruns agree.

Scale: the flow sees one row for each pattern; the number of distinct patterns is a property of the
catalogue, bounded by `max_patterns` (more is an error, not a cut). Running sums over documents are made of
4,096 buckets per pattern: the bucket sums are broadcast (patterns x 4,096 rows at most), rows are only
summed within their bucket.

Defined cases: null text has size 0; documents of size 0 are never taken; a null source is a source of
its own, last in order; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table, written

#: The contract's weights, repeated over the sources in code-point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Shares all sizes by weight; a target stops at `most` times its source's size and the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left, scale = total - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / scale > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / scale for s in free}
        out |= {s: most * sizes[s] for s in over}
        free = [s for s in free if s not in out]
    return out


class Flow:
    """Min-cost flow by successive shortest paths with potentials; integers, small graphs."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.of: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.of[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        n = len(self.of)
        lift = [0] * n  # all first costs are >= 0
        while True:
            far, via = [float("inf")] * n, [-1] * n
            far[s], heap = 0, [(0, s)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.of[a]:
                    b = self.to[e]
                    if self.cap[e] and (x := d + self.cost[e] + lift[a] - lift[b]) < far[b]:
                        far[b], via[b] = x, e
                        heapq.heappush(heap, (x, b))
            if far[t] == float("inf"):
                return
            lift = [p + d if d < float("inf") else p for p, d in zip(lift, far, strict=True)]
            path, a = [], t
            while a != s:
                path.append(via[a])
                a = self.to[via[a] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], max_repeats: int = 3) -> dict[tuple, dict[str | None, int]]:
    """Words that each source takes of each pattern (a tuple of sources with its size)."""
    ps, ss = list(patterns), list(quotas)
    flow, at = Flow(2 + len(ps) + len(ss)), {s: 2 + len(ps) + i for i, s in enumerate(ss)}
    arcs = {}
    for i, p in enumerate(ps):
        for again in range(max_repeats):
            flow.edge(0, 2 + i, patterns[p], again * again)
        for s in p:
            arcs[p, s] = flow.edge(2 + i, at[s], patterns[p] * max_repeats, 0)
    for s in ss:
        flow.edge(at[s], 1, quotas[s], 0)
    flow.run(0, 1)
    out: dict[tuple, dict] = defaultdict(dict)
    for (p, s), e in arcs.items():
        if flow.cap[e ^ 1]:
            out[p][s] = flow.cap[e ^ 1]
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, members: str, seed: int) -> DataFrame:
    """A narrow row for each document: id, size, member sources (sorted, null last), order and bucket."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), member_list(docs, members).alias("members"), place_of(id_col, text_col, seed).alias("place"))
    return rows.withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))


def place_of(id_col: str, text_col: str, seed: int) -> Column:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))


def member_list(docs: DataFrame, members: str) -> Column:
    """The member sources in code-point order, null last. A row without any belongs to the null source."""
    if docs.schema[members].dataType.typeName() != "array":
        return F.array(F.col(members).cast("string"))
    some = F.array_sort(F.array_distinct(F.col(members)))
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(None).cast("string")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, max_repeats: int = 3, seed: int = 11, max_patterns: int = 10_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, members, source_size and target (of the first member source), copies, taken, sources (of each copy)."""
    spark = docs.sparkSession
    rows = written(sized(docs, id_col, text_col, members, seed), "mixing")
    sums = rows.groupBy("members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns; raise max_patterns")
    patterns = {tuple(r["members"]): int(r["size"]) for r in sums}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    want = targets(sizes, weights, most)
    flows = route(patterns, {s: round(x) for s, x in want.items()}, max_repeats)
    plan = spark.createDataFrame(
        [(list(p), n, sizes[p[0]], float(want[p[0]]), sum(flows[p].values()) if p in flows else 0, list(flows.get(p, {})), ends(flows.get(p, {}))) for p, n in patterns.items() if p],
        "members array<string>, whole long, source_size long, target double, flow long, owners array<string>, ends array<long>",
    )
    start = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("members", "bucket").agg(F.sum("size").alias("n")).select("members", "bucket", F.coalesce(F.sum("n").over(start), F.lit(0)).alias("first"))
    own = Window.partitionBy("members", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    lines = (
        rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(F.broadcast(first.withColumnRenamed("members", "m").withColumnRenamed("bucket", "b")), F.col("members").eqNullSafe(F.col("m")) & (F.col("bucket") == F.col("b")))
        .drop("m", "b")
        .join(F.broadcast(plan.withColumnRenamed("members", "m")), F.col("members").eqNullSafe(F.col("m")))
        .drop("m")
    )
    # A copy in lap i lies from i * whole + before to that plus size.
    begins = lambda i: i.cast("long") * F.col("whole") + F.col("before")
    laps = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), begins)
    lines = lines.withColumn("before", F.col("first") + F.col("own"))
    lines = written(lines.withColumn("starts", F.filter(laps, lambda x: (F.col("size") > 0) & (x + F.col("size") <= F.col("flow")))), "mixing-lines")
    gaps = lines.groupBy("members").agg((F.max("flow") - F.sum(F.size("starts") * F.col("size"))).alias("gap"))
    spare = lines.filter((F.col("size") > 0) & (F.size("starts") < max_repeats)).join(F.broadcast(gaps.withColumnRenamed("members", "m")), F.col("members").eqNullSafe(F.col("m")) & (F.col("size") < 2 * F.col("gap")))
    filler = spare.groupBy("m").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "place", "before")).alias("pick")).select("m", F.col("pick.before").alias("fill"))
    full = lines.join(F.broadcast(filler), F.col("members").eqNullSafe(F.col("m")), "left").drop("m")
    extra = (F.col("before") == F.col("fill")) & (F.col("size") > 0)
    owner = lambda x: F.get(F.col("owners"), F.least(F.size(F.filter("ends", lambda e: 2 * e < 2 * x + F.col("size"))), F.size("owners") - 1))
    full = full.withColumn("starts", F.when(extra, F.concat("starts", F.array(F.col("flow") - 1))).otherwise(F.col("starts")))
    return full.select(
        "doc_id", "size", "members", "source_size", "target", F.size("starts").alias("copies"),
        (F.size("starts") * F.col("size")).cast("long").alias("taken"), F.transform("starts", owner).alias("taken_by"), "place",
    )


def ends(flows: dict[str | None, int]) -> list[int]:
    out, n = [], 0
    for x in flows.values():
        n += x
        out.append(n)
    return out


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", members: str = "source", seed: int = 11, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    mixed = mix_documents(docs, id_col, text_col, members, seed=seed, **options)
    # Equal rows stand in one place of the order; together they have this many copies.
    taken = mixed.groupBy(F.col("place").alias("__at"), "members").agg(F.sum("copies").cast("int").alias("__copies"), F.count(F.lit(1)).cast("int").alias("__rows")).filter("__copies > 0").withColumnRenamed("members", "__from")
    place = place_of(id_col, text_col, seed)
    joined = docs.withColumns({"__place": place, "__members": member_list(docs, members)}).join(taken, (F.col("__place") == F.col("__at")) & F.col("__members").eqNullSafe(F.col("__from")))
    joined = written(joined.drop("__at", "__from"), "mixed")
    one = Window.partitionBy("__place", "__members").orderBy("__place")
    once = joined.filter("__rows = 1").withColumn("__n", F.col("__copies"))
    more = joined.filter("__rows > 1").withColumn("__n", (F.floor(F.col("__copies") / F.col("__rows")) + (F.row_number().over(one) <= F.col("__copies") % F.col("__rows")).cast("int")).cast("int"))
    return once.unionByName(more).filter("__n > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


_DOCS = f"""docs as (
  select doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, source,
         md5('11|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as place
  from documents
), sources as (
  select source, sum(size)::double as size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight
  from docs group by source
), ordered as (
  select *, row_number() over (order by size * 3 / weight, source nulls last) as nth,
         sum(size * 3) over (order by size * 3 / weight, source nulls last) as caps,
         sum(weight) over (order by size * 3 / weight, source nulls last) as weights,
         sum(size) over () as total, sum(weight) over () as all_weights
  from sources
), level as (  -- the first level at which no further source is above three times its size
  select coalesce(max(nth) filter (where size * 3 / weight < (total - (caps - size * 3)) / (all_weights - (weights - weight))), 0) as capped from ordered
), shared as (
  select source, size, total, weight, nth, nth <= (select capped from level) as stops,
         total - coalesce(sum(size * 3) filter (where nth <= (select capped from level)) over (), 0) as rest,
         sum(weight) filter (where nth > (select capped from level)) over () as free
  from ordered
), targets as (
  select source, size::bigint as source_size, case when stops then size * 3 else rest * weight / free end as target from shared
), lines as (
  select d.*, t.source_size, t.target, round_even(t.target, 0)::bigint as flow,
         coalesce(sum(d.size) over (partition by d.source order by d.place rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from docs d join targets t on d.source is not distinct from t.source
)"""

_FITS = " + ".join(f"({lap} * source_size + before + size <= flow)::int" for lap in range(3))

OP3_SQL = f"""with {_DOCS}, based as (
  select *, case when size = 0 then 0 else {_FITS} end as base from lines
), gaps as (
  select *, flow - sum(base * size) over (partition by source) as gap from based
), picked as (
  select *, row_number() over (partition by source order by case when size > 0 and base < 3 and size < 2 * gap then abs(gap - size) end nulls last, place, before) = 1
            and size > 0 and base < 3 and size < 2 * gap as fills
  from gaps
)
select doc_id, size, source_size, target, (size * (base + fills::int))::bigint as taken, (base + fills::int)::int as copies from picked"""
