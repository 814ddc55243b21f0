"""Operator 10: near-duplicate passages by compact windows.

A text is its sequence of word-shingle hashes. For each of two hash functions the Cartesian tree of that
sequence (the least hash is the root, what lies before and behind are its subtrees) groups all runs by their
min-hash: the nodes whose subtrees hold at least `core` shingles are the compact windows, and a run belongs to
the window of its least hash. An interval join of both functions' windows within the text leaves the cells whose
runs share the signature (both min-hashes and their distance): one key a cell, about 4n / core of them.

What is near: runs of t = min_words - 4 shingles of which `need` (similarity 0.8: 41 of 46) stand in the other
text. Two gaps between matches cost more shingles than that leaves over, so the matches are two runs at most and
one of them has core = need / 2 shingles: any near passage shares a cell, whatever the word that differs.

Texts with a shared key are compared with one centre, the least text of the group, where the anchors of a pair
are verified on the full shingle sequences. A centre may hold less of a passage than two others share, so members of
a group that no verified span covers get a second centre (of those that share the shingle core / 2 before or behind theirs too,
which common lines do not), and what is open even then, and has enough shingles that other texts hold, is compared with every
member of its group on the shingles around its anchors, in blocks; groups of over `large` members are first taken apart, by the
rarest shingles of each run, of which any near member holds one. Equal runs of
t shingles that the spans leave uncovered are found by a hash of the whole run.

Result: spans of words in a text that stand in another text too, by a text of lesser hash: the least of those
that share a passage keeps it. A text that equals another as a whole gives one span.

Scale: cells shuffle as 20 bytes; groups are found by partial minima; texts are fetched only where they share a key,
broadcasting names if they are few (`broadcast_keys`). No list of a passage's holders is ever gathered but of
groups of `small` members at most; anchors of a pair are merged by offset, and only the shingles around them
travel, by 32 bits each (in a run of 46 a chance match of these has a probability of some 1e-6).

Defined cases: null or short texts (under `min_words` words) have no span; a key that a text repeats within t
shingles (tables, junk) counts once for each t; repeats within one text are not reported; repeated rows give
equal spans; null ids are carried; very long texts are read whole; the columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, mix, quiet, scratch, shingle_hashes, small_batches, table, text_bytes, tidy, word_hashes, written

WIDTH, MIN_WORDS = 5, 50
#: Positions of one slice of a text, and the bits they take of a packed hash.
SLICE, BITS = 1 << 20, np.uint64(20)


def bounds(min_words: int, percent: int) -> tuple[int, int, int]:
    """t, need and core: the shingles of a passage, how many of them must agree, and the longer of the two runs these make."""
    t = min_words - WIDTH + 1
    need = -(-2 * t * percent // (100 + percent))
    return t, need, -(-need // 2)


def window_hashes(s: np.ndarray, i: int) -> np.ndarray:
    with quiet():
        return mix(s ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))


def centres(h: np.ndarray, t: int) -> np.ndarray:
    """The position of the least of h (the first of equal ones) in every run of t: each is the root of the run's compact window."""
    n = len(h) - t + 1
    if n < 1:
        return np.empty(0, np.int64)
    if len(h) > SLICE:
        step = SLICE - t + 1
        return np.concatenate([a + centres(h[a : a + SLICE], t) for a in range(0, n, step)])
    best, width = h >> BITS << BITS | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= t:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < t:
        best = np.minimum(best[:n], best[t - width : t - width + n])
    return (best & np.uint64(SLICE - 1)).astype(np.int64)


def cells(s: np.ndarray, core: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """key and c (centre of the first hash function) of a text's cells."""
    h, g = window_hashes(s, 0), window_hashes(s, 1)
    c, e = centres(h, core), centres(g, core)
    if not len(c):
        return np.empty(0, np.int64), c
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (e[1:] != e[:-1]))))
    c, e = c[first], e[first]
    with quiet():
        key = mix(h[c] * np.uint64(3) + g[e] * np.uint64(5) + (e - c + core).astype(np.uint64)).view(np.int64)
    if len(np.unique(key)) < len(key):
        keep, last = np.ones(len(key), dtype=bool), {}
        for i, (k, at) in enumerate(zip(key.tolist(), c.tolist(), strict=True)):
            if at - last.get(k, -t) < t:
                keep[i] = False
            else:
                last[k] = at
        key, c = key[keep], c[keep]
    return key, c


def windowed(docs: DataFrame, id_col: str, text_col: str, min_words: int, percent: int) -> DataFrame:
    """doc_id, tid (hash of the text), n_words, key, c; written to the shared folder. A task names a text's cells once."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).select("doc_id", F.xxhash64("text").alias("tid"), "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    t, _, core = bounds(min_words, percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for batch in batches:
            out = []
            for tid, text in zip(batch["tid"], batch["text"], strict=True):
                if (n := seen.get(tid)) is None:
                    w = word_hashes(text)
                    s = shingle_hashes(w, WIDTH) if len(w) >= min_words else np.empty(0, np.uint64)
                    out.append((len(w), *cells(s, core, t)))
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen[tid] = len(w)
                else:
                    out.append((n, (), ()))
            got = pd.DataFrame(out, columns=["n_words", "key", "c"])
            yield pd.concat([batch.drop(columns=["text"]).reset_index(drop=True), got], axis=1)

    return written(own.mapInPandas(tidy(run), f"doc_id {kind}, tid long, n_words int, key array<long>, c array<int>"), "windows")


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def agreed(own: np.ndarray, other: np.ndarray, t: int, need: int) -> list[tuple[int, int]]:
    """Spans of own's shingles covered by runs of t of which need stand in other; they begin and end with a match."""
    if len(own) < t or not len(other):
        return []
    other = np.sort(other)
    hit = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
    sums = np.concatenate(([0], np.cumsum(hit)))
    good = np.flatnonzero(sums[t:] - sums[:-t] >= need)
    if not len(good):
        return []
    mark = np.zeros(len(own) + 1, dtype=np.int32)
    mark[good] += 1
    mark[good + t] -= 1
    out = []
    for p, q in runs(np.cumsum(mark[:-1]) > 0):
        m = np.flatnonzero(hit[p:q])
        out.append((p + int(m[0]), p + int(m[-1]) + 1))
    return out


def either(own: np.ndarray, other: np.ndarray, shift: int, t: int, need: int) -> list[tuple[int, int]]:
    """agreed, or where only other's runs agree with own, the places of their first and last matches in own (shift: own's position less other's)."""
    if got := agreed(own, other, t, need):
        return got
    out = []
    for p, q in agreed(other, own, t, need):
        first, last = np.flatnonzero(own == other[p]), np.flatnonzero(own == other[q - 1])
        a, b = int(first[np.abs(first - p - shift).argmin()]), int(last[np.abs(last - q + 1 - shift).argmin()])
        if a <= b:
            out.append((a, b + 1))
    return out


def run_hashes(s: np.ndarray, t: int) -> np.ndarray:
    """A 64-bit hash of each run of t shingles."""
    with quiet():
        base = np.uint64(0x9E3779B97F4A7C15)
        power, inverse = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(s), b, np.uint64)))) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s * power[:-1])))
        return mix((sums[t:] - sums[:-t]) * inverse[: len(s) - t + 1])


def open_runs(s: np.ndarray, at: list[int], done: list[tuple[int, int]], t: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of the runs of t shingles that no span of done covers and of which each run of core shingles holds a shared centre (of `at`)."""
    if len(s) < t:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.zeros(len(s) + 1, dtype=np.int64)
    sums[np.asarray(at) + 1] = 1
    sums = np.cumsum(sums)
    none = np.concatenate(([0], np.cumsum(sums[core:] == sums[:-core])))
    left = none[t - core + 1 :] == none[: -(t - core + 1)]
    for p, q in done:
        left[p : max(p, q - (t + WIDTH - 1) + 1)] = False
    a = np.flatnonzero(left)
    return (run_hashes(s, t)[a].view(np.int64) if len(a) else np.empty(0, np.int64)), a


def exact_rest(full: DataFrame, keyed: DataFrame, found: DataFrame, t: int, core: int) -> DataFrame:
    """tid, other, start, end of the equal runs of t shingles at shared keys that found leaves in two texts or more."""
    done = found.groupBy(F.col("tid").alias("d")).agg(F.collect_set(F.struct("start", "end")).alias("done"))
    at = keyed.groupBy(F.col("tid").alias("k")).agg(F.collect_set("c").alias("at"))
    some = full.join(at, F.col("tid") == F.col("k")).join(done, F.col("tid") == F.col("d"), "left").select("tid", "s", "at", "done")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s, at, done in zip(batch["s"], batch["at"], batch["done"], strict=True):
                out.append(open_runs(np.frombuffer(s, dtype=np.uint32).astype(np.uint64), list(at), [] if done is None else [(x["start"], x["end"]) for x in done], t, core))
            sizes = [len(a) for _, a in out]
            yield pd.DataFrame({"tid": np.repeat(batch["tid"].to_numpy(), sizes), "run": np.concatenate([h for h, _ in out]), "a": np.concatenate([a for _, a in out]).astype(np.int32)})

    left = written(some.mapInPandas(tidy(run), "tid long, run long, a int"), "open-runs")
    holders = left.groupBy(F.col("run").alias("h")).agg(F.min("tid").alias("other"), F.max("tid").alias("hi")).filter("other != hi").select("h", "other")
    hits = left.join(holders, (F.col("run") == F.col("h")) & (F.col("tid") != F.col("other"))).select("tid", "other", "a")
    island = F.col("a") - F.row_number().over(Window.partitionBy("tid", "other").orderBy("a"))
    return hits.withColumn("island", island).groupBy("tid", "other", "island").agg(F.min("a").alias("start"), (F.max("a") + t + WIDTH - 1).cast("int").alias("end")).drop("island")


def shingled(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, keyed: DataFrame, broadcast_keys: int) -> DataFrame:
    """tid, s (32 bits of each shingle's hash) of the texts that share a key."""
    least = rows.groupBy(F.col("tid").alias("r")).agg(F.min("doc_id").alias("least"))
    asked = written(keyed.select("tid").distinct().join(least, F.col("tid") == F.col("r")).select("tid", "least"), "passage-texts")
    few = asked.limit(broadcast_keys + 1).count() <= broadcast_keys
    bytes_ = text_bytes(text_col)
    texts = docs.select(F.xxhash64(bytes_).alias("h"), F.col(id_col).alias("id"), bytes_.alias("text"))
    found = texts.join(F.broadcast(asked) if few else asked, (F.col("h") == F.col("tid")) & F.col("id").eqNullSafe(F.col("least"))).select("tid", "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"tid": batch["tid"], "s": [half(shingle_hashes(word_hashes(x), WIDTH)).tobytes() for x in batch["text"]]})

    return written(found.mapInPandas(tidy(hashed), "tid long, s binary").dropDuplicates(["tid"]), "passage-shingles")


def half(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)


FOUND = "tid long, other long, start int, end int, offset int"


def verified(met: DataFrame, full: DataFrame, t: int, need: int) -> DataFrame:
    """FOUND, for met: two texts tid, other with their anchors c, d. The greater text names the span."""
    swap = F.col("tid") < F.col("other")
    hi, lo = F.greatest("tid", "other"), F.least("tid", "other")
    p, q = F.when(swap, F.col("d")).otherwise(F.col("c")), F.when(swap, F.col("c")).otherwise(F.col("d"))
    each = met.select(hi.alias("tid"), lo.alias("other"), p.alias("p"), (p - q).alias("o")).repartition("tid", "other")
    offsets = each.groupBy("tid", "other", "o").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    # Of each text only what lies around the anchors travels on: t shingles on each side, and a few more of the other's.
    x, u = F.greatest(F.lit(0), F.col("lo") - t), F.greatest(F.lit(0), F.col("lo") - F.col("o") - t - WIDTH)
    cut = lambda at, end: F.substring(F.col("s"), 4 * at + 1, 4 * (end - at))
    mine = offsets.join(full, "tid").select("tid", "other", "o", "lo", "hi", x.alias("x"), cut(x, F.col("hi") + t + 1).alias("a"))
    both = mine.join(full.select(F.col("tid").alias("other"), "s"), "other").select("tid", "other", "o", "x", "a", u.alias("u"), cut(u, F.greatest(u, F.col("hi") - F.col("o") + t + WIDTH + 1)).alias("b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tid, other, o, x, a, u, b in zip(*(batch[c] for c in ("tid", "other", "o", "x", "a", "u", "b")), strict=True):
                a, b = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
                out += [(tid, other, x + p, x + q + WIDTH - 1, o) for p, q in either(a, b, o - x + u, t, need)]
            yield pd.DataFrame(out, columns=["tid", "other", "start", "end", "offset"])

    return written(both.mapInPandas(tidy(verify), FOUND), "passages")


def marked(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members (key, tid, c) of groups of which one at least is open: no span of its text, or of its part in another's, covers its centre."""
    mine = found.select("tid", "start", "end").union(found.select("other", F.col("start") - F.col("offset"), F.col("end") - F.col("offset")))
    merged = mine.groupBy("tid", "start").agg(F.max("end").alias("end")).groupBy(F.col("tid").alias("d")).agg(F.collect_list(F.struct("start", "end")).alias("done"))
    covered = F.coalesce(F.exists("done", lambda x: (x["start"] <= F.col("c")) & (F.col("c") < x["end"])), F.lit(False))
    return members.join(merged, F.col("tid") == F.col("d"), "left").select("key", "tid", "c", (~covered).alias("open"))


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    now = written(marked(members, found), "members")
    order = F.struct(F.xxhash64("tid", F.lit(2)).alias("o"), "tid", "c")
    groups = now.groupBy(F.col("key").alias("k")).agg(F.max("open").alias("some"), F.count(F.lit(1)).alias("n"), F.min(order).alias("m")).filter("some")
    return now.join(groups, F.col("key") == F.col("k")).select("key", "tid", "c", "open", "n", F.col("m.tid").alias("other"), F.col("m.c").alias("d"))


def closer(members: DataFrame, found: DataFrame, full: DataFrame, core: int) -> DataFrame:
    """The members (key, tid, c, open) of groups with an open one, by finer keys: with the shingle core / 2 before their centre, and
    with that behind it. Of a shared run of core shingles one of the two is part, while a common line shorter than that has neither."""
    reach = core // 2
    now = marked(members, found)
    some = now.groupBy(F.col("key").alias("k")).agg(F.max("open").alias("some")).filter("some").select("k")
    now = written(now.join(some, F.col("key") == F.col("k"), "left_semi"), "members")

    def finer(key: int, c: int, is_open: bool, s: np.ndarray) -> list[tuple]:
        at = np.array([x for x in (c - reach, c + reach) if 0 <= x < len(s)], dtype=np.int64)
        with quiet():
            keys = mix(s[at].astype(np.uint64) * np.uint64(1 << 20 | 1) + np.uint64(key % (1 << 64)) + (at < c).astype(np.uint64))
        return [(k, c, is_open) for k in keys.view(np.int64).tolist()]

    each = written(by_text(now, full, finer, "key long, c int, open boolean"), "closer")
    groups = each.groupBy(F.col("key").alias("k")).agg(F.max("open").alias("some"), F.min("tid").alias("lo"), F.max("tid").alias("hi")).filter("some and lo != hi").select("k")
    return each.join(groups, F.col("key") == F.col("k")).select("key", "tid", "c", "open")


def living(members: DataFrame, full: DataFrame, t: int, need: int) -> DataFrame:
    """The members (key, tid, c, open) that can be near to anything, of groups that still have an open one, with n, the group's size.

    A shingle that no other text of these groups holds matches nothing. A member with less than need (but two, for passages that
    agree in one direction only) others in every run of t around its centre is left out: in a family of copies whose edits
    are their own, most of what is open."""
    texts = full.join(members.select(F.col("tid").alias("k")).distinct(), F.col("tid") == F.col("k")).select("tid", "s")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.unique(np.frombuffer(s, dtype=np.int32)) for s in batch["s"]]
            yield pd.DataFrame({"tid": np.repeat(batch["tid"].to_numpy(), [len(x) for x in own]), "sh": np.concatenate(own)})

    each = written(texts.mapInPandas(tidy(distinct), "tid long, sh int"), "shingles")
    held = each.groupBy(F.col("sh").alias("h")).agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).filter("lo != hi").select("h")
    shared = each.join(held, F.col("sh") == F.col("h"), "left_semi").groupBy(F.col("tid").alias("k")).agg(F.collect_list("sh").alias("held"))
    some = members.groupBy(F.col("tid").alias("m")).agg(F.collect_list(F.struct("key", "c", "open")).alias("some"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tid, s, held, some in zip(batch["tid"], batch["s"], batch["held"], batch["some"], strict=True):
                sums = np.concatenate(([0], np.cumsum(np.isin(np.frombuffer(s, dtype=np.int32), held))))
                good = np.concatenate(([0], np.cumsum(sums[t:] - sums[:-t] >= need - 2)))
                at = np.array([x["c"] for x in some])
                live = good[np.minimum(at + 1, len(good) - 1)] > good[np.clip(at - t + 1, 0, len(good) - 1)]
                out += [(x["key"], tid, x["c"], x["open"]) for x, yes in zip(some, live, strict=True) if yes]
            yield pd.DataFrame(out, columns=["key", "tid", "c", "open"])

    rows = texts.join(shared, F.col("tid") == F.col("k")).join(some, F.col("tid") == F.col("m")).select("tid", "s", "held", "some")
    live = written(rows.mapInPandas(tidy(run), "key long, tid long, c int, open boolean"), "living")
    discard(each)
    groups = live.groupBy(F.col("key").alias("k")).agg(F.max("open").alias("some"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count(F.lit(1)).alias("n")).filter("some and lo != hi").select("k", "n")
    return live.join(groups, F.col("key") == F.col("k")).select("key", "tid", "c", "open", "n")


def compared(own: list[tuple], t: int, need: int, first: list[tuple] | None = None) -> list[tuple]:
    """FOUND rows that join members (tid, c, open, at, shingles), or such of first and own, if one of the two is open.

    Shingles that several members hold are columns; an open member is tested against all others at once, by gathered columns
    and sums over runs of t, in both directions. Spans are worked out for what joins members not joined yet, or gives the
    greater of the two its first span."""
    rows = own if first is None else first + own
    sizes = np.array([len(x[4]) for x in rows])
    longest = int(sizes.max())
    if longest < t:
        return []
    _, place, held = np.unique(np.concatenate([x[4] for x in rows]), return_inverse=True, return_counts=True)
    column = np.where(held > 1, np.cumsum(held > 1), 0)[place]  # 0: held by one member, or padding
    at = np.zeros((len(rows), longest), dtype=np.int64)
    at[np.arange(longest)[None, :] < sizes[:, None]] = column
    has = np.zeros((len(rows), int(column.max()) + 1), dtype=bool)
    np.put_along_axis(has, at, True, axis=1)
    has[:, 0] = False
    n = len(first) if first is not None else 0
    open_, tids = np.array([x[2] for x in rows]), np.array([x[0] for x in rows])

    def near(hits: np.ndarray) -> np.ndarray:
        sums = np.zeros((hits.shape[0], longest + 1), dtype=np.int16)
        np.cumsum(hits, axis=1, out=sums[:, 1:])
        return (sums[:, t:] - sums[:, :-t]).max(axis=1) >= need

    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out, named = [], set()
    for i in np.flatnonzero(open_).tolist():
        others = np.arange(len(rows)) if first is None else (np.arange(n, len(rows)) if i < n else np.arange(n))
        others = others[tids[others] != tids[i]]
        if not len(others):
            continue
        for j in others[near(has[others][:, at[i]]) | near(has[i][at[others]])].tolist():
            more, less = (i, j) if tids[i] > tids[j] else (j, i)
            if (p := find(i)) == (q := find(j)) and more in named:
                continue
            a, b = rows[more], rows[less]
            if got := either(a[4], b[4], a[3] - b[3], t, need):
                root[max(p, q)] = min(p, q)
                named.add(more)
                out += [(a[0], b[0], a[1] - a[3] + k, a[1] - a[3] + e + WIDTH - 1, a[1] - b[1]) for k, e in got]
    return out


def by_text(members: DataFrame, full: DataFrame, f, schema: str) -> DataFrame:
    """f(key, c, open, shingles) of the members of each text, a list of rows after the tid."""
    some = members.groupBy(F.col("tid").alias("k")).agg(F.collect_list(F.struct("key", "c", "open")).alias("some"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tid, some, s in zip(batch["tid"], batch["some"], batch["s"], strict=True):
                s = np.frombuffer(s, dtype=np.uint32)
                for x in some:
                    out += [(tid, *row) for row in f(x["key"], x["c"], x["open"], s)]
                    if len(out) >= 4096:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    names = ["tid"] + [x.split()[0] for x in schema.split(", ")]
    return full.join(some, F.col("tid") == F.col("k")).select("tid", "some", "s").mapInPandas(tidy(run), f"tid long, {schema}")


def around(reach: int):
    """For by_text: the shingles around a member's centre, and the centre's place among them."""

    def run(key: int, c: int, is_open: bool, s: np.ndarray) -> list[tuple]:
        lo = max(0, c - reach)
        return [(key, c, is_open, c - lo, s[lo : c + reach + 1].tobytes())]

    return run


AROUND = "key long, c int, open boolean, at int, s binary"


def rarest(s: np.ndarray, held: dict, t: int, need: int) -> np.ndarray:
    """The t - need + 1 least held shingles of each run of t, where t - need at most are held by no other member.

    Of any t - need + 1 shingles of a run, a text that has need of its t holds one: no near member is without one of these."""
    f = np.array([held.get(x, 1) for x in s.tolist()])
    if len(f) < t:
        return s[:0]
    spare = t - need
    windows = np.lib.stride_tricks.sliding_window_view(f, t)
    begin = np.flatnonzero((windows == 1).sum(axis=1) <= spare)
    if not len(begin):
        return s[:0]
    least = np.argpartition(windows[begin], spare, axis=1)[:, : spare + 1] + begin[:, None]
    return np.unique(s[least[f[least] > 1]])


def apart(members: DataFrame, full: DataFrame, t: int, need: int) -> tuple[DataFrame, DataFrame]:
    """(FOUND of members with equal surroundings; members (key, tid, c, open) by finer keys) of groups, with all that compared finds in them.

    Members that agree in all shingles around their centres are linked with their least, which stands for them. The others meet
    those with whom they share a shingle that is among the rarest of a run (see rarest) of the one or the other."""
    local = written(by_text(members, full, around(t + WIDTH), AROUND), "large")
    least = local.groupBy(F.col("key").alias("k"), F.col("at").alias("p"), F.col("s").alias("z")).agg(F.min(F.struct("tid", "c")).alias("m"), F.max("open").alias("some"))
    equal = local.filter("open").join(least, (F.col("key") == F.col("k")) & (F.col("at") == F.col("p")) & (F.col("s") == F.col("z"))).filter((F.col("tid") != F.col("m.tid")) & (F.length("s") >= 4 * t))
    begin = F.col("c") - F.col("at")
    equal = written(equal.select("tid", F.col("m.tid").alias("other"), begin.alias("start"), (begin + F.length("s") / 4 + WIDTH - 1).cast("int").alias("end"), (F.col("c") - F.col("m.c")).alias("offset")), "equal")
    own = written(least.select(F.col("k").alias("key"), F.col("m.tid").alias("tid"), F.col("m.c").alias("c"), F.col("some").alias("open"), F.col("z").alias("s")), "variants")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [np.unique(np.frombuffer(s, dtype=np.int32)) for s in batch["s"]]
            sizes = [len(x) for x in each]
            yield pd.DataFrame({"key": np.repeat(batch["key"].to_numpy(), sizes), "tid": np.repeat(batch["tid"].to_numpy(), sizes), "c": np.repeat(batch["c"].to_numpy(), sizes), "sh": np.concatenate(each)})

    each = written(own.mapInPandas(tidy(distinct), "key long, tid long, c int, sh int"), "surroundings")
    counts = each.groupBy(F.col("key").alias("k"), F.col("sh").alias("h")).agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    held = each.join(counts, (F.col("key") == F.col("k")) & (F.col("sh") == F.col("h"))).groupBy(F.col("key").alias("k"), F.col("tid").alias("x"), F.col("c").alias("y")).agg(F.collect_list(F.struct("sh", "f")).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, tid, c, is_open, s, held in zip(*(batch[x] for x in ("key", "tid", "c", "open", "s", "held")), strict=True):
                by = {x["sh"]: x["f"] for x in held}
                few = set(rarest(np.frombuffer(s, dtype=np.int32), by, t, need).tolist())
                out += [(key, tid, c, is_open, sh, sh in few) for sh in by]
            yield pd.DataFrame(out, columns=["key", "tid", "c", "open", "sh", "rare"])

    rows = own.join(held, (F.col("key") == F.col("k")) & (F.col("tid") == F.col("x")) & (F.col("c") == F.col("y"))).select("key", "tid", "c", "open", "s", "held")
    shares = written(rows.mapInPandas(tidy(run), "key long, tid long, c int, open boolean, sh int, rare boolean"), "shares")
    discard(local, own, each)
    groups = shares.groupBy(F.col("key").alias("k"), F.col("sh").alias("h")).agg(
        F.max(F.col("open") & F.col("rare")).alias("asks"), F.max("open").alias("some"), F.max("rare").alias("asked"), F.min("tid").alias("lo"), F.max("tid").alias("hi")
    ).filter("some and asked and lo != hi").select("k", "h", "asks")
    met = shares.join(groups, (F.col("key") == F.col("k")) & (F.col("sh") == F.col("h")))
    # An open member's own rarest shingles against all that hold them; and every member's rarest ones against the open members that hold them.
    finer = lambda i: F.xxhash64("key", "sh", F.lit(i)).alias("key")
    mine = met.filter("asks").select(finer(0), "tid", "c", (F.col("open") & F.col("rare")).alias("open"))
    theirs = met.filter("open or rare").select(finer(1), "tid", "c", "open")
    return equal, written(mine.union(theirs), "finer")


def residue(members: DataFrame, full: DataFrame, t: int, need: int, small: int, block: int, large: int) -> DataFrame:
    """FOUND, for what is open: each open member (key, tid, c, open, n) against all others of its group, by the shingles around their centres.

    Groups of over `large` members (a common phrase, say) are taken apart without loss; groups are compared in blocks, whatever their size."""
    few = members.filter(F.col("n") <= large).select("key", "tid", "c", "open")
    most = members.filter(F.col("n") > large)
    equal = None
    if most.limit(1).count():
        equal, finer = apart(most.select("key", "tid", "c", "open"), full, t, need)
        few = few.union(finer)
    sizes = few.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("o"))
    local = written(by_text(few, full, around(t + WIDTH), AROUND).join(sizes, F.col("key") == F.col("k")).drop("k"), "around")

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own in batch["own"]:
                out += compared([(x["tid"], x["c"], x["open"], x["at"], np.frombuffer(x["s"], dtype=np.uint32)) for x in own], t, need)
            yield pd.DataFrame(out, columns=["tid", "other", "start", "end", "offset"])

    # As many tasks as the session has for a shuffle: the groups are small in bytes, but not in work.
    tasks = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = local.filter(F.col("n") <= small).repartition(tasks, "key").groupBy("key").agg(F.collect_list(F.struct("tid", "c", "open", "at", "s")).alias("own")).select("own").mapInPandas(tidy(lists), FOUND)

    def blocks(own: pd.DataFrame) -> pd.DataFrame:
        sides = [[(r.tid, r.c, r.open, r.at, np.frombuffer(r.s, dtype=np.uint32)) for r in own[own["side"] == k].itertuples()] for k in (0, 1)]
        if own["same"].iloc[0]:
            got = compared(sides[0], t, need)
        else:
            got = compared(sides[1], t, need, sides[0]) if sides[0] and sides[1] else []
        return pd.DataFrame(got, columns=["tid", "other", "start", "end", "offset"])

    # Open members have blocks of their own, which come first; the others meet these alone.
    of, rest = F.ceil(F.col("o") / block).cast("int"), F.ceil((F.col("n") - F.col("o")) / block).cast("int")
    place = F.when(F.col("open"), F.pmod(F.xxhash64("tid", F.lit(3)), of)).otherwise(of + F.pmod(F.xxhash64("tid", F.lit(3)), F.greatest(rest, F.lit(1))))
    blocked = local.filter((F.col("n") > small) & (F.col("o") > 0)).withColumn("own", place.cast("int"))
    cut = blocked.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("open"), of + rest).otherwise(of) - 1)))
    cut = cut.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), (F.col("own") == F.col("with")).alias("same"), "tid", "c", "open", "at", "s")
    many = cut.repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(blocks, FOUND)
    found = found.union(many) if equal is None else found.union(many).union(equal)
    out = written(found.distinct(), "residue")
    discard(local)
    return out


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = 80, small: int = 256, block: int = 256, large: int = 8192, broadcast_keys: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, n_words of every row; tid, other, start, end of every repeated passage by text)."""
    t, need, core = bounds(min_words, percent)
    with scratch(docs.sparkSession) as keep:
        windows = windowed(docs, id_col, text_col, min_words, percent)
        rows = written(windows.select("doc_id", "tid", "n_words"), "texts")
        each = windows.select("tid", F.explode(F.arrays_zip("key", "c")).alias("w")).select("w.key", "tid", "w.c")
        middle = each.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("tid", "c")).alias("m"), F.max("tid").alias("hi"), F.count(F.lit(1)).alias("n")).filter("m.tid != hi")
        keyed = written(each.join(middle, F.col("key") == F.col("k")).select("key", "tid", "c", "n", F.col("m.tid").alias("other"), F.col("m.c").alias("d")), "keyed")
        discard(windows)
        full = shingled(docs, id_col, text_col, rows, keyed, broadcast_keys)
        found = verified(keyed.filter("tid != other"), full, t, need)
        # A group of two members has been compared; larger ones may hold members that are near to others than their centre.
        now = closer(keyed.filter("n > 2").select("key", "tid", "c").distinct(), found, full, core)
        now = written(still_open(now.select("key", "tid", "c"), found), "open")
        found = written(found.union(verified(now.filter("open and tid != other"), full, t, need)), "found")
        now = still_open(now.select("key", "tid", "c"), found).select("key", "tid", "c", "open")
        now = written(living(written(now, "open"), full, t, need), "alive")
        found = written(found.union(residue(now, full, t, need, small, block, large)).select("tid", "other", "start", "end"), "found")
        rest = written(exact_rest(full, keyed, found, t, core), "exact-passages")
        for df in (rows, found, rest):
            keep(df)
    return rows, found.union(rest)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, start, end (words from 0, end not included), other_doc_id: every span of a document that another holds."""
    rows, found = passages(docs, id_col, text_col, **options)
    least = options.get("min_words", MIN_WORDS)
    first = rows.filter(F.col("n_words") >= least).groupBy(F.col("tid").alias("t")).agg(F.min("doc_id").alias("first_id"))
    part = rows.join(found, "tid").join(first, F.col("other") == F.col("t")).select("doc_id", "n_words", "start", "end", F.col("first_id").alias("other_doc_id"))
    whole = rows.join(first, (F.col("tid") == F.col("t")) & (F.col("doc_id") != F.col("first_id"))).select("doc_id", "n_words", F.lit(0).alias("start"), F.col("n_words").alias("end"), F.col("first_id").alias("other_doc_id"))
    return part.unionByName(whole).distinct()


def cut(text: bytes, spans_: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what is left keeps its white space but for the cut's trailing one."""
    import re

    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, last = [], 0
    for a, b in sorted(spans_):
        begin = at[a][0]
        if begin > last:
            out.append(text[last:begin])
        last = max(last, at[b][0] if b < len(at) else len(text))
    out.append(text[last:])
    return b"".join(out).decode("utf-8", "replace")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated passages cut from all texts but the ones that keep them; texts of which no word is left go. Equal texts are left alone: that is document deduplication's task. n_chars follows."""
    _, found = passages(docs, id_col, text_col, **options)
    cuts = found.groupBy(F.col("tid").alias("t")).agg(F.collect_set(F.struct("start", "end")).alias("__cuts"))
    kind = docs.schema

    def run(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([x if c is None or not len(c) else cut(x.encode("utf-8", "surrogatepass"), [(p["start"], p["end"]) for p in c]) for x, c in zip(text, cuts, strict=True)], dtype=object)

    from pyspark.sql.types import StringType

    out = docs.withColumn("__tid", F.xxhash64(text_bytes(text_col))).join(cuts, F.col("__tid") == F.col("t"), "left")
    shorter = F.when(F.col("__cuts").isNotNull(), F.pandas_udf(run, StringType())(F.col(text_col).cast("string"), F.col("__cuts"))).otherwise(F.col(text_col))
    out = out.withColumn(text_col, shorter).filter(F.col("__cuts").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(kind["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
