"""Operator 2: Brown class-based bigram model, and text scores.

P(text) is the product over words of P(class | class before) * P(word | class), ended by an end token that
is a class of its own and stands before the first word. Exchange clustering assigns the classes of the `units` most
frequent words: word by word, each moves to the class that raises the likelihood of the class bigrams most,
sum of N(c, d) log N(c, d) less the marginals, whose counts follow each move. The contexts of words (counts of
classes before and behind) come from the corpus once a round; the next round's counts tell the likelihood itself, and a round that
did not raise it is taken back by halves. Every other training word, however rare, then moves to the class that
its own contexts make likeliest, so what is gathered grows with the corpus: its words' contexts, as a distributed table.

Emissions are each word's own: (n + 1) / (words in class + types in class), where the class of most words seen
once has one type more, for a word not seen; transitions are smoothed towards the classes' shares. All probabilities add up to one.

Scale. Word counts are one shuffle of per-task counts. The `dictionary` most frequent words (not longer
than 256 bytes) are numbers in the encoded documents and broadcast with their classes and counts: bounded by parameters;
all further words find class and count by a join. Rounds run over encoded documents written
once; what they return to the driver is units x classes counts, whatever the input.

Defined cases: null text is empty and scores its end token; a null doc_id counts as an empty string for the
split; repeated rows are documents of their own; without training documents an unseen word and the end are equally likely;
very long texts are read whole; ties between words go by their bytes, so reruns agree.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, small_batches, table, text_bytes, written

#: Numbers of the end token and of words that are not in the dictionary.
END, RARE = (1 << 32) - 1, (1 << 32) - 2
LONGEST = 256


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary, lower case), n. texts: text (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(text.lower().split())
                if len(counts) > 600_000:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
        if counts:
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    return texts.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The words of the highest classes of frequency (32 for each doubling) that together are at most `most`, by count and
    then bytes, and their counts. Classes are counted first, so no task or driver sorts more words than these."""
    level = F.floor(F.log2("n") * 32).cast("int")
    short = vocabulary.filter(F.length("word") <= LONGEST)
    sizes = sorted(short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["level"])
    least, total = None, 0
    for r in sizes:
        if total + r["words"] > most:
            break
        least, total = r["level"], total + r["words"]
    if least is None:
        return [], np.empty(0)
    top = short.filter(level >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.float64)


def encoded(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """rid, doc_id, held_out, n_words, units (32 bits a word: its place among words, or RARE) and rare (the words that are RARE, in
    their order); written to the shared folder. docs: doc_id, held_out, text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = {w: i for i, w in enumerate(shared.value)}.get
        for batch in batches:
            out = []
            for text in batch["text"]:
                w = text.lower().split()
                u = np.array([get(x, RARE) for x in w], dtype=np.uint32)
                out.append((len(w), u.tobytes(), [w[i] for i in np.flatnonzero(u == RARE).tolist()]))
            got = pd.DataFrame(out, columns=["n_words", "units", "rare"])
            yield pd.concat([batch.drop(columns=["text"]).reset_index(drop=True), got], axis=1)

    rows = docs.select("doc_id", "held_out", "text").mapInPandas(run, f"doc_id {kind}, held_out boolean, n_words int, units binary, rare array<binary>")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "units")


def _sequence(units: list[bytes], end: int, kind) -> np.ndarray:
    """END, the first text's units, END, the next text's units, ..., END."""
    mark = np.array([end], dtype=kind).tobytes()
    return np.frombuffer(mark + mark.join(units) + mark, dtype=kind)


def _classed(s: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """The class of each unit; k for all without one, k + 1 for END."""
    of = np.append(classes, k)
    return np.where(s == END, k + 1, of[np.minimum(s, len(classes))])


def contexts(train: DataFrame, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the classes behind and before each unit (units x (k + 2)), of a unit behind itself, and of all class pairs.
    Class k is that of all other words, k + 1 that of END."""
    n, width = len(classes), k + 2
    parts = np.cumsum([0, n * width, n * width, n, width * width])
    shared = train.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(parts[-1], dtype=np.int64)
        for batch in batches:
            s = _sequence(list(batch["units"]), END, np.uint32)
            c = _classed(s, shared.value, k)
            here = np.flatnonzero(s < n)
            at = s[here].astype(np.int64) * width
            out[: parts[1]] += np.bincount(at + c[here + 1], minlength=n * width)
            out[parts[1] : parts[2]] += np.bincount(at + c[here - 1], minlength=n * width)
            out[parts[2] : parts[3]] += np.bincount(s[here[s[here] == s[here + 1]]], minlength=n)
            out[parts[3] :] += np.bincount(c[:-1] * width + c[1:], minlength=width * width)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"at": at.astype(np.int64), "n": out[at]})

    got = train.select("units").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(parts[-1])
    for part in got.to_batches(max_chunksize=100_000):
        out[part.column("at").to_numpy()] = part.column("n").to_numpy()
    del got
    release()
    behind, before, own, pairs = np.split(out, parts[1:-1])
    return behind.reshape(n, width), before.reshape(n, width), own, pairs.reshape(width, width)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300)) * (x > 0)


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for what no class decides: sum of N log N over pairs less that over both marginals."""
    return float(xlogx(pairs).sum() - xlogx(pairs.sum(0)).sum() - xlogx(pairs.sum(1)).sum())


def exchange(behind: np.ndarray, before: np.ndarray, own: np.ndarray, pairs: np.ndarray, classes: np.ndarray, k: int, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Moves one unit after another to the class that raises the likelihood most. Returns the classes and each unit's gain.

    pairs follows every move; a unit's contexts stay as they were counted, although its neighbours may have moved since."""
    classes, n, each = classes.copy(), pairs.copy(), np.arange(k)
    unit = np.arange(len(classes))
    r_, l_ = behind.copy(), before.copy()
    r_[unit, classes] -= own  # a unit next to itself moves with itself
    l_[unit, classes] -= own
    out, into = n.sum(1), n.sum(0)
    logs, gains = xlogx(n), np.zeros(len(classes))

    def put(w: int, c: int, sign: int) -> None:
        n[c] += sign * r_[w]
        n[:, c] += sign * l_[w]
        n[c, c] += sign * own[w]
        out[c] += sign * (r_[w].sum() + own[w])
        into[c] += sign * (l_[w].sum() + own[w])
        into[:] += sign * r_[w]
        out[:] += sign * l_[w]
        logs[c], logs[:, c] = xlogx(n[c]), xlogx(n[:, c])

    for _ in range(sweeps):
        moved = False
        for w in range(len(classes)):
            r, l, s, a = r_[w], l_[w], own[w], int(classes[w])  # noqa: E741
            if r.sum() + s == 0:
                continue
            put(w, a, -1)
            d = n[each, each]
            rows, columns = xlogx(n[:k] + r) - logs[:k], xlogx(n[:, :k].T + l) - logs[:, :k].T
            gain = rows.sum(1) - rows[each, each] + columns.sum(1) - columns[each, each] + xlogx(d + r[:k] + l[:k] + s) - xlogx(d)
            o, i = out[:k] + l[:k], into[:k] + r[:k]
            gain -= xlogx(o + r.sum() + s) - xlogx(o) + xlogx(i + l.sum() + s) - xlogx(i)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            gains[w] += gain[b] - gain[a]
            moved |= b != a
            classes[w] = b
            put(w, b, 1)
        if not moved:
            break
    return classes, gains


def seeded(train: DataFrame, n_units: int, k: int, wide: int = 128, steps: int = 12) -> np.ndarray:
    """Classes to begin with: units by their contexts among the `wide` most frequent units, next to seeds that lie far from each other."""
    wide = min(wide, n_units)
    behind, before, _, _ = contexts(train, np.where(np.arange(n_units) < wide, np.arange(n_units), wide - 1), max(wide, 1))
    x = np.concatenate((behind, before), axis=1)
    every = x.sum(0) + 1e-3
    every /= every.sum()
    often = np.flatnonzero(x.sum(1) > 0)[: 8 * k]  # the most frequent units are the candidates for seeds
    if not len(often):
        return np.zeros(n_units, dtype=np.int64)

    def logs(sums: np.ndarray) -> np.ndarray:
        own = sums + 5 * every
        return np.log(own / own.sum(1, keepdims=True))

    per = x[often] / x[often].sum(1, keepdims=True)
    seeds, best = [0], (per * (logs(x[often]) - logs(x[often[:1]]))).sum(1)
    while len(seeds) < min(k, len(often)):
        seeds.append(int(best.argmax()))
        best = np.minimum(best, (per * (logs(x[often]) - logs(x[often[seeds[-1:]]]))).sum(1))
    classes = (x @ logs(x[often[seeds]]).T).argmax(1)
    for _ in range(steps):
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, classes, x)
        now = (x @ logs(sums).T).argmax(1)
        if (now == classes).all():
            break
        classes = now
    return classes


def cluster(train: DataFrame, n_units: int, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of units, their class pairs, and the likelihood after each round that raised it, the first being that of `seeded`."""
    classes = seeded(train, n_units, k)
    counts = contexts(train, classes, k)
    best, trial, gains = [likelihood(counts[3])], None, None
    for _ in range(rounds):
        if trial is None:
            trial, gains = exchange(*counts, classes, k)
        changed = np.flatnonzero(trial != classes)
        if not len(changed):
            break
        seen = contexts(train, trial, k)
        if (now := likelihood(seen[3])) > best[-1]:
            classes, counts, trial = trial, seen, None
            best.append(now)
        else:  # only the half of the moves that gained most
            back = changed[np.argsort(-gains[changed], kind="stable")[len(changed) // 2 :]]
            trial = trial.copy()
            trial[back] = classes[back]
    return classes, counts[3], best


def assigned(train: DataFrame, words: list[bytes], classes: np.ndarray, pairs: np.ndarray, k: int) -> DataFrame:
    """word, n, class of every training word but the units, by the classes of the units (and ends) before and behind it; written."""
    width, top = k + 2, len(classes)
    shared = train.sparkSession.sparkContext.broadcast((words, classes))

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, of = shared.value
        index: dict[bytes, int] = {}  # words outside the dictionary, numbered behind it
        codes: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            rare = list(index)
            word = [known[i] if i < len(known) else rare[i - len(known)] for i in (code // (2 * width)).tolist()]
            out = pd.DataFrame({"word": word, "at": (code % (2 * width)).astype(np.int16), "n": n.astype(np.int64)})
            codes.clear()
            index.clear()
            return out

        for batch in batches:
            s = _sequence(list(batch["units"]), END, np.uint32)
            c = _classed(s, of, k)
            at, rare_at = np.flatnonzero((s >= top) & (s < RARE)), np.flatnonzero(s == RARE)
            rare = np.fromiter((index.setdefault(w, len(known) + len(index)) for words in batch["rare"] for w in words), dtype=np.int64, count=len(rare_at))
            who, where = np.concatenate((s[at].astype(np.int64), rare)), np.concatenate((at, rare_at))
            codes += [who * 2 * width + c[where - 1], who * 2 * width + width + c[where + 1]]
            if len(index) > 400_000 or sum(map(len, codes)) > 4_000_000:
                yield flush()
        if codes:
            yield flush()

    # Log probabilities of a context given the word's class: of the class behind it, and of the class before it.
    p = pairs + 0.5
    logs = np.concatenate((np.log(p[:k] / p[:k].sum(1, keepdims=True)), np.log(p[:, :k].T / p[:, :k].T.sum(1, keepdims=True))), axis=1)
    order = np.concatenate((logs[:, width:], logs[:, :width]), axis=1).T  # before, then behind

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, sizes = np.zeros((len(batch), 2 * width)), [len(r) for r in batch["seen"]]
            seen = np.concatenate(batch["seen"].to_list())
            x[np.repeat(np.arange(len(batch)), sizes), seen % 1024] = seen // 1024
            yield pd.DataFrame({"word": batch["word"], "n": x[:, :width].sum(1).astype(np.int64), "class": (x @ order).argmax(1).astype(np.int32)})

    each = train.select("units", "rare").mapInPandas(events, "word binary, at short, n long").groupBy("word", "at").agg(F.sum("n").alias("n"))
    seen = each.groupBy("word").agg(F.collect_list(F.col("n") * 1024 + F.col("at")).alias("seen"))
    return written(seen.mapInPandas(best, "word binary, n long, class int"), "classes")


def tagged(rows: DataFrame, others: DataFrame, classes: np.ndarray, log_counts: np.ndarray, unseen: int) -> DataFrame:
    """rid, doc_id, held_out, n_words, classes (a byte for each word), logs (of counts + 1) and known (words seen in training); written."""
    found = rows.select(F.col("rid").alias("r"), F.posexplode("rare").alias("nth", "word")).join(others.withColumnRenamed("class", "c"), "word", "left")
    # As many entries as the document has words outside the dictionary.
    by_doc = found.groupBy("r").agg(
        F.collect_list(F.col("nth").cast("long") * 256 + F.coalesce("c", F.lit(unseen))).alias("of"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more"), F.count("n").alias("more_known")
    )
    shared = rows.sparkSession.sparkContext.broadcast((classes.astype(np.uint8), log_counts))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, logs = shared.value
        for batch in batches:
            out = []
            for units, rare, more, more_known in zip(batch["units"], batch["of"], batch["more"], batch["more_known"], strict=True):
                u = np.frombuffer(units, dtype=np.uint32)
                known = u[u != RARE]
                c = np.zeros(len(u), dtype=np.uint8)
                c[u != RARE] = of[known]
                total, seen = float(logs[known].sum()), len(known)
                if rare is not None and len(rare):
                    c[np.flatnonzero(u == RARE)[rare // 256]] = rare % 256
                    total, seen = total + more, seen + int(more_known)
                out.append((c.tobytes(), total, seen))
            yield pd.concat([batch[["rid", "doc_id", "held_out", "n_words"]].reset_index(drop=True), pd.DataFrame(out, columns=["classes", "logs", "known"])], axis=1)

    both = rows.select("rid", "doc_id", "held_out", "n_words", "units").join(by_doc, F.col("rid") == F.col("r"), "left").drop("r")
    return written(both.mapInPandas(run, f"rid long, doc_id {kind}, held_out boolean, n_words int, classes binary, logs double, known long"), "tagged")


def transitions(train: DataFrame, k: int) -> np.ndarray:
    """Counts of class pairs, (k + 1) x (k + 1), class k being END."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((k + 1) ** 2, dtype=np.int64)
        for batch in batches:
            c = _sequence(list(batch["classes"]), k, np.uint8).astype(np.int64)
            n += np.bincount(c[:-1] * (k + 1) + c[1:], minlength=(k + 1) ** 2)
        yield pd.DataFrame({"at": np.arange((k + 1) ** 2, dtype=np.int64), "n": n})

    got = train.select("classes").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((k + 1) ** 2)
    out[got["at"].to_numpy(dtype=int)] = got["n"].to_numpy()
    return out.reshape(k + 1, k + 1)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", k: int = 32, units: int = 8192, dictionary: int = 262_144, rounds: int = 4, pull: float = 10.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row; trained on the rows not held out. At most 254 classes."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(text_col).alias("text"))
    vocabulary = written(word_counts(own.filter(~F.col("held_out"))), "vocabulary")
    known, counts = frequent(vocabulary, dictionary)
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
    rows = encoded(own, known)
    release()
    train = rows.filter(~F.col("held_out"))
    n_docs = float(train.count())
    n_units = min(units, len(known))
    classes, pairs, _ = cluster(train, n_units, k, rounds)
    others = assigned(train, known, classes, pairs, k)
    # The classes of the dictionary's words beyond the units come to the driver: dictionary rows at most.
    rest = {w: i + n_units for i, w in enumerate(known[n_units:])}
    least = float(counts[-1]) if len(counts) else 0.0
    of = np.concatenate((classes, np.zeros(len(rest), dtype=np.int64)))
    if rest:
        got = others.filter((F.col("n") >= least) & (F.length("word") <= LONGEST)).select("word", "class").toArrow()
        for w, c in zip(got.column("word").to_pylist(), got.column("class").to_pylist(), strict=True):
            if w in rest:
                of[rest[w]] = c
    discard(vocabulary)
    # Words, types and types seen once of each class.
    sizes = others.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    n, types, once = np.bincount(of[:n_units], weights=counts[:n_units], minlength=k + 1), np.bincount(of[:n_units], minlength=k + 1).astype(float), np.zeros(k + 1)
    for r in sizes:
        n[r["class"]] += r["n"]
        types[r["class"]] += r["types"]
        once[r["class"]] += r["once"]
    n[k], types[k] = n_docs, float(n_docs > 0)
    unseen = int(once[:k].argmax())
    log_counts = np.log10(counts + 1)
    done = tagged(rows, others, of, log_counts, unseen)
    discard(rows, others)
    moves = transitions(done.filter(~F.col("held_out")), k)
    tokens, distinct = float(sums["n"] or 0) + n_docs, float(sums["types"]) + float(n_docs > 0)
    weight = n + types + (np.arange(k + 1) == unseen) + (np.arange(k + 1) == k)
    move = np.log10(np.maximum(moves + pull * weight / weight.sum(), 1e-300) / (moves.sum(1, keepdims=True) + pull))
    emit = -np.log10(np.maximum(weight, 1))
    emit[k] = 0.0  # the end is its class's only token
    # A token costs move[class before, class] + emit[class] + log10(count + 1); the end only the move.
    model = spark.sparkContext.broadcast(move + emit)
    kind = done.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cost = model.value
        for batch in batches:
            c = _sequence(list(batch["classes"]), k, np.uint8)
            at = np.concatenate(([0], np.cumsum(batch["n_words"].to_numpy(dtype=np.int64) + 1)[:-1]))
            out = batch[["doc_id", "held_out", "n_words", "logs", "known"]].copy()
            out["path"] = np.add.reduceat(cost[c[:-1], c[1:]], at)
            yield out

    paths = done.select("doc_id", "held_out", "n_words", "logs", "known", "classes").mapInPandas(run, f"doc_id {kind}, held_out boolean, n_words int, logs double, known long, path double")
    n_tokens = F.col("n_words").cast("long") + 1
    out = paths.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("known") + int(n_docs > 0)).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(n_docs + 1)) - n_tokens * float(np.log10(tokens + distinct + 1))).alias("base_score"), (F.col("path") + F.col("logs")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2(spark, sf_dir: str) -> DataFrame:
    own = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(table(spark, sf_dir, "documents"), own)
