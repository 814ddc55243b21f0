"""Operator 8: language identification as a mixture of languages.

Training counts byte trigrams (of words between blanks, lower case) per language over every labelled
training text; the table has 65,536 slots per language, so it is small whatever the corpus. A document is
a bag of words, each with a likelihood under every language (its trigrams' product, tempered by the number
of trigrams). Expectation-maximisation estimates the proportions of a set of languages; sets are built
from the single best language by adding the language that gains most, as long as the log likelihood gains
more than `penalty` * log(words). The largest proportion names the document.

Defined cases: null or letterless text gives `und` with score 0; null labels teach nothing; without any
label every text is `und`; equal proportions go to the first language in code-point order; repeated rows
get the same answer each and teach once a row; texts are read whole, in slices of bounded size (a text is never cut).
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

SLOTS = 1 << 16
#: Everything in ASCII but the letters parts words; A-Z become a-z; bytes of other scripts stay.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER = re.compile(r"[^\W\d_]")
#: Words looked at together; a batch of texts is worked through in slices of about so many bytes.
SLICE_BYTES = 4_000_000


def trigrams(buffer: bytes) -> np.ndarray:
    """Slots of the trigrams that begin at each byte but the last two."""
    b = np.frombuffer(buffer, dtype=np.uint8).astype(np.uint32)
    x = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    return (x ^ x >> np.uint32(15)) >> np.uint32(16)


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > SLICE_BYTES:
            yield a, i
            a, n = i, 0
        n += len(t)
    if a < len(texts):
        yield a, len(texts)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, own in batch.groupby("lang"):
            texts = list(own["text"])
            for a, b in slices(texts):
                buffer = b" " + b" ".join(texts[a:b]).translate(CLEAN) + b" "
                if len(buffer) > 2:
                    counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(buffer), minlength=SLOTS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pd.DataFrame({"lang": lang, "slot": at.astype(np.int32), "n": c[at].astype(np.int64)})


def train(labelled: DataFrame, max_languages: int = 1000, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and log P(slot | language). labelled: text (binary), lang.

    At most max_languages x 65,536 counts reach the driver; more labels are an error."""
    rows = labelled.filter("lang is not null and length(text) > 0").mapInPandas(_count, "lang string, slot int, n long")
    sums = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))
    found = sums.limit(max_languages + 1).toPandas()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = sorted(found["lang"])
    logp = np.zeros((len(langs), SLOTS))
    for _, r in found.iterrows():
        logp[langs.index(r["lang"])][np.asarray(r["slots"], dtype=int)] = r["ns"]
    logp = np.log((logp + alpha) / (logp.sum(1, keepdims=True) + alpha * SLOTS)) if langs else logp
    return langs, logp.astype(np.float32)


def _em(w: np.ndarray, at: np.ndarray, doc: np.ndarray, n: np.ndarray, use: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over the used languages and log likelihoods of documents whose words w begin at at."""
    p = use / use.sum(1, keepdims=True)
    for _ in range(rounds):
        x = w * p[doc]
        x /= np.maximum(x.sum(1, keepdims=True), 1e-300)
        p = np.add.reduceat(x, at, axis=0) / n[:, None]
    mass = (w * p[doc]).sum(1)
    return p, np.add.reduceat(np.log(np.maximum(mass, 1e-300)), at)


def proportions(texts: list[bytes], logp: np.ndarray, penalty: float = 1.5, rounds: int = 8) -> np.ndarray:
    """Proportions of the selected languages, a row for each text; zeros where a text has no word."""
    k = len(logp)
    out = np.zeros((len(texts), k))
    buffer = b" " + b" \n ".join(t.translate(CLEAN) for t in texts) + b" "
    raw = np.frombuffer(buffer, dtype=np.uint8)
    blank = (raw == 32) | (raw == 10)
    begin = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
    if not len(begin) or not k:
        return out
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1  # the blank after it
    ends_doc = np.flatnonzero(raw == 10)
    doc_of = np.searchsorted(ends_doc, begin)
    slots = trigrams(buffer)
    size = np.maximum(end - begin - 1, 1)  # trigrams within blank + word + blank
    w = np.empty((len(begin), k))
    for i in range(k):
        sums = np.concatenate(([0.0], np.cumsum(logp[i][slots], dtype=np.float64)))
        w[:, i] = (sums[np.minimum(begin + size, len(slots))] - sums[begin]) / np.sqrt(size)
    best = w.max(1, keepdims=True)
    w = np.exp(w - best)
    docs, at, n = np.unique(doc_of, return_index=True, return_counts=True)
    row = np.repeat(np.arange(len(docs)), n)
    single = np.add.reduceat(np.log(np.maximum(w, 1e-300)), at, axis=0)
    first = single.argmax(1)
    use = np.zeros((len(docs), k), dtype=bool)
    use[np.arange(len(docs)), first] = True
    p, ll = use.astype(float), single[np.arange(len(docs)), first]
    cost = penalty * np.log(n + 1.0)
    # No mixture has a likelihood above that of the best language for each word, which is 0 here.
    open_ = np.flatnonzero(-ll > cost) if k > 1 else np.empty(0, dtype=int)
    while len(open_):
        mine = np.isin(row, open_)
        sub_n = n[open_]
        sub_at = np.concatenate(([0], np.cumsum(sub_n)[:-1]))
        sub_row = np.repeat(np.arange(len(open_)), sub_n)
        sub_w = w[mine]
        got_ll, got_p, got = np.full(len(open_), -np.inf), np.zeros((len(open_), k)), np.zeros(len(open_), dtype=int)
        for i in range(k):
            may = use[open_].copy()
            new = ~may[:, i]
            may[:, i] = True
            q, l2 = _em(sub_w, sub_at, sub_row, sub_n, may.astype(float), rounds)
            better = new & (l2 > got_ll)
            got_ll[better], got_p[better], got[better] = l2[better], q[better], i
        more = got_ll - ll[open_] > cost[open_]
        took = open_[more]
        use[took, got[more]] = True
        p[took], ll[took] = got_p[more], got_ll[more]
        open_ = took[(-ll[took] > cost[took]) & ~use[took].all(1)]
    out[docs] = p
    return out


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray, keep: list[str], penalty: float = 1.5) -> DataFrame:
    """keep columns, lang_pred, score, and the selected languages with their proportions. docs has text (binary or null) among its columns."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, model = shared.value
        for batch in batches:
            texts = [t or b"" for t in batch["text"]]
            p = np.concatenate([proportions(texts[a:b], model, penalty) for a, b in slices(texts)]) if texts else np.zeros((0, len(names)))
            top = p.argmax(1) if names else np.zeros(len(texts), dtype=int)
            known = [bool(names) and p[i, top[i]] > 0 and LETTER.search(t.decode("utf-8", "replace")) is not None for i, t in enumerate(texts)]
            out = batch[keep].copy()
            out["lang_pred"] = [names[top[i]] if ok else "und" for i, ok in enumerate(known)]
            out["score"] = [float(min(1.0, p[i, top[i]])) if ok else 0.0 for i, ok in enumerate(known)]
            out["languages"] = [[names[j] for j in np.flatnonzero(p[i] > 0)] if ok else [] for i, ok in enumerate(known)]
            out["shares"] = [[float(x) for x in p[i][p[i] > 0]] if ok else [] for i, ok in enumerate(known)]
            yield out

    kept = docs.select(*keep).schema.simpleString()[len("struct<") : -1]
    return docs.select(*keep, "text").mapInPandas(run, f"{kept}, lang_pred string, score double, languages array<string>, shares array<double>")


def op8(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("text"), "lang", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out")
    )
    langs, logp = train(docs.filter(~F.col("held_out")).select("text", "lang"))
    return identify(docs, langs, logp, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))
