import random

from pyspark.sql import functions as F

from sawmill.llm import language_id as L

WORDS = {"en": "the and thing with here other about then there which".split(), "de": "der und nicht schön über durch sich auch wäre zwischen".split(), "fr": "les des être où déjà pour avec très leur même".split()}


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(40)), lang))
    return rows


def ready(df):
    return df.select("doc_id", F.col("text").cast("binary").alias("text"), "lang")


def test_accuracy_mixtures_and_edges(spark):
    rows = corpus(spark)
    d = ready(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, logp = L.train(d.filter("doc_id % 5 != 0"))
    assert langs == ["de", "en", "fr"] and logp.shape == (3, L.SLOTS)
    got = {r["doc_id"]: r for r in L.identify(d, langs, logp, ["doc_id"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    rng = random.Random(2)
    both = " ".join(rng.choice(WORDS["en"]) for _ in range(70)) + " " + " ".join(rng.choice(WORDS["de"]) for _ in range(30))
    odd = [(1, both), (2, None), (3, ""), (4, "12 34 !?"), (5, "日本"), (6, "the " * 200_000), (6, "the " * 200_000), (None, "und")]
    out = L.identify(spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text")), langs, logp, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(odd)
    assert set(by[1]["languages"]) == {"de", "en"} and by[1]["lang_pred"] == "en" and abs(by[1]["score"] - 0.7) < 0.1
    assert [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and by[2]["score"] == 0.0
    assert by[5]["lang_pred"] in langs and by[6]["lang_pred"] == "en" and 0 <= by[6]["score"] <= 1
    assert by[None]["lang_pred"] == "de"


def test_slices_agree(spark, monkeypatch):
    d = ready(spark.createDataFrame(corpus(spark, 30), "doc_id long, text string, lang string"))
    langs, logp = L.train(d)
    texts = [r["text"] for r in d.collect()]
    whole = L.proportions([bytes(t) for t in texts], logp)
    parts = [L.proportions([bytes(t)], logp)[0] for t in texts]
    assert abs(whole - parts).max() < 1e-6


def test_nothing_learned(spark):
    d = ready(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    langs, logp = L.train(d)
    assert langs == [] and L.identify(d, langs, logp, ["doc_id"]).first()["lang_pred"] == "und"
    assert L.identify(d.limit(0), langs, logp, ["doc_id"]).count() == 0


def plain_mixture(text: bytes, logp, penalty=1.5, rounds=8):
    """One document word by word: likelihoods, then greedy sets whose proportions a textbook EM estimates."""
    import math

    k = len(logp)
    like = []
    for word in text.translate(L.CLEAN).split():
        padded = b" " + word + b" "
        slots = [int(L.trigrams(padded[i : i + 3])[0]) for i in range(len(padded) - 2)]
        like.append([sum(float(logp[j][x]) for x in slots) / math.sqrt(len(slots)) for j in range(k)])
    if not like:
        return [0.0] * k
    w = [[math.exp(x - max(row)) for x in row] for row in like]

    def fit(use):
        p = [1 / len(use) if j in use else 0.0 for j in range(k)]
        for _ in range(rounds):
            new = [0.0] * k
            for row in w:
                total = max(sum(a * b for a, b in zip(row, p, strict=True)), 1e-300)
                for j in range(k):
                    new[j] += row[j] * p[j] / total / len(w)
            p = new
        return p, sum(math.log(max(sum(a * b for a, b in zip(row, p, strict=True)), 1e-300)) for row in w)

    one = [sum(math.log(max(row[j], 1e-300)) for row in w) for j in range(k)]
    use, ll = {one.index(max(one))}, max(one)
    p = [float(j in use) for j in range(k)]
    while len(use) < k:
        tried = [(fit(use | {j}), j) for j in range(k) if j not in use]
        (q, best), j = max(tried, key=lambda x: x[0][1])
        if best - ll <= penalty * math.log(len(w) + 1):
            break
        use, p, ll = use | {j}, q, best
    return p


def test_mixtures_by_brute_force(spark):
    rng = random.Random(9)
    langs, logp = L.train(ready(spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string")))
    texts = []
    for _ in range(60):
        some = rng.sample(sorted(WORDS), rng.randrange(1, 4))
        texts.append(" ".join(rng.choice(WORDS[rng.choice(some)]) for _ in range(rng.randrange(1, 60))).encode())
    texts += [b"", b"12 !", "the der les".encode(), "zzz qqq".encode()]
    got = L.proportions(texts, logp)
    assert max(abs(a - b) for t, row in zip(texts, got, strict=True) for a, b in zip(plain_mixture(t, logp), row, strict=True)) < 1e-6
    assert sum((row > 0).sum() > 1 for row in got) > 10


def test_clashing_columns_and_repeated_rows(docs, none):
    """Extra columns of the operator's own names do no harm, rows that repeat get the same answer each, ties the first language."""
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "lang", F.lit("x").alias("score"), F.lit("y").alias("lang_pred"), "key")
    langs, logp = L.train(d)
    rows = L.identify(d, langs, logp, ["doc_id"]).collect()
    assert len(rows) == d.count() and {len({r["lang_pred"] for r in rows if r["doc_id"] == i}) for i in {r["doc_id"] for r in rows}} == {1}
    same = L.train(d.sparkSession.createDataFrame([(b"one two", "b"), (b"one two", "a")], "text binary, lang string"))
    out = L.identify(d.sparkSession.createDataFrame([(1, b"one two")], "doc_id long, text binary"), *same, ["doc_id"]).first()
    assert out["lang_pred"] == "a" and out["score"] == 1.0
    assert L.identify(none.select("doc_id", F.col("text").cast("binary").alias("text")), langs, logp, ["doc_id"]).count() == 0
