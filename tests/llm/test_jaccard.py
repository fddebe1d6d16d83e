"""The n-gram Jaccard join against all pairs of shingle sets."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard


def shingles(text, k):
    words = (text or "").lower().split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, num, den):
    sets, root = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rnd.choice([1, 2, 4, 12, 30, 80, 300]))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 4, len(w) // 40, len(w) // 15])):
            at = rnd.randrange(len(w))
            w[at : at + rnd.choice([0, 1])] = [word()] * rnd.choice([1, 1, 2])
        if rnd.random() < 0.2:
            w += passage
        rows.append((i, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, "   "), (903, rows[5][1].upper()), (904, "only"), (905, "ONLY")]


@pytest.mark.parametrize(("seed", "k", "num", "part"), [(1, 3, 90, 1500), (2, 5, 80, 1500), (3, 3, 90, 10), (4, 5, 80, 10)])
def test_brute_force(spark, monkeypatch, seed, k, num, part):
    monkeypatch.setattr(jaccard, "PART", part)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), 3, 90, 100).count() == 0


def test_rows_are_told_apart(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:59], "x"]), "some other words that stand alone"
    rows = [(None, a), (None, c), (7, b), (7, c + " too many"), (7, b), (8, "alone here it stays for ever"), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("clash")).withColumn("node", F.lit(1))
    got = jaccard.jaccard_components(df, 3, 80, 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("None", 58, "7"), ("None", 4, "None"), ("7", 58, "7"), ("7", 6, "7"), ("7", 58, "7"), ("8", 4, "8"), ("9", 0, "9"), ("9", 0, "9")])
    kept = jaccard.first_of_each(df, 3, 80, 100)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", c), ("7", b), ("7", c + " too many"), ("8", "alone here it stays for ever")])
    assert jaccard.first_of_each(df.where("false"), 3, 80, 100).count() == 0
