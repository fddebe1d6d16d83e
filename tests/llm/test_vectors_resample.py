"""Importance resampling, exact top-k and centroid clustering against plain Python, on planted and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import centroids, pivots, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def plain_resample(docs, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, fs in own:
        for f, n in fs.items():
            s[bucket(f)] += n
    for x in target:
        for f, n in features(x)[1].items():
            t[bucket(f)] += n
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for d, words, fs in own:
        weight = sum(gain(bucket(f)) * n for f, n in fs.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, sum(fs.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    most = 5 * len(able) // 100
    rank = {id(r): i + 1 for i, r in enumerate(able[:most])}
    return sorted((tuple([*r[:4], rank.get(id(r))]) for r in rows), key=repr)


def test_resample_odd_rows(spark):
    rng = random.Random(5)
    vocabulary = ["Der", "naïve", "x1", "漢字", "ﬀ", "don't", "a_b", "É", "the", "of", "ZZ9"]
    text = lambda n: rng.choice([" ", "\n", "\x00", "--"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "!?"), (303, "one"), (304, "one two"), (305, "one two three"), (None, text(30)), (None, text(25)), (306, "word " * 40_000), (307, "z" * 200_000 + " a b"), (308, "tie " * 30), (308, "tie " * 30)]
    target = [text(20) for _ in range(10)] + [None, "", "tie tie"]
    df = spark.createDataFrame([(d, t, "x", 1, True) for d, t in docs], "doc_id long, text string, key string, row int, total boolean").repartition(7)
    bench = spark.createDataFrame(list(enumerate(target)), "item_id int, text string")
    got = sorted(map(tuple, resample.resample(df, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain_resample(docs, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100
    none = df.where("false")
    assert resample.resample(none, bench).count() == 0
    assert sorted(map(tuple, resample.resample(df, bench.where("false")).collect()), key=repr) == plain_resample(docs, [])


def test_resample_other_sizes(spark):
    """The counts do not depend on blocks and pieces, and other run lengths and shares hold."""
    docs = [(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 70))) for i in range(200)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "w1 w2 w3 w4")], "item_id long, text string")
    for grams in (1, 2, 4):
        rows = resample.resample(df, bench, share=(1, 2), least_words=10, grams=grams).collect()
        for r in rows:
            n = len(docs[r.doc_id][1].split())
            assert r.n_features == sum(max(0, n - g + 1) for g in range(1, grams + 1))
        ranked = sorted((r.rank, -r.score, r.doc_id) for r in rows if r["rank"])
        assert [r[0] for r in ranked] == list(range(1, sum(len(t.split()) >= 10 for _, t in docs) // 2 + 1)) and ranked == sorted(ranked, key=lambda r: r[1:])


VECTORS = "vec_id long, embedding array<double>, row string, id string, d int"


def plain_whole(v, scale):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(x * scale) for x in v]


def plain_top(rows, every, k):
    own = [(i, w) for i, v in rows if (w := plain_whole(v, 1024))]
    out = []
    for a, (q, x) in enumerate(own):
        if q is None or q % every:
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(s * t for s, t in zip(x, y, strict=True)))), i is None, i or 0) for b, (i, y) in enumerate(own) if a != b and len(x) == len(y)]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_top_k_odd_rows(spark, spread):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, spread) for c in centres[i % 5]]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [None] * 6), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1005, [0.0] * 6), (1010, [0.0] * 6), (None, centres[0]), (20, centres[1]), (20, centres[1]), (1020, [1.0, 2.0]), (1021, [2.0, 1.0]), (1030, [1e300] * 6), (1040, [-3e17] * 6), (1050, [7.5e5] * 6)]
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS).repartition(5)
    asks = df.vec_id % 10 == 0
    got = sorted(map(tuple, pivots.top_k(df, asks, k=10).collect()), key=repr)
    assert got == plain_top(rows, 10, 10)
    assert pivots.top_k(df.where("false"), asks).count() == 0
    assert pivots.top_k(df, df.vec_id < 0).count() == 0


def test_top_k_small_units(spark, monkeypatch):
    """Many units, groups of summaries and blocks of queries give the same rows, and close vectors need few units."""
    monkeypatch.setattr(pivots, "UNIT", 700)
    monkeypatch.setattr(pivots, "GROUP", 3)
    monkeypatch.setattr(pivots, "ASKING", 7)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(10 * (i % 4 == j), 0.1) for j in range(4)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    single = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, pivots.top_k(df, df.vec_id % 20 == 0, k=3, pivots=8).collect()), key=repr) == plain_top(single, 20, 3)


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1.0, 1e3, 1e7):
        x = np.floor(rng.standard_normal((300, 16)) * size)
        x[7], x[8] = x[9], x[9] + 1
        points = np.vstack([np.zeros(16), x[:6]])
        far, norm = pivots.distances_to(x, points).astype(float), (x * x).sum(1)
        for q in range(0, 300, 7):
            assert (pivots.upper(np.abs(far - far[q]), far + far[q], norm, norm[q]) >= x @ x[q]).all()


def plain_clusters(rows, k=40, rounds=5, d=64):
    own = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in own)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in own]
        c = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), a in zip(own, at, strict=True) if a == j]) else m for j, m in enumerate(c)]
    found, top = [(i, *near(v)) for i, v in own], (1 << 63) - 1
    sums = Counter()
    for _, far, j in found:
        sums[j] += min(far, top)
    return sorted(((i, j, min(far, top), min(sums[j], top), min(sum(sums.values()), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, far, j in found), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("size", [1.0, 3e6, 1e12])
def test_clusters(spark, size):
    """In float64, in 64-bit integers and in Python's."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, size) for _ in range(64)]) for i in range(90)]
    rows += [(200, None), (201, [1.0]), (202, [None] * 64), (203, [float("nan")] * 64), (None, [0.5] * 64), (5, rows[5][1]), (6, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS).repartition(5)
    got = sorted(map(tuple, centroids.cluster(df, k=12).select(*COLUMNS).collect()), key=repr)
    assert got == plain_clusters(rows, k=12)
    assert sorted(map(tuple, centroids.cluster(df.where("vec_id < 5"), k=12).select(*COLUMNS).collect()), key=repr) == plain_clusters(rows[:5], k=12)
    assert centroids.cluster(df.where("false")).count() == 0
