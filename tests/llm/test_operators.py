"""The operators against brute force, on planted and odd rows."""

import base64
import hashlib
import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, embed, langid, licences, packing, quality, queries, toxicity, vec, warc

DATA = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a", "a\x00b", "<|endoftext|> x", "ﬀ😀 é́ 漢字", "word " * 30_000, "z" * 5_000, "a\r\n\tb  c", "a", "a"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def same(df, sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert same(queries.QUERIES[name](spark, DATA), queries.SQL[name])


def test_bpe_odd_texts(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN, offsets=True), RANKS, PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id] or ""
        assert list(r.ids) == own.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.decoded_text == text
        assert len(r.starts) == len(r.ends) == len(r.ids) and (not r.ids or (r.starts[0], r.ends[-1]) == (0, len(text)))
    assert bpe.encode(docs.where("false"), RANKS, PATTERN).count() == 0


def test_bpe_split_character(spark):
    ranks = bpe.read_ranks(RANKS)
    part = spark.createDataFrame([(1, [ranks[b"a"], ranks[b"\xe6"]]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: (bytes(r.decoded), r.decoded_text) for r in bpe.decode(part, RANKS, PATTERN).collect()}
    assert got == {1: (b"a\xe6", "a\ufffd"), 2: (b"", ""), 3: (b"", "")}


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(langid.sample(docs, queries.remainder(3) != 1, "doc_id", "lang", "text"))
    odd = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), model).collect()}
    assert len(odd) == len(ODD)
    for i, t in enumerate(ODD):
        assert (odd[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= odd[i].score <= 1
    held = [(r.lang, r.lang_pred) for r in langid.predict(docs.where(queries.remainder(3) == 1), model).join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id").select(F.col("l").alias("lang"), "lang_pred").collect() if r.lang]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    none = langid.train(langid.sample(docs.where("false"), F.lit(True), "doc_id", "lang", "text"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_licences(spark):
    plain = [f"The committee number {i} met by the river and spoke of boats and weather." for i in range(60)]
    planted = {60: "Licensed under the Apache License, Version 2.0.", 61: "some text\nSPDX-License-Identifier: MIT\nmore", 62: None, 63: "", 64: "He has a driving license and permission to park."}
    docs = documents(spark, [*plain, *planted.values()])
    found = {r.doc_id: (r.family, r.line_no, r.confirmed) for r in licences.scan(docs, licences.train(docs)).collect()}
    assert found[60] == ("apache-2.0", 0, True) and found[61] == ("mit", 1, True)
    assert set(found) <= {60, 61, 64} and not found.get(64, (0, 0, False))[2]
    assert licences.scan(docs.where("false"), licences.train(docs.where("false"))).count() == 0


def test_licences_without_cue_and_wrapped(spark):
    plain = [f"The committee number {i} met by the river and spoke of boats and weather.\nThen they went home, tired of talk.\n\nThe end of day {i}." for i in range(60)]
    mit = "Permission is hereby granted,\nfree of charge, to any person\nobtaining a copy of this software and\nassociated documentation files"
    planted = ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', "some text\n\nDistributed under GPLv3 or later", "CC-BY-4.0", f"A heading\n\n{mit}\n\nmore text"]
    docs = documents(spark, [*plain, *planted])
    found = {}
    for r in licences.scan(docs, licences.train(docs)).collect():
        found.setdefault(r.doc_id, []).append((r.family, r.line_no, r.confirmed))
    assert found == {60: [("mit", 0, True)], 61: [("gpl", 2, True)], 62: [("cc-by", 0, True)], 63: [("mit", 2, True)]}


def test_licences_wrapped_word_by_word(spark):
    """A template with one or two words a line, in a block of other lines, is one find."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    words = licences.TEMPLATES["mit"][0].split()
    around = ["tall trees grow", "near the river", "all year round"]
    planted = ["\n".join([*around, *(" ".join(words[i : i + k]) for i in range(0, len(words), k)), *around]) for k in (1, 2)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(60 + i, t) for i, t in enumerate(planted)], "doc_id long, text string"))
    found = {}
    for r in licences.scan(docs, licences.train(docs)).where("doc_id >= 60").collect():
        found.setdefault(r.doc_id, []).append((r.family, r.line_no <= 4, r.template_share > 0.9))
    assert found == {60: [("mit", True, True)], 61: [("mit", True, True)]}


def test_licences_runs_by_brute_force():
    """Runs are those of the docstring."""
    lines = ["", "a", "b b b", "a", "a a", "", *["w"] * 50, " ", "w " * 40, "x", "y " * 30, "z", "z", "z " * 9]
    want, n_words = set(), [len(x.split()) for x in lines]
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if all(n_words[i : j + 1]):
                whole = (i == 0 or not n_words[i - 1]) and (j + 1 == len(lines) or not n_words[j + 1])
                if j - i < licences.RUN or whole or sum(n_words[i + 1 : j]) <= licences.WITHIN:
                    want.add((i, j - i + 1))
    (block,) = vec.texts(pa.array(["\n".join(lines)]))
    doc, line, n, lo, hi = licences.paragraphs(block, licences.grams(block)[0])
    got = list(zip(line.tolist(), n.tolist(), strict=True))
    assert set(got) == want and len(got) == len(want)
    assert all(block.data[a:b].tobytes().decode() == "\n".join(lines[i : i + k]) for i, k, a, b in zip(line, n, lo, hi, strict=True))


def test_licences_of_more_families(spark):
    plain = [f"The committee number {i} met by the river and spoke of boats and weather.\nMit.\nBy.\n" for i in range(60)]
    planted = [t for ts in licences.TEMPLATES.values() for t in ts]
    docs = documents(spark, [*plain, *planted])
    found = {r.doc_id: (r.family, r.confirmed) for r in licences.scan(docs, licences.train(docs)).collect()}
    want = {60 + i: (f, True) for i, f in enumerate(f for f, ts in licences.TEMPLATES.items() for _ in ts)}
    assert {k: v for k, v in found.items() if k < 60} == {} and sum(found.get(k) == v for k, v in want.items()) >= 0.9 * len(want)


def test_licences_negatives_are_of_the_scored_lines(spark, monkeypatch):
    plain = [f"The committee number {i} met by the river and spoke of boats and weather." for i in range(60)]
    docs = documents(spark, [*plain, *["He has a driving license and permission to park."] * 5, "Licensed under the Apache License, Version 2.0.", "Zz\n\n "])
    found = {r.doc_id: r.family for r in licences.scan(docs, licences.train(docs)).collect()}
    assert found == {65: "apache-2.0"}
    taken = []
    monkeypatch.setattr(licences, "Classifier", taken.append)
    licences.train(docs, negatives=1000)
    licences.train(docs, negatives=7)
    every, seven = ([run[0] for run in x] for x in taken)
    assert sorted(every) == sorted({*plain, "He has a driving license and permission to park.", "Licensed under the Apache License, Version 2.0.", "Zz"}) and seven == every[:7]


def test_toxicity(spark):
    rng = random.Random(3)
    calm = [" ".join(rng.choices("river boat green tree walk small house evening".split(), k=30)) for _ in range(80)]
    bad = [t.replace("boat", "vrexling", 2) + " vrexling" for t in calm]
    rows = spark.createDataFrame([(t, 0) for t in calm] + [(t, 1) for t in bad], "text string, y int")
    model = toxicity.learn(rows)
    asked = ["the vrexling walks home in the evening", "the vr3xling walks", "the boat walks home in the evening", None, "", "calm " * 50_000]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    empty = toxicity.learn(rows.where("false"))
    assert toxicity.score(spark.createDataFrame([(1, "the boat")], "doc_id long, text string"), empty).first().predicted == 0
    assert toxicity.score(rows.select(F.lit(1).alias("doc_id"), "text").where("false"), model).count() == 0


@pytest.mark.parametrize("clean,toxic,hits", [(3000, 400, 9), (50, 1, 1), (1, 50, 2), (5000, 5, 40)])
def test_curve_settles(clean, toxic, hits):
    x = toxicity.features(np.array([0.0] * clean + [3.0 * hits] * toxic), np.array([0] * clean + [hits] * toxic), np.full(clean + toxic, 300))
    w = toxicity.fit_logistic(x, np.array([0.0] * clean + [1.0] * toxic))
    p = 1 / (1 + np.exp(-x @ w))
    assert np.isfinite(w).all() and (p[:clean] < 0.5).all() and (p[clean:] > 0.5).all()


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = []
    for i, label in itertools.product(range(60), (0, 1)):
        rows.append((2 * i + label, (base[i % 12] + rng.normal(size=16) * 0.05).astype("float32").tolist(), label))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 16, 0), (505, [float("nan")] * 16, 0), (506, [None] + [1.0] * 15, 0), (507, [], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    fine = [(i, np.array(e, float), y) for i, e, y in rows if i < 502]
    links = {i: {j for j, b, z in fine if i != j and y == z and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98} for i, a, y in fine}
    first = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, near in links.items():
            first[i] = min([first[i], *(first[j] for j in near)])
    want = {i: (len(links.get(i, ())), first[i], first[i] == i) for i, _, _ in rows}
    assert set(got) == set(want)
    assert sum(n for n, _, _ in got.values()) >= 0.9 * sum(n for n, _, _ in want.values()) > 0
    assert all(got[i][0] <= want[i][0] for i in want) and all(got[i] == want[i] for i in range(502, 508))


def test_quality_odd_texts(spark):
    docs = documents(spark, ODD, lambda i: None if i % 2 else "en").withColumn("kept", F.lit(7))
    got = quality.quality(docs).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got) and {r.text for r in got} == set(ODD)
    assert quality.quality(docs.where("false")).count() == 0


def test_warc(spark):
    html = ["<p>x</p>", "<p>x</p>", "", None, "é" * 100_000, "<p>y</p>", "<p>x</p>", "WARC/1.1\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 3 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    index = warc.write(pages)
    got = {r.page_id: r for r in warc.read(index).collect()}
    for i, h in enumerate(html):
        data = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))
    assert len(got) == len(html) and warc.read(warc.write(pages.where("false"))).count() == 0
    assert warc.read(index.where(F.col("page_id") == 4)).count() == 1


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        sizes = sorted(rng.sample(range(1, 60), 8))
        count = [rng.randint(1, 9) for _ in sizes]
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in zip(sizes, count, strict=True))
        best = min(cost([*c, sizes[-1]]) for k in range(3) for c in itertools.combinations(sizes[:-1], k))
        assert cost(packing.boundaries(np.array(sizes), np.array(count), 3)) == best


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, None, 5, 700, rng.randint(1, 90_000), rng.randint(1, 300)])) for i in range(600)] + [(None, 5), (3, 5), (3, 5)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), budget=10_000, shard_rows=50).collect()
    assert sorted((r.doc_id or -1, r.length or 0) for r in got) == sorted((i or -1, n or 0) for i, n in rows)
    batches = {}
    for r in got:
        assert (r.bucket is None) == (not r.length) and (not r.length or r.length <= r.bound)
        if r.length:
            batches.setdefault((r.bucket, r.batch), []).append(r.bound)
    assert all(sum(b) <= 10_000 or len(b) == 1 for b in batches.values())
    for k in {b for b, _ in batches}:
        own = [len(v) for (b, _), v in sorted(batches.items()) if b == k]
        assert len(set(own[:-1])) <= 1 and [n for b, n in sorted(batches) if b == k] == list(range(len(own)))


def test_bounds_of_binned_lengths(spark):
    rng = random.Random(6)
    lengths = [rng.randint(65, 3_000) for _ in range(400)]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), buckets=3).collect()
    sizes = sorted(set(lengths))
    bounds = packing.boundaries(np.array(sizes), np.array([lengths.count(n) for n in sizes]), 3)
    assert sum(r.bound for r in got) <= sum(min(b for b in bounds if b >= n) for n in lengths) * (1 + 1 / 64)


def test_packing_counts_tokens(spark, tmp_path):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = [*ODD, "漢字かな" * 500]
    docs = documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: len(own.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert want[len(texts) - 1] > 100
    assert {r.doc_id: r.length for r in queries.op10_packing(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()} == want


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    texts += [texts[0], texts[1] + " extra", None, "", "too short"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(12)) and all(r.batch is not None for r in out)
    documents(spark, texts).where("false").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASH = ("g_lang", "g_source", "m_symbols", "low_symbols", "shard", "rank", "before", "q_shard", "at", "label2", "h1", "weight", "node")


def clashing(df):
    return df.withColumns({c: F.lit(999) for c in CLASH if c not in df.columns})


def test_clashing_names(spark):
    docs = clashing(documents(spark, ["word " * 60, None, "", "b"]))
    judged = quality.quality(docs)
    assert judged.columns == [*docs.columns, *quality.COUNTS, "base_failed", "kept"] and {r.m_symbols for r in judged.collect()} == {999}
    assert quality.quality(docs, keep_text=False).count() == 4
    packed = packing.pack(docs.withColumn("length", F.lit(5).cast("long")))
    assert packed.columns == [*docs.columns, "length", "bucket", "bound", "batch"] and {(r.shard, r["rank"], r.q_shard) for r in packed.collect()} == {(999, 999, 999)}
    scored = toxicity.score(docs, toxicity.learn(spark.createDataFrame([], "text string, y int")))
    assert {r.weight for r in scored.collect()} == {0.0} and scored.count() == 4
    none = langid.train(langid.sample(docs.where("false"), F.lit(True), "doc_id", "lang", "text"))
    assert langid.predict(docs, none).select("g_lang").distinct().collect() == [(999,)]
    assert licences.scan(docs, licences.train(docs)).count() == 0
    pages = clashing(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")).withColumns({"sha": F.lit("a"), "last": F.lit(1), "n": F.lit(2)})
    assert sorted((r.page_id, r.record_type) for r in warc.read(warc.write(pages)).collect()) == [(1, "revisit"), (2, "response")]
    vectors = clashing(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")).withColumns({"id": F.lit(7), "v": F.lit(8), "d": F.lit(9)})
    assert sorted(map(tuple, embed.near_vectors(vectors).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_empty_tables(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0
    assert embed.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    none = langid.train(spark.createDataFrame([], "lang string, text string, aside boolean"))
    assert langid.predict(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_repeated_ids_of_different_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 1.0], 0)]
    got = sorted(map(tuple, embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).distinct().collect()))
    assert got == [(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_decode_of_odd_ids(spark):
    ranks = bpe.read_ranks(RANKS)
    rows = spark.createDataFrame([(1, [ranks[b"a"], None, -1, 10**8, ranks[b"b"]])], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(rows, RANKS, PATTERN).first().decoded) == b"ab"


def test_encoding_around_white_space(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(9)
    texts = ["".join(rng.choices(" \u00a0\u2028\n\t\x1c\x85aé'sll9漢!.", k=rng.randint(0, 30))) for _ in range(3000)] + ["it's  fine we'll go 've x"]
    codec = bpe.Codec.of(RANKS, PATTERN)
    want = [own.encode_ordinary(t) for t in texts]
    assert [x.tolist() for x in codec.encode(texts)] == want and codec.count(texts) == [len(x) for x in want]
    rows = bpe.digest(bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string"), RANKS, PATTERN), RANKS, PATTERN)).collect()
    for r in rows:
        joined = ",".join(map(str, want[r.doc_id])).encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), hashlib.sha256(joined).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_prediction_is_a_text_s_own(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(langid.sample(docs, F.lit(True), "doc_id", "lang", "text"))
    alone = langid.predict(spark.createDataFrame([(1, "ÉCOLE ÎLE")], "doc_id long, text string"), model).first()
    beside = langid.predict(spark.createDataFrame([(0, "İstanbul"), (1, "ÉCOLE ÎLE")], "doc_id long, text string").coalesce(1), model).where("doc_id = 1").first()
    assert alone == beside


def test_kneser_ney_by_hand():
    """The probabilities of a model against plain counting with dictionaries."""
    text = "abracadabra abba " * 3 + "cab"
    symbols = np.array([ord(c) if c != " " else 1 for c in text], np.uint64)
    grams = langid._grams(symbols, np.array([0, len(symbols)]))
    model = langid.Model(*np.unique(grams, return_counts=True))
    padded = [1] * (langid.ORDER - 1) + [int(x) for x in symbols]
    tops = [tuple(padded[i : i + langid.ORDER]) for i in range(len(symbols))]
    counts = {langid.ORDER: {g: tops.count(g) for g in set(tops)}}
    for m in range(langid.ORDER - 1, 0, -1):
        ends = [g[-m:] for g in counts[m + 1]]
        counts[m] = {g: ends.count(g) for g in set(ends)}

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 64)
        c = counts[len(g)]
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = [v for h, v in c.items() if h[:-1] == g[:-1]]
        return p(g[1:]) if not own else max(c.get(g, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * p(g[1:])

    for g in [*set(tops), (97, 97, 97, 97, 99), (1, 1, 1, 1, 122), tops[7][:4] + (122,)]:
        packed = sum(x << (langid.BITS * (langid.ORDER - 1 - i)) for i, x in enumerate(g))
        assert abs(model.logp(np.array([packed], np.uint64))[0] - np.log(p(g))) < 1e-4


def test_matches_against_every_entry():
    rng = random.Random(8)
    lexicon = {"idio": 2.0, "bad ": 1.0, "bads": 3.0, "白 痴 ": 2.5, "zzz": 1.0}
    model = toxicity.Matcher(lexicon)
    for _ in range(300):
        words = rng.choices(["idiot", "idi", "bad", "badly", "badsy", "白痴", "白", "trash", "can", "clown", "fish", "Bád", "1diot", "zzzz", "clownfish"], k=8)
        text = " ".join(words)
        plain = " " + " ".join(toxicity.WORD.findall(toxicity.fold(text))) + " "
        spared = {i for e in toxicity.EXCEPTIONS for i in range(len(plain)) if plain.startswith(f" {e} ", i) for i in range(i, i + len(e) + 1)}
        found = {}
        for i, c in enumerate(plain):
            if c == " " and i not in spared:
                own = [w for e, w in lexicon.items() if plain.startswith(" " + e, i)]
                if own:
                    found[i] = max(own)
        assert model(text) == (sum(found.values()), len(found), len(plain.split()))


def test_bounds_of_many_lengths():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 5000, 300))
    count = rng.integers(1, 50, len(sizes))
    total = np.concatenate(([0], np.cumsum(count)))
    best = np.full(len(sizes) + 1, np.inf)
    best[0] = 0
    for _ in range(6):
        best = np.array([0] + [min(best[i] + (total[j] - total[i]) * sizes[j - 1] for i in range(j)) for j in range(1, len(sizes) + 1)])
    bounds = packing.boundaries(sizes, count, 6)
    assert sum(n * min(b for b in bounds if b >= s) for s, n in zip(sizes, count, strict=True)) == best[-1]
