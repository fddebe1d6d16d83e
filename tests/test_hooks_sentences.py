"""Tokenizer and model hooks, Punkt, TextTiling, the sparse encoder, and searches for tables of queries, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.functions import hooks
from quarry.functions import text as T
from quarry.operators import chunk, punkt, search, segment
from quarry.sources.store import Options

DATA = "/root/testdata/sf0.001"


def words_with_places(texts):
    return [[m.span() for m in re.finditer(r"\w+|[^\w\s]", t)] for t in texts]


def test_token_windows_by_a_tokenizer(spark):
    by = hooks.tokenizer("words", lambda: lambda texts: [[m.span() for m in re.finditer(r"\w+|[^\w\s]", t)] for t in texts])
    rows = [(i, t) for i, t in enumerate(["one two, three four five six seven eight", "", None, "x", "  a  b ", "é 漢字 " * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, chunk.token_windows(docs, ["doc_id"], 4, 1, 2, raw=True, tokenizer=by).collect()))
    want = []
    for i, t in rows:
        spans = words_with_places([t or ""])[0]
        for lo in range(0, len(spans), 3):
            hi = min(lo + 4, len(spans))
            if hi - lo >= 2 or hi == len(spans):
                want.append((i, lo, hi, t[spans[lo][0] if lo else 0 : spans[lo + 4][0] if lo + 4 < len(spans) else len(t)]))
    assert got == sorted(want)
    # the built-in pieces of four, as a hook, are the built-in windows
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = (sorted(chunk.token_windows(whole, ["doc_id"], tokenizer=t).collect()) for t in (None, hooks.pieces_of_four))
    assert a == b
    assert [r.n for r in docs.select(hooks.count_tokens(F.col("text"), by).alias("n")).collect()] == [len(words_with_places([t or ""])[0]) for _, t in rows]


def test_file_tokenizer_on_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.char_start): (r.char_end, r.chunk) for r in chunk.token_windows(docs, ["doc_id"], 200, 20, 50, raw=True, tokenizer=hooks.file_tokenizer(path)).collect()}
    own, want = Tokenizer.from_file(path), {}
    for d, t in docs.collect():
        spans = own.encode(t, add_special_tokens=False).offsets
        for lo in range(0, len(spans), 180):
            hi = min(lo + 200, len(spans))
            if hi - lo >= 50 or hi == len(spans):
                want[d, lo] = (hi, t[spans[lo][0] if lo else 0 : spans[hi][0] if hi < len(spans) else len(t)])
    assert got == want


def test_a_tokenizer_sees_few_characters_at_a_time(spark):
    """Offsets of 64 texts of any length were with the tokenizer at once, and those of a whole batch were dicts of Python."""
    limit = hooks.AT_ONCE

    def load():
        def encode(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= limit
            return [[(i, i + 2) for i in range(0, len(t), 2)] for t in texts]

        return encode

    docs = spark.range(80).coalesce(1).select("id", F.expr("case id when 7 then null when 9 then '' when 11 then repeat('ab', 200000) else repeat('ab', 5000) end").alias("text"))
    spans = docs.select("id", hooks.tokenizer("twos", load)(F.col("text")).alias("t"))
    got = spans.select("id", F.size("t").alias("n"), F.get("t", F.lit(1)).alias("second"), F.get("t", F.size("t") - 1)["end"].alias("end")).orderBy("id").collect()
    size = {7: 0, 9: 0, 11: 200000}
    assert [(r.n, r.second and tuple(r.second), r.end) for r in got] == [(n, (2, 4) if n else None, 2 * n if n else None) for n in (size.get(i, 5000) for i in range(80))]


def test_model_workers(spark, tmp_path):
    def load():
        import os
        import time

        with open(tmp_path / "loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(pairs):
            with open(tmp_path / "batches", "a") as f:
                f.write(f"{len(pairs)}\n")
            if any(t == "bad" for _, t in pairs):
                raise ValueError("no")
            if any(t == "slow" for _, t in pairs):
                time.sleep(5)
            return [len(q) + len(t) for q, t in pairs]

        return model

    rows = spark.createDataFrame([(i, "x" * i) for i in range(40)] + [(40, "bad"), (48, "slow")] + [(i, "y") for i in (*range(41, 48), *range(49, 56))], "id int, text string").coalesce(1).sortWithinPartitions("id")
    score = hooks.scored_pairs(f"counted{tmp_path}", load, seconds=1.0)
    for _ in range(2):
        got = {r.id: r.s for r in rows.select("id", score(F.lit("qq"), F.col("text")).alias("s")).collect()}
    assert all(got[i].score == i + 2 and got[i].error is None for i in range(40))
    assert got[40].score is None and got[40].error == "ValueError: no" and got[48].score is None and "1.0 s" in got[48].error
    loads, sizes = (open(tmp_path / n).read().split() for n in ("loads", "batches"))
    assert len(loads) == len(set(loads)) and set(sizes) == {"8"}


TEXTS = [
    "Dr. Smith went home. The dog of Mr. Smith slept. It was late! Was it? Yes, it was.",
    "We met Dr. Jones. The cat sat there. The man saw Mr. Brown at home. Prices rose 3.5 per cent. The rest fell.",
    "He paid Dr. Who 5. The bill of J. Smith came late. He said z.B. nothing. The end... Or not.",
    "The time came. The sun rose. The day passed. The moon set. It was late. The man went home. \"The night.\" (It fell.)",
    "They left home and came home again, at home of all, as home is home to them. Their home is home and home is theirs.",
] * 6 + [None, "", "   ", "one", "No. 5 is here. no one saw it."]


def plain_tokens(text):
    out = []
    for raw in re.split(r"[ \t\n\x0b\f\r]+", text or ""):
        if raw:
            bare = re.sub(r"^[(\[{«“‘\"'`]+|[)\]}»”’\"'`]+$", "", raw)
            body = re.sub(r"[.!?,;:]+$", "", bare)
            kind = punkt.NUMBER if re.fullmatch(r"[-+]?[0-9][0-9.,]*", body) else body.lower()
            out.append((raw, kind, bool(re.search(r"[^.]\.$", bare)), body[:1].isupper(), body[:1].islower(), bool(re.search(r"[!?]$|\.\.+$", bare))))
    return out


def plain_punkt(texts):
    """The sentences of each text, decided type by type with counts in dictionaries."""
    ln = lambda x: math.log(max(x, 1e-300))
    like = lambda k, n, p: k * ln(p) + (n - k) * ln(1 - p)
    n, dots, upper, lower, starts, pairs = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    rows = [plain_tokens(t) for t in texts]
    for ts in rows:
        for i, (_, k, dot, up, low, _) in enumerate(ts):
            if k:
                n[k] += 1
                dots[k] += dot
                upper[k] += up
                lower[k] += low
                starts[k] += i > 0 and (ts[i - 1][2] or ts[i - 1][5])
            if dot and k and i + 1 < len(ts) and ts[i + 1][1]:
                pairs[k, ts[i + 1][1]] += 1
    big, all_dots, all_breaks = sum(n.values()), sum(dots.values()), sum(starts.values())

    def dunning(a, b, both):
        p, p1, p2 = b / big, both / a, (b - both) / max(big - a, 1)
        return -2 * (like(both, a, p) + like(b - both, big - a, p) - like(both, a, p1) - like(b - both, big - a, p2))

    short = set()
    for k in n:
        if dots[k] and k != punkt.NUMBER and any(c.isalpha() for c in k):
            inner = k.count(".")
            letters = len(k) - inner
            ratio = -2 * (like(dots[k], n[k], all_dots / big) - like(dots[k], n[k], 0.99))
            if round(ratio * math.exp(-letters) * (inner + 1) * letters ** -(n[k] - dots[k]), 6) >= punkt.ABBREVIATION:
                short.add(k)
    opening = {k for k in n if starts[k] and upper[k] and starts[k] / all_breaks > n[k] / big and round(dunning(all_breaks, n[k], starts[k]), 6) >= punkt.STARTER}
    together = {(a, b) for (a, b), c in pairs.items() if c > 1 and (a in short or a == punkt.NUMBER) and c / n[a] > n[b] / big and round(dunning(n[a], n[b], c), 6) >= punkt.COLLOCATION}
    out = []
    for ts in rows:
        cuts = []
        for i, (_, k, dot, _, _, ended) in enumerate(ts[:-1]):
            _, b, _, capital, _, _ = ts[i + 1]
            initial = len(k) == 1 and k.isalpha()
            opens = capital and (b in opening or (lower[b] > 0 and not initial))
            if ended or (dot and (not (k in short or initial or k == punkt.NUMBER) or (opens and (k, b) not in together))):
                cuts.append(i)
        ends = [*cuts, len(ts) - 1]
        out.append([" ".join(t[0] for t in ts[(ends[j - 1] + 1 if j else 0) : e + 1]) for j, e in enumerate(ends)] if ts else [])
    return out, short, opening, together


def test_punkt(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, type string")
    want, short, opening, together = plain_punkt(TEXTS)
    model = punkt.learn(docs)
    assert {r.type for r in model.abbreviations.collect()} == short >= {"dr", "mr"}
    assert {r.type for r in model.starters.collect()} == opening
    assert {(r.a, r.b) for r in model.collocations.collect()} == together
    found = defaultdict(list)
    for r in punkt.sentences(docs, model, ["doc_id"]).orderBy("doc_id", "sentence_no").collect():
        found[r.doc_id].append(r.sentence)
    assert [found[i] for i in range(len(TEXTS))] == want
    assert want[0][0] == "Dr. Smith went home." and want[2][0].startswith("He paid Dr. Who 5.")
    chunks = chunk.chunked(docs.select(F.col("doc_id").cast("string").alias("source_name"), "text", F.lit(1).alias("page_start"), F.lit(1).alias("page_end")), Options(strategy="sentence", target_tokens=8, min_tokens=1), punkt_model=model)
    assert chunks.where("source_name = '0'").orderBy("text").first().text.startswith("Dr. Smith went home.")
    assert punkt.learn(docs.where("false")).abbreviations.count() == 0


def plain_tiles(sentences, width=20, around=10, apart=4):
    words = [w for s in sentences for w in segment.WORD.findall(s.lower())]
    starts = [sum(len(segment.WORD.findall(x.lower())) for x in sentences[:i]) for i in range(len(sentences))]
    pieces = [words[i : i + width] for i in range(0, len(words), width)]
    gaps = len(pieces) - 1
    if gaps < 2 or len(sentences) < 2:
        return []
    scores = []
    for g in range(gaps):
        n = min(around, g + 1, gaps - g)
        a, b = Counter(sum(pieces[g + 1 - n : g + 1], [])), Counter(sum(pieces[g + 1 : g + 1 + n], []))
        scores.append(sum(a[w] * b[w] for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())))
    smooth = [sum(p) / len(p) for g in range(gaps) for p in [scores[max(0, g - 1) : g + 2]]]
    depth = []
    for g in range(gaps):
        left = right = g
        while left > 0 and smooth[left - 1] >= smooth[left]:
            left -= 1
        while right < gaps - 1 and smooth[right + 1] >= smooth[right]:
            right += 1
        depth.append(smooth[left] + smooth[right] - 2 * smooth[g])
    mean = sum(depth) / gaps
    limit = mean - math.sqrt(sum((x - mean) ** 2 for x in depth) / gaps) / 2
    chosen = []
    for g in sorted(range(gaps), key=lambda g: (-round(depth[g], 12), g)):
        if depth[g] > max(limit, 1e-12) and all(abs(g - c) >= apart for c in chosen):
            chosen.append(g)
    return sorted({min(range(len(starts)), key=lambda k: (abs(starts[k] - (g + 1) * width), k)) for g in chosen} - {0})


def test_tiles_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    some = 0
    for r in docs.collect():
        assert segment.tiles(r.s) == plain_tiles(r.s)
        some += len(segment.tiles(r.s))
    assert some > 100
    topics = ["river boat water mill salt bank flow grain", "vote law court judge party seat rule city", "wheel engine road speed fuel brake driver lane"]
    rng = random.Random(1)
    told = [" ".join(rng.choice(topics[i // 40].split()) for _ in range(9)).capitalize() + "." for i in range(120)]
    assert {min((40, 80), key=lambda k: abs(k - p)) for p in segment.tiles(told) if min(abs(40 - p), abs(80 - p)) <= 3} == {40, 80}
    tiled = segment.standalone(spark.createDataFrame([(1, " ".join(told)), (2, None), (3, "")], "doc_id long, text string"), ["doc_id"], strategy="texttiling", least=1)
    assert tiled.where("doc_id = 1").count() >= 3 and [r.id for r in tiled.where("doc_id = 1").orderBy("id").limit(2).collect()] == ["chunk_00001", "chunk_00002"]
    with pytest.raises(ValueError, match="no strategy"):
        segment.standalone(tiled.select("doc_id", F.col("chunk").alias("text")), ["doc_id"], strategy="none")


def test_sparse_encoder(spark, tmp_path):
    pages = spark.createDataFrame([(f"{i}.txt", t, 1, 1) for i, t in enumerate(["boats boats boats on the river", "mill and river and mill", "salt", "..."])], "source_name string, text string, page_start int, page_end int")
    engine = Engine(spark, str(tmp_path / "s"), Options(strategy="page", top_k_vocab=2), encoder=T.term_weights)
    engine.ingest(pages.limit(2))
    engine.ingest(pages)
    rows = engine.log.read(engine.log.state().of("sparse"), search.SPARSE.format("string"))
    assert {r["count"] for r in rows.groupBy("key").count().collect()} <= {1, 2} and rows.agg(F.max("weight")).first()[0] == math.log1p(3)
    best = [(r.source_name, round(r.score, 6)) for r in engine.search("boats", mode="sparse").orderBy("rank").collect()]
    other = math.log1p(1)
    assert best == [("0.txt", round(math.log1p(3) / math.hypot(math.log1p(3), other), 6))]
    plain = Engine(spark, str(tmp_path / "s"), engine.options)
    words = [r.id for r in plain.search("boats", mode="sparse").orderBy("rank").collect()]
    assert len(words) == 4 and [r.id for r in engine.search(" ", mode="sparse").orderBy("rank").collect()] == [r.id for r in plain.search(" ", mode="sparse").orderBy("rank").collect()]
    near = sorted(r.id for r in engine.search(" ", mode="semantic").collect())
    assert sorted(r.id for r in engine.search(" ", mode="hybrid").collect()) == near  # an empty sparse side, no BM25
    before = rows.orderBy("key", "id").collect()
    engine.rebuild("SPLADE++")
    assert engine.log.read(engine.log.state().of("sparse"), search.SPARSE.format("string")).orderBy("key", "id").collect() == before
    with pytest.raises(ValueError, match="no encoder"):
        plain.rebuild("SPLADE++")


def test_tables_of_queries(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(40)], "doc_id long, text string")
    index = search.extend(docs, str(tmp_path / "i"))
    asked = [(1, "w1 w2 w2"), (2, "zebra"), (3, ""), (4, None), (5, "w0 w10 zebra")]
    got = defaultdict(list)
    for r in search.bm25_many(index, spark.createDataFrame(asked, "query_id int, text string"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q, text in asked:
        assert got[q] == [tuple(r) for r in search.top(search.bm25(index, text or ""), 7, "doc_id").collect()]
    vectors = docs.select("doc_id", T.hashed_vector(F.coalesce("text", F.lit(""))).alias("vector"))
    queries = spark.createDataFrame(asked, "query_id int, text string").select("query_id", T.hashed_vector(F.col("text")).alias("vector"))
    near = defaultdict(list)
    for r in search.dense_many(vectors, queries, 5).orderBy("query_id", "rank").collect():
        near[r.query_id].append((r.doc_id, r.score))
    assert set(near) == {1, 2, 3, 4, 5}
    for q in near:
        v = queries.where(f"query_id = {q}").first().vector
        want = search.dense(vectors, list(v), "doc_id", "vector").withColumn("score", F.round("score", search.DIGITS))
        assert near[q] == [tuple(r) for r in search.top(want, 5, "doc_id").collect()]
    assert search.dense_many(vectors, queries.where("false"), 5).count() == 0


def test_tables_of_queries_hand_on_the_first_rows_only(spark, tmp_path, monkeypatch):
    """Each document with a word was a row for each query with it, and documents that score 0 by a word came before others that score 0."""
    docs = spark.createDataFrame([(i, f"{'half' if i >= 150 else ''} {'some' if i % 3 else ''} own{i} w{i % 7} w{i % 7}") for i in range(300)], "doc_id long, text string")
    asked = [(q, x) for q, x in enumerate(["half", "half zebra", "some w1", "w1 some w1", "own7 own8", "w3 half", *["some"] * 20])]
    every = docs.withColumn("text", F.regexp_replace("text", "own[0-9]+", ""))  # the mean weight is below 0
    handed, plain = [], search.first_of_each
    monkeypatch.setattr(search, "first_of_each", lambda scores, *a: handed.append(scores.count()) or plain(scores, *a))
    monkeypatch.setattr(search, "SCORES", 100)
    for name, table, held in (("a", docs, 250_000), ("b", every.withColumn("text", F.concat("text", F.lit(" all every each any most"))), 250_000), ("c", docs, 9)):
        monkeypatch.setattr(search, "HELD_WORDS", held)
        handed.clear()
        index = search.extend(table, str(tmp_path / name))
        got = defaultdict(list)
        for r in search.bm25_many(index, spark.createDataFrame(asked, "query_id int, text string"), 4).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_id, r.score))
        assert (index.mean() < 0) == (name == "b")
        for q, text in asked[:8]:
            assert got[q] == [tuple(r) for r in search.top(search.bm25(index, text), 4, "doc_id").collect()]
        assert handed[0] <= len(asked) * 4 * 4  # four rows a query and task


def test_rows_of_a_task_do_not_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    """Postings were sorted in the session's number of tasks, however many there were, and so were the rows of a search for many queries."""
    monkeypatch.setattr(search, "TO_SORT", 500, raising=False)
    docs = spark.createDataFrame([(i % 290, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w96 w5")], "query_id int, text string")
    for name, table in (("once", docs.limit(290)), ("repeated", docs)):
        index = search.extend(table, str(tmp_path / name))
        assert len(index.postings.inputFiles()) > 8
        found = index.postings.groupBy("key").agg(F.sum("tf").alias("n"))
        assert found.agg(F.sum("n")).first()[0] == 40 * table.count() == index.state.info["n_words"] and index.n_docs == table.count()
        got = search.bm25_many(index, asked, 5).where("query_id = 1").orderBy("rank").collect()
        assert [(r.doc_id, r.score) for r in got] == [tuple(r) for r in search.top(search.bm25(index, "w1 w2 w2").distinct(), 5, "doc_id").collect()]


def test_tasks_go_by_the_words_whatever_the_session_has(spark, tmp_path, monkeypatch):
    """Small tasks were merged by their bytes, a word of all documents lay in 16 tasks at most, and merged runs in the session's number of tasks."""
    docs = spark.createDataFrame([(i, f"w{i % 97} all") for i in range(3000)], "doc_id long, text string")
    one = docs.withColumn("text", F.lit("all"))
    monkeypatch.setattr(search, "TO_SORT", 2000)
    assert len(search.extend(docs, str(tmp_path / "few")).postings.inputFiles()) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(search, "TO_SORT", 20)
    assert len(search.extend(one, str(tmp_path / "one")).postings.inputFiles()) > 16
    for i in range(4):
        index = search.extend(one.where(F.col("doc_id") % 4 == i), str(tmp_path / "merged"))
    assert [r.level for r in index.state.of("postings")] == [1] and len(index.postings.inputFiles()) > 16
    assert index.postings.count() == 3000 and index.terms.agg(F.sum("df")).first()[0] == 3000
    rows = search.sparse_rows(docs, T.term_weights, 2)
    assert rows.rdd.getNumPartitions() > 16 and rows.count() == 6000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors_hand_on_the_first_rows_of_a_task(spark, monkeypatch, kind):
    """A task handed on n rows a query and batch, and all ties of the n-th."""
    vectors = spark.range(9000, 0, -1, 2).select(F.col("id").cast(kind).alias("doc_id"), F.array(F.col("id") % 5 * 1.0, F.col("id") % 3000 * 0.5).alias("vector"))
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.5, 1.0]), (3, [-1.0, 0.0]), (4, None)], "query_id int, vector array<double>")
    handed, plain = [], search.first_of_each
    monkeypatch.setattr(search, "first_of_each", lambda scores, *a: handed.append(scores.count()) or plain(scores, *a))
    monkeypatch.setattr(search, "AT_ONCE", 50)
    got = [tuple(r) for r in search.dense_many(vectors, queries, 6).select("query_id", "doc_id", "score").orderBy("query_id", "rank").collect()]
    assert handed[0] <= 4 * 6 * 2
    every = [(r.doc_id, r.vector) for r in vectors.collect()]
    for q, v in [(r.query_id, r.vector) for r in queries.where("query_id < 4").collect()]:
        want = sorted((-round(x[0] * v[0] + x[1] * v[1], 9), k) for k, x in every)[:6]
        assert [r[1:] for r in got if r[0] == q] == [(k, -s) for s, k in want]


def test_postings_are_counted_in_place(spark):
    """They were grouped by document and word in a shuffle of all words, and the documents' norms in another of all postings."""
    texts = ["The the\u00a0x ÄÖ äö \x0b\x1cİ", None, "", " \n", "ΣΑΣ σας Ǆ", "a b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (search.postings(docs), search.lengths(docs)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    own = {r.doc_id: Counter(r.w) for r in docs.select("doc_id", T.words(F.col("text")).alias("w")).collect() if r.w}
    assert {(r.key, r.term): (r.tf, r.dl) for r in search.postings(docs).collect()} == {(d, w): (n, c.total()) for d, c in own.items() for w, n in c.items()}
    norm = {d: math.sqrt(sum(math.log1p(n) ** 2 for n in c.values())) for d, c in own.items()}
    got = {r.key: (r.dl, r.norm) for r in search.lengths(docs).collect()}
    assert got == {d: (own[d].total(), pytest.approx(norm[d])) if d in own else (0, None) for d in range(len(texts))}


def test_rows_of_one_key_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a a b"), (1, "a"), (2, "b")], "doc_id long, text string")
    index = search.extend(docs, str(tmp_path / "i"))
    assert sorted(tuple(r) for r in index.postings.select("key", "term", "tf", "dl").collect()) == [(1, "a", 3, 3), (1, "b", 1, 3), (2, "b", 1, 1)]
    assert sorted((r.key, r.dl, round(r.norm, 6)) for r in index.docs.collect()) == [(1, 1, 1.549924), (1, 3, 1.549924), (2, 1, 0.693147)]


def test_punkt_looks_at_distinct_runs_by_patterns(spark):
    """Each place of the corpus was looked at by six patterns, in each of two or more evaluations of its text; now a text is only split and its runs are counted."""
    docs = spark.createDataFrame([(0, 'Dr. No! "no." yes... (A. b) 3.5 x.'), (1, None), (2, ""), (3, ". No")], "doc_id long, text string")
    plan = punkt.counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
    assert not any("Filter" in line and "size(" in line for line in plan.splitlines())
    got = {r.type: (r.n, r.dots, r.upper_n, r.lower_n, r.starts) for r in punkt.counts(docs).collect()}
    assert got == {"dr": (1, 1, 1, 0, 0), "no": (3, 1, 2, 1, 2), "yes": (1, 0, 0, 1, 1), "a": (1, 1, 1, 0, 1), "b": (1, 0, 0, 1, 1), "##number##": (1, 0, 0, 0, 0), "x": (1, 1, 0, 1, 0)}


def test_sparse_rows_are_made_once(spark):
    plan = search.sparse_rows(spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string"), T.term_weights, 5)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "size(" in line for line in text.splitlines()) and "rangepartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.key, round(r.weight, 6)) for r in plan.collect()) == [(1, 0.693147), (1, 1.098612)]
