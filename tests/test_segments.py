"""Segmenting, corpus-wide near copies, charts and answers against plain Python or given values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answer, dedup, ground, segment


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cosine(a, b):
    return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-9)


def test_boundaries_as_numpy(spark):
    rng = random.Random(1)
    topics = ["river boat water mill".split(), "tax law court judge".split(), "stone hill tree bird".split()]
    texts = ["", "Only one."] + [" ".join(" ".join(rng.choices(rng.choice(topics) if rng.random() < 0.2 else topics[i // 5 % 3], k=6)).capitalize() + "." for i in range(15)) for _ in range(4)]
    df = frame(spark, *texts).select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    rows = df.select("doc_id", F.transform("s", lambda x: T.hashed_vector(x)).alias("v"), segment.boundaries(F.col("s")).alias("places")).collect()
    for r in rows:
        v, want = [np.array(x) for x in r.v], []
        if len(v) > 1:
            near = lambda i: [j for j in range(max(0, i - 3), min(len(v), i + 4)) if j != i]
            d = np.diff([np.mean([cosine(v[i], v[j]) for j in near(i)]) for i in range(len(v))])
            for i, z in enumerate((d - d.mean()) / (d.std() + 1e-9)):
                if z < -0.8 and i + 1 - (want[-1] if want else 0) >= 3:
                    want.append(i + 1)
        assert r.places == want
    assert any(r.places for r in rows)


def test_semantic(spark):
    text = "River boat water. River boat mill. Tax law court. Tax law judge. Tax court judge"
    got = [(r.chunk, r.sentence_count) for r in segment.by_semantic(frame(spark, text, "One", None), ["doc_id"], least=1, threshold=0.5).orderBy("doc_id", "chunk_no").collect()]
    assert got == [("River boat water River boat mill", 2), ("Tax law court Tax law judge Tax court judge", 3), ("One", 1)]
    assert [r.sentence_count for r in segment.by_semantic(frame(spark, text), ["doc_id"], least=1, threshold=-1.0, target=9).orderBy("chunk_no").collect()] == [2, 3]


def test_sections_and_blocks(spark):
    text = "intro\n# One\nBody. Next line\n```\nzz. Y\n```\n# Empty\n# Two\n1. point\nlast"
    got = [(r.section, r.body) for r in segment.by_headings(frame(spark, text, "# a\n# b"), ["doc_id"]).orderBy("doc_id", "section_no").collect()]
    assert got == [("Document", "intro"), ("One", "Body. Next line\n```\nzz. Y\n```"), ("1. point", "last"), ("Document", "# a\n# b")]
    for strategy in segment.STRATEGIES:
        rows = segment.standalone(frame(spark, text), ["doc_id"], strategy=strategy).orderBy("id").collect()
        assert [(r.id, r.section) for r in rows] == [("chunk_00001", "Document"), ("chunk_00002", "One"), ("chunk_00003", "1. point")]
        assert "```\nzz. Y\n```" in rows[1].chunk


def test_text_rules(spark):
    rows = spark.createDataFrame([("```\nx",), ("a\n\n\n\nb",), ("| a | b |\n| 1 | 2 |",), ("a\n---",), ("plain\ntext",), ("IV) part",), ("A Title here:",), ("  ## x",), ("x ## y",)], "t string")
    got = rows.select(T.boundary_cleanup(F.col("t")), T.is_table_block(F.col("t")), T.is_heading(F.col("t"))).collect()
    assert got[0][0] == "```\nx\n```" and got[1][0] == "a\n\nb"
    assert [r[1] for r in got[:5]] == [False, False, True, True, False] and [r[2] for r in got[5:]] == [True, True, True, False]


def test_remerged_is_trimmed(spark):
    rows = spark.createDataFrame([(1, i, f"c{i}", "x" * n) for i, n in enumerate((400, 40, 40, 400))], "d long, n int, id string, chunk string")
    got = {r.id: (r.merged_from, len(r.text)) for r in segment.remerged(rows, "d", "n", most=60).collect()}
    assert got == {"merged_c0": (["c0", "c1"], 40), "merged_c1": (["c0", "c1", "c2"], 82), "merged_c2": (["c1", "c2", "c3"], 82), "merged_c3": (["c2", "c3"], 40)}


def test_greedy_near_copies(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    base = [[word() for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = word()
        rows.append((i % 2, i, " ".join(w[: rng.choice([60, 60, 58, 5])])))
    kept: dict[int, list] = {0: [], 1: []}
    for g, i, t in rows:
        w = t.split()
        s = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        alike = lambda a: (1.0 if not a and not s else len(a & s) / len(a | s)) > 0.8  # noqa: B023, E731
        if not any(alike(a) for _, a in kept[g]):
            kept[g].append((i, s))
    df = spark.createDataFrame([*rows, (2, 0, None), (2, 1, "")], "g int, o long, text string")
    assert {(r.g, r.o) for r in dedup.greedy(df, "g", "o").collect()} == {(g, i) for g in kept for i, _ in kept[g]} | {(2, 0)}
    assert dedup.greedy(df.where("false"), "g", "o").count() == 0


def test_greedy_over_a_large_group(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    rows = [(None if i % 50 == 7 else 1, i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])) for i in range(2000) for at in [rng.randrange(150)]]
    pairs, alike = [], dedup._alike
    monkeypatch.setattr(dedup, "_alike", lambda p, *rest: (pairs.append(p.count()), alike(p, *rest))[1])
    df = spark.createDataFrame(rows, "g int, o long, text string").withColumns({c: F.lit("mine") for c in ("w", "k", "s", "id")})
    got = {(r.g, r.o) for r in dedup.greedy(df, "g", "o").collect()}
    kept: dict = {}
    for g, i, t in rows:
        w = t.split()
        s = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        if not any(len(a & s) / len(a | s) > 0.8 for _, a in kept.setdefault(g, [])):
            kept[g].append((i, s))
    assert got == {(g, i) for g in kept for i, _ in kept[g]}
    assert len(got) < 20 and sum(pairs) < 10 * len(rows)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_greedy_moves_few_sets(spark, monkeypatch, few):
    """All sets went to each comparison, also those of chunks that have most shingles for themselves."""
    rng = random.Random(5)
    texts = [[f"u{i}x{j}" for j in range(30 if i > 30 else 8 + i % 2)] for i in range(300)]
    for size in (10, 14, 17, 40, 90):  # from few shingles to many, each with longer ones, copies and ones that are less alike
        base = [f"b{size}x{j}" for j in range(size)]
        texts += [base, [*base, "more"], ["other", *base], base, [*base, "more", "and", "more"], [*base[: size // 2], "in", *base[size // 2 :]], [*base, "more"]]
    rng.shuffle(texts)
    seen, alike = [], dedup._alike
    monkeypatch.setattr(dedup, "_alike", lambda pairs, sets, over: (seen.append(sets.count()), alike(pairs, sets, over))[1])
    monkeypatch.setattr(dedup, "FEW_IDS", few, raising=False)
    got = {r.o for r in dedup.greedy(spark.createDataFrame([(1, i, " ".join(w)) for i, w in enumerate(texts)], "g int, o long, text string"), "g", "o").collect()}
    kept: list = []
    for i, w in enumerate(texts):
        s = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        if not any(len(a & s) / len(a | s) > 0.8 for _, a in kept):
            kept.append((i, s))
    assert got == {i for i, _ in kept}
    assert seen and max(seen) < 100


def test_greedy_ties_and_null_orders(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(1, 5, words[0]), (1, 5, words[1]), (1, None, words[0] + " more"), (None, None, words[1]), (1, 5, words[1])]
    got = dedup.greedy(spark.createDataFrame(rows, "g int, o long, text string"), "g", "o").collect()
    assert sorted(((r.g, r.o) for r in got), key=repr) == [(1, 5), (1, None), (None, None)]


POINTS = [{"category": f"C{i}", "time_period": None, "value": float(i), "unit": "kg"} for i in range(20)]


def test_charts():
    spec = ground.chart(POINTS)
    assert [v["value"] for v in spec["data"]["values"]] == [19.0, 18, 17, 16, 15, 14, 13, 12] and spec["title"] == "Category Analysis (kg)"
    times = [{"category": None, "time_period": f"Q1 {y}", "value": v, "unit": ""} for y, v in zip(range(2000, 2020), [3.0, 1.0] * 10, strict=True)]
    line = ground.chart(times, "Area Chart")
    assert [v["time"] for v in line["data"]["values"]] == [p["time_period"] for p in times] and line["mark"]["type"] == "area"
    assert ground.chart(POINTS, "Donut Chart")["mark"]["innerRadius"] == 50 and ground.chart(POINTS, "Scatter Plot")["mark"]["type"] == "bar"
    assert ground.captioned(POINTS).startswith("This bar chart shows 8 data points extracted from the provided documents. Values are in kg.\n\n```json\n{")
    assert ground.captioned(POINTS, "Pie Chart").startswith("This pie chart shows the distribution of kg by category")
    assert ground.captioned(times, "Line Chart").startswith("This line chart shows 20 data points")


def test_forms():
    assert ground.form("draw a chart and a table", "Auto-detect", 9) == "table" and ground.form("plot it", "Auto-detect", 1) == "chart"
    assert [ground.form("numbers", "Auto-detect", n) for n in (3, 4)] == ["table", "chart"] and ground.form("numbers", "Pie Chart", 1) == "chart"


def test_respond(spark):
    schema = "id string, source_name string, page_start int, page_end int, section_path string, text string, rank int"
    sheet = "Sheet: Sales\nColumns: a | b\n\nNorth: $1,250,000\nSouth: 12 units\nEast: 3\nWest: 4%\n"
    chunks = spark.createDataFrame([("abc", "s.xlsx", 1, 1, None, sheet, 1), ("def", "s.xlsx", 1, 2, "A", "nothing", 2)], schema)
    said = ground.respond(chunks, "numbers", include_csv=True)
    assert '"category": "Sales - North"' in said and "Sales - South,12.0,units" in said and said.endswith("- [ID:abc] s.xlsx — pages 1–1 | section: -")
    assert "What we look for" in ground.respond(chunks.where("rank = 2"), "numbers")
    assert ground.context(chunks, "rank").orderBy("rank").first().context.startswith("[ID: abc]\nsource_name: s.xlsx\npage_start: 1   page_end: 1\nsection: -\ntext: |\nSheet:")


def test_answer_modes(spark):
    ranked = spark.createDataFrame([(1, "The dress code prohibits casual tops, jeans and more of it.", 1.0), (2, "The dress code is for all who work", 0.5)], "doc_id long, text string, score double")
    query = "what does the dress code prohibit"
    own = answer.answer(ranked, query).first().answer
    assert own == "The dress code prohibits casual tops and jeans."
    assert answer.answered(ranked, query, "gpt_enhanced", lambda context, q: f"{len(context) > 0} {q}").first() == (f"True {query}", [1, 2])
    assert answer.answered(ranked, query, "hybrid", lambda context, q: "Not enough information").first().answer == own
    assert answer.answered(ranked, query, "hybrid", lambda context, q: 1 / 0).first().answer == own


def test_ties_follow_the_ranks(spark):
    ranked = spark.createDataFrame([(1, "A boat on the river goes far", 0.5), (2, "The river has one boat today", 0.5)], "doc_id long, text string, score double")
    assert answer.answer(ranked, "river boat").first().used == [1, 2]


def test_cosines_in_batches_are_those_of_columns(spark):
    """Bit for bit, with null and empty texts, texts of one sentence and words beyond ASCII; each sentence used to be worked out by columns, some 0.1 ms a pair."""
    from quarry.functions import hashed

    texts = ["A b c. B c d! C d\\u00a0e? Ä ö. ä Ö. Zz. A b c. Q r s t. A b", "One", "", None, "... Σας ΣΑΣ. ς"] + [". ".join(" ".join(random.Random(i * 99 + k).choices("abcdefgh", k=k % 5 + 1)) for k in range(30)) for i in range(5)]
    docs = frame(spark, *texts)
    lists = docs.select("doc_id", T.sentences(F.col("text")).alias("s"))
    for of, column in ((hashed.drops, segment.boundaries(F.col("s"))), (hashed.alike, F.transform("s", lambda x, i: F.when(i > 0, T.cosine(T.hashed_vector(F.get("s", i - 1)), T.hashed_vector(x)))))):
        kind = "int" if of is hashed.drops else "double"
        got = {r.doc_id: r.x for r in hashed.added(lists.withColumnRenamed("s", "sentences"), "x", of, kind).collect()}
        assert got == {r.doc_id: r.x for r in lists.select("doc_id", column.alias("x")).collect()}


def test_recursion_hands_on_few_pieces_at_a_time(spark, monkeypatch):
    """All pieces of a batch of Arrow were held at once, as objects of Python; however they are handed on, they are the same."""
    docs = frame(spark, *[" ".join(f"w{i}{k}" for k in range(300)) for i in range(40)], None, "")
    whole = segment.by_recursion(docs, "doc_id", size=200, overlap=20)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(segment, "HANDED_ON", 500)
    assert sorted(map(tuple, segment.by_recursion(docs, "doc_id", size=200, overlap=20).collect())) == want
