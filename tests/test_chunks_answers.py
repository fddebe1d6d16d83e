"""Ordered chunkers, answers and number extraction against plain Python or given values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answer, chunk, ground, pack, segment
from quarry.plans.queries import QUERIES
from quarry.sources.store import Options

DATA = "/root/testdata/sf0.001"
tokens = lambda s: max(1, len(s) // 4)


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def fill(pieces, target, least, overlap, sep):
    out, run = [], []
    for p in pieces:
        if run and sum(map(tokens, run)) + tokens(p) > target:
            out.append(run)
            run = run[-overlap:] if overlap else []
        run = [*run, p]
    return [sep.join(r) for r in [*out, run] if r and tokens(sep.join(r)) >= least]


@pytest.mark.parametrize("name,overlap,sep", [("chunk_sentence", 2, " "), ("chunk_paragraph", 0, "\n\n")])
def test_packed(spark, name, overlap, sep):
    got = {}
    for r in sorted(QUERIES[name](spark, DATA).collect()):
        got.setdefault(r.doc_id, []).append(r.chunk)
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        cut = r.text.split("\n") if overlap == 0 else re.split("[.!?]+", r.text)
        want = fill([p.strip(" \t\n\x0b\f\r") for p in cut if p.strip(" \t\n\x0b\f\r")], 700, 120, overlap, sep)
        assert got.get(r.doc_id, []) == want


def test_merged_overlap_and_cut(spark):
    docs = frame(spark, "Aaaa aaaa. Bbbb bbbb. Cccc cccc. Dddd dddd.", "x" * 30 + ", " + "y" * 30, None, "")
    got = [(r.doc_id, r.chunk) for r in pack.by_merged_sentences(docs, ["doc_id"], target=5, overlap=3, least=2).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(0, "Aaaa aaaa. Bbbb bbbb."), (0, "Bbbb bbbb. Cccc cccc."), (0, "Cccc cccc. Dddd dddd."), (1, "x" * 30 + ","), (1, "y" * 30)]


def test_markdown_paths(spark):
    docs = frame(spark, "before\n# A\na\n## B\nb\n### C\nc\n## D\nd\n#no\n", "", None)
    got = [(r.chunk, r.header_level, r.section_path) for r in pack.by_markdown(docs, ["doc_id"]).orderBy("doc_id", "chunk_no").collect()]
    assert [r.md_types for r in pack.by_markdown(frame(spark, "# A\n- x\n# B\nplain"), ["doc_id"]).orderBy("chunk_no").collect()] == [["list"], []]
    assert got == [("before", 0, ""), ("# A a", 1, "A"), ("## B b", 2, "A > B"), ("### C c", 3, "A > B > C"), ("## D d #no", 2, "A > D")]


def test_hybrid_drops_later_copies(spark):
    body = " ".join(f"word{i}" for i in range(20))
    got = [r.section_path for r in segment.by_hybrid(frame(spark, f"# A\n{body}\n# B\nother words\n# C\n{body}"), ["doc_id"]).orderBy("chunk_no").collect()]
    assert got[:2] == ["A", "B"]
    assert segment.by_hybrid(frame(spark, f"{body}\n# x\nshort\n# y\nalso short"), ["doc_id"]).count() == 2


def test_answer(spark):
    ranked = spark.createDataFrame([(1, "Working hours are 9:45 AM to 6:15 PM. Nothing else to see here", 1.0), (2, "The office hours are 9 AM. Short", 0.5), (3, "unrelated text of a page", 0.1)], "doc_id long, text string, score double")
    row = answer.answer(ranked, "What are the working hours").first()
    assert row.answer == "Working hours are 9:45 AM to 6:15 PM The office hours are 9 AM" and row.used == [1, 2]
    assert answer.answer(ranked, "zebra").first().answer == answer.UNKNOWN


def test_references(spark):
    rows = [("abcdefghij", "a.pdf", 2, 3, None, 1), ("zzzzzzzzzz", "a.pdf", 2, 3, None, 2), ("kkkkkkkkkk", "b.md", 2, 2, "A > B", 3)]
    chunks = spark.createDataFrame(rows, "id string, source_name string, page_start int, page_end int, section_path string, rank int")
    got = [r.reference for r in answer.references(chunks, "rank").orderBy("rank").collect()]
    assert got == ["[ID:abcdefgh] a.pdf — pages 2–3 | section: -", "[ID:kkkkkkkk] b.md — pages 2 | section: A > B"]


@pytest.mark.parametrize(
    "text,fix,want",
    [
        ("Office hours 9:00 AM to 11:30 AM", False, {("Weekday Working Hours", None, 2.5, "hours")}),
        ("Working hours: 9:45 AM to 6:15 PM", True, {("Weekday Working Hours", None, 8.5, "hours"), ("Working Hours", None, 9.0, "")}),
        ("Working hours: 9:45 AM to 6:15 PM", False, {("Working Hours", None, 9.0, "")}),
        ("21 days annual leave", False, {("Annual Leave", None, 21.0, "days")}),
        ("45% completion rate", False, {("Completion Rate", None, 45.0, "%")}),
        ("$1,250,000 revenue", False, {("Revenue", None, 1250000.0, "$")}),
        ("Q1 2023: 1500", False, {(None, "Q1 2023", 1500.0, "")}),
        ("", False, set()),
        (None, False, set()),
    ],
)
def test_numbers(spark, text, fix, want):
    got = {(r.category, r.time_period, r.value, r.unit) for r in ground.numbers(frame(spark, text), fix_meridiem=fix).collect()}
    assert got == want


def test_table_and_chart(spark):
    points = ground.numbers(frame(spark, "Q1 2023: 1500\nQ2 2023: 1700\n45% completion rate"))
    assert ground.markdown_table(points).first().table.splitlines()[2:] == ["| Q2 2023 | 1,700.0 |  |", "| Q1 2023 | 1,500.0 |  |"]
    rows = [r.asDict() for r in points.orderBy("line_no").collect()]
    assert ground.chart(rows)["mark"]["type"] == "line"
    assert ground.chart([r for r in rows if not r["time_period"]], "Donut Chart")["mark"] == {"type": "arc", "innerRadius": 50}
    assert ground.markdown_table(points.where("false")).first().table.startswith("No tabular data")


def test_yaml_scalars(spark):
    yaml = pytest.importorskip("yaml")
    words = ["a", "is: it", "x #y", "- b", "-b", "? q", "yes", "Null", "~", "12", "1_0", "0x1f", "1.5e+3", "1e5", ".5", "2024-01-02", "12:30", "", " lead", "trail ", "it's", "'q", "[l", "{m", "a > b", "> c", "%d", "@e", "`f", "&g", "*h", "!i", "|j", "k:", "k:v", "café", "tab\there", "世", "\U0001f600", 'say "hi"', "back\\slash", "---", "...", "=", "<<", "a,b", "0.1.2", "on", "007", "089", "line\nbreak"]
    rng = random.Random(4)
    long = [" > ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    values = words + long + [f"it's {x}: y" for x in long] + ["w" * 90 + " x", "a  b " * 30 + "c"]
    for key in ("source_name", "k"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = {r.i: r.f for r in df.select("i", T.front_matter({key: F.col("v")}).alias("f")).collect()}
        wrong = {v: (got[i], want) for i, v in enumerate(values) if got[i] != (want := f"---\n{yaml.dump({key: v}, default_flow_style=False, width=80)}---") and not (v.isascii() is False or "\t" in v or "\n" in v)}
        assert wrong == {}
        for i, v in enumerate(values):
            assert yaml.safe_load(got[i].split("---\n", 1)[1].removesuffix("---")) == {key: v}


def test_front_matter_in_chunks(spark):
    text = "# Top\nintro words here\n\n## Sub\n- a list\n\n> quoted"
    pages = spark.createDataFrame([("a.md", text, 2, 3, {"created_at": "2024-01-02", "other": "x"})], "source_name string, text string, page_start int, page_end int, metadata map<string,string>")
    plain = chunk.chunked(pages, Options(strategy="markdown_structure")).orderBy("section_path").collect()
    assert [(r.section_path, r.header_level, r.md_types_present, r.sentence_count) for r in plain] == [("Top", 1, [], None), ("Top > Sub", 2, ["blockquote", "list"], None)]
    options = Options(strategy="markdown_structure", include_front_matter=True)
    assert Options().merged(options.to_json()) == options
    rich = chunk.chunked(pages, options).orderBy("section_path").collect()
    for a, b in zip(plain, rich, strict=True):
        assert (a.id, a.sha256, a.tokens) == (b.id, b.sha256, b.tokens)
        front = f"---\ncreated_at: '2024-01-02'\npage_end: 3\npage_start: 2\nsection_path: {a.section_path}\nsha256: {a.sha256}\nsource_name: a.md\ntokens: {a.tokens}\n---"
        assert b.text == f"{front}\n\n{a.text}"
    none = chunk.chunked(pages, Options(strategy="page", include_front_matter=True, front_matter_keys=("section_path",))).first()
    assert none.text.startswith("\n\n# Top")
    semantic = chunk.chunked(pages.withColumn("text", F.lit("One thing. Two things. Three things.")), Options(strategy="semantic_boundary", min_tokens=1, semantic_threshold=0.0)).first()
    assert semantic.sentence_count == 3
    assert chunk.chunked(pages, Options(strategy="hybrid_chunking", min_tokens=1)).first().parser == "hybrid"


def test_chunk_schema_has_the_columns_of_its_sql(spark):
    assert QUERIES["chunk_schema"](spark, DATA).columns == ["id", "sha256", "text", "source_name", "page_start", "page_end", "tokens", "parser", "char_start", "char_end"]
