"""The engine, its store, the stream that feeds it, and file sources."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import chunk, search, segment
from quarry.sources import files, store
from quarry.sources.store import Options
from quarry.streaming.ingest import ingest

PAGES = "source_name string, text string, page_start int, page_end int"
BODY = "Working hours are 9:45 AM to 6:15 PM for all of us. Leave is 21 days annual leave. "


def pages(spark):
    rows = [("a.md", BODY * 3, 1, 1), ("b.md", "River boats carry grain and salt past the old mill. " * 12, 2, 3), ("a.md", BODY * 3, 1, 1), ("c.md", None, 1, 1), ("d.md", "", None, None)]
    return spark.createDataFrame(rows, PAGES)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), Options(strategy="page"))


def test_ingest_search_answer(spark, engine):
    assert engine.ingest(pages(spark)) == {"files": 3, "new": 3, "skipped": 1}
    assert engine.ingest(pages(spark)) == {"files": 3, "new": 0, "skipped": 4}
    assert [*engine.stats().first()][:2] == [3, 3]
    for mode in search.MODES:
        best = engine.search("river boats", mode=mode).orderBy("rank").first()
        assert best.source_name == "b.md" and (best.rank, best.page_start) == (1, 2)
    assert engine.search("river boats", mode="none").count() == 0
    assert engine.search("river boats", mode="sparse", top_k=1, reranker="overlap").first().score == 1.0
    text, refs = engine.answer("what are the working hours", mode="sparse")
    assert "9:45 AM" in text and refs[0].endswith("a.md — pages 1 | section: -")
    said = engine.chart("show a table of leave", mode="sparse")
    assert "| Annual Leave | 21.0 | days |" in said and "```csv" in said and "## References" in said
    before = engine.search("river boats", mode="sparse").collect()
    engine.rebuild()
    assert engine.search("river boats", mode="sparse").collect() == before
    engine.reset()
    assert engine.chunks().count() == 0


def test_index_grows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i}") for i in range(60)] + [(99, None)], "doc_id long, text string")
    search.extend(docs.where("doc_id < 20"), str(tmp_path / "i"))
    grown = search.extend(docs.where("doc_id >= 20"), str(tmp_path / "i"))
    whole = search.extend(docs, str(tmp_path / "j"))
    for f in (search.bm25, search.sparse_cosine):
        assert sorted(f(grown, "common word3 word3 word3 zebra").collect()) == sorted(f(whole, "common word3 word3 word3 zebra").collect())
    assert search.bm25(whole, "").agg(F.sum("score")).first()[0] == 0
    plan = search.bm25(whole, "word3 word4")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(part, [^]]*\]\), [^]]*In\(term, \[word3,word4\]\)|PushedFilters: \[[^]]*In\(term, \[word3,word4\]\)", plan) and "Generate" not in plan


def test_reset_only_deletes_stores(spark, tmp_path):
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="not a store"):
        store.reset(spark, str(tmp_path / "other"))
    store.reset(spark, str(tmp_path / "none"))


def test_chunks_as_json(spark, tmp_path):
    chunks = chunk.chunked(pages(spark), Options(strategy="page"))
    store.write_chunks(chunks.withColumn("id", F.lit(None).cast("string")), str(tmp_path / "c"))
    assert sorted(store.read_chunks(spark, str(tmp_path / "c")).select("id", "text").collect()) == sorted(chunks.select("id", "text").collect())
    assert json.loads(store.exported(chunks).first().value).keys() == {"id", "text", "metadata"}


def test_options():
    o = Options(strategy="page").merged('{"top_k": 3, "other": 1}')
    assert (o.strategy, o.top_k) == ("page", 3) and Options().merged(o.to_json()) == o


@pytest.mark.parametrize("strategy", [*chunk.STRATEGIES, "no such"])
def test_every_strategy_has_the_schema(spark, strategy):
    rows = chunk.chunked(pages(spark), Options(strategy=strategy, min_tokens=5, target_tokens=40, overlap_tokens=5, char_size=300, char_overlap=20))
    assert rows.columns == [x.split()[0] for x in store.CHUNK.split(", ")]
    got = rows.collect()
    assert {r.source_name for r in got} >= {"a.md", "b.md"} and all(r.text == " ".join(r.text.split()) for r in got)
    assert {r.parser for r in got} == {strategy if strategy in chunk.STRATEGIES else "token"}


def test_metadata_overrides_only_if_asked(spark):
    rows = pages(spark).limit(1).withColumn("metadata", F.create_map(F.lit("parser"), F.lit("mine")))
    assert [chunk.chunked(rows, Options(strategy="page"), overrides=x).first().parser for x in (False, True)] == ["page", "mine"]


def test_stream(spark, tmp_path, engine):
    rows = [{"source_name": f"{i}.txt", "text": f"text number {i} about boats", "page_start": 1, "page_end": 1} for i in range(3)]
    (tmp_path / "in").mkdir()
    for n, some in enumerate((rows[:2], rows[1:])):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, some)))
        stream = spark.readStream.schema(PAGES).json(str(tmp_path / "in"))
        ingest(stream, engine, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.source_name for r in engine.chunks().collect()) == ["0.txt", "1.txt", "2.txt"]


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    docx = f'<w:document xmlns:w="{w}"><w:body>{p("First")}{p(" ")}<w:tbl><w:tr>{cell("h1")}{cell("h2")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl>{p("Last")}</w:body></w:document>'
    x, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xlsx = {
        "xl/workbook.xml": f'<workbook xmlns="{x}" xmlns:r="{r}"><sheets><sheet name="Sales" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{x}"><si><t>Region</t></si><si><t>Total</t></si><si><t>North</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>12.0</v></c></row></sheetData></worksheet>',
    }
    given = {
        "a.md": b"---\ntitle: x\n---\nbody\n", "bad.md": b"---\nt: [\n---\nbody\n", "l.txt": "caf\xe9".encode("latin-1"), "d.docx": zipped({"word/document.xml": docx}), "e.docx": b"no zip",
        "s.xlsx": zipped(xlsx), "c.csv": b"name;n\nx;1.0\ny;\n", "p.pdf": b"%PDF", "z.bin": b"\x00",
    }
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    every = ("md", "txt", "docx", "xlsx", "csv", "pdf")
    got = {r.source_name: r for r in files.read(spark, str(tmp_path), every).collect()}
    assert set(got) == set(given) - {"z.bin"}
    assert (got["a.md"].text, got["a.md"].metadata) == ("body\n", {"title": "x"}) and got["bad.md"].text.startswith("---")
    assert (got["l.txt"].text, got["l.txt"].parser) == ("café", "text_latin1")
    assert got["d.docx"].text == "First\n\n| h1 | h2 |\n|---|---|\n| 1 | 2 |\n\n\nLast" and got["e.docx"].parser == got["p.pdf"].parser == "failed"
    assert got["s.xlsx"].text == "Sheet: Sales\nColumns: Region | Total\n\nRegion: North\nTotal: 12\n\n"
    assert got["c.csv"].text == "CSV Data from c.csv\nColumns: name | n\n\nname: x\nn: 1\n\nname: y\n\n"
    raw = {r.source_name: r.text for r in files.read(spark, str(tmp_path), ("csv",), structured=False).collect()}
    assert raw == {"c.csv": "name;n\nx;1.0\ny;\n"}
    two = files.read(spark, str(tmp_path / "p.pdf"), every, pdf=lambda data: ["one", " ", "three"]).collect()
    assert [(r.text, r.page_start) for r in two] == [("one", 1), ("three", 3)]
    marked = files.read(spark, str(tmp_path / "p.pdf"), page_marks=True, pdf=lambda data: ["one", "two"]).first()
    assert marked.text == "[[PAGE 1]]\none\n[[PAGE 2]]\ntwo"
    assert [r.name for r in files.skipped(spark, str(tmp_path), every).collect()] == ["z.bin"]


def test_paired_reranker(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(20)], "id long, text string").withColumn("score", F.lit(0.0))
    best = search.rerank(rows, "q", 3, search.paired(lambda pairs: [len(t) for _, t in pairs]), "id")
    assert [r.id for r in best.collect()] == [19, 18, 17] and [r.id for r in search.rerank(rows, "q", 2, None, "id").collect()] == [0, 1]


def test_cascade():
    assert segment.cascade("aa bb cc dd", 5, 0) == ["aa bb", "cc", "dd"] or segment.cascade("aa bb cc dd", 6, 0) == ["aa bb", "cc dd"]
    text = "one two three.\n\n" + "four five six seven eight nine ten " * 3
    out = segment.cascade(text, 40, 10)
    assert out[0] == "one two three." and all(len(x) <= 40 for x in out)
    assert "".join("".join(out).split()).count("ten") >= 3
    assert segment.cascade("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5] and segment.cascade("", 10, 0) == []
