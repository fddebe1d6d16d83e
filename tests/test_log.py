"""The commit log: ingests that fail, writers that meet, levels that merge, and an index that grows batch by batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.engine import Engine
from quarry.operators import search
from quarry.sources import log as L
from quarry.sources import store
from quarry.sources.log import Log
from quarry.sources.store import Options
from quarry.streaming.ingest import ingest

PAGES = "source_name string, text string, page_start int, page_end int"


def pages(spark, lo, hi):
    return spark.createDataFrame([(f"{i}.txt", f"common text number{i} about word{i % 3} boats", 1, 1) for i in range(lo, hi)], PAGES)


def held(engine):
    """All that a store gives: chunks, vectors, statistics, and what searches find."""
    rows = [sorted(engine.chunks().drop("metadata").collect()), sorted(engine.vectors().collect()), engine.index().n_docs, round(engine.index().avgdl, 9)]
    rows.append(sorted(engine.index().terms.groupBy("term").agg(F.sum("df")).collect()))
    return rows + [[(r.id, r.score) for r in engine.search("common word1 boats number3", mode=m).orderBy("rank").collect()] for m in ("hybrid",)]


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("s") / "store"), Options(strategy="page"))
    out = []
    for lo, hi in ((0, 5), (3, 9)):
        out.append(engine.ingest(pages(spark, lo, hi)))
    return out, held(engine)


class Stop(Exception):
    pass


def failing(monkeypatch, name, at, after=False):
    """Log.<name> fails at its at-th call, before or after it has done its work."""
    own, calls = getattr(Log, name), []

    def call(self, *a, **k):
        calls.append(1)
        if len(calls) == at and not after:
            raise Stop
        out = own(self, *a, **k)
        if len(calls) == at and after:
            raise Stop
        return out

    monkeypatch.setattr(Log, name, call)


@pytest.mark.parametrize(("name", "at", "after"), [("write", 1, True), ("write", 2, False), ("write", 4, True), ("write", 5, True), ("commit", 1, False), ("commit", 1, True), ("merge", 1, False)])
def test_failed_ingest_leaves_the_store(spark, tmp_path, monkeypatch, undisturbed, name, at, after):
    engine = Engine(spark, str(tmp_path / "store"), Options(strategy="page"))
    stats, whole = undisturbed
    assert engine.ingest(pages(spark, 0, 5)) == stats[0]
    before = held(engine)
    with monkeypatch.context() as m:
        failing(m, name, at, after)
        with pytest.raises(Stop):
            engine.ingest(pages(spark, 3, 9))
    committed = name == "merge" or (name == "commit" and after)
    assert held(engine) == (whole if committed else before)
    again = engine.ingest(pages(spark, 3, 9))
    assert again == ({"files": 6, "new": 0, "skipped": 6} if committed else stats[1])
    assert held(engine) == whole


@pytest.mark.parametrize(("name", "at", "after"), [("write", 4, False), ("commit", 1, True)])
def test_failed_stream_goes_on(spark, tmp_path, monkeypatch, undisturbed, name, at, after):
    engine = Engine(spark, str(tmp_path / "store"), Options(strategy="page"))
    (tmp_path / "in").mkdir()

    def run():
        ingest(spark.readStream.schema(PAGES).json(str(tmp_path / "in")), engine, str(tmp_path / "cp")).awaitTermination(120)

    for n, (lo, hi) in enumerate(((0, 5), (3, 9))):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r.asDict()) for r in pages(spark, lo, hi).collect()))
        if n:
            with monkeypatch.context() as m:
                failing(m, name, at, after)
                with pytest.raises(Exception, match="Stop"):
                    run()
        run()
    assert held(engine) == undisturbed[1]
    assert engine.log.state().info["streams"][str(tmp_path / "cp")] == {"batch": 1, "stats": undisturbed[0][1]}


def test_two_writers(spark, tmp_path, monkeypatch):
    one, other = (Engine(spark, str(tmp_path / "store"), Options(strategy="page")) for _ in range(2))
    one.ingest(pages(spark, 0, 2))
    own, met = Log.commit, []

    def commit(self, *a, **k):
        if not met:
            met.append(1)
            assert other.ingest(pages(spark, 1, 4))["new"] == 2
        return own(self, *a, **k)

    monkeypatch.setattr(Log, "commit", commit)
    assert one.ingest(pages(spark, 2, 6)) == {"files": 4, "new": 2, "skipped": 2}
    assert one.chunks().count() == one.chunks().select("id").distinct().count() == one.index().n_docs == one.vectors().count() == 6
    with pytest.raises(L.Conflict):
        one.log.commit(L.State(1, (), {}), [])


def test_index_in_batches_equals_whole(spark, tmp_path, monkeypatch):
    """Any sequence of batches, levels merged on the way; a batch reads nothing but its own runs."""
    monkeypatch.setattr(L, "CHECKPOINT", 3)
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "of", "a", *(f"w{j}" for j in range(40))]) for _ in range(rng.randrange(0, 12)))) for i in range(120)] + [(500, None), (501, "")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    read, seen = Log.read, []
    monkeypatch.setattr(Log, "read", lambda self, runs, schema: (seen.append([r.path for r in runs]), read(self, runs, schema))[1])
    lo, path = 0, str(tmp_path / "i")
    for n in (40, 1, 1, 30, 2, 1, 1, 20, 3, 9, 14):
        before = {r.path for r in Log(spark, path).state().runs}
        seen.clear()
        search.indexed(Log(spark, path), frame(docs[lo : lo + n]), Log(spark, path).state(), "doc_id", "text")
        assert not {p for paths in seen for p in paths} & before
        grown = search.extend(frame(docs[lo : lo + n]), path)
        lo += n
    assert lo == len(docs)
    whole = search.extend(frame(docs), str(tmp_path / "j"))
    assert (grown.n_docs, grown.avgdl) == (whole.n_docs, whole.avgdl) == (len(docs), grown.avgdl)
    assert all(len(grown.state.of(t)) < 2 * L.FAN for t in ("postings", "terms", "docs")) and {r.level for r in grown.state.runs} >= {1}
    assert round(grown.mean(), 9) == round(whole.mean(), 9)
    for query in ("the of w1 w1", "w3", "zebra", "", "the the"):
        for f in (search.bm25, search.sparse_cosine):
            assert sorted(f(grown, query).collect()) == sorted(f(whole, query).collect())
        for n in (3, 200):
            assert search.bm25_top(grown, query, n).orderBy(F.desc("score"), "doc_id").collect() == search.top(search.bm25(whole, query), n, "doc_id").collect()
    assert Log(spark, path).state() == grown.state


def test_vacuum_and_empty_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), Options(strategy="page"))
    assert engine.search("boats", mode="sparse").count() == engine.search("boats").count() == 0
    engine.log.write("chunks", engine.chunks())
    for lo in range(0, 10, 2):
        engine.ingest(pages(spark, lo, lo + 2))
    before = held(engine)
    assert engine.log.vacuum() == 0 and engine.log.vacuum(hours=0) >= 1
    assert held(engine) == before
    engine.rebuild()
    assert held(engine)[2:] == before[2:]
    assert store.get_json(spark, str(tmp_path / "store" / "sparse.json"))["backend"] == "BM25"
