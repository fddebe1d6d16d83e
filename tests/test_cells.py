"""The index of cells finds what a look at all vectors finds, and reads less where vectors lie in groups."""

import numpy as np
import pytest

from quarry.operators import cells
from quarry.operators.cells import Cells
from quarry.sources.log import Log

KIND = "vec_id long, embedding array<double>, cell string, away string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND)


def wanted(rows, query, n, score="dot", size=None):
    """Brute force."""
    found = []
    for i, v in rows:
        if v is not None and len(v) == (size or len(query)) and all(x is not None and np.isfinite(x) for x in v):
            d = sum(a * b for a, b in zip(v, query))
            found.append((-round({"dot": d, "clamped": max(0.0, d), "l2": max(0.0, 2 * d - 1)}[score], 9), i))
    return [(i, -s) for s, i in sorted(found)[:n]]


def same(got, want):
    got = [(r.vec_id, r.score) for r in got.collect()]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-8)


def grouped(n, size=12, groups=20, seed=3, width=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size))
    return [(i, (middles[i % groups] + width * rng.normal(size=size)).tolist()) for i in range(n)]


def test_brute_force_over_batches(spark, tmp_path):
    rows = grouped(900) + [(10_000 + i, v) for i, v in grouped(60, seed=8, width=3.0)]
    rows += [(20_000 + i, rows[5][1]) for i in range(40)]  # copies: ties go by key
    path = str(tmp_path / "i")
    for part in (rows[:300], rows[300:310], rows[310:900], rows[900:]):
        cells.extend(table(spark, part), path)
    index = Cells.read(spark, path)
    assert index.vectors().count() == len(rows)
    for q in (rows[5][1], [-x for x in rows[7][1]], [0.0] * 12, np.random.default_rng(1).normal(size=12).tolist()):
        for score in ("dot", "clamped", "l2"):
            same(index.nearest(q, 10, score), wanted(rows, q, 10, score))
    same(index.nearest(rows[5][1], 2000), wanted(rows, rows[5][1], 2000))


def test_groups_are_left_out(spark, tmp_path):
    rows = grouped(3000, groups=50)
    index = cells.extend(table(spark, rows), str(tmp_path / "i"))
    look = index.look(rows[0][1], 10)
    same(look.rows, wanted(rows, rows[0][1], 10))
    assert look.cells > 20 and look.vectors_read < 0.25 * len(rows)


def test_odd_vectors(spark, tmp_path):
    rows = grouped(50) + [(100, None), (101, []), (102, [None] * 12), (103, [float("nan")] + [0.0] * 11), (104, [float("inf")] * 12), (105, [1.0] * 5), (106, [0.0] * 12), (107, [1e200] * 12), (108, [-1e300] * 12)]
    index = cells.extend(table(spark, rows), str(tmp_path / "i"))
    assert index.vectors().count() == len(rows)
    for q in (rows[0][1], [0.001] * 12, [0.0] * 12):
        got = [r.vec_id for r in index.nearest(q, 100).collect()]
        assert sorted(got) == [*range(50), 106, 107, 108]
        assert got[:5] == [i for i, _ in wanted(rows, q, 5)]
    with pytest.raises(ValueError):
        index.nearest([1.0], 3)


def test_empty_and_later_vectors(spark, tmp_path):
    path = str(tmp_path / "i")
    none = cells.extend(table(spark, []), path)
    assert none.nearest([1.0] * 12, 5).count() == 0 and none.vectors().count() == 0
    cells.extend(table(spark, [(1, None)]), path)
    rows = grouped(30)
    same(cells.extend(table(spark, rows), path).nearest(rows[3][1], 4), wanted(rows, rows[3][1], 4))


def test_cells_grow_and_runs_merge(spark, tmp_path):
    path, rows = str(tmp_path / "i"), grouped(700)
    cells.extend(table(spark, rows[:10]), path)
    few = len(Log(spark, path).read(Log(spark, path).state().of("centres"), cells.schemas("vec_id", "bigint")["centres"]).collect())
    for lo in range(10, 700, 115):
        index = cells.extend(table(spark, rows[lo : lo + 115]), path)
    look = index.look(rows[4][1], 10)
    assert look.cells > few and len(index.state.of("vectors")) < 6
    assert index.state.info["n_vectors"] == 700 == index.vectors().count()
    same(look.rows, wanted(rows, rows[4][1], 10))


def test_a_failed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "i"), grouped(60)
    cells.extend(table(spark, rows[:40]), path)
    with monkeypatch.context() as m:
        m.setattr(Log, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            cells.extend(table(spark, rows[40:]), path)
    assert Cells.read(spark, path).vectors().count() == 40
    same(cells.extend(table(spark, rows[40:]), path).nearest(rows[50][1], 7), wanted(rows, rows[50][1], 7))
