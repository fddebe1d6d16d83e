"""Line dedup against brute force over all pairs of lines."""

import random

from pyspark.sql import functions as F

from quarry.llm import lines


def near(a, b):
    """Word edit distance of at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    i = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def brute(rows):
    every = [(i, n, w.lower().split()) for i, t in rows if t is not None for n, w in enumerate(t.split("\n"))]
    every = sorted((x for x in every if len(x[2]) >= lines.MIN_WORDS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    gone = set()
    for k, (i, n, w) in enumerate(every):
        if any(near(w, v) for _, _, v in every[:k]):
            gone.add((i, n))
    return gone


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "dd", "eé"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(3, 12))] for _ in range(40)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rnd.randint(0, 6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.choice([0, 1])] = [rnd.choice(vocabulary)] * rnd.choice([0, 1, 2])
                w = w or ["a"]
            out.append(rnd.choice([" ", "  "]).join(w))
        rows.append((i, "\n".join(out)))
    return [*rows, (100, None), (101, ""), (None, rows[3][1]), (102, "A B\tc dd Е a b c"), (103, "w " * 5000)]


def test_brute_force(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        got = {(r.doc_id, r.line_no) for r in lines.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows)


def test_texts(spark):
    df = spark.createDataFrame([(1, "one two three four five\nx", "s"), (2, "one two three four five", "s"), (3, "y\none two three six five\n", "s"), (4, None, "s")], "doc_id long, text string, gone string")
    df = df.withColumns({c: F.col("gone") for c in ("doc", "h", "first", "g")})
    got = {r.doc_id: (r.text, r.lines_removed) for r in lines.dedup_lines(df).collect()}
    assert lines.dedup_lines(df).columns == [*df.columns, "lines_removed"]
    assert got == {1: ("one two three four five\nx", 0), 2: ("", 1), 3: ("y\n", 1), 4: (None, 0)}


def test_empty(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def brute_every(rows, chars, bound, spaceless="我们今天下午一起去北南京看大学的图书馆和新旧博物院ก"):
    """All lines that are not blank, by a floor of its own: five words, or so many characters outside the longest word."""
    every = []
    for i, t in rows:
        for n, line in enumerate((t or "").lower().split("\n")):
            w = line.split()
            x = "".join(f" {c} " if c in spaceless else c for c in line).split()
            if w:
                every.append((i, n, w, x, len(w) >= 5 or len("".join(x)) - max(map(len, x)) >= chars))
    every.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    return {(i, n) for k, (i, n, w, x, near) in enumerate(every) if any(w == v or (near and also and edits(x, y) <= bound) for _, _, v, y, also in every[:k])}


def test_every_line_and_bound(spark):
    long = [f"w{i}" for i in range(30)]
    two = [*long[:4], "new", *long[5:20], "other", *long[21:]]
    rows = [*[r for r in corpus(4) if r[0] != 103][:30], (200, "Chapter 1\n}\nx\n" + " ".join(long)), (201, "chapter  1\n }\n\n  \ny"), (202, " ".join(two))]
    rows += [(203, "我们今天下午一起去北京看大学的图书馆和新博物院\n我们去北京"), (204, "我们今天下午一起去南京看大学的图书馆和新博物院\n我们去南京\n我们去北京")]
    rows += [(205, "https://a.example/one/two/three\ninternationalisation administration today"), (206, "https://a.example/one/two/four\ninternationalisation administration tomorrow")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no) for r in lines.removed(df, chars=20).collect()}
    assert got == brute_every(rows, 20, 1)
    assert {(201, 0), (201, 1), (204, 0), (204, 2)} <= got and not {(202, 0), (204, 1), (206, 0)} & got
    few = [r for r in rows if r[0] is None or not 10 <= r[0] < 100]
    got = {(r.doc_id, r.line_no) for r in lines.removed(spark.createDataFrame(few, "doc_id long, text string"), chars=20, edits=2).collect()}
    assert got == brute_every(few, 20, 2) and (202, 0) in got


def test_null_and_repeated_ids(spark):
    line = "one two three four five"
    rows = [(None, f"{line}\nown line of the first text here"), (None, f"another text begins with its own line\n{line}"), (4, f"{line}\nzz"), (4, f"yy\n{line}"), (4, f"yy\n{line}")]
    got = sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    every = "\n".join(t for _, t in got).split("\n")
    assert every.count(line) == 1 and every.count("zz") == 1 and every.count("yy") == 2
    assert every.count("own line of the first text here") == every.count("another text begins with its own line") == 1
