"""Chunkers that fill windows in order, and ordered removal of near copies.

Each works within one row on arrays of the document's pieces, so that nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

GAP = r"[ \t\x0B\f\r]"
#: Fixed value: where a piece that is too long is cut.
CUT = r"(?<=[,;])\s+|\s{2,}"
HEADER = rf"{GAP}*(#{{1,6}}){GAP}+"


def _strings(*values: Column) -> Column:
    return F.array(*values).cast("array<string>")


def _tokens(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda s, p: s + T.approx_tokens(p))


def packed(pieces: Column, target: int = 700, least: int = 120, overlap: int = 0, sep: str = " ") -> Column:
    """Joined runs of pieces of at most `target` tokens; a run of fewer than `least` is left out.

    The last `overlap` pieces of a full run open the next one. A longer piece is a run of its own.
    """

    def joined(run: Column) -> Column:
        text = F.array_join(run, sep)
        return F.when((F.size(run) > 0) & (T.approx_tokens(text) >= least), _strings(text)).otherwise(_strings())

    def step(a: Column, p: Column) -> Column:
        run, n = a["run"], a["n"] + T.approx_tokens(p)
        full = (n > target) & (F.size(run) > 0)
        carried = F.when(F.size(run) > overlap, F.slice(run, F.size(run) - overlap + 1, F.lit(overlap))).otherwise(run) if overlap else _strings()
        opened = F.concat(carried, _strings(p))
        return F.struct(
            F.when(full, opened).otherwise(F.concat(run, _strings(p))).alias("run"),
            F.when(full, _tokens(opened)).otherwise(n).alias("n"),
            F.when(full, F.concat(a["out"], joined(run))).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(_strings().alias("run"), F.lit(0).alias("n"), _strings().alias("out"))
    return F.aggregate(pieces, start, step, lambda a: F.concat(a["out"], joined(a["run"])))


def merged(pieces: Column, target: int = 700, overlap: int = 80, least: int = 120) -> Column:
    """Lists of pieces: a list is closed once it holds `least` tokens and the next piece would not fit.

    The next list opens with the last pieces of together less than `overlap` tokens. Longer pieces
    are cut at commas, semicolons or double blanks, without overlap.
    """
    cut = lambda p: F.filter(F.split(p, CUT), lambda x: F.trim(x) != "")
    long = lambda p: T.approx_tokens(p) > target
    parts = F.flatten(F.transform(pieces, lambda p: F.when(long(p), F.transform(cut(p), lambda x: F.struct(x.alias("p"), F.lit(True).alias("cut")))).otherwise(F.array(F.struct(p.alias("p"), F.lit(False).alias("cut"))))))

    def back(run: Column) -> Column:
        start = F.struct(_strings().alias("last"), F.lit(0).alias("n"), F.lit(False).alias("done"))

        def step(a: Column, p: Column) -> Column:
            done = a["done"] | (a["n"] + T.approx_tokens(p) >= overlap)
            return F.struct(F.when(done, a["last"]).otherwise(F.concat(_strings(p), a["last"])).alias("last"), F.when(done, a["n"]).otherwise(a["n"] + T.approx_tokens(p)).alias("n"), done.alias("done"))

        return F.aggregate(F.reverse(run), start, step, lambda a: a["last"])

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] + T.approx_tokens(x["p"]) > target) & (a["n"] >= least)
        kept = F.when(~full, a["run"]).when(x["cut"], _strings()).otherwise(back(a["run"]))
        run = F.concat(kept, _strings(x["p"]))
        return F.struct(run.alias("run"), F.when(full, _tokens(run)).otherwise(a["n"] + T.approx_tokens(x["p"])).alias("n"), F.when(full & (F.size(a["run"]) > 0), F.concat(a["out"], F.array(a["run"]))).otherwise(a["out"]).alias("out"))

    start = F.struct(_strings().alias("run"), F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("out"))
    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["run"]) > 0, F.concat(a["out"], F.array(a["run"]))).otherwise(a["out"]))


def rows(docs: DataFrame, keys: list[str], chunks: Column) -> DataFrame:
    return docs.select(*keys, F.posexplode(chunks).alias("chunk_no", "chunk"))


def by_sentences(docs: DataFrame, keys: list[str], text: str = "text", **limits: int) -> DataFrame:
    return rows(docs, keys, packed(T.sentences(F.col(text)), overlap=2, **limits))


def by_paragraphs(docs: DataFrame, keys: list[str], text: str = "text", **limits: int) -> DataFrame:
    stripped = F.transform(F.split(text, "\n\n", -1), lambda p: F.regexp_replace(p, rf"^{T.BLANK}|{T.BLANK}$", ""))
    return rows(docs, keys, packed(F.filter(stripped, lambda p: p != ""), sep="\n\n", **limits))


def by_merged_sentences(docs: DataFrame, keys: list[str], text: str = "text", **limits: int) -> DataFrame:
    """Sentences end before a blank and a capital letter or digit."""
    return rows(docs, keys, F.transform(merged(T.split_sentences(F.col(text)), **limits), lambda run: F.array_join(run, " ")))


def sections(text: Column) -> Column:
    """array<struct<chunk, header_level, section_path, md_types, raw>> of a markdown text.

    A header opens a section under the last header of each lower level; text before the first one
    has level 0. Headers in code fences count too. Blank sections are left out.
    """
    pieces = F.split(text, rf"(?md)^(?={HEADER}\S)")
    whole = T.bound(pieces, lambda ps: F.transform(ps, lambda p, i: F.when(i < F.size(ps) - 1, F.regexp_replace(p, r"\n\z", "")).otherwise(p)))
    head = F.transform(
        whole,
        lambda p: F.struct(
            T.normalize_text(p).alias("chunk"),
            F.length(F.regexp_extract(p, rf"^{HEADER}[^\s]", 1)).alias("level"),
            F.regexp_replace(F.regexp_extract(p, rf"^{HEADER}([^\n]+)", 2), rf"{T.BLANK}$", "").alias("title"),
            T.md_types(p).alias("types"),
            p.alias("raw"),
        ),
    )
    empty = F.array().cast("array<struct<level:int,title:string>>")
    out = F.array().cast("array<struct<chunk:string,header_level:int,section_path:string,md_types:array<string>,raw:string>>")

    def step(a: Column, s: Column) -> Column:
        above = F.filter(a["stack"], lambda x: x["level"] < s["level"])
        stack = F.when(s["level"] > 0, F.concat(above, F.array(F.struct(s["level"].alias("level"), s["title"].alias("title"))))).otherwise(empty)
        path = F.array_join(F.transform(stack, lambda x: x["title"]), " > ")
        row = F.array(F.struct(s["chunk"].alias("chunk"), s["level"].alias("header_level"), path.alias("section_path"), s["types"].alias("md_types"), s["raw"].alias("raw")))
        return F.struct(stack.alias("stack"), F.when(s["chunk"] != "", F.concat(a["out"], row)).otherwise(a["out"]).alias("out"))

    return F.aggregate(head, F.struct(empty.alias("stack"), out.alias("out")), step, lambda a: a["out"])


def by_markdown(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    found = docs.select(*keys, F.posexplode(sections(F.col(text))).alias("chunk_no", "s"))
    return found.select(*keys, "chunk_no", "s.chunk", "s.header_level", "s.section_path", "s.md_types")


def first_of_alike(chunks: Column, over: float = 0.8, n: int = 8) -> Column:
    """Of an array of structs with a field chunk, in order: those not alike to one kept before."""
    known = F.transform(chunks, lambda c: F.struct(c.alias("c"), T.shingles(c["chunk"], n).alias("set")))

    def alike(k: Column, x: Column) -> Column:
        # sets of sizes too far apart can't be alike, so few meet
        a, b = F.size(k["set"]), F.size(x["set"])
        return F.when(F.least(a, b) >= F.greatest(a, b) * over, T.jaccard(k["set"], x["set"]) > over).otherwise(False)

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: alike(k, x)), kept).otherwise(F.concat(kept, F.array(x)))

    return T.bound(known, lambda k: F.transform(F.aggregate(k, F.slice(k, 1, 0), step), lambda x: x["c"]))
