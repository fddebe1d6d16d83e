"""Near-duplicate lines by a deletion-neighbourhood join (operator 5), in DataFrame functions only.

A line is a piece between line feeds, read as a lower-cased sequence of words. A line is removed if
an earlier line, by (doc_id, line number), is equal or within the edit bound (words inserted, deleted
or replaced, one by default); the earliest stays. Every line that is not blank takes part in step 1, and
in the others those of at least `least` words or of `chars` characters outside their longest word;
there each character of a script without spaces is a word. Without chars only lines of at least `least`
words take part, in all steps.

1. Equal lines collapse: 128 bits of hash of a line and its earliest place, aggregated before the shuffle.
2. Lines within one edit have min(n) // 2 first or last words in common, so only lines that share
   such a half with another line go on; nothing is lost by that.
3. Those emit a key for each deletion of a word (its place, and the hashes of the words before and
   after it) and for each gap between words (likewise). Lines with a deletion in common differ in that word
   only; a deletion of one that is a gap of another is a word more. Each is joined with the
   earliest of its key alone, never in pairs, and the edit distance of that pair is verified on the
   words. The hashes before and after come from running hashes, so a line of n words costs n of them.
4. With more than one edit, steps 2 and 3 give way to one without a filter: all ways to delete or
   mark so many places, about (2n) ** edits a line of n words. Lines that share what is left and
   its places are within the bound of each other.

Edge cases: null and empty texts stay as they are; a document of removed lines only keeps its row
with an empty text; null doc_id sorts first; of rows that repeat a doc_id the one with the smaller hash of
its text is the earlier, and each has removals of its own; rows that repeat a doc_id with a text share
them; lines of any length are whole; empty tables give empty results; other columns are kept, whatever
their names, but for one called lines_removed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import dropped, stored, text_hash

MIN_WORDS, NEAR_CHARS, EDITS = 5, 20, 1
#: Tables of up to so many rows of a few longs are broadcast after they are counted; larger ones are joined by shuffle.
BROADCAST_ROWS = 400_000
GAPS = "\t\x0b\f\r"
#: Characters of scripts without spaces between words, and a quick range that holds them.
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*"
BEYOND = r"[\x{0e00}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{ffff}\x{16fe0}-\x{3ffff}]"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _single(c: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(c))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines that are not blank: doc_id, doc (hash of the text), line_no, line (words with single blanks), compared (with blanks around spaceless characters)."""
    # gaps are rare, and a text is hashed and split before its lines are rows
    gaps = functools.reduce(lambda x, y: x | y, (F.contains(F.col(text), F.lit(c)) for c in GAPS))
    plain = F.when(gaps, F.translate(text, GAPS, " " * len(GAPS))).otherwise(F.col(text))
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("doc"), F.split(plain, "\n", -1).alias("lines"))
    lines = lines.select("doc_id", "doc", F.posexplode("lines").alias("line_no", "line")).where(F.trim("line") != "")
    # a step of its own, so that it is worked out once
    lines = lines.withColumn("line", F.lower("line")).withColumn("line", _single(F.col("line")))
    # each such character takes three bytes at least
    apart = (F.octet_length("line") - F.length("line") > 1) & F.col("line").rlike(BEYOND)
    return lines.withColumn("compared", F.when(apart, _single(F.regexp_replace("line", f"({SPACELESS})", " $1 "))).otherwise(F.col("line")))


def _count(line: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int | None = None, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, doc, line_no, h and h2 (hashes of the words), compared, n (its words) and near (whether it is compared) of every line that takes part."""
    lines = _lines(docs, doc_id, text).withColumn("n", _count("compared"))
    enough = F.when(F.col("compared") == F.col("line"), F.col("n")).otherwise(_count("line")) >= least
    length = F.length(F.replace("compared", F.lit(" "), F.lit("")))
    rest = length - F.array_max(F.transform(F.split("compared", " "), F.length))
    if chars is None:
        lines = lines.where(enough)
    near = F.lit(True) if chars is None else F.when(enough, True).when(length <= chars, False).otherwise(rest >= chars)
    h, h2 = text_hash("line")
    return lines.select("doc_id", "doc", "line_no", h.alias("h"), h2.alias("h2"), "compared", "n", near.alias("near"))


def _halves() -> Column:
    """Hashes of the first and last words that a line within one edit must share one of.

    Of two lines within one edit the shorter, of n words, shares n // 2 with the other at one end. The
    lengths are rounded down to fours where that leaves some, so a line and one a word longer seldom differ.
    """
    part = lambda k: F.when(k < 4, k).otherwise(k - k % 4)
    a, b = part(F.floor(F.col("n") / 2).cast("int")), part(F.floor((F.col("n") - 1) / 2).cast("int"))
    key = lambda side, k: F.xxhash64(F.lit(side), k, F.call_function("substring_index", F.col("compared"), F.lit(" "), k if side == "<" else -k))
    both = F.array(key("<", a), key(">", a))
    return F.when(a == b, both).otherwise(F.concat(both, F.array(key("<", b), key(">", b))))


def _running(words: Column) -> Column:
    """Hashes of the first 0, 1, ... words."""
    return F.aggregate(words, F.array(F.lit(0).cast("long")), lambda hashes, w: F.array_append(hashes, F.xxhash64(F.element_at(hashes, -1), w)))


def _neighbours(words: Column) -> Column:
    """gap and deletion at each place: hashes of the place and of the words before and after.

    Every word of a run of equal words counts: a replaced word may be any of them, and the line it
    is replaced in may have a shorter run or none there.
    """
    bound = F.array(F.struct(F.size(words).alias("n"), _running(words).alias("upto"), _running(F.reverse(words)).alias("last")))

    def keys(b: Column) -> Column:
        at = lambda k, more: F.xxhash64(k, F.get(b["upto"], k), F.get(b["last"], b["n"] - k - more))
        return F.transform(F.sequence(F.lit(0), b["n"]), lambda k: F.struct(at(k, 0).alias("gap"), F.when(k < b["n"], at(k, 1)).alias("deletion")))

    return F.flatten(F.transform(bound, keys))


def within_one(a: str, b: str) -> Column:
    """Whether the word edit distance of two different word lists is one."""
    x, y = F.col(a), F.col(b)
    n = F.least(F.size(x), F.size(y))
    upto = F.sequence(F.lit(1), n)
    differ = F.coalesce(F.array_min(F.filter(upto, lambda i: F.element_at(x, i) != F.element_at(y, i))), n + 1)
    rest = lambda c, more: F.slice(c, differ + more, F.size(c))
    same = F.when(F.size(x) == F.size(y), rest(x, 1) == rest(y, 1))
    same = same.when(F.size(x) == F.size(y) + 1, rest(x, 1) == rest(y, 0))
    return F.coalesce(same.when(F.size(y) == F.size(x) + 1, rest(x, 0) == rest(y, 1)), F.lit(False))


def _edited(chosen: DataFrame, edits: int) -> DataFrame:
    """h, h2 of the lines with an earlier one within the bound, by all ways to delete or mark `edits` places."""
    own = ("h", "h2", "first")
    now = chosen.select(*own, "words", F.array().cast("array<int>").alias("gaps"))
    for _ in range(edits):
        n = F.size("words")
        mark = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.col("words").alias("words"), F.array_sort(F.array_append("gaps", i)).alias("gaps")))
        cut = lambda i: F.concat(F.slice("words", F.lit(1), i), F.slice("words", i + 2, n))
        moved = lambda i: F.transform("gaps", lambda g: F.when(g > i, g - 1).otherwise(g))
        drop = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.struct(cut(i).alias("words"), F.array_sort(F.array_append(moved(i), i)).alias("gaps")))
        now = now.select(*own, F.explode(F.concat(mark, drop)).alias("e")).select(*own, "e.*").distinct()
    now = stored(now.select(*own, F.xxhash64("words", "gaps").alias("key"), F.xxhash64(F.lit(17), "words", "gaps").alias("key2")), "edited")
    earliest = now.groupBy("key", "key2").agg(F.min("first").alias("e"))
    return now.join(earliest, ["key", "key2"]).where(F.col("e") < F.col("first")).select("h", "h2").distinct()


def _within_one(chosen: DataFrame) -> DataFrame:
    """h, h2 of the lines with an earlier one within one edit."""
    own = ("h", "h2", "first")
    places = chosen.select(*own, F.explode(_neighbours(F.col("words"))).alias("k")).select(*own, F.posexplode(F.array("k.gap", "k.deletion")).alias("deleted", "key")).where("key is not null")
    # keys that two lines share, of one at least by a deletion; few of all
    common = places.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("deleted").alias("deleted")).where("low < high and deleted = 1")
    shared = stored(places.join(_small(stored(common.select("key"), "common")), "key"), "places")
    line = F.struct("first", "h", "h2")
    earliest = shared.groupBy("key").agg(F.min(F.when(F.col("deleted") == 1, line)).alias("by_deletion"), F.min(F.when(F.col("deleted") == 0, line)).alias("by_gap"))
    met = shared.join(earliest, "key")
    pairs = met.select(*own, F.explode(F.when(F.col("deleted") == 1, F.array("by_deletion", "by_gap")).otherwise(F.array("by_deletion"))).alias("e"))
    pairs = pairs.where(F.col("e.first") < F.col("first")).select("h", "h2", F.col("e.h").alias("other"), F.col("e.h2").alias("other2")).distinct()
    words = chosen.select("h", "h2", "words")
    others = words.toDF("other", "other2", "others")
    return stored(pairs, "line-pairs").join(words, ["h", "h2"]).join(others, ["other", "other2"]).where(within_one("words", "others")).select("h", "h2").distinct()


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int | None = None, edits: int = EDITS, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, doc (hash of the text), line_no, near (false: an earlier line is equal) of each line to remove."""
    line, at = ["h", "h2"], ["doc_id", "doc", "line_no"]
    place = F.struct(*at)
    read = occurrences(docs, doc_id, text, chars, least)
    halves = _halves() if edits == 1 else F.array(F.lit(0).cast("long"))
    found = stored(read.select(*at, *line, F.when(F.col("near"), halves).alias("halves")), "lines")
    distinct = stored(found.groupBy(*line).agg(F.min(place).alias("first"), F.count("*").alias("n")), "distinct-lines")

    keyed = found.select(*line, F.explode("halves").alias("half"))
    shared = stored(keyed.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("half"), "halves")
    likely = stored((keyed.join(_small(shared), "half") if edits == 1 else keyed if edits else keyed.limit(0)).select(*line).distinct(), "likely")
    # the words of the likely lines, read again at the earliest place of each
    where = stored(distinct.join(_small(likely), line).select(*line, "first", *(F.col(f"first.{c}").alias(f"at_{c}") for c in at)), "places")
    same = F.col("doc_id").eqNullSafe(F.col("at_doc_id")) & (F.col("doc") == F.col("at_doc")) & (F.col("line_no") == F.col("at_line_no"))
    chosen = _lines(docs, doc_id, text).join(_small(where), same).select(*line, "first", F.split("compared", " ").alias("words"))
    chosen = stored(chosen.dropDuplicates(line), "likely-lines")  # rows may repeat
    checked = _within_one(chosen) if edits == 1 else _edited(chosen, edits)

    marks = distinct.join(checked.withColumn("near", F.lit(True)), line, "left").where("near or n > 1").select(*line, "first", F.coalesce("near", F.lit(False)).alias("near"))
    marks = stored(marks, "marks")
    out = found.select(*at, *line).join(_small(marks), line)
    result = stored(out.where(F.col("near") | ~place.eqNullSafe(F.col("first"))).select(*at, "near"), "removed-lines")
    dropped(docs.sparkSession, found, distinct, shared, likely, where, chosen, marks)
    return result


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int | None = NEAR_CHARS, edits: int = EDITS, least: int = MIN_WORDS) -> DataFrame:
    """All columns, with text rid of the removed lines, and lines_removed."""
    gone = removed(docs, doc_id, text, chars, edits, least).groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("gone")).alias("g")
    columns = [c for c in docs.columns if c != "lines_removed"]
    joined = docs.alias("d").join(gone, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64(f"d.`{text}`") == F.col("g.doc")), "left")
    own = F.col(f"d.`{text}`")
    kept = F.array_join(F.filter(F.split(own, "\n", -1), lambda line, i: ~F.array_contains("g.gone", i)), "\n")
    cut = F.when(F.col("g.gone").isNull(), own).otherwise(kept)
    return joined.select(*[cut.alias(c) if c == text else F.col(f"d.`{c}`") for c in columns], F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("lines_removed"))
