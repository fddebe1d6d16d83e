"""Sentences after Kiss and Strunk (2006), learned without labels: abbreviations, collocations and sentence starters from one corpus.

One pass counts, by Spark, how often each word type stands with and without a full stop, capitalised and small, at which kinds of places, and which words stand
on both sides of a full stop. Log-likelihood ratios then decide, type by type: what is (nearly) always followed by a full stop and is
short is an abbreviation; what follows full stops more often than elsewhere starts sentences; pairs that meet over a full stop more often than chance are
collocations, which no sentence end divides. What is learned are three small tables of types whose number is checked before they are broadcast;
a larger model is joined by shuffle to the candidates of its types. The split itself is Column functions over the tokens of one row.

Arrays that are worked out from texts are exploded with *_outer: for explode, Spark looks at their size first, and works them out twice or more.

Types are lower-cased; numbers are the type ##number##. A token is a run without white space, stripped of quotes and brackets. Null texts have no sentences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import store

# Fixed values of the published method: least scores, and what a token can be.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
NUMBER = "##number##"
#: So many learned types are broadcast.
FEW = 200_000
_EDGE = r"^[\p{Ps}\p{Pi}\"'`]+|[\p{Pe}\p{Pf}\"'`]+$"


def runs(text: Column) -> Column:
    """array<string> of a text: its runs without white space."""
    return F.filter(F.split(text, T.BLANK), lambda r: r != "")


def token(raw: Column) -> Column:
    """struct<type, dot, upper, lower, ended> of a run: its type without a final full stop, whether it has one, how its first letter is written, and whether
    ! or ? ends it. Several patterns a run: it is for distinct runs and for those with a mark, not for every place of a corpus."""

    def of(bare: Column) -> Column:
        def kinds(body: Column) -> Column:
            kind = F.when(body.rlike(r"^[-+]?[0-9][0-9.,]*$"), F.lit(NUMBER)).otherwise(F.lower(body))
            return F.struct(kind.alias("type"), bare.rlike(r"[^.]\.$").alias("dot"), body.rlike(r"^\p{Lu}").alias("upper"), body.rlike(r"^\p{Ll}").alias("lower"), bare.rlike(r"[!?]$|\.\.+$").alias("ended"))

        return T.bound(F.regexp_replace(bare, r"[.!?,;:]+$", ""), kinds)

    return T.bound(F.regexp_replace(raw, _EDGE, ""), of)


def _marked(raw: Column) -> Column:
    """Whether a run can end a sentence: it has a mark somewhere."""
    return F.contains(raw, F.lit(".")) | F.contains(raw, F.lit("!")) | F.contains(raw, F.lit("?"))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """type, n, dots, upper_n, lower_n and, of its places after a sentence end, starts: one row a word type.

    Places are counted by their run and by whether one before it, which must have a mark, ends a sentence; only these distinct runs are looked at by patterns.
    """
    ends = lambda r: T.bound(F.regexp_replace(r, _EDGE, ""), lambda bare: bare.rlike(r"[^.]\.$|[!?]$|\.\.+$"))
    row = lambda t: lambda x, i: F.struct(x.alias("raw"), F.when(_marked(F.get(t, i - 1)), ends(F.get(t, i - 1))).otherwise(F.lit(False)).alias("start"))
    each = docs.select(F.explode_outer(T.bound(runs(F.col(text)), lambda t: F.transform(t, row(t)))).alias("e")).where("e is not null").groupBy("e.raw", "e.start").agg(F.count("*").alias("times"))
    flat = each.select("times", "start", token(F.col("raw")).alias("t")).select("times", "start", "t.*").where("type <> ''")
    flags = {"dots": "dot", "upper_n": "upper", "lower_n": "lower", "starts": "start"}
    return flat.groupBy("type").agg(F.sum("times").alias("n"), *[F.sum(F.when(F.col(c), F.col("times")).otherwise(F.lit(0).cast("long"))).alias(name) for name, c in flags.items()])


def _meeting(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, at, raw, next of the runs that have a mark."""
    place = lambda t: lambda x, i: F.when(_marked(x), F.struct(i.alias("at"), x.alias("raw"), F.get(t, i + 1).alias("next")))
    some = lambda t: F.filter(F.transform(t, place(t)), lambda p: p["next"].isNotNull())
    return docs.select(*keys, F.explode_outer(T.bound(runs(F.col(text)), some)).alias("e")).where("e is not null").select(*keys, "e.*")


def pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """a, b, n: how often type b follows type a and a full stop."""
    each = _meeting(docs, [], text).groupBy("raw", "next").agg(F.count("*").alias("times"))
    known = each.select("times", token(F.col("raw")).alias("t"), token(F.col("next")).alias("u")).where("t.dot and t.type <> '' and u.type <> ''")
    return known.groupBy(F.col("t.type").alias("a"), F.col("u.type").alias("b")).agg(F.sum("times").alias("n"))


def _ln(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-300)))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    return k * _ln(p) + (n - k) * _ln(1 - p)


def dunning(a: Column, b: Column, both: Column, n: Column) -> Column:
    """-2 log lambda that a is followed by b at one rate, whether or not it is a."""
    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    return -2 * (_likelihood(both, a, p) + _likelihood(b - both, n - a, p) - _likelihood(both, a, p1) - _likelihood(b - both, n - a, p2))


def abbreviations(counted: DataFrame) -> DataFrame:
    """type, score of the types that are abbreviations: dots far beyond half the places, few letters, inner full stops."""
    total = counted.agg(F.sum("n").cast("double").alias("all_n"), F.sum("dots").cast("double").alias("all_dots"))  # one row
    rows = counted.where(f"dots > 0 and type <> '{NUMBER}'").join(F.broadcast(total))
    n, dots = F.col("n").cast("double"), F.col("dots").cast("double")
    # how well 0.99 explains the full stops after the type, against their rate after all types
    ratio = -2 * (_likelihood(dots, n, F.col("all_dots") / F.col("all_n")) - _likelihood(dots, n, F.lit(0.99)))
    inner = F.length("type") - F.length(F.translate("type", ".", ""))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -(n - dots))
    return rows.where(F.col("type").rlike(r"\p{L}")).select("type", F.round(score, 6).alias("score")).where(F.col("score") >= ABBREVIATION)


def starters(counted: DataFrame) -> DataFrame:
    """type, score of the types that begin sentences."""
    total = counted.agg(F.sum("n").cast("double").alias("all_n"), F.sum("starts").cast("double").alias("breaks"))
    rows = counted.where("starts > 0 and upper_n > 0").join(F.broadcast(total))
    n, starts = F.col("n").cast("double"), F.col("starts").cast("double")
    score = F.round(dunning(F.col("breaks"), n, starts, F.col("all_n")), 6)
    return rows.select("type", score.alias("score"), (starts / F.col("breaks") > n / F.col("all_n")).alias("more")).where((F.col("score") >= STARTER) & F.col("more")).drop("more")


def collocations(counted: DataFrame, paired: DataFrame) -> DataFrame:
    """a, b, score of the pairs that belong together over a full stop."""
    total = counted.agg(F.sum("n").cast("double").alias("all_n"))
    of = lambda name: counted.select(F.col("type").alias(name), F.col("n").cast("double").alias(f"n_{name}"))
    rows = paired.where("n > 1").join(of("a"), "a").join(of("b"), "b").join(F.broadcast(total))
    both = F.col("n").cast("double")
    score = F.round(dunning(F.col("n_a"), F.col("n_b"), both, F.col("all_n")), 6)
    return rows.select("a", "b", score.alias("score"), (both / F.col("n_a") > F.col("n_b") / F.col("all_n")).alias("more")).where((F.col("score") >= COLLOCATION) & F.col("more")).drop("more")


@dataclass(frozen=True)
class Model:
    """abbreviations, starters (type) and, of what follows full stops, collocations (a, b); cases: type, upper_n, lower_n."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Counts once, in two passes over the corpus, and keeps what it learned in the shared folder."""
    counted = store.written(counts(docs, text), "punkt-counts")
    own = store.written(abbreviations(counted), "punkt-abbreviations")
    # a collocation matters only where its first word is an abbreviation or a number
    known = own.select(F.col("type").alias("a")).unionAll(docs.sparkSession.createDataFrame([(NUMBER,)], "a string"))
    together = store.written(collocations(counted, pairs(docs, text)).join(known, "a", "left_semi"), "punkt-collocations")
    return Model(own, store.written(starters(counted), "punkt-starters"), together, counted.select("type", "upper_n", "lower_n"))


def breaks(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys, at of each token (from 0) that ends a sentence.

    ! and ? end one. A full stop does so unless its word is an abbreviation, an initial or a number; after these it does where the next word
    is a known starter in capitals, or is written small elsewhere too and stands in capitals here, and is no collocation.
    """
    known = _meeting(docs, keys, text).select(*keys, "at", token(F.col("raw")).alias("t"), token(F.col("next")).alias("u"))
    flat = known.select(*keys, "at", F.col("t.type").alias("a"), "t.dot", "t.ended", F.col("u.type").alias("b"), F.col("u.upper").alias("capital")).where("dot or ended")
    plain = flat.where("ended").select(*keys, "at")
    asked = flat.where("not ended")
    flag = lambda df, name, *cols: df.select(*cols).distinct().withColumn(name, F.lit(True))
    few = lambda df: F.broadcast(df) if df.count() <= FEW else df
    asked = asked.join(few(flag(model.abbreviations, "short", F.col("type").alias("a"))), "a", "left").join(few(flag(model.collocations, "together", "a", "b")), ["a", "b"], "left")
    asked = asked.join(few(flag(model.starters, "starter", F.col("type").alias("b"))), "b", "left").join(few(model.cases.where("lower_n > 0").select(F.col("type").alias("b"), F.lit(True).alias("small"))), "b", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    initial = F.col("a").rlike(r"^\p{L}$")
    kept = true("short") | initial | (F.col("a") == NUMBER)
    opens = F.col("capital") & (true("starter") | (true("small") & ~initial))
    ends = F.when(kept, opens & ~true("together")).otherwise(True)
    return plain.unionByName(asked.where(ends).select(*keys, "at"))


def _cut(t: Column, ends: Column) -> Column:
    def piece(end: Column, i: Column) -> Column:
        start = F.when(i > 0, F.get(ends, i - 1) + 1).otherwise(0)
        return F.array_join(F.slice(t, start + 1, end - start + 1), " ")

    return F.when(F.size(t) > 0, F.transform(ends, piece)).otherwise(F.array().cast("array<string>"))


def sentence_arrays(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column sentences: its texts cut at the breaks, white space between words as one blank.

    Rows are numbered where they are written, in the shared folder, so that their places find them again.
    """
    spark, row = docs.sparkSession, "punkt_row"
    path = store.fresh(spark, "punkt")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    places = breaks(rows, model, [row], text).groupBy(row).agg(F.array_sort(F.collect_list("at")).alias("cuts"))  # of one text
    found = rows.join(places, row, "left")
    cuts = F.coalesce("cuts", F.array().cast("array<int>"))
    pieces = lambda t: T.bound(F.concat(cuts, F.array(F.size(t) - 1)), lambda ends: _cut(t, ends))
    return found.withColumn("sentences", T.bound(runs(F.col(text)), pieces)).drop(row, "cuts")


def sentences(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys, sentence_no, sentence."""
    return sentence_arrays(docs.select(*keys, text), model, text).select(*keys, F.posexplode_outer("sentences").alias("sentence_no", "sentence")).where("sentence_no is not null")
