"""Extractive answers with references from ranked chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import policy

# Stop words, then for each kind of question its trigger words, and points by pattern.
STOP = {"the", "and", "are", "what", "how", "when", "where", "why"}
HOURS = ["hours"]
HOURS_PATTERNS = {r"[0-9]{1,2}:[0-9]{2}\s*(?:am|pm)": 3, r"[0-9]{1,2}\s*(?:am|pm)": 3, "monday|tuesday|wednesday|thursday|friday|saturday|sunday": 3, "schedule|timing|hours|shift": 3}
POLICY = ["dress code", "clothing", "prohibit", "policy"]
POLICY_PATTERNS = {r"prohibit[s]?\s+(?:the\s+)?following": 4, r"not\s+allowed": 4, "forbidden": 4, r"dress\s+code": 4, r"(?:ripped|low\s+cut|casual|track\s+suit)": 4}
ELIGIBLE = ["eligibility", "criteria", "requirements", "eligible", "outline"]
ELIGIBLE_PATTERNS = {"eligib(?:le|ility)": 5, "criteria|requirements": 5, r"must\s+(?:have|be|complete)": 5, r"probation(?:ary)?\s+period": 5, "performance.*(?:meeting|exceeding)": 5, r"completed?\s+their": 5, r"consistent\s+record": 5}
HOME = ["wfh", "work from home"]
HOME_PATTERNS = {
    r"not\s+all\s+positions?\s+(?:are\s+)?eligible": 6,
    r"case-by-case\s+basis": 6,
    r"discretion\s+of.*manager": 6,
    r"emergency\s+cases": 6,
    r"hometowns?\s+(?:is\s+)?not\s+permitted": 6,
    r"connectivity\s+issues": 6,
    r"avoid\s+miscommunication": 6,
    "work from home|wfh|remote work": 3,
}
UNKNOWN = "Not enough information in the provided context."


def keywords(query: str) -> list[str]:
    return sorted({w for w in query.lower().split() if len(w) > 2 and w not in STOP})


def _asked(query: str, words: list[str]) -> bool:
    return any(w in query.lower() for w in words)


def _points(query: str, sentence: Column) -> Column:
    lower, total = F.lower(sentence), F.lit(0)
    for w in keywords(query):
        total = total + F.when(F.contains(lower, F.lit(w)), 2).otherwise(0)
    patterns = HOURS_PATTERNS if _asked(query, HOURS) else {}
    if _asked(query, POLICY):
        patterns = patterns | POLICY_PATTERNS
        commas = F.length(sentence) - F.length(F.translate(sentence, ",", ""))
        total = total + F.when(F.contains(sentence, F.lit(":")) & (commas >= 2), 3).otherwise(0)
    if _asked(query, ELIGIBLE):
        patterns = patterns | ELIGIBLE_PATTERNS | (HOME_PATTERNS if _asked(query, HOME) else {})
    for pattern, points in patterns.items():
        total = total + F.when(lower.rlike(pattern), points).otherwise(0)
    return total + F.when(sentence.rlike("[0-9]"), 1).otherwise(0) - F.when(F.size(T.words(sentence)) > 50, 1).otherwise(0)


def scored_sentences(chunks: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_no, sentence, points (2 or more) of the chunks that contain a keyword."""
    words = keywords(query)
    wanted = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)) if words else F.lit(False)
    found = chunks.where(wanted).select(key, F.posexplode(T.sentences(F.col(text))).alias("sentence_no", "sentence"))
    return found.where(F.length("sentence") >= 10).withColumn("points", _points(query, F.col("sentence"))).where("points >= 2")


def selected(ranked: DataFrame, query: str, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """One row, picked: up to five (eight) unlike sentences of the ranked chunks, most relevant first, ties in the
    order of the chunks' ranks.

    The chunks are the few that a search returns, so their sentences fit in one row.
    """
    most = 8 if _asked(query, [*HOME, "policy"]) else 5
    ranks = ranked.select(key, F.col(score).alias("score_of"), F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank"))  # of a search's few chunks
    found = scored_sentences(ranked, query, key, text).join(ranks, key)
    relevance = F.col("points") + F.col("score_of") * 0.5
    order = F.struct((-relevance).alias("minus"), "rank", "sentence_no", F.col(key).alias("key"), "sentence", T.shingles(F.col("sentence"), 4).alias("set"))
    everything = F.sort_array(F.collect_list(order))

    def step(kept: Column, x: Column) -> Column:
        alike = F.exists(kept, lambda k: T.jaccard(k["set"], x["set"]) > 0.6)
        return F.when((F.size(kept) >= most) | alike, kept).otherwise(F.concat(kept, F.array(x)))

    listed = found.agg(everything.alias("all"))
    picked = F.aggregate("all", F.slice("all", 1, 0), step)
    return listed.select(F.transform(picked, lambda x: F.struct(x["key"].alias("key"), x["sentence"].alias("sentence"), (-x["minus"]).alias("relevance"))).alias("picked"))


def answer(ranked: DataFrame, query: str, key: str = "doc_id", text: str = "text", score: str = "score", company: str = "the company") -> DataFrame:
    """One row: answer and the keys of the chunks that it uses."""
    texts = lambda rows, n: F.slice(F.transform(rows, lambda x: x["sentence"]), 1, n)
    picked = selected(ranked, query, key, text, score)
    high = texts(F.filter("picked", lambda x: x["relevance"] >= 5), 3)
    medium = texts(F.filter("picked", lambda x: (x["relevance"] >= 3) & (x["relevance"] < 5)), 2)
    parts = F.when(F.size(high) < 2, F.concat(high, medium)).otherwise(high)
    found = F.array_join(parts, " ")
    if _asked(query, ["dress code", "prohibit", "clothing"]):
        found = T.bound(found, lambda t: policy.formatted(t, query, company))
    shown = F.when(F.size("picked") == 0, UNKNOWN).otherwise(T.normalize_text(found))
    return picked.select(shown.alias("answer"), F.array_distinct(F.transform("picked", lambda x: x["key"])).alias("used"))


#: Fixed value: what a language model says that has found nothing.
DECLINED = "not enough information"
MODES = ("extractive", "gpt_enhanced", "hybrid")


def answered(ranked: DataFrame, query: str, mode: str = "extractive", model: Callable[[str, str], str] | None = None, key: str = "doc_id", **columns: str) -> DataFrame:
    """One row: answer and used. model(context, query) is a hook; its answer counts in the modes gpt_enhanced and hybrid,
    in hybrid only if it does not decline. Without a model, or where it fails, the extractive answer stands."""
    if mode not in MODES:
        raise ValueError(f"no answer mode {mode!r}")
    own = answer(ranked, query, key, **columns)
    if mode == "extractive" or model is None:
        return own
    parts = within_budget(ranked, key=key, **columns).orderBy("upto").collect()  # at most ten chunks
    try:
        said = model("\n\n".join(r[columns.get("text", "text")] for r in parts), query)
    except Exception:  # noqa: BLE001  a hook may fail in any way
        return own
    if mode == "hybrid" and DECLINED in said.lower():
        return own
    kind = own.schema["used"].dataType
    return own.sparkSession.range(1).select(F.lit(said).alias("answer"), F.array(*[F.lit(r[key]) for r in parts]).cast(kind).alias("used"))


def within_budget(ranked: DataFrame, budget: int = 3000, most: int = 10, key: str = "doc_id", text: str = "text", score: str = "score") -> DataFrame:
    """The first chunks, at most `most`, up to the first that would exceed the budget of tokens."""
    best = ranked.orderBy(F.desc(score), key).limit(most)
    order = Window.orderBy(F.desc(score), key)  # over at most `most` rows
    return best.withColumn("upto", F.sum(T.approx_tokens(F.col(text))).over(order)).where(F.col("upto") <= budget)


def references(chunks: DataFrame, rank: str) -> DataFrame:
    """reference, rank: one for each source, pages and section, that of the first chunk."""
    section, source = F.coalesce("section_path", F.lit("-")), F.coalesce("source_name", F.lit("Unknown"))
    pages = F.when(F.col("page_start").isNull() | F.col("page_end").isNull(), "-").when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("–", "page_start", "page_end"))
    named = chunks.select(source.alias("source"), pages.alias("pages"), section.alias("section"), F.col("id"), F.col(rank).alias("rank"))
    first = named.groupBy("source", "pages", "section").agg(F.min(F.struct("rank", "id")).alias("first"))
    return first.select(F.format_string("[ID:%s] %s — pages %s | section: %s", F.substring("first.id", 1, 8), "source", "pages", "section").alias("reference"), F.col("first.rank").alias("rank"))


def distinct_sources(chunks: DataFrame, rank: str) -> DataFrame:
    """id, source_name, page_start, page_end, section: of each source and first page the first chunk, as strings."""
    shown = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    named = chunks.select(F.struct(F.col(rank).alias("rank"), shown("id", "").alias("id"), shown("page_end", "1").alias("page_end"), shown("section_path", "-").alias("section")).alias("c"), shown("source_name", "Unknown").alias("source_name"), shown("page_start", "1").alias("page_start"))
    return named.groupBy("source_name", "page_start").agg(F.min("c").alias("c")).select("c.rank", "c.id", "source_name", "page_start", "c.page_end", "c.section")
