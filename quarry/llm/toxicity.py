"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text (operator 4).

Folding: NFKC, lower case, accents off, letters of other scripts that look Latin to Latin, digits
and signs that stand for letters inside a word to those letters, and runs of three or more equal
letters to two. An entry matches at the beginning of a word and covers it; each carries the log
odds of a labelled toxic document. The sum of the weights of a text's matches, by itself and
divided by the text's length in words, goes through a logistic curve. Matches inside an exception
phrase do not count.

Entries are learned from labelled rows: beginnings of LOW to HIGH letters of words, whole words of two
letters or more, and runs of two to four characters of scripts without spaces. One is taken if
its toxic share is at least PRECISION and the rows that have it speak for that by EVIDENCE nats against
the share of all rows, at any size of the table. A beginning gives way to a longer one that nine tenths of its rows
have; of those that are left and nested the shortest stays. The words of LEXICON are
there from the start, those that labelled rows speak against go. The curve is fitted on every
fourth labelled row, by a hash of its text; the entries are learned from the others. What is learned from
is bounded by SAMPLE, a documented parameter: about so many labelled rows, those with small hashes of their ids.

Edge cases: null and empty texts have no match and get the score of a text without one; without
labels of both kinds the built-in words alone score; an id that is labelled twice counts as toxic if
one label says so; repeated rows are scored each; long texts are
read whole; empty tables give empty results; columns with the names of the results are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import stored

#: Letters of other scripts with the Latin letters that they look like.
HOMOGLYPHS = dict(zip("абвгеіјкмнорстухѕԁһԛԝαβεικνορτυχγ", "abbreijkmhopctyxsdhqwabeiknoptuxy", strict=True)) | {"ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss"}
#: Digits and signs with the letters that they stand for.
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi", strict=True))
#: Insults in common use in English, French, German and Spanish, and phrases with such a word that are none.
LEXICON = dict.fromkeys("idiot moron imbecile scum scumbag trash stupid dumbass jackass pathetic worthless disgusting loser clown bastard crétin abruti connard salaud dummkopf trottel mistkerl vollidiot arschloch imbécil estúpido cabrón pendejo".split(), 2.0)
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bins", "clown fish", "clownfish", "stupidly simple")
LOW, HIGH, PRECISION, EVIDENCE = 4, 10, 0.75, 12.0
SAMPLE = 30_000
#: The curve without labelled rows, and what fitted ones are drawn to.
CURVE = (-4.0, 1.0, 1.0, 1.0, 1.0)
SPACELESS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])")
WORD = re.compile(r"[^\W_]+")
_SIGNS = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![^\W_])[0134578@$](?=[^\W\d_]{2})")
_RUNS = re.compile(r"(.)\1{2,}")
_GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()}
_SUBS = {ord(k): v for k, v in SUBSTITUTES.items()}
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_INVISIBLE))
        text = "".join(c for c in text if not unicodedata.combining(c)).lower().translate(_GLYPHS)
        text = SPACELESS.sub(r" \1 ", text)
    text = text.lower()
    while (plain := _SIGNS.sub(lambda m: m[0].translate(_SUBS), text)) != text:  # each round leaves fewer signs
        text = plain
    return _RUNS.sub(r"\1\1", text)


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(" " + entry, (len(entry), weight))
        for phrase in exceptions:
            self.automaton.add_word(" " + fold(phrase) + " ", (len(fold(phrase)) + 1, None))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[float, int, int]:
        """Weight and number of the matches, and words."""
        words = WORD.findall(fold(text))
        hits: dict[int, float] = {}
        spared: set[int] = set()
        for end, (size, weight) in self.automaton.iter(" " + " ".join(words) + " "):
            start = end - size
            if weight is None:
                spared.update(range(start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        if spared:
            hits = {s: w for s, w in hits.items() if s not in spared}
        return sum(hits.values()), len(hits), len(words)


def _keys(text: str) -> set[str]:
    """Beginnings of words; words and runs of spaceless characters end with a blank."""
    out: set[str] = set()
    words = WORD.findall(fold(text))
    for w in set(words):
        if len(w) > 1 and not w.isdigit():
            out.update(w[:k] for k in range(LOW, min(len(w), HIGH) + 1))
            out.add(w + " ")
    single = [len(w) == 1 and SPACELESS.match(w) is not None for w in words] if not text.isascii() else []
    for i in (i for i, x in enumerate(single) if x):
        for n in range(2, 5):
            if not all(single[i : i + n]) or i + n > len(words):
                break
            out.add(" ".join(words[i : i + n]) + " ")
    return out


def features(weight: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    density = weight / np.maximum(words, 1)
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(hits), np.minimum(100 * density, 50) ** 0.5, hits > 0], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Newton's method with halved steps; few rows stay near CURVE."""
    start = np.array(CURVE)
    w = start.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - start) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * (w - start))
        now = loss(w)
        while loss(w + step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """text and y of about `rows` labelled documents, those with small hashes of their ids.

    The labels that are taken are broadcast, so no text is shuffled.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(toxic).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64(F.lit(9), F.col(doc_id)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(taken), doc_id).select("text", "y")


def learn(rows: DataFrame) -> dict:
    """A lexicon and the curve from text and y (0 or 1, a bounded number of rows that may be learned from)."""
    aside = F.pmod(F.xxhash64(F.lit(13), F.col("text")), F.lit(4)) == 0
    rows = stored(rows.select("text", F.col("y").cast("int").alias("y"), aside.alias("aside")), "tox-rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(found[0] | found[1])
            return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string())} | {n: pa.array([c[k] for k in keys], pa.int64()) for n, c in zip(("neg", "pos"), found, strict=True)})

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(_keys(text or ""))
                if len(found[0]) + len(found[1]) > 300_000:
                    yield out()
                    for c in found:
                        c.clear()
        yield out()

    sizes = {(r.aside, r.y): r.n for r in rows.groupBy("aside", "y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    lexicon = {fold(w): v for w, v in LEXICON.items()}
    if toxic and clean:
        every = rows.where("not aside").select("text", "y").mapInArrow(count, "key string, neg long, pos long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        base = toxic / (toxic + clean)
        part = lambda n, share: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (F.col("pos") + F.col("neg")) / share)).otherwise(0.0)
        sure = part("pos", base) + part("neg", 1 - base) >= EVIDENCE
        share = F.col("pos") / (F.col("pos") + F.col("neg"))
        # of a bounded sample, so bounded as well
        found = every.where(((share >= PRECISION) & sure) | F.col("key").isin([*lexicon])).collect()
        against = {r.key for r in found if r.key in lexicon and r.pos < PRECISION * (r.pos + r.neg) and r.pos + r.neg >= 8}
        lexicon = {k: v for k, v in lexicon.items() if k not in against}
        good = {r.key: math.log((r.pos + 0.5) / toxic / ((r.neg + 0.5) / clean)) for r in found if r.key not in against and r.pos >= PRECISION * (r.pos + r.neg)}
        rows_of = {r.key: r.pos + r.neg for r in found}
        begins = {k for k in good if not k.endswith(" ")}
        begins -= {k[:i] for k in begins for i in range(LOW, len(k)) if k[:i] in begins and rows_of[k] >= 0.9 * rows_of[k[:i]]}
        whole = {k for k in good if k.endswith(" ")}
        lexicon |= {k: good[k] for k in begins | whole if not any(k[:i] in begins for i in range(LOW, len(k)))}
    model = {"lexicon": lexicon, "curve": np.array(CURVE)}
    if sizes.get((True, 0)) and sizes.get((True, 1)):
        matched = score(rows.where("aside").select("text", "y"), model).select("y", "weight", "hits", "words").toPandas()
        matched = matched.sort_values([*matched.columns])  # the same sums in any order of the rows
        x = features(*(matched[c].to_numpy(float) for c in ("weight", "hits", "words")))
        model["curve"] = fit_logistic(x, matched.y.to_numpy(float))
    return model


def score(docs: DataFrame, model: dict, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns (the text if so asked), weight, hits, words, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE
    new = [T.StructField(n, t()) for n, t in (("weight", T.DoubleType), ("hits", T.LongType), ("words", T.LongType), ("score", T.DoubleType))]
    kept = [f for f in docs.schema.fields if f.name not in {*(x.name for x in new), "predicted"} and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, curve = Matcher(shared.value["lexicon"]), shared.value["curve"]
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                found = np.array([matcher(t.as_py() or "") for t in batch.column(text)], float).reshape(-1, 3)
                p = 1 / (1 + np.exp(-(features(*found.T) @ curve).clip(-30, 30)))
                new = {"weight": found[:, 0], "hits": found[:, 1].astype(np.int64), "words": found[:, 2].astype(np.int64), "score": p}
                yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {k: pa.array(v) for k, v in new.items()})

    return docs.mapInArrow(run, T.StructType(kept + new)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
