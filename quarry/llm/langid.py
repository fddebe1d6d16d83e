"""Language identification by interpolated Kneser-Ney character models (operator 2).

Each language has a model of five characters. The counts of its 5-grams come from a sample of its
labelled rows: about SAMPLE rows with the smallest hashes of their ids, of LONGEST bytes at most where it has such
(fewer rows each where there are over ROWS / SAMPLE languages; both are the documented bound of what is
fitted, and no language is left out). All lower orders follow from the distinct 5-grams, as Kneser-Ney asks. A gram is
packed in 64 bits (its order and 12 bits a character), mixed to a hash, and kept in one sorted
array per language beside its log probability and back-off weight. The language with the lowest
cross-entropy per character wins; a text whose cross-entropy lies beyond the limit of that
language is marked `rejected`. The limit is the cross-entropy that all but REJECTED of the rows set aside of that
language keep to (every eighth row of the sample, which the models do not count). Case is folded character by character,
so a text's prediction is its own.

Edge cases: null text, and text without a letter, is `und` with score 0 and is not rejected;
without any labelled row every text is `und`; ids and sources are never inputs; repeated rows are
predicted each; long texts are read whole, in blocks; empty tables give empty results; columns with
the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import vec
from quarry.llm.shared import stored

ORDER, BITS = 5, 12
SAMPLE, ROWS, LONGEST, REJECTED = 2000, 64_000, 1 << 16, 0.005
#: So many deviations are above the mean at that share of a normal distribution.
NORMAL = 2.5758
BLOCK = 2 << 20
#: Characters beyond which a longer text makes a prediction no surer.
SURE = 60
MASK = [np.uint64((1 << (BITS * m)) - 1) for m in range(ORDER + 1)]


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """12-bit symbols of a block's characters, the first of each text, and whether it is a letter.

    White space, digits and punctuation are one symbol each, so models hold letters and gaps.
    """
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate(([0], np.cumsum(vec.LEADING[data])))[offsets]
    values, inverse = np.unique(code, return_inverse=True)
    # a letter whose lower case is longer stands for itself
    lower = [chr(v).lower() for v in values.tolist()]
    values = np.array([ord(x) if len(x) == 1 else v for x, v in zip(lower, values.tolist(), strict=True)], np.uint32)
    alpha = np.array([chr(v).isalpha() for v in values.tolist()], bool) if len(values) else np.empty(0, bool)
    folded = np.where(values < 4096, values, (vec.mix(values.astype(np.uint64)) & np.uint64(2047)).astype(np.uint32) + 2048)
    folded = np.where(alpha, folded, np.where(np.isin(values, [32, 9, 10, 11, 12, 13]), 1, 2)).astype(np.uint64)
    return folded[inverse], first, alpha[inverse]


def _grams(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The packed 5-gram that ends at each character; a text begins after gaps."""
    n = len(symbols)
    at = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = symbols.copy()
    for k in range(1, ORDER):
        before = np.ones(n, np.uint64)
        before[k:] = symbols[: n - k]
        before[at < k] = 1
        out |= before << np.uint64(BITS * k)
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """first row, rows, grams, text borders, letters per text."""
    for block in vec.texts(column, BLOCK):
        symbols, first, alpha = _symbols(block.data, block.offsets)
        letters = np.concatenate(([0], np.cumsum(alpha)))
        yield block.first, block.n, _grams(symbols, first), first, letters[first[1:]] - letters[first[:-1]]


def _hash(grams: np.ndarray, order: int) -> np.ndarray:
    return vec.mix(grams | (np.uint64(order) << np.uint64(60)))


class Model:
    """Sorted hashes of grams, their log probabilities, and the log back-off weights of contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        keys, logp, bow_keys, bows = [], [], [], []
        by_order: list[tuple[np.ndarray, np.ndarray]] = [(grams, counts.astype(np.float64))]
        for m in range(ORDER - 1, 0, -1):
            suffix, times = np.unique(by_order[0][0] & MASK[m], return_counts=True)
            by_order.insert(0, (suffix, times.astype(np.float64)))
        lower, self.floor = None, -np.log(len(by_order[0][0]) + 64.0)
        for m, (g, c) in enumerate(by_order, 1):
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, inverse = np.unique(g >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(inverse, c)
            weight = discount * np.bincount(inverse) / total
            below = np.exp(self.floor) if lower is None else lower[1][np.searchsorted(lower[0], g & MASK[m - 1])]
            p = (c - discount).clip(0) / total[inverse] + weight[inverse] * below
            keys.append(_hash(g, m))
            logp.append(np.log(p))
            bow_keys.append(_hash(context, m + 8))
            bows.append(np.log(weight))
            lower = (g, p)
        for name, (k, v) in {"p": (keys, logp), "w": (bow_keys, bows)}.items():
            k, v = np.concatenate(k), np.concatenate(v)
            order = np.argsort(k)
            setattr(self, name, (k[order], v[order].astype(np.float32)))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[1][at]

    def logp(self, grams: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for m in range(ORDER, 0, -1):
            g = grams[todo] & MASK[m]
            found, value = self._find(self.p, _hash(g, m))
            out[todo[found]] += value[found]
            todo, g = todo[~found], g[~found]
            known, weight = self._find(self.w, _hash(g >> np.uint64(BITS), m + 8))
            out[todo] += np.where(known, weight, 0)
        out[todo] += self.floor
        return out


def entropies(models: list[Model], grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Cross-entropy per character of each text under each model; each distinct gram is looked up once."""
    values, inverse = np.unique(grams, return_inverse=True)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    return np.stack([-np.bincount(doc, m.logp(values)[inverse], len(size)) / np.maximum(size, 1) for m in models], 1)


def sample(docs: DataFrame, train: Column, doc_id: str, lang: str, text: str) -> DataFrame:
    """lang, text, aside: about SAMPLE labelled rows of each language, those with small hashes of their ids."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    short = F.octet_length("text") <= LONGEST
    sizes = rows.groupBy("lang").agg(F.count(F.when(short, 1)).alias("short"), F.count("*").alias("n")).collect()  # a row a language
    each = max(20, min(SAMPLE, ROWS // max(1, len(sizes))))
    known = docs.sparkSession.createDataFrame([(r.lang, each / max(1, r.short or r.n), r.short == 0) for r in sizes], "lang string, share double, long boolean")
    place = F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(known), "lang").where((place < F.col("share")) & (short | F.col("long")))
    return picked.select("lang", "text", (F.pmod(F.xxhash64(F.lit(6), F.col("id")), F.lit(8)) == 0).alias("aside"))


def train(rows: DataFrame) -> dict:
    """languages, models and limits from lang, text, aside."""
    rows = stored(rows, "lang-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for at, n, grams, first, _ in _blocks(batch.column(1)):
                doc = np.repeat(np.arange(n), np.diff(first))
                own = langs[at : at + n]
                for lang in dict.fromkeys(own.tolist()):
                    g, c = np.unique(grams[(own == lang)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g.view(np.int64)), "n": pa.array(c.astype(np.int64))})

    counts = rows.where("not aside").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(counts["lang"]).to_pylist())
    models = []
    for lang in langs:
        own = counts.filter(pc.equal(counts["lang"], lang)).sort_by("gram")
        g, c = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(g)
        models.append(Model(g[order], c[order]))
    fitted = {"langs": langs, "models": models, "limits": [np.inf] * len(langs)}
    if langs:
        own = (F.col("lang") == F.col("lang_pred")) & F.col("entropy").isNotNull()
        # few rows say little of so far a quantile: not below that of a normal distribution with their mean and deviation
        wide = F.avg("entropy") + NORMAL * F.stddev_samp("entropy") * F.sqrt(1 + 1 / F.count("*"))
        limit = F.when(F.count("*") > 1, F.greatest(F.percentile("entropy", 1 - REJECTED), wide)).otherwise(float("inf"))
        seen = {r.lang: r.limit for r in predict(rows.where("aside"), fitted).where(own).groupBy("lang").agg(limit.alias("limit")).collect()}
        fitted["limits"] = [seen.get(x, np.inf) for x in langs]
    return fitted


def predict(docs: DataFrame, fitted: dict, text: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns (the text if so asked), lang_pred, score, entropy (nats a character) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by ROWS and LONGEST
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in new} and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        langs, limits = np.array([*f["langs"], "und"], object), np.array([*f["limits"], np.inf])
        for batch in batches:
            for at, n, grams, first, letters in _blocks(batch.column(text)):
                rows = batch.slice(at, n)
                if f["models"]:
                    h = entropies(f["models"], grams, first)
                    best = np.where(letters > 0, h.argmin(1), len(langs) - 1)
                    low = h.min(1)
                    room = np.minimum(np.diff(first), SURE)[:, None]
                    score = np.where(letters > 0, 1 / np.exp((low[:, None] - h) * room).sum(1), 0.0)
                else:
                    best, low, score = np.zeros(n, np.int64), np.full(n, np.nan), np.zeros(n)
                und = langs[best] == "und"
                found = {x.name: rows.column(x.name) for x in kept}
                found |= {"lang_pred": pa.array(langs[best].tolist(), pa.string()), "score": pa.array(score), "entropy": pa.array(low, mask=und), "rejected": pa.array(~und & (low > limits[best]))}
                yield pa.RecordBatch.from_pydict(found)

    return docs.mapInArrow(run, T.StructType(kept + new))
