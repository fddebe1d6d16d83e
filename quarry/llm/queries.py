"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, centroids, embed, jaccard, langid, licences, lines, packing, pivots, quality, resample, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, pattern).drop("text")
    return bpe.digest(bpe.decode(encoded, ranks, pattern, as_text=False)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def token_lengths(docs: DataFrame, name: str) -> DataFrame:
    """doc_id and the number of op1's tokens of the text."""
    return bpe.count(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, name=name)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.sample(docs, remainder(3) != 1, "doc_id", "lang", "text"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Learned from a sample of the labelled rows among docs that are not held out."""
    fit = remainder(5) != 0
    return toxicity.learn(toxicity.sample(docs.select("doc_id", "text").where(fit), table(spark, sf_dir, "labels").where(fit)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxic_model(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "hits")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed(table(spark, sf_dir, "documents"), chars=lines.NEAR_CHARS).drop("doc")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.quality(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_lengths(table(spark, sf_dir, "documents"), "length"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_language_id, op3_license_scan, op4_toxicity, op5_line_dedup, op6_ngram_jaccard, op7_embedding_near_dedup, op8_quality_rules, op9_warc, op10_packing,
        op11_importance_resample, op12_exact_top_k, op13_centroid_clustering,
    )
}

_SHARES = {m: f"({n} * 1000 // nullif({d}, 0))" for m, (n, d, _, _) in quality.RULES.items()}
_SHARES = {m: f"({e} >> greatest(length(bin({e})) - {quality.BITS}, 0)) << greatest(length(bin({e})) - {quality.BITS}, 0)" for m, e in _SHARES.items()}
_QUANTILES = "count(*) AS n, " + ", ".join(f"quantile_disc(m_{m}, {q}) AS {m}_{k}" for m in quality.RULES for k, q in (("a", 0.25), ("b", 0.75)))


def _fence(m: str) -> str:
    """True where the measure is in the fence of the finest group of enough documents."""
    pick = lambda k: f"CASE WHEN f.n >= {quality.LEAST} THEN f.{m}_{k} WHEN l.n >= {quality.LEAST} THEN l.{m}_{k} ELSE w.{m}_{k} END"
    slack, two = quality.RULES[m][2:]
    spread = f"{quality.SPREAD} * ({pick('b')} - {pick('a')}) + {slack}"
    low = f"{pick('a')} - ({spread})" if two else "-1"
    return f"coalesce(m_{m} BETWEEN {low} AND {pick('b')} + {spread}, true)"


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds unrolled. Products and sums of whole numbers below 2^53 are exact in doubles."""
    near = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""
    for i in range(rounds + 1):
        out += f""",
 d{i} AS MATERIALIZED (SELECT rid, min({{'d': d, 'k': k}}) AS best FROM (SELECT rid, k, {near} AS d FROM v, c{i}) GROUP BY 1)"""
        if i < rounds:
            out += f""",
 m{i} AS (SELECT k, j, sum(x::BIGINT) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(range(1, 65)) AS j, unnest(v) AS x FROM d{i} JOIN v USING (rid)) GROUP BY 1, 2),
 n{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS c FROM m{i} GROUP BY 1),
 c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (k))"""
    return out + f""",
 a AS (SELECT vec_id, best.k AS k, best.d::BIGINT AS distance FROM d{rounds} JOIN v USING (rid))
 SELECT vec_id, k::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a JOIN c{rounds} USING (k)"""


SQL: dict[str, str] = {
    "op5_line_dedup": rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(x)))::INT AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS x FROM documents)),
 w AS (SELECT doc_id, line_no, list_filter(string_split(translate(lower(line), E'\t\x0B\f\r', '    '), ' '), lambda y: y <> '') AS w FROM l),
 o AS (SELECT *, array_to_string(w, ' ') AS s, {{'d': doc_id, 'l': line_no}} AS place FROM w WHERE len(w) > 0),
 d AS (SELECT s, any_value(w) AS w, min(place) AS first, count(*) AS n FROM o GROUP BY s),
 e AS (SELECT s, w, first FROM d WHERE len(w) >= {lines.MIN_WORDS} OR list_sum(list_transform(w, lambda y: length(y))) - list_max(list_transform(w, lambda y: length(y))) >= {lines.NEAR_CHARS}),
 k AS (SELECT s, first, 1 AS del, i || '|' || array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS key FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM e)
 UNION ALL SELECT s, first, 0, i || '|' || s FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM e)),
 m AS (SELECT DISTINCT a.s FROM k a JOIN k b ON a.key = b.key AND a.s <> b.s AND a.del + b.del >= 1 WHERE b.first < a.first)
 SELECT doc_id, line_no, m.s IS NOT NULL AS near FROM o JOIN d USING (s) LEFT JOIN m USING (s) WHERE m.s IS NOT NULL OR (n > 1 AND place <> first)""",
    "op6_ngram_jaccard": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 l AS (SELECT i.a, i.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * c >= 90 * (p.n + q.n - c)),
 r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
 SELECT id AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY 1""",
    "op9_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), x AS (SELECT page_id, h, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last FROM p)
 SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM x""",
    "op7_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
 r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
 g AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
 SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM g LEFT JOIN k ON k.a = g.id""",
    "op8_quality_rules": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
 x AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d),
 k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS times FROM x),
 p AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM k WHERE times > 1) GROUP BY 1),
 c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN p USING (rid)),
 m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{e} AS m_{m}" for m, e in _SHARES.items())} FROM c),
 f AS (SELECT lang, source, {_QUANTILES} FROM m WHERE NOT base_failed GROUP BY ALL), l AS (SELECT lang, {_QUANTILES} FROM m WHERE NOT base_failed GROUP BY ALL), w AS (SELECT {_QUANTILES} FROM m WHERE NOT base_failed)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(_fence(m) for m in quality.RULES)} AS kept
 FROM m CROSS JOIN w LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source LEFT JOIN l ON l.lang IS NOT DISTINCT FROM m.lang""",
    "op11_importance_resample": rf"""WITH poly AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS p),
 d AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
 w AS MATERIALIZED (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
 f AS MATERIALIZED (SELECT side, id, f, count(*) AS n FROM (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w) GROUP BY ALL),
 words AS MATERIALIZED (SELECT x, list_transform(range(1, strlen(x) + 1), lambda i: ('0x' || substr(hex(x), 2 * i - 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT unnest(w) AS x FROM w)),
 parts AS (SELECT f, string_split(f, ' ') AS ps FROM (SELECT DISTINCT f FROM f)),
 bytes AS (SELECT f, list_concat(a.b, CASE WHEN len(ps) > 1 THEN list_concat([32], b.b) ELSE [] END, CASE WHEN len(ps) > 2 THEN list_concat([32], c.b) ELSE [] END) AS b FROM parts JOIN words a ON a.x = ps[1] LEFT JOIN words b ON b.x = ps[2] LEFT JOIN words c ON c.x = ps[3]),
 crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295], b), lambda a, x: xor(a >> 8, p[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, poly),
 c AS MATERIALIZED (SELECT side, id, bucket, sum(n) AS n FROM f JOIN crc USING (f) GROUP BY ALL),
 g AS (SELECT bucket, sum(n) FILTER (WHERE side = 's') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM c GROUP BY 1),
 gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM g),
 weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1),
 h AS (SELECT id AS doc_id, len(w) AS words, ('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT::DOUBLE AS h FROM w WHERE side = 's'),
 x AS (SELECT doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h LEFT JOIN weights ON id = doc_id),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM x WHERE words >= 20)
 SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM x LEFT JOIN r USING (doc_id)""",
    "op12_exact_top_k": """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.rid <> c.rid WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_centroid_clustering": _clusters(),
}
