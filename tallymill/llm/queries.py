"""Queries over the corpus operators, each on its whole table with production
parameters, and their SQL where DuckDB can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import bpe, decontaminate, divergence, langid, licenses, lines, pii, pivots, quality, resample, simhash, toxicity, warc


def tokenizer_file() -> str:
    """The vocabulary's place; it stays outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hits", "items", "longest_match")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))).drop("spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.archive_pages(_table(spark, sf_dir, "pages")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_file())


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"), "text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(spark, docs=docs)).drop("redactions")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_bpe": op5_bpe,
    "op6_lines": op6_lines,
    "op7_quality": op7_quality,
    "op8_pivots": op8_pivots,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
    "op11_divergence": op11_divergence,
    "op12_langid": op12_langid,
    "op13_resample": op13_resample,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
#: Polynomial of the CRC-32, by bits and then by bytes.
_CRC = """crc AS (SELECT list(list_reduce(list_concat([k::bigint], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS poly FROM range(256) t(k))"""
_CRC32 = "xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c >> 8, poly[(xor(c, x) & 255) + 1])), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 v AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, p, p + least(10, len(w)) - 1) AS s FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(p) WHERE len(w) > 0),
 k AS (SELECT DISTINCT k FROM v), o AS (SELECT r, p, k, list_slice(w, p, p + k - 1) AS s FROM d, k, unnest(range(1, len(w) - k + 2)) t(p)),
 h AS (SELECT r, p, k, item_id FROM o JOIN v USING (k, s)), m AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM (SELECT DISTINCT r, p, k FROM h), unnest(range(0, k)) t(j) GROUP BY r),
 i AS (SELECT r, count(item_id) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS items FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
 SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN m USING (r) LEFT JOIN i USING (r)""",
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), r AS (SELECT h, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY h)
 SELECT page_id, n::bigint AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM p LEFT JOIN r USING (h)""",
    "op8_pivots": """WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
 reach AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT e.a, r.c FROM e JOIN reach r ON r.a = e.b),
 n AS (SELECT a, count(*) AS links FROM e GROUP BY a)
 SELECT r.a AS vec_id, coalesce(any_value(n.links), 0)::bigint AS n_links, min(r.c) AS component_id, min(r.c) = r.a AS kept FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a""",
    "op11_divergence": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents), g AS (SELECT DISTINCT lang, source FROM d),
 o AS (SELECT r, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*)::hugeint AS c FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 3), v AS (SELECT lang, count(*)::hugeint AS v, sum(c)::hugeint AS n FROM k GROUP BY ALL),
 c AS (SELECT lang, source, term, count(*)::hugeint AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL), n AS (SELECT lang, source, sum(c)::hugeint AS n FROM c GROUP BY ALL),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (coalesce(n.n, 0) + v.v) AS p, 1 + 1000000000 * (k.c + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
 SELECT lang, source, part, item, value::bigint AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::int AS rank FROM u QUALIFY part = 'pair' OR rank <= 200""",
    "op13_resample": f"""WITH {_CRC}, d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
 fd AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d), fb AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
 h AS (SELECT f, {_CRC32} % 10000 AS bucket FROM (SELECT f FROM fd UNION SELECT f FROM fb), crc), s AS (SELECT bucket, count(*) AS s FROM fd JOIN h USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM fb JOIN h USING (f) GROUP BY 1),
 n AS (SELECT (SELECT count(*) FROM fd)::double AS s, (SELECT count(*) FROM fb)::double AS t),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1.0::double) * (n.s + 10000) / ((s.s + 1.0::double) * (n.t + 10000))))::bigint AS gain FROM s LEFT JOIN t USING (bucket), n),
 m AS (SELECT r, count(*) AS n_features, floor(sum(gain)::double / count(*))::bigint AS weight FROM fd JOIN h USING (f) JOIN g USING (bucket) GROUP BY 1),
 e AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight, ('0x' || left(sha256('7:' || coalesce(doc_id::varchar, '')), 8))::bigint AS h FROM d LEFT JOIN m USING (r)),
 z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint AS score FROM e),
 k AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n >= 20) * 25 // 100 AS most FROM z)
 SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND k <= most THEN k END::bigint AS rank FROM k""",
}
