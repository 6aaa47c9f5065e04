"""The queries of resampling, suffix removal and source divergence, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from controlweave.llm import divergence, resampling, suffix_buckets
from controlweave.llm.tables import table
from controlweave.workload.common import Query


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH steps AS (
    SELECT list(c ORDER BY b) AS crcs FROM (
        SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) t(b))
), texts AS (
    SELECT doc_id, 's' AS part, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT item_id, 't', coalesce(text, '') FROM benchmark
), split AS (
    SELECT doc_id, part, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), met AS (
    SELECT doc_id, part, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
           list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM split
), counted AS (SELECT doc_id, part, f, count(*) AS n FROM met GROUP BY ALL),
digits AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), placed AS (
    SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2),
           lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM digits, steps
), hashed AS (SELECT doc_id, part, bucket, sum(n) AS n FROM counted JOIN placed USING (f) GROUP BY ALL),
sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (WHERE part = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE part = 't'), 0) AS t
    FROM hashed GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE)
           / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM sums
), weighed AS (
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
    FROM hashed JOIN gains USING (bucket) WHERE part = 's' GROUP BY doc_id
), scored AS (
    SELECT doc_id, len(w) >= 20 AS eligible, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM split LEFT JOIN weighed USING (doc_id) WHERE part = 's'
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY eligible) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND r <= 5 * n // 100 THEN r END AS rank FROM ranked"""


def op12_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_buckets.remove_repeats(table(spark, sf_dir, "documents"))
    lost = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select(
        "doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


OP12_SQL = r"""
WITH own AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (
    SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range((len(h) // 2 + 999) // 1000)) AS k FROM own)
), windows AS (
    SELECT doc_id, 1000 * k + i AS i, substr(h, 2 * i + 1, 100) AS s
    FROM (SELECT doc_id, k, h, unnest(range(least(1000, len(h) // 2 - 49))) AS i FROM parts)
), first AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN first USING (s) WHERE least < doc_id),
bytes AS (
    SELECT doc_id, 1000 * k + i AS i, substr(h, 2 * i + 1, 2) AS byte
    FROM (SELECT doc_id, k, h, unnest(range(least(1000, len(h) // 2))) AS i FROM parts)
), marked AS (
    SELECT doc_id, b.i, byte, coalesce(b.i - max(x.i) OVER (PARTITION BY doc_id ORDER BY b.i) < 50, false) AS gone
    FROM bytes b LEFT JOIN hits x USING (doc_id, i)
), edges AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS starts FROM marked),
cut AS (
    SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
           coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
    FROM edges GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(from_hex(coalesce(kept, ''))) AS kept_sha256
FROM own LEFT JOIN cut USING (doc_id)"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH own AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), met AS (SELECT d, lang, source, unnest(w) AS term FROM own),
kept AS (SELECT lang, term FROM met GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM own),
counts AS (SELECT lang, source, term, count(*) AS n FROM met JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
own_p AS (
    SELECT lang, source, term, n,
           1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense
), lang_p AS (
    SELECT lang, term, 1 + 1000000000 * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
    FROM dense GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM own_p a JOIN own_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM own_p JOIN lang_p USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


QUERIES = {
    "op11_resampling": Query(op11_resampling, OP11_SQL),
    "op12_suffix_buckets": Query(op12_suffix_buckets, OP12_SQL),
    "op13_divergence": Query(op13_divergence, OP13_SQL),
}
