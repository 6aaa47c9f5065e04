"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from controlweave.llm import byte_bpe, decontaminate, licenses, line_chunks, ngram_join, queries_corpus, substrings, token_files, toxicity, vectors, warc
from controlweave.llm.tables import table
from controlweave.workload.common import Query


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(archives, with_payload=False).where("kind = 'record'")
    return records.select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number("refers_to").alias("refers_to"),
    )


OP1_SQL = """
WITH own AS (
    SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS payload_digest FROM pages
), sized AS (
    SELECT page_id, payload_digest, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
           min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM own
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM sized"""


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", F.size("hits").alias("n_hits"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_ids(shards, digests_only=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False, with_decoded=False)


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE own AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
    SELECT vec_id, v FROM own
    WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach(id, other) AS (
    SELECT vec_id, vec_id FROM own UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
), lowest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM own JOIN lowest ON own.vec_id = lowest.id LEFT JOIN counts ON counts.id = vec_id"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_chunks.remove_repeats(docs)


OP8_SQL = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line, len(l) AS n_lines
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), hashed AS (
    SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines
), ended AS (
    SELECT *, i = n_lines OR (h + 31 * coalesce(lag(h) OVER w, 0)) % 3 = 0 AS ends FROM hashed
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
    SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
    FROM ended
), chunks AS (
    SELECT doc_id, k, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk
    FROM numbered GROUP BY doc_id, k
), placed AS (
    SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, start) > 1 AS gone FROM chunks
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.kept, '') END AS text,
       CAST(coalesce(c.n_lines, 0) AS INT) AS n_lines, CAST(coalesce(c.removed_chunks, 0) AS INT) AS removed_chunks,
       CAST(coalesce(c.removed_lines, 0) AS INT) AS removed_lines
FROM documents d LEFT JOIN (
    SELECT doc_id, sum(n) AS n_lines, count(*) FILTER (WHERE gone) AS removed_chunks,
           coalesce(sum(n) FILTER (WHERE gone), 0) AS removed_lines,
           string_agg(chunk, chr(10) ORDER BY start) FILTER (WHERE NOT gone) AS kept
    FROM placed GROUP BY doc_id
) c USING (doc_id)"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"), ngram_join.Rule(n=4, percent=85))


OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4
        THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g
    FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * k >= 85 * (s.n + t.n - k)
), reach(id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) ON id = d.doc_id"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.notices(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc": Query(op1_warc, OP1_SQL),
    "op2_repeated_passages": Query(op2_repeated_passages),
    "op3_toxicity": Query(op3_toxicity),
    "op4_token_files": Query(op4_token_files),
    "op5_byte_bpe": Query(op5_byte_bpe),
    "op6_near_vectors": Query(op6_near_vectors, OP6_SQL),
    "op7_decontaminate": Query(op7_decontaminate),
    "op8_line_chunks": Query(op8_line_chunks, OP8_SQL),
    "op9_ngram_join": Query(op9_ngram_join, OP9_SQL),
    "op10_licenses": Query(op10_licenses),
}
QUERIES |= queries_corpus.QUERIES
