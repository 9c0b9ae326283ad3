"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbflow.llm import (
    exactdedup, hardnegatives, licenses, mixing, ngramjoin, ngramrules, packing, personal,
    qualityfm, resampling, sharding, tokenfiles, warc,
)
from kerbflow.llm.common import read_documents
from kerbflow.session import shared_folder

TOKENIZER = "byte_bpe_50k.json"


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir))


def op3_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_documents(spark, sf_dir), 8)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_copies(read_documents(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(read_documents(spark, sf_dir)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(read_documents(spark, sf_dir), exactdedup.fresh_index(spark))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "token-files")
    tokenfiles.write_tokens(read_documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER))
    return tokenfiles.checked_tokens(spark, path)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return qualityfm.score(docs, qualityfm.fit(docs, read_labels(spark, sf_dir)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return personal.find(docs, personal.fit(docs))


def op10_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_labels(spark, sf_dir).filter(F.col("quality") == 1)
    return ngramrules.judge(read_documents(spark, sf_dir), trusted)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(read_documents(spark, sf_dir), target)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_license_scan, op3_slot_sharding, op4_ngram_jaccard_join,
        op5_source_mixing, op6_exact_dedup, op7_token_files, op8_quality_classifier,
        op9_personal_data, op10_ngram_rules, op11_importance_resampling, op12_hard_negatives,
        op13_warc_archive,
    )
}

ORACLES = {
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, count(*) AS group_size,
                   first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
            FROM t GROUP BY 1
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
    # The crc32 of a word: bytes in turn, eight bits each, by the reversed polynomial.
    "op11_importance_resampling": r"""
        WITH words AS (
            SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
            UNION ALL
            SELECT 't', NULL, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
        ), forms AS (
            SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)
        ), crcs AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                range(1, (length(h) // 2 + 1)::BIGINT), lambda i: list_prepend(
                    ((strpos('0123456789ABCDEF', substr(h, 2*i-1, 1)) - 1) * 16
                     + strpos('0123456789ABCDEF', substr(h, 2*i, 1)) - 1)::BIGINT,
                    [0,0,0,0,0,0,0]::BIGINT[])))),
                lambda c, b: xor(xor(c, b) >> 1, ((xor(c, b) & 1) * 3988292384)::BIGINT)),
                4294967295::BIGINT) % 10000 AS bucket
            FROM forms
        ), raw AS (
            SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
            FROM words JOIN crcs USING (w) GROUP BY 1
        ), gains AS (
            SELECT bucket, floor(1000 * ln(
                ((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
            FROM raw
        ), sums AS (
            SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total
            FROM words JOIN crcs USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1
        ), weights AS (
            SELECT doc_id, coalesce(n, 0) AS n_features,
                   coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
                   sha256('2024:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents LEFT JOIN sums USING (doc_id)
        ), scores AS (
            SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((
                list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef',
                    substr(h, i::BIGINT, 1)) - 1) * power(16, 8 - i))) + 0.5) / 4294967296)))::BIGINT AS score
            FROM weights
        ), places AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) FILTER (n_features >= 20) OVER () AS eligible
            FROM scores
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank
        FROM places
    """,
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT row_number() OVER () AS k, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scores AS (
            SELECT a.k AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.k AS b, b.vec_id,
                   list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v a JOIN v b ON a.k <> b.k WHERE a.vec_id % 100 = 0
        ), pos AS (
            SELECT * FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
                   p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) AS rank
            FROM pos p JOIN scores n ON p.a = n.a AND NOT n.same
             AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        )
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 5
    """,
    "op13_warc_archive": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), g AS (
            SELECT *, row_number() OVER w AS place, first(page_id) OVER w AS head
            FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND place > 1 THEN head END AS refers_to
        FROM g
    """,
}
