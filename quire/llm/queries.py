"""The queries of the llm operators, by registered name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, exact_dedup, html_text, mixing, near_dedup, ngram_lm, quality_rules, substring_dedup, toxicity, warc
from quire.session import prepare, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("n_points")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_lm.quality_by_perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_text.html_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_ngram_lm": op5_ngram_lm,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_bpe": op9_bpe,
    "op10_html_text": op10_html_text,
}

SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
        b AS (SELECT *, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: instr('0123456789abcdef', hex[i * 5 + j]) - 1), lambda x, y: x * 16 + y)) AS runs FROM g)
        SELECT page_id, payload_bytes,
            list_aggregate(list_transform(runs, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32768) % 32 + 1 AS BIGINT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 1024) % 32 + 1 AS BIGINT), 1)
                || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32) % 32 + 1 AS BIGINT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM b
    """,
    "op7_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
        x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
        pairs AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON r.other = e.u),
        c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
    """,
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM w WHERE len(words) >= 20),
        x AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS win FROM s),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM x),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM r WHERE k > 1),
        words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, len(w.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
    """,
}
