"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import alignment, bpe, divergence, exact_dedup, fingerprints, line_dedup, metric_join, packing, quality, simhash, suffix_dedup, token_counts, token_files
from marginalia.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_groups(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), 5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"), passage=51)


def op11_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.metric_join(table(spark, sf_dir, "embeddings"), 0.93)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_token_files": op5_token_files,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_metric_join": op11_metric_join,
    "op12_alignment": op12_alignment,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_line_dedup": """
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), common AS (
            SELECT line FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= 5
        )
        SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
               sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE c.line IS NULL), '')) AS kept_sha256
        FROM lines l LEFT JOIN common c ON l.line = c.line GROUP BY doc_id
    """,
    "op11_metric_join": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        ), usable AS (
            SELECT * FROM v WHERE label IS NOT NULL AND CASE WHEN list_count(x) = len(x) THEN list_inner_product(x, x) > 0 AND isfinite(list_inner_product(x, x)) END
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), component AS (
            SELECT a, min(b) AS c FROM reach GROUP BY a
        )
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN component ON a = vec_id
    """,
    "op13_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), tokens AS (
            SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), kept AS (
            SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= 3
        ), sizes AS (
            SELECT lang, count(*) AS v FROM kept GROUP BY lang
        ), own AS (
            SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM own GROUP BY ALL) USING (lang, source) LEFT JOIN sizes USING (lang)
        ), shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // CAST(g.n + g.v AS HUGEINT) AS p
            FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
        ), langs AS (
            SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 1) // CAST(n + v AS HUGEINT) AS q
            FROM (SELECT lang, term, sum(c) AS c FROM own GROUP BY ALL) JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM groups GROUP BY lang) USING (lang)
        ), pairs AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
            FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN (
                SELECT a.lang, a.source AS s, b.source AS t, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
            ) x ON x.lang = g.lang AND s = g.source AND t = h.source
        ), used AS (
            SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares JOIN langs USING (lang, term) WHERE c > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM used)
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
