"""One query per operator of this subpackage, with production parameters, and SQL where SQL
can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import (
    bpe_chunks,
    decontamination,
    fill_in_middle,
    jaccard_join,
    language_profiles,
    line_rules,
    nearest_hashing,
    quality_kernel,
    secret_forest,
    source_divergence,
    token_counts,
    toxicity_kernel,
    web_archives,
)
from ebbtide.llm.common import in_fold, table
from ebbtide.plans import durable


def _held_out(df: DataFrame, parts: int, part: int) -> DataFrame:
    return df.withColumn("held_out", in_fold("doc_id", parts, part))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~in_fold("doc_id", 5, 0))
    model = toxicity_kernel.fit_toxicity(docs, labels)
    scored = _held_out(toxicity_kernel.score_toxicity(docs, model), 5, 0)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_archives.pages_through_archives(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_chunks.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = durable(quality_kernel.document_statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").filter(~in_fold("doc_id", 4, 2))
    model = quality_kernel.fit_quality(quality_kernel.labelled_statistics(stats, labels))
    scored = _held_out(quality_kernel.score_quality(stats, model), 4, 2)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(decontamination.benchmark_matches(docs, benchmark))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = language_profiles.language_prototypes(docs.filter(~in_fold("doc_id", 3, 1)))
    found = _held_out(language_profiles.identify_language(docs, prototypes), 3, 1)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cosine")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are left out of the result; their digests tell them apart."""
    found = secret_forest.scan_secrets(table(spark, sf_dir, "documents"))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value", "text_hash")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_hashing.nearest_rows(table(spark, sf_dir, "embeddings"), step=20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_web_archives": op2_web_archives,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_language": op8_language,
    "op9_line_rules": op9_line_rules,
    "op10_secrets": op10_secrets,
    "op11_divergence": op11_divergence,
    "op12_nearest": op12_nearest,
    "op13_fill_in_middle": op13_fill_in_middle,
}

# Base 32 of a digest, five bits at a time, two of its hex digits around them.
BASE32 = """list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((((16 * (instr('0123456789abcdef', substr(h, CAST(1 + (5 * i) // 4 AS INTEGER), 1)) - 1)
        + greatest(0, instr('0123456789abcdef', substr(h, CAST(2 + (5 * i) // 4 AS INTEGER), 1)) - 1))
        >> (3 - (5 * i) % 4)) & 31) AS INTEGER), 1)), lambda a, b: a || b)"""

ORACLE: dict[str, str] = {
    "op2_web_archives": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
        ), q AS (
            SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p
        )
        SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
            {BASE32} AS payload_digest,
            CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < top THEN top END AS refers_to
        FROM q""",
    "op9_line_rules": """
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'),
                lambda x: x <> '') AS ws FROM d
        ),
        win AS (
            SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
        ),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win)
            WHERE n > 1),
        covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(3)) AS k) GROUP BY doc_id
        ),
        l AS (
            SELECT doc_id, source, line FROM (
                SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d
            ) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
        ),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
        forms AS (
            SELECT doc_id, source, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS form FROM l
        ),
        own AS (
            SELECT doc_id, source, form, sum(len(string_split(form, ' '))) AS words
            FROM forms GROUP BY ALL
        ),
        hosts AS (
            SELECT source, count(*) AS documents FROM (SELECT DISTINCT source, doc_id FROM own) GROUP BY source
        ),
        counted AS (SELECT *, count(*) OVER (PARTITION BY source, form) AS n FROM own),
        marked AS (
            SELECT c.*, n > 10 AND n * 50 > documents AS common
            FROM counted AS c JOIN hosts AS h ON c.source IS NOT DISTINCT FROM h.source
        ),
        judged AS (
            SELECT doc_id, sum(words) AS words, sum(CASE WHEN common THEN words ELSE 0 END) AS removed
            FROM marked GROUP BY doc_id
        ),
        base AS (
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
                CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))
                    AS BIGINT) AS word_chars,
                CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
            FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
        )
        SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                AND coalesce((words - removed) * 5 >= words AND words - removed >= 50, TRUE) AS kept,
            CAST(coalesce(removed, 0) AS BIGINT) AS common_words
        FROM base LEFT JOIN judged USING (doc_id)""",
    "op11_divergence": """
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                coalesce(text, '') AS text
            FROM documents
        ), t AS (
            SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM d
        ), k AS (
            SELECT lang, term, CAST(count(*) AS BIGINT) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3
        ), c AS (
            SELECT lang, source, term, CAST(count(*) AS BIGINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
        ), l AS (
            SELECT lang, CAST(count(*) AS BIGINT) AS v, CAST(sum(total) AS BIGINT) AS n_lang FROM k GROUP BY lang
        ), g AS (
            SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
            FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
        ), p AS (
            SELECT lang, source, term, coalesce(c.n, 0) AS own,
                1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v) AS p,
                1 + (1000000000 * (total + 1)) // (n_lang + v) AS q
            FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
        ), pair AS (
            SELECT lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
            FROM p AS a JOIN p AS b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
            UNION ALL
            SELECT a.lang, a.source, b.source, 0 FROM g AS a JOIN g AS b USING (lang)
            WHERE a.source <> b.source AND a.lang NOT IN (SELECT lang FROM l)
        ), term AS (
            SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE own > 0 AND p > q
        ), ranked AS (
            SELECT lang, source, 'pair' AS part, item, value,
                row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r
            FROM pair
            UNION ALL
            SELECT * FROM (
                SELECT lang, source, 'term', item, value,
                    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r
                FROM term
            ) WHERE r <= 200
        )
        SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM ranked""",
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
            FROM documents
        ), k AS (
            SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
                CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
                CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
            FROM d
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM k
        ), p AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                array_to_string(units[b + 1:], '') AS suffix
            FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
            CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix
                || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p""",
}
