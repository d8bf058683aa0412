"""The ten operators as queries over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.llm import bpe, bwt, bytecnn, fertility, lengths, lines, minmax, packing, rotated, warc
from loomspan.llm.common import word_pattern
from loomspan.session import table


def op1_fertility(spark, folder):
    return fertility.fertility_rules(table(spark, folder, "documents"))


def op2_lengths(spark, folder):
    return lengths.length_histogram(table(spark, folder, "documents"))


def op3_rotated(spark, folder):
    return rotated.nearest_neighbours(table(spark, folder, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op4_packing(spark, folder):
    return packing.best_fit_packing(table(spark, folder, "documents"))


def op5_bpe(spark, folder):
    return bpe.encode(table(spark, folder, "documents"), check=True)


def op6_lines(spark, folder):
    return lines.line_bitmaps(table(spark, folder, "documents"))


def op7_warc(spark, folder):
    return warc.reassembled_pages(table(spark, folder, "pages"))


def op8_minmax(spark, folder):
    return minmax.near_duplicates(table(spark, folder, "documents"))


def op9_bwt(spark, folder):
    return bwt.repeated_passages(table(spark, folder, "documents"))


def op10_bytecnn(spark, folder):
    return bytecnn.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


_ALL = (op1_fertility, op2_lengths, op3_rotated, op4_packing, op5_bpe, op6_lines, op7_warc, op8_minmax, op9_bwt, op10_bytecnn)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op6_lines": r"""
        WITH cut AS (
            SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
        ), placed AS (
            SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM cut
        ), bare AS (
            SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM placed
        ), marked AS (
            SELECT doc_id, pos,
                   line = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) = 1 AS stays
            FROM bare
        ), edges AS (
            SELECT doc_id, pos, stays,
                   CASE WHEN stays IS DISTINCT FROM lag(stays) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS edge
            FROM marked
        ), islands AS (
            SELECT doc_id, pos, stays, sum(edge) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM edges
        ), runs AS (
            SELECT doc_id, island, stays, count(*) AS n FROM islands GROUP BY doc_id, island, stays
        )
        SELECT doc_id, CAST(sum(n) AS INTEGER) AS n_lines,
               CAST(coalesce(sum(n) FILTER (WHERE stays), 0) AS INTEGER) AS n_kept,
               CASE WHEN first(stays ORDER BY island) THEN '' ELSE '0,' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY island) AS keep
        FROM runs GROUP BY doc_id
    """,
    "op9_bwt": rf"""
        WITH worded AS (
            SELECT doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '{word_pattern()}') AS words
            FROM documents WHERE text IS NOT NULL
        ), long AS (
            SELECT doc_id, words FROM worded WHERE len(words) >= 50
        ), placed AS (
            SELECT doc_id, words, unnest(range(len(words) - 49)) AS pos FROM long
        ), runs AS (
            SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos + 1, pos + 50), ' ')) AS run FROM placed
        ), ranked AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth,
                   count(*) OVER (PARTITION BY run) AS n FROM runs
        ), kinds AS (
            SELECT doc_id, pos, CASE WHEN nth = 1 THEN 'first' ELSE 'repeat' END AS kind FROM ranked WHERE n > 1
        ), islands AS (
            SELECT doc_id, kind, pos, pos - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS island FROM kinds
        )
        SELECT doc_id, kind, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word
        FROM islands GROUP BY doc_id, kind, island
    """,
    "op7_warc": r"""
        WITH measured AS (
            SELECT page_id, url, html, octet_length(encode(html)) AS n_bytes FROM pages WHERE html IS NOT NULL
        ), framed AS (
            SELECT *, 87 + (n_bytes // 1000) * 1007
                   + CASE WHEN n_bytes % 1000 > 0 THEN n_bytes % 1000 + 4 + length(to_hex(n_bytes % 1000)) ELSE 0 END
                   + 5 AS total FROM measured
        )
        SELECT DISTINCT page_id, url, 'ok' AS status, CAST((total + 1023) // 1024 AS INTEGER) AS n_segments,
               CAST(total AS BIGINT) AS total_length, CAST(n_bytes AS BIGINT) AS n_bytes, html
        FROM framed
    """,
}
