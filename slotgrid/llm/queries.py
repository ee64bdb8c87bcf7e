"""The queries of the text operators, each over its whole tables, and the DuckDB SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, filter_audit, html_extract, license_scan, line_dedup, lm, minhash, pii, quality, simhash, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and text_sha256 of the text that stays."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score.*")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("letter")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_top_k, op3_bpe, op4_pii, op5_decontaminate, op6_simhash, op7_lm, op8_quality, op9_html, op10_licenses, op11_minhash, op12_filter_audit, op13_divergence)
}

#: Upper and lower case of the letters that the contracts lower.
CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _steps() -> str:
    """The rows (filter_order, step, bit, before) of all orders of the five filters."""
    rows = []
    for order in permutations(filter_audit.FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << filter_audit.FILTERS.index(letter)
            rows.append(f"('{''.join(order)}', {step}, {bit}, {before})")
            before |= bit
    return ", ".join(rows)

ORACLE_SQL: dict[str, str] = {
    "op2_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(CAST(x AS DOUBLE) * 256) FOR x IN embedding] AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {CASES}), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) ELSE w END AS s FROM w
        ), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
        ), k AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (SELECT a, b FROM k WHERE 100 * k >= 80 * (m + n - k)
        ), t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a
        ), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1
        ) SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.doc_id""",
    "op12_filter_audit": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), f AS (
            SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
              + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
              + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d
        ), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY 1
        ), c AS (SELECT part, mask, count(*) AS n, coalesce(sum(q), 0) AS q, coalesce(sum(x), 0) AS x FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY 1, 2
        ), s AS (SELECT * FROM (VALUES {_steps()}) AS v(filter_order, step, bit, before)
        ), a AS (
            SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
              sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
              sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN q ELSE 0 END) AS good_lost,
              sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4
        ) SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
          CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
          CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM a""",
    "op13_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {CASES}) AS t FROM documents
        ), o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10
        ), n AS (SELECT o.lang, source, o.term, CAST(count(*) AS HUGEINT) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY 1, 2, 3
        ), g AS (SELECT DISTINCT lang, source FROM d
        ), v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1
        ), m AS (SELECT lang, source, sum(c) AS n FROM n GROUP BY 1, 2
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, CAST(1 + 1000000000 * (coalesce(n.c, 0) + 2) // (coalesce(m.n, 0) + 2 * v.v) AS BIGINT) AS p,
              CAST(1 + 1000000000 * (k.c + 2) // (v.n + 2 * v.v) AS BIGINT) AS q
            FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN m ON m.lang = g.lang AND m.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
        ), f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
        ), u AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
        ), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
        SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 10""",
}
