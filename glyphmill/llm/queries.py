"""One thin query per operator, over whole tables; and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotraining, html_extract, license_scan, mixing, quality_rules, secret_scan, simhash, streaming_dedup, token_counts
from .common import scratch


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(*columns) if columns else rows


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("license_spans").cast("long").alias("n_matches"), "license_dice")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "tokens")
    token_counts.write_flat(_read(spark, sf_dir, "documents", "text"), target)
    counted = token_counts.count_tokens(token_counts.read_blocks(spark, target))
    return counted.withColumn("file", F.regexp_extract("file", r"(part-\d+)", 1))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return cotraining.classify(docs, _read(spark, sf_dir, "labels"), carry=["doc_id"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming_dedup.dedup_files(spark, f"{sf_dir}/documents.parquet", columns=["doc_id"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_read(spark, sf_dir, "documents", "doc_id", "text", "source"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), carry=["doc_id"])
    base = [kind for kind, *_ in secret_scan.BASE]
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = secret_scan.joined_spans(F.filter("secrets", lambda x: x["kind"].isin(base)))
    return found.select("doc_id", *map(count, base), F.sha2(of_base, 256).alias("base_sha256"), secret_scan.joined_spans(F.col("secrets")).alias("spans"), "n_live", "n_example", "n_shared")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"], digests=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_license_scan, op3_token_counts, op4_quality_classifier, op5_exact_dedup, op6_quality_rules, op7_secret_scan, op8_html_extraction, op9_simhash, op10_bpe, pipeline,
    )
}

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         CASE WHEN row_number() OVER (ORDER BY source NULLS LAST) % 2 = 1 THEN 0.5 ELSE 1.5 END AS first
  FROM docs GROUP BY source),
ordered AS (
  SELECT *, 3.0 * source_size / w AS ratio, sum(source_size) OVER () AS whole, sum(w) OVER () AS all_w,
         coalesce(sum(3.0 * source_size) OVER before, 0) AS full_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM sources WINDOW before AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, max((whole - full_before) / (all_w - w_before)) OVER () AS level FROM ordered),
targets AS (
  SELECT source, source_size, CAST(least(3.0 * source_size, level * w) AS DOUBLE) AS target, w,
         CAST(w * first AS DOUBLE) AS w0, CAST(w * (2.0 - first) AS DOUBLE) - CAST(w * first AS DOUBLE) AS slope
  FROM levels),
placed AS (
  SELECT docs.*, t.source_size, t.target, t.w, t.w0, t.slope, CAST(floor(t.target + 0.5) AS BIGINT) AS stop,
         coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM docs JOIN targets t ON docs.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, stop - start)) + greatest(0, least(size, stop - start - source_size))
            + greatest(0, least(size, stop - start - 2 * source_size)) AS BIGINT) AS taken,
       -- the time t at which the source's demand w0 t + slope t^2 / 2 is at the document's place
       CASE WHEN size > 0 AND stop > start THEN 2 * area / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * area, 0))) END AS position
FROM (SELECT *, CASE WHEN size > 0 AND stop > start THEN w * start / target END AS area FROM placed)
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

_OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS g FROM repeated),
covered AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS n FROM gaps GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         coalesce(100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars / nullif(n_words, 0) < 2 OR word_chars / nullif(n_words, 0) > 15, false) AS soft_failed
  FROM m),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR soft_failed THEN 1 ELSE 0 END) AS f FROM j GROUP BY source),
moments AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(10000, greatest(1, m * (1 - m) / v - 1)) ELSE 10000 END AS s FROM moments),
verdicts AS (SELECT source, (f + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.6 AND NOT (rate > 0.25 AND soft_failed) AS kept
FROM j JOIN verdicts ON j.source IS NOT DISTINCT FROM verdicts.source
"""

#: SQL for DuckDB; where there is none, tests hold the query against brute force.
ORACLE = {"op1_mixing": _OP1, "op5_exact_dedup": _OP5, "op6_quality_rules": _OP6}
