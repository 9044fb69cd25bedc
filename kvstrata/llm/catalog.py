"""The opN_ queries of this subpackage over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, curriculum, exact_dedup, html_text, line_dedup, simhash, suffix_dedup, topk, toxicity, url_reputation
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; a labelled row of quality 0 is a bad outcome of the page with its id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, is_toxic of all documents, by a chain fitted on a sample of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, docs, table(spark, sf_dir, "labels")).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filters, op2_topk, op3_exact_dedup, op4_toxicity, op5_html_extraction, op6_bpe, op7_line_dedup, op8_mixing, op9_suffix_dedup, op10_simhash)
    return {f.__name__: f for f in ops}


OP1_SQL = r"""
WITH urls AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
counts AS (
  SELECT doc_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         regexp_replace(host, ':\d*$', '') AS bare, string_split(regexp_replace(host, ':\d*$', ''), '.') AS names
  FROM parts LEFT JOIN counts ON doc_id = page_id GROUP BY host),
kinds AS (
  SELECT *, array_to_string(names[-2:], '.') AS two, len(names) < 2 OR regexp_matches(bare, '^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$') AS single,
         array_to_string(names[-2:], '.') IN (TWO_NAMES) AS long FROM hosts),
named AS (
  SELECT host, n, bad,
         CASE WHEN single THEN bare WHEN long AND len(names) > 2 THEN array_to_string(names[-3:], '.') ELSE two END AS domain,
         CASE WHEN single THEN bare WHEN long THEN two ELSE names[-1] END AS suffix
  FROM kinds),
base AS (SELECT sum(n) AS p_n, sum(bad) AS p_bad, 0.5::DOUBLE AS p_mean, 1::DOUBLE AS p_size FROM named),
s0 AS (
  SELECT suffix, n, bad, p_size + p_n - n AS support, (p_size * p_mean + p_bad - bad) / (p_size + p_n - n) AS mean FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY suffix) , base),
s1 AS (
  SELECT sum(mean * (1 - mean)) AS noise, sum(n * pow(bad / n - mean, 2)) AS spread, sum(n * mean * (1 - mean)) AS within FROM s0 WHERE n > 0),
s2 AS (SELECT (spread - noise) / nullif(within - noise, 0) AS excess FROM s1),
s3 AS (SELECT coalesce(least(greatest(CASE WHEN excess > 0 THEN 1 / excess - 1 ELSE 1000 END, 1), 1000), 1000) AS k FROM s2),
s4 AS (SELECT suffix, n, bad, mean, 1 / (1 / k + 1 / support) AS size FROM s0, s3),
d0 AS (
  SELECT suffix, domain, n, bad, p_size + p_n - n AS support, (p_size * p_mean + p_bad - bad) / (p_size + p_n - n) AS mean FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY suffix, domain) JOIN (SELECT suffix, n AS p_n, bad AS p_bad, mean AS p_mean, size AS p_size FROM s4) USING (suffix)),
d1 AS (
  SELECT sum(mean * (1 - mean)) AS noise, sum(n * pow(bad / n - mean, 2)) AS spread, sum(n * mean * (1 - mean)) AS within FROM d0 WHERE n > 0),
d2 AS (SELECT (spread - noise) / nullif(within - noise, 0) AS excess FROM d1),
d3 AS (SELECT coalesce(least(greatest(CASE WHEN excess > 0 THEN 1 / excess - 1 ELSE 1000 END, 1), 1000), 1000) AS k FROM d2),
d4 AS (SELECT suffix, domain, n, bad, mean, 1 / (1 / k + 1 / support) AS size FROM d0, d3),
h0 AS (
  SELECT host, n, bad, p_size + p_n - n AS support, (p_size * p_mean + p_bad - bad) / (p_size + p_n - n) AS mean FROM named JOIN (SELECT domain, n AS p_n, bad AS p_bad, mean AS p_mean, size AS p_size FROM d4) USING (domain)),
h1 AS (
  SELECT sum(mean * (1 - mean)) AS noise, sum(n * pow(bad / n - mean, 2)) AS spread, sum(n * mean * (1 - mean)) AS within FROM h0 WHERE n > 0),
h2 AS (SELECT (spread - noise) / nullif(within - noise, 0) AS excess FROM h1),
h3 AS (SELECT coalesce(least(greatest(CASE WHEN excess > 0 THEN 1 / excess - 1 ELSE 1000 END, 1), 1000), 1000) AS k FROM h2),
h4 AS (SELECT host, n, bad, mean, 1 / (1 / k + 1 / support) AS size FROM h0, h3),
post AS (SELECT host, (size * mean + bad) / (size + n) AS mean, size + n AS size FROM h4),
bounds AS (SELECT host, mean - 1.645 * sqrt(greatest(mean * (1 - mean), 0) / (size + 1)) AS bound FROM post),
rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules
    ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
   AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p JOIN bounds USING (host) LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
""".replace("TWO_NAMES", ", ".join(f"'{x}'" for x in url_reputation.TWO_NAME_SUFFIXES))

OP2_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

OP3_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Positions solve u t + v t^2 / 2 = fraction of the integral, for each piece of a schedule. Levels rise until the sources that stay under their caps take all that the capped ones leave.
OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))) AS key FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sized GROUP BY source),
need AS (
  SELECT source, s, w, 2.0::DOUBLE * s AS cap,
         (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2.0::DOUBLE * s) OVER (ORDER BY 2.0::DOUBLE * s / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * s / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
goal AS (
  SELECT source, s, w, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM need WHERE level * w <= cap) * w, cap)) AS target FROM need),
rows_ AS (
  SELECT doc_id, size, s, w, target, sized.source, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source),
shares AS (SELECT *, least(1.0::DOUBLE, coalesce(ahead / nullif(target, 0.0), 1.0::DOUBLE)) AS x FROM rows_)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
       CASE w WHEN 5 THEN least(2 * x / (1.5 + sqrt(greatest(2.25 - 2 * x, 0.0))), 1.0) WHEN 2 THEN least(2 * x / (1.0 + sqrt(1.0)), 1.0)
              ELSE CASE WHEN x <= 0.25 THEN least(2 * x / (0.25 + sqrt(0.0625 + 2 * x)), 0.5)
                        ELSE least(0.5 + 2 * (x - 0.25) / (0.75 + sqrt(0.5625 + 6 * (x - 0.25))), 1.0) END END::DOUBLE AS position,
       (greatest(0, least(size, floor(target + 0.5)::BIGINT - ahead)) + greatest(0, least(size, floor(target + 0.5)::BIGINT - s - ahead)))::BIGINT AS taken
FROM shares
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op2_topk": OP2_SQL, "op7_line_dedup": OP7_SQL, "op3_exact_dedup": OP3_SQL, "op8_mixing": OP8_SQL}
