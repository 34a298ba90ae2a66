"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard_join, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, token_counts, url_filters
from .common import table


#: The rules of the url query, as (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.source_domain(docs["source"]), mixing.WEIGHTS, max_epochs=mixing.MAX_EPOCHS, seed=mixing.SEED)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.url_filters(table(spark, sf_dir, "pages"), rules)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), license_scan.document_path())


#: All pairs that share a shingle; run by DuckDB on small tables only.
JACCARD_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
   ELSE list_distinct([array_to_string(w[i : i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, list_sort(s) AS s FROM s),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS rep, count(*) OVER (PARTITION BY s) AS copies FROM n WHERE n > 0),
x AS (SELECT rep, n, unnest(s) AS h FROM c WHERE doc_id = rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
   GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS node, a AS l FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(l) AS l FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.l, c.rep, n.doc_id) AS component_id, coalesce(c.copies, 1)::BIGINT AS n_copies
FROM n LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.node = c.rep"""


URL_SQL = f"""WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
p AS (SELECT row_number() OVER () AS rid, page_id,
   coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, r.host || r.path AS rule, r.verdict AS v,
   row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
   FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_near_dedup, op3_lm_scoring, op4_language_id, op5_jaccard_join, op6_packing, op7_mixing, op8_url_filters, op9_token_counts, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op5_jaccard_join": JACCARD_SQL, "op7_mixing": mixing.MIX_SQL, "op8_url_filters": URL_SQL}
