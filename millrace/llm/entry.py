"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import html_extract, license_scan, line_dedup, media, mixing, ngram_join, packing, quality_crf, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_crf.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_crf.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The rules that the query judges by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.apply_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"), k=20).select("query_id", "rank", "vec_id", "score")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Parameters of the mix: the domains' shares, and the clean domain's own size as the measure of the budget.
MIX = {"targets": {"clean": 0.95, "toxic": 0.04, "junk": 0.01}, "anchor": "clean", "headroom": 1.15}


def op6_target_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, mixing.domains_of_labels(table(spark, sf_dir, "labels")), **MIX)
    return mixed.select("doc_id", "n_tokens", "p_clean", "p_toxic", "p_junk", "rate", "copies")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarize(license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_crf, op2_url_filter, op3_html_extraction, op4_exact_topk, op5_media_columns, op6_target_mixing, op7_license_scan, op8_line_dedup, op9_ngram_jaccard_join, op10_best_fit_packing)}


#: Where plain SQL gives the same rows.
_URL_SQL = """
with parts as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as n
  from parts join rules on (host = h or host like '%.' || h) and starts_with(path, p))
select parts.page_id, host, path, rule, coalesce(v, 'allow') as verdict
from parts left join fits on parts.page_id = fits.page_id and n = 1
"""


_TOPK_SQL = """
with sound as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from sound q join sound c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _URL_SQL, "op4_exact_topk": _TOPK_SQL}
