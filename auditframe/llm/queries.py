"""Queries of the problems on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditframe.llm import containers, history, languages, leaks


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replay(_table(spark, sf_dir, "intake"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fill_containers(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "containers"))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_overlaps(spark, sf_dir).filter("exact_words >= 12").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(languages.document_languages(_table(spark, sf_dir, "documents")))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return languages.find_passages(documents, languages.fit_prototypes(documents))


QUERIES = {f.__name__: f for f in (p2_found, p6_containers, p7_found, p7_overlaps, p8_found, p8_passages)}
ORACLE: dict[str, str] = {
    "p7_found": r"""
with w as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '\\\p{L}+', ' ', 'g')), '[\p{L}\p{N}]+') as w from documents),
  i as (select item_id, regexp_extract_all(lower(regexp_replace(text, '\\\p{L}+', ' ', 'g')), '[\p{L}\p{N}]+') as w from eval_items),
  wg as (select doc_id, array_to_string(w[k:k + 11], ' ') as g from w, range(1, len(w) - 10) as r(k) where len(w) >= 12),
  ig as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from i, range(1, len(w) - 10) as r(k) where len(w) >= 12)
select distinct doc_id, item_id from wg join ig using (g)""",
}
