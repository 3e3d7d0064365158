"""Queries pN_ of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import boilerplate, encode, leak, lines, mojibake, records, residue, truncation
from tesserine.session import table


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trace_real_evidence")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_evidence(spark, d), "evidence_id", "domain", "url", "chunk").select(F.col("id").alias("evidence_id")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a text, those cut off and their share of each domain and kind of evidence."""
    ev = _evidence(spark, d)
    cut = p1_found(spark, d).withColumn("cut", F.lit(1))
    rows = ev.filter(F.length("chunk") > 0).select("evidence_id", "domain", "evidence_type").join(cut, "evidence_id", "left")
    agg = rows.groupBy("domain", "evidence_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("cut").alias("n_cut"))
    return agg.withColumn("share", F.col("n_cut") / F.col("n_rows"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_rows(_evidence(spark, d), "evidence_id", "chunk").select(F.col("id").alias("evidence_id")).distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored_texts(_evidence(spark, d), "evidence_id", "chunk").withColumnRenamed("id", "evidence_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(_evidence(spark, d), "evidence_id", "domain", "chunk").withColumnRenamed("id", "evidence_id")


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of each domain with their log-likelihood ratio and false-discovery level."""
    return lines.excess_lines(_evidence(spark, d), "evidence_id", "domain", "chunk")


def p5_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Rows within and outside, and the ratio, of the same lines."""
    return p5_lines(spark, d).select("source", "letters", "n_rows", "n_outside", F.round("llr", 6).alias("llr"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    ev = _evidence(spark, d)
    return lines.without_lines(ev, "evidence_id", "chunk", lines.repeated_lines(ev, "evidence_id", "domain", "chunk"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.template_lines(_evidence(spark, d), "evidence_id", "domain", "url", "chunk").withColumnRenamed("id", "evidence_id")


def p6_body(spark: SparkSession, d: str) -> DataFrame:
    ev = _evidence(spark, d)
    return lines.without_lines(ev, "evidence_id", "chunk", boilerplate.template_lines(ev, "evidence_id", "domain", "url", "chunk"), "body")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts won back from the ids of the whole corpus."""
    return encode.decoded_texts(p8_ids(spark, d), "doc_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), "doc_id", table(spark, d, "eval_items"), "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked: the number of documents and the greatest coverage, in order and in any order."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("coverage").alias("coverage"), F.max("loose").alias("loose"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


QUERIES = records.QUERIES | {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_restored, p5_found, p5_lines, p5_ratios, p5_clean, p6_found, p6_body, p8_ids, p8_texts, p9_found, p9_items, p10_found)}
