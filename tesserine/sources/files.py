"""Manifests, score caches and fact-check files: readers with explicit schemas, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "cascade_id string, label string, file_path string, file_name string, file_size_bytes bigint, duration_sec double, width int, height int, fps double, source_url string, actual_url string, used_fallback boolean"
CORPUS_LIST = "cascade_id string, video_url string, label string"
IMAGE_MANIFEST = "id string, path string, abs_path string, label int, source string, split string, orig_width int, orig_height int, width int, height int, category string, hash string"
SCORES = "model_key string, id string, p double"
FACT_CHECK = "array<struct<text: string, claimDate: string, claimant: string, claimReview: array<struct<publisher: struct<name: string>, url: string, textualRating: string>>>>"


def read_csv(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A CSV file with a header; rows that don't fit the schema get nulls."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, schema: str = IMAGE_MANIFEST) -> DataFrame:
    """A JSON array or lines of JSON objects."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_scores(spark: SparkSession, path: str, model_key: str) -> DataFrame:
    """A cache ``{id: p}`` of one model as ``(model_key, id, p)``."""
    text = spark.read.text(path, wholetext=True)
    cache = F.from_json("value", T.MapType(T.StringType(), T.DoubleType()))
    return text.select(F.explode(cache).alias("id", "p")).select(F.lit(model_key).alias("model_key"), "id", "p")


def directory_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, stem, size and SHA-256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("source_id"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"))


def fact_check_rows(df: DataFrame, json_col: str) -> DataFrame:
    """One row for each review of each claim of a response; claims without a review and broken JSON give none."""
    claims = df.withColumn("_c", F.explode(F.from_json(json_col, FACT_CHECK)))
    reviews = claims.withColumn("_r", F.explode("_c.claimReview"))
    return reviews.select(*df.columns, F.col("_c.text").alias("claim"), F.col("_c.claimDate").alias("claim_date"), F.col("_c.claimant").alias("claimant"), F.col("_r.publisher.name").alias("publisher"), F.col("_r.url").alias("review_url"), F.col("_r.textualRating").alias("rating"))


def format_results(title: Column, url: Column, content: Column, number: Column) -> Column:
    """A search result as a labelled block."""
    return F.concat_ws("\n", F.concat(F.lit("SOURCE "), number.cast("string")), F.concat(F.lit("Title: "), title), F.concat(F.lit("URL: "), url), F.concat(F.lit("Content: "), content))


def parse_results(df: DataFrame, text: str) -> DataFrame:
    """The blocks of a text again as rows ``(pos, title, url, content)``; blocks without an address drop out."""
    blocks = df.select("*", F.posexplode(F.split(text, r"(?m)^SOURCE \d+\s*$")).alias("pos", "_b"))

    def field(name: str) -> Column:
        return F.regexp_replace(F.regexp_extract("_b", rf"(?ms)^{name}: (.*?)(?=^\w+: |\z)", 1), r"^\s+|\s+$", "")

    return blocks.select("*", field("Title").alias("title"), field("URL").alias("url"), field("Content").alias("content")).filter("url <> ''").drop("_b", text)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, JSON lines, or CSV with a header."""
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": lambda p: w.csv(p, header=True)}[kind](path)
