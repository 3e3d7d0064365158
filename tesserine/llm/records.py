"""Queries pN_ of the operators on records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.canonical import copies
from tesserine.llm.cross_split import cross_split_pairs, video_key
from tesserine.llm.topn import top_n_per_group
from tesserine.session import table


# Short hosts of the platforms in the tables.
SHORT_HOSTS = {"vdrv.example": "vidriver.example"}
# Marks of a copy or a re-encoding at the end of a file name.
COPY_MARKS = r"(?:\s*\(\d+\)|[\s_.-]*\b(?:copy|copie|kopie)(?:[\s_-]*\(?\d+\)?)?|[\s_-]+(?:copy|copie|kopie)(?:[\s_-]*\(?\d+\)?)?|[\s_.-]+(?:re-?enc(?:oded?)?|transcoded?|compressed|converted|x26[45]|h\.?26[45]|\d{3,4}p))+$"


def _cross(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    train = table(spark, d, "train_manifest")
    evals = table(spark, d, "val_manifest").withColumn("split", F.lit("val")).unionByName(table(spark, d, "test_manifest").withColumn("split", F.lit("test")))
    return train, evals, cross_split_pairs(train, evals, table(spark, d, "fvc"), copy_marks=COPY_MARKS, short_hosts=SHORT_HOSTS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _cross(spark, d)[2]
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and rows of each evaluation split and source, the platform of the row's address."""
    _, evals, pairs = _cross(spark, d)
    source = F.coalesce(F.substring_index(video_key(F.coalesce("source_url", "actual_url"), SHORT_HOSTS), ":", 1), F.lit("unknown"))
    of = evals.select(F.col("row_id").alias("eval_id"), "split", source.alias("source"))
    return pairs.join(of, "eval_id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_rows"), F.countDistinct("train_id").alias("n_train_rows"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "trace_real_evidence"), ["source_id"], "evidence_score", "evidence_id", 3).select("source_id", "evidence_id")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return copies(table(spark, d, "trace_real_evidence"), "evidence_id", ["claim_id"], ["source_id", "chunk"], ["url"], "chunk")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)[1].select(F.col("first_id").alias("evidence_id_a"), F.col("id").alias("evidence_id_b"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record with the number of its copies."""
    return _copies(spark, d)[0].select(F.col("first_id").alias("evidence_id"), "n_copies")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p4_found, p7_found, p7_records)}

_P4 = """
SELECT source_id, evidence_id FROM (
  SELECT source_id, evidence_id, row_number() OVER (PARTITION BY source_id ORDER BY evidence_score DESC, evidence_id) AS rn
  FROM trace_real_evidence WHERE source_id IS NOT NULL AND evidence_score IS NOT NULL) WHERE rn <= 3
"""


def _canon(x: str) -> str:
    return rf"regexp_replace(upper(replace({x}, 'ß', 'SS')), '[\p{{P}}\p{{Z}}\s\x{{85}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]+', '', 'g')"


_KEYED = rf"""
keyed AS (
  SELECT evidence_id, claim_id, coalesce({_canon('source_id')}, chr(2)) AS s, {_canon('chunk')} AS c,
    coalesce({_canon("split_part(split_part(url, '#', 1), '?', 1)")} || chr(1)
      || array_to_string(list_sort(list_filter(list_transform(string_split(regexp_extract(split_part(url, '#', 1), '\?(.*)$', 1), '&'), lambda p: {_canon('p')}), lambda p: p <> '')), chr(3))
      || chr(1) || {_canon("regexp_extract(url, '#(.*)$', 1)")}, chr(2)) AS u
  FROM trace_real_evidence WHERE regexp_replace(chunk, '[\s\p{{Z}}]+', '', 'g') <> '')
"""
_P7 = f"""
WITH {_KEYED}, firsts AS (SELECT evidence_id, min(evidence_id) OVER (PARTITION BY claim_id, s, u, c) AS first_id FROM keyed)
SELECT DISTINCT first_id AS evidence_id_a, evidence_id AS evidence_id_b FROM firsts WHERE first_id <> evidence_id
"""
_P7_RECORDS = f"""
WITH {_KEYED} SELECT min(evidence_id) AS evidence_id, count(*) AS n_copies FROM keyed GROUP BY claim_id, s, u, c
"""

_PAIRS = r"""
m AS (
  SELECT row_id, 'train' AS split, cascade_id, file_path, duration_sec, coalesce(source_url, actual_url) AS url FROM train_manifest
  UNION ALL SELECT row_id, 'val', cascade_id, file_path, duration_sec, coalesce(source_url, actual_url) FROM val_manifest
  UNION ALL SELECT row_id, 'test', cascade_id, file_path, duration_sec, coalesce(source_url, actual_url) FROM test_manifest),
k AS (
  SELECT row_id, split, url, duration_sec AS d, nullif(regexp_replace(lower(cascade_id), '[^\p{L}\p{N}]+', '', 'g'), '') AS cas,
    trim(lower(regexp_replace(regexp_extract(file_path, '([^/\\]*)$', 1), '\.[A-Za-z0-9]{1,5}$', ''))) AS stem FROM m),
f AS (
  SELECT *, nullif(regexp_replace(regexp_replace(stem, '(\s*\(\d+\)|\s*-\s*copy|[_.-]copy|[_.-]reenc|[_.-]\d+p)$', ''), '(\s*\(\d+\)|\s*-\s*copy|[_.-]copy|[_.-]reenc|[_.-]\d+p)$', ''), '') AS fil FROM k),
w AS (
  SELECT DISTINCT nullif(regexp_replace(lower(cascade_id), '[^\p{L}\p{N}]+', '', 'g'), '') AS cas,
    replace(regexp_replace(lower(regexp_extract(video_url, '^[A-Za-z]+://([^/?#]+)', 1)), '^(www\.|m\.)+', ''), 'vdrv.example', 'vidriver.example') || ':' ||
    CASE WHEN regexp_matches(video_url, '[?&]v=') THEN regexp_extract(video_url, '[?&]v=([^&#]+)', 1)
         ELSE regexp_extract(regexp_replace(video_url, '[?#].*$', ''), '/([^/]+)/*$', 1) END AS vid
  FROM fvc WHERE video_url IS NOT NULL),
v AS (SELECT row_id, split, vid FROM f JOIN w USING (cas)),
pairs AS (
  SELECT a.row_id AS t, b.row_id AS e FROM f a JOIN f b ON a.cas = b.cas AND a.split = 'train' AND b.split <> 'train'
  UNION SELECT a.row_id, b.row_id FROM f a JOIN f b ON a.fil = b.fil AND a.split = 'train' AND b.split <> 'train' AND round(abs(a.d - b.d), 9) < 0.1
  UNION SELECT a.row_id, b.row_id FROM v a JOIN v b ON a.vid = b.vid AND a.split = 'train' AND b.split <> 'train')
"""
_P2 = f"WITH {_PAIRS} SELECT least(t, e) AS row_id_a, greatest(t, e) AS row_id_b FROM pairs"
_P2_REPORT = rf"""
WITH {_PAIRS}
SELECT split, coalesce(nullif(replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^(www\.|m\.)+', ''), 'vdrv.example', 'vidriver.example'), ''), 'unknown') AS source,
  count(*) AS n_pairs, count(DISTINCT e) AS n_eval_rows, count(DISTINCT t) AS n_train_rows
FROM pairs JOIN f ON f.row_id = e GROUP BY 1, 2
"""
ORACLE = {"p2_found": _P2, "p2_report": _P2_REPORT, "p4_found": _P4, "p7_found": _P7, "p7_records": _P7_RECORDS}
