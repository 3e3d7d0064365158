"""Recognised texts of images and videos: cleaning, headlines, fusion of speech and screen, window decisions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import numbers, squeezed
from tesserine.operators.timeline import interval_join


def clean_ocr(df: DataFrame, text: str, confidence: str) -> DataFrame:
    """Rows of confidence 0.40 and more (single words 0.60) with two letters or digits; text squeezed. Nulls drop out."""
    t = squeezed(F.col(text))
    words = F.size(F.split(t, " "))
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    return df.withColumn(text, t).filter((F.col(confidence) >= 0.40) & ((words > 1) | (F.col(confidence) >= 0.60)) & (alnum >= 2))


def headlines(df: DataFrame, key: str, text: str, left: str, right: str, top: str, bottom: str) -> DataFrame:
    """``(key, headline)``: of wider-than-high lines in the upper 70 % of each image the ones nearly as high as the highest, top down."""
    w = Window.partitionBy(key)
    wide = df.withColumn("_h", F.col(bottom) - F.col(top)).withColumn("_low", F.max(bottom).over(w)).filter(((F.col(right) - F.col(left)) > F.col("_h")) & ((F.col(top) + F.col(bottom)) / 2 <= 0.7 * F.col("_low")))
    tall = wide.withColumn("_m", F.max("_h").over(w)).filter(F.col("_h") >= 0.85 * F.col("_m"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(top).alias("t"), F.col(left).alias("l"), F.col(text).alias("x"))))
    return tall.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["x"]), " ").alias("headline"))


def disagreements(speech: Column, screen: Column) -> Column:
    """Flags: numbers without a common one; one side denies and both share two words; a word said four times."""
    denials = F.array(*map(F.lit, ("not", "no", "never", "fake", "denies", "denied", "rejected", "false", "refutes")))
    a, b = F.split(F.lower(speech), r"\s+"), F.split(F.lower(screen), r"\s+")
    na, nb = numbers(speech), numbers(screen)
    loop = F.exists(F.array_distinct(a), lambda w: (F.length(w) > 3) & (F.size(F.filter(a, lambda x: x == w)) >= 4))
    return F.array_compact(
        F.array(
            F.when((F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb), F.lit("number_mismatch")),
            F.when((F.arrays_overlap(a, denials) != F.arrays_overlap(b, denials)) & (F.size(F.array_intersect(a, b)) >= 2), F.lit("polarity_conflict")),
            F.when(loop, F.lit("repetition_loop")),
        )
    )


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b)])


def fused(speech: DataFrame, screen: DataFrame, key: str, tolerance: float, width: float, similar: float = 0.50) -> DataFrame:
    """Speech ``(key, speech_id, s_from, s_to, s_text)`` with the screen texts ``(key, o_id, o_from, o_to, o_text)`` around it.

    One row for each segment with the texts in order of time, both where one of them is alike, else speech; then the
    texts no segment covers, as screen rows. Touching at the tolerance counts.
    """
    args = (key, "s_from", "s_to", "o_from", "o_to", tolerance, width)
    pairs = interval_join(speech, screen, *args).withColumn("alike", F.pandas_udf(_ratio, "double")("s_text", "o_text"))
    seen = pairs.groupBy(key, "speech_id").agg(F.array_sort(F.collect_list(F.struct("o_from", "o_text"))).alias("o"), F.max("alike").alias("alike"))
    said = speech.join(seen, [key, "speech_id"], "left").select(
        key, F.when(F.col("alike") >= similar, "both").otherwise("speech").alias("source"), F.col("s_text").alias("text"), F.col("s_from").alias("from"), F.col("s_to").alias("to"), F.coalesce(F.array_join(F.transform("o", lambda s: s["o_text"]), " | "), F.lit("")).alias("screen")
    )
    alone = interval_join(screen, speech, key, "o_from", "o_to", "s_from", "s_to", tolerance, width, "anti")
    return said.unionByName(alone.select(key, F.lit("screen").alias("source"), F.col("o_text").alias("text"), F.col("o_from").alias("from"), F.col("o_to").alias("to"), F.lit("").alias("screen")))


def window_decisions(df: DataFrame, key: str, p: str, high: float = 0.65, low: float = 0.35) -> DataFrame:
    """Mean score of each key's windows and what it decides: positive, negative or uncertain; null scores don't count."""
    m = F.avg(p)
    return df.groupBy(key).agg(F.count(p).alias("n"), m.alias("mean")).withColumn("decision", F.when(F.col("mean") >= high, "positive").when(F.col("mean") <= low, "negative").when(F.col("mean").isNotNull(), "uncertain"))


def folded_labels(df: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Scores of a model's labels folded to entailment, contradiction and neutral by their greatest; the best with them."""
    low = F.lower(label)
    kind = F.when(low.contains("entail") & ~low.contains("not"), "entailment").when(low.contains("contra"), "contradiction").otherwise("neutral")
    per = df.groupBy(key).agg(*(F.coalesce(F.max(F.when(kind == k, F.col(score))), F.lit(0.0)).alias(k) for k in ("entailment", "contradiction", "neutral")))
    best = F.greatest("entailment", "contradiction", "neutral")
    return per.withColumn("best", F.when(F.col("entailment") == best, "entailment").when(F.col("contradiction") == best, "contradiction").otherwise("neutral"))


def errors(df: DataFrame, id_col: str, y: str, p: str, threshold: float = 0.5, by: str | None = None, n: int = 10) -> DataFrame:
    """The ``n`` false positives and false negatives furthest off, of each value of ``by``, with their numbers in all."""
    wrong = df.filter((F.col(p) >= threshold) != (F.col(y) == 1)).withColumn("kind", F.when(F.col(y) == 1, "false_negative").otherwise("false_positive"))
    keys = [*([by] if by else []), "kind"]
    w = Window.partitionBy(*keys)
    return wrong.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs(F.col(p) - threshold)), id_col))).withColumn("n_errors", F.count(F.lit(1)).over(w)).filter(F.col("rank") <= n).select(id_col, *keys, p, "rank", "n_errors")
