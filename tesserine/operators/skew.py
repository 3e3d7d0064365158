"""Joins of a long table to a table of distinct keys, safe when one key holds much of the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A keyed side is broadcast while rows x row_bytes stay under this.
BROADCAST_BYTES = 8 << 20
#: A key is hot when it holds at least 1/HOT_SHARE of the weight; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 200
SALTS = 64


def keyed_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, spread: Column, row_bytes: int = 64, how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``rows`` to ``keyed`` (one row a key, none null), inner or left.

    ``keyed`` should be a written table: it is counted first. While it is small it is broadcast and ``rows`` isn't
    shuffled. Beyond that both sides are shuffled; keys whose ``weight`` (rows of that key) is at least 1/200 of the
    sum, of which there can be 200 at most, are salted by ``spread`` so that no task gets such a key whole.
    An empty side gives an empty (inner) or null-extended (left) result.
    """
    n, total = keyed.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n * row_bytes <= broadcast_bytes:
        return rows.join(F.broadcast(keyed), on, how)
    hot = keyed.filter(F.col(weight) * HOT_SHARE >= F.lit(total)).select(*on, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    right = keyed.withColumn("_salt", F.explode(F.when(F.col(weight) * HOT_SHARE >= F.lit(total), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def salted_join(a: DataFrame, b: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Inner join of two long tables on columns without nulls that may have keys which hold much of ``a``.

    ``a`` is counted by key with map-side combining, so it should be a written table or cheap to read; keys with at
    least 1/200 of its rows, of which there are 200 at most, are spread over tasks by ``spread``, a Column of ``a``,
    and their rows of ``b`` go to each of them. All pairs come out.
    """
    counts = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = a.count()
    hot = F.broadcast(counts.filter(F.col("_n") * HOT_SHARE >= F.lit(max(total, 1))).select(*on, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = a.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    right = b.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [*on, "_salt"]).drop("_salt")
