"""Near-duplicates by perceptual hashes: all pairs within a Hamming distance, and greedy survivors of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.scores import hamming
from tesserine.operators.skew import salted_join
from tesserine.session import written

BITS = 60


def sign_hash(vector: Column, bits: int = BITS) -> Column:
    """A bigint of the signs of a vector's first values, the first one lowest; null for a null vector.

    It stands for the hash of decoded pixels, of which the bits are signs too, of differences from a mean.
    """
    signs = (F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(bits))
    return F.when(vector.isNotNull(), reduce(Column.__add__, signs))


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, distance: int, bits: int = BITS) -> DataFrame:
    """``(id_a, id_b, distance, n_a, n_b)`` of all pairs of hashes at most ``distance`` bits apart, none lost.

    Rows of one hash are one class and appear by their smallest id, with their number, so copies aren't paired. A hash
    is cut into ``distance + 1`` parts; of hashes so near at least one part is equal, so pairs are joined by part, the
    first equal part counts, and parts that many hashes share are salted. Null hashes have no part.
    """
    reps = written(df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).cast("bigint").alias("h")).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n")), "hashes")
    parts = distance + 1
    width = -(-bits // parts)
    mask = (1 << width) - 1

    def part(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit(mask).cast("bigint"))

    cut = reps.select("id", "h", "n", F.posexplode(F.array(*(part(F.col("h"), i) for i in range(parts)))).alias("at", "part"))
    a, b = (cut.withColumnsRenamed({c: f"{c}_{x}" for c in ("id", "h", "n")}) for x in "ab")
    met = salted_join(a, b, ["at", "part"], F.col("id_a")).filter("id_a < id_b")
    first = F.array_position(F.array(*(part(F.col("h_a"), i) == part(F.col("h_b"), i) for i in range(parts))), F.lit(True)) - 1
    near = met.filter((F.col("at") == first) & (hamming(F.col("h_a"), F.col("h_b")) <= distance))
    return near.select("id_a", "id_b", hamming(F.col("h_a"), F.col("h_b")).cast("int").alias("distance"), "n_a", "n_b")
