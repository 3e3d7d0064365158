"""Top rows with variety, duplicates by address, near-duplicates by exact shingle overlap, greedy survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import shingle_hashes
from tesserine.operators.skew import keyed_join, salted_join
from tesserine.session import spread, written

JACCARD = 0.8


def diverse_top(df: DataFrame, key: str, group: str, score: str, tie: str, k: int, per_group: int = 2) -> DataFrame:
    """``k`` rows of each key: the best of each group first, groups by their best, then the second ones.

    Null groups are one group, null scores last; ties go to the smaller ``tie``. A key's rows are ranked in its groups
    first, so what is ranked over the key is at most ``per_group`` rows a group.
    """
    order = [F.desc_nulls_last(score), F.col(tie)]
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key, group).orderBy(*order))).filter(F.col("_rn") <= per_group)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("_rn", *order))).filter(F.col("rank") <= k).drop("_rn")


def dedup_merging(df: DataFrame, keys: list[str], label: str, order: list[str]) -> DataFrame:
    """One row for each of the keys with its number of rows, its labels sorted and the first of ``order[0]``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(label)).alias("labels"), F.min(order[0]).alias("first_id"))


def dedup_best(df: DataFrame, keys: list[str], score: str, tie: str, merged: list[str]) -> DataFrame:
    """The row of greatest score of each of the keys, nulls last and ties to the smaller ``tie``, with its number of rows and the sorted labels of all of
    them in place of the ``merged`` columns.

    One aggregate with map-side combining, so a key that holds a third of all rows costs a row a task.
    """
    rest = [c for c in df.columns if c not in (*keys, *merged)]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score).isNotNull(), F.col(score), -F.col(tie))).alias("_best")
    return df.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("n"), *(F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c) for c in merged)).select(*keys, "_best.*", "n", *merged)


def text_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, class_id)``: rows with equal shingle sets share the smallest id; texts without a word have no class."""
    keyed = _sets(df, id_col, text).select("id", "h1", "h2")
    return keyed.join(keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id")), ["h1", "h2"]).select("id", "class_id")


def _sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, s, h1, h2)``: sorted shingle hashes of texts with a word, and 128 bits of them. The sets are made once and written."""
    worded = spread(df.select(F.col(id_col).alias("id"), F.col(text).alias("t"))).filter(F.col("t").rlike(r"[\p{L}\p{N}]"))
    sets = written(worded.select("id", shingle_hashes(F.col("t")).alias("s")), "sets")
    return sets.select("id", "s", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"))


def _representatives(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, s, n)``: the smallest row of each class with its shingles and their number."""
    sets = _sets(df, id_col, text)
    first = sets.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    return written(sets.join(first.select("id"), "id", "left_semi").select("id", "s").withColumn("n", F.size("s")), "representatives")


def _by_rarity(reps: DataFrame) -> DataFrame:
    """``(id, n, h, at)``: the shingles of a set that other sets have too, with their place in it from the rarest on.

    Shingles of one set only come first in that order and make no pair, so they are counted and left out.
    """
    each = reps.select("id", "n", F.explode("s").alias("h"))
    common = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")
    held = keyed_join(each, common, ["h"], "df", F.col("id"), row_bytes=24)
    of = Window.partitionBy("id")
    ranked = held.withColumn("rn", F.row_number().over(of.orderBy("df", "h"))).withColumn("shared", F.count(F.lit(1)).over(of))
    return ranked.select("id", "n", "h", (F.col("n") - F.col("shared") + F.col("rn")).alias("at"))


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(id_a, id_b, n_a, n_b, overlap)`` of candidate pairs by their whole sets."""
    full = salted_join(written(pairs, "candidates"), reps.select(F.col("id").alias("id_a"), F.col("s").alias("sa")), ["id_a"], F.col("id_b"))
    both = salted_join(written(full, "half"), reps.select(F.col("id").alias("id_b"), F.col("s").alias("sb")), ["id_b"], F.col("id_a"))
    return both.select("id_a", "id_b", F.size("sa").alias("n_a"), F.size("sb").alias("n_b"), F.size(F.array_intersect("sa", "sb")).alias("overlap"))


def near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float = JACCARD) -> DataFrame:
    """``(id_a, id_b, overlap, jaccard)`` of pairs of class representatives with Jaccard similarity of at least the threshold.

    Prefix filter: the shingles of a set are ordered by the number of sets that have them, the rarest first, and sets as
    similar as asked for share one of the first ``n - ceil(t * n) + 1``; pairs whose sizes, or the places of the shared
    shingle, leave too few others to share are left out by the join. A shingle that much of the corpus has comes last
    in all sets, and what is hot all the same is salted. All candidates are verified by their whole sets, so no pair is
    lost and no bucket is capped. Rows with equal sets are one class (``text_classes``) and appear by their
    representative, so copies aren't paired with each other. Words are those of any script.
    """
    reps = _representatives(df, id_col, text)
    prefix = written(_by_rarity(reps).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1), "prefixes")
    a, b = (prefix.withColumnsRenamed({c: f"{c}_{x}" for c in ("id", "n", "at")}) for x in "ab")
    need = F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    left = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    close = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    pairs = salted_join(a, b, ["h"], F.col("id_a")).filter((F.col("id_a") < F.col("id_b")) & close).groupBy("id_a", "id_b").agg(F.max(left - need).alias("spare")).filter("spare >= 0").select("id_a", "id_b")
    scored = _verified(pairs, reps).withColumn("jaccard", F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap")))
    return scored.filter(F.col("jaccard") >= threshold).select("id_a", "id_b", "overlap", "jaccard")


def contained_texts(df: DataFrame, id_col: str, text: str, threshold: float = 0.9) -> DataFrame:
    """``(small_id, large_id, overlap, containment)``: representatives of which so much of the smaller set is in the larger.

    Shortened copies have a small Jaccard similarity but are contained. The rarest ``n - ceil(t * n) + 1`` shingles of
    the smaller one must meet one of the larger, so only these are joined to all shingles that sets share. Sets of equal
    size are paired once, by their ids; sets of fewer than four shingles are contained by chance and take no part.
    """
    reps = _representatives(df, id_col, text)
    ordered = written(_by_rarity(reps), "ordered")
    small = ordered.filter((F.col("n") >= 4) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)).select(F.col("id").alias("id_a"), F.col("n").alias("m_a"), "h")
    large = ordered.select(F.col("id").alias("id_b"), F.col("n").alias("m_b"), "h")
    smaller = (F.col("m_a") < F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("id_a") < F.col("id_b")))
    pairs = salted_join(large, small, ["h"], F.col("id_b")).filter(smaller).select("id_a", "id_b").distinct()
    scored = _verified(pairs, reps).withColumn("containment", F.col("overlap") / F.col("n_a"))
    return scored.filter(F.col("containment") >= threshold).select(F.col("id_a").alias("small_id"), F.col("id_b").alias("large_id"), "overlap", "containment")


def greedy_survivors(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id,)`` kept when going through the ids in order and dropping each one that is paired with a kept one before.

    That is the lexicographically first maximal independent set: A~B, B~C, A and C apart keeps A and C. Rounds keep all
    ids without an undecided smaller neighbour and drop their neighbours; each round is written, cutting the lineage, and
    decides at least the smallest id left, so any chain comes to its end.
    """
    edges = written(pairs.select("id_a", "id_b").distinct(), "edges")
    state = written(ids.select("id").distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    while True:
        undecided = state.filter("kept is null").select("id")
        live = edges.join(undecided.withColumnRenamed("id", "id_a"), "id_a").join(undecided.withColumnRenamed("id", "id_b"), "id_b")
        keep = undecided.join(live.select(F.col("id_b").alias("id")), "id", "left_anti").withColumn("k", F.lit(True))
        drop = edges.join(keep.select(F.col("id").alias("id_a")), "id_a").select(F.col("id_b").alias("id")).distinct().withColumn("d", F.lit(True))
        state = written(state.join(keep, "id", "left").join(drop, "id", "left").select("id", F.coalesce("kept", F.when(F.col("k"), True).when(F.col("d"), False)).alias("kept")), "state")
        if not state.filter("kept is null").take(1):
            break
    return state.filter("kept").select("id")
