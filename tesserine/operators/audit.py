"""Audit of data sets: groups of duplicates, conflicts, connected components, splits by group, statistics by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.skew import keyed_join
from tesserine.session import written


def duplicate_groups(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Groups of more than one row with equal, non-null keys: number and smallest id."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups whose rows bear different labels, with the sorted labels."""
    return df.dropna(subset=[*keys, label]).groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count(F.lit(1)).alias("n")).filter(F.size("labels") > 1)


def star_edges(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """``(a, b)``: each row of a key linked with the smallest id of it; a key of n rows has n - 1 edges, not n squared."""
    keyed = df.filter(F.col(key).isNotNull()).select(F.col(id_col).alias("b"), F.col(key).alias("k")).distinct()
    return keyed.join(keyed.groupBy("k").agg(F.min("b").alias("a")), "k").filter("a <> b").select("a", "b")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``, the smallest id each vertex is connected with.

    Alternating large-star and small-star steps contract the graph in about log n rounds, also along chains; each round
    is written to the shared folder, which cuts the lineage. Minima are grouped with map-side combining and come back to
    the neighbours by a broadcast of checked size or a salted join, so a hub of any degree is spread over tasks.
    """
    e = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        # large star: larger neighbours of a vertex are linked with the smallest of its neighbours and itself
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = keyed_join(both.filter("v > u"), written(least, "least"), ["u"], "n", F.col("v")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        # small star: smaller neighbours of a vertex and itself are linked with the smallest of them
        down = large.filter("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v")).distinct()
        m = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = keyed_join(down, m, ["u"], "n", F.col("v")).select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(m.select(F.col("m").alias("a"), F.col("u").alias("b")))
        e = written(small.filter("a <> b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    of = e.groupBy("b").agg(F.min("a").alias("component"))
    return vertices.select("id").distinct().join(of.withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def grouped_split(df: DataFrame, group: str, label: str, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42, held_out: Column | None = None) -> DataFrame:
    """Each group whole in one of train, val and test, in about these shares of the groups of each label.

    A group's place is the hash of its name and the seed, so groups keep their split when others come; the label of a
    group is its smallest. Null groups are rows of their own and go to train. Groups with a row for which ``held_out``
    holds are all test, so that what is held out (a generator, a source) is in no other split; null groups too, row by row.
    """
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    groups = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(label).alias("_l"), F.coalesce(F.max(out), F.lit(False)).alias("_o"))
    name = F.concat_ws("|", F.col(group).cast("string"), F.col("_l").cast("string"), F.lit(str(seed)))
    place = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    split = F.when(F.col("_o"), "test").when(place < shares[0], "train").when(place < shares[0] + shares[1], "val").otherwise("test")
    return df.join(groups.select(group, split.alias("split")), group, "left").withColumn("split", F.coalesce("split", F.when(out, "test").otherwise("train")))


def split_by_precedence(df: DataFrame, key: str, split: str, order: tuple[str, ...] = ("train", "val", "test"), tie: str = "row_id") -> DataFrame:
    """One row of each non-null key, of the split that comes first."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col(split))
    w = Window.partitionBy(key).orderBy(rank, tie)
    return df.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def shared_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split, with the splits; none where splits are disjoint."""
    return df.dropna(subset=[key, split]).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def class_statistics(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Number, least, greatest, mean, median and population deviation of each value, of each label and of all (null)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        c = F.col(v).cast("double")
        aggs += [F.min(c).alias(f"{v}_min"), F.max(c).alias(f"{v}_max"), F.avg(c).alias(f"{v}_mean"), F.median(c).alias(f"{v}_median"), F.stddev_pop(c).alias(f"{v}_std")]
    return df.rollup(label).agg(*aggs)
