"""Media timelines: interval joins by time buckets, gap merges, sliding windows, sampling and line grouping."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import squeezed


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re_: str, tolerance: float, width: float, how: str = "inner") -> DataFrame:
    """Rows of both sides of one key whose intervals, widened by the tolerance, touch or overlap; inner, left, anti.

    Both sides are cut into buckets of ``width`` and joined on key and bucket, so the join is a hash join; of the
    buckets an overlap spans only the first one counts, so no pair comes twice and none is to be made distinct. Intervals
    with a null end match nothing. Columns of the right side must not clash with those of the left, the key aside.
    """
    t = F.lit(tolerance)
    a = left.withColumn("_b", F.explode_outer(F.when(F.col(ls).isNotNull() & F.col(le).isNotNull(), _buckets(F.col(ls) - t, F.col(le) + t, width))))
    b = right.filter(F.col(rs).isNotNull() & F.col(re_).isNotNull()).withColumn("_c", F.explode(_buckets(F.col(rs), F.col(re_), width))).withColumnRenamed(key, "_k")
    first = F.greatest(F.floor((F.col(ls) - t) / width), F.floor(F.col(rs) / width))
    on = (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & (F.col("_b") == first) & (F.col(rs) <= F.col(le) + t) & (F.col(re_) >= F.col(ls) - t)
    if how == "inner":
        return a.join(b, on).drop("_b", "_c", "_k")
    # each left row is told by a number of its own, so rows that repeat stay rows and only one shuffle follows the join
    told = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", F.explode_outer(F.when(F.col(ls).isNotNull() & F.col(le).isNotNull(), _buckets(F.col(ls) - t, F.col(le) + t, width))))
    tried = told.join(b.select("_k", "_c", rs, re_, F.lit(True).alias("_hit")), on, "left")
    rest = tried.groupBy("_row").agg(F.first(F.struct(*left.columns)).alias("_of"), F.max("_hit").alias("_hit")).filter("_hit is null").select("_of.*")
    if how == "anti":
        return rest
    return a.join(b, on).drop("_b", "_c", "_k").unionByName(rest, allowMissingColumns=True)


def gap_islands(df: DataFrame, key: str, ts: str, gap: float, same: str | None = None) -> DataFrame:
    """``(key, island, start, end, n)``: runs of rows of a key whose steps are at most ``gap``, and equal in ``same``.

    A key's rows are ordered in one task, with spilling; keys must be of bounded size, as media are.
    """
    w = Window.partitionBy(key).orderBy(ts)
    new = (F.col(ts) - F.lag(ts).over(w) > gap) | F.lag(ts).over(w).isNull()
    if same:
        new = new | ~F.col(same).eqNullSafe(F.lag(same).over(w))
    marked = df.filter(F.col(ts).isNotNull()).withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of characters to be changed, put in or dropped, of the longer text; case aside."""
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def merge_observations(df: DataFrame, key: str, ts: str, text: str, gap: float = 30.0, similarity: float = 0.70, frame: str | None = None, confidence: str | None = None) -> DataFrame:
    """``(key, start, end, text, n)`` of runs of observations of a key in the order of time, and of their frames.

    A run goes on while the next observation comes within the gap and its text is like the one before it; its text is
    the longest, of equally long ones the first. With ``frame`` (an integer) the first and last frame, with
    ``confidence`` the greatest one come with it. Observations at the same time follow their frames, then their texts; blank
    texts and null times drop out. A key's observations are ordered by a window, which spills.
    """
    extra = [F.col(frame).cast("long").alias("frame")] if frame else [F.lit(0).cast("long").alias("frame")]
    sure = F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("double").alias("ts"), squeezed(F.col(text)).alias("text"), *extra, sure.alias("sure")).filter("ts is not null and text <> ''")
    w = Window.partitionBy("key").orderBy("ts", "frame", "text")
    last_ts, last_text = F.lag("ts").over(w), F.lag("text").over(w)
    parts = last_ts.isNull() | (F.col("ts") - last_ts > gap) | (likeness(F.col("text"), last_text) < similarity)
    runs = rows.withColumn("parts", parts.cast("int")).withColumn("run", F.sum("parts").over(w))
    longest = F.min(F.struct((-F.length("text")).alias("l"), "ts", "frame", "text"))["text"]
    of = runs.groupBy("key", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), longest.alias("text"), F.count(F.lit(1)).cast("int").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("sure").alias("confidence"))
    return of.select("key", "start", "end", "text", "n", *(["first_frame", "last_frame"] if frame else []), *(["confidence"] if confidence else []))


def sliding_means(df: DataFrame, key: str, ts: str, value: str, width: float, stride: float) -> DataFrame:
    """``(key, window_start, n, mean)`` of overlapping windows [start, start + width) at multiples of the stride."""
    starts = F.sequence((F.floor((F.col(ts) - width) / stride) + 1).cast("long"), F.floor(F.col(ts) / stride).cast("long"))
    rows = df.filter(F.col(ts).isNotNull()).select(key, F.col(value).alias("_v"), F.explode(starts).alias("_i"))
    return rows.groupBy(key, "_i").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean")).select(key, (F.col("_i") * stride).alias("window_start"), "n", "mean")


def sampled(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """At most ``k`` rows of a key at even places, its first and last among them."""
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    numbered = df.withColumn("_i", i).withColumn("_n", n)
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return numbered.filter((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def box_info(box: Column) -> Column:
    """Extent of a box of points, ``array<array<double>>``."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"), ((left + right) / 2).alias("cx"), ((top + bottom) / 2).alias("cy"), (bottom - top).alias("height"))


def group_boxes(df: DataFrame, key: str, text: str, left: str, right: str, top: str, bottom: str) -> DataFrame:
    """Boxes of one key put together to lines: overlap in height of a third, gaps up to two and a half heights; nearest first."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []
        for r in pdf.sort_values(["t", "l"]).itertuples(index=False):
            best = None
            for line in lines:
                last = line[-1]
                over = min(r.b, last.b) - max(r.t, last.t)
                heights = (r.b - r.t, last.b - last.t)
                gap = r.l - last.r
                if over >= 0.35 * min(heights) and -max(heights) <= gap <= 2.5 * sum(heights) / 2:
                    d = abs((r.t + r.b) - (last.t + last.b))
                    if best is None or d < best[0]:
                        best = (d, line)
            best[1].append(r) if best else lines.append([r])
        out = [(pdf["key"].iloc[0], i, " ".join(x.text for x in line), min(x.l for x in line), max(x.r for x in line), min(x.t for x in line), max(x.b for x in line)) for i, line in enumerate(lines)]
        return pd.DataFrame(out, columns=["key", "line", "text", "left", "right", "top", "bottom"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).cast("double").alias(a) for c, a in ((left, "l"), (right, "r"), (top, "t"), (bottom, "b")))).dropna()
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandas(one, f"key {kind}, line int, text string, left double, right double, top double, bottom double")
