"""Evaluation of scores against labels: confusion, sweeps, calibration, bands, rank statistics, ensembles.

Input ``(y int, p double)`` and grouping columns; rows with a null in either don't count. Sweeps count scores in cells
between the thresholds first and cumulate over the cells, so the rows are read once whatever the number of thresholds.
Empty denominators give null, those of precision, recall and F1 give 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 100


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def bundle(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    def or0(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    pr, rc = or0(_ratio(tp, tp + fp)), or0(_ratio(tp, tp + fn))
    f1, f0 = or0(_ratio(2 * tp, 2 * tp + fp + fn)), or0(_ratio(2 * tn, 2 * tn + fp + fn))
    return [
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"),
        _ratio(fp, tn + fp).alias("fpr"), _ratio(fn, tp + fn).alias("fnr"), ((_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    ]


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None, band: tuple[float, float] | None = None) -> DataFrame:
    """Counts and rates at a threshold; scores strictly inside the band are uncertain and don't count as decided."""
    rows = df.filter("y is not null and p is not null").withColumn("u", (F.col("p") > band[0]) & (F.col("p") < band[1]) if band else F.lit(False))
    hit, pos, ok = F.col("p") >= threshold, F.col("y") == 1, ~F.col("u")
    agg = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("u").alias("n_uncertain"), F.count_if(ok & hit & pos).alias("tp"), F.count_if(ok & hit & ~pos).alias("fp"), F.count_if(ok & ~hit & ~pos).alias("tn"), F.count_if(ok & ~hit & pos).alias("fn")
    )
    c = F.col
    return agg.select("*", *bundle(c("tp"), c("fp"), c("tn"), c("fn")))


def threshold_sweep(df: DataFrame, steps: int = STEPS) -> DataFrame:
    """Counts and rates at each threshold i / steps, from 0 to 1."""
    cell = F.least(F.lit(steps + 1), F.floor(F.col("p") * steps + 1e-9) + 1).cast("int")
    rows = df.filter("y is not null and p is not null").groupBy(cell.alias("c")).agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") != 1).alias("b"))
    grid = df.sparkSession.range(steps + 1).select((F.col("id") + 1).cast("int").alias("c"))
    # as many rows as thresholds
    w = Window.partitionBy(F.lit(0)).orderBy("c")
    cells = grid.join(F.broadcast(rows), "c", "left").na.fill(0).withColumn("ta", F.sum("a").over(Window.partitionBy(F.lit(0)))).withColumn("tb", F.sum("b").over(Window.partitionBy(F.lit(0)))).withColumn("below_a", F.sum("a").over(w) - F.col("a")).withColumn("below_b", F.sum("b").over(w) - F.col("b"))
    x = cells.select(((F.col("c") - 1) / steps).alias("threshold"), (F.col("ta") - F.col("below_a")).alias("tp"), (F.col("tb") - F.col("below_b")).alias("fp"), F.col("below_b").alias("tn"), F.col("below_a").alias("fn"))
    c = F.col
    return x.select("*", *bundle(c("tp"), c("fp"), c("tn"), c("fn")))


def best_threshold(df: DataFrame, metric: str = "macro_f1", steps: int = STEPS) -> DataFrame:
    """The threshold of greatest metric, the smallest of equal ones; none without rows."""
    s = threshold_sweep(df, steps).filter(F.col(metric).isNotNull() & (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") > 0))
    return s.orderBy(F.desc(F.round(metric, 12)), "threshold").limit(1)


def locked(fit: DataFrame, apply: DataFrame, by: list[str] | None = None, metric: str = "macro_f1", steps: int = STEPS) -> DataFrame:
    """The threshold that is best on ``fit``, and counts and rates of ``apply`` at it; nothing of ``apply`` has a part in its choice.

    The threshold is one row, the only one that is collected. Without a row to fit it is null and there is no result.
    """
    chosen = best_threshold(fit, metric, steps).select("threshold").first()
    if chosen is None:
        return confusion(apply.limit(0), 0.0, by).filter(F.lit(False)).withColumn("threshold", F.lit(None).cast("double"))
    # scores fall into the cells of the sweep
    return confusion(apply.withColumn("p", F.floor(F.col("p") * steps + 1e-9) / steps), chosen[0], by).withColumn("threshold", F.lit(chosen[0]))


def reliability_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Bins closed on the right, the first on both sides: number, mean score and share of positives; empty ones with nulls."""
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(F.col("p") * bins - 1e-9))).cast("int")
    agg = df.filter("y is not null and p is not null").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("observed_rate"))
    return df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(agg), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    r = reliability_bins(df, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("observed_rate") - F.col("mean_predicted"))) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def auc(df: DataFrame, by: list[str] | None = None, cells: int = 1024) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at half; null without both classes.

    Rows are counted by distinct score first. Those counts are ordered within cells of scores, and the cells, of which
    there are 1,025 at most for each group, among each other, so no task orders all scores of a group.
    """
    by = by or []
    cell = F.greatest(F.lit(0), F.least(F.lit(cells), F.floor(F.col("p") * cells))).cast("int")
    pos = df.filter("y is not null and p is not null").groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).cast("double").alias("a"), F.count_if(F.col("y") != 1).cast("double").alias("b")).withColumn("cell", cell)
    of_cells = Window.partitionBy(*(by or [F.lit(0)])).orderBy("cell")
    offsets = pos.groupBy(*by, "cell").agg(F.sum("b").alias("b")).select(*by, "cell", (F.sum("b").over(of_cells) - F.col("b")).alias("offset"))
    w = Window.partitionBy(*by, "cell").orderBy("p")
    inside = pos.withColumn("below", F.sum("b").over(w) - F.col("b"))
    keys = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*by, "cell")]
    joined = inside.alias("_l").join(offsets.alias("_r"), keys).select(*(F.col(f"_l.{c}").alias(c) for c in (*by, "a", "b", "below")), "offset")
    u = joined.withColumn("u", F.col("a") * (F.col("offset") + F.col("below") + F.col("b") / 2))
    return u.groupBy(*by).agg(F.try_divide(F.sum("u"), F.sum("a") * F.sum("b")).alias("auc"), F.sum("a").alias("n_pos"), F.sum("b").alias("n_neg"))


def uncertainty_bands(df: DataFrame, threshold: float = 0.5, widths: int = 40, most_uncertain: float = 0.30) -> DataFrame:
    """Of bands ``threshold ± i / 100`` the narrowest of best accuracy among those decided, at most so many uncertain."""
    cell = F.floor(F.abs(F.col("p") - threshold) * 100 + 1e-9).cast("int")
    right = (F.col("p") >= threshold) == (F.col("y") == 1)
    rows = df.filter("y is not null and p is not null").groupBy(F.least(F.lit(widths), cell).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("ok"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("c"))
    grid = df.sparkSession.range(widths + 1).select(F.col("id").cast("int").alias("c")).join(F.broadcast(rows), "c", "left").na.fill(0)
    x = grid.withColumn("n_decided", F.sum("n").over(w)).withColumn("n_right", F.sum("ok").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    x = x.select((F.col("c") / 100).alias("width"), "n_decided", _ratio(F.col("n_right"), F.col("n_decided")).alias("accuracy"), (1 - _ratio(F.col("n_decided"), F.col("total"))).alias("uncertain_rate"))
    return x.filter((F.col("uncertain_rate") <= most_uncertain) & F.col("accuracy").isNotNull()).orderBy(F.desc("accuracy"), "width").limit(1)


def temperature(df: DataFrame, grid: list[float]) -> DataFrame:
    """The temperature of the grid with the least mean negative log-likelihood; the grid is short and goes with each row."""
    from tesserine.functions.scores import calibrated

    rows = df.filter("y is not null and p is not null").select("y", "p", F.explode(F.array(*(F.lit(float(t)) for t in grid))).alias("t"))
    q = calibrated(F.col("p"), F.col("t"))
    nll = rows.groupBy("t").agg(F.avg(-F.log(F.when(F.col("y") == 1, q).otherwise(1 - q))).alias("nll"))
    return nll.orderBy(F.round("nll", 12), "t").limit(1)


def ensemble(scores: DataFrame, n_models: int) -> DataFrame:
    """Mean and share of votes of ids that all models scored, of ``(model, id, p)``."""
    g = scores.groupBy("id").agg(F.countDistinct("model").alias("m"), F.avg("p").alias("p_mean"), F.avg((F.col("p") >= 0.5).cast("double")).alias("p_vote"))
    return g.filter(F.col("m") == n_models).drop("m")


def paired_bootstrap(df: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """``(mean, p_b_better, low, high)`` of the gain in accuracy of B over A, of ``(id, a, b)`` as 0 or 1.

    Poisson resampling: each row counts in each round by a draw of mean one from a hash of id, round and seed, so
    rounds are sums with map-side combining and the same on any partitioning.
    """
    u = (F.pmod(F.xxhash64("id", "r", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cdf, draw, p, total = [], F.lit(8), 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cdf.append((k, total))
        p /= k + 1
    for k, top in reversed(cdf):
        draw = F.when(u <= top, F.lit(k)).otherwise(draw)
    x = df.select("id", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("w", draw)
    per = x.groupBy("r").agg((F.sum(F.col("w") * (F.col("b") - F.col("a"))) / F.sum("w")).alias("d"))
    return per.agg(F.avg("d").alias("mean"), F.avg((F.col("d") > 0).cast("double")).alias("p_b_better"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
