"""Lines repeated within one source, and texts put together again without given lines.

The lines of each source are counted by their letters; the rows of the source with a line are compared with the rows of
all other sources by the log-likelihood ratio, with false-discovery control over all lines of all sources.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.skew import keyed_join
from tesserine.session import spread, written

MIN_ROWS = 8
FDR = 0.01
#: p-values are counted in bins of this width in -log10 p, up to the greatest.
BIN, BINS = 0.05, 6400


def letters(line: Column) -> Column:
    """Unicode letters of a line in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _keyed_lines(df: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    """``(id, line_no, h1, h2, g1, g2)``: 128 bits of source and letters, and of the letters alone; lines with letters."""
    rows = spread(df.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("s"), F.col(text).alias("t")))
    lines = rows.select("id", "s", F.posexplode(F.split("t", "\n")).alias("p", "line"))
    keyed = lines.select("id", (F.col("p") + 1).alias("line_no"), "s", letters(F.col("line")).alias("k")).filter("k <> ''")
    return keyed.select("id", "line_no", F.xxhash64("s", "k").alias("h1"), F.xxhash64("k", F.lit(7), "s").alias("h2"), "k", "s")


def line_counts(df: DataFrame, id_col: str, source: str, text: str, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(lines, repeated)``: all lines with letters as ``(id, line_no, h1, h2)``; of those in ``min_rows`` rows of a source
    ``(h1, h2, n)``. A line twice in one row counts once."""
    lines = written(_keyed_lines(df, id_col, source, text).select("id", "line_no", "h1", "h2"), "lines")
    counted = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    # most lines stand once: only keys that reach the number by places are counted by rows
    places = written(counted, "places")
    rows = keyed_join(lines, places, ["h1", "h2"], "n", F.col("id"), row_bytes=32).groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return lines, written(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows), "repeated")


def repeated_lines(df: DataFrame, id_col: str, source: str, text: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """``(id, line_no)`` of each line whose letters stand in at least ``min_rows`` rows of the same source.

    Rows with a null source or text and lines without letters have no part in it; rows repeated under one id count once;
    an empty table gives no row. The lines are counted with map-side combining, so a line that a third of all rows
    share costs one row a task; they are found again by a broadcast of checked size or a salted join.
    """
    lines, repeated = line_counts(df, id_col, source, text, min_rows)
    # rows repeated under one id give a line once
    return keyed_join(lines, repeated, ["h1", "h2"], "n", F.col("id"), row_bytes=32).select("id", "line_no").distinct()


def _log10_p(g: pd.Series) -> pd.Series:
    """-log10 of the p-value of a log-likelihood ratio, one degree of freedom."""

    def one(x: float) -> float:
        p = math.erfc(math.sqrt(max(x, 0.0) / 2))
        if p > 1e-290:
            return -math.log10(p) + 0.0
        return (x / 2 + math.log(math.sqrt(math.pi * x / 2))) / math.log(10)

    return g.map(one)


def excess_lines(df: DataFrame, id_col: str, source: str, text: str, min_rows: int = MIN_ROWS, fdr: float = FDR) -> DataFrame:
    """``(source, letters, n_rows, n_outside, llr, q, excess)`` of each line in at least ``min_rows`` rows of a source.

    ``llr`` compares its share of the rows within the source with that outside; ``q`` is the Benjamini-Hochberg level
    over all lines of all sources, from p-values counted in bins: lines in fewer rows are tests too, of which none is
    taken to be more significant. ``excess``: more frequent within and ``q`` at most ``fdr``. Lines are counted and
    joined by hashes; the letters of those that come out are read from the texts once more. Rows with a null source or text have no part;
    rows repeated under one id count once; an empty table gives no row.
    """
    keyed = _keyed_lines(df, id_col, source, text).select("id", F.xxhash64("s").alias("s"), F.xxhash64("k").alias("k"), "h1", "h2")
    within = written(keyed.distinct().groupBy("h1", "h2", "s", "k").agg(F.count(F.lit(1)).alias("a")), "within")
    everywhere = written(within.groupBy("k").agg(F.sum("a").alias("t"), F.count(F.lit(1)).alias("sources")), "everywhere")
    sizes = df.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).groupBy(F.xxhash64(F.col(source).cast("string")).alias("s")).agg(F.countDistinct(id_col).alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    tests = within.count()
    often = within.filter(F.col("a") >= min_rows)
    sized = keyed_join(often, written(sizes, "sizes"), ["s"], "m", F.col("k"), row_bytes=24)
    x = keyed_join(sized, everywhere, ["k"], "sources", F.col("s"), row_bytes=32).withColumn("b", F.col("t") - F.col("a")).withColumn("o", F.lit(total) - F.col("m"))

    def part(seen: Column, of: Column, rate: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (of * rate))).otherwise(0.0)

    rate = F.col("t") / F.lit(float(max(total, 1)))
    g = 2 * (part(F.col("a"), F.col("m"), rate) + part(F.col("b"), F.col("o"), rate) + part(F.col("m") - F.col("a"), F.col("m"), 1 - rate) + part(F.col("o") - F.col("b"), F.col("o"), 1 - rate))
    scored = written(x.withColumn("llr", F.greatest(g, F.lit(0.0))).withColumn("lp", F.pandas_udf(_log10_p, "double")("llr")).withColumn("bin", F.least(F.floor(F.col("lp") / BIN), F.lit(BINS)).cast("int")), "scored")
    # one row a bin, of which there are BINS at most, so the windows without groups are small
    bins = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("in_bin"))
    above = bins.withColumn("n_above", F.sum("in_bin").over(Window.orderBy(F.desc("bin"))))
    raw = F.least(F.lit(1.0), F.pow(F.lit(10.0), -F.col("bin") * BIN) * float(max(tests, 1)) / F.col("n_above"))
    # the least of the levels of all p-values that are as great or greater
    level = above.withColumn("q", F.min(raw).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).select("bin", "q")
    more = F.col("a") * F.col("o") > F.col("b") * F.col("m")
    judged = written(scored.join(F.broadcast(level), "bin").select("h1", "h2", "a", "b", "llr", "q", (more & (F.col("q") <= fdr)).alias("excess")), "judged_lines")
    words = keyed_join(_keyed_lines(df, id_col, source, text), judged, ["h1", "h2"], "a", F.col("id"), row_bytes=64)
    said = words.groupBy("h1", "h2").agg(F.first("s").alias("source"), F.first("k").alias("letters"), *(F.first(c).alias(c) for c in ("a", "b", "llr", "q", "excess")))
    return said.select("source", "letters", F.col("a").alias("n_rows"), F.col("b").alias("n_outside"), "llr", "q", "excess")


def without_lines(df: DataFrame, id_col: str, text: str, found: DataFrame, name: str = "clean") -> DataFrame:
    """``(id_col, name)``: each text without the lines ``(id, line_no)``, the others in their order; null stays null.

    Only ids of texts with such lines are joined; a text of which all lines go becomes empty.
    """
    gone = found.groupBy(F.col("id").alias("_of")).agg(F.collect_set("line_no").alias("_gone"))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    kept = F.filter(F.split("_text", "\n"), lambda _, i: ~F.array_contains("_gone", i + 1))
    joined = rows.join(gone, F.col("_id") == F.col("_of"), "left")
    return joined.select(F.col("_id").alias(id_col), F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias(name))
