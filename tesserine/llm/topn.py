"""The N best rows of every group by partition lower bounds.

Each partition finds, in one pass over its Arrow batches, the N best rows it holds of each group and its N-th best
order key. That key is a lower bound of the group's N-th best, as N rows at least as good exist. For groups that reach
many partitions the greatest bound is joined to the survivors, and those below it are dropped before anything of them
is shuffled for the ranking; groups in few partitions have no more survivors than a bound would leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.skew import keyed_join
from tesserine.session import written

_COMPACT_ROWS = 1 << 17
#: Groups get a bound where they have more survivors than so many partitions leave.
WIDE = 4


def _best(t: pa.Table, groups: list[str], n: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The n best rows of each group, and the score and tie of the n-th where there are n."""
    code = np.zeros(t.num_rows, np.int64)
    for g in groups:
        d = t.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    score, tie = t.column("_score").to_numpy(), t.column("_tie").to_numpy()
    nan = np.isnan(score)
    order = np.lexsort((tie, -np.where(nan, 0.0, score), ~nan, code))
    code = code[order]
    start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(code)])
    rank = np.arange(len(code)) - np.repeat(start, length)
    keep = rank < n
    nth = np.repeat(np.where(length >= n, start + n - 1, -1), length)[keep]
    kept = order[keep]
    return t.take(pa.array(kept)), np.where(nth >= 0, order[nth], -1), kept


def _survivors(groups: list[str], n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        state: pa.Table | None = None

        def fold() -> pa.Table:
            return _best(pa.concat_tables([*([state] if state is not None else []), pa.Table.from_batches(held)]), groups, n)[0]

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= max(_COMPACT_ROWS, 2 * (state.num_rows if state is not None else 0)):
                state, held, rows = fold(), [], 0
        if held:
            state = fold()
        if state is None or not state.num_rows:
            return
        full = state
        best, nth, _ = _best(full, groups, n)
        score, tie = full.column("_score").to_numpy(), full.column("_tie").to_numpy()
        none = nth < 0
        best = best.append_column("_bound_score", pa.array(score[nth], mask=none)).append_column("_bound_tie", pa.array(tie[nth], mask=none))
        yield from best.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def top_n_per_group(df: DataFrame, groups: list[str], score: str, tie: str, n: int = 3) -> DataFrame:
    """The ``n`` rows of greatest ``score`` of each group as ``(*groups, tie, score, rank)``.

    Order: score descending, NaN above all numbers, -0.0 equal to 0.0; of equal scores the smaller ``tie`` (an integer
    column) first. Rows with a null group, score or tie don't count. Repeated rows each take a place. Groups with fewer
    than ``n`` rows come whole; an empty table gives no row. Other columns, whatever their names, are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [f"_g{i}" for i in range(len(groups))]
    slim = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), (F.col(score).cast("double") + F.lit(0.0)).alias("_score"), F.col(tie).cast("long").alias("_tie"))
    for c in slim.columns:  # dropna would drop NaN too
        slim = slim.filter(F.col(c).isNotNull())
    schema = T.StructType([*slim.schema.fields, T.StructField("_bound_score", T.DoubleType()), T.StructField("_bound_tie", T.LongType())])
    local = written(slim.mapInArrow(_survivors(keys, n), schema), "survivors")
    # ~tie falls as the tie rises and can't overflow
    bound = F.max(F.when(F.col("_bound_score").isNotNull(), F.struct("_bound_score", F.bitwise_not("_bound_tie").alias("t"))))
    wide = local.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), bound.alias("_bound")).filter((F.col("_rows") > WIDE * n) & F.col("_bound").isNotNull())
    bounds = written(wide, "bounds")
    alive = keyed_join(local, bounds, keys, "_rows", F.col("_tie"), how="left").filter(F.col("_bound").isNull() | (F.struct("_score", F.bitwise_not("_tie")) >= F.struct("_bound._bound_score", "_bound.t")))
    by = Window.partitionBy(*keys)
    ranked = alive.withColumn("rank", F.row_number().over(by.orderBy(F.desc("_score"), "_tie"))).filter(F.col("rank") <= n)
    return ranked.select(*(F.col(k).alias(g) for g, k in zip(groups, keys)), F.col("_tie").alias(tie), F.col("_score").alias(score), "rank")
