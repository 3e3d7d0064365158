"""Nearest vectors by cosine, of a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the vectors of one block of rows, and of queries.
BLOCK_BYTES = 32 << 20
DECIMALS = 6


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for x in b.column(1).to_pylist():
            v = np.asarray(x, np.float64)
            n = np.linalg.norm(v)
            out.append((v / n if n > 0 else v).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])


def _scored(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        # by id, so that of equal values the smaller id is found first
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        matrix = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(rows.num_rows, -1)[order]
        asked = queries.column("id").to_numpy()
        other = np.frombuffer(b"".join(queries.column("v").to_pylist()), np.float64).reshape(queries.num_rows, -1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, BLOCK_BYTES // (8 * len(ids)))
        for at in range(0, len(asked), step):
            s = np.round(other[at : at + step] @ matrix.T, DECIMALS)
            s[asked[at : at + step, None] == ids[None, :]] = -np.inf
            # the least value among the k best, and all rows that reach it
            n = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            for q, row, least_of in zip(asked[at : at + step], s, least):
                good = np.flatnonzero((row >= least_of) & np.isfinite(row))
                good = good[np.argsort(-row[good], kind="stable")][:k]
                found.append((np.full(len(good), q), ids[good], row[good]))
        return pa.Table.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], schema=schema)

    return run


def cosine_top(df: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, id, cosine, rank)``: the ``k`` rows nearest to each query, without itself; ties to the smaller id.

    Vectors are brought to unit length once. Rows and queries are put into blocks by the hash of their ids, of so many
    bytes each as ``BLOCK_BYTES``; each block of rows meets each block of queries in one task, as a product of
    matrices, which gives ``k`` rows a query. Only these are ranked. Null vectors have no part, vectors of zeros have a
    cosine of 0; all vectors have one length; an empty side gives no row.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    sizes = [x.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)) * 8).first()[0] for x in (rows, asked)]
    # a core at least for each of the session's, as far as there is work for it
    n_rows = max(-(-sizes[0] // BLOCK_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, -(-sizes[0] // (1 << 18))), 1)
    n_asked = max(-(-sizes[1] // BLOCK_BYTES), 1)
    unit = [x.mapInArrow(_unit, "id long, v binary") for x in (rows, asked)]

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    a = unit[0].withColumn("r", block(n_rows)).withColumn("c", every(n_asked))
    b = unit[1].withColumn("c", block(n_asked)).withColumn("r", every(n_rows))
    near = a.groupBy("r", "c").cogroup(b.groupBy("r", "c")).applyInArrow(_scored(k), "query_id long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "cosine", "rank")
