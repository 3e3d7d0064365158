"""Streams of media events: keyed merge of similar observations, interval join, session counts.

Late rows: those behind the watermark are dropped; the batch operators have no such rule, so results agree on streams
whose rows are not later than the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, start double, end double, text string, n int"
STATE = "ts array<double>, text array<string>"


def likeness(a: str, b: str) -> float:
    """That of the batch operator."""
    x, y = a.lower(), b.lower()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, above = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (c != d)))
    return 1 - row[-1] / max(len(x), len(y), 1)


def runs_of(rows: list[tuple[float, str]], gap: float, similarity: float) -> list[tuple[float, float, str, int]]:
    """``(start, end, text, n)`` of the runs of observations in order of time, as the batch operator has them."""
    said = sorted((ts, t) for ts, text in rows if (t := " ".join((text or "").split())))
    ends = [i for i, (a, b) in enumerate(pairwise(said), 1) if b[0] - a[0] > gap or likeness(a[1], b[1]) < similarity]
    parts = [said[i:j] for i, j in pairwise([0, *ends, len(said)]) if i < j]
    return [(p[0][0], p[-1][0], max((t for _, t in p), key=len), len(p)) for p in parts]


def merge_observations(stream: DataFrame, key: str, at: str, text: str, gap: float = 30.0, similarity: float = 0.70, delay: str = "60 seconds") -> DataFrame:
    """The gap merge of a stream: runs are given out once the watermark has passed their end and the gap.

    A key's state are its open rows, in order of time, bounded by the rows within the delay and the gap.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get)) if state.exists else []
        for b in batches:
            rows += list(zip(b["ts"], b["text"]))
        rows.sort(key=lambda r: r[0])
        mark = state.getCurrentWatermarkMs() / 1000
        runs = runs_of(rows, gap, similarity)
        # a run is closed when no row in time can join it any more
        done = [r for r in runs if state.hasTimedOut or r[1] + gap < mark]
        end = max((r[1] for r in done), default=None)
        rest = [r for r in rows if end is None or r[0] > end]
        if rest and not state.hasTimedOut:
            state.update(([r[0] for r in rest], [r[1] for r in rest]))
            state.setTimeoutTimestamp(int(max(max(r[0] for r in rest) + gap, mark) * 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(str(k[0]), *r) for r in done], columns=["key", "start", "end", "text", "n"])

    rows = stream.withWatermark(at, delay).select(F.col(key).cast("string").alias("key"), F.col(at).cast("double").alias("ts"), F.col(text).alias("text"), F.col(at).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, seconds: int, delay: str = "60 seconds") -> DataFrame:
    """Rows of two streams with the same key and times at most ``seconds`` apart; watermarks bound the state of both."""
    a = left.withWatermark(left_at, delay)
    b = right.withWatermark(right_at, delay).withColumnRenamed(key, f"{key}_right")
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    near = (F.col(right_at) >= F.col(left_at) - span) & (F.col(right_at) <= F.col(left_at) + span)
    return a.join(b, (F.col(key) == F.col(f"{key}_right")) & near).drop(f"{key}_right")


def session_counts(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows of each key's sessions, those parted by more than the gap."""
    agg = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def staged_progress(lines: DataFrame, text: str, stages: list[tuple[str, str]]) -> DataFrame:
    """Each line with the first stage whose pattern it matches, null if none; works on streams and tables."""
    stage = F.lit(None).cast("string")
    for pattern, name in reversed(stages):
        stage = F.when(F.col(text).rlike(pattern), F.lit(name)).otherwise(stage)
    return lines.withColumn("stage", stage)
