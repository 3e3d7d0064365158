"""Texts cut into passages under a budget of words, and windows of neighbouring passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_WORDS = 6
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def pack(text: str, budget: int) -> list[str]:
    """Paragraphs, then sentences, then words, each packed up to the budget; passages of fewer than six words drop out."""
    out: list[str] = []

    def add(parts: list[str], join: str, deeper: int) -> None:
        held: list[str] = []
        n = 0
        for p in parts:
            size = len(p.split())
            if size > budget:
                if held:
                    out.append(join.join(held))
                    held, n = [], 0
                if deeper == 1:
                    add([s for s in _SENTENCE.split(p) if s.strip()], " ", 2)
                else:
                    words = p.split()
                    out.extend(" ".join(words[i : i + budget]) for i in range(0, len(words), budget))
                continue
            if n + size > budget and held:
                out.append(join.join(held))
                held, n = [], 0
            held.append(p.strip())
            n += size
        if held:
            out.append(join.join(held))

    for paragraph in re.split(r"\n\s*\n", text):
        if paragraph.strip():
            add([paragraph.strip()], "\n", 1)
    return [p for p in out if len(p.split()) >= LEAST_WORDS]


def chunks(df: DataFrame, id_col: str, text: str, budget: int = 220) -> DataFrame:
    """``(id, pos, chunk, n_words)`` of each text; null and empty ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p, c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p, c in enumerate(pack(t, budget))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2].split()) for r in rows], pa.int32())], names=["id", "pos", "chunk", "n_words"])

    return df.filter(F.length(text) > 0).select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "id long, pos int, chunk string, n_words int")


def context_windows(passages: DataFrame, key: str, pos: str, text: str, size: int = 3) -> DataFrame:
    """Each passage with up to ``size - 1`` following ones of its text, joined; windows of one passage drop out."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(0, size - 1)
    x = passages.select(key, pos, F.collect_list(text).over(w).alias("_w"))
    return x.filter(F.size("_w") > 1).select(key, pos, F.size("_w").alias("n"), F.array_join("_w", "\n").alias("window"))
