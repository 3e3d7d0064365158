"""Held-out evaluation texts inside a corpus, by greedy string tiling.

Seeds, runs of three words, of the items are joined with those of the documents; for each document and item that share
seeds, the longest runs of equal words that don't overlap are marked again and again, found by rolling hashes of falling
length. Tiles inside one stretch that follow each other in both texts make up the coverage; items with enough of their
words in it are reported. The coverage without regard to order comes with them, for passages put in another order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.skew import BROADCAST_BYTES, keyed_join, salted_join
from tesserine.session import spread, written

SEED = 3
LEAST_TILE = 2
#: Least share of an item's words, with those that were changed or dropped between tiles.
COVERAGE = 0.5
#: So many words of the item in a row may be changed or dropped, or other words put in, between two tiles of a passage.
GAP_WORDS = 2
#: Stretches are tiled where they hold at least this share of an item's seeds: half of an item with every sixth word of it
#: changed keeps more.
DENSITY = 0.15
#: A stretch is at most so many times as long as the part of the item it covers, plus a few words.
STRETCH, STRETCH_WORDS = 1.6, 8

_WORDS = re.compile(r"[^\W_]+(?:[.,]\d+)*")
# What formatting puts between words: time codes of transcripts, links, tags, line hyphens, list and quote marks.
_FORMAT = re.compile(r"\[\d+:\d+(?::\d+)?\]|\]\([^()\s]*\)|</?[a-zA-Z][^<>]*>|­|[​-‍﻿]")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def words_of(text: str) -> list[str]:
    """Words in lower case without formatting; numbers without their separators."""
    out = _WORDS.findall(_FORMAT.sub(" ", text.lower()) if "[" in text or "<" in text or "­" in text or "​" in text else text.lower())
    return [w.replace(",", "").replace(".", "") if w[0].isdigit() else w for w in out]


def seed_hashes(words: list[str]) -> list[int]:
    h = xxhash.xxh64_intdigest
    return [h(" ".join(words[i : i + SEED])) - (1 << 63) for i in range(len(words) - SEED + 1)]


def _rolling(ids: list[int], n: int) -> Iterator[tuple[int, int]]:
    """``(start, hash)`` of each run of n words."""
    if len(ids) < n:
        return
    lead = pow(_BASE, n - 1, _MOD)
    h = 0
    for x in ids[:n]:
        h = (h * _BASE + x) % _MOD
    yield 0, h
    for i in range(n, len(ids)):
        h = ((h - ids[i - n] * lead) * _BASE + ids[i]) % _MOD
        yield i - n + 1, h


def tiles(a: list[str], b: list[str], least: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in a, start in b, words)`` of the longest equal runs, marked without overlap.

    Runs are sought by rolling hashes of a length that halves, and extended as far as they go; the longest one is always
    marked first, of equal ones that with the smaller starts. What is left of a run that was marked in part waits for
    its turn, so the order is that of greedy tiling word by word.
    """
    number: dict[str, int] = {}
    x, y = ([number.setdefault(w, len(number) + 1) for w in t] for t in (a, b))
    free_a, free_b = [True] * len(x), [True] * len(y)
    out: list[tuple[int, int, int]] = []
    size = least
    while size * 2 <= min(len(x), len(y)):
        size *= 2
    while size >= least:
        at = defaultdict(list)
        for i, h in _rolling(x, size):
            if all(free_a[i : i + size]):
                at[h].append(i)
        runs: list[tuple[int, int, int]] = []
        for j, h in _rolling(y, size) if at else ():
            if h not in at or not all(free_b[j : j + size]):
                continue
            for i in at[h]:
                # a run that goes on to the left was found from there
                if i and j and x[i - 1] == y[j - 1] and free_a[i - 1] and free_b[j - 1]:
                    continue
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= size:
                    runs.append((-n, i, j))
        heapify(runs)
        while runs:
            n, i, j = heappop(runs)
            from_ = 0
            rest = []
            for k in range(-n + 1):
                if k == -n or not (free_a[i + k] and free_b[j + k]):
                    if k - from_ >= size:
                        rest.append((from_ - k, i + from_, j + from_))
                    from_ = k + 1
            if rest == [(n, i, j)]:
                free_a[i : i - n] = [False] * -n
                free_b[j : j - n] = [False] * -n
                out.append((i, j, -n))
            else:
                for r in rest:
                    heappush(runs, r)
        size = size // 2 if size > least else 0
    return out


def dense(spots: list[tuple[int, int]], span: int, need: int) -> list[tuple[int, int]]:
    """Stretches ``(first, last place)`` of at most ``span`` words with ``need`` different seeds, those that overlap made one."""
    out: list[tuple[int, int]] = []
    held: dict[int, int] = defaultdict(int)
    i = different = 0
    for p, h in spots:
        different += not held[h]
        held[h] += 1
        while spots[i][0] < p - span:
            held[spots[i][1]] -= 1
            different -= not held[spots[i][1]]
            i += 1
        if different >= need:
            if out and spots[i][0] <= out[-1][1]:
                out[-1] = (out[-1][0], p)
            else:
                out.append((spots[i][0], p))
    return out


def _bridged(item_gap: int, doc_gap: int) -> int:
    """Words of the item between two tiles that count as held, as they were but changed or dropped."""
    return item_gap if item_gap <= GAP_WORDS and doc_gap <= GAP_WORDS else 0


def coverage(item: list[str], doc: list[str], spots: list[tuple[int, int]]) -> tuple[float, float]:
    """Share of the item's words in tiles that are in order within one stretch of the document, and in tiles at all.

    ``spots``: places of shared seeds in the document, ascending, with their hashes; each dense stretch is tiled for itself.
    """
    m = len(item)
    span = int(STRETCH * m) + STRETCH_WORDS
    best = loose = 0.0
    for first, last in dense(spots, span, _least_seeds(m)):
        from_, to = max(0, first - m // 2), min(len(doc), last + SEED + m // 2)
        ts = sorted(tiles(item, doc[from_:to]), key=lambda t: t[1])
        loose = max(loose, sum(t[2] for t in ts) / m)
        # the best chain of tiles in order whose stretch isn't too long for the part of the item it covers
        for s in range(len(ts)):
            chain: list[tuple[int, int, int, int]] = []  # weight, end in item, end in document, start in item
            for i, j, n in ts[s:]:
                before = max(((c[0] + _bridged(i - c[1], j - c[2]), c[3]) for c in chain if c[1] <= i), default=None)
                if chain and before is None:
                    continue
                w, from_item = (n + before[0], before[1]) if before else (n, i)
                chain.append((w, i + n, j + n, from_item))
                if j + n - ts[s][1] <= STRETCH * max(i + n - from_item, w) + STRETCH_WORDS:
                    best = max(best, w / m)
    return best, loose


def _index(items: list[tuple[int, list[str]]]) -> dict[int, list[int]]:
    at: dict[int, list[int]] = defaultdict(list)
    for k, (_, words) in enumerate(items):
        for h in set(seed_hashes(words)):
            at[h].append(k)
    return at


def _matches(doc: list[str], items: list[tuple[int, list[str]]], at: dict[int, list[int]]) -> list[tuple[int, float, float]]:
    shared: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, h in enumerate(seed_hashes(doc)):
        if h in at:
            for k in at[h]:
                shared[k].append((p, h))
    out = []
    for k, spots in shared.items():
        item_id, words = items[k]
        best, loose = coverage(words, doc, spots)
        if best >= COVERAGE:
            out.append((item_id, best, loose))
    return out


def leaks(documents: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, item_id, coverage, loose)`` of each document that holds at least half of an item's words.

    The words must stand in the item's order within one stretch; up to two of the item's words in a row between two
    tiles count as held, as they were changed or dropped, more don't. Null, empty and blank texts hold and are nothing; items of fewer than three words are found only
    whole, as one seed of all their words. Repeated documents come out once for each id. Items go to all executors while their
    size, which is counted, stays under ``broadcast_bytes``; beyond that seeds of both sides are joined by a shuffle.
    Whole texts are read.
    """
    spark = documents.sparkSession
    docs = documents.filter(F.length(text) > 0).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    its = items.filter(F.length(text) > 0).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    size = its.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([(r[0], w) for r in its.collect() if (w := words_of(r[1]))])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pool = held.value
            at = _index(pool)
            short = defaultdict(list)
            for k, (_, w) in enumerate(pool):
                if len(w) < SEED:
                    short[w[0]].append(k)
            for b in batches:
                rows = []
                for d, t in zip(*(c.to_pylist() for c in b.columns)):
                    doc = words_of(t)
                    rows += [(d, *m) for m in _matches(doc, pool, at)]
                    if short:
                        rows += [(d, pool[k][0], 1.0, 1.0) for k in {k for p, w in enumerate(doc) for k in short.get(w, ()) if doc[p : p + len(pool[k][1])] == pool[k][1]}]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())], names=["doc_id", "item_id", "coverage", "loose"])

        found = spread(docs).mapInArrow(scan, "doc_id long, item_id long, coverage double, loose double")
    else:
        found = _by_seeds(docs, its)
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("loose").alias("loose"))


def _least_seeds(m: int) -> int:
    """Different seeds that a stretch must share with an item of m words."""
    return max(1, round(DENSITY * (m - SEED + 1)))


def _by_seeds(docs: DataFrame, its: DataFrame) -> DataFrame:
    """The same by shuffles of seeds, for items of any size.

    A document that shares ``need`` of an item's n seeds shares one of its n - need + 1 that are rarest among the
    documents, so only these make candidates; their shared seeds are counted by all of the item's seeds, and texts go
    only to pairs that reach the number. Seeds that hold much of a side are salted.
    """
    seeds = written(its.mapInPandas(_item_seeds, "item_id long, h long, need int"), "seeds")
    counted = written(seeds.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "seed_counts")
    hits = written(keyed_join(docs.mapInPandas(_doc_seeds, "doc_id long, h long"), counted, ["h"], "n", F.col("doc_id"), row_bytes=16).select("doc_id", "h"), "hits")
    held = hits.groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    by_rarity = Window.partitionBy("item_id").orderBy("docs", "h")
    ranked = seeds.join(held, "h").withColumn("at", F.row_number().over(by_rarity)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("item_id")))
    rare = written(ranked.filter("at <= of - need + 1").select("item_id", "h"), "rare")
    pairs = salted_join(hits, rare, ["h"], F.col("doc_id")).select("doc_id", "item_id").distinct()
    # pairs are held against all of the item's seeds by their documents' own
    near = salted_join(pairs, seeds, ["item_id"], F.col("doc_id")).join(hits, ["doc_id", "h"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need")).filter("n >= need").select("doc_id", "item_id")
    near = written(near, "near")
    texts = salted_join(near, docs.distinct(), ["doc_id"], F.col("item_id")).join(its.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "text", "item_text")
    return texts.mapInPandas(_tiled, "doc_id long, item_id long, coverage double, loose double")


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, t in zip(b["item_id"], b["text"]):
            if w := words_of(t):
                own = seed_hashes(w) if len(w) >= SEED else [xxhash.xxh64_intdigest(" ".join(w)) - (1 << 63)]
                rows += [(i, h, _least_seeds(max(len(w), SEED))) for h in set(own)]
        yield pd.DataFrame(rows, columns=["item_id", "h", "need"])


def _doc_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, t in zip(b["doc_id"], b["text"]):
            w = words_of(t)
            short = [xxhash.xxh64_intdigest(" ".join(w[p : p + n])) - (1 << 63) for n in range(1, SEED) for p in range(len(w) - n + 1)]
            rows += [(i, h) for h in {*seed_hashes(w), *short}]
        yield pd.DataFrame(rows, columns=["doc_id", "h"])


def _tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for d, i, t, s in b.itertuples(index=False):
            doc, item = words_of(t), words_of(s)
            if len(item) < SEED:
                if any(doc[p : p + len(item)] == item for p in range(len(doc))):
                    rows.append((d, i, 1.0, 1.0))
                continue
            own = set(seed_hashes(item))
            best, loose = coverage(item, doc, [(p, h) for p, h in enumerate(seed_hashes(doc)) if h in own])
            if best >= COVERAGE:
                rows.append((d, i, best, loose))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "loose"])
