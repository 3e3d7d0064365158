"""The operators on records against brute force, and their edge cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserine.llm.canonical import copies
from tesserine.llm.cross_split import bands_for, cross_split_pairs
from tesserine.llm.records import COPY_MARKS, SHORT_HOSTS
from tesserine.llm.topn import top_n_per_group

MANIFEST = "row_id long, cascade_id string, file_path string, duration_sec double, rank int"
FVC = "cascade_id string, video_url string, key string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_top_n_matches_brute_force(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 30)}", rng.choice([0.1, 0.5, 0.9, None, float("nan"), -0.0, 0.0]), i, "x") for i in range(4000)]
    data += [(None, 1.0, 9001, "x"), ("g1", 1.0, None, "x")] + data[:5]
    df = spark.createDataFrame(data, "g string, s double, id long, rank string").repartition(7)
    want = defaultdict(list)
    for g, s, i, _ in data:
        if g is not None and s is not None and i is not None:
            want[g].append((0 if s != s else 1, -s if s == s else 0.0, i))
    expected = sorted((g, k[2], r) for g, v in want.items() for r, k in enumerate(sorted(v)[:3], 1))
    assert sorted(map(tuple, top_n_per_group(df, ["g"], "s", "id", 3).select("g", "id", "rank").collect())) == expected


def test_top_n_of_an_empty_table_and_of_one_row(spark):
    empty = spark.createDataFrame([], "g string, s double, id long")
    assert top_n_per_group(empty, ["g"], "s", "id").count() == 0
    one = spark.createDataFrame([("a", -5.0, -3)], "g string, s double, id long")
    assert rows(top_n_per_group(one, ["g"], "s", "id")) == [("a", -3, -5.0, 1)]
    with pytest.raises(ValueError):
        top_n_per_group(one, ["g"], "s", "id", 0)


def test_top_n_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("s"), "id").coalesce(1)
        got = rows(top_n_per_group(df, ["g"], "s", "id", 2).select("g", "id"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = defaultdict(list)
    for i in range(2000):
        best[i % 3].append((-(i * 7919 % 1000), i))
    assert got == sorted((g, i) for g, v in best.items() for _, i in sorted(v)[:2])


RECORD = "id long, claim_id long, s string, u string, c string, h string, check string"


def record_rows(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], RECORD)


COPIES = [
    (5, 1, "src-A", "https://a.example/p?x=1&y=2", "Straße, 3 km."),
    (2, 1, "SRC A", "HTTPS://A.example/p?y=2&x=1", "STRASSE 3 KM"),
    (7, 1, "src_a", "https://a.example/p/?y=2&x=1", "Stra\u00a0ße 3 km"),
    (8, 1, "src-A", "https://a.example/p?x=1&y=2", "Straße, 4 km."),
    (9, 2, "src-A", "https://a.example/p?x=1&y=2", "Straße, 3 km."),
    (10, 1, None, "", "alone"),
    (11, 1, None, "", "Alone!"),
    (12, 1, "", "", "alone"),
    (13, 1, "s", None, "  "),
    (14, 1, "s", None, None),
    (15, 1, "s", None, ""),
    (18, 3, "s", "u", "Cafe\u0301 \uff13 \ufb01n"),
    (19, 3, "s", "u", "caf\u00e9 3 fin"),
    (16, None, "s", None, "x" * 200_000),
    (17, None, "s", None, "X" * 200_000),
]


@pytest.mark.parametrize("limit", [None, 0])
def test_copies(spark, limit):
    records, members = copies(record_rows(spark, COPIES), "id", ["claim_id"], ["s", "c"], ["u"], "c", broadcast_bytes=limit)
    assert rows(members) == [(10, 11), (16, 17), (18, 19), (2, 5), (2, 7)]
    assert sorted(r[0] for r in records.select("n_copies").collect()) == [1, 1, 1, 2, 2, 2, 3]


def test_colliding_hashes_stay_apart(spark):
    weak = lambda c: F.unhex(F.lit("00"))
    _, members = copies(record_rows(spark, COPIES), "id", ["claim_id"], ["s", "c"], ["u"], "c", hash128=weak)
    assert rows(members) == [(10, 11), (16, 17), (18, 19), (2, 5), (2, 7)]


def test_copies_of_an_empty_table_and_of_repeated_rows(spark):
    r, m = copies(record_rows(spark, []), "id", ["claim_id"], ["s", "c"], ["u"], "c")
    assert r.count() == 0 and m.count() == 0
    r, m = copies(record_rows(spark, [COPIES[0]] * 3), "id", ["claim_id"], ["s", "c"], ["u"], "c")
    assert m.count() == 0 and r.first()["n_copies"] == 3


TRAIN = [(1, "f-12", "/a/f12.mp4", 10.0, 0), (2, "F 12", "D:\\x\\clip_a.mp4", 4.0, 0), (3, "r7", "r7 (1).MKV", 5.0, 0), (4, "r8", "x/r8.mp4", 1.0, 0), (5, None, None, None, 0), (5, None, None, None, 0)]
EVALS = [(11, "f12", "/b/other.mp4", 3.0, 0), (12, "r1", "CLIP_A_copy.webm", 4.09, 0), (13, "r2", "clip_a.mp4", 4.1, 0), (14, "r3", "q/r7-480p.mp4", 5.05, 0), (15, "r9", "z.mp4", None, 0), (16, "", "", 1.0, 0)]
VIDEOS = [("r8", "https://www.vidriver.example/watch?feature=share&v=AbC", "k"), ("R-9", "https://vdrv.example/AbC?t=3", "k"), ("r2", "https://vidriver.example/watch?v=abc", "k"), (None, None, "k"), ("r8", None, "k")]


def test_cross_split_pairs(spark):
    t, e = (spark.createDataFrame(x, MANIFEST) for x in (TRAIN, EVALS))
    v = spark.createDataFrame(VIDEOS, FVC)
    got = {(r["train_id"], r["eval_id"]): tuple(r["kinds"]) for r in cross_split_pairs(t, e, v, copy_marks=COPY_MARKS, short_hosts=SHORT_HOSTS).collect()}
    assert got == {(1, 11): ("cascade",), (2, 11): ("cascade",), (2, 12): ("file",), (3, 14): ("file",), (4, 15): ("video",)}
    assert cross_split_pairs(t.limit(0), e, v, copy_marks=COPY_MARKS).count() == 0
    assert cross_split_pairs(t, e, v.limit(0), copy_marks=COPY_MARKS).count() == 4


def test_near_keys_are_found_as_brute_force_finds_them(spark):
    rng = random.Random(8)
    words = ["harbour", "flood", "night", "council", "bridge", "quay", "storm", "ferry"]
    names = ["-".join(rng.choices(words, k=5)) for _ in range(60)]
    train = [(i, None, f"{n}.mp4", 5.0, 0) for i, n in enumerate(names)]
    evals = [(1000 + i, None, f"{n[:k]}{rng.choice('xyz')}{n[k + 1:]}.mp4", 5.0, 0) for i, n in enumerate(names * 3) for k in [rng.randrange(2, len(n) - 1)]]

    def shingles(n):
        p = f"\x02\x02{n}\x03\x03"
        return {p[i : i + 3] for i in range(len(p) - 2)}

    def stem(p):
        return shingles(p.rsplit(".", 1)[0])

    want = {(a[0], b[0]) for a in train for b in evals if len(stem(a[2]) & stem(b[2])) / len(stem(a[2]) | stem(b[2])) >= 0.8}
    t, e = (spark.createDataFrame(x, MANIFEST) for x in (train, evals))
    got = {(r["train_id"], r["eval_id"]) for r in cross_split_pairs(t, e, spark.createDataFrame([], FVC), similarity=0.8).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 50
    assert bands_for(1.0) == 1 and bands_for(0.8) == 7


def test_wide_groups_are_bounded(spark):
    df = spark.range(4000).selectExpr("id % 2 AS g", "cast(hash(id) % 100 AS double) AS s", "id").repartition(40)
    got = rows(top_n_per_group(df, ["g"], "s", "id", 3).select("g", "id"))
    want = []
    for g in (0, 1):
        want += [(g, r["id"]) for r in df.filter(f"g = {g}").orderBy(F.desc("s"), "id").limit(3).collect()]
    assert got == sorted(want)
