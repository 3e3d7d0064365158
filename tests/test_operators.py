"""Selection, timelines, metrics, audit, chunking, sources and evidence on small rows and against brute force."""

import json
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import audit, chunking, evidence, hashes, metrics, selection, timeline, vectors
from tesserine.sources import files, html


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sh(t, n=5):
    import re

    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def texts():
    rng = random.Random(5)
    out = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 40)}" for _ in range(40)]
        out.append(" ".join(base))
        out.append(" ".join(base[:-1]))
        out.append(" ".join(base[1:]) + " tail")
        out.append(" ".join(base).upper())
    return [*out, "", None, "a b", "A  b"]


def test_near_duplicates_lose_no_pair(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    sets = {}
    for i, x in enumerate(t):
        if s := sh(x):
            sets.setdefault(frozenset(s), i)
    reps = {i: s for s, i in sets.items()}
    want = sorted((a, b) for a, b in combinations(sorted(reps), 2) if len(reps[a] & reps[b]) / len(reps[a] | reps[b]) >= 0.8)
    assert len(want) > 20
    assert rows(selection.near_duplicates(df, "doc_id", "text").select("id_a", "id_b")) == sorted(want, key=repr)
    classes = dict(rows(selection.text_classes(df, "doc_id", "text")))
    assert all(classes[i] == sets[frozenset(sh(x))] for i, x in enumerate(t) if sh(x)) and len(classes) == len(t) - 2


def test_words_of_all_scripts_make_shingles(spark):
    ru = "город насчитал семь лодок у старой пристани в порту до полудня и записал их"
    data = [(1, ru + " 12 14"), (2, ru.upper() + ", 12; 14"), (3, "совсем другие слова стоят здесь в этом тексте 12 14"), (4, "12 14"), (5, "…"), (6, None), (7, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(selection.text_classes(df, "doc_id", "text")) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_contained_texts_lose_no_pair(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(40)) for _ in range(30)]
    data = list(enumerate(base + [" ".join(t.split()[3:30]) for t in base] + ["the same four words", "", None] + base[:2]))
    df = spark.createDataFrame(data, "doc_id long, text string")
    first = {}
    for i, t in data:
        if sh(t):
            first.setdefault(frozenset(sh(t)), i)
    want = []
    for a, i in first.items():
        for b, j in first.items():
            if i != j and len(a) >= 4 and (len(a), i) < (len(b), j) and len(a & b) / len(a) >= 0.9:
                want.append((i, j, len(a & b)))
    got = selection.contained_texts(df, "doc_id", "text").select("small_id", "large_id", "overlap")
    assert rows(got) == sorted(want, key=repr) and len(want) >= 30
    assert selection.contained_texts(df.limit(0), "doc_id", "text").count() == 0


def test_the_best_row_of_duplicates_is_kept(spark):
    df = spark.createDataFrame([("a", 1, 0.5, "x"), ("a", 2, 0.9, "y"), ("a", 3, 0.9, "x"), ("b", 4, None, None), ("b", 5, -1.0, "z"), ("c", 6, None, "q")], "k string, id long, s double, l string")
    assert rows(selection.dedup_best(df, ["k"], "s", "id", ["l"])) == [("a", 2, 0.9, 3, "x|y"), ("b", 5, -1.0, 2, "z"), ("c", 6, None, 1, "q")]


def test_a_long_chain_comes_to_its_end(spark):
    n = 106
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "id_a long, id_b long").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = [r[0] for r in selection.greedy_survivors(spark.range(n).coalesce(1), pairs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got) == list(range(0, n, 2))


def test_near_hashes_lose_no_pair(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(60) for _ in range(30)]
    data = [(i, h) for i, h in enumerate(base)] + [(100 + i, h ^ sum(1 << rng.randrange(60) for _ in range(rng.randint(1, 6)))) for i, h in enumerate(base)] + [(200, base[0]), (201, base[0]), (300, None), (301, 0), (302, 1)]
    df = spark.createDataFrame(data, "i long, h long")
    first = {}
    for i, h in data:
        if h is not None:
            first.setdefault(h, []).append(i)
    want = sorted((min(a), min(b), (x ^ y).bit_count(), len(a), len(b)) for x, a in first.items() for y, b in first.items() if min(a) < min(b) and (x ^ y).bit_count() <= 5)
    assert rows(hashes.hamming_pairs(df, "i", "h", 5)) == sorted(want, key=repr) and len(want) > 10
    assert hashes.hamming_pairs(df.limit(0), "i", "h", 5).count() == 0
    assert spark.range(1).select(hashes.sign_hash(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0)))).first()[0] == 5


def test_a_locked_threshold_is_fitted_elsewhere(spark):
    fit = spark.createDataFrame([(1, 0.31), (1, 0.9), (0, 0.3), (0, 0.1)], "y int, p double")
    other = spark.createDataFrame([(1, 0.35), (0, 0.2), (0, 0.6), (None, 0.4), (1, None)], "y int, p double")
    got = metrics.locked(fit, other).first()
    assert (got["threshold"], got["tp"], got["fp"], got["tn"], got["fn"]) == (0.31, 1, 1, 1, 0)
    assert metrics.locked(fit.limit(0), other).count() == 0


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (300, 8)).astype(float)
    v[7] = 0
    v[11] = v[12] * 2
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(999, None)], "i long, e array<double>")
    got = rows(vectors.cosine_top(df, "i", "e", df.filter("i % 20 = 0 or i = 12"), 5).select("query_id", "id", "rank"))
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = []
    for q in [*range(0, 300, 20), 12]:
        s = np.round(u @ u[q], 6)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        want += [(q, i, r) for r, i in enumerate(best, 1)]
    assert got == sorted(want, key=repr)
    assert vectors.cosine_top(df.limit(0), "i", "e", df, 5).count() == vectors.cosine_top(df, "i", "e", df.limit(0), 5).count() == 0


def test_greedy_survivors_are_the_first_independent_set(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for i in range(60):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    ids = spark.range(60)
    assert [r[0] for r in rows(selection.greedy_survivors(ids, spark.createDataFrame(pairs, "id_a long, id_b long")))] == sorted(kept, key=lambda x: repr((x,)))
    assert selection.greedy_survivors(ids.limit(0), spark.createDataFrame([], "id_a long, id_b long")).count() == 0


def test_diverse_top(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 1), (1, "a", 0.8, 2), (1, "a", 0.7, 3), (1, "b", 0.5, 4), (1, None, None, 5)], "k int, g string, s double, id int")
    assert [r[3] for r in selection.diverse_top(df, "k", "g", "s", "id", 4).orderBy("rank").collect()] == [1, 4, 5, 2]


def brute_components(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in range(n)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    n = 80
    edges = {"chain": [(i, i + 1) for i in range(n - 1)], "star": [(40, i) for i in range(n) if i != 40], "random": [tuple(rng.sample(range(n), 2)) for _ in range(50)], "none": []}[kind]
    got = audit.components(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
    assert set(map(tuple, got.collect())) == brute_components(n, edges)


def test_grouped_split_keeps_groups_and_partitions_dont_matter(spark):
    df = spark.range(600).select("id", (F.col("id") % 97).alias("g"), (F.col("id") % 2).alias("y"))
    a = audit.grouped_split(df, "g", "y").select("id", "g", "split")
    assert a.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert rows(a) == rows(audit.grouped_split(df.repartition(9), "g", "y").select("id", "g", "split"))
    assert audit.shared_keys(a, "g", "split").count() == 0


EDGES = [0.0, 2.9, 3.0, 3.1, 29.9, 30.0, 30.1, 60.0]


def test_interval_join_like_brute_force(spark):
    rng = random.Random(4)
    left = [(rng.randint(0, 2), i, float(a := rng.choice(EDGES)), a + rng.choice([0.0, 3.0])) for i, _ in enumerate(range(40))] + [(0, 99, None, 1.0)]
    right = [(rng.randint(0, 2), i, float(a := rng.choice(EDGES)), a + rng.choice([0.0, 40.0])) for i in range(40)] + [(None, 98, 1.0, 2.0)]
    dl, dr = spark.createDataFrame(left, "k int, l int, a double, b double"), spark.createDataFrame(right, "k int, r int, c double, d double")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] is not None and y[2] <= x[3] + 3 and y[3] >= x[2] - 3)
    args = ("k", "a", "b", "c", "d", 3.0, 10.0)
    assert sorted(map(tuple, timeline.interval_join(dl, dr, *args).select("l", "r").collect())) == want
    alone = sorted(set(x[1] for x in left) - {a for a, _ in want})
    assert sorted(r[0] for r in timeline.interval_join(dl, dr, *args, "anti").select("l").collect()) == alone
    assert timeline.interval_join(dl, dr, *args, "left").count() == len(want) + len(alone)


def test_merges(spark):
    seen = [("v", 0.0, "Breaking: flood", 1, 0.5), ("v", 30.0, " breaking:  floods", 2, 0.9), ("v", 60.1, "breaking: flood", 3, None), ("v", 61.0, " ", 4, 1.0), ("v", 62.0, "other words", 5, 0.7), ("w", None, "x", 6, 1.0), ("w", 1.0, "Öl", 7, 0.1), ("w", 1.0, "öl", 7, 0.2)]
    of = spark.createDataFrame(seen, "k string, t double, x string, f long, c double")
    got = rows(timeline.merge_observations(of, "k", "t", "x", 30, 0.7, "f", "c"))
    assert got == [("v", 0.0, 30.0, "breaking: floods", 2, 1, 2, 0.9), ("v", 60.1, 60.1, "breaking: flood", 1, 3, 3, None), ("v", 62.0, 62.0, "other words", 1, 5, 5, 0.7), ("w", 1.0, 1.0, "Öl", 2, 7, 7, 0.2)]
    df = spark.createDataFrame([("v", 0.0), ("v", 30.0), ("v", 60.1), ("w", None)], "k string, t double")
    assert rows(timeline.gap_islands(df, "k", "t", 30.0)) == [("v", 1, 0.0, 30.0, 2), ("v", 2, 60.1, 60.1, 1)]
    assert timeline.merge_observations(df.limit(0).withColumn("x", F.lit("a")), "k", "t", "x").count() == 0


def test_boxes(spark):
    df = spark.createDataFrame([("i", "hello", 0, 10, 0, 10), ("i", "world", 12, 20, 1, 11), ("i", "below", 0, 9, 30, 40)], "k string, t string, l int, r int, a int, b int")
    assert [r["text"] for r in timeline.group_boxes(df, "k", "t", "l", "r", "a", "b").orderBy("line").collect()] == ["hello world", "below"]
    b = spark.range(1).select(timeline.box_info(F.lit(None).cast("array<array<double>>")).alias("n"), timeline.box_info(F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(4.0), F.lit(5.0)))).alias("b")).first()["b"]
    assert (b["cx"], b["height"]) == (2.0, 4.0)


def test_metrics_like_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)] + [(None, 0.3), (1, None)], "y int, p double")
    c = metrics.confusion(df, 0.5).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 0)).sum(), ((p < 0.5) & (y == 1)).sum())
    s = {round(r["threshold"], 2): r for r in metrics.threshold_sweep(df).collect()}
    for t in (0.0, 0.07, 0.5, 0.99, 1.0):
        assert s[t]["tp"] == ((p >= t - 1e-9) & (y == 1)).sum() and s[t]["fn"] == ((p < t - 1e-9) & (y == 1)).sum()
    pos, neg = p[y == 1], p[y == 0]
    u = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert metrics.auc(df).first()["auc"] == pytest.approx(u)
    b = {r["bin"]: r["n"] for r in metrics.reliability_bins(df).collect()}
    assert b[1] == (p <= 0.1 + 1e-9).sum() and sum(b.values()) == 500
    w = metrics.uncertainty_bands(df).first()
    assert w["uncertain_rate"] <= 0.30
    empty = df.limit(0)
    assert metrics.confusion(empty).first()["accuracy"] is None and metrics.auc(empty).first()["auc"] is None and metrics.calibration_error(empty).first()["ece"] is None


def test_bootstrap_is_the_same_on_any_partitioning(spark):
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("a"), (F.col("id") % 2 == 0).cast("int").alias("b"))
    x, y = (metrics.paired_bootstrap(d, 50).first() for d in (df, df.repartition(7)))
    assert x["mean"] == pytest.approx(y["mean"]) and x["low"] <= x["mean"] <= x["high"] and x["p_b_better"] > 0.9


def test_chunks_hold_all_words_in_order():
    t = "First sentence here is six words. " * 30 + "\n\n" + "word " * 500
    got = chunking.pack(t, 50)
    assert " ".join(got).split() == t.split() and max(len(c.split()) for c in got) <= 50
    assert chunking.pack("too short", 50) == []


EV = "claim_id long, pos int, evidence_id long, source_id string, url string, domain string, independence_group string, evidence_class string, evidence_type string, evidence_score double, is_primary_source boolean, debunking boolean, date_status string, detail_coverage double"


def ev(spark, *rs):
    return spark.createDataFrame([(1, i, i, None, u, None, g, k, t, s, True, False, "match", 0.5) for i, (u, g, k, t, s) in enumerate(rs)], EV)


@pytest.mark.parametrize("gap,source,group", [(0.0625, "neutral", "neutral"), (0.125, "entailment", "entailment")])
def test_margins(spark, gap, source, group):
    one = ev(spark, ("https://a.example/1", "a", "SUPPORT", "scraped_article", 0.5 + gap), ("https://a.example/1", "a", "CONTRADICTION", "scraped_article", 0.5))
    assert evidence.source_decisions(one).first()["decision"] == source
    two = ev(spark, ("https://a.example/1", "a", "SUPPORT", "scraped_article", 0.5 + gap), ("https://a.example/2", "a", "CONTRADICTION", "scraped_article", 0.5))
    assert evidence.publisher_decisions(evidence.source_decisions(two)).first()["decision"] == group


def test_snippets_never_decide_and_identity_needs_an_address(spark):
    d = evidence.source_decisions(ev(spark, ("https://a.example/1", "a", "SUPPORT", "search_snippet", 0.9), ("", None, "SUPPORT", "scraped_article", 0.9)))
    got = {r["source_key"]: (r["decision"], r["identity_resolved"]) for r in d.collect()}
    assert got == {"url:a.example/1": ("related_context", True), "unresolved:1": ("entailment", False)}
    a = evidence.agreement(d, evidence.publisher_decisions(d)).first()
    assert a["supporting"] == 0 and a["unresolved_sources"] == 1


def test_html():
    body = "x" * 250
    graph = json.dumps({"@graph": [{"mainEntity": {"articleBody": body}}]})
    assert html.extract(f'<script type="application/ld+json">{graph}</script>')[2] == body
    page = "<title>T</title><nav><p>menu menu menu menu menu menu menu</p></nav><article>" + "<p>A paragraph of the article with enough characters in it.</p>" * 8 + "</article>"
    title, _, text, status = html.extract(page)
    assert (title, status) == ("T", "ok") and "menu" not in text
    assert html.extract('<script type="application/ld+json">{broken</script>')[3] == "empty" and html.extract(None)[3] == "empty"


def test_html_column(spark):
    df = spark.createDataFrame([("<p>" + "word " * 60 + "</p>",), (None,)], "h string")
    assert [r[0]["status"] for r in df.select(html.article(F.col("h"))).collect()] == ["ok", "empty"]


def test_fact_checks_and_results(spark, tmp_path):
    good = json.dumps([{"text": "c", "claimReview": [{"publisher": {"name": "P"}, "url": "u", "textualRating": "False"}, {"url": "v"}]}, {"text": "d"}])
    df = spark.createDataFrame([(1, good), (2, "{broken"), (3, None)], "id int, j string")
    assert [r["review_url"] for r in files.fact_check_rows(df, "j").orderBy("review_url").collect()] == ["u", "v"]
    block = spark.createDataFrame([("T", "http://u.example", "two\nlines", 1)], "t string, u string, c string, n int").select(files.format_results(F.col("t"), F.col("u"), F.col("c"), F.col("n")).alias("x"))
    r = files.parse_results(block, "x").first()
    assert (r["title"], r["url"], r["content"]) == ("T", "http://u.example", "two\nlines")
    m = spark.createDataFrame([("f1", "fake", "/a/f1.mp4", "f1.mp4", 5, 1.0, 2, 3, 25.0, None, None, False)], files.MANIFEST)
    files.write_table(m, str(tmp_path / "m"), "csv")
    assert rows(files.read_csv(spark, str(tmp_path / "m"))) == rows(m)
    (tmp_path / "s.json").write_text('{"a": 0.5, "b": 1}')
    assert rows(files.read_scores(spark, str(tmp_path / "s.json"), "k")) == [("k", "a", 0.5), ("k", "b", 1.0)]
    assert files.directory_manifest(spark, str(tmp_path / "s.json")).first()["source_id"] == "s"
