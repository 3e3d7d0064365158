"""Expressions on inline rows."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.functions import dates, scores, text, tiers, urls


def one(spark, col, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(col.alias("x")).first()["x"]


URLS = [
    ("https://www.A.example/p/?utm_source=x&b=2&a=1#f", "a.example/p?a=1&b=2"),
    ("http://m.a.example/p", "a.example/p"),
    ("https://amp.a.example/p/", "a.example/p"),
    ("https://user:pw@a.example:8080/p", "a.example:8080/p"),
    ("no host", "no host"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("url,want", URLS)
def test_canonical_url(spark, url, want):
    got = one(spark, urls.canonical_url(F.col("u")), u=url)
    assert got == want


def test_canonical_url_is_idempotent(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string").withColumn("c", urls.canonical_url(F.col("u")))
    assert df.filter(urls.canonical_url(F.concat(F.lit("https://"), F.col("c"))) != F.col("c")).filter("c like '%.example%'").count() == 0


@pytest.mark.parametrize("host,want", [("news.bbc.co.uk", "bbc.co.uk"), ("a.b.example", "b.example"), ("me.wordpress.com", "me.wordpress.com"), ("www.x.example", "x.example"), ("x", "x"), ("", ""), (None, "")])
def test_registrable_domain(spark, host, want):
    assert one(spark, urls.registrable_domain(F.col("h")), h=host) == want


LEXICON = [("host", "Wire.example", "established_wire"), ("suffix", ".gov", "official"), ("host", "bbc.example", "major_outlet"), ("host", "old.bbc.example", "aggregator_portal"), ("mark", "blog", "weak/blog"), ("path", "/r/", "user_generated")]
TIERS = [("https://www.wire.example/x", "established_wire"), ("https://x.gov/y", "official"), ("https://notbbc.example", "unknown"), ("https://me.blog.example", "weak/blog"), ("https://a.bbc.example/r/x", "user_generated"), ("https://news.old.bbc.example:8080/", "aggregator_portal"), ("https://BBC.example", "major_outlet"), ("", "unknown"), ("/r/x", "unknown"), (None, "unknown")]


def test_tiers(spark):
    lexicon = spark.createDataFrame(LEXICON, tiers.LEXICON)
    df = spark.createDataFrame([(u, w, "x") for u, w in TIERS] + [TIERS[0] + ("again",)], "u string, want string, value string")
    got = tiers.with_tiers(df, "u", lexicon)
    assert got.count() == len(TIERS) + 1 and got.filter("tier <> want").collect() == [] and got.columns == ["u", "want", "value", "tier", "tier_reason"]
    assert tiers.with_tiers(df, "u", lexicon.limit(0)).filter("tier <> 'unknown'").count() == 0
    assert tiers.with_tiers(df.limit(0), "u", lexicon).count() == 0
    with pytest.raises(ValueError):
        tiers.with_tiers(df, "u", spark.createDataFrame([("mark", f"m{i}", "weak/blog") for i in range(501)], tiers.LEXICON))


STATUSES = [
    ("The ship sank on 14 July 1969.", "On 14 July 1969 it sank.", "match"),
    ("The ship sank on 14 July 1969.", "It sank in July 1969.", "same_year"),
    ("The ship sank on 14 July 1969.", "It sank on 15 July 1969.", "different"),
    ("The ship sank on 14 July 1969.", "A paper of 2019 tells of it.", "different"),
    ("The ship sank on 14 July 1969.", "In 1969, not on 3 May 1916, it sank.", "same_year"),
    ("The ship sank in July 1969.", "It sank on 20 July 1969.", "match"),
    ("The ship sank in July 1969.", "It sank on 20 May 1969.", "different"),
    ("The ship sank in July 1969.", "It sank in 1969.", "same_year"),
    ("The ship sank in July 1969.", "It sank in 1970.", "different"),
    ("The ship sank in 1969.", "In 1969 it sank.", "same_year"),
    ("The ship sank.", "In 1969 it sank.", "unknown"),
    ("The ship sank in 1969.", "It sank.", "unknown"),
    ("The ship sank in 1969.", None, "unknown"),
    (None, "In 1969 it sank.", "unknown"),
]


@pytest.mark.parametrize("claim,passage,want", STATUSES)
def test_compatibility_of_dates(spark, claim, passage, want):
    c, e = F.col("c"), F.col("e")
    assert one(spark, dates.compatibility(dates.extract_dates(e), dates.years(e), F.get(dates.extract_dates(c), F.lit(0)), dates.years(c)), c=claim, e=passage) == want


def test_dates_of_the_source_and_of_publication(spark):
    claim, passage = F.get(dates.extract_dates(F.lit("on 14 July 1969")), F.lit(0)), F.lit("The paper.")
    own, years = dates.extract_dates(passage), dates.years(passage)
    of_source = dates.extract_dates(F.lit("14 July 1969"))
    named = F.array(F.lit(1969))
    # the day of the source is no day of the passage
    assert one(spark, dates.compatibility(own, years, claim, named, of_source, named), x="") == "same_year"
    assert one(spark, dates.compatibility(own, years, claim, named, F.filter(of_source, lambda d: F.lit(False)), named, F.lit("1969-07-14").cast("date")), x="") == "same_day_published"


@pytest.mark.parametrize("passage,want", [
    ("They landed on 20 July 1969. They gave it away on 20 July 1970.", (False, False)),
    ("They landed on the moon on 20 July 1970.", (True, False)),
    ("The landing was on 21 August 1969.", (False, True)),
    ("The landing was on 21 July 1969.", (False, False)),
    ("The landing.", (False, False)),
    (None, (False, False)),
])
def test_dates_bound_to_the_event(spark, passage, want):
    stems = F.array(*(F.lit(w) for w in ("land", "moon")))
    claim = F.get(dates.extract_dates(F.lit("on 20 July 1969")), F.lit(0))
    got = one(spark, dates.event_conflicts(text.sentences(F.col("e")), claim, stems, text.stem), e=passage)
    assert (got["clear"], got["soft"]) == want


def test_parts_of_labelled_texts(spark):
    t = F.col("t")
    kinds = ("REAL", "FAKE", "UNVERIFIED")
    verdict = text.labelled(t, "verdict", kinds)
    assert one(spark, verdict, t="Verdict: fake. Later\nFinal verdict -\n**Real** so.") == "REAL" and one(spark, verdict, t="It is not REAL.\n ** fake **\n") == "FAKE"
    assert one(spark, verdict, t="It is not REAL.") is None and one(spark, verdict, t=None) is None
    assert one(spark, text.list_section(t, "gaps"), t="Gaps:\n- one\n• two x\n\nnone\nNext part:\n- three") == ["one", "two x"]
    assert one(spark, text.list_section(t, "gaps"), t="No list") == [] and one(spark, text.list_section(t, "gaps"), t=None) is None


def test_phrases_and_words_in_other_forms(spark):
    words = text.tokens(F.col("t"))
    assert one(spark, text.contains_phrase_nearly(words, F.lit("flooded river bank")), t="The flooded old bank") and one(spark, text.contains_phrase_nearly(words, F.lit("flooded river")), t="The flooded river")
    assert not one(spark, text.contains_phrase_nearly(words, F.lit("flooded river")), t="The flooded town") and not one(spark, text.contains_phrase_nearly(words, F.lit("a b c")), t="a b")
    assert one(spark, text.contains_keyword(words, F.lit("landing")), t="They land now") and not one(spark, text.contains_keyword(words, F.lit("landing")), t=None)
    assert one(spark, text.has_marker(F.col("t"), ("a+b", "hoax")), t="A HOAX") and not one(spark, text.has_marker(F.col("t"), ("a+b",)), t="aab")


def test_dates_are_taken_out(spark):
    t = F.col("t")
    out = text.without_dates(t, dates.extract_dates(t))
    assert one(spark, out, t="It sank on 12 Aug 2024 and, in July 1969, rose.") == "It sank and, , rose." and one(spark, out, t=None) is None and one(spark, out, t="No date (x).") == "No date (x)."


def test_redaction(spark):
    got = one(spark, text.redact(F.col("t")), t="org_Ab12cd34 proj_x1 sk-abcdefghijkl-1 bearer abcdefghijklm API_KEY = v1 secretary: no")
    assert got == "org_[redacted] proj_x1 [redacted-key] Bearer [redacted] API_KEY=[redacted] secretary: no"


DATES = [
    ("on 12 Aug 2024 and 12th August, 2024", [(12, 8, 2024)]),
    ("August 12, 2024", [(12, 8, 2024)]),
    ("July 20 th , 1969", [(20, 7, 1969)]),
    ("2024-08-12T08:01:45Z", [(12, 8, 2024)]),
    ("12/08/2024", [(12, 8, 2024), (8, 12, 2024)]),
    ("31/12/2024", [(31, 12, 2024)]),
    ("30 February 2024, 31 April 2020", []),
    ("in July of 1969", [(None, 7, 1969)]),
    ("Mayflower 1620", []),
    ("12 Aug 2024, not August 2024", [(12, 8, 2024), (None, 8, 2024)]),
    ("", []),
]


@pytest.mark.parametrize("t,want", DATES)
def test_extract_dates(spark, t, want):
    assert [(d["day"], d["month"], d["year"]) for d in one(spark, dates.extract_dates(F.col("t")), t=t)] == want


def test_dates_around_an_anchor(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1), "Yesterday"), (None, "today"), (dt.date(2024, 3, 1), "soon")], "d date, t string")
    assert [r[0] for r in df.select(dates.relative(F.col("t"), F.col("d"))).collect()] == [dt.date(2024, 2, 29), None, None]
    v = spark.range(1).select(dates.variants(F.lit(5), F.lit(7), F.lit(1969)).alias("v"), dates.variants(F.lit(None).cast("int"), F.lit(7), F.lit(1969)).alias("m")).first()
    assert v["v"][0] == "5 July 1969" and len(v["v"]) == 7 and v["m"] == ["July 1969", "July, 1969", "Jul 1969", "1969-07"]


SECRETS = [("org_01kwyrabc", "org_[redacted]"), ("key gsk_abcdefghijklmnop1", "key [redacted-key]"), ("Bearer abcdefghijklmnop", "Bearer [redacted]"), ("password: hunter2 x", "password=[redacted] x"), ("nothing", "nothing"), (None, None)]


@pytest.mark.parametrize("t,want", SECRETS)
def test_redact(spark, t, want):
    assert one(spark, text.redact(F.col("t")), t=t) == want


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([("a b c d e f", "a b c d e f g"), ("a b", "a b"), ("", "x"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(text.jaccard(text.shingles(F.col("a")), text.shingles(F.col("b")))).collect()]
    assert got[:3] == [2 / 3, 1.0, 0.0] and got[3] in (None, 0.0)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=30), min_size=1, max_size=5))
def test_shingles_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.shingles(F.col("t"), 2).alias("s"))
    for t, s in df.collect():
        w = t.split()
        assert set(s) == ({" ".join(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) >= 2 else set(w))


def test_parsing(spark):
    assert one(spark, text.confidence(F.col("t")), t="Confidence:\n83%") == 83.0
    assert one(spark, text.confidence(F.col("t")), t="maybe 12.5 % or so") == 12.5
    assert one(spark, text.confidence(F.col("t")), t="none") is None
    assert one(spark, text.section(F.col("t"), "Verdict"), t="Verdict:\n TRUE \nReason: x") == "TRUE"
    assert one(spark, text.reference(F.col("t")), t="u | d").asDict() == {"url": "u", "domain": "d", "excerpt": None}
    assert one(spark, text.keyword_forms(F.col("t")), t="flooding") == ["flood", "floode", "flooding"]
    assert one(spark, text.stem(F.col("t")), t="meetings") == "meet"
    assert one(spark, text.normalize_shouting(F.col("t"), ("NASA",)), t="BIG NASA NEWS, ok") == "Big NASA News, ok"


def test_scores(spark):
    c = F.lit
    full = scores.evidence_score(c(1.0), c("entailment"), c(1.0), c(1.0), c("match"), c("strong"), c(1.0), c(True), c(True), c(False))
    none = scores.evidence_score(c(None), c(None), c(None), c(None), c(None), c(None), c(None), c(None), c(None), c(None))
    a, b, cap = spark.range(1).select(full, none, scores.capped(full, c("SUPPORT"), c("search_snippet"))).first()
    assert a == pytest.approx(1.0) and 0 <= b < 0.2 and cap == 0.45
    x = spark.range(1).select(scores.cosine(F.array(c(1.0), c(0.0)), F.array(c(0.0), c(2.0))), scores.cosine(F.array(c(0.0)), F.array(c(1.0))), scores.calibrated(c(0.7), 1.0), scores.hamming(c(5), c(3))).first()
    assert x[0] == 0.0 and x[1] is None and x[2] == pytest.approx(0.7) and x[3] == 2
