"""The operators on small tables: edge cases, repeated rows, clashing columns, both ways of joining."""

import hashlib
import math

import pytest

from tesserine.llm import boilerplate, encode, leak, lines, mojibake, residue, truncation

EV = "evidence_id long, domain string, url string, chunk string, id string, word string, line_no string, n string"


def ev(spark, data):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in data], EV)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


NULLS = [(None, None, None, None), (900, None, None, ""), (901, "a.example", "", "  \n\n "), (902, None, "https://a.example/x", None)]


def test_repeated_lines(spark):
    data = [(i, "a.example", "u", f"Own line {'x' * i}.\n\nRead  next!\nREAD NEXT\n12 3") for i in range(8)]
    data += [(50 + i, "b.example", "u", "Read next") for i in range(7)] + NULLS + [(60, None, "u", "Read next")] * 9
    got = rows(lines.repeated_lines(ev(spark, data), "evidence_id", "domain", "chunk"))
    assert got == sorted([(i, n) for i in range(8) for n in (3, 4)], key=repr)
    twice = rows(lines.repeated_lines(ev(spark, data[:7] + data[:1]), "evidence_id", "domain", "chunk"))
    assert twice == []  # eight rows, but seven ids
    assert lines.repeated_lines(ev(spark, []), "evidence_id", "domain", "chunk").count() == 0
    clean = dict(rows(lines.without_lines(ev(spark, data), "evidence_id", "chunk", lines.repeated_lines(ev(spark, data), "evidence_id", "domain", "chunk"))))
    assert clean[3] == "Own line xxx.\n\n12 3" and clean[902] is None and clean[55] == "Read next"
    x = {(r["source"], r["letters"]): r for r in lines.excess_lines(ev(spark, data), "evidence_id", "domain", "chunk").collect()}
    assert set(x) == {("a.example", "readnext")} and x["a.example", "readnext"]["n_rows"] == 8 and x["a.example", "readnext"]["n_outside"] == 7


def test_llr_is_small_for_lines_common_everywhere(spark):
    data = [(i, f"h{i % 3}.example", "u", "Common line" + ("\nOnly here" if i % 3 == 0 else "")) for i in range(90)]
    x = {(r["source"], r["letters"]): r for r in lines.excess_lines(ev(spark, data), "evidence_id", "domain", "chunk").collect()}
    assert not x["h0.example", "commonline"]["excess"] and x["h0.example", "onlyhere"]["excess"]


def test_levels_are_those_of_benjamini_and_hochberg(spark):
    data = [(i, f"h{i % 5}.example", "u", "\n".join(w for j, w in enumerate(("alpha", "beta", "gamma", "delta", "epsilon")) if (i * (j + 3) + i // 7) % (2 + j) == 0 or i % 5 == j) or "none") for i in range(300)]
    got = lines.excess_lines(ev(spark, data), "evidence_id", "domain", "chunk").collect()
    tests = len({(s, k) for _, s, _, c in data for k in c.split("\n")})
    p = sorted((math.erfc(math.sqrt(r["llr"] / 2)), r["q"]) for r in got)
    want, least = [], 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[rank - 1][0] * tests / rank)
        want.append(least)
    assert len(p) > 5 and all(q == pytest.approx(w, rel=0.2, abs=1e-12) for (_, q), w in zip(p, reversed(want)))
    assert [q for _, q in p] == sorted(q for _, q in p)


def pages():
    body = "The council of Aby{n} met on day {n} and counted {n} boats near quay {n}, the clerk wrote{w}."
    out = []
    for h in range(6):
        for p in range(8):
            n = h * 10 + p
            word = "".join(chr(97 + int(c, 16)) for c in hashlib.md5(str(n).encode()).hexdigest()[:12])
            text = "\n".join([f"Host{'abcdef'[h]} Post uses cookies to measure visits.", "Money · Sport · World", body.format(n=n, w=word), f"Related: Flood in {word}", "", f"Heading of {word[:6]}", body.format(n=n + 1, w=word[::-1]), "Back to top"])
            out.append((n, f"host{'abcdef'[h]}-post.example", f"https://host{'abcdef'[h]}-post.example/{word}", text))
    return out


def test_templates(spark):
    data = pages() + NULLS
    want = sorted([(r[0], n) for r in pages() for n in (1, 2, 4, 8)], key=repr)
    assert rows(boilerplate.template_lines(ev(spark, data), "evidence_id", "domain", "url", "chunk")) == want
    assert rows(boilerplate.template_lines(ev(spark, data + data[:2]).repartition(7), "evidence_id", "domain", "url", "chunk")) == want
    assert boilerplate.template_lines(ev(spark, []), "evidence_id", "domain", "url", "chunk").count() == 0


def test_garbled_rows(spark):
    sound = [(i, "a", "u", "Die Behörde prüft „Übung“ – São Déjà vu über Grüntal.") for i in range(12)]
    bad = [(100, "a", "u", "Die BehÃ¶rde prÃ¼ft"), (101, "a", "u", "Gr�ntal."), (102, "a", "u", "Grⁿntal."), (103, "a", "u", "Die Behörde"), (104, "a", "u", "日本 ΑΘΗΝΑ SÃO"), (105, "a", "u", "x" * 100_000 + " BehÃ¶rde")]
    df = ev(spark, sound + bad + NULLS + bad[:1])
    got = mojibake.garbled_rows(df, "evidence_id", "chunk")
    assert sorted({r["id"] for r in got.collect()}) == [100, 101, 102, 105]
    fixed = {r["id"]: r["restored"] for r in mojibake.restored_texts(ev(spark, sound + bad + NULLS), "evidence_id", "chunk").collect()}
    assert fixed[100] == "Die Behörde prüft" and fixed[101] == "Grüntal." and fixed[102] == "Grüntal."
    assert mojibake.garbled_rows(ev(spark, []), "evidence_id", "chunk").count() == 0


def test_lost_words_stay_lost_where_the_corpus_doesnt_tell(spark):
    sound = [(i, "a", "u", "Die Behörde prüft Grüntal. Déjà vu, voilà – это он, déjà vu.") for i in range(12)] + [(20 + i, "a", "u", "Der Ort Bär oder Bür") for i in range(6)]
    bad = [(100, "a", "u", "the word � here"), (101, "a", "u", "in B�r now"), (102, "a", "u", "in Gr?ntal. What?Then x?y=1"), (103, "a", "u", "Gr��ntal."), (104, "a", "u", "dÃ©jÃ vu"), (105, "a", "u", "caf茅 and"), (106, "a", "u", "trÃ©sorÃ")]
    r = {r["id"]: r for r in mojibake.restored_texts(ev(spark, sound + bad), "evidence_id", "chunk").collect()}
    assert set(r) == {100, 101, 102, 103, 104, 105, 106}
    assert [(r[i]["restored"], r[i]["n_lost"]) for i in (100, 101)] == [("the word � here", 1), ("in B�r now", 1)]
    assert r[102]["restored"] == "in Grüntal. What?Then x?y=1" and r[103]["restored"] == "Grüntal."
    assert r[104]["restored"].startswith("déjà") and r[105]["restored"].startswith("café and") and r[106]["n_lost"] == 1


def test_truncated(spark):
    data = pages()
    cut = [(500, "hosta-post.example", "https://hosta-post.example/z", "The council of Aby met on day four and counted boats. Then it"), (501, None, None, "Cut… [+3 chars]"), (502, "hosta-post.example", "", "A whole sentence.")]
    df = ev(spark, data + cut + NULLS)
    assert sorted(r["id"] for r in truncation.truncated(df, "evidence_id", "domain", "url", "chunk").collect()) == [500, 501]
    assert truncation.truncated(ev(spark, []), "evidence_id", "domain", "url", "chunk").count() == 0


def test_marks_left_open_cut_a_text_unless_its_source_leaves_them_open(spark):
    data = pages() + [(600, "hosta-post.example", "https://hosta-post.example/y", "The clerk wrote (as ever. The town paid.")]
    neat = truncation.truncated(ev(spark, data), "evidence_id", "domain", "url", "chunk")
    assert [r["id"] for r in neat.collect()] == [600]
    slips = [(700 + i, "slips.example", f"https://slips.example/{i}", "\n".join(f"In year {w} the clerk of Aby{'abcdefghij'[i]} wrote (as ever and {w} paid it." for w in ("one", "two", "three"))) for i in range(10)]
    assert [r["id"] for r in truncation.truncated(ev(spark, data + slips), "evidence_id", "domain", "url", "chunk").collect()] == [600]


def test_sources_without_terminators_arent_cut(spark):
    poem = "\n".join(f"a line of verse that goes on and on without a stop {'abcdefghij'[i]}" for i in range(10))
    df = ev(spark, [(i, "verse.example", f"https://verse.example/{i}", poem.replace("verse", f"verse{'xyz'[i % 3] * i}")) for i in range(12)])
    assert truncation.truncated(df, "evidence_id", "domain", "url", "chunk").count() == 0


def test_token_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "a <|endoftext|> b", "x"), (5, "word " * 20_000, "x"), (5, "b", "x")], "doc_id int, text string, ids string")
    got = encode.token_ids(df, "doc_id", "text", leaf=64).collect()
    assert [len(r["ids"]) for r in got[:3]] == [0, 0, 1] and 50256 not in got[3]["ids"] and len(got) == 6
    assert encode.token_ids(df.limit(0), "doc_id", "text").count() == 0
    back = [r["text"] for r in encode.decoded_texts(encode.token_ids(df, "doc_id", "text"), "doc_id").collect()]
    assert sorted(back) == sorted(r["text"] or "" for r in df.collect())
    assert encode.decoded_texts(spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>"), "i").collect() == [(1, ""), (2, "")]


DOC = "doc_id long, text string, item_id string, coverage string"
ITEMS = [(1, "old tide tables outlast spoken pledges while kiln receipts undercut a forged stamp"), (2, "Zanzibar"), (3, None), (4, ""), (5, "two words")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_leaks(spark, limit):
    docs = [(1, f"Intro here. {ITEMS[0][1].upper()}! Then more."), (2, "nothing of it"), (3, None), (4, ""), (5, "They saw Zanzibar, in two words."), (5, "They saw Zanzibar, in two words."), (6, "old tide tables are here, kiln receipts there"), (7, "x " * 50_000 + ITEMS[0][1])]
    d = spark.createDataFrame([(*r, "c", "d") for r in docs], DOC)
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(leak.leaks(d, "doc_id", i, "item_id", broadcast_bytes=limit).select("doc_id", "item_id")) == [(1, 1), (5, 2), (5, 5), (7, 1)]
    assert leak.leaks(d.limit(0), "doc_id", i, "item_id", broadcast_bytes=limit).count() == 0
    assert leak.leaks(d, "doc_id", i.limit(0), "item_id", broadcast_bytes=limit).count() == 0


def test_fields_on_the_same_lines_are_one_class(spark):
    def name(i):
        return "".join(chr(97 + i * 7 // 26**k % 26) for k in range(4)).title()

    data = [(i, "a.example", f"https://a.example/{i}", f"The {name(i)} council met.\n" + (f"Watch: {name(i)} ({i}:10)" if i < 4 else f"Seen: {name(i)}" if i < 8 else "No more of it, they said.")) for i in range(900)]
    feats = boilerplate.spread(spark.createDataFrame(data, "id long, d string, u string, t string")).mapInArrow(boilerplate._features, boilerplate._SCHEMA)
    tokens = boilerplate._tokens(feats)
    fields = {(r["pages"], r["fields"]) for r in boilerplate._classes(tokens).filter("kind = 1").collect()}
    assert fields == {(4, 2), (4, 1)}  # Watch: and the time stand on the same lines, Seen: alone
    got = set(rows(boilerplate.template_lines(ev(spark, data), "evidence_id", "domain", "url", "chunk")))
    assert {(i, 2) for i in range(4)} <= got and not any(n == 1 for _, n in got)


def test_residue(spark):
    real = "The council met at noon and counted the boats. The clerk wrote it all down in a bulletin, as the law asks. " * 3
    docs = [(1, "Title of it\n\nError 500: internal server error\nRequest id 1234abcd"), (2, real), (3, real + "Now in {{city}}."), (4, real + "\nThe server failed with error 500 on election night."), (5, None), (6, ""), (7, "  \n"), (8, "<html><head><title>null</title></head><body><h1>null</h1></body></html>"), (9, "PLEASE ENABLE\nJAVASCRIPT TO\nCONTINUE."), (10, "<|endoftext|> ☃ 🙂"), (11, real + "\n403 Forbidden"), (1, "null")]
    df = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, id string")
    assert sorted({r["id"] for r in residue.residue(df, "doc_id", "text").collect()}) == [1, 3, 8, 9]
    assert residue.residue(df.limit(0), "doc_id", "text").count() == 0


def test_residue_in_long_lines_and_wrapped_in_long_texts(spark):
    nav = "Home News Sport Weather Culture Money Travel Opinion Video Podcasts Archive Contact Privacy Imprint Shop " * 5
    menu = "Home | News | Sport | Weather\n" * 15
    docs = [(1, nav + "Please enable JavaScript and cookies to continue"), (2, menu + "Please turn on\nJavaScript in your browser"), (3, nav + "All of it in one place.")]
    got = residue.residue(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(r["id"] for r in got) == [1, 2]


def test_residue_does_not_hang_on_batches(spark):
    docs = [(1, "The requested page was not found."), (2, "The requested page was never found."), (3, "The requested page was soon found.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    # all in one partition and batch, in both orders, and each line in a batch of its own
    for rows_a_batch, order in ((100, "doc_id"), (100, "-doc_id"), (1, "doc_id")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        one = df.selectExpr("*", f"{order} AS o").coalesce(1).sortWithinPartitions("o").drop("o")
        got.append(sorted(r["id"] for r in residue.residue(one, "doc_id", "text").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got[0] == got[1] == got[2] and 1 in got[0]
    more = [(i, f"The requested page was not found by clerk {'abcdefgh'[i % 8] * 3}.") for i in range(10, 90)] + [(100, "You will need to enable JavaScript in your browser to read"), (101, "You will need to have patience in your chair to read")]
    df = spark.createDataFrame(docs + more, "doc_id long, text string")
    by_parts = [sorted(r["id"] for r in residue.residue(df.repartition(n), "doc_id", "text").collect()) for n in (1, 7, 64)]
    assert by_parts[0] == by_parts[1] == by_parts[2] and 100 in by_parts[0] and 101 not in by_parts[0] and set(range(10, 90)) < set(by_parts[0])


def test_a_template_stays_found_as_its_host_and_the_input_grow(spark):
    def name(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    # a notice and a frame of one host's own pages, and a slot filled alike by chance
    data = [(i, "a.example", f"https://a.example/{i}", f"The {name(i)} council met.\nListed for {name(i % 500).title()}:" + ("\nTap to unmute the player" if i < 5 else "") + (f"\nRead on: the {name(i + 7)} files" if i < 5 else "")) for i in range(2000)]
    got = set(rows(boilerplate.template_lines(ev(spark, data), "evidence_id", "domain", "url", "chunk")))
    assert got == {(i, n) for i in range(5) for n in (3, 4)}
    # a frame on hosts of which each has two of its pages
    data = [(i, f"h{name(i // 2)}.example", f"https://h/{i}", f"The {name(i)} council met.\n" + (f"Read on: the {name(i + 7)} files" if i < 12 else "No more.")) for i in range(1400)]
    got = set(rows(boilerplate.template_lines(ev(spark, data), "evidence_id", "domain", "url", "chunk")))
    assert {(i, 2) for i in range(12)} <= got
