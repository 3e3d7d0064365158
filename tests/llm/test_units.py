"""The operators' parts on single texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import boilerplate, encode, leak, mojibake, residue, truncation

COMPLETE = [
    "One sentence.",
    "He said: “We never gave such an …”",
    "Listed:\n- boats from Aby: 3\n- boats from Bby: 4.",
    "Full record: https://a.example/records/3-x",
    "« Cette vidéo n’est pas la nôtre. »",
    "« Cette vidéo n’est pas la nôtre », a dit le maire.",
    "“One paragraph of it.\n“And another one,” they said.",
    "It’s 5\" long (or 6) :( and a < b, not {x}.",
    "A tag <b>bold</b> and a [link](https://a.example/x) in it.",
    "She said \"no\" and \"yes\".",
    "“They asked for the tapes.â€\x9d",
    "Ends well!) ",
    "",
    "   \n ",
]
CUT = [
    "It was sealed… [+3688 chars]",
    "It was sea…",
    "It was sealed, but the...",
    "It was sealed [...]",
    "The table from X leaves ou &am",
    "The table <a href",
    "The table [full record](https://a.example/da",
    "It ended. “",
    "Die Stadt bestätigte am 4.",
    "The word ends in S�",
    "The word ends in dÃ",
    "The table <a title='" + "x" * 900,
    "The table [full record](https://a.example/" + "x" * 900,
]


@pytest.mark.parametrize("t", COMPLETE)
def test_complete(t):
    assert truncation.judge(t)[0] == truncation.COMPLETE


@pytest.mark.parametrize("t", CUT)
def test_cut(t):
    assert truncation.judge(t)[0] == truncation.CUT


UNCLOSED = ["He said (and this is open. The town paid.", "The “council said so.", "« Cette vidéo n’est pas la nôtre.", "(according to Dr.", "“It rose by 3.", "A [note that goes on.\nAnother paragraph, whole.", 'They said "no.']


@pytest.mark.parametrize("t", UNCLOSED)
def test_unclosed(t):
    assert truncation.judge(t)[0] == truncation.UNCLOSED


# the quotation is closed, but the words in it aren't a sentence that ends
@pytest.mark.parametrize("t", ["« Cette vidéo n’est pas la nôtre »", "It was sealed and then the", "The vote recount near Abby left 33", "It was sealed,"])
def test_open(t):
    assert truncation.judge(t)[0] == truncation.OPEN


def test_stack():
    assert truncation.unclosed("a (b [c] “d") == ["(", "“"] and truncation.unclosed("„x“ (y)") == []


@pytest.mark.parametrize("page", ["cp1252", "latin_1", "cp437", "mac_roman", "cp1250", "cp1251", "koi8_r"])
@pytest.mark.parametrize("word", ["Grüntal", "déclarés", "über", "Støntuby"])
def test_utf8_read_in_a_code_page_is_restored(page, word):
    try:
        bad = word.encode().decode(page)
    except UnicodeDecodeError:
        pytest.skip("undefined byte")
    assert word in [c[0] for c in mojibake.candidates(bad)]


def test_twice_garbled_and_single_bytes():
    twice = "réparés".encode().decode("cp1252").encode().decode("cp1252")
    assert "réparés" in [c[0] for c in mojibake.candidates(twice)]
    assert "насчитали" in [c[0] for c in mojibake.candidates("насчитали".encode("cp1251").decode("latin_1"))]


@pytest.mark.parametrize("word", ["plain", "São", "SÃO", "Ângaurvador", "городе", "l’équipe", "“They", "日本", "ΑΘΗΝΑ"])
def test_sound_words_have_no_utf8_reading_with_letters(word):
    assert all(channel != "utf8" for _, channel, _ in mojibake.candidates(word))


def test_mojibake_kinds():
    assert mojibake.plausible("déjà") and not mojibake.plausible("dÃ\x83©") and not mojibake.plausible("rйgie")


def test_line_keys_and_frames():
    k = boilerplate.line_key
    assert k("  Haut  de page . ") == k("HAUT DE PAGE") == "hautdepage"
    assert k("VidÃ©o · Monde") == k("Vidéo | Monde") and k("городе 3") == "городе" and k("12 — 3") == ""
    assert boilerplate.frames("Watch: Flood in Aby (3:10)") == [("watch*", "floodinaby"), ("*(#)", "watchfloodinaby")]
    assert ("*comments", "floodinaby") in boilerplate.frames("Flood in Aby | 3 comments") and ("#.*", "x") in boilerplate.frames("3. X")
    assert boilerplate.frames("* [Flood](https://a.example/r/1)")[0][0] == "[](/)" and boilerplate.frames("A plain sentence.") == []
    assert boilerplate.menu_items("Home > Money > Sport") == ["Home", "Money", "Sport"] and boilerplate.menu_items("no menu") == []
    assert boilerplate.host_of(None, "HTTPS://www.A.example/x") == "a.example" and boilerplate.page_of("https://a.example/p/?x=1#f", "t") == "p" and boilerplate.page_of("", "A b") == "ab"


POOL = list("abc  \n\t'sdré日本1290.,!?—“”🙂<|endoftext|> 　 \x1c\r") + ["'re", "'ll", " the", "   ", "tables"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(POOL), max_size=120), st.integers(1, 40), st.integers(1, 9))
def test_pieces_join_to_the_ids_of_the_whole(parts, leaf, window):
    text = "".join(parts)
    e = encode.Encoder(leaf=leaf, window=window)
    whole = e.encoding.encode_ordinary(text)
    assert e.encode(text) == whole
    assert e.decode(whole) == text
    assert b"".join(e.encoding.decode_single_token_bytes(i) for i in whole).decode() == text


def test_joining_is_associative():
    rng = random.Random(1)
    e = encode.Encoder(leaf=8, window=2)
    a, b, c = ("".join(rng.choice(POOL) for _ in range(30)) for _ in range(3))
    x, y, z = map(e.element, (a, b, c))
    assert e.join(e.join(x, y), z) == e.join(x, e.join(y, z)) == (a + b + c, e.encoding.encode_ordinary(a + b + c))
    assert e.encode(None) == e.encode("") == [] and e.encode("<|endoftext|>") != [50256]


def test_a_very_long_text_in_time():
    e = encode.Encoder()
    assert len(e.encode("ab " * 200_000)) > 200_000 and len(e.encode("a" * 100_000)) > 1000


def lcs_share(item, doc):
    row = [0] * (len(doc) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(doc):
            new.append(row[j] + 1 if v == w else max(row[j + 1], new[j]))
        row = new
    return row[-1] / len(item)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=4, max_size=25), st.lists(st.integers(0, 12), min_size=4, max_size=40))
def test_tiles_dont_overlap_and_match(a, b):
    a, b = [f"w{x}" for x in a], [f"w{x}" for x in b]
    ua, ub = set(), set()
    for i, j, n in leak.tiles(a, b):
        assert a[i : i + n] == b[j : j + n] and n >= leak.LEAST_TILE
        assert not ua & set(range(i, i + n)) and not ub & set(range(j, j + n))
        ua |= set(range(i, i + n))
        ub |= set(range(j, j + n))


def plain_tiles(a, b):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= leak.LEAST_TILE and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return sorted(out)
        n, i, j = -best[0], best[1], best[2]
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        out.append((i, j, n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=50))
def test_tiles_are_those_of_greedy_tiling(a, b):
    a, b = [f"w{x}" for x in a], [f"w{x}" for x in b]
    assert sorted(leak.tiles(a, b)) == plain_tiles(a, b)


def test_whole_runs_are_tiled():
    words = [f"w{i}" for i in range(40)]
    for n in range(2, 41):
        assert leak.tiles(words, words[:n]) == [(0, 0, n)]


ITEM = "the old tide tables outlast spoken pledges while kiln receipts undercut a forged stamp near the quiet harbour wall at dusk"


def found(text):
    items = [(1, leak.words_of(ITEM))]
    return leak._matches(leak.words_of(text), items, leak._index(items))


def test_coverage():
    filler = " ".join(f"f{i}" for i in range(60))
    words = ITEM.split()
    assert found(f"{filler} {ITEM.upper()} {filler}")[0][1] == 1.0
    assert found(f"{filler} {' '.join(words[:11])} {filler}")  # half
    assert not found(f"{filler} {' '.join(words[:6])} {filler}")
    wrapped = "\n[00:27] ".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))
    assert found(wrapped)[0][1] > 0.9
    noisy = [w if i % 6 else f"x{i}" for i, w in enumerate(words)]
    assert found(" ".join(noisy))
    parted = f"{' '.join(words[:6])} {filler} {filler} {' '.join(words[6:12])} {filler} {filler} {' '.join(words[12:18])}"
    assert not found(parted)
    assert lcs_share(leak.words_of(ITEM), leak.words_of(parted)) > 0.8


SLOTS = ["{{ city }}", "<%= city %>", "${city}", "#{city}", "%(city)s", "{city}", "__CITY__", "@@CITY@@", "<CITY>", "[INSERT CITY]", "[claim date goes here]", "{{ city|title }}"]


@pytest.mark.parametrize("s", SLOTS)
def test_slots(s):
    assert residue.slots(f"It began in {s} on Monday.")


@pytest.mark.parametrize("s", ["the set {0, 3, 8} of gauges", "[sic]", "<|endoftext|>", "[MASK] <pad> <PAD>", "“insert name here”", "[00:12] x", 'a record {"city": "X", "mm": 3}', "<b>bold</b>", "50% of it", "a_b_c"])
def test_no_slots(s):
    assert not residue.slots(s)


@pytest.mark.parametrize("line,kind", [("Error 500: internal server error", "message"), ("Forbidden (403)", "message"), ("JavaScript is disabled. Some parts cannot be shown.", "message"), ("Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "message"), ("Your session has expired. Sign in again.", "message"), ("java.lang.NullPointerException: region is null", "output"), ("null", "value"), ("Published: [object Object]", "value"), ("TODO: add two sources", "todo"), ("Home | Contact | Privacy", "wrapper"), ("© 2016", "wrapper"), ("The server in Aby failed with error 500 on election night, and 4 ballots were counted late.", "content"), ("“Access denied” was the answer they got at the gate, the inquiry heard.", "content"), ("For two hours the archive answered every visitor with “404 Not Found”, the board said.", "content"), ("Readers who had switched JavaScript off could not open the map, so the council printed it.", "content")])
def test_classes(line, kind):
    assert residue.classify(line) == kind


def test_fillers_and_templates():
    assert residue.filler("Sample text. Sample text. Sample text.") and residue.filler("Lorem ipsum dolor sit amet") and not residue.filler("A poster showed lorem ipsum where the programme should have been.")
    tree = residue.PrefixTree()
    a = tree.add(residue.masked("Request id 2702a123 was refused by Aby at noon"))
    b = tree.add(residue.masked("Request id 99beef12 was refused by Bby at noon"))
    assert a is b and a == ["Request", "id", "<*>", "was", "refused", "by", "<*>", "at", "noon"]
    c = tree.add("You will need to enable JavaScript in your browser to read".split())
    d = tree.add("You will need to have patience in your chair to read".split())
    assert c is not d and "JavaScript" in c


def test_filler_is_sought_in_the_whole_line():
    lorem = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"
    assert residue.filler("Seven real words stand before all this: " + lorem)
    assert not residue.filler("The council met at noon and counted the boats, and the clerk wrote all of it down in a book: " + lorem)
    assert residue.slots("Now in {{ " + "city of the year " * 20 + "}}.") and residue.classify("word " * 30 + "and then the Server said at last: 500 internal server error") == "message"
    assert residue.classify(("Aaa Bbb " * 25) + "please enable JavaScript to continue.") == "message"


NAVIGATION = "Home News Sport Weather Culture Money Travel Opinion Video Podcasts Archive Contact Privacy Imprint Shop " * 5


def test_messages_after_many_words_of_a_line():
    def kind(line):
        return residue.classify(" ".join(residue.masked(line)))

    assert kind(NAVIGATION + "Please enable JavaScript and cookies to continue") == kind(NAVIGATION + "500 Internal Server Error") == "message"
    assert kind("The council met at noon and counted the boats. The clerk wrote it all down. " * 5 + "Then readers had to enable JavaScript to see it.") == "content"
    assert kind("the boats came in and the clerk counted them all " * 8 + "and then something went wrong with the ferry") == "content"


def test_messages_wrapped_over_lines_of_a_long_text():
    menu = ["Home | News | Sport | Weather"] * 15
    assert residue.wrapped_lines([*menu, "Flood in Aby", "Please turn on", "JavaScript in your browser"]) == {16, 17}
    assert residue.wrapped_lines([*menu, "The council met at noon.", "JavaScript Weekly came out on Monday."]) == set()
    # no message ends where the first words of a line do
    assert residue.classify("The board said at length that it had no word of it. " * 3 + "For many days all the archive ever answered was 404 Not Found and then nothing at all") == "content"


def test_templates_hide_no_telling_word():
    lines = ["The requested page was never found.", "The requested page was not found."]
    assert residue._verdicts([(i, 1, x) for i, x in enumerate(lines)])[-1] == (1, 1, "message")
    tree = residue.PrefixTree()
    assert tree.add("a b c d “e f g h i j".split()) is not tree.add("a b c d e f g h i j".split())
