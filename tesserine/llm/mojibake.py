"""Text garbled by a wrong decoding: found and restored word by word over a noisy channel.

Channel: a text in one code page was read in another one, once or more often, or bytes were lost. For each distinct word
with characters beyond ASCII a lattice over its bytes is built: an arc is a character as it stands, a run of characters
whose bytes in a code page form one UTF-8 character, such a run that lacks its last bytes, with a wildcard for them, or
a mark of lost bytes, with a wildcard for one character. A Viterbi search finds the best path of each code page under
the pairs of characters of the corpus. Paths, and words of the corpus that fit what is left beside lost bytes, are
weighed by how often they and the word as it stands occur in the corpus. Words are judged once, whatever the number of
rows, and the verdicts go back to the rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.skew import keyed_join
from tesserine.session import spread, written

# Code pages that texts are read in by mistake, and those they were written in.
READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_15", "cp1254")
WRITTEN_IN = ("cp1251", "koi8_r", "cp866", "cp1252", "mac_roman", "iso8859_2", "cp1250")
# Marks that occur in sound text beside letters and ASCII.
TYPOGRAPHIC = frozenset("“”‘’„‚«»‹›—–−…·•°€£§©®™×½¼¾¿¡ºªµ²³±´№☰→←✓★  ")
# East Asian code pages that UTF-8 was read in by mistake; their characters are of two bytes.
READ_AS_PAIRS = ("gbk", "big5", "shift_jis", "euc_kr")
CYRILLIC_PAGES = frozenset(("cp1251", "koi8_r", "cp866", "mac_cyrillic"))
LOST = "�"
#: How much more often a candidate must occur than the word as it stands.
ODDS_UTF8, ODDS_BYTES, ODDS_DASH = 2, 5, 50
#: The same for words with lost bytes: how much more often the best word that fits must occur than the next one.
ODDS_LOST = 4
#: Log-probabilities of the channel: a character as it stands, a run of UTF-8, one whose last bytes are gone, a lost character; of a pair of
#: characters that the corpus hasn't.
AS_IS, RUN, DROPPED, WILD, UNSEEN = -14.0, -0.01, -7.0, -3.0, -9.0
# First bytes of UTF-8 whose last byte may be missing: Latin and Cyrillic letters.
LEADS = (0xC3, 0xC5, 0xD0, 0xD1)


@lru_cache(maxsize=None)
def _page(name: str) -> tuple[str, dict[str, int]]:
    chars = "".join(bytes([b]).decode(name, "replace").replace(LOST, chr(b)) for b in range(256))
    inverse: dict[str, int] = {}
    for b, c in enumerate(chars):
        inverse.setdefault(c, b)
    return chars, inverse


def read_as(text: str, page: str) -> str:
    """The text's UTF-8 bytes read in a code page."""
    chars = _page(page)[0]
    return "".join(chars[b] for b in text.encode("utf-8"))


@lru_cache(maxsize=None)
def _arcs(name: str) -> re.Pattern:
    """Characters of the code page that start a run of UTF-8, where it goes on or breaks off."""
    chars = _page(name)[0]
    return re.compile("[" + re.escape(chars[0xC2:0xF5]) + "](?:[" + re.escape(chars[0x80:0xC0]) + "]|$|[\\x00-\\x7f])")


@lru_cache(maxsize=None)
def _of_lead(lead: int) -> tuple[str, ...]:
    return tuple(c for tail in range(0x80, 0xC0) if (c := bytes((lead, tail)).decode("utf-8", "ignore")).isalpha())


class Pairs:
    """Log-probabilities of pairs of characters, and the characters beyond ASCII, of sound words; empty without counts."""

    def __init__(self, counts: dict[str, int] | None = None):
        counts = counts or {}
        first: dict[str, int] = {}
        for ab, n in counts.items():
            first[ab[0]] = first.get(ab[0], 0) + n
        self.log = {ab: math.log(n / first[ab[0]]) for ab, n in counts.items()}
        self.beyond = tuple(sorted({ab[1] for ab in counts if ab[1] > "\x7f"}))

    def __call__(self, a: str, b: str) -> float:
        return self.log.get(a + b, UNSEEN)


START, END = "\x02", "\x03"


def arcs(word: str, page: str, pairs: Pairs) -> list[list[tuple[int, str, float, int, int]]]:
    """The lattice: from each place of the word ``(next place, character, log-probability, run, dropped)``."""
    inverse = _page(page)[1]
    values = [ord(c) if c < "\x80" else inverse.get(c, -1) for c in word]
    out: list[list[tuple[int, str, float, int, int]]] = []
    for i, c in enumerate(word):
        if c < "\x80":
            out.append([(i + 1, c, 0.0, 0, 0)])
            continue
        if c == LOST:
            # a byte of its own, or one of the two that a letter has
            wild = [(i + 1, x, WILD, 0, 1) for x in pairs.beyond]
            out.append(wild + [(i + 2, x, WILD, 0, 1) for x in pairs.beyond if word[i + 1 : i + 2] == LOST] or [(i + 1, c, AS_IS, 0, 0)])
            continue
        here = [(i + 1, c, AS_IS, 0, 0)]
        lead = values[i]
        size = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        tail = values[i + 1 : i + size] if size else []
        if size and len(tail) == size - 1 and all(0x80 <= v < 0xC0 for v in tail):
            try:
                here.append((i + size, bytes((lead, *tail)).decode("utf-8"), RUN, 1, 0))
            except UnicodeDecodeError:
                pass
        elif lead in LEADS:
            here += [(i + 1, x, DROPPED, 1, 1) for x in _of_lead(lead)]
        out.append(here)
    return out


def viterbi(word: str, page: str, pairs: Pairs) -> tuple[str, int, int]:
    """The best path through the lattice, the runs of several bytes taken and those with a wildcard."""
    lattice = arcs(word, page, pairs)
    best: list[dict[str, tuple[float, str, int, int]]] = [{} for _ in range(len(word) + 1)]
    best[0][START] = (0.0, "", 0, 0)
    for i, here in enumerate(lattice):
        for last, (score, said, runs, dropped) in best[i].items():
            for to, c, p, run, wild in here:
                s = score + p + pairs(last, c)
                held = best[to].get(c)
                if held is None or (s, said) > held[:2]:
                    best[to][c] = (s, said + c, runs + run, dropped + wild)
    ends = [(score + pairs(last, END), said, runs, dropped) for last, (score, said, runs, dropped) in best[-1].items()]
    return max(ends)[1:]


def _in_pairs(word: str) -> str | None:
    """A word of which an East Asian code page made two-byte characters, as UTF-8."""
    for page in READ_AS_PAIRS:
        try:
            return word.encode(page).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return None


def _as_bytes(word: str, read: str, wrote: str) -> str | None:
    chars, inverse = _page(wrote)[0], _page(read)[1]
    try:
        return "".join(c if c < "\x80" else chars[inverse[c]] for c in word)
    except KeyError:
        return None


@lru_cache(maxsize=8192)
def _kind(c: str) -> str:
    """Of a character: a letter's script, 'mark' or 'punct' of sound text, or 'odd'."""
    if c < "\x80":
        return "LATIN" if c.isalpha() else "punct"
    if c in TYPOGRAPHIC:
        return "punct"
    cat = unicodedata.category(c)
    if cat[0] == "L":
        script = unicodedata.name(c, "?").split()[0]
        return script if script in ("LATIN", "CYRILLIC", "GREEK") else "odd"
    return "mark" if cat[0] == "M" else "odd"


def plausible(word: str) -> bool:
    """Made of ASCII, typographic marks and the letters of one script in an even case, accents on letters that bear them."""
    kinds = {_kind(c) for c in word} - {"punct", "mark"}
    if len(kinds) > 1 or "odd" in kinds:
        return False
    if not word.isascii() and any("\u0300" <= c < "\u0370" for c in word) and any("\u0300" <= c < "\u0370" for c in unicodedata.normalize("NFC", word)):
        return False
    letters = "".join(c for c in word if c.isalpha())
    rest = letters[1:]
    return rest == rest.lower() or letters == letters.upper() or not re.search(r"[^\W\d_][a-zà-ÿа-я][A-ZÀ-ÞА-Я]{2}|[a-zà-ÿа-я][À-ÞА-Я]", word)


def core(word: str) -> str:
    """From the first to the last letter."""
    at = [i for i, c in enumerate(word) if c.isalpha()]
    return word[at[0] : at[-1] + 1] if at else ""


def shapes(word: str) -> tuple[str, str]:
    """The word with the number of characters, and of bytes in UTF-8, in place of each run beyond ASCII."""
    return tuple(k + _BEYOND.sub(lambda m, k=k: f"\x01{len(m.group()) if k == 'c' else len(m.group().encode())}\x01", word) for k in "cb")


def lost_shapes(word: str) -> tuple[str, ...]:
    """The shapes of words that fit a word with lost bytes; none without a letter or digit, as any word would fit.

    Bytes that are lost one by one stand for as many characters, or for those of so many bytes.
    """
    bare = _LOST_RUN.sub(lambda m: f"\x01{len(m.group())}\x01", word)
    return ("c" + bare, "b" + bare) if re.search(r"[A-Za-z0-9]", word) and bare.isascii() else ()


_BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Lost bytes: their mark, or a question mark between letters.
_LOST_RUN = re.compile(f"{LOST}+|(?<=[^\\W\\d_])\\?+(?=[^\\W\\d_])")


def candidates(word: str, pairs: Pairs | None = None) -> list[tuple[str, str, int]]:
    """``(restored, channel, weight)`` of each plausible restoration; channel utf8, dropped or bytes; weight: runs taken."""
    pairs = pairs or Pairs()
    out: dict[str, tuple[str, int]] = {}
    for page in READ_AS:
        if not _arcs(page).search(word):
            continue
        once, n, dropped = viterbi(word, page, pairs)
        if not n:
            continue
        lone = page in CYRILLIC_PAGES and n == 1
        if plausible(once) and not (lone and any(_kind(c) == "CYRILLIC" for c in once) and len(once) > 1):
            out.setdefault(once, ("dropped" if dropped else "utf8", n))
        for again in dict.fromkeys(("cp1252", "latin_1", page)):
            last, gone = once, dropped
            # whole runs make a word shorter, so this ends
            while _arcs(again).search(last):
                twice, m, more = viterbi(last, again, pairs)
                gone += more
                if not m or len(twice) >= len(last):
                    break
                if plausible(twice):
                    out.setdefault(twice, ("dropped" if gone else "utf8", n + m))
                last = twice
    if any(_kind(c) == "odd" for c in word) and any("a" <= c.lower() <= "z" for c in word):
        wide = _in_pairs(word)
        if wide and wide != word and plausible(wide):
            out.setdefault(wide, ("utf8", 1))
    for read in READ_AS:
        for wrote in WRITTEN_IN:
            if read != wrote:
                a = _as_bytes(word, read, wrote)
                if a is not None and a != word and a not in out and plausible(a) and any(c.isalpha() or c in "“”’„—–" for c in a):
                    out[a] = ("bytes", 1)
    return [(a, *v) for a, v in out.items()]


def unreadable(word: str) -> bool:
    """No sound word, as it has runs of UTF-8 read in a Western code page; what it was can't be told."""
    return not plausible(word) and any(viterbi(word, page, Pairs())[1:] >= (2, 0) for page in ("cp1252", "latin_1") if _arcs(page).search(word))


def _judge(counts: Broadcast):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Pairs(counts.value)
        for b in batches:
            rows = []
            for w, n in zip(b["word"], b["n"]):
                if _LOST_RUN.search(w):
                    rows += [(w, n, core(w), None, None, "lost", LOST in w, k) for k in lost_shapes(w) or ("",)]
                    continue
                odd = not plausible(w)
                found = candidates(w, pairs)
                rows += [(w, n, core(w), a, core(a), channel, odd, None) for a, channel, _ in found]
                if odd and not any(x[1] == "utf8" for x in found) and unreadable(w):
                    rows.append((w, n, core(w), None, None, "unread", True, None))
            yield pd.DataFrame(rows, columns=["word", "n", "core", "fixed", "fixed_core", "channel", "odd", "shape"])

    return run


_JUDGED = "word string, n long, core string, fixed string, fixed_core string, channel string, odd boolean, shape string"


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of characters of sound words; letters of other alphabets than the Latin, Greek and Cyrillic ones are left out."""
    for b in batches:
        out: Counter = Counter()
        for w, n in zip(b["word"], b["n"]):
            if LOST not in w and plausible(w) and all(ord(c) < 0x250 or 0x370 <= ord(c) < 0x460 or c in TYPOGRAPHIC for c in w):
                for ab in zip(START + w, w + END):
                    out["".join(ab)] += n
        yield pd.DataFrame(list(out.items()), columns=["pair", "n"])


def suspect_words(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, word)``: each distinct word of a row that has a character beyond ASCII, or a question mark between letters
    and no mark of an address; words part at ASCII white space."""
    asked = F.col(text).contains("?") & F.col(text).rlike(r"\p{L}\?\p{L}")
    beyond = df.filter(F.col(text).isNotNull() & ((F.length(text) != F.octet_length(text)) | asked)).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    words = F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: (F.length(w) != F.octet_length(w)) | (w.contains("?") & w.rlike(r"^[^/=&.@:]*\p{L}\?\p{L}"))))
    return spread(beyond).select("id", F.explode(words).alias("word"))


def _beyond(c: str) -> Column:
    return F.length(c) != F.octet_length(c)


def garbled_words(words: DataFrame) -> DataFrame:
    """``(word, n, fixed)`` of the garbled ones among ``(id, word)``; ``fixed`` is null where the original isn't won back.

    A restoration from UTF-8 is taken if it occurs at least twice as often as the word (its letters, or the word as it
    stands), or has no letters beyond ASCII, or the word can't be sound text; one with a wildcard for a dropped byte
    only if the corpus has it twice as often; one between single-byte code pages if it
    occurs five times as often and has three letters, or is a mark that occurs fifty times as often. Words with marks of
    lost bytes are garbled in any case; they take the word of the corpus that fits the rest, with as many characters or
    bytes as were lost, if it occurs four times as often as any other one that fits, and else stay as they are. A
    question mark between letters is a lost character only where such a word is found.
    """
    freq = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    spark = words.sparkSession
    # pairs of some hundred characters at most, not of all words
    counts = {r["pair"]: r["n"] for r in freq.mapInPandas(_pair_counts, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    judged = written(freq.repartition(parts, "word").mapInPandas(_judge(spark.sparkContext.broadcast(counts)), _JUDGED), "judged")
    # letters in ASCII and words without letters are no key: each such word looks for one that isn't there
    none = F.concat(F.lit("\x04"), F.col("word"))
    cores = freq.mapInPandas(_cores, "core string, n long").groupBy("core").agg(F.sum("n").alias("core_n"))
    decoded = judged.filter("fixed is not null").drop("shape")
    lookup = decoded.join(freq.select(F.col("word").alias("fixed"), F.col("n").alias("fixed_n")), "fixed", "left")
    lookup = lookup.withColumn("_fc", F.when(_beyond("fixed_core"), F.col("fixed_core")).otherwise(none)).withColumn("_c", F.when(_beyond("core"), F.col("core")).otherwise(none))
    lookup = lookup.join(cores.withColumnsRenamed({"core": "_fc", "core_n": "fixed_core_n"}), "_fc", "left").join(cores.withColumnRenamed("core", "_c"), "_c", "left")
    letters = F.length(F.regexp_replace("fixed_core", r"[^\p{L}]", ""))
    seen = F.greatest(F.coalesce("fixed_n", F.lit(0)), F.when(letters >= F.when(F.col("channel") == "bytes", 3).otherwise(2), F.coalesce("fixed_core_n", F.lit(0))).otherwise(F.lit(0)))
    stands = F.greatest("n", F.coalesce("core_n", F.lit(0)))
    by_utf8 = (F.col("channel") == "utf8") & ((seen >= stands * ODDS_UTF8) | ~_beyond("fixed_core") | (F.col("odd") & (letters >= 2)))
    by_dropped = (F.col("channel") == "dropped") & (seen >= stands * ODDS_UTF8) & (letters >= 2)
    # one or two letters are no evidence, but a dash that stands alone may be, as it is so much more frequent
    shape = (letters >= 3) & (F.length("fixed_core") * 2 >= F.length("fixed")) | (F.col("fixed_core") == "") & (seen >= stands * ODDS_DASH)
    by_bytes = (F.col("channel") == "bytes") & (seen >= stands * ODDS_BYTES) & shape
    taken = lookup.filter(by_utf8 | by_dropped | by_bytes).withColumn("seen", seen)
    restored = taken.groupBy("word").agg(F.max("n").alias("n"), F.max_by("fixed", F.struct("seen", F.col("channel") == "utf8", "fixed")).alias("fixed"))
    unread = judged.filter("channel = 'unread'").select("word", "n", F.lit(None).cast("string").alias("fixed")).join(restored.select("word"), "word", "left_anti")
    # shapes without a letter or digit are looked for by no word
    shaped = freq.mapInPandas(_shapes, "shape string, fitting string, of long")
    lost = judged.filter("channel = 'lost'").select("word", "n", "odd", "shape")
    fits = lost.filter("shape <> ''").join(shaped, "shape").groupBy("word", "fitting").agg(F.max("of").alias("of"))
    ranked = fits.groupBy("word").agg(F.max(F.struct("of", "fitting")).alias("first"), F.sum("of").alias("all"))
    clear = ranked.filter(F.col("first.of") >= ODDS_LOST * (F.col("all") - F.col("first.of"))).select("word", F.col("first.fitting").alias("fixed"))
    mended = lost.select("word", "n", "odd").distinct().join(clear, "word", "left").filter("odd or fixed is not null").select("word", "n", "fixed")
    return restored.unionByName(unread).unionByName(mended)


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        x = pd.DataFrame({"core": [core(w) for w in b["word"]], "n": b["n"]})
        yield x[[not c.isascii() for c in x["core"]]]


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, w, n) for w, n in zip(b["word"], b["n"]) if not _LOST_RUN.search(w) and re.search(r"[A-Za-z0-9]", w) and plausible(w) for k in shapes(w)]
        yield pd.DataFrame(rows, columns=["shape", "fitting", "of"])


def garbled_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, word, fixed)``: each garbled word of each row. Null and empty texts, and those in ASCII, have none.

    An empty table gives no row; rows repeated count again in the frequencies. Words go whole through one task each, so
    a text of any length is handled; nothing but the distinct words is sent to Python.
    """
    words = suspect_words(df, id_col, text)
    bad = written(garbled_words(words), "garbled")
    return keyed_join(words, bad, ["word"], "n", F.xxhash64("id"), row_bytes=128)


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for t, pairs in zip(b["text"], b["pairs"]):
            fixes = {p["word"]: p["fixed"] for p in pairs if p["fixed"] is not None}
            out.append(re.sub(r"[^ \t\n\x0b\f\r]+", lambda m, fixes=fixes: fixes.get(m.group(), m.group()), t))
        yield pd.DataFrame({"id": b["id"], "restored": out, "n_garbled": [len(p) for p in b["pairs"]], "n_lost": [sum(x["fixed"] is None for x in p) for p in b["pairs"]]})


def restored_texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, restored, n_garbled, n_lost)`` of each garbled row; ``n_lost`` words stay as they are."""
    bad = garbled_rows(df, id_col, text).groupBy("id").agg(F.collect_list(F.struct("word", "fixed")).alias("pairs"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(bad, "id")
    return rows.mapInPandas(_restore, "id long, restored string, n_garbled int, n_lost int")
