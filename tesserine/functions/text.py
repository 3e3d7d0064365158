"""Strings as Column expressions: tokens, n-grams, shingles, redaction and parsing of labelled texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'-]*"
WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what lambdas refer to outside is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeezed(col: Column) -> Column:
    """White space made single blanks, trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def clean_claim(col: Column) -> Column:
    return F.regexp_replace(squeezed(col), "^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", "")


def excerpt(col: Column, limit: int = 420) -> Column:
    """At most ``limit`` characters of the squeezed text, then an ellipsis."""
    s = squeezed(col)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("…")))


def sentences(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def numeric_details(col: Column) -> Column:
    """Distinct numbers of one to four digits."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(r"(?<![A-Za-z0-9_])(\d{1,4})(?![A-Za-z0-9_])"), 1))


def numbers(col: Column) -> Column:
    """Distinct numbers and percentages in their order."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(r"(?<![A-Za-z0-9_])(\d+(?:\.\d+)?%?)"), 1))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(f"({TOKEN})"), 1)


def keywords(col: Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct content words in their order: of three letters, or two characters with a digit; no stop words."""
    return F.array_distinct(F.filter(tokens(col), lambda w: (F.length(w) >= 2) & ((F.length(w) >= 3) | w.rlike(r"[^\p{L}]")) & ~w.isin(*stopwords)))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words; none where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(col: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of n words in lower case, in any script; shorter texts are one shingle, empty ones have none."""
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all(F.lower(col), F.lit(f"({WORD})"), 1)
    return let(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(ngrams(w, n))).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(none))


def shingle_hashes(col: Column, n: int = SHINGLE) -> Column:
    """The shingles as distinct 64-bit hashes, sorted: of the hashes of n words, so no strings are put together."""
    none = F.array().cast("array<bigint>")
    words = F.transform(F.regexp_extract_all(F.lower(col), F.lit(f"({WORD})"), 1), lambda w: F.xxhash64(w))

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        return F.when(F.size(w) >= n, F.array_sort(F.array_distinct(F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)

    return let(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common))


def stem(word: Column) -> Column:
    """Without the first of ings, ing, edly, ed, es, s that leaves three letters."""
    out = word
    for end in reversed(("ings", "ing", "edly", "ed", "es", "s")):
        out = F.when(word.endswith(end) & (F.length(word) - len(end) > 2), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def keyword_forms(word: Column) -> Column:
    """Sorted simple English forms of a content word."""
    w = F.lower(F.trim(word))
    n = F.length(w)

    def cut(k: int, add: str = "") -> Column:
        return F.concat(F.substring(w, F.lit(1), n - k), F.lit(add))

    forms = F.array(
        w,
        F.when(w.endswith("ies") & (n > 4), cut(3, "y")),
        F.when(w.rlike("(?:ses|xes|zes)$"), cut(2)),
        F.when(w.endswith("s") & ~w.endswith("ss") & (n > 3), cut(1)),
        F.when(w.endswith("ed") & (n > 4), cut(2)),
        F.when(w.endswith("ed") & (n > 4), cut(1)),
        F.when(w.endswith("ing") & (n > 5), cut(3)),
        F.when(w.endswith("ing") & (n > 5), cut(3, "e")),
    )
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(forms), lambda f: f != "")))


def phrases(col: Column, stopwords: tuple[str, ...], limit: int = 6) -> Column:
    """Runs of three, then two keywords; those with a digit, more words, then more characters first."""
    def chosen(t: Column, known: Column) -> Column:
        runs = F.array_distinct(F.concat(ngrams(t, 3), ngrams(t, 2)))
        good = F.filter(runs, lambda r: F.forall(F.split(r, " "), lambda w: F.array_contains(known, w)))
        keyed = F.transform(good, lambda r, i: F.struct((~r.rlike("[0-9]")).cast("int").alias("a"), (-F.size(F.split(r, " "))).alias("b"), (-F.length(r)).alias("c"), i.alias("i"), r.alias("r")))
        return F.transform(F.slice(F.array_sort(keyed), 1, limit), lambda s: s["r"])

    return let(F.struct(tokens(col).alias("t"), keywords(col, stopwords).alias("k")), lambda x: chosen(x["t"], x["k"]))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """The phrase stands in the text as whole words, case aside; false for an empty one."""
    hit = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(phrase), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))
    return F.coalesce(hit & (F.trim(phrase) != ""), F.lit(False))


def normalize_shouting(col: Column, acronyms: tuple[str, ...] = ()) -> Column:
    """Words of three and more capitals with a capital first only, acronyms aside."""
    return F.array_join(F.transform(F.split(col, " "), lambda w: F.when(w.rlike(r"^[A-Z]{3,}[.,;:!?]*$") & ~F.regexp_replace(w, "[^A-Z]", "").isin(*(acronyms or ("",))), F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, F.lit(2), F.length(w))))).otherwise(w)), " ")


# What counts as sensitive, as results must take out the same: prefixes of account ids and of keys of
# providers, the scheme of tokens, and names before a colon or an equals sign that a secret follows.
ACCOUNTS = ("org", "proj")
KEYS = ("gsk", "sk", "xai", "groq", "tvly", "tavily")
SECRET_NAMES = ("api[_-]?key", "apikey", "secret", "token", "password", "authorization")
KEY_LENGTH, ACCOUNT_LENGTH = 12, 6


def redact(col: Column) -> Column:
    """Account ids, provider keys, bearer tokens and named secrets taken out: the name stays, the value goes."""
    keys = rf"(?i)\b(?:{'|'.join(KEYS)})[-_][\w-]{{{KEY_LENGTH},}}"
    bearer = rf"(?i)\bbearer\s+[\w.-]{{{KEY_LENGTH},}}"
    named = rf"(?i)\b({'|'.join(SECRET_NAMES)})\s*[:=]\s*\S+"
    account = rf"\b({'|'.join(ACCOUNTS)})_[A-Za-z0-9]{{{ACCOUNT_LENGTH},}}\b"
    out = F.regexp_replace(F.regexp_replace(col, keys, "[redacted-key]"), bearer, "Bearer [redacted]")
    return F.regexp_replace(F.regexp_replace(out, named, "$1=[redacted]"), account, "$1_[redacted]")


def case_id(kind: Column, ident: Column, length: int = 10) -> Column:
    return F.concat(F.lit("TL-"), F.upper(F.substring(F.sha2(F.concat(kind, F.lit(":"), ident), 256), 1, length)))


def section(col: Column, heading: str) -> Column:
    """What follows a heading with a colon up to the next line that is a heading, squeezed."""
    return squeezed(F.regexp_extract(col, rf"(?is)(?:^|\n)\s*{heading}\s*:\s*(.*?)(?=\n\s*[A-Z][A-Za-z ]{{2,40}}:|$)", 1))


def confidence(col: Column) -> Column:
    """A labelled number of 0 to 100, else the first percentage, else null."""
    labelled = F.regexp_extract(col, r"(?i)confidence[^0-9]{0,20}(\d{1,3}(?:\.\d+)?)", 1)
    first = F.regexp_extract(col, r"(\d{1,3}(?:\.\d+)?)\s*%", 1)
    n = F.expr("null").cast("double")
    for c in (first, labelled):
        v = F.when(c != "", c).try_cast("double")
        n = F.when(v.between(0, 100), v).otherwise(n)
    return n


def reference(col: Column) -> Column:
    """``url | domain | excerpt`` as a struct; missing parts are null."""
    parts = F.transform(F.split(col, r"\|"), lambda s: F.trim(s))
    return F.struct(F.get(parts, F.lit(0)).alias("url"), F.get(parts, F.lit(1)).alias("domain"), F.get(parts, F.lit(2)).alias("excerpt"))


def has_marker(col: Column, markers: tuple[str, ...]) -> Column:
    """One of the markers stands in the text, case aside; false for null."""
    return F.coalesce(F.lower(col).rlike("|".join(rf"\Q{m.lower()}\E" for m in markers)), F.lit(False)) if markers else F.lit(False)


def contains_keyword(words: Column, keyword: Column) -> Column:
    """A simple form of the keyword is among the words of a text (``tokens``); false for null."""
    return F.coalesce(F.arrays_overlap(words, keyword_forms(keyword)), F.lit(False))


def contains_phrase_nearly(words: Column, phrase: Column) -> Column:
    """The words of a phrase stand in a row among ``words``, in any simple form, but one of them at most; two at least do."""
    parts = F.split(F.lower(phrase), " ")
    n = F.size(parts)
    forms = F.transform(parts, keyword_forms)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))

    def hits(i: Column) -> Column:
        return F.size(F.filter(F.zip_with(F.slice(words, i, n), forms, lambda w, f: F.array_contains(f, w)), lambda hit: hit))

    near = F.exists(starts, lambda i: hits(i) >= F.greatest(n - 1, F.lit(2)))
    return F.coalesce((F.size(words) >= n) & near, F.lit(False))


def without_dates(col: Column, found: Column) -> Column:
    """The text without the spellings of the dates found in it and a preposition before them, squeezed; null stays null."""
    spellings = F.transform(found, lambda d: F.concat(F.lit(r"(?i)(?:\b(?:on|in|at|during|since)\s+)?\Q"), d["raw"], F.lit(r"\E")))
    return squeezed(F.aggregate(F.coalesce(spellings, F.array().cast("array<string>")), col, lambda t, p: F.regexp_replace(t, p, " ")))


def labelled(col: Column, label: str, values: tuple[str, ...]) -> Column:
    """The last of the values, in capitals, that follows the label and a colon or dash, else the last alone on a line, else null."""
    known = F.array(*(F.lit(v.upper()) for v in values))

    def last_known(words: Column) -> Column:
        return F.try_element_at(F.filter(words, lambda w: F.array_contains(known, w)), F.lit(-1))

    high = F.upper(col)
    # what stands behind each label, down to its first word
    behind = F.transform(F.split(high, rf"{label.upper()}\s*[:-]"), lambda x, i: F.when(i > 0, F.regexp_extract(x, r"^[\s*]*(\w+)", 1)))
    lines = F.transform(F.split(high, "\n"), lambda x: F.regexp_replace(x, r"[\s*]+", ""))
    return F.coalesce(last_known(behind), last_known(lines))


def list_section(col: Column, heading: str) -> Column:
    """The entries under a heading with a colon, one a line without their marks, up to the next heading; "none" is no entry."""
    body = F.regexp_extract(col, rf"(?is)(?:^|\n)\s*{heading}\s*:\s*(.*?)(?=\n\s*[A-Z][A-Za-z ]{{2,40}}:|$)", 1)
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-•*]\s*", "")))
    return F.filter(lines, lambda x: (x != "") & (F.lower(x) != "none"))
