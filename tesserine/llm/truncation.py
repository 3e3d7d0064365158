"""Texts cut off by a field limit or in transfer, found by structural completeness.

A stack automaton runs over the whole text: quotation marks, brackets, tags and links it opens must be closed at its
end, or else the text is cut, unless the paragraphs of its source leave marks open as often. A mark of a cut, or a
link, tag, character reference, escape or multibyte sequence that breaks off at the end, settles the case. What closes
all marks must end in a terminator, if the paragraphs of its source as a rule do so; lists, addresses and page parts
end without one, and speech may trail off inside its quotation marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.boilerplate import template_lines
from tesserine.llm.mojibake import READ_AS, read_as
from tesserine.operators.skew import keyed_join
from tesserine.session import spread, written

#: Share of a source's inner paragraphs that must end in a terminator for a missing one to count, and the weight in
#: paragraphs of the share over all sources, for sources with few.
BASELINE, PRIOR = 0.5, 20
#: List entries end in a digit, a letter or another character; an ending rarer than this among entries is a cut.
ENTRY_SHARE = 0.1
#: Marks left open count where a source has so many times the texts with such marks that its inner paragraphs let expect.
OVER_SLIPS = 2
#: Paragraphs, which make the baselines, are longer than headings and list entries.
PARAGRAPH_LENGTH = 40

# What pairs of marks open and close.
PAIRS = {"“": "”“", "„": "“”", "«": "»", '"': '"', "(": ")", "[": "]", "{": "}", "<": ">"}
_MARKS = re.compile(r"[“”„«»\"()\[\]{}<>]|\n\s*")
_TAG = re.compile(r"<(?:[/!]?[A-Za-z]|!--)")
_CLOSERS = frozenset(".,;:!?)]}")
_QUOTES = frozenset("“„«\"")
_CUT_MARK = re.compile(r"(?:\[\s*\+\s*\d[\d,. ]*\s*(?:chars?|characters?|more)?\s*\]|[\[(]\s*(?:truncated|cut|more|…|\.{3})\s*[\])]|(?:…|\.{3})\s*(?:read|show|see) more)\s*$", re.I)
_ENDED = re.compile(r"[.!?。！？؟।](?:[^\sA-Za-z0-9]*|\s?[»”“\"'’)\]]{1,2})\s*$")
_TRAILS = re.compile(r"(?:…|\.{3})\s?(?:[”“»\"’')]|[^\sA-Za-z0-9.…]+)\s*$")
_ELLIPSIS = re.compile(r"(?:…|\.{3,})\s*$")
_BROKEN_REF = re.compile(r"(?<![A-Za-z])&(?:#x?[0-9a-f]{0,6}|[a-z]{1,8})$", re.I)
_BROKEN_TAG = re.compile(r"<(?:/?[a-z][^<>]*|!--[^>]*)?", re.I)
_BROKEN_LINK = re.compile(r"\]\([^()\s]*")
_BROKEN_BYTES = re.compile(r"(?:(?<=[^\W\d_])�+|[ÂÃÐÑ]|â€?)$")
_SENTENCE = re.compile(r"[.!?]\s+[^\W\d_a-z]")
_OPENED = re.compile(r"(?:^|\s)[“„«(\[{]$")
_ORDINAL = re.compile(r"\b(?:am|vom|zum|den|dem)\s\d{1,2}\.$", re.I)
_BROKEN_ESCAPE = re.compile(r"(?:\\u[0-9a-f]{0,3}|\\x[0-9a-f]?|\\|%[0-9a-f]?)$", re.I)
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+$", re.I)
_ENTRY = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])\s+\S")
COMPLETE, CUT, OPEN, ENTRY, UNCLOSED = 0, 1, 2, 3, 4


def _garbled_marks() -> dict[str, str]:
    """Quotation marks read once or twice in a wrong code page, and what they are."""
    out: dict[str, str] = {}
    for mark in "“”„«»’":
        for page in READ_AS:
            once = read_as(mark, page)
            for seen in (once, read_as(once, page)):
                if seen != mark:
                    out.setdefault(seen, mark)
    return out


_GARBLED = _garbled_marks()
_GARBLED_MARK = re.compile("|".join(map(re.escape, sorted(_GARBLED, key=len, reverse=True))))


def unclosed(text: str) -> list[str]:
    """What the automaton's stack holds at the end of the text.

    A mark opens where it stands before something and after nothing it could close; within a word it is a wrong
    decoding's. A paragraph that opens the quotation marks of the one before anew goes on with them. A closing mark
    without its opening one is passed over; one that closes an outer mark closes those within.
    """
    if not text.isascii():
        text = _GARBLED_MARK.sub(lambda m: _GARBLED[m.group()], text)
    stack: list[str] = []
    lead = True
    for m in _MARKS.finditer(text):
        c, at = m.group()[0], m.start()
        if c == "\n":
            lead = True
            continue
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        first, lead = lead and not text[text.rfind("\n", 0, at) + 1 : at].strip(), False
        if c in PAIRS and c != "<" and after not in _CLOSERS and (after.strip() or (after and c in "«\"")) and not before.isalnum() and (c not in _QUOTES or not before.strip() or before in "([{—–-:,;“„«'’\"") and not (c == "(" and before in (":", ";")):
            if c in _QUOTES and c in stack and (first or c == '"'):
                if not first:
                    del stack[stack.index(c) :]
                continue
            if not (c == "“" and "„" in stack):
                stack.append(c)
                continue
        elif c == "<":
            if _TAG.match(text, at):
                stack.append(c)
            continue
        for i in range(len(stack) - 1, -1, -1):
            if c in PAIRS[stack[i]]:
                del stack[i:]
                break
    return stack


def broken(last: str) -> bool:
    """A link, tag, character reference, escape or multibyte sequence breaks off at the end."""
    escape = _BROKEN_ESCAPE.search(last) and not re.search(r"\d\s?%$", last)
    tag, link = last.rfind("<"), last.rfind("](")
    return bool(escape or _BROKEN_REF.search(last) or _BROKEN_BYTES.search(last) or (tag >= 0 and _BROKEN_TAG.fullmatch(last, tag)) or (link >= 0 and "[" in last[:link] and _BROKEN_LINK.fullmatch(last, link)))


def judge(text: str) -> tuple[int, str, int, int, int]:
    """``(state, last paragraph, inner paragraphs, those with a terminator, those with open marks)``."""
    lines = [x for line in text.split("\n") if (x := line.strip())]
    if not lines:
        return COMPLETE, "", 0, 0, 0
    last = lines[-1]
    inner = [x for x in lines[:-1] if len(x) > PARAGRAPH_LENGTH]
    ended = sum(1 for x in inner if _ENDED.search(x))
    slips = sum(1 for x in inner if unclosed(x))
    open_ = unclosed(text)
    if _CUT_MARK.search(last) or broken(last) or _OPENED.search(last) or _ORDINAL.search(last):
        state = CUT
    elif _TRAILS.search(last):
        state = COMPLETE
    elif _ELLIPSIS.search(last):
        state = CUT
    elif open_:
        state = UNCLOSED
    elif _ENDED.search(last) or _ADDRESS.search(last):
        state = COMPLETE
    else:
        state = ENTRY if _ENTRY.match(last) and not _SENTENCE.search(last) else OPEN
    return state, last, len(inner), ended, slips


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sources, urls, texts = (c.to_pylist() for c in b.columns)
        got = [judge(t) for t in texts]
        ends = [("digit" if g[1][-1].isdigit() else "letter" if g[1][-1].isalpha() else "other") if g[0] == ENTRY else None for g in got]
        ended = [bool(_ENDED.search(g[1])) for g in got]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(urls, pa.string()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string()), pa.array(ends, pa.string()), pa.array(ended, pa.bool_()), *(pa.array([g[k] for g in got], pa.int32()) for k in (2, 3, 4))],
            names=["id", "source", "url", "state", "last", "ends", "ended", "n_inner", "n_ended", "n_slips"],
        )


def truncated(df: DataFrame, id_col: str, source: str, url: str, text: str) -> DataFrame:
    """``(id,)`` of each text that is cut off.

    Null, empty and blank texts are complete. A text that leaves marks open is cut, unless that is no more frequent in
    its source than among inner paragraphs, which no limit cuts. A text without a terminator is cut unless its last
    line is an address, a list entry like the other ones, or a page part, that is a template of its host's pages by
    their last lines; and unless the paragraphs of its source do without terminators. Rows with a null source are one
    source. Rows repeated come out each; an empty table gives no row. Texts are read whole and once.
    """
    texts = df.filter(F.length(text) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(url).cast("string").alias("url"), F.col(text).alias("t"))
    rows = written(spread(texts).mapInArrow(_judged, "id long, source string, url string, state int, last string, ends string, ended boolean, n_inner int, n_ended int, n_slips int"), "judged")
    named = F.coalesce("source", F.lit("")).alias("source")
    per_source = written(rows.groupBy(named).agg(F.sum("n_inner").alias("n"), F.sum("n_ended").alias("e"), F.sum("n_slips").alias("s"), F.count(F.lit(1)).alias("texts"), F.count_if(F.col("state") == UNCLOSED).alias("u")), "per_source")
    n, e, s = per_source.agg(F.sum("n"), F.sum("e"), F.sum("s")).first()
    share, slips = ((e or 0) / n, (s or 0) / n) if n else (1.0, 0.0)
    loose = (F.col("e") + share * PRIOR) / (F.col("n") + PRIOR) < BASELINE
    slipshod = F.col("u") < OVER_SLIPS * F.col("texts") * (F.col("s") + slips * PRIOR) / (F.col("n") + PRIOR)
    baseline = per_source.select("source", "texts", loose.alias("loose"), slipshod.alias("slipshod"))
    parts = template_lines(rows, "id", "source", "url", "last").select("id").distinct()
    entries = {r["ends"]: r["count"] for r in rows.filter(F.col("state") == ENTRY).groupBy("ends").count().collect()}
    usual = [k for k, v in entries.items() if v >= ENTRY_SHARE * sum(entries.values())]
    # three kinds of ending at most
    entry = (F.col("state") == ENTRY) & F.col("ends").isin(usual) if usual else F.lit(False)
    open_ = rows.filter((F.col("state") > CUT) & ~entry).select("id", named, "state", "ended")
    held = keyed_join(open_, written(baseline.filter("loose or slipshod"), "baseline"), ["source"], "texts", F.col("id"), how="left")
    # an open mark settles the case, or else a missing terminator may
    missing = held.filter(((F.col("state") == UNCLOSED) & ~F.coalesce("slipshod", F.lit(False))) | (~F.col("ended") & ~F.coalesce("loose", F.lit(False)))).join(parts, "id", "left_anti")
    return rows.filter(F.col("state") == CUT).select("id").unionByName(missing.select("id"))
