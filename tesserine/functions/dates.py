"""Partial dates in texts as Column expressions; nothing is guessed without an anchor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.functions.text import let

# The months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_SHORT = "|".join(m[:3] for m in MONTHS)
_DMY = rf"(?i)(?<![A-Za-z0-9])(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_SHORT})[a-z]{{0,6}}\.?,?\s+\d{{4}})(?![0-9])"
# months start with one of eight letters, which is looked at before the names
_MDY = rf"(?i)(?<![A-Za-z0-9])(?=[adfjmnos])((?:{_SHORT})[a-z]{{0,6}}\.?\s+\d{{1,2}}(?:\s*(?:st|nd|rd|th))?\s*,?\s+\d{{4}})(?![0-9])"
_ISO = r"(?<![0-9])(\d{4}-\d{1,2}-\d{1,2})(?![0-9])"
_NUM = r"(?<![0-9])(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?![0-9])"
_MY = rf"(?i)(?<![A-Za-z0-9])(?=[adfjmnos])((?:{'|'.join(MONTHS)}|{_SHORT}|sept)\.?,?\s+(?:of\s+)?\d{{4}})(?![0-9])"


def month_number(token: Column) -> Column:
    """1 to 12 by the first three letters; null for others."""
    key = F.lower(F.substring(F.trim(token), 1, 3))
    return F.nullif(F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), key), F.lit(0)).cast("int")


def _date(raw: Column, day: Column, month: Column, year: Column, ambiguous: bool = False) -> Column:
    ok = year.between(1900, 2100) & month.between(1, 12) & F.expr("true") & (day <= F.dayofmonth(F.last_day(F.make_date(F.when(year.between(1900, 2100), year), F.when(month.between(1, 12), month), F.lit(1))))) & (day >= 1)
    return F.when(ok, F.struct(day.alias("day"), month.alias("month"), year.alias("year"), F.lower(raw).alias("raw"), F.lit(ambiguous).alias("ambiguous"), F.lit("day").alias("precision")))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def extract_dates(text: Column) -> Column:
    """``array<struct<day, month, year, raw, ambiguous, precision>>`` of a text, distinct by day, month and year.

    Days first by pattern: 12 Aug 2024; August 12, 2024; 2024-08-12; 12/08/2024 in both readings. Then months with a
    year that are no part of a day found. Days that no calendar has are left out; a null text gives null.
    """

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), 1)

    def named(raw: Column) -> Column:
        return _date(raw, _int(F.regexp_extract(raw, r"(?<![0-9])(\d{1,2})(?![0-9])", 1)), month_number(F.regexp_extract(raw, r"([A-Za-z]{3,})", 1)), _int(F.regexp_extract(raw, r"(\d{4})", 1)))

    def month_of_dmy(raw: Column) -> Column:
        return _date(raw, _int(F.regexp_extract(raw, r"^(\d{1,2})", 1)), month_number(F.regexp_extract(raw, r"\s([A-Za-z]{3,})", 1)), _int(F.regexp_extract(raw, r"(\d{4})$", 1)))

    def iso(raw: Column) -> Column:
        p = F.split(raw, "-")
        return _date(raw, _int(p[2]), _int(p[1]), _int(p[0]))

    def numeric(raw: Column) -> Column:
        p = F.split(raw, "[/-]")
        return F.array(_date(raw, _int(p[0]), _int(p[1]), _int(p[2]), True), _date(raw, _int(p[1]), _int(p[0]), _int(p[2]), True))

    days = F.array_compact(F.concat(F.transform(found(_DMY), month_of_dmy), F.transform(found(_MDY), named), F.transform(found(_ISO), iso), F.flatten(F.transform(found(_NUM), numeric))))
    # a month and year inside a day's spelling is no date of its own
    rest = F.regexp_replace(F.regexp_replace(text, _DMY, " "), _MDY, " ")
    months = F.transform(
        F.regexp_extract_all(rest, F.lit(_MY), 1),
        lambda raw: F.struct(F.lit(None).cast("int").alias("day"), month_number(raw).alias("month"), _int(F.regexp_extract(raw, r"(\d{4})", 1)).alias("year"), F.lower(raw).alias("raw"), F.lit(False).alias("ambiguous"), F.lit("month").alias("precision")),
    )
    both = F.concat(days, F.filter(months, lambda m: m["year"].between(1900, 2100)))

    def same(a: Column, b: Column) -> Column:
        return a["day"].eqNullSafe(b["day"]) & (a["month"] == b["month"]) & (a["year"] == b["year"])

    return let(both, lambda all_: F.filter(all_, lambda d, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda e: same(d, e))))


def years(text: Column) -> Column:
    """Distinct years 1900 to 2099, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])"), 1), lambda y: y.cast("int"))))


def variants(day: Column, month: Column, year: Column) -> Column:
    """Spellings of a date, seven with a day and four without, distinct in their order."""
    full = F.initcap(F.element_at(F.array(*(F.lit(m) for m in MONTHS)), month))
    short = F.substring(full, 1, 3)
    y, d = year.cast("string"), day.cast("string")
    m2, d2 = F.lpad(month.cast("string"), 2, "0"), F.lpad(d, 2, "0")
    join = lambda *p: F.concat(*p)
    b, c, h, s = F.lit(" "), F.lit(", "), F.lit("-"), F.lit("/")
    by_day = F.array(join(d, b, full, b, y), join(full, b, d, c, y), join(d, b, short, b, y), join(short, b, d, c, y), join(short, b, d, b, y), join(y, h, m2, h, d2), join(d2, s, m2, s, y))
    by_month = F.array(join(full, b, y), join(full, c, y), join(short, b, y), join(y, h, m2))
    return F.array_distinct(F.when(day.isNull(), by_month).otherwise(by_day))


def window(day: Column, lead: int, follow: int) -> Column:
    """First and last day around a date, null with it."""
    return F.when(day.isNotNull(), F.struct(F.date_sub(day, lead).alias("from"), F.date_add(day, follow).alias("to")))


def relative(term: Column, anchor: Column) -> Column:
    """A relative day word against its anchor; null without one."""
    t = F.lower(F.trim(term))
    shift = F.when(t.isin("yesterday", "last night"), -1).when(t.isin("today", "tonight", "this morning"), 0).when(t == "tomorrow", 1)
    return F.date_add(anchor, shift)


def agreement(found: Column, year_list: Column, claim: Column) -> Column:
    """exact, same_year, different or absent: dates of a text against the day of a claim; null without one."""
    exact = F.exists(found, lambda d: (d["day"] == F.dayofmonth(claim)) & (d["month"] == F.month(claim)) & (d["year"] == F.year(claim)))
    same = F.array_contains(year_list, F.year(claim)) | F.exists(found, lambda d: d["year"] == F.year(claim))
    return F.when(claim.isNull(), F.lit(None)).when(exact, "exact").when(same, "same_year").when((F.size(found) > 0) | (F.size(year_list) > 0), "different").otherwise("absent")


def compatibility(found: Column, year_list: Column, claim: Column, claim_years: Column, source_found: Column | None = None, source_years: Column | None = None, published: Column | None = None) -> Column:
    """match, same_day_published, same_year, different or unknown: the dates of a passage against the date of a claim.

    ``claim``: a date struct of ``extract_dates``, of a day or a month, or null; ``claim_years``: the years the claim
    names. ``source_found`` and ``source_years`` are those of the whole source, which a passage inherits, but only the
    passage's own dates match a day. Dates are compared in the fields both have. A date of another year counts only
    where the claimed year stands nowhere.
    """
    none = F.array().cast("array<int>")
    own, own_years, named = F.coalesce(found, F.filter(found, lambda d: F.lit(False))), F.coalesce(year_list, none), F.coalesce(claim_years, none)
    every = own if source_found is None else F.concat(own, F.coalesce(source_found, F.filter(own, lambda d: F.lit(False))))
    all_years = own_years if source_years is None else F.array_union(own_years, F.coalesce(source_years, none))
    year_stands = F.arrays_overlap(named, all_years)

    def of_month(d: Column) -> Column:
        return (d["year"] == claim["year"]) & (d["month"] == claim["month"])

    def differs(d: Column) -> Column:
        other_day = (d["month"] != claim["month"]) | F.coalesce(d["day"] != claim["day"], F.lit(False))
        return F.when(d["year"] == claim["year"], other_day).otherwise(~year_stands)

    nothing = (claim.isNull() & (F.size(named) == 0)) | ((F.size(every) == 0) & (F.size(all_years) == 0))
    by_month = F.when(F.exists(every, of_month), "match").when(F.exists(every, lambda d: (d["year"] == claim["year"]) & (d["month"] != claim["month"])), "different")
    same_day = F.lit(False) if published is None else F.coalesce((F.dayofmonth(published) == claim["day"]) & (F.month(published) == claim["month"]) & (F.year(published) == claim["year"]), F.lit(False))
    by_day = F.when(F.exists(own, lambda d: of_month(d) & F.coalesce(d["day"] == claim["day"], F.lit(False))), "match").when(F.exists(every, differs), "different").when(same_day, "same_day_published")
    by_date = F.when(claim.isNotNull(), F.when(claim["day"].isNull(), by_month).otherwise(by_day))
    by_year = F.when(year_stands, "same_year").when(((F.size(named) > 0) & (F.size(all_years) > 0)) | (claim.isNotNull() & claim["day"].isNull()), "different")
    return F.when(nothing, "unknown").otherwise(F.coalesce(by_date, by_year, F.lit("unknown")))


def event_conflicts(sentence_list: Column, claim: Column, stems: Column, stem: Callable[[Column], Column]) -> Column:
    """``struct<clear, soft>``: sentences that speak of the claim's event and date it otherwise.

    A sentence speaks of the event if a word of it has one of the claim's ``stems``; its dates of another month or year
    are clear conflicts where the claim has no day or the day is the same, soft ones otherwise. Only sentences with a
    year are looked at; without a claim's date or stems there is no conflict.
    """
    dated = F.filter(sentence_list, lambda s: s.rlike(r"\d{4}"))

    def of(s: Column) -> Column:
        words = F.transform(F.regexp_extract_all(F.lower(s), F.lit("([a-z]+)"), 1), stem)
        other = F.filter(extract_dates(s), lambda d: ~((d["month"] == claim["month"]) & (d["year"] == claim["year"])))
        speaks = F.arrays_overlap(words, stems)
        same_day = F.exists(other, lambda d: claim["day"].isNull() | F.coalesce(d["day"] == claim["day"], F.lit(False)))
        another = F.exists(other, lambda d: claim["day"].isNotNull() & ~F.coalesce(d["day"] == claim["day"], F.lit(False)))
        return F.struct((speaks & same_day).alias("clear"), (speaks & another).alias("soft"))

    judged = F.transform(dated, of)

    def any_of(x: Column, name: str) -> Column:
        return F.coalesce(F.exists(x, lambda r: F.coalesce(r[name], F.lit(False))), F.lit(False))

    return let(judged, lambda x: F.struct(any_of(x, "clear").alias("clear"), any_of(x, "soft").alias("soft")))
