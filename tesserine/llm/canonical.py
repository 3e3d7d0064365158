"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining, collision check."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserine.operators.skew import keyed_join
from tesserine.session import spread, written

#: White space (no-break and zero-width kinds too) and punctuation.
_DROPPED = r"[\p{P}\p{Z}\s\x{85}\x{200B}-\x{200D}\x{2060}\x{FEFF}]+"
_NONE = "\u0002"


def canonical(col: Column) -> Column:
    """Text without case, white space and punctuation; upper case, as it folds ß and final sigma too."""
    return F.regexp_replace(F.upper(col), _DROPPED, "")


def canonical_url(col: Column) -> Column:
    """The same of an address, the query parameters sorted; path, parameters and fragment stay apart."""
    base, fragment = F.substring_index(col, "#", 1), F.regexp_extract(col, r"#(?s)(.*)$", 1)
    path, query = F.substring_index(base, "?", 1), F.regexp_extract(base, r"\?(?s)(.*)$", 1)
    params = F.array_sort(F.filter(F.transform(F.split(query, "&"), canonical), lambda p: p != ""))
    return F.concat(canonical(path), F.lit("\u0001"), F.array_join(params, "\u0003"), F.lit("\u0001"), canonical(fragment))


@F.pandas_udf(T.StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """NFKC: one form of accents, widths and ligatures; most texts are in it and only looked at."""
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def record_keys(df: DataFrame, id_col: str, exact: list[str], texts: list[str], urls: list[str], hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """``(id, h, check)`` of each row: the 128-bit hash of its canonical record, and a hash of another family."""

    def or_none(c: Column) -> Column:
        return F.coalesce(c, F.lit(_NONE))

    names = [f"_x{i}" for i in range(len(exact))], [f"_t{i}" for i in range(len(texts))], [f"_u{i}" for i in range(len(urls))]
    formed = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("string").alias(k) for c, k in zip(exact, names[0])), *(normal_form(F.col(c)).alias(k) for c, k in zip([*texts, *urls], [*names[1], *names[2]])))
    parts = [or_none(F.col(c)) for c in names[0]] + [or_none(canonical(F.col(c))) for c in names[1]] + [or_none(canonical_url(F.col(c))) for c in names[2]]
    record = F.concat_ws("\u0004", *parts)
    return formed.select("id", record.alias("r")).select("id", hash128(F.col("r")).alias("h"), F.xxhash64("r").alias("check"))


def copies(df: DataFrame, id_col: str, exact: list[str], texts: list[str], urls: list[str], required: str, hash128: Callable[[Column], Column] = md5_128, broadcast_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and their copies: ``(records, members)``.

    records: ``(h, check, first_id, n_copies)``, one row a record, single ones too; members: ``(first_id, id)``, one row
    for each copy but the first. Nulls equal nulls and nothing else; rows whose ``required`` text is null or blank don't
    count. The group key is the hash and the check together, so records whose 128-bit hashes collide stay apart. The
    texts are read once, in Unicode normal form: only the keys are written and grouped, with map-side combining, so a record that holds a third
    of all rows costs one combined row a task; its copies come back by a salted join. Rows repeated with the same id
    count as copies but give no pair of an id with itself. Empty tables give empty results.
    """
    used = list(dict.fromkeys([id_col, *exact, *texts, *urls, required]))
    rows = spread(df.select(*used)).filter(F.regexp_replace(F.col(required), r"[\s\p{Z}]+", "") != "")
    keys = written(record_keys(rows, id_col, exact, texts, urls, hash128), "keys")
    records = keys.groupBy("h", "check").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    repeated = written(records.filter("n_copies > 1"), "repeated")
    extra = {} if broadcast_bytes is None else {"broadcast_bytes": broadcast_bytes}
    members = keyed_join(keys, repeated, ["h", "check"], "n_copies", F.col("id"), **extra).filter("id <> first_id").select("first_id", "id").distinct()
    return records, members
