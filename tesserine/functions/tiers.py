"""Reliability tiers of hosts by a lexicon table, and the scores that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import urls

# The score of each tier, those that count as primary reporting, and the order in which rules are tried.
TIER_SCORES = {"official": 0.95, "established_wire": 0.92, "major_outlet": 0.82, "regional/general_news": 0.68, "aggregator_portal": 0.45, "weak/blog": 0.32, "user_generated": 0.15, "unknown": 0.55}
PRIMARY = ("official", "established_wire", "major_outlet", "regional/general_news")
ORDER = ("user_generated", "aggregator_portal", "established_wire", "official", "major_outlet", "regional/general_news", "weak/blog")
LEXICON = "kind string, value string, tier string"
#: Marks and path hints are compared with each host, so there can be so many at most; host names and suffixes are joined.
MOST_MARKS = 500


def _tails(host: Column) -> Column:
    """The host and what is left of it after each of its first dots."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def with_tiers(df: DataFrame, url: str, lexicon: DataFrame) -> DataFrame:
    """``df`` with ``tier`` and ``tier_reason``, the entry of the lexicon that decided.

    ``lexicon`` (kind, value, tier): a ``host`` or ``suffix`` holds for whole labels at the end of a host, so notbbc.com
    is not bbc.com; a ``mark`` stands anywhere in the host; a ``path`` anywhere in the address. Of several entries that
    hold, the tier that comes first in ``ORDER`` decides, then the longest value. Hosts are judged once each; only
    addresses with a path hint are judged by themselves. No host, or no entry: unknown. Null addresses are unknown.
    """
    lex = lexicon.select("kind", F.lower("value").alias("value"), "tier").distinct()
    marks = [tuple(r) for r in lex.filter("kind in ('mark', 'path')").orderBy("kind", "value").limit(MOST_MARKS + 1).collect()]
    if len(marks) > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} marks")
    host = F.regexp_replace(urls.host(F.col(url)), r"^www\.", "")
    rows = df.withColumn("_host", F.coalesce(host, F.lit("")))
    hosts = rows.select("_host").distinct().filter("_host <> ''")

    def rank(t: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, ORDER)), t)

    named = lex.filter("kind in ('host', 'suffix')").select(F.regexp_replace("value", r"^\.+", "").alias("_tail"), "value", "tier")
    by_name = hosts.select("_host", F.explode(_tails(F.col("_host"))).alias("_tail")).join(named, "_tail").select("_host", F.struct((-rank(F.col("tier"))).alias("r"), F.length("value").alias("l"), "value", "tier").alias("e"))
    by_mark = [F.when(F.col("_host").contains(v), F.struct((-rank(F.lit(t))).alias("r"), F.lit(len(v)).alias("l"), F.lit(v).alias("value"), F.lit(t).alias("tier"))) for k, v, t in marks if k == "mark"]
    found = by_name
    if by_mark:
        found = found.unionByName(hosts.select("_host", F.explode(F.array_compact(F.array(*by_mark))).alias("e")))
    judged = found.groupBy("_host").agg(F.max("e").alias("_by_host"))
    by_path = [F.when(F.lower(url).contains(v), F.struct((-rank(F.lit(t))).alias("r"), F.lit(len(v)).alias("l"), F.lit(v).alias("value"), F.lit(t).alias("tier"))) for k, v, t in marks if k == "path"]
    best = F.greatest(F.col("_by_host"), F.array_max(F.array_compact(F.array(*by_path)))) if by_path else F.col("_by_host")
    # by_path is none where the address has no host
    out = rows.join(judged, "_host", "left").withColumn("_best", F.when(F.col("_host") != "", best))
    return out.withColumn("tier", F.coalesce("_best.tier", F.lit("unknown"))).withColumn("tier_reason", F.col("_best.value")).drop("_host", "_by_host", "_best")


def reliability(tier_col: Column, mode: Column) -> Column:
    """Score of a tier, lowered and capped by the mode of retrieval and for weak tiers."""
    base = F.lit(TIER_SCORES["unknown"])
    for k, v in TIER_SCORES.items():
        base = F.when(tier_col == k, F.lit(v)).otherwise(base)
    s = F.when(mode == "search_extract", F.least(base * 0.80, F.lit(0.62))).when(mode == "search_snippet", F.least(base * 0.65, F.lit(0.40))).otherwise(base)
    cap = F.when(mode == "scraped_article", 0.32).otherwise(0.22)
    return F.when(tier_col.isin("weak/blog", "user_generated"), F.least(s, cap)).otherwise(s)


def is_primary(tier_col: Column, mode: Column) -> Column:
    return tier_col.isin(*PRIMARY) & (mode != "search_snippet")


def profile(tier_col: Column, mode: Column) -> Column:
    """Tier, score and whether it is primary, as a struct."""
    return F.struct(tier_col.alias("tier"), reliability(tier_col, mode).alias("reliability"), is_primary(tier_col, mode).alias("is_primary"))
