"""Passages collapsed to sources, sources to publishers, publishers to counters of a claim.

Two grouped aggregations with map-side combining; all choices of a best row have the total order score, then position.
Scores are compared as they stand: one source decides for the side ahead by more than the margin, a publisher for the
side ahead by the margin or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import urls

MARGIN = 0.10
ARTICLES = ("scraped_article", "search_extract")
MODES = (*ARTICLES, "search_snippet")


def source_key(url: Column, source_id: Column, pos: Column) -> Column:
    """Identity of a source: its address, else its id, else the position, of which only the first is resolved."""
    u = urls.canonical_url(url)
    return F.when(u != "", F.concat(F.lit("url:"), u)).when(F.coalesce(source_id, F.lit("")) != "", F.concat(F.lit("sid:"), source_id)).otherwise(F.concat(F.lit("unresolved:"), pos.cast("string")))


def publisher(group: Column, url: Column, domain: Column) -> Column:
    """Independence group as stored, else the registrable domain of the address, else the domain; '' if none."""
    stored = F.lower(F.trim(group))
    derived = urls.registrable_domain(urls.host(url))
    return F.coalesce(F.when(stored != "", stored), F.when(derived != "", derived), F.lower(F.trim(domain)), F.lit(""))


def corrects(df_class: Column, debunking: Column, date_status: Column, detail: Column) -> Column:
    """A passage that contradicts, corrects, and does so in a material detail."""
    return F.coalesce((df_class == "CONTRADICTION") & debunking & ((date_status == "different") | (detail >= 0.30)), F.lit(False))


def source_decisions(ev: DataFrame) -> DataFrame:
    """One row for each claim and source. Null scores count as 0; an empty table gives no row."""
    c = F.col
    rows = ev.select(
        "claim_id", "pos", source_key(c("url"), c("source_id"), c("pos")).alias("source_key"), publisher(c("independence_group"), c("url"), c("domain")).alias("publisher"),
        "evidence_class", "evidence_type", F.coalesce("evidence_score", F.lit(0.0)).alias("score"), F.coalesce("is_primary_source", F.lit(False)).alias("prim"),
        corrects(c("evidence_class"), c("debunking"), c("date_status"), c("detail_coverage")).alias("correcting"),
    )

    def best(kind: str) -> Column:
        return F.max(F.when(c("evidence_class") == kind, c("score")))

    agg = rows.groupBy("claim_id", "source_key").agg(
        F.count(F.lit(1)).alias("n_chunks"), best("SUPPORT").alias("support"), best("CONTRADICTION").alias("contra"), best("RELATED_CONTEXT").alias("context"), F.max("score").alias("top"),
        F.coalesce(F.every(c("evidence_type") == "search_snippet"), F.lit(False)).alias("snippet_only"), F.coalesce(F.bool_or(c("evidence_type").isin(*ARTICLES)), F.lit(False)).alias("has_article"),
        F.bool_or("prim").alias("any_primary"), F.bool_or("correcting").alias("has_correction"),
        F.countDistinct(F.when(c("evidence_type").isin(*MODES), c("evidence_type"))).alias("n_modes"), F.min(F.when(c("evidence_type").isin(*MODES), c("evidence_type"))).alias("mode"),
        F.min_by("publisher", "pos").alias("publisher"),
    )
    s, k = c("support"), c("contra")
    raw = (
        F.when(s.isNotNull() & k.isNotNull(), F.when(s > k + MARGIN, "entailment").when(k > s + MARGIN, "contradiction").otherwise("neutral"))
        .when(s.isNotNull(), "entailment").when(k.isNotNull(), "contradiction").when(c("context").isNotNull(), "related_context").otherwise("non_evidence")
    )
    return (
        agg.withColumn("raw", raw)
        .withColumn("decision", F.when(c("snippet_only") & c("raw").isin("entailment", "contradiction"), "related_context").otherwise(c("raw")))
        .withColumn("source_score", F.when(s.isNotNull() | k.isNotNull(), F.greatest(F.when(c("raw") != "contradiction", s), F.when(c("raw") != "entailment", k))).otherwise(F.coalesce("context", "top")))
        .withColumn("retrieval_mode", F.when(c("n_modes") == 0, "unknown").when(c("n_modes") == 1, c("mode")).otherwise("mixed"))
        .withColumn("is_primary", c("any_primary") & ~c("snippet_only"))
        .withColumn("identity_resolved", c("source_key").startswith("url:") & (c("publisher") != ""))
        .select("claim_id", "source_key", "publisher", "decision", "source_score", "retrieval_mode", "n_chunks", "is_primary", "snippet_only", "has_article", "has_correction", "identity_resolved")
    )


def publisher_decisions(sources: DataFrame) -> DataFrame:
    """One row for each claim and publisher, of the sources with a resolved identity."""
    c = F.col

    def best(kind: str) -> Column:
        return F.max(F.when(c("decision") == kind, c("source_score")))

    agg = sources.filter("identity_resolved").groupBy("claim_id", "publisher").agg(
        F.count(F.lit(1)).alias("n_sources"), best("entailment").alias("s"), best("contradiction").alias("k"), F.max("source_score").alias("publisher_score"), F.bool_or(c("decision") == "related_context").alias("ctx"),
        F.every("snippet_only").alias("snippet_only"), F.bool_or("has_article").alias("has_article"), F.bool_or("is_primary").alias("is_primary"), F.bool_or("has_correction").alias("has_correction"), F.bool_or(c("is_primary") & c("has_correction")).alias("has_primary_correction"),
    )
    s, k = c("s"), c("k")
    decision = (
        F.when(s.isNotNull() & k.isNotNull(), F.when(s >= k + MARGIN, "entailment").when(k >= s + MARGIN, "contradiction").otherwise("neutral"))
        .when(s.isNotNull(), "entailment").when(k.isNotNull(), "contradiction").when(c("ctx"), "context").otherwise("non_evidence")
    )
    return agg.select("claim_id", "publisher", decision.alias("decision"), "n_sources", "publisher_score", "snippet_only", "has_article", "is_primary", "has_correction", "has_primary_correction")


def agreement(sources: DataFrame, publishers: DataFrame) -> DataFrame:
    """Counters of each claim with the agreement score; claims without a resolved publisher have zeros."""
    c = F.col
    by_source = sources.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("n_chunks").alias("n_chunks"), F.count_if(c("decision") == "entailment").alias("supporting_sources"), F.count_if(c("decision") == "contradiction").alias("contradicting_sources"),
        F.count_if("snippet_only").alias("snippet_only_sources"), F.count_if("has_article").alias("article_sources"), F.count_if(~c("identity_resolved")).alias("unresolved_sources"),
    )
    yes, no = c("decision") == "entailment", c("decision") == "contradiction"
    by_publisher = publishers.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("publishers"), F.count_if(yes).alias("supporting"), F.count_if(no).alias("contradicting"), F.count_if(yes & c("is_primary")).alias("primary_supporting"), F.count_if(no & c("is_primary")).alias("primary_contradicting"),
        F.count_if(yes & c("has_article")).alias("article_supporting"), F.count_if(no & c("has_article")).alias("article_contradicting"), F.count_if("has_correction").alias("correcting"), F.count_if("has_primary_correction").alias("primary_correcting"),
    )
    out = by_source.join(by_publisher, "claim_id", "left").na.fill(0)
    a, b, n = c("supporting"), c("contradicting"), F.greatest(F.lit(1), c("publishers"))
    score = F.when((a + b) == 0, 0.0).when((a > 0) & (b > 0), 0.5 * F.greatest(a, b) / (a + b)).when(a > 0, 0.30 + 0.70 * a / n).otherwise(0.20 + 0.50 * b / n)
    weak = ((a > 0) & (c("primary_supporting") == 0)) | ((b > 0) & (c("primary_contradicting") == 0))
    score = F.when(weak, F.least(score, F.lit(0.35))).otherwise(score)
    score = F.when((a == 1) & (b == 0), F.least(score, F.lit(0.65))).otherwise(score)
    return out.withColumn("agreement_score", score).withColumn("coverage", c("article_sources") / c("n_sources"))


def fusion_score(publishers: DataFrame, counters: DataFrame) -> DataFrame:
    """Strength of a claim's best four publishers, their agreement and number; 0 without a decided one."""
    c = F.col
    w = Window.partitionBy("claim_id").orderBy(F.desc("publisher_score"), "publisher")
    top = publishers.filter(c("decision").isin("entailment", "contradiction")).withColumn("rn", F.row_number().over(w))
    n = top.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(c("rn") <= 4, F.least(F.lit(0.9), c("publisher_score")))).alias("strength"), F.bool_or("snippet_only").alias("snip"), F.bool_or("has_article").alias("art"))
    j = counters.join(n, "claim_id", "left")
    s = c("strength") * 0.55 + c("agreement_score") * 0.25 + F.least(F.lit(1.0), (c("n") - 1) / 2.0) * 0.20
    s = F.when(c("snip") & ~c("art"), F.least(s, F.lit(0.45))).otherwise(s)
    s = F.when(c("n") == 1, F.least(s, F.lit(0.62))).otherwise(s)
    s = F.when((c("supporting") > 0) & (c("contradicting") > 0), F.least(s, F.lit(0.50))).otherwise(s)
    return j.select("claim_id", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), F.lit(0.0)).alias("fusion_score"))


def best_passages(ev: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` passages of greatest score of each claim and class, ties by position."""
    w = Window.partitionBy("claim_id", "evidence_class").orderBy(F.desc_nulls_last("evidence_score"), "pos")
    return ev.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("claim_id", "evidence_class", "evidence_id", "evidence_score", "rn")


def reconciled(ev: DataFrame) -> DataFrame:
    """One passage for each claim and source: support before contradiction before all else, then score, then position."""
    rank = F.when(F.col("evidence_class") == "SUPPORT", 0).when(F.col("evidence_class") == "CONTRADICTION", 1).otherwise(2)
    keyed = ev.withColumn("source_key", source_key(F.col("url"), F.col("source_id"), F.col("pos"))).withColumn("rank", rank)
    w = Window.partitionBy("claim_id", "source_key").orderBy("rank", F.desc_nulls_last("evidence_score"), "pos")
    return keyed.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("claim_id", "source_key", "evidence_id", "evidence_class", "evidence_score")


def evidence_class(c: dict[str, Column]) -> Column:
    """SUPPORT, CONTRADICTION, RELATED_CONTEXT or NON_EVIDENCE of a passage by its signals.

    ``c``: Columns of the signals, named as in the evidence table; a null signal is its weakest value, a null claim type
    that of an event. What decides a claim must be read on a primary page, be near enough, at the claimed place, and
    judged by a model that worked; claims of events must also meet the event and its date, others the proposition.
    """
    def at_least(name: str, least: float) -> Column:
        return F.coalesce(c[name] >= least, F.lit(False))

    def true(name: str) -> Column:
        return F.coalesce(c[name], F.lit(False))

    def said(label: str, least: float) -> Column:
        return F.coalesce(F.lower(c["raw_nli_label"]) == label, F.lit(False)) & at_least("raw_nli_score", least)

    status, match = F.coalesce(c["date_status"], F.lit("unknown")), F.coalesce(c["event_match"], F.lit("weak"))
    event = F.coalesce(c["claim_type"].isin("historical_event", "current_event"), F.lit(True))
    snippet = F.coalesce(c["evidence_type"] == "search_snippet", F.lit(False))
    covered = at_least("detail_coverage", 0.30)
    conflict = true("event_date_conflict")
    dated_alike = ~conflict & ~true("event_date_mismatch")
    usable = ~F.coalesce(c["nli_status"], F.lit("ok")).isin("error", "unavailable")
    decisive = usable & ~snippet & true("is_primary_source") & at_least("similarity", 0.40) & (true("location_match") | ~true("claim_has_location"))
    # events
    date_tells = (status == "match") | ((status == "different") & true("debunking")) | conflict
    event_denied = (match == "strong") & date_tells & (said("contradiction", 0.75) | conflict)
    same_date = status.isin("match", "same_day_published") | ((status == "unknown") & at_least("raw_nli_score", 0.90) & at_least("detail_coverage", 0.50))
    # other propositions
    denied = covered & dated_alike & said("contradiction", 0.75)
    one_passage = F.coalesce(c["passage_kind"] != "window", F.lit(True))
    contradiction = decisive & one_passage & F.when(event, event_denied).otherwise(denied)
    support = decisive & said("entailment", 0.70) & covered & dated_alike & (~event | ((match == "strong") & same_date))
    anchor = true("location_match") | covered
    near = (status.isin("same_year", "match") & at_least("similarity", 0.35)) | ((status == "different") & at_least("similarity", 0.45)) | snippet
    return F.when(contradiction, "CONTRADICTION").when(support, "SUPPORT").when(match.isin("moderate", "strong") | (anchor & near), "RELATED_CONTEXT").otherwise("NON_EVIDENCE")


def event_match(c: dict[str, Column], policy: Column, aggregate: Column, incident: Column, phrase_hit: Column, number_hit: Column, entails: Column, place_conflict: Column | None = None) -> Column:
    """strong, moderate, weak or none: whether a passage tells of the claim's event.

    ``c``: signals named as in the evidence table; the others are what the passage's text shows: rules in place of an
    incident, numbers over many incidents, words of an incident, a phrase or number of the claim, a model's entailment,
    another place. Null signals are their weakest value. Nearness of text and details makes an event strong or moderate
    where the date lets it: a date that agrees needs a detail besides, one that differs a denial of it.
    """
    def at_least(name: str, least: float) -> Column:
        return F.coalesce(c[name] >= least, F.lit(False))

    def true(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    placed = true(c["location_match"]) | ~true(c["claim_has_location"])
    covered, mostly = (placed & at_least("detail_coverage", x) for x in (0.30, 0.60))
    status = F.coalesce(c["date_status"], F.lit("unknown"))

    def by_nearness(sure: Column) -> Column:
        return F.when(covered & sure & at_least("similarity", 0.50), "strong").when(covered & at_least("similarity", 0.45), "moderate").otherwise("weak")

    denied = true(c["debunking"]) | true(c["event_date_conflict"])
    full = at_least("detail_coverage", 0.65)
    detail = (status == "match") | true(number_hit) | true(phrase_hit) | full | true(entails)
    pattern = true(aggregate) & ~true(phrase_hit) & ~full
    told = mostly & true(incident)
    agreeing = F.when(pattern, "weak").otherwise(by_nearness(detail))
    undated = F.when(told & ((status == "same_year") | at_least("similarity", 0.45)), "moderate").otherwise("weak")
    of_event = F.when(status == "different", F.when(denied, by_nearness(F.lit(True))).otherwise("weak")).when(status.isin("match", "same_day_published"), agreeing).otherwise(undated)
    elsewhere = F.lit(False) if place_conflict is None else true(place_conflict)
    return F.when((true(policy) & ~true(incident)) | elsewhere, "none").otherwise(of_event)
