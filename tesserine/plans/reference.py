"""Queries of the evidence, media and evaluation operators over the given tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import dates, scores, text, tiers, urls
from tesserine.operators import audit, chunking, evidence, hashes, media, metrics, selection, timeline, vectors
from tesserine.session import spread, table
from tesserine.streaming import timeline as progress

STOPWORDS = tuple("the a an and or of to in on at for is are was were be been that this by from with as about into over after before it its he she they not no but if than then so such also will would can may might do does did has had have nor".split())
DATE_LIST = "array<struct<day: int, month: int, year: int, raw: string, ambiguous: boolean, precision: string>>"
MERGE_GAP, JOIN_TOLERANCE, JOIN_WIDTH = 1800.0, 3600.0, 14400.0


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "trace_real_evidence")


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, f"{s}_manifest").withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labels and scores of passages: support and contradiction by their NLI score."""
    p = F.when(F.col("nli_label") == "entailment", F.col("nli_score")).when(F.col("nli_label") == "contradiction", 1 - F.col("nli_score"))
    return _ev(spark, d).filter(F.col("evidence_class").isin("SUPPORT", "CONTRADICTION")).select("evidence_id", "evidence_type", (F.col("evidence_class") == "SUPPORT").cast("int").alias("y"), F.round(p, 4).alias("p"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"), (us / 1e6).alias("sec"))


def canonical_urls(spark, d):
    return _ev(spark, d).select("evidence_id", urls.canonical_url(F.col("url")).alias("canonical"))


def url_parts(spark, d):
    u = F.col("url")
    return _ev(spark, d).select("evidence_id", urls.normalize_url(u).alias("normalized"), urls.domain(u).alias("domain_of"), urls.host(u).alias("host"), urls.registrable_domain(urls.host(u)).alias("registrable"), urls.is_valid_url(u).alias("valid"), urls.path_key(u).alias("path_key"))


def source_tiers(spark, d):
    """Tier of each passage by a lexicon of hosts, that of the table's own commonest tiers, with marks and a suffix."""
    ev = _ev(spark, d)
    by_domain = ev.filter("domain is not null and source_tier <> 'unknown'").groupBy("domain", "source_tier").count()
    hosts = by_domain.groupBy("domain").agg(F.max_by("source_tier", F.struct("count", "source_tier")).alias("tier")).select(F.lit("host").alias("kind"), F.col("domain").alias("value"), "tier")
    marks = spark.createDataFrame([("mark", "blog", "weak/blog"), ("mark", "gazette", "weak/blog"), ("suffix", ".gov", "official"), ("path", "/live/", "user_generated")], tiers.LEXICON)
    t = tiers.with_tiers(ev.select("evidence_id", "url", "evidence_type"), "url", hosts.unionByName(marks))
    return t.select("evidence_id", "tier", "tier_reason", tiers.reliability(F.col("tier"), F.col("evidence_type")).alias("reliability"), F.coalesce(tiers.is_primary(F.col("tier"), F.col("evidence_type")), F.lit(False)).alias("is_primary"))


def evidence_classes(spark, d):
    """Class of each passage by its signals, its score and the score under the ceilings of that class."""
    ev = _ev(spark, d)
    c = F.col
    k = evidence.evidence_class({name: c(name) for name in ev.columns})
    s = scores.evidence_score(c("similarity"), c("raw_nli_label"), c("raw_nli_score"), c("source_reliability"), c("date_status"), c("event_match"), c("detail_coverage"), c("location_match"), c("claim_has_location"), c("debunking"))
    return ev.withColumn("k", k).select("evidence_id", c("k").alias("class"), scores.capped(s, c("k"), c("evidence_type")).alias("class_score"))


POLICY_WORDS, AGGREGATE_WORDS, INCIDENT_WORDS = "policy|guideline|protocol|regulation", "on average|records from|data showed|in total", "flood|fire|storm|landslide|leak|closure|strike|evacuation|collision"


def event_matches(spark, d):
    """How well each passage meets the event of its claim, by its signals and words."""
    c = F.col
    numbered = table(spark, d, "claims").select("claim_id", text.numeric_details(c("claim")).alias("claim_numbers"))
    names = ["evidence_id", "claim_id", "chunk", "location_match", "claim_has_location", "detail_coverage", "similarity", "date_status", "debunking", "event_date_conflict", "nli_label"]
    rows = _ev(spark, d).select(*names).withColumn("low", F.lower("chunk")).withColumn("own_numbers", text.numeric_details(c("chunk")))
    j = rows.drop("chunk").join(numbered, "claim_id")
    m = evidence.event_match({n: c(n) for n in names if n != "chunk"}, c("low").rlike(POLICY_WORDS), c("low").rlike(AGGREGATE_WORDS), c("low").rlike(INCIDENT_WORDS), F.lit(False), F.arrays_overlap("claim_numbers", "own_numbers"), c("nli_label") == "entailment")
    return j.select("evidence_id", m.alias("event_match"))


def _dated_passages(spark, d):
    """Passages with the first date, the years and the stems of their claims; the short table is joined to the texts."""
    c = F.col
    first = F.get(dates.extract_dates(c("claim")), F.lit(0))
    stems = F.array_distinct(F.transform(text.keywords(c("claim"), STOPWORDS), text.stem))
    claims = table(spark, d, "claims").select("claim_id", first.alias("claim_date"), dates.years(c("claim")).alias("claim_years"), stems.alias("stems"))
    return spread(_ev(spark, d).filter("chunk is not null").select("evidence_id", "claim_id", "chunk")).join(claims, "claim_id")


def date_statuses(spark, d):
    """Status of each passage's dates against the first date of its claim."""
    c = F.col
    found = _dated_passages(spark, d).select("evidence_id", "claim_date", "claim_years", dates.extract_dates(c("chunk")).alias("found"), dates.years(c("chunk")).alias("years"))
    return found.select("evidence_id", dates.compatibility(c("found"), c("years"), c("claim_date"), c("claim_years")).alias("status"))


def date_bindings(spark, d):
    """Passages that date the event of their claim otherwise."""
    c = F.col
    conflict = dates.event_conflicts(text.sentences(c("chunk")), c("claim_date"), c("stems"), text.stem)
    return _dated_passages(spark, d).filter("claim_date is not null").select("evidence_id", conflict.alias("conflict")).select("evidence_id", "conflict.clear", "conflict.soft")


def dedup_by_url(spark, d):
    keyed = _ev(spark, d).withColumn("canonical", urls.canonical_url(F.col("url"))).filter("canonical <> ''")
    return selection.dedup_merging(keyed, ["claim_id", "canonical"], "evidence_type", ["evidence_id"])


def diverse_topk(spark, d):
    rows = _ev(spark, d).select("claim_id", "domain", "evidence_score", "evidence_id")
    return selection.diverse_top(rows, "claim_id", "domain", "evidence_score", "evidence_id", 10)


def evidence_scores(spark, d):
    c = F.col
    s = scores.evidence_score(c("similarity"), c("nli_label"), c("nli_score"), c("source_reliability"), c("date_status"), c("event_match"), c("detail_coverage"), c("location_match"), c("claim_has_location"), c("debunking"))
    return _ev(spark, d).select("evidence_id", s.alias("score"), scores.capped(s, c("evidence_class"), c("evidence_type")).alias("capped"), scores.strength(s).alias("strength"))


def source_decisions(spark, d):
    return evidence.source_decisions(spread(_ev(spark, d)))


def publisher_decisions(spark, d):
    return evidence.publisher_decisions(source_decisions(spark, d))


def agreement(spark, d):
    s = source_decisions(spark, d)
    return evidence.agreement(s, evidence.publisher_decisions(s))


def fusion_scores(spark, d):
    s = source_decisions(spark, d)
    p = evidence.publisher_decisions(s)
    return evidence.fusion_score(p, evidence.agreement(s, p))


def best_passages(spark, d):
    return evidence.best_passages(_ev(spark, d))


def reconciled(spark, d):
    return evidence.reconciled(_ev(spark, d))


def class_counts(spark, d):
    """Strong passages of each class and the share of scraped ones of each claim."""
    c = F.col
    strong = c("evidence_score") >= 0.6
    return _ev(spark, d).groupBy("claim_id").agg(
        F.count_if((c("evidence_class") == "SUPPORT") & strong).alias("strong_support"), F.count_if((c("evidence_class") == "CONTRADICTION") & strong).alias("strong_contradiction"),
        F.count_if(c("evidence_class") == "RELATED_CONTEXT").alias("context"), F.avg((c("evidence_type") == "scraped_article").cast("double")).alias("scraped_share"),
    )


def claim_dates(spark, d):
    """Dates in claims, one row each, with their spellings."""
    found = table(spark, d, "claims").select("claim_id", F.posexplode(dates.extract_dates(F.col("claim"))).alias("pos", "x"))
    return found.select("claim_id", "pos", "x.day", "x.month", "x.year", "x.precision", F.array_join(dates.variants(F.col("x.day"), F.col("x.month"), F.col("x.year")), "|").alias("variants"))


def claim_years(spark, d):
    return table(spark, d, "claims").select("claim_id", F.array_join(dates.years(F.col("claim")).cast("array<string>"), ",").alias("years"), dates.window(F.col("submission_date"), 3, 45).alias("w")).select("claim_id", "years", F.col("w.from").alias("from_day"), F.col("w.to").alias("to_day"))


def date_agreement(spark, d):
    """How the dates of passages agree with the day their claim was entered."""
    # dates are taken out once, before they are compared, and only they go through the join
    dated = spread(_ev(spark, d).select("claim_id", "chunk")).select("claim_id", dates.extract_dates(F.col("chunk")).alias("found"), dates.years(F.col("chunk")).alias("years"))
    found = dated.join(table(spark, d, "claims").select("claim_id", "submission_date"), "claim_id").select("submission_date", "found", "years")
    full = found.select("submission_date", F.coalesce("found", F.from_json(F.lit("[]"), DATE_LIST)).alias("found"), F.coalesce("years", F.array().cast("array<int>")).alias("years"))
    return full.select(dates.agreement(F.col("found"), F.col("years"), F.col("submission_date")).alias("agreement")).groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))


def claim_keywords(spark, d):
    k = table(spark, d, "claims").select("claim_id", F.posexplode(text.keywords(F.col("claim"), STOPWORDS)).alias("pos", "keyword"))
    return k.select("claim_id", "pos", "keyword", F.array_join(text.keyword_forms(F.col("keyword")), ",").alias("forms"), text.stem(F.col("keyword")).alias("stem"))


FACT_CHECK_WORDS = ("fact check", "false", "misleading", "hoax", "faktencheck", "no evidence")


def claim_words_met(spark, d):
    """Which of a claim's keywords, in any simple form, stand in each passage, and whether it speaks of checking facts."""
    c = F.col
    kw = table(spark, d, "claims").select("claim_id", text.keywords(c("claim"), STOPWORDS).alias("kw"))
    words = spread(_ev(spark, d).filter("chunk is not null").select("evidence_id", "claim_id", "chunk")).select("evidence_id", "claim_id", F.array_distinct(text.tokens(c("chunk"))).alias("words"), text.has_marker(c("chunk"), FACT_CHECK_WORDS).alias("checks"))
    met = F.filter("kw", lambda k: text.contains_keyword(c("words"), k))
    return words.join(kw, "claim_id").select("evidence_id", F.array_join(met, ",").alias("met"), "checks")


def undated_claims(spark, d):
    """Claims without the dates they name."""
    c = F.col("claim")
    return table(spark, d, "claims").select("claim_id", text.without_dates(c, dates.extract_dates(c)).alias("undated"))


def claim_phrases(spark, d):
    return table(spark, d, "claims").select("claim_id", F.posexplode(text.phrases(F.col("claim"), STOPWORDS)).alias("pos", "phrase"))


def keyword_coverage(spark, d):
    """Share of a claim's keywords that stand in each of its passages."""
    kw = table(spark, d, "claims").select("claim_id", text.keywords(F.col("claim"), STOPWORDS).alias("kw"))
    j = _ev(spark, d).filter("chunk is not null").select("evidence_id", "claim_id", text.tokens(F.col("chunk")).alias("words")).join(kw, "claim_id")
    return j.select("evidence_id", F.size(F.array_intersect("kw", "words")).alias("n_hits"), F.try_divide(F.size(F.array_intersect("kw", "words")).cast("double"), F.size("kw")).alias("coverage"))


def text_helpers(spark, d):
    """Excerpt, sentences, numbers and the first shingle of each text."""
    c = F.col("text")
    of = table(spark, d, "documents").filter("text is not null").select("doc_id", text.squeezed(c).alias("squeezed"), text.excerpt(c).alias("excerpt"), text.sentences(c).alias("s"), F.array_join(text.numbers(c), ",").alias("numbers"), text.shingles(c).alias("sh"))
    return of.select("doc_id", F.md5("squeezed").alias("squeezed_md5"), "excerpt", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"), "numbers", F.size("sh").alias("n_shingles"), F.array_min("sh").alias("least_shingle"))


def redacted(spark, d):
    """Texts with account ids, keys and named secrets, put before them here, taken out."""
    c = F.concat(F.lit("org_Ab12cd34 sk-"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 14), F.lit(" Bearer abcdefghijkl.mn password: x"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.substring(text.redact(c), 1, 200).alias("redacted"), F.md5(text.redact(c)).alias("redacted_md5"))


def case_ids(spark, d):
    return table(spark, d, "claims").select("claim_id", text.case_id(F.lit("text"), F.col("claim")).alias("case_id"))


def near_duplicates(spark, d):
    return selection.near_duplicates(table(spark, d, "documents"), "doc_id", "text").select("id_a", "id_b", "overlap", "jaccard")


def contained_texts(spark, d):
    return selection.contained_texts(table(spark, d, "documents"), "doc_id", "text")


def best_by_url(spark, d):
    """The passage of greatest score of each claim and address, with the kinds of evidence of all of them."""
    rows = _ev(spark, d).select("claim_id", urls.canonical_url(F.col("url")).alias("canonical"), "evidence_id", "evidence_score", "evidence_type").filter("canonical <> ''")
    return selection.dedup_best(rows, ["claim_id", "canonical"], "evidence_score", "evidence_id", ["evidence_type"])


def text_classes(spark, d):
    return selection.text_classes(table(spark, d, "documents"), "doc_id", "text")


def greedy_dedup(spark, d):
    reps = selection.text_classes(table(spark, d, "documents"), "doc_id", "text").select(F.col("class_id").alias("id")).distinct()
    return selection.greedy_survivors(reps, near_duplicates(spark, d))


def chunks(spark, d):
    c = chunking.chunks(table(spark, d, "documents"), "doc_id", "text", 120)
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_words").alias("n_words"))


def context_windows(spark, d):
    rows = _ev(spark, d).filter("chunk is not null").select("claim_id", "pos", "chunk")
    return chunking.context_windows(rows, "claim_id", "pos", "chunk").select("claim_id", "pos", "n", F.md5("window").alias("window_md5"))


def cosine_topk(spark, d):
    """The five vectors nearest to each query vector (ids divisible by 20), against all, in blocks."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_top(v, "vec_id", "embedding", v.filter("vec_id % 20 = 0"), 5).select("query_id", F.col("id").alias("vec_id"), "rank")


def near_hashes(spark, d):
    """Pairs of vectors whose hashes of signs are at most fifteen of sixty bits apart."""
    v = table(spark, d, "embeddings").select("vec_id", hashes.sign_hash(F.col("embedding")).alias("h"))
    return hashes.hamming_pairs(v, "vec_id", "h", 15)


def confusion(spark, d):
    return metrics.confusion(_scored(spark, d), 0.5)


def confusion_by_type(spark, d):
    return metrics.confusion(_scored(spark, d), 0.5, ["evidence_type"], (0.4, 0.6))


def threshold_sweep(spark, d):
    return metrics.threshold_sweep(_scored(spark, d))


def best_threshold(spark, d):
    return metrics.best_threshold(_scored(spark, d)).select("threshold", "macro_f1", "tp", "fp", "tn", "fn")


def locked_evaluation(spark, d):
    """Passages of other kinds at the threshold that is best on scraped articles."""
    s = _scored(spark, d)
    scraped = F.col("evidence_type") == "scraped_article"
    return metrics.locked(s.filter(scraped), s.filter(~scraped), ["evidence_type"])


def reliability_bins(spark, d):
    return metrics.reliability_bins(_scored(spark, d))


def calibration_error(spark, d):
    return metrics.calibration_error(_scored(spark, d))


def auc_by_type(spark, d):
    return metrics.auc(_scored(spark, d), ["evidence_type"])


def uncertainty_band(spark, d):
    return metrics.uncertainty_bands(_scored(spark, d))


def temperature(spark, d):
    return metrics.temperature(_scored(spark, d), [0.25 + 0.05 * i for i in range(96)])


def ensemble_scores(spark, d):
    models = _ev(spark, d).select(F.col("evidence_id").alias("id"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in ("nli_score", "raw_nli_score", "source_reliability")))).alias("m")).select("id", "m.model", "m.p").filter("p is not null")
    return metrics.ensemble(models, 3)


def bootstrap_gain(spark, d):
    ok = _scored(spark, d).filter("p is not null").select(F.col("evidence_id").alias("id"), ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int").alias("a"), ((F.col("p") >= 0.3) == (F.col("y") == 1)).cast("int").alias("b"))
    return metrics.paired_bootstrap(ok, 200)


def duplicate_files(spark, d):
    return audit.duplicate_groups(_manifests(spark, d), "row_id", ["file_size_bytes", "duration_sec"])


def label_conflicts(spark, d):
    return audit.conflicts(table(spark, d, "fvc"), ["video_url"], "label").select("video_url", F.array_join("labels", ",").alias("labels"), "n")


def linked_components(spark, d):
    """Manifest rows linked by cascade, address or content (size and duration): the smallest row id of each component."""
    m = _manifests(spark, d)
    bare = F.regexp_replace(F.lower("cascade_id"), r"[^\p{L}\p{N}]+", "")
    kinds = {"c": F.when(bare != "", bare), "u": F.col("actual_url"), "f": F.when(F.col("file_size_bytes").isNotNull() & F.col("duration_sec").isNotNull(), F.concat_ws("|", F.col("file_size_bytes").cast("string"), F.round(F.col("duration_sec") * 1000).cast("long").cast("string")))}
    keyed = m.select("row_id", F.explode(F.array(*(F.concat(F.lit(k), v) for k, v in kinds.items()))).alias("k"))
    return audit.components(m.select(F.col("row_id").alias("id")), audit.star_edges(keyed, "row_id", "k"))


def grouped_split(spark, d):
    """Rows of each split and label when whole components are drawn."""
    c = linked_components(spark, d).withColumnRenamed("id", "row_id")
    return audit.grouped_split(_manifests(spark, d).drop("split").join(c, "row_id"), "component", "label").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def held_out_split(spark, d):
    """The same with components that have a row of a fallback source held out for the test."""
    c = linked_components(spark, d).withColumnRenamed("id", "row_id")
    m = _manifests(spark, d).drop("split").join(c, "row_id")
    return audit.grouped_split(m, "component", "label", held_out=F.col("used_fallback")).groupBy("split", "label", "used_fallback").agg(F.count(F.lit(1)).alias("n"))


def scored_manifest(spark, d):
    """Scores joined to the rows of the manifests by id, rows without one among them, by split and quality of the picture."""
    s = _scored(spark, d).select(F.col("evidence_id").alias("row_id"), "y", "p").filter("p is not null")
    j = _manifests(spark, d).join(s, "row_id", "left")
    return j.groupBy("split", (F.greatest("width", "height") > 1024).alias("large")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("p").alias("n_scored"), F.count_if((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("n_right"))


STAGES = [("^(?:view|open|visit)", "seen"), ("click|search|play", "used"), ("cart|buy|purchase|pay", "bought")]


def progress_stages(spark, d):
    """Events by the first stage whose pattern their kind matches; the same operator works on a stream."""
    e = progress.staged_progress(table(spark, d, "events").select("event_type"), "event_type", STAGES)
    return e.groupBy("event_type", "stage").agg(F.count(F.lit(1)).alias("n"))


def split_leaks(spark, d):
    return audit.shared_keys(_manifests(spark, d), "actual_url", "split").select("actual_url", F.array_join("splits", ",").alias("splits"))


def split_precedence(spark, d):
    return audit.split_by_precedence(_manifests(spark, d), "actual_url", "split").select("row_id", "actual_url", "split")


def class_statistics(spark, d):
    return audit.class_statistics(_manifests(spark, d), "label", ["duration_sec", "file_size_bytes"])


def resolution_buckets(spark, d):
    long_side = F.greatest("width", "height")
    b = F.when(long_side <= 256, "tiny").when(long_side <= 512, "small").when(long_side <= 1024, "medium").otherwise("large")
    return _manifests(spark, d).groupBy("split", b.alias("bucket"), urls.modality(F.col("file_name")).alias("modality")).agg(F.count(F.lit(1)).alias("n"))


def gap_islands(spark, d):
    return timeline.gap_islands(_events(spark, d), "user_id", "us", MERGE_GAP * 1e6)


def merged_observations(spark, d):
    return timeline.merge_observations(_events(spark, d), "user_id", "us", "event_type", 7200e6, 0.7, "event_id", "value")


def _intervals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, d)
    speech = e.filter("event_id % 2 = 0").select("user_id", F.col("event_id").alias("speech_id"), F.col("us").alias("s_from"), (F.col("us") + 600_000_000).alias("s_to"))
    ocr = e.filter("event_id % 2 = 1").select("user_id", F.col("event_id").alias("ocr_id"), F.col("us").alias("o_from"), F.col("us").alias("o_to"))
    return speech, ocr


def interval_join(spark, d):
    s, o = _intervals(spark, d)
    return timeline.interval_join(s, o, "user_id", "s_from", "s_to", "o_from", "o_to", JOIN_TOLERANCE * 1e6, JOIN_WIDTH * 1e6).select("user_id", "speech_id", "ocr_id")


def interval_anti_join(spark, d):
    s, o = _intervals(spark, d)
    return timeline.interval_join(s, o, "user_id", "s_from", "s_to", "o_from", "o_to", JOIN_TOLERANCE * 1e6, JOIN_WIDTH * 1e6, "anti").select("user_id", "speech_id")


def sliding_means(spark, d):
    return timeline.sliding_means(_events(spark, d).withColumn("h", F.col("us") / 3_600_000_000), "user_id", "h", "value", 24.0, 6.0)


def sampled_events(spark, d):
    return timeline.sampled(_events(spark, d), "user_id", "event_id", 15).select("user_id", "event_id")


def fused_timeline(spark, d):
    """Events of even number as speech, of odd number as screen texts."""
    s, o = _intervals(spark, d)
    kinds = _events(spark, d).select("event_id", "event_type")
    s = s.join(kinds.withColumnsRenamed({"event_id": "speech_id", "event_type": "s_text"}), "speech_id")
    o = o.join(kinds.withColumnsRenamed({"event_id": "o_id", "event_type": "o_text"}), F.col("ocr_id") == F.col("o_id")).drop("ocr_id")
    return media.fused(s, o, "user_id", JOIN_TOLERANCE * 1e6, JOIN_WIDTH * 1e6)


def window_decisions(spark, d):
    return media.window_decisions(_scored(spark, d).join(_ev(spark, d).select("evidence_id", "claim_id"), "evidence_id"), "claim_id", "p")


def folded_labels(spark, d):
    """Raw and final labels of passages folded to the best of the three."""
    both = _ev(spark, d).select("evidence_id", F.explode(F.array(F.struct(F.col("nli_label").alias("label"), F.col("nli_score").alias("score")), F.struct(F.col("raw_nli_label").alias("label"), F.col("raw_nli_score").alias("score")))).alias("x"))
    return media.folded_labels(both.select("evidence_id", "x.label", "x.score"), "evidence_id", "label", "score")


def worst_errors(spark, d):
    return media.errors(_scored(spark, d), "evidence_id", "y", "p", 0.5, "evidence_type")


def event_properties(spark, d):
    """Numbers of the flat JSON of events."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def claim_profiles(spark, d):
    """Facts of each claim in one row: dates, years, keywords and numbers."""
    c = F.col("claim")
    spelt = F.transform(dates.extract_dates(c), lambda x: F.concat_ws("-", x["year"].cast("string"), x["month"].cast("string"), x["day"].cast("string")))
    lists = {"dates": spelt, "years": dates.years(c).cast("array<string>"), "keywords": text.keywords(c, STOPWORDS), "numbers": text.numeric_details(c)}
    return table(spark, d, "claims").select("claim_id", *(F.array_join(v, ",").alias(k) for k, v in lists.items()))


#: Columns whose last digits depend on the order of sums, and how many decimals both sides of the check keep.
DECIMALS = {
    "agreement": {"agreement_score": 9, "coverage": 9}, "fusion_scores": {"fusion_score": 9}, "class_counts": {"scraped_share": 9}, "evidence_scores": {"score": 12, "capped": 12}, "evidence_classes": {"class_score": 12}, "uncertainty_band": {"accuracy": 9, "uncertain_rate": 9}, "temperature": {"nll": 9, "t": 6}, "keyword_coverage": {"coverage": 9}, "near_duplicates": {"jaccard": 9}, "contained_texts": {"containment": 9},
    **{q: dict.fromkeys(("accuracy", "precision", "recall", "f1", "macro_f1", "fpr", "fnr", "balanced_accuracy"), 9) for q in ("confusion", "confusion_by_type", "threshold_sweep", "locked_evaluation")},
    "best_threshold": {"macro_f1": 9}, "reliability_bins": {"mean_predicted": 9, "observed_rate": 9}, "calibration_error": {"ece": 9}, "auc_by_type": {"auc": 9}, "ensemble_scores": {"p_mean": 9, "p_vote": 9},
    "class_statistics": {"duration_sec_mean": 6, "duration_sec_median": 6, "duration_sec_std": 6, "file_size_bytes_mean": 3, "file_size_bytes_median": 3, "file_size_bytes_std": 3}, "sliding_means": {"mean": 9}, "window_decisions": {"mean": 9},
}


def _rounded(f):
    @wraps(f)
    def query(spark: SparkSession, d: str) -> DataFrame:
        return f(spark, d).withColumns({c: F.round(c, n) for c, n in DECIMALS[f.__name__].items()})

    return query if f.__name__ in DECIMALS else f


QUERIES = {
    f.__name__: _rounded(f)
    for f in (
        canonical_urls, url_parts, source_tiers, evidence_classes, event_matches, date_statuses, date_bindings, dedup_by_url, diverse_topk, evidence_scores, source_decisions, publisher_decisions, agreement, fusion_scores, best_passages, reconciled, class_counts,
        claim_dates, claim_years, date_agreement, claim_keywords, claim_words_met, undated_claims, claim_phrases, keyword_coverage, text_helpers, redacted, case_ids, near_duplicates, contained_texts, best_by_url, text_classes, greedy_dedup, chunks, context_windows, cosine_topk, near_hashes,
        confusion, confusion_by_type, threshold_sweep, best_threshold, locked_evaluation, reliability_bins, calibration_error, auc_by_type, uncertainty_band, temperature, ensemble_scores, bootstrap_gain,
        duplicate_files, label_conflicts, linked_components, grouped_split, held_out_split, scored_manifest, progress_stages, split_leaks, split_precedence, class_statistics, resolution_buckets,
        gap_islands, merged_observations, interval_join, interval_anti_join, sliding_means, sampled_events, fused_timeline, window_decisions, folded_labels, worst_errors, event_properties, claim_profiles,
    )
}
