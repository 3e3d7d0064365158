"""SQL of the reference queries for the side-by-side check."""

from tesserine.plans.reference import DECIMALS

_CAMPAIGN = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','dclid','msclkid','mc_cid','mc_eid','igshid','ref','referrer','source','cmpid','spm','yclid','_hsenc','_hsmi','at_medium','at_campaign','ito','ns_campaign','ns_mchannel'"
_URL = rf"""
u0 AS (
  SELECT *, lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) AS auth,
    regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1) AS q
  FROM trace_real_evidence),
u AS (
  SELECT *, regexp_replace(regexp_replace(auth, '^[^@]*@', ''), '^(?:www\.|m\.|amp\.)', '') AS chost,
    array_to_string(list_sort(list_transform(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({_CAMPAIGN})), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS cq,
    split_part(regexp_replace(auth, '^.*@', ''), ':', 1) AS host
  FROM u0),
e AS (
  SELECT *, coalesce(CASE WHEN chost = '' THEN lower(trim(url)) ELSE chost || regexp_replace(path, '/+$', '') || CASE WHEN cq <> '' THEN '?' || cq ELSE '' END END, '') AS canonical,
    regexp_replace(host, '^(?:www\.|m\.)', '') AS bare FROM u),
ev AS (
  SELECT *, CASE WHEN len(string_split(bare, '.')) <= 2 THEN bare ELSE array_to_string(string_split(bare, '.')[-2:], '.') END AS registrable,
    CASE WHEN canonical <> '' THEN 'url:' || canonical WHEN coalesce(source_id, '') <> '' THEN 'sid:' || source_id ELSE 'unresolved:' || pos END AS source_key FROM e)
"""
_TRACKING = "'utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid'"
_URL_PARTS = rf"""
WITH {_URL}, n AS (
  SELECT *, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKING}) AND regexp_extract(p, '([^=]*)$', 1) <> ''), '&') AS nq FROM ev)
SELECT evidence_id, CASE WHEN scheme <> '' THEN scheme || '://' ELSE '' END || auth || regexp_replace(path, '/+$', '') || CASE WHEN nq <> '' THEN '?' || nq ELSE '' END AS normalized,
  regexp_replace(auth, '^(?:www\.|m\.)', '') AS domain_of, host, registrable, coalesce(regexp_matches(url, '^(?i)https?://\S+$') AND length(url) <= 2048, false) AS valid, lower(regexp_replace(path, '/+$', '')) AS path_key FROM n
"""
_SOURCES = f"""
{_URL}, r AS (
  SELECT claim_id, pos, source_key, coalesce(nullif(lower(trim(independence_group)), ''), nullif(registrable, ''), lower(trim(domain)), '') AS publisher, evidence_class AS k, evidence_type AS t, coalesce(evidence_score, 0.0) AS score,
    coalesce(is_primary_source, false) AS prim, coalesce(evidence_class = 'CONTRADICTION' AND debunking AND (date_status = 'different' OR detail_coverage >= 0.30), false) AS corr FROM ev),
g AS (
  SELECT claim_id, source_key, count(*) AS n_chunks, max(score) FILTER (k = 'SUPPORT') AS s, max(score) FILTER (k = 'CONTRADICTION') AS c, max(score) FILTER (k = 'RELATED_CONTEXT') AS x, max(score) AS top,
    coalesce(bool_and(t = 'search_snippet'), false) AS snippet_only, coalesce(bool_or(t IN ('scraped_article', 'search_extract')), false) AS has_article, bool_or(prim) AS any_primary, bool_or(corr) AS has_correction,
    count(DISTINCT t) FILTER (t IN ('scraped_article', 'search_extract', 'search_snippet')) AS n_modes, min(t) FILTER (t IN ('scraped_article', 'search_extract', 'search_snippet')) AS mode, arg_min(publisher, pos) AS publisher FROM r GROUP BY 1, 2),
d AS (
  SELECT *, CASE WHEN s IS NOT NULL AND c IS NOT NULL THEN CASE WHEN s > c + CAST(0.1 AS DOUBLE) THEN 'entailment' WHEN c > s + CAST(0.1 AS DOUBLE) THEN 'contradiction' ELSE 'neutral' END
    WHEN s IS NOT NULL THEN 'entailment' WHEN c IS NOT NULL THEN 'contradiction' WHEN x IS NOT NULL THEN 'related_context' ELSE 'non_evidence' END AS raw FROM g),
src AS (
  SELECT claim_id, source_key, publisher, CASE WHEN snippet_only AND raw IN ('entailment', 'contradiction') THEN 'related_context' ELSE raw END AS decision,
    CASE WHEN raw = 'entailment' THEN s WHEN raw = 'contradiction' THEN c WHEN raw = 'neutral' THEN greatest(s, c) ELSE coalesce(x, top) END AS source_score,
    CASE WHEN n_modes = 0 THEN 'unknown' WHEN n_modes = 1 THEN mode ELSE 'mixed' END AS retrieval_mode, n_chunks, any_primary AND NOT snippet_only AS is_primary, snippet_only, has_article, has_correction,
    source_key LIKE 'url:%' AND publisher <> '' AS identity_resolved FROM d),
pg AS (
  SELECT claim_id, publisher, count(*) AS n_sources, max(source_score) FILTER (decision = 'entailment') AS s, max(source_score) FILTER (decision = 'contradiction') AS c, max(source_score) AS publisher_score, bool_or(decision = 'related_context') AS ctx,
    bool_and(snippet_only) AS snippet_only, bool_or(has_article) AS has_article, bool_or(is_primary) AS is_primary, bool_or(has_correction) AS has_correction, bool_or(is_primary AND has_correction) AS has_primary_correction FROM src WHERE identity_resolved GROUP BY 1, 2),
pub AS (
  SELECT claim_id, publisher, CASE WHEN s IS NOT NULL AND c IS NOT NULL THEN CASE WHEN s >= c + CAST(0.1 AS DOUBLE) THEN 'entailment' WHEN c >= s + CAST(0.1 AS DOUBLE) THEN 'contradiction' ELSE 'neutral' END
    WHEN s IS NOT NULL THEN 'entailment' WHEN c IS NOT NULL THEN 'contradiction' WHEN ctx THEN 'context' ELSE 'non_evidence' END AS decision, n_sources, publisher_score, snippet_only, has_article, is_primary, has_correction, has_primary_correction FROM pg),
a1 AS (
  SELECT claim_id, count(*) AS n_sources, CAST(sum(n_chunks) AS BIGINT) AS n_chunks, count(*) FILTER (decision = 'entailment') AS supporting_sources, count(*) FILTER (decision = 'contradiction') AS contradicting_sources, count(*) FILTER (snippet_only) AS snippet_only_sources,
    count(*) FILTER (has_article) AS article_sources, count(*) FILTER (NOT identity_resolved) AS unresolved_sources FROM src GROUP BY 1),
a2 AS (
  SELECT claim_id, count(*) AS publishers, count(*) FILTER (decision = 'entailment') AS supporting, count(*) FILTER (decision = 'contradiction') AS contradicting, count(*) FILTER (decision = 'entailment' AND is_primary) AS primary_supporting,
    count(*) FILTER (decision = 'contradiction' AND is_primary) AS primary_contradicting, count(*) FILTER (decision = 'entailment' AND has_article) AS article_supporting, count(*) FILTER (decision = 'contradiction' AND has_article) AS article_contradicting,
    count(*) FILTER (has_correction) AS correcting, count(*) FILTER (has_primary_correction) AS primary_correcting FROM pub GROUP BY 1),
a3 AS (
  SELECT a1.*, coalesce(publishers, 0) AS publishers, coalesce(supporting, 0) AS supporting, coalesce(contradicting, 0) AS contradicting, coalesce(primary_supporting, 0) AS primary_supporting, coalesce(primary_contradicting, 0) AS primary_contradicting,
    coalesce(article_supporting, 0) AS article_supporting, coalesce(article_contradicting, 0) AS article_contradicting, coalesce(correcting, 0) AS correcting, coalesce(primary_correcting, 0) AS primary_correcting FROM a1 LEFT JOIN a2 USING (claim_id)),
a4 AS (
  SELECT *, CASE WHEN supporting + contradicting = 0 THEN CAST(0 AS DOUBLE) WHEN supporting > 0 AND contradicting > 0 THEN CAST(0.5 AS DOUBLE) * greatest(supporting, contradicting) / (supporting + contradicting)
    WHEN supporting > 0 THEN CAST(0.3 AS DOUBLE) + CAST(0.7 AS DOUBLE) * supporting / greatest(1, publishers) ELSE CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * contradicting / greatest(1, publishers) END AS z FROM a3),
a5 AS (SELECT *, CASE WHEN (supporting > 0 AND primary_supporting = 0) OR (contradicting > 0 AND primary_contradicting = 0) THEN least(z, CAST(0.35 AS DOUBLE)) ELSE z END AS y FROM a4),
agr AS (SELECT * EXCLUDE (z, y), CASE WHEN supporting = 1 AND contradicting = 0 THEN least(y, CAST(0.65 AS DOUBLE)) ELSE y END AS agreement_score, article_sources / n_sources AS coverage FROM a5)
"""
_FUSION = f"""
WITH {_SOURCES}, t AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY publisher_score DESC, publisher) AS rn FROM pub WHERE decision IN ('entailment', 'contradiction')),
n AS (SELECT claim_id, count(*) AS n, avg(least(CAST(0.9 AS DOUBLE), publisher_score)) FILTER (rn <= 4) AS strength, bool_or(snippet_only) AS snip, bool_or(has_article) AS art FROM t GROUP BY 1),
f AS (SELECT *, strength * CAST(0.55 AS DOUBLE) + agreement_score * CAST(0.25 AS DOUBLE) + least(CAST(1 AS DOUBLE), (n - 1) / 2.0) * CAST(0.2 AS DOUBLE) AS s0 FROM agr LEFT JOIN n USING (claim_id)),
f1 AS (SELECT *, CASE WHEN snip AND NOT art THEN least(s0, CAST(0.45 AS DOUBLE)) ELSE s0 END AS s1 FROM f), f2 AS (SELECT *, CASE WHEN n = 1 THEN least(s1, CAST(0.62 AS DOUBLE)) ELSE s1 END AS s2 FROM f1),
f3 AS (SELECT *, CASE WHEN supporting > 0 AND contradicting > 0 THEN least(s2, CAST(0.5 AS DOUBLE)) ELSE s2 END AS s3 FROM f2)
SELECT claim_id, coalesce(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), s3)), CAST(0 AS DOUBLE)) AS fusion_score FROM f3
"""
_SCORED = """
sc AS (SELECT evidence_id, evidence_type, CAST(evidence_class = 'SUPPORT' AS INTEGER) AS y, round(CASE WHEN nli_label = 'entailment' THEN nli_score WHEN nli_label = 'contradiction' THEN 1 - nli_score END, 4) AS p
  FROM trace_real_evidence WHERE evidence_class IN ('SUPPORT', 'CONTRADICTION')),
s AS (SELECT * FROM sc WHERE p IS NOT NULL)
"""
_D = "CAST({} AS DOUBLE)"


def _rates(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    def ratio(a, b):
        return f"CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END"

    def or0(x):
        return f"coalesce({x}, 0)"

    f1, f0 = or0(ratio(f"(2*{tp})", f"(2*{tp}+{fp}+{fn})")), or0(ratio(f"(2*{tn})", f"(2*{tn}+{fp}+{fn})"))
    return ", ".join(
        (
            f"{ratio(f'({tp}+{tn})', f'({tp}+{fp}+{tn}+{fn})')} AS accuracy", f"{or0(ratio(tp, f'({tp}+{fp})'))} AS precision", f"{or0(ratio(tp, f'({tp}+{fn})'))} AS recall", f"{f1} AS f1", f"(({f1}) + ({f0})) / 2 AS macro_f1",
            f"{ratio(fp, f'({tn}+{fp})')} AS fpr", f"{ratio(fn, f'({tp}+{fn})')} AS fnr", f"(({ratio(tp, f'({tp}+{fn})')}) + ({ratio(tn, f'({tn}+{fp})')})) / 2 AS balanced_accuracy",
        )
    )


_SWEEP = f"""
{_SCORED}, g AS (SELECT CAST(range AS INTEGER) AS i FROM range(101)),
w AS (SELECT i / 100 AS threshold, count(*) FILTER (p * 100 + 1e-9 >= i AND y = 1) AS tp, count(*) FILTER (p * 100 + 1e-9 >= i AND y <> 1) AS fp, count(*) FILTER (p * 100 + 1e-9 < i AND y <> 1) AS tn, count(*) FILTER (p * 100 + 1e-9 < i AND y = 1) AS fn FROM g, s GROUP BY i),
sweep AS (SELECT *, {_rates()} FROM w)
"""
_BINS = f"""
{_SCORED}, b AS (SELECT greatest(1, least(10, CAST(ceil(p * 10 - 1e-9) AS INTEGER))) AS bin, count(*) AS n, avg(p) AS mean_predicted, avg(CAST(y AS DOUBLE)) AS observed_rate FROM s GROUP BY 1),
bins AS (SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_predicted, observed_rate FROM range(1, 11) r LEFT JOIN b ON b.bin = r.range)
"""
_M = """
m AS (SELECT *, 'train' AS split FROM train_manifest UNION ALL BY NAME SELECT *, 'val' AS split FROM val_manifest UNION ALL BY NAME SELECT *, 'test' AS split FROM test_manifest)
"""
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
_IV = f"""
{_E}, sp AS (SELECT user_id, event_id AS speech_id, us AS a, us + 600000000 AS b FROM e WHERE event_id % 2 = 0), oc AS (SELECT user_id, event_id AS ocr_id, us AS o FROM e WHERE event_id % 2 = 1)
"""
_STOP = "'" + "','".join("the a an and or of to in on at for is are was were be been that this by from with as about into over after before it its he she they not no but if than then so such also will would can may might do does did has had have nor".split()) + "'"
_KW = rf"""
w AS (SELECT claim_id, claim, regexp_extract_all(lower(claim), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}''-]*') AS t FROM claims),
i AS (SELECT claim_id, unnest(t) AS k, unnest(generate_series(1, len(t))) AS p FROM w),
f AS (SELECT claim_id, k, min(p) AS p FROM i WHERE length(k) >= 2 AND (length(k) >= 3 OR regexp_matches(k, '[^\p{{L}}]')) AND k NOT IN ({_STOP}) GROUP BY 1, 2),
kw AS (SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY p) - 1 AS INTEGER) AS pos, k AS keyword FROM f)
"""
_SH = r"""
t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t),
x AS (SELECT * FROM sh WHERE len(s) > 0), c AS (SELECT id, s, min(id) OVER (PARTITION BY s) AS class_id FROM x)
"""

_TIERS = f"""
WITH {_URL}, b AS (SELECT domain, source_tier, count(*) AS n FROM trace_real_evidence WHERE domain IS NOT NULL AND source_tier <> 'unknown' GROUP BY 1, 2),
lex AS (SELECT lower(domain) AS v, lower(domain) AS tail, source_tier AS tier FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, source_tier DESC) AS rn FROM b) WHERE rn = 1 UNION SELECT '.gov', 'gov', 'official'),
o AS (SELECT unnest(['user_generated', 'aggregator_portal', 'established_wire', 'official', 'major_outlet', 'regional/general_news', 'weak/blog']) AS tier, unnest([1, 2, 3, 4, 5, 6, 7]) AS r),
h AS (SELECT evidence_id, evidence_type, url, regexp_replace(host, '^www\\.', '') AS hh FROM ev),
c AS (SELECT evidence_id, v, tier FROM h JOIN lex ON hh = tail OR ends_with(hh, '.' || tail)
  UNION SELECT evidence_id, m, 'weak/blog' FROM h, (SELECT unnest(['blog', 'gazette']) AS m) WHERE contains(hh, m) UNION SELECT evidence_id, '/live/', 'user_generated' FROM h WHERE hh <> '' AND contains(lower(url), '/live/')),
w AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY r, length(v) DESC, v DESC) AS rn FROM c JOIN o USING (tier)),
t AS (SELECT h.evidence_id, evidence_type AS m, coalesce(tier, 'unknown') AS tier, v AS tier_reason FROM h LEFT JOIN (SELECT * FROM w WHERE rn = 1) w ON w.evidence_id = h.evidence_id),
s AS (SELECT *, CAST(CASE tier WHEN 'official' THEN 0.95 WHEN 'established_wire' THEN 0.92 WHEN 'major_outlet' THEN 0.82 WHEN 'regional/general_news' THEN 0.68 WHEN 'aggregator_portal' THEN 0.45 WHEN 'weak/blog' THEN 0.32 WHEN 'user_generated' THEN 0.15 ELSE 0.55 END AS DOUBLE) AS b FROM t),
q AS (SELECT *, CASE m WHEN 'search_extract' THEN least(b * CAST(0.8 AS DOUBLE), CAST(0.62 AS DOUBLE)) WHEN 'search_snippet' THEN least(b * CAST(0.65 AS DOUBLE), CAST(0.4 AS DOUBLE)) ELSE b END AS s FROM s)
SELECT evidence_id, tier, tier_reason, CASE WHEN tier IN ('weak/blog', 'user_generated') THEN least(s, CAST(CASE WHEN m = 'scraped_article' THEN 0.32 ELSE 0.22 END AS DOUBLE)) ELSE s END AS reliability,
  coalesce(tier IN ('official', 'established_wire', 'major_outlet', 'regional/general_news') AND m <> 'search_snippet', false) AS is_primary FROM q
"""
_WS = "[ \\t\\n\\x0B\\f\\r]+"
_HELPERS = rf"""
WITH x0 AS (SELECT doc_id, text, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS q FROM documents WHERE text IS NOT NULL),
y AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]){_WS}', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '') AS s,
  list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?%?'), lambda n: regexp_matches(n, '^\d')) AS n FROM x0),
{_SH.strip()}
SELECT doc_id, md5(q) AS squeezed_md5, CASE WHEN length(q) <= 420 THEN q ELSE rtrim(substr(q, 1, 420)) || '…' END AS excerpt, CAST(len(y.s) AS INTEGER) AS n_sentences, md5(array_to_string(y.s, chr(10))) AS sentences_md5,
  array_to_string(list_filter(n, lambda v, i: list_position(n, v) = i), ',') AS numbers, CAST(len(sh.s) AS INTEGER) AS n_shingles, list_min(sh.s) AS least_shingle FROM y JOIN sh ON sh.id = y.doc_id
"""
_REDACTED = r"""
WITH x AS (SELECT doc_id, 'org_Ab12cd34 sk-' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 14) || ' Bearer abcdefghijkl.mn password: x' || doc_id || ' ' || text AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b(?:gsk|sk|xai|groq|tvly|tavily)[-_][\w-]{12,}', '[redacted-key]', 'g'), '(?i)\bbearer\s+[\w.-]{12,}', 'Bearer [redacted]', 'g') AS t FROM x),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b(api[_-]?key|apikey|secret|token|password|authorization)\s*[:=]\s*\S+', '\1=[redacted]', 'g'), '\b(org|proj)_[A-Za-z0-9]{6,}\b', '\1_[redacted]', 'g') AS t FROM a)
SELECT doc_id, substr(t, 1, 200) AS redacted, md5(t) AS redacted_md5 FROM b
"""
_LINKED = rf"""
{_M.strip()}, k AS (
  SELECT row_id, 'c' || nullif(regexp_replace(lower(cascade_id), '[^\p{{L}}\p{{N}}]+', '', 'g'), '') AS k FROM m UNION SELECT row_id, 'u' || actual_url FROM m
  UNION SELECT row_id, 'f' || file_size_bytes || '|' || CAST(round(duration_sec * 1000) AS BIGINT) FROM m),
e AS (SELECT a.row_id AS a, b.row_id AS b FROM k a JOIN k b USING (k)),
r AS (SELECT row_id AS id, row_id AS c FROM m UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
comp AS (SELECT id, min(c) AS component FROM r GROUP BY 1)
"""
_GROUPED = rf"""
WITH RECURSIVE {_LINKED.strip()}, g AS (SELECT component, min(label) AS l FROM comp JOIN m ON m.row_id = comp.id GROUP BY 1),
p AS (SELECT component, (CAST(('0x' || substr(md5(component || '|' || l || '|42'), 1, 8)) AS BIGINT) + 0.5) / 4294967296 AS p FROM g)
SELECT CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split, label, count(*) AS n FROM comp JOIN m ON m.row_id = comp.id JOIN p USING (component) GROUP BY 1, 2
"""
_CLASSES = """
WITH x AS (SELECT *, coalesce(date_status, 'unknown') AS st, coalesce(event_match, 'weak') AS em, lower(coalesce(raw_nli_label, 'neutral')) AS lab, coalesce(raw_nli_score, 0) AS ns, coalesce(similarity, 0) AS si, coalesce(detail_coverage, 0) AS cov, coalesce(evidence_type, '') = 'search_snippet' AS snip,
  coalesce(event_date_conflict, false) AS cf, coalesce(event_date_mismatch, false) AS mm, coalesce(location_match, false) AS lm, coalesce(claim_type, 'historical_event') IN ('historical_event', 'current_event') AS evt FROM trace_real_evidence),
y AS (SELECT *, NOT snip AND coalesce(is_primary_source, false) AND coalesce(nli_status, 'ok') NOT IN ('error', 'unavailable') AND si >= 0.4 AND (lm OR NOT coalesce(claim_has_location, false)) AS ok FROM x),
z AS (SELECT *, CASE
  WHEN evt AND ok AND coalesce(passage_kind, '') <> 'window' AND em = 'strong' AND (st = 'match' OR (st = 'different' AND coalesce(debunking, false)) OR cf) AND ((lab = 'contradiction' AND ns >= 0.75) OR cf) THEN 'CONTRADICTION'
  WHEN NOT evt AND ok AND coalesce(passage_kind, '') <> 'window' AND cov >= 0.3 AND NOT cf AND NOT mm AND lab = 'contradiction' AND ns >= 0.75 THEN 'CONTRADICTION'
  WHEN evt AND ok AND lab = 'entailment' AND ns >= 0.7 AND em = 'strong' AND cov >= 0.3 AND NOT cf AND NOT mm AND (st IN ('match', 'same_day_published') OR (ns >= 0.9 AND cov >= 0.5 AND st = 'unknown')) THEN 'SUPPORT'
  WHEN NOT evt AND ok AND lab = 'entailment' AND ns >= 0.7 AND cov >= 0.3 AND NOT cf AND NOT mm THEN 'SUPPORT'
  WHEN em IN ('moderate', 'strong') OR ((lm OR cov >= 0.3) AND ((st IN ('same_year', 'match') AND si >= 0.35) OR (st = 'different' AND si >= 0.45) OR snip)) THEN 'RELATED_CONTEXT' ELSE 'NON_EVIDENCE' END AS class FROM y)
"""
_SHORT_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_FULL_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"


def _dates(name: str, rows: str) -> str:
    """CTEs of the dates of ``rows`` (id, x): ``name`` with id, day, month, year, precision and their order o, distinct."""
    lead = r"(?:^|[^A-Za-z0-9])"
    dmy = rf"(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_SHORT_MONTHS})[a-z]{{0,6}}\.?,?\s+\d{{4}})"
    mdy = rf"((?:{_SHORT_MONTHS})[a-z]{{0,6}}\.?\s+\d{{1,2}}(?:\s*(?:st|nd|rd|th))?\s*,?\s+\d{{4}})"
    my = rf"((?:{_FULL_MONTHS}|{_SHORT_MONTHS}|sept)\.?,?\s+(?:of\s+)?\d{{4}})"

    def each(kind: int, source: str, pattern: str) -> str:
        return f"SELECT id, {kind} AS k, unnest(l) AS raw, unnest(generate_series(1, len(l))) AS i FROM (SELECT id, regexp_extract_all({source}, '{pattern}', 1) AS l FROM {name}_t)"

    month = f"CAST(list_position(string_split('{_SHORT_MONTHS}', '|'), lower(substr({{}}, 1, 3))) AS INTEGER)"
    return rf"""
{name}_t AS (SELECT id, x, regexp_replace(regexp_replace(x, '(?i){lead}{dmy}', '  ', 'g'), '(?i){lead}{mdy}', '  ', 'g') AS rest FROM ({rows})),
{name}_r AS ({each(0, "x", f"(?i){lead}{dmy}")} UNION ALL {each(1, "x", f"(?i){lead}{mdy}")} UNION ALL {each(2, "x", r"(?:^|[^0-9])(\d{4}-\d{1,2}-\d{1,2})")} UNION ALL {each(3, "x", r"(?:^|[^0-9])(\d{1,2}[/-]\d{1,2}[/-]\d{4})")} UNION ALL {each(9, "rest", f"(?i){lead}{my}")}),
{name}_p AS (
  SELECT id, k, i, 0 AS j, TRY_CAST(regexp_extract(raw, '^(\d+)', 1) AS INTEGER) AS day, {month.format("regexp_extract(raw, '[A-Za-z]{3,}')")} AS month, TRY_CAST(right(raw, 4) AS INTEGER) AS year FROM (SELECT * REPLACE (regexp_replace(raw, '(?i)(\d)(st|nd|rd|th)', '\1') AS raw) FROM {name}_r) WHERE k = 0
  UNION ALL SELECT id, k, i, 0, TRY_CAST(regexp_extract(raw, '[A-Za-z.]\s+(\d{{1,2}})', 1) AS INTEGER), {month.format("raw")}, TRY_CAST(right(raw, 4) AS INTEGER) FROM {name}_r WHERE k = 1
  UNION ALL SELECT id, k, i, 0, TRY_CAST(split_part(raw, '-', 3) AS INTEGER), TRY_CAST(split_part(raw, '-', 2) AS INTEGER), TRY_CAST(split_part(raw, '-', 1) AS INTEGER) FROM {name}_r WHERE k = 2
  UNION ALL SELECT id, k, i, j, TRY_CAST(regexp_extract(raw, CASE j WHEN 0 THEN '^(\d+)' ELSE '^\d+[/-](\d+)' END, 1) AS INTEGER), TRY_CAST(regexp_extract(raw, CASE j WHEN 1 THEN '^(\d+)' ELSE '^\d+[/-](\d+)' END, 1) AS INTEGER), TRY_CAST(right(raw, 4) AS INTEGER) FROM {name}_r, (SELECT unnest([0, 1]) AS j) WHERE k = 3
  UNION ALL SELECT id, k, i, 0, NULL, {month.format("raw")}, TRY_CAST(right(raw, 4) AS INTEGER) FROM {name}_r WHERE k = 9),
{name} AS (SELECT id, day, month, year, CASE WHEN day IS NULL THEN 'month' ELSE 'day' END AS precision, min(k * 100000 + i * 2 + j) AS o FROM {name}_p
  WHERE year BETWEEN 1900 AND 2100 AND (day IS NULL OR TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', year, month, day) AS DATE) IS NOT NULL) GROUP BY id, day, month, year)
"""


_YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all({}, '\b((?:19|20)\d{{2}})\b', 1), lambda y: CAST(y AS INTEGER))))"
_STATUSES = f"""
WITH {_dates("cd", "SELECT claim_id AS id, claim AS x FROM claims").strip()}, {_dates("ed", "SELECT evidence_id AS id, chunk AS x FROM trace_real_evidence WHERE chunk IS NOT NULL").strip()},
cl AS (SELECT claim_id, day, month, year, {_YEARS.format("claim")} AS cy FROM claims LEFT JOIN (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1) f ON f.id = claim_id),
ev AS (SELECT evidence_id, claim_id, {_YEARS.format("chunk")} AS ey FROM trace_real_evidence WHERE chunk IS NOT NULL),
j AS (SELECT evidence_id, any_value(cl.day) AS cday, any_value(cl.month) AS cmonth, any_value(cl.year) AS cyear, any_value(cy) AS cy, any_value(ey) AS ey, count(ed.id) AS n,
    coalesce(bool_or(ed.year = cl.year AND ed.month = cl.month), false) AS same_month, coalesce(bool_or(ed.year = cl.year AND ed.month <> cl.month), false) AS other_month, coalesce(bool_or(ed.year = cl.year AND ed.month = cl.month AND ed.day = cl.day), false) AS same_day,
    coalesce(bool_or(ed.year = cl.year AND ed.month = cl.month AND ed.day <> cl.day), false) AS other_day, coalesce(bool_or(ed.year <> cl.year), false) AS other_year
  FROM ev JOIN cl USING (claim_id) LEFT JOIN ed ON ed.id = evidence_id GROUP BY evidence_id),
y AS (SELECT *, len(list_intersect(cy, ey)) > 0 AS ys FROM j)
SELECT evidence_id, CASE WHEN (cmonth IS NULL AND len(cy) = 0) OR (n = 0 AND len(ey) = 0) THEN 'unknown'
  WHEN cmonth IS NOT NULL AND cday IS NULL AND same_month THEN 'match' WHEN cmonth IS NOT NULL AND cday IS NULL AND other_month THEN 'different'
  WHEN cday IS NOT NULL AND same_day THEN 'match' WHEN cday IS NOT NULL AND (other_month OR other_day OR (other_year AND NOT ys)) THEN 'different'
  WHEN ys THEN 'same_year' WHEN (len(cy) > 0 AND len(ey) > 0) OR (cmonth IS NOT NULL AND cday IS NULL) THEN 'different' ELSE 'unknown' END AS status FROM y
"""
_AGREEMENT = f"""
WITH {_dates("ed", "SELECT evidence_id AS id, chunk AS x FROM trace_real_evidence WHERE chunk IS NOT NULL").strip()},
g AS (SELECT evidence_id, any_value(submission_date) AS c, coalesce(any_value({_YEARS.format("chunk")}), []) AS ey, count(ed.id) AS n, coalesce(bool_or(ed.day = day(submission_date) AND ed.month = month(submission_date) AND ed.year = year(submission_date)), false) AS exact, coalesce(bool_or(ed.year = year(submission_date)), false) AS same
  FROM trace_real_evidence JOIN claims USING (claim_id) LEFT JOIN ed ON ed.id = evidence_id GROUP BY evidence_id)
SELECT CASE WHEN c IS NULL THEN NULL WHEN exact THEN 'exact' WHEN same OR list_contains(ey, CAST(year(c) AS INTEGER)) THEN 'same_year' WHEN n > 0 OR len(ey) > 0 THEN 'different' ELSE 'absent' END AS agreement, count(*) AS n FROM g GROUP BY 1
"""
_CLAIM_DATES = f"""
WITH {_dates("cd", "SELECT claim_id AS id, claim AS x FROM claims").strip()}, v AS (SELECT *, make_date(year, month, coalesce(day, 1)) AS t FROM cd)
SELECT id AS claim_id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS pos, day, month, year, precision,
  array_to_string(CASE WHEN day IS NULL THEN list_distinct([strftime(t, '%B %Y')]) || list_filter([strftime(t, '%B, %Y'), strftime(t, '%b %Y'), strftime(t, '%Y-%m')], lambda s: s <> strftime(t, '%B %Y'))
    ELSE [day || strftime(t, ' %B %Y'), strftime(t, '%B ') || day || ', ' || year] || list_filter([day || strftime(t, ' %b %Y'), strftime(t, '%b ') || day || ', ' || year], lambda s: strftime(t, '%b') <> strftime(t, '%B')) || [strftime(t, '%b ') || day || ' ' || year, strftime(t, '%Y-%m-%d'), strftime(t, '%d/%m/%Y')] END, '|') AS variants FROM v
"""
_PROFILES = rf"""
WITH {_KW.strip()}, {_dates("cd", "SELECT claim_id AS id, claim AS x FROM claims").strip()},
dl AS (SELECT id, string_agg(year || '-' || month || CASE WHEN day IS NULL THEN '' ELSE '-' || day END, ',' ORDER BY o) AS dates FROM cd GROUP BY id), kl AS (SELECT claim_id, string_agg(keyword, ',' ORDER BY pos) AS keywords FROM kw GROUP BY 1),
n AS (SELECT claim_id, claim, list_filter(regexp_extract_all(claim, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^\d{{1,4}}$')) AS l FROM claims)
SELECT n.claim_id, coalesce(dates, '') AS dates, array_to_string({_YEARS.format("claim")}, ',') AS years, coalesce(keywords, '') AS keywords, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS numbers
FROM n LEFT JOIN dl ON dl.id = n.claim_id LEFT JOIN kl USING (claim_id)
"""
_PHRASES = f"""
WITH {_KW.strip()}, kl AS (SELECT claim_id, list(keyword) AS ks FROM kw GROUP BY 1),
r AS (SELECT w.claim_id, ks, list_transform(generate_series(1, greatest(len(t) - 2, 0)), lambda i: array_to_string(t[i:i+2], ' ')) || list_transform(generate_series(1, greatest(len(t) - 1, 0)), lambda i: array_to_string(t[i:i+1], ' ')) AS l FROM w JOIN kl USING (claim_id)),
e AS (SELECT claim_id, ks, unnest(l) AS phrase, unnest(generate_series(1, len(l))) AS i FROM r),
pf AS (SELECT claim_id, phrase, any_value(ks) AS ks, min(i) AS i FROM e GROUP BY 1, 2),
g AS (SELECT *, string_split(phrase, ' ') AS ws FROM pf),
o AS (SELECT claim_id, phrase, row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN regexp_matches(phrase, '[0-9]') THEN 0 ELSE 1 END, len(ws) DESC, length(phrase) DESC, i) - 1 AS pos FROM g WHERE len(list_filter(ws, lambda w: NOT list_contains(ks, w))) = 0)
SELECT claim_id, CAST(pos AS INTEGER) AS pos, phrase FROM o WHERE pos < 6
"""
_FORMS = "list_filter([w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' END, CASE WHEN regexp_matches(w, '(ses|xes|zes)$') THEN substr(w, 1, length(w) - 2) END, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN substr(w, 1, length(w) - 1) END, CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN substr(w, 1, length(w) - 2) END, CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN substr(w, 1, length(w) - 1) END, CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN substr(w, 1, length(w) - 3) END, CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN substr(w, 1, length(w) - 3) || 'e' END], lambda x: x IS NOT NULL)"
_MET = rf"""
WITH {_KW.strip()}, kf AS (SELECT claim_id, pos, keyword AS w, {_FORMS} AS forms FROM (SELECT claim_id, pos, keyword, keyword AS w FROM kw)),
ev AS (SELECT evidence_id, claim_id, regexp_extract_all(lower(chunk), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}''-]*') AS words, regexp_matches(lower(chunk), 'fact check|false|misleading|hoax|faktencheck|no evidence') AS checks FROM trace_real_evidence JOIN claims USING (claim_id) WHERE chunk IS NOT NULL),
hit AS (SELECT evidence_id, string_agg(kf.w, ',' ORDER BY pos) AS met FROM ev JOIN kf USING (claim_id) WHERE list_has_any(words, forms) GROUP BY 1)
SELECT evidence_id, coalesce(met, '') AS met, checks FROM ev LEFT JOIN hit USING (evidence_id)
"""
ORACLE: dict[str, str] = {
    "claim_words_met": _MET,
    "claim_profiles": _PROFILES,
    "claim_phrases": _PHRASES,
    "claim_dates": _CLAIM_DATES,
    "date_agreement": _AGREEMENT,
    "date_statuses": _STATUSES,
    "source_tiers": _TIERS,
    "text_helpers": _HELPERS,
    "redacted": _REDACTED,
    "held_out_split": _GROUPED.replace("min(label) AS l FROM", "min(label) AS l, coalesce(bool_or(used_fallback), false) AS o FROM").replace("SELECT component, (CAST", "SELECT component, o, (CAST").replace("SELECT CASE WHEN p < 0.7", "SELECT CASE WHEN o THEN 'test' WHEN p < 0.7").replace("label, count(*) AS n FROM", "label, used_fallback, count(*) AS n FROM").replace("GROUP BY 1, 2\n", "GROUP BY 1, 2, 3\n"),
    "scored_manifest": f"WITH {_M}, {_SCORED} SELECT split, greatest(width, height) > 1024 AS large, count(*) AS n_rows, count(p) AS n_scored, count(*) FILTER ((p >= 0.5) = (y = 1)) AS n_right FROM m LEFT JOIN s ON row_id = evidence_id GROUP BY ALL",
    "progress_stages": "SELECT event_type, CASE WHEN regexp_matches(event_type, '^(?:view|open|visit)') THEN 'seen' WHEN regexp_matches(event_type, 'click|search|play') THEN 'used' WHEN regexp_matches(event_type, 'cart|buy|purchase|pay') THEN 'bought' END AS stage, count(*) AS n FROM events GROUP BY ALL",
    "linked_components": f"WITH RECURSIVE {_LINKED} SELECT id, component FROM comp",
    "grouped_split": _GROUPED,
    "claim_keywords": rf"""
WITH {_KW.strip()}, f2 AS (SELECT *, length(keyword) AS n, keyword AS w FROM kw)
SELECT claim_id, pos, keyword, array_to_string(list_sort(list_distinct(list_filter([w, CASE WHEN w LIKE '%ies' AND n > 4 THEN substr(w, 1, n - 3) || 'y' END, CASE WHEN regexp_matches(w, '(ses|xes|zes)$') THEN substr(w, 1, n - 2) END, CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND n > 3 THEN substr(w, 1, n - 1) END,
  CASE WHEN w LIKE '%ed' AND n > 4 THEN substr(w, 1, n - 2) END, CASE WHEN w LIKE '%ed' AND n > 4 THEN substr(w, 1, n - 1) END, CASE WHEN w LIKE '%ing' AND n > 5 THEN substr(w, 1, n - 3) END, CASE WHEN w LIKE '%ing' AND n > 5 THEN substr(w, 1, n - 3) || 'e' END], lambda x: x IS NOT NULL AND x <> ''))), ',') AS forms,
  CASE WHEN w LIKE '%ings' AND n > 6 THEN substr(w, 1, n - 4) WHEN w LIKE '%ing' AND n > 5 THEN substr(w, 1, n - 3) WHEN w LIKE '%edly' AND n > 6 THEN substr(w, 1, n - 4) WHEN w LIKE '%ed' AND n > 4 THEN substr(w, 1, n - 2) WHEN w LIKE '%es' AND n > 4 THEN substr(w, 1, n - 2) WHEN w LIKE '%s' AND n > 3 THEN substr(w, 1, n - 1) ELSE w END AS stem FROM f2""",
    "context_windows": "WITH w AS (SELECT claim_id, pos, list(chunk) OVER (PARTITION BY claim_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM trace_real_evidence WHERE chunk IS NOT NULL) SELECT claim_id, pos, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, chr(10))) AS window_md5 FROM w WHERE len(w) > 1",
    "uncertainty_band": f"WITH {_SCORED}, c AS (SELECT CAST(floor(abs(p - 0.5) * 100 + 1e-9) AS INTEGER) AS c, (p >= 0.5) = (y = 1) AS ok FROM s), g AS (SELECT range / 100 AS width, count(*) FILTER (c >= range) AS n_decided, count(*) FILTER (c >= range AND ok) AS r, count(*) AS total FROM range(41), c GROUP BY range), b AS (SELECT width, CAST(n_decided AS BIGINT) AS n_decided, r / n_decided AS accuracy, 1 - n_decided / total AS uncertain_rate FROM g WHERE n_decided > 0) SELECT * FROM b WHERE uncertain_rate <= 0.3 ORDER BY accuracy DESC, width LIMIT 1",
    "temperature": f"WITH {_SCORED}, q AS (SELECT y, greatest(1e-6, least(1 - 1e-6, p)) AS p FROM s), t AS (SELECT y, 0.25 + 0.05 * range AS t, 1 / (1 + exp(-ln(p / (1 - p)) / (0.25 + 0.05 * range))) AS q FROM q, range(96)), g AS (SELECT CAST(t AS DOUBLE) AS t, avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS nll FROM t GROUP BY t) SELECT t, nll FROM g ORDER BY round(nll, 12), t LIMIT 1",
    "evidence_classes": None,
    "event_matches": """
WITH n AS (SELECT claim_id, list_filter(regexp_extract_all(claim, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^\\d{1,4}$')) AS cn FROM claims),
x AS (SELECT evidence_id, coalesce(location_match, false) OR NOT coalesce(claim_has_location, false) AS ok, coalesce(detail_coverage, 0) AS cov, coalesce(similarity, -1) AS si, coalesce(date_status, 'unknown') AS st, coalesce(debunking, false) OR coalesce(event_date_conflict, false) AS den,
  coalesce(regexp_matches(lower(chunk), 'policy|guideline|protocol|regulation'), false) AS pol, coalesce(regexp_matches(lower(chunk), 'on average|records from|data showed|in total'), false) AS agg, coalesce(regexp_matches(lower(chunk), 'flood|fire|storm|landslide|leak|closure|strike|evacuation|collision'), false) AS inc,
  coalesce(list_has_any(cn, list_filter(regexp_extract_all(chunk, '[A-Za-z0-9_]+'), lambda w: regexp_matches(w, '^\\d{1,4}$'))), false) AS num, coalesce(nli_label = 'entailment', false) AS ent FROM trace_real_evidence JOIN n USING (claim_id))
SELECT evidence_id, CASE WHEN pol AND NOT inc THEN 'none'
  WHEN st = 'different' AND NOT den THEN 'weak' WHEN st IN ('match', 'same_day_published') AND agg AND cov < 0.65 THEN 'weak'
  WHEN st IN ('different', 'match', 'same_day_published') THEN CASE WHEN NOT ok OR cov < 0.3 OR si < 0.45 THEN 'weak' WHEN si >= 0.5 AND (st <> 'same_day_published' OR num OR cov >= 0.65 OR ent) THEN 'strong' ELSE 'moderate' END
  WHEN ok AND cov >= 0.6 AND inc AND (st = 'same_year' OR si >= 0.45) THEN 'moderate' ELSE 'weak' END AS event_match FROM x""",
    "canonical_urls": f"WITH {_URL} SELECT evidence_id, canonical FROM ev",
    "url_parts": _URL_PARTS,
    "dedup_by_url": f"WITH {_URL} SELECT claim_id, canonical, count(*) AS n, list_sort(list(DISTINCT evidence_type)) AS labels, min(evidence_id) AS first_id FROM ev WHERE canonical <> '' GROUP BY 1, 2",
    "diverse_topk": "WITH a AS (SELECT claim_id, domain, evidence_score, evidence_id, row_number() OVER (PARTITION BY claim_id, domain ORDER BY evidence_score DESC NULLS LAST, evidence_id) AS rn FROM trace_real_evidence), b AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY rn, evidence_score DESC NULLS LAST, evidence_id) AS INTEGER) AS rank FROM a WHERE rn <= 2) SELECT claim_id, domain, evidence_score, evidence_id, rank FROM b WHERE rank <= 10",
    "source_decisions": f"WITH {_SOURCES} SELECT * FROM src",
    "publisher_decisions": f"WITH {_SOURCES} SELECT * FROM pub",
    "agreement": f"WITH {_SOURCES} SELECT * FROM agr",
    "fusion_scores": _FUSION,
    "best_passages": "SELECT claim_id, evidence_class, evidence_id, evidence_score, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, evidence_class ORDER BY evidence_score DESC NULLS LAST, pos) AS rn FROM trace_real_evidence) WHERE rn <= 3",
    "reconciled": f"WITH {_URL}, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, source_key ORDER BY CASE evidence_class WHEN 'SUPPORT' THEN 0 WHEN 'CONTRADICTION' THEN 1 ELSE 2 END, evidence_score DESC NULLS LAST, pos) AS rn FROM ev) SELECT claim_id, source_key, evidence_id, evidence_class, evidence_score FROM r WHERE rn = 1",
    "class_counts": "SELECT claim_id, count(*) FILTER (evidence_class = 'SUPPORT' AND evidence_score >= 0.6) AS strong_support, count(*) FILTER (evidence_class = 'CONTRADICTION' AND evidence_score >= 0.6) AS strong_contradiction, count(*) FILTER (evidence_class = 'RELATED_CONTEXT') AS context, avg(CAST(evidence_type = 'scraped_article' AS DOUBLE)) AS scraped_share FROM trace_real_evidence GROUP BY 1",
    "evidence_scores": """
WITH a AS (SELECT evidence_id, evidence_class, evidence_type, nli_label, date_status, debunking,
  CAST(CASE date_status WHEN 'match' THEN 1 WHEN 'same_day_published' THEN 0.85 WHEN 'same_year' THEN 0.45 WHEN 'unknown' THEN 0.3 WHEN 'different' THEN 0 ELSE 0.3 END AS DOUBLE) * CAST(0.2 AS DOUBLE)
  + CAST(CASE event_match WHEN 'strong' THEN 1 WHEN 'moderate' THEN 0.55 WHEN 'weak' THEN 0.15 WHEN 'none' THEN 0 ELSE 0.15 END AS DOUBLE) * CAST(0.2 AS DOUBLE)
  + greatest(0, least(1, coalesce(detail_coverage, 0))) * CAST(0.15 AS DOUBLE) + CASE WHEN coalesce(claim_has_location, true) AND NOT coalesce(location_match, false) THEN 0 ELSE 1 END * CAST(0.1 AS DOUBLE)
  + CASE WHEN lower(trim(coalesce(nli_label, 'neutral'))) IN ('entailment', 'contradiction') THEN greatest(0, least(1, coalesce(nli_score, 0))) ELSE 0 END * CAST(0.15 AS DOUBLE)
  + greatest(0, least(1, coalesce(source_reliability, 0))) * CAST(0.15 AS DOUBLE) + greatest(0, least(1, (coalesce(similarity, 0) + 1) / 2)) * CAST(0.05 AS DOUBLE) AS s FROM trace_real_evidence),
b AS (SELECT *, CASE WHEN date_status = 'different' AND NOT coalesce(debunking, false) THEN s * CAST(0.5 AS DOUBLE) ELSE s END AS s1 FROM a),
c AS (SELECT *, greatest(0, least(1, CASE WHEN lower(trim(coalesce(nli_label, 'neutral'))) = 'neutral' THEN s1 * CAST(0.45 AS DOUBLE) ELSE s1 END)) AS score FROM b)
SELECT evidence_id, score, least(score, CAST(CASE evidence_class WHEN 'SUPPORT' THEN 0.95 WHEN 'CONTRADICTION' THEN 0.95 WHEN 'RELATED_CONTEXT' THEN 0.25 WHEN 'NON_EVIDENCE' THEN 0.02 ELSE 0.5 END AS DOUBLE), CAST(CASE evidence_type WHEN 'search_extract' THEN 0.8 WHEN 'search_snippet' THEN 0.45 ELSE 1 END AS DOUBLE)) AS capped,
  CASE WHEN score >= 0.75 THEN 'Strong' WHEN score >= 0.5 THEN 'Moderate' WHEN score > 0 THEN 'Weak' ELSE 'None' END AS strength FROM c""",
    "claim_years": r"SELECT claim_id, array_to_string(list_sort(list_distinct(regexp_extract_all(claim, '\b((?:19|20)\d{2})\b', 1))), ',') AS years, CAST(submission_date - INTERVAL 3 DAY AS DATE) AS from_day, CAST(submission_date + INTERVAL 45 DAY AS DATE) AS to_day FROM claims",
    "keyword_coverage": f"WITH {_KW}, k2 AS (SELECT claims.claim_id, coalesce(list(keyword) FILTER (keyword IS NOT NULL), []) AS kw FROM claims LEFT JOIN kw USING (claim_id) GROUP BY 1), j AS (SELECT evidence_id, len(list_intersect(kw, regexp_extract_all(lower(chunk), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}''-]*'))) AS h, len(kw) AS n FROM trace_real_evidence JOIN k2 USING (claim_id) WHERE chunk IS NOT NULL) SELECT evidence_id, CAST(h AS INTEGER) AS n_hits, CASE WHEN n = 0 THEN NULL ELSE CAST(h AS DOUBLE) / n END AS coverage FROM j",
    "case_ids": "SELECT claim_id, 'TL-' || upper(substr(sha256('text:' || claim), 1, 10)) AS case_id FROM claims",
    "text_classes": f"WITH {_SH} SELECT id, class_id FROM c",
    "near_duplicates": f"WITH {_SH}, r AS (SELECT id, s, len(s) AS n FROM c WHERE id = class_id), z AS (SELECT id, n, unnest(s) AS g FROM r), p AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS overlap FROM z a JOIN z b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2) SELECT id_a, id_b, CAST(overlap AS INTEGER) AS overlap, overlap / (na + nb - overlap) AS jaccard FROM p WHERE overlap / (na + nb - overlap) >= 0.8",
    "contained_texts": f"WITH {_SH}, r AS (SELECT id, s, len(s) AS n FROM c WHERE id = class_id), z AS (SELECT id, n, unnest(s) AS g FROM r), p AS (SELECT a.id AS small_id, b.id AS large_id, any_value(a.n) AS na, count(*) AS overlap FROM z a JOIN z b ON a.g = b.g AND (a.n < b.n OR (a.n = b.n AND a.id < b.id)) WHERE a.n >= 4 GROUP BY 1, 2) SELECT small_id, large_id, CAST(overlap AS INTEGER) AS overlap, overlap / na AS containment FROM p WHERE overlap / na >= 0.9",
    "best_by_url": f"WITH {_URL}, b AS (SELECT claim_id, canonical, evidence_id, evidence_score, row_number() OVER (PARTITION BY claim_id, canonical ORDER BY evidence_score DESC NULLS LAST, evidence_id) AS rn, count(*) OVER (PARTITION BY claim_id, canonical) AS n FROM ev WHERE canonical <> ''), t AS (SELECT claim_id, canonical, array_to_string(list_sort(list(DISTINCT evidence_type)), '|') AS evidence_type FROM ev WHERE canonical <> '' GROUP BY 1, 2) SELECT claim_id, canonical, evidence_id, evidence_score, n, evidence_type FROM b JOIN t USING (claim_id, canonical) WHERE rn = 1",
    "cosine_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), j AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS s FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank FROM j) SELECT query_id, vec_id, rank FROM r WHERE rank <= 5",
    "near_hashes": "WITH v AS (SELECT vec_id, CAST(list_sum(list_transform(embedding[1:60], lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS h FROM embeddings WHERE embedding IS NOT NULL), r AS (SELECT h, min(vec_id) AS id, count(*) AS n FROM v GROUP BY h) SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance, a.n AS n_a, b.n AS n_b FROM r a JOIN r b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 15",
    "locked_evaluation": f"WITH {_SWEEP.replace('FROM g, s GROUP', 'FROM g, (SELECT * FROM s WHERE evidence_type = ' + repr('scraped_article') + ') s GROUP')}, b AS (SELECT threshold FROM sweep WHERE macro_f1 IS NOT NULL ORDER BY round(macro_f1, 12) DESC, threshold LIMIT 1), q AS (SELECT evidence_type, y, floor(p * 100 + 1e-9) / 100 AS p FROM s WHERE evidence_type <> 'scraped_article'), c AS (SELECT evidence_type, any_value(threshold) AS threshold, count(*) AS n_total, CAST(0 AS BIGINT) AS n_uncertain, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y <> 1) AS fp, count(*) FILTER (p < threshold AND y <> 1) AS tn, count(*) FILTER (p < threshold AND y = 1) AS fn FROM q, b GROUP BY 1) SELECT *, {_rates()} FROM c",
    "confusion": f"WITH {_SCORED}, c AS (SELECT count(*) AS n_total, CAST(0 AS BIGINT) AS n_uncertain, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y <> 1) AS tn, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM s) SELECT *, {_rates()} FROM c",
    "confusion_by_type": f"WITH {_SCORED}, c AS (SELECT evidence_type, count(*) AS n_total, count(*) FILTER (u) AS n_uncertain, count(*) FILTER (NOT u AND p >= 0.5 AND y = 1) AS tp, count(*) FILTER (NOT u AND p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (NOT u AND p < 0.5 AND y <> 1) AS tn, count(*) FILTER (NOT u AND p < 0.5 AND y = 1) AS fn FROM (SELECT *, p > 0.4 AND p < 0.6 AS u FROM s) GROUP BY 1) SELECT *, {_rates()} FROM c",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sweep",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold, macro_f1, tp, fp, tn, fn FROM sweep ORDER BY round(macro_f1, 12) DESC, threshold LIMIT 1",
    "reliability_bins": f"WITH {_BINS} SELECT * FROM bins",
    "calibration_error": f"WITH {_BINS} SELECT sum(n * abs(observed_rate - mean_predicted)) / sum(n) AS ece FROM bins",
    "auc_by_type": f"WITH {_SCORED}, r AS (SELECT evidence_type, y, rank() OVER (PARTITION BY evidence_type ORDER BY p) + (count(*) OVER (PARTITION BY evidence_type, p) - 1) / 2.0 AS rk FROM s), a AS (SELECT evidence_type, sum(rk) FILTER (y = 1) AS w, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n_pos, CAST(count(*) FILTER (y <> 1) AS DOUBLE) AS n_neg FROM r GROUP BY 1) SELECT evidence_type, CASE WHEN n_pos * n_neg = 0 THEN NULL ELSE CAST((w - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS DOUBLE) END AS auc, n_pos, n_neg FROM a",
    "ensemble_scores": "WITH m AS (SELECT evidence_id AS id, unnest([nli_score, raw_nli_score, source_reliability]) AS p FROM trace_real_evidence), g AS (SELECT id, count(p) AS n, avg(p) AS p_mean, avg(CAST(p >= 0.5 AS DOUBLE)) AS p_vote FROM m WHERE p IS NOT NULL GROUP BY 1) SELECT id, p_mean, p_vote FROM g WHERE n = 3",
    "duplicate_files": f"WITH {_M} SELECT file_size_bytes, duration_sec, count(*) AS n, min(row_id) AS first_id FROM m WHERE file_size_bytes IS NOT NULL AND duration_sec IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "label_conflicts": "SELECT video_url, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, count(*) AS n FROM fvc WHERE video_url IS NOT NULL AND label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) > 1",
    "split_leaks": f"WITH {_M} SELECT actual_url, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM m WHERE actual_url IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "split_precedence": f"WITH {_M}, r AS (SELECT row_id, actual_url, split, row_number() OVER (PARTITION BY actual_url ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, row_id) AS rn FROM m WHERE actual_url IS NOT NULL) SELECT row_id, actual_url, split FROM r WHERE rn = 1",
    "class_statistics": f"WITH {_M} SELECT label, count(*) AS n, min(duration_sec) AS duration_sec_min, max(duration_sec) AS duration_sec_max, avg(duration_sec) AS duration_sec_mean, median(duration_sec) AS duration_sec_median, stddev_pop(duration_sec) AS duration_sec_std, CAST(min(file_size_bytes) AS DOUBLE) AS file_size_bytes_min, CAST(max(file_size_bytes) AS DOUBLE) AS file_size_bytes_max, avg(CAST(file_size_bytes AS DOUBLE)) AS file_size_bytes_mean, median(CAST(file_size_bytes AS DOUBLE)) AS file_size_bytes_median, stddev_pop(CAST(file_size_bytes AS DOUBLE)) AS file_size_bytes_std FROM m GROUP BY ROLLUP (label)",
    "resolution_buckets": f"WITH {_M} SELECT split, CASE WHEN greatest(width, height) <= 256 THEN 'tiny' WHEN greatest(width, height) <= 512 THEN 'small' WHEN greatest(width, height) <= 1024 THEN 'medium' ELSE 'large' END AS bucket, CASE WHEN lower(regexp_extract(file_name, '\\.([A-Za-z0-9]+)$', 1)) IN ('mp4', 'mov', 'avi', 'mkv', 'webm') THEN 'video' ELSE 'text' END AS modality, count(*) AS n FROM m GROUP BY ALL",
    "gap_islands": f"WITH {_E}, n AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)), i AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n) SELECT user_id, island, min(us) AS start, max(us) AS \"end\", count(*) AS n FROM i GROUP BY 1, 2",
    "merged_observations": f"WITH {_E}, n AS (SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us - lag(us) OVER w > 7200000000 OR 1 - levenshtein(lower(event_type), lower(lag(event_type) OVER w)) / greatest(length(event_type), length(lag(event_type) OVER w), 1) < 0.7 THEN 1 ELSE 0 END AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), r AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT user_id AS key, CAST(min(us) AS DOUBLE) AS start, CAST(max(us) AS DOUBLE) AS \"end\", (list(event_type ORDER BY length(event_type) DESC, us, event_id))[1] AS text, CAST(count(*) AS INTEGER) AS n, min(event_id) AS first_frame, max(event_id) AS last_frame, max(value) AS confidence FROM r GROUP BY user_id, run",
    "interval_join": f"WITH {_IV} SELECT sp.user_id, speech_id, ocr_id FROM sp JOIN oc ON sp.user_id = oc.user_id AND o <= b + 3600000000 AND o >= a - 3600000000",
    "interval_anti_join": f"WITH {_IV} SELECT user_id, speech_id FROM sp WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.user_id = sp.user_id AND o <= b + 3600000000 AND o >= a - 3600000000)",
    "sliding_means": f"WITH {_E}, x AS (SELECT user_id, value, us / 3600000000.0 AS h FROM e), y AS (SELECT user_id, value, unnest(generate_series(CAST(floor((h - 24) / 6) + 1 AS BIGINT), CAST(floor(h / 6) AS BIGINT))) AS i FROM x) SELECT user_id, i * 6.0 AS window_start, count(value) AS n, avg(value) AS mean FROM y GROUP BY user_id, i",
    "event_properties": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "sampled_events": "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM n WHERE n <= 15 OR i IN (SELECT CAST(floor(j * (n.n - 1) / 14.0) AS BIGINT) FROM range(15) t(j))",
    "fused_timeline": f"WITH {_IV}, t AS (SELECT event_id, event_type FROM events), s2 AS (SELECT sp.*, t.event_type AS x FROM sp JOIN t ON event_id = speech_id), o2 AS (SELECT oc.*, t.event_type AS x FROM oc JOIN t ON event_id = ocr_id), j AS (SELECT s2.user_id, speech_id, string_agg(o2.x, ' | ' ORDER BY o, o2.x) AS screen, bool_or(s2.x = o2.x) AS same FROM s2 JOIN o2 ON s2.user_id = o2.user_id AND o <= b + 3600000000 AND o >= a - 3600000000 GROUP BY 1, 2) SELECT s2.user_id, CASE WHEN same THEN 'both' ELSE 'speech' END AS source, x AS text, a AS \"from\", b AS \"to\", coalesce(screen, '') AS screen FROM s2 LEFT JOIN j USING (user_id, speech_id) UNION ALL SELECT user_id, 'screen', x, o, o, '' FROM o2 WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.user_id = o2.user_id AND o <= b + 3600000000 AND o >= a - 3600000000)",
    "window_decisions": f"WITH {_SCORED}, g AS (SELECT claim_id, count(p) AS n, avg(p) AS mean FROM sc JOIN trace_real_evidence USING (evidence_id) GROUP BY 1) SELECT *, CASE WHEN mean >= 0.65 THEN 'positive' WHEN mean <= 0.35 THEN 'negative' WHEN mean IS NOT NULL THEN 'uncertain' END AS decision FROM g",
    "folded_labels": "WITH x AS (SELECT evidence_id, nli_label AS l, nli_score AS s FROM trace_real_evidence UNION ALL SELECT evidence_id, raw_nli_label, raw_nli_score FROM trace_real_evidence), g AS (SELECT evidence_id, coalesce(max(s) FILTER (l = 'entailment'), 0) AS entailment, coalesce(max(s) FILTER (l = 'contradiction'), 0) AS contradiction, coalesce(max(s) FILTER (l = 'neutral' OR l IS NULL), 0) AS neutral FROM x GROUP BY 1) SELECT *, CASE WHEN entailment = greatest(entailment, contradiction, neutral) THEN 'entailment' WHEN contradiction = greatest(entailment, contradiction, neutral) THEN 'contradiction' ELSE 'neutral' END AS best FROM g",
    "worst_errors": f"WITH {_SCORED}, w AS (SELECT evidence_id, evidence_type, p, CASE WHEN y = 1 THEN 'false_negative' ELSE 'false_positive' END AS kind FROM s WHERE (p >= 0.5) <> (y = 1)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY evidence_type, kind ORDER BY abs(p - 0.5) DESC, evidence_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY evidence_type, kind) AS n_errors FROM w) SELECT evidence_id, evidence_type, kind, p, rank, n_errors FROM r WHERE rank <= 10",
}
# the class' score is that of the scores' query, with the raw label and under the ceiling of the class found
_SCORE = ORACLE["evidence_scores"].strip().replace("nli_label", "raw_nli_label").replace("nli_score", "raw_nli_score").replace("FROM trace_real_evidence", "FROM z").replace("evidence_class", "class").replace("WITH a AS", ", a AS", 1)
ORACLE["evidence_classes"] = f"{_CLASSES.strip()}{_SCORE[: _SCORE.rindex('SELECT evidence_id, score')]} , o AS ({_SCORE[_SCORE.rindex('SELECT evidence_id, score') :]}) SELECT evidence_id, z.class, capped AS class_score FROM o JOIN z USING (evidence_id)"
ORACLE["greedy_dedup"] = f"""
WITH RECURSIVE nd AS ({ORACLE["near_duplicates"]}), b AS (SELECT id_a AS id, id_b AS o FROM nd UNION SELECT id_b, id_a FROM nd),
v AS (SELECT id, list(o) AS os, row_number() OVER (ORDER BY id) AS i FROM b GROUP BY id),
k AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT v.i, CASE WHEN list_has_any(kept, os) THEN kept ELSE list_append(kept, id) END FROM k JOIN v ON v.i = k.i + 1)
SELECT DISTINCT class_id AS id FROM ({ORACLE["text_classes"]}) t WHERE class_id NOT IN (SELECT id FROM v) UNION SELECT unnest(kept) FROM (SELECT kept FROM k ORDER BY i DESC LIMIT 1)
"""
for _q, _columns in DECIMALS.items():
    _kept = ", ".join(f"round({c}, {n}) AS {c}" for c, n in _columns.items())
    ORACLE[_q] = f"SELECT * REPLACE ({_kept}) FROM ({ORACLE[_q].strip()}) AS _q"
