"""SQL of the queries that SQL can express."""

from tesserine.llm import records

_LINES = r"""
l AS (
  SELECT evidence_id, domain, chunk, CAST(i AS INTEGER) AS line_no, string_split(chunk, chr(10))[i] AS line
  FROM trace_real_evidence, LATERAL (SELECT unnest(generate_series(1, len(string_split(chunk, chr(10))))) AS i)
  WHERE chunk IS NOT NULL AND domain IS NOT NULL),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS k FROM l),
r AS (SELECT domain, k, count(DISTINCT evidence_id) AS n FROM k WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT evidence_id) >= 8)
"""
_P5 = f"WITH {_LINES} SELECT DISTINCT evidence_id, line_no FROM k JOIN r USING (domain, k)"
_P5_CLEAN = f"""
WITH {_LINES}, f AS (SELECT evidence_id, list(line_no) AS gone FROM (SELECT DISTINCT evidence_id, line_no FROM k JOIN r USING (domain, k)) GROUP BY 1)
SELECT evidence_id, CASE WHEN gone IS NULL THEN chunk ELSE coalesce(array_to_string(list_filter(string_split(chunk, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END AS clean
FROM trace_real_evidence LEFT JOIN f USING (evidence_id)
"""
_P8_TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
#: Ratio and verdict are held against each other's rounded values; q needs p-values, which SQL has not.
_P5_LINES = f"""
WITH {_LINES}, m AS (SELECT domain, count(DISTINCT evidence_id) AS m FROM l GROUP BY 1), w AS (SELECT domain, k, count(DISTINCT evidence_id) AS a FROM k WHERE k <> '' GROUP BY 1, 2),
t AS (SELECT k, sum(a) AS t FROM w GROUP BY 1), n AS (SELECT CAST(sum(m) AS DOUBLE) AS n FROM m),
x AS (SELECT domain, k, CAST(a AS DOUBLE) AS a, CAST(t - a AS DOUBLE) AS b, CAST(m AS DOUBLE) AS m, n - m AS o, CAST(t AS DOUBLE) / n AS r FROM w JOIN m USING (domain) JOIN t USING (k), n WHERE a >= 8)
SELECT domain AS source, k AS letters, CAST(a AS BIGINT) AS n_rows, CAST(b AS BIGINT) AS n_outside, round(greatest(0, 2 * (a * ln(a / (m * r)) + CASE WHEN b > 0 THEN b * ln(b / (o * r)) ELSE 0 END
  + CASE WHEN m > a THEN (m - a) * ln((m - a) / (m * (1 - r))) ELSE 0 END + CASE WHEN o > b THEN (o - b) * ln((o - b) / (o * (1 - r))) ELSE 0 END)), 6) AS llr FROM x
"""
ORACLE: dict[str, str] = records.ORACLE | {"p5_found": _P5, "p5_clean": _P5_CLEAN, "p5_ratios": _P5_LINES, "p8_texts": _P8_TEXTS}
