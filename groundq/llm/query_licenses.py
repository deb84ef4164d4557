"""op7_license_scan: license labels of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundq.llm.licenses import BASE, NOTICES, _key_places, indexed_words, mandatory, scan_licenses


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), text="text", keys=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {"op7_license_scan": op7_license_scan}


def _sql() -> str:
    """The same labels from all words of the vocabulary and all templates: what the anchors leave out makes no candidate here either."""
    templates = BASE + NOTICES
    rows = [f"('{w}', {t}, {i}, {i in _key_places(x)}, {(i, w) in mandatory(x)})" for t, x in enumerate(templates) for i, w in indexed_words(x)]
    names = [f"({t}, '{x.label}', {t < len(BASE)}, {x.whole}, {len(indexed_words(x))}, {len(_key_places(x))})" for t, x in enumerate(templates)]
    return f"""
WITH postings(w, template, place, in_key, must) AS (VALUES {", ".join(rows)}),
templates(template, label, is_base, whole, n_all, n_key) AS (VALUES {", ".join(names)}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
hits AS (SELECT * FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM words) WHERE w IN (SELECT w FROM postings)),
idf AS (SELECT p.w, coalesce(any_value(c.df), 0) AS df, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(any_value(c.df), 0) + 1)) + 1.0 AS idf
  FROM postings p LEFT JOIN (SELECT w, count(DISTINCT doc_id) AS df FROM hits GROUP BY w) c ON c.w = p.w GROUP BY p.w),
anchors AS (SELECT * FROM postings JOIN idf USING (w) WHERE must QUALIFY row_number() OVER (PARTITION BY template ORDER BY df, place) <= 2),
counted AS (SELECT *, count(*) OVER (PARTITION BY template) AS of FROM anchors),
candidates AS (SELECT doc_id, template, i - place AS start FROM hits JOIN counted USING (w) GROUP BY doc_id, template, i - place, of HAVING count(*) = of),
matched AS (SELECT c.doc_id, c.template, c.start, count(h.w) AS n, coalesce(sum(f.idf) FILTER (h.w IS NOT NULL), 0) AS weight, sum(f.idf) AS idf_all, count(h.w) FILTER (p.in_key) AS in_key
  FROM candidates c JOIN postings p USING (template) JOIN idf f ON f.w = p.w LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.i = c.start + p.place AND h.w = p.w GROUP BY ALL),
judged AS (SELECT *, CASE WHEN NOT whole OR n = n_all THEN least(1.0, weight / idf_all) END AS share, CASE WHEN whole THEN n = n_all ELSE in_key = n_key AND weight / idf_all >= 0.6 END AS accepted
  FROM matched JOIN templates USING (template)),
labelled AS (SELECT doc_id, count(*) FILTER (accepted AND is_base) AS n_base, min(start) FILTER (accepted AND is_base) AS first_word, max(start) FILTER (accepted AND is_base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (accepted AND is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (accepted) AS labels, max(share) AS score FROM judged GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM words LEFT JOIN labelled USING (doc_id)"""


SQL = {"op7_license_scan": _sql()}
