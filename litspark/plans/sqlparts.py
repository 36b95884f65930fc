"""SQL fragments for the DuckDB oracles (ANSI SQL + DuckDB list functions).

They restate each operator's semantics independently of the Spark code, on
the same parquet tables.
"""

from __future__ import annotations

from litspark import fixtures
from litspark.functions.constants import (COMMON_WORDS, CUTOFF_YEAR, NON_INSTITUTION_AFFILIATIONS,
                                          PUNCTUATION, STOPWORDS_V1, STOPWORDS_V2)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def unescape4(x: str) -> str:
    """The four entities present in the testdata pages; &amp; last (one pass).

    ``&amp`` is also decoded without its semicolon, as html.unescape does for
    this legacy name (sf0.1 pages hold such truncated entities); one regex pass
    handles both forms, so nothing is decoded twice.
    """
    return (f"regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp;?', '&', 'g')")


def clean_html(x: str) -> str:
    return trim_ws(f"regexp_replace({unescape4(x)}, '<[^>]*>', '', 'g')")


def clean_par(x: str) -> str:
    return trim_ws(f"regexp_replace(replace({x}, chr(13), ''), '\\s+', ' ', 'g')")


def strip_prefix(x: str) -> str:
    return f"regexp_replace({x}, '^[Aa][Bb][Ss][Tt][Rr][Aa][Cc][Tt]\\s*', '')"


def tokenize(x: str, words=STOPWORDS_V2) -> str:
    parts = f"regexp_split_to_array(translate(lower({x}), {q(PUNCTUATION)}, ''), '\\s+')"
    return (f"coalesce(list_filter({parts}, lambda t: length(t) > 0 AND NOT list_contains({sql_list(words)}, t)),"
            f" []::VARCHAR[])")


def tokenize_v1(x: str) -> str:
    return tokenize(x, STOPWORDS_V1)


def english_tokens(x: str, lang: str = "lang") -> str:
    return f"CASE WHEN {lang} = 'en' THEN {tokenize(x)} ELSE []::VARCHAR[] END"


def last_segment(x: str) -> str:
    return trim_ws(f"regexp_extract({x}, '([^,]*)$', 1)")


NON_INST = ", ".join(q(n) for n in NON_INSTITUTION_AFFILIATIONS)
COMMON = ", ".join(q(w) for w in COMMON_WORDS)

BASE_CTES = f"""
papers AS ({fixtures.PAPERS_SQL}),
gaz AS ({fixtures.GAZETTEER_SQL}),
regions_v AS ({fixtures.REGIONS_SQL}),
tw AS ({fixtures.topic_words_values_sql()}),
labels_v AS ({fixtures.topic_labels_values_sql()}),
cleaned0 AS (
  SELECT paper_id, {clean_par(clean_html('title'))} AS title, affiliation, year,
         {strip_prefix(clean_par(clean_html('abstract')))} AS abstract, lang
  FROM papers WHERE year > {CUTOFF_YEAR}),
dedup AS (
  SELECT min(paper_id) AS paper_id, title, affiliation, year, abstract, arg_min(lang, paper_id) AS lang
  FROM cleaned0 GROUP BY title, affiliation, year, abstract),
cleaned AS (
  SELECT * FROM dedup WHERE NOT coalesce(lower(affiliation) IN ({NON_INST}), false)),
geo AS (
  SELECT c.*, g.latitude, g.longitude
  FROM cleaned c JOIN gaz g ON lower({last_segment('c.affiliation')}) = lower(g.place)),
tok AS (SELECT *, {english_tokens('abstract')} AS tokens FROM geo),
hits AS (
  SELECT t.paper_id, w.topic_id, count(*) AS n
  FROM (SELECT DISTINCT paper_id, term FROM (SELECT paper_id, unnest(tokens) AS term FROM tok)) t
  JOIN tw w ON t.term = w.term GROUP BY 1, 2),
best AS (SELECT paper_id, arg_max(topic_id, (n, -topic_id)) AS topic_id FROM hits GROUP BY 1),
assigned AS (
  SELECT tok.*, CAST(coalesce(best.topic_id, (SELECT min(topic_id) FROM tw)) AS INTEGER) AS topic_id
  FROM tok LEFT JOIN best USING (paper_id)),
fallback AS (
  SELECT topic_id, string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank < 3) AS fb FROM tw GROUP BY 1),
names AS (
  SELECT f.topic_id, coalesce(replace(l.label, '"', ''), f.fb) AS label
  FROM fallback f LEFT JOIN labels_v l USING (topic_id)),
pt AS (SELECT a.*, n.label AS assigned_topic FROM assigned a LEFT JOIN names n USING (topic_id)),
dtok AS (SELECT doc_id AS paper_id, {english_tokens('text')} AS tokens FROM documents),
dhits AS (
  SELECT t.paper_id, w.topic_id, count(*) AS n
  FROM (SELECT DISTINCT paper_id, term FROM (SELECT paper_id, unnest(tokens) AS term FROM dtok)) t
  JOIN tw w ON t.term = w.term GROUP BY 1, 2),
dbest AS (SELECT paper_id, arg_max(topic_id, (n, -topic_id)) AS topic_id FROM dhits GROUP BY 1),
dassigned AS (
  SELECT d.paper_id, CAST(coalesce(b.topic_id, (SELECT min(topic_id) FROM tw)) AS INTEGER) AS topic_id
  FROM dtok d LEFT JOIN dbest b USING (paper_id))
"""


def with_base(body: str) -> str:
    return "WITH " + BASE_CTES.strip() + "\n" + body
