"""Registered queries for nested JSON and HTML sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark import fixtures
from litspark.functions.constants import RELEVANCE_KEYWORDS
from litspark.operators import flatten
from litspark.plans import sqlparts as S
from litspark.plans.queries import register
from litspark.sources import files, html, html_tree

# Keyword lists for the relevance filter: the default topic keywords (none of
# which occur in the synthetic prose) plus two phrases that do.
KEYWORDS = RELEVANCE_KEYWORDS + ["license", "password"]

_AFF_TRIM = S.trim_ws("concat(' Institute ', source, ' ')")

_works_keep = (
    f"source NOT IN ('{fixtures.NO_AUTHOR_SOURCE}', '{fixtures.NO_AFFILIATION_SOURCE}', "
    f"'{fixtures.NULL_AFF_NAME_SOURCE}', '{fixtures.NO_PUBLISHED_SOURCE}', '{fixtures.NULL_DATE_PART_SOURCE}', "
    f"'{fixtures.NO_ABSTRACT_SOURCE}', '{fixtures.EMPTY_ABSTRACT_SOURCE}')")


@register("flatten_works",
          f"SELECT {S.trim_ws('split_part(text, chr(10), 1)')} AS title, "
          f"{_AFF_TRIM} AS affiliation, "
          f"CAST(2016 + doc_id % 8 AS INTEGER) AS year, {S.trim_ws('text')} AS abstract "
          f"FROM documents WHERE {_works_keep}")
def q_flatten_works(spark, sf_dir):
    return flatten.flatten_works(files.work_items_from_strings(fixtures.works_pages(spark, sf_dir)))


_records_sql = (
    "SELECT concat(source, '/', CAST(doc_id AS VARCHAR), '.json') AS filename, "
    "split_part(text, chr(10), 1) AS title, "
    "CASE WHEN doc_id % 2 = 0 THEN concat('Institute ', source) "
    f"WHEN lang <> '{fixtures.NO_ORG_LANG}' THEN concat('University ', source) END AS organization, "
    "CAST(2016 + doc_id % 8 AS INTEGER) AS year, text AS abstracts FROM documents")


@register("flatten_records", _records_sql)
def q_flatten_records(spark, sf_dir):
    return flatten.flatten_records(files.records_from_strings(fixtures.records_json(spark, sf_dir)))


@register("keyword_relevance",
          "SELECT * FROM (" + _records_sql + ") WHERE length(abstracts) > 0 AND ("
          + " OR ".join(f"contains(lower(abstracts), '{k}')" for k in KEYWORDS) + ")")
def q_keyword_relevance(spark, sf_dir):
    recs = flatten.flatten_records(files.records_from_strings(fixtures.records_json(spark, sf_dir)))
    return flatten.relevant(recs, "abstracts", KEYWORDS)


BASE_URL = "https://pages.example.org"
LISTING_PAGES = 10  # pages joined to one listing
FIRST_CARDS = 100   # cap of html_cards_first_n, below the number of cards


def _element(x: str, tag: str) -> str:
    """Content of the first element ``tag`` (no attributes lost, none needed) of an SQL text."""
    rest = f"substr({x}, strpos({x}, '<{tag}'))"
    return (f"CASE WHEN strpos({x}, '<{tag}') > 0 THEN split_part(substr({rest}, strpos({rest}, '>') + 1), "
            f"'</{tag}>', 1) END")


def _visible(x: str) -> str:
    return S.trim_ws(S.unescape4(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


_PARAGRAPHS = ("list_filter(list_transform(string_split_regex(card, '<p>|<p [^>]*>')[2:], lambda s: "
               + _visible("string_split_regex(s, '</?(p|div|h[1-6]|ul|ol|table|section|article|footer|header)[ >/]')[1]")
               + "), lambda t: t <> '')[1]")


def _cards_sql(pages: str, base_url: str) -> str:
    """Cards cut with plain string functions: the article's text up to its end tag."""
    link = "split_part(split_part(card, 'href=\"', 2), '\"', 1)"
    return (
        f"SELECT page_id, card_no, coalesce(nullif({_visible(_element('card', 'h1'))}, ''), 'No title') AS Title, "
        f"coalesce({_PARAGRAPHS}, 'No abstract') AS Abstract, "
        f"concat('{base_url}', coalesce(nullif({_visible(link)}, ''), 'No URL')) AS Source, "
        f"coalesce(nullif({_visible(_element('card', 'time'))}, ''), 'No year') AS Year FROM ("
        "SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS card_no, "
        "unnest(list_transform(parts, lambda p: split_part(substr(p, strpos(p, '>') + 1), '</article>', 1))) AS card FROM ("
        "SELECT page_id, list_filter(string_split(html, '<article')[2:], lambda p: contains(p, '</article>')) AS parts "
        f"FROM {pages}))")


_LISTINGS_SQL = (f"(SELECT page_id // {LISTING_PAGES} AS page_id, string_agg(html, '' ORDER BY page_id) AS html "
                 "FROM pages GROUP BY 1)")


@register("html_cards", _cards_sql("pages", BASE_URL))
def q_html_cards(spark, sf_dir):
    """Every card of every landed page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.extract_cards(pages, base_url=BASE_URL)


@register("html_listing_cards", _cards_sql(_LISTINGS_SQL, BASE_URL))
def q_html_listing_cards(spark, sf_dir):
    """Listing pages with several cards each."""
    return html.extract_cards(fixtures.listing_pages(spark, sf_dir, LISTING_PAGES), base_url=BASE_URL)


@register("html_cards_first_n", _cards_sql("pages", "") + f" ORDER BY page_id, card_no LIMIT {FIRST_CARDS}")
def q_html_cards_first_n(spark, sf_dir):
    """The result cap of the scraper (stop after N cards): the first N cards in
    (page, card) order. Every page is still parsed; only the output is capped."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.extract_cards(pages, limit=FIRST_CARDS)


# --------------------------------------------------------------------------
# Element tree
# --------------------------------------------------------------------------

@register("html_tree_cards", _cards_sql("pages", BASE_URL))
def q_html_tree_cards(spark, sf_dir):
    """The same cards, read off each page's element tree."""
    return html_tree.extract_cards(spark.read.parquet(f"{sf_dir}/pages.parquet"), base_url=BASE_URL)


@register("html_tag_counts",
          "WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
          "'(?s)(<script[^>]*>|<style[^>]*>).*?</(script|style)>', '\\1', 'g') AS h FROM pages), "
          "tags AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM bare) "
          "SELECT tag, count(*) AS n_elements, count(DISTINCT page_id) AS n_pages FROM tags GROUP BY tag")
def q_html_tag_counts(spark, sf_dir):
    found = html_tree.elements(html_tree.parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.groupBy("tag").agg(F.count("*").alias("n_elements"), F.countDistinct("page_id").alias("n_pages"))
