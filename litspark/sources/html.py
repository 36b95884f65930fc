"""Result cards out of landed HTML pages, as one Spark job over the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import CARD_DEFAULTS

# Card and field patterns for the article layout of the landed pages.
ARTICLE_CARD = r"(?s)<article[^>]*>(.*?)</article>"
ARTICLE_FIELDS = {
    "title": r"(?s)<h1[^>]*>(.*?)</h1>",
    "url": r"<a [^>]*href=\"([^\"]*)\"",
    "source": r"(?s)<cite[^>]*>(.*?)</cite>",
    "year": r"(?s)<time[^>]*>(.*?)</time>",
    # a paragraph runs to its closing tag, the next block element or the card's end
    "abstract": r"<p\b[^>]*>([^<]*+(?:<(?!/?(?:p|div|h[1-6]|ul|ol|table|section|article|footer|header)\b)[^<]*+)*+)",
}

#: Something other than tags and white space.
VISIBLE = r"(?sU)\A(?:<[^>]*>|\s++)*+."


def _text(c):
    """Visible text of a fragment: tags removed, entities decoded, trimmed."""
    return T.unicode_trim(T.unescape_entities(T.strip_tags(c)))


def extract_cards(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
                  card_pattern: str = ARTICLE_CARD, fields: dict[str, str] | None = None,
                  base_url: str = "", limit: int | None = None) -> DataFrame:
    """One row per card: (page id, card number, Title, Abstract, Source, Year).

    Each field is the first match of its pattern inside the card that has visible
    text, converted to text; a missing or empty field takes its default ("No
    title", …). Source is ``base_url`` + the card link. All cards are returned
    unless ``limit`` asks for the first N in (page id, card number) order.
    """
    pats = fields or ARTICLE_FIELDS
    cards = pages.select(id_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(card_pattern), 1))
                         .alias("card_no", "_card"))
    # each step is a projection of its own, so no field is computed twice
    for step in (lambda name: F.try_element_at(F.filter(F.regexp_extract_all("_card", F.lit(pats[name]), 1),
                                                        lambda m: m.rlike(VISIBLE)), F.lit(1)),
                 lambda name: _text(F.col(f"_{name}"))):
        kept = [c for c in cards.columns if not c.startswith("_") or c == "_card"]
        cards = cards.select(*kept, *[step(name).alias(f"_{name}") for name in CARD_DEFAULTS if name in pats])

    def field(name):
        default = F.lit(CARD_DEFAULTS[name])
        return F.coalesce(F.nullif(F.col(f"_{name}"), F.lit("")), default) if name in pats else default

    out = cards.select(
        id_col, "card_no",
        field("title").alias("Title"),
        field("abstract").alias("Abstract"),
        F.concat(F.lit(base_url), field("url")).alias("Source"),
        field("year").alias("Year"),
    )
    if limit is not None:
        out = out.orderBy(id_col, "card_no").limit(limit)
    return out
