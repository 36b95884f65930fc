"""Column-level text functions.

All of these are built-in Spark expressions (JVM side, inside whole-stage
codegen) except the HTML entity decoder, which is an Arrow-batched pandas UDF
that only ever receives the values that contain ``&``.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litspark.functions.constants import PUNCTUATION, STOPWORDS_V2
from litspark.session import bound_batches

ColumnOrName = Column | str

# Java regex with UNICODE_CHARACTER_CLASS: \s matches NBSP and the other
# Unicode spaces, like Python's str.split()/str.strip().
WHITESPACE_RUN = r"(?U)\s+"
# The same set as characters, for the edge trims: \t-\r, space, NEL, NBSP,
# OGHAM SPACE MARK, U+2000-U+200A, LINE/PARAGRAPH SEPARATOR, NNBSP, MMSP and
# IDEOGRAPHIC SPACE (the Unicode White_Space property).
UNICODE_WHITESPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                      + "\u2028\u2029\u202f\u205f\u3000")
TAG_PATTERN = r"<[^>]*>"
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else v)


def unescape_entities(c: ColumnOrName) -> Column:
    """One-pass HTML entity decode (named, numeric, and the legacy forms without ';').

    The UDF input is null unless the value contains '&', so Arrow ships only
    the rows that can change; the rest stay in the JVM. Its batches are bounded.
    """
    bound_batches(SparkSession.active())
    c = _col(c)
    decoded = _unescape_batch(F.when(c.contains("&"), c))
    return F.coalesce(decoded, c)


def unicode_trim(c: ColumnOrName) -> Column:
    """Strip Unicode whitespace at both ends (Spark's plain ``trim`` strips only
    spaces). Looks at the edges only, not the whole text like an anchored regex."""
    return F.trim(_col(c), F.lit(UNICODE_WHITESPACE))


def strip_tags(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), TAG_PATTERN, "")


def clean_html(c: ColumnOrName) -> Column:
    """Decode entities once, then remove tags, then trim. Null stays null."""
    return unicode_trim(strip_tags(unescape_entities(c)))


def clean_paragraphs(c: ColumnOrName) -> Column:
    """Delete CR, turn every whitespace run (incl. newlines) into one space, trim."""
    no_cr = F.replace(_col(c), F.lit("\r"), F.lit(""))
    return unicode_trim(F.regexp_replace(no_cr, WHITESPACE_RUN, " "))


def strip_abstract_prefix(c: ColumnOrName) -> Column:
    """Drop a leading 'abstract' (any case) and the whitespace after it.

    Exactly eight characters go, so 'Abstracts of x' becomes 's of x'.
    """
    return F.regexp_replace(_col(c), r"(?U)^[Aa][Bb][Ss][Tt][Rr][Aa][Cc][Tt]\s*", "")


def tokenize(c: ColumnOrName, stopwords: list[str] | None = None, strip_stopwords: bool = False) -> Column:
    """lower → delete ASCII punctuation → split → drop stop words.

    Duplicates and order are kept. Null input gives an empty array. Punctuation
    is deleted before the stop-word test, so by default a listed word with an
    apostrophe ("aren't") never matches; ``strip_stopwords=True`` deletes the
    punctuation from the list as well ("arent" is then removed).
    """
    words = STOPWORDS_V2 if stopwords is None else stopwords
    if strip_stopwords:
        table = str.maketrans("", "", PUNCTUATION)
        words = list(dict.fromkeys(w.translate(table) for w in words if w.translate(table)))
    base = F.translate(F.lower(_col(c)), PUNCTUATION, "")
    parts = F.split(base, WHITESPACE_RUN)
    if words:
        kept = F.filter(parts, lambda t: (F.length(t) > 0) & ~t.isin(*words))
    else:
        kept = F.filter(parts, lambda t: F.length(t) > 0)
    return F.coalesce(kept, F.array().cast("array<string>"))


def word_tokens(c: ColumnOrName) -> Column:
    """Lower-cased tokens of two or more letter/digit/underscore characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_PATTERN), 0)


def remove_quotes(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), '"', "")


def last_segment(c: ColumnOrName, sep: str = ",") -> Column:
    """Text after the last separator, trimmed; the whole value when there is none."""
    return unicode_trim(F.substring_index(_col(c), sep, -1))
