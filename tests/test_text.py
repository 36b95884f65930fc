"""String functions: markup, whitespace, prefix, tokenising (X1–X15)."""

import html
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import PUNCTUATION, STOPWORDS_V1, STOPWORDS_V2


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_constants():
    assert len(STOPWORDS_V1) == 177 and len(STOPWORDS_V2) == 181
    assert PUNCTUATION == string.punctuation


def test_clean_html_decodes_before_tags(spark):
    # entity decoding happens first, so an encoded tag is removed as well
    assert one(spark, T.clean_html, "&lt;p&gt;Hello&lt;/p&gt; world") == "Hello world"
    # one pass only: a doubly encoded entity is decoded once
    assert one(spark, T.clean_html, "a &amp;lt; b") == "a &lt; b"
    # tags spanning a newline are removed; trailing NBSP trimmed
    assert one(spark, T.clean_html, "<b\nclass='x'>bold</b> ") == "bold"
    assert one(spark, T.clean_html, "&#233;t&eacute; &amp") == html.unescape("&#233;t&eacute; &amp")
    assert one(spark, T.clean_html, None) is None


def test_clean_paragraphs(spark):
    assert one(spark, T.clean_paragraphs, "a\r\nb\n\n c  d  ") == "a b c d"
    assert one(spark, T.clean_paragraphs, "x\ry") == "xy"
    assert one(spark, T.clean_paragraphs, None) is None


def test_strip_abstract_prefix_parity(spark):
    assert one(spark, T.strip_abstract_prefix, "Abstract: x") == ": x"
    assert one(spark, T.strip_abstract_prefix, "Abstracts of y") == "s of y"
    assert one(spark, T.strip_abstract_prefix, "ABSTRACT   body") == "body"
    assert one(spark, T.strip_abstract_prefix, "An abstract") == "An abstract"
    assert one(spark, T.strip_abstract_prefix, None) is None


def py_tokenize(text, words):
    text = text.lower().translate(str.maketrans("", "", string.punctuation))
    return [w for w in text.split() if w not in set(words)]


def test_tokenize_keeps_order_duplicates_and_apostrophe_words(spark):
    s = "The low-carbon grid, the grid! Aren't THESE ±5 c n p"
    got = one(spark, lambda c: T.tokenize(c, STOPWORDS_V2), s)
    assert got == py_tokenize(s, STOPWORDS_V2)
    assert "lowcarbon" in got and got.count("grid") == 2 and "arent" in got
    assert one(spark, lambda c: T.tokenize(c, STOPWORDS_V2), None) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "Beta,", "the", "it's", "x-y", "±", "n", " ", "\n", "  ", "ok."]),
                max_size=30))
def test_tokenize_matches_python(spark, parts):
    s = " ".join(parts)
    assert one(spark, lambda c: T.tokenize(c, STOPWORDS_V1), s) == py_tokenize(s, STOPWORDS_V1)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab <>\n é", max_size=40))
def test_clean_html_idempotent_without_entities(spark, s):
    once = one(spark, T.clean_html, s)
    assert one(spark, T.clean_html, once) == once


def test_word_tokens_and_last_segment(spark):
    assert one(spark, T.word_tokens, "Co2 émission a_b x 42") == ["co2", "émission", "a_b", "42"]
    assert one(spark, T.last_segment, "Institute src1,  NATION_3 ") == "NATION_3"
    assert one(spark, T.last_segment, "Independent Researcher") == "Independent Researcher"
    assert one(spark, T.remove_quotes, 'A "quoted" label') == "A quoted label"


def test_strip_stopwords_option(spark):
    s = "Aren't these fine"
    assert one(spark, lambda c: T.tokenize(c, STOPWORDS_V2), s) == ["arent", "fine"]
    assert one(spark, lambda c: T.tokenize(c, STOPWORDS_V2, strip_stopwords=True), s) == ["fine"]


def test_unicode_trim_set_is_java_unicode_whitespace(spark):
    # The edge trim uses an explicit character set; it must be exactly the
    # set the whitespace-run regex (?U)\s matches, or trim and split disagree.
    bmp = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    found = spark.createDataFrame([(bmp,)], "s string").select(
        F.regexp_extract_all("s", F.lit(r"(?U)(\s)"), 1).alias("w")).first()["w"]
    assert sorted(found) == sorted(T.UNICODE_WHITESPACE)


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet=" \t\n\r\xa0　 \x85abé", max_size=12))
def test_unicode_trim_matches_anchored_regex(spark, s):
    got = spark.createDataFrame([(s,)], "v string").select(
        T.unicode_trim("v").alias("t"), F.regexp_replace("v", r"(?U)^\s+|\s+$", "").alias("r")).first()
    assert got["t"] == got["r"]
