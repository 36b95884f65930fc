"""Tokens, bag of words, vocabulary bounds and word frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import COMMON_WORDS, STOPWORDS_V1, STOPWORDS_V2
from litspark.operators.lookup import scalar

def empty_tokens():
    return F.array().cast("array<string>")


def tokenize_v1(df: DataFrame, text_col: str = "abstract", out_col: str = "tokens") -> DataFrame:
    """lower → de-punctuate → split → version-1 stop words, every language."""
    return df.withColumn(out_col, T.tokenize(text_col, STOPWORDS_V1))


def english_tokens(df: DataFrame, text_col: str = "abstract", lang_col: str = "lang",
                   out_col: str = "tokens", stopwords: list[str] | None = None) -> DataFrame:
    """Version-2 preprocessing: only English rows are tokenised, others get [].

    ``lang_col`` is the language column (given, or produced by
    ``litspark.operators.lang.detect_language``).
    """
    words = STOPWORDS_V2 if stopwords is None else stopwords
    tokens = F.when(F.col(lang_col) == "en", T.tokenize(text_col, words)).otherwise(empty_tokens())
    return df.withColumn(out_col, tokens)


def processed_text(df: DataFrame, tokens_col: str = "tokens", out_col: str = "processed") -> DataFrame:
    return df.withColumn(out_col, F.array_join(tokens_col, " "))


def bag_of_words(df: DataFrame, tokens_col: str = "tokens", id_col: str = "paper_id") -> DataFrame:
    """Long-form bag of words (id, term, tf)."""
    return (df.select(id_col, F.explode(tokens_col).alias("term"))
              .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def vectorizer_tokens(text_col: str = "processed", stopwords: list[str] | None = None):
    """Word tokens (≥ 2 word characters, lower-cased) without stop words."""
    words = STOPWORDS_V2 if stopwords is None else stopwords
    toks = T.word_tokens(text_col)
    return F.filter(toks, lambda t: ~t.isin(*words)) if words else toks


def vocab_df_bounds(df: DataFrame, text_col: str = "processed", id_col: str = "paper_id",
                    min_df: int = 2, max_df: float = 0.95,
                    stopwords: list[str] | None = None) -> DataFrame:
    """Vocabulary of word tokens (≥ 2 word characters) within document-frequency bounds.

    ``min_df`` is an absolute count, ``max_df`` a share of all input documents
    (empty ones included).
    """
    n_docs = scalar(df.agg(F.count(F.lit(1))))
    pairs = df.select(id_col, F.explode(F.array_distinct(vectorizer_tokens(text_col, stopwords))).alias("term"))
    dfreq = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    return dfreq.filter((F.col("doc_freq") >= min_df) & (F.col("doc_freq") <= F.lit(max_df * n_docs)))


def top_words(df: DataFrame, n: int = 10, ignore=COMMON_WORDS,
              cols=("title", "abstract")) -> DataFrame:
    """Most frequent lower-cased whitespace words over title + abstract.

    Counted with explode + hash aggregate (partial aggregation absorbs very
    frequent words); ties broken by the word.
    """
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in cols]))
    # Exploded first, then filtered as rows: the empty-string test stays in
    # generated code instead of a lambda over every word array.
    words = df.select(F.explode(F.split(text, T.WHITESPACE_RUN)).alias("word"))
    counts = (words.filter((F.length("word") > 0) & ~F.col("word").isin(*ignore))
                   .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))
    return counts.orderBy(F.desc("freq"), F.asc("word")).limit(n)
