"""The end-to-end flow as composable stages (DataFrame → DataFrame).

acquire (sources) → clean → coordinates → tokens → topics → assign → analytics.
Stages hand DataFrames to each other; files appear only at the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litspark import fixtures
from litspark.functions.constants import FINAL_PASSES, K_SWEEP, SWEEP_PASSES, TOP_WORDS_PER_TOPIC
from litspark.operators import assign, clean, corpus, geo, lang, stats, topics
from litspark.session import stage_table
from litspark.sources.files import paper_key


def clean_stage(papers: DataFrame) -> DataFrame:
    return clean.clean_papers(papers)


def coordinates_stage(cleaned: DataFrame, gazetteer: DataFrame) -> DataFrame:
    return geo.with_coordinates(cleaned, gazetteer)


def tokens_stage(df: DataFrame) -> DataFrame:
    return corpus.english_tokens(df, "abstract", "lang", "tokens")


def assign_stage(tokens: DataFrame, topic_words: DataFrame, labels: DataFrame | None) -> DataFrame:
    assigned = assign.assign_topic(tokens, topic_words, "tokens", "paper_id", "topic_id")
    names = assign.topic_names(topic_words, labels)
    return assign.attach_labels(assigned, names, "topic_id", "assigned_topic")


def language_profile(spark: SparkSession, sf_dir: str) -> lang.LanguageProfile:
    """Profile of the labelled documents outside the held-out fifth (``doc_id % 5 = 0``)."""
    docs = fixtures.documents(spark, sf_dir)
    return lang.train_profile(docs.filter(docs["doc_id"] % 5 != 0), "text", "lang")


def from_source(rows: DataFrame, profile: lang.LanguageProfile) -> DataFrame:
    """Rows of any source (title, affiliation, year, abstract) → cleaned papers with a
    digest key, their identified language and their tokens. A ``lang`` column that
    the source gives is kept."""
    keyed = rows if "paper_id" in rows.columns else paper_key(rows)
    cleaned = clean_stage(keyed)
    if "lang" not in cleaned.columns:
        cleaned = stage_table(cleaned, "cleaned")  # read by the identification and by its join
        cleaned = lang.with_language(cleaned, profile, "abstract", "paper_id", "lang")
    return tokens_stage(cleaned)


def source_distribution(rows: DataFrame, profile: lang.LanguageProfile, topic_words: DataFrame,
                        labels: DataFrame | None) -> DataFrame:
    """source → key → clean → language → tokens → assign → topic distribution."""
    return stats.topic_distribution(assign_stage(from_source(rows, profile), topic_words, labels))


def papers_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned papers with coordinates."""
    return coordinates_stage(clean_stage(fixtures.papers(spark, sf_dir)), fixtures.gazetteer(spark, sf_dir))


def papers_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_stage(papers_geo(spark, sf_dir))


def papers_topic(spark: SparkSession, sf_dir: str, topic_words: DataFrame | None = None,
                 labels: DataFrame | None = None) -> DataFrame:
    """Cleaned, located, tokenised papers with their topic id and label."""
    tw = fixtures.topic_words(spark) if topic_words is None else topic_words
    lb = fixtures.topic_labels(spark) if labels is None else labels
    return assign_stage(papers_tokens(spark, sf_dir), tw, lb)


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English tokens of every document (whole texts), keyed by paper_id."""
    docs = fixtures.documents(spark, sf_dir).withColumnRenamed("doc_id", "paper_id")
    return corpus.english_tokens(docs, "text", "lang", "tokens").select("paper_id", "tokens")


def end_to_end(papers: DataFrame, gazetteer: DataFrame, countries: DataFrame, labels: DataFrame | None = None,
               ks=K_SWEEP, sweep_passes: int = SWEEP_PASSES, final_passes: int = FINAL_PASSES,
               seed: int = 42, out_dir: str | None = None,
               profile: lang.LanguageProfile | None = None) -> dict[str, DataFrame]:
    """clean → locate → tokenise → k sweep → final model → assign → analytics.

    ``papers`` may come straight from a source without key and language; the
    language is then identified with ``profile``. One corpus serves the sweep and
    the final fit.

    Files are written only at the edges (``out_dir``): the located papers, the
    topic words (wide CSV), the coherence curve, the labelled papers and the
    topic distribution (CSV and JSON).
    """
    from litspark.sources import sinks
    from litspark.sources import topics as topic_io

    # The cleaned, located, tokenised papers feed the sweep, the final fit and
    # the assignment: written once to the shared folder.
    tokens = stage_table(coordinates_stage(from_source(papers, profile), gazetteer), "papers")
    located = tokens.drop("tokens")
    shared = topics.Corpus(tokens.select("paper_id", "tokens"))
    try:
        scores, _ = topics.sweep_k(shared, ks, sweep_passes, seed)
        best_k = scores.filter("selected").first()["k"]
        words = topics.lda_topics(shared, best_k, TOP_WORDS_PER_TOPIC, final_passes, seed)
    finally:
        shared.release()
    labelled = assign_stage(tokens, words.select("topic_id", "rank", "term"), labels)
    out = {
        "papers_geo": located, "coherence": scores, "topic_words": words, "papers_topic": labelled,
        "topic_distribution": stats.topic_distribution(labelled),
        "country_density": geo.country_density(labelled, countries),
        "kpis": stats.kpis(labelled), "papers_by_year": stats.papers_by_year(labelled),
        "top_institutions": stats.top_institutions(labelled),
        "dominant_topic_by_latitude": stats.dominant_topic_by_latitude(labelled),
    }
    if out_dir:
        sinks.write_csv(located, f"{out_dir}/papers_geo")
        topic_io.write_topic_words(words.select("topic_id", "rank", "term"), f"{out_dir}/topic_words",
                                   TOP_WORDS_PER_TOPIC)
        sinks.write_csv(scores, f"{out_dir}/coherence")
        sinks.write_csv(labelled.drop("tokens"), f"{out_dir}/papers_topic")
        sinks.write_csv(out["topic_distribution"], f"{out_dir}/topic_distribution")
        sinks.write_json(out["topic_distribution"], f"{out_dir}/topic_distribution_json")
    return out
