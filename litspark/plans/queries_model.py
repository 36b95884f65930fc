"""Registered queries for the corpus statistics and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark import fixtures
from litspark.functions.constants import COHERENCE_EPSILON, COHERENCE_WINDOW, FINAL_PASSES, K_SWEEP, SWEEP_PASSES
from litspark.operators import coherence, lang, topics
from litspark.plans import sqlparts as S
from litspark.plans import stages
from litspark.plans.queries import register
from litspark.session import stage_table

FIXED_WORDS = sorted({w for ws in fixtures.TOPIC_WORDS.values() for w in ws})
LDA_K = 4
LDA_SEED = 42
_S1 = COHERENCE_WINDOW - 1

_COOC_CTES = (
    f", docs AS (SELECT paper_id, tokens, len(tokens) AS L, "
    f"CASE WHEN len(tokens) = 0 THEN 0 ELSE greatest(1, len(tokens) - {_S1}) END AS n FROM dtok), "
    f"occ AS (SELECT * FROM (SELECT paper_id, n, unnest(generate_series(0, L - 1)) AS pos, "
    f"unnest(tokens) AS word FROM docs WHERE L > 0) WHERE word IN ({', '.join(S.q(w) for w in FIXED_WORDS)})), "
    f"win AS (SELECT DISTINCT paper_id, w, word FROM (SELECT paper_id, word, "
    f"unnest(generate_series(greatest(0, pos - {_S1}), least(pos, n - 1))) AS w FROM occ)), "
    f"single AS (SELECT word AS word_a, word AS word_b, count(*) AS n_windows FROM win GROUP BY 1, 2), "
    f"pairs AS (SELECT a.word AS word_a, b.word AS word_b, count(*) AS n_windows FROM win a JOIN win b "
    f"ON a.paper_id = b.paper_id AND a.w = b.w AND a.word < b.word GROUP BY 1, 2) ")

_COOC_SQL = S.with_base(
    _COOC_CTES + "SELECT word_a, word_b, CAST(n_windows AS BIGINT) AS n_windows, "
    "CAST((SELECT sum(n) FROM docs) AS BIGINT) AS total_windows "
    "FROM (SELECT * FROM single UNION ALL SELECT * FROM pairs)")

_CIJ = "coalesce(CASE WHEN g.wi = g.wj THEN si.n_windows ELSE p.n_windows END, 0)"
_COHERENCE_SQL = S.with_base(
    _COOC_CTES
    + ", nt AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM docs), "
    "grid AS (SELECT a.topic_id, a.term AS wi, b.term AS wj FROM tw a JOIN tw b ON a.topic_id = b.topic_id), "
    f"m AS (SELECT g.topic_id, g.wi, g.wj, ln(({_CIJ} / nt.n + {COHERENCE_EPSILON}) / "
    f"((si.n_windows / nt.n) * (sj.n_windows / nt.n))) / (-ln({_CIJ} / nt.n + {COHERENCE_EPSILON})) AS m "
    "FROM grid g JOIN nt ON true LEFT JOIN single si ON si.word_a = g.wi LEFT JOIN single sj ON sj.word_a = g.wj "
    "LEFT JOIN pairs p ON p.word_a = least(g.wi, g.wj) AND p.word_b = greatest(g.wi, g.wj)), "
    "vw AS (SELECT topic_id, wj, sum(m) AS vw FROM m GROUP BY 1, 2), "
    "pw AS (SELECT m.topic_id, m.wi, sum(m.m * vw.vw) AS dot, sqrt(sum(m.m * m.m)) AS nm, "
    "sqrt(sum(vw.vw * vw.vw)) AS nv FROM m JOIN vw USING (topic_id, wj) GROUP BY 1, 2) "
    "SELECT topic_id, avg(dot / (nm * nv)) AS coherence FROM pw GROUP BY 1")


@register("window_cooccurrence", _COOC_SQL)
def q_window_cooccurrence(spark, sf_dir):
    return coherence.window_cooccurrence(stages.document_tokens(spark, sf_dir), FIXED_WORDS)


@register("coherence_cv", _COHERENCE_SQL)
def q_coherence_cv(spark, sf_dir):
    toks = stages.document_tokens(spark, sf_dir)
    tw = fixtures.topic_words(spark)
    counts = coherence.window_cooccurrence(toks, FIXED_WORDS)
    return coherence.coherence_cv(tw, counts, ("topic_id",))


@register("lda_vocabulary", S.with_base(
    ", v AS (SELECT term, count(*) AS tf FROM (SELECT unnest(tokens) AS term FROM dtok) GROUP BY 1) "
    "SELECT term, tf, row_number() OVER (ORDER BY tf DESC, term) - 1 AS position FROM v"))
def q_lda_vocabulary(spark, sf_dir):
    """The terms a topic model is fitted on, in its order: all of them, ties by term."""
    return topics.dictionary(topics.vocabulary(stages.document_tokens(spark, sf_dir)))


@register("indexed_bags", S.with_base(
    ", v AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS position "
    "FROM (SELECT unnest(tokens) AS term FROM dtok) GROUP BY 1), "
    "c AS (SELECT paper_id, term, count(*) AS n FROM (SELECT paper_id, unnest(tokens) AS term FROM dtok) GROUP BY 1, 2) "
    "SELECT paper_id, string_agg(concat(CAST(position AS VARCHAR), ':', CAST(n AS VARCHAR)), ' ' ORDER BY position) AS bag "
    "FROM c JOIN v USING (term) GROUP BY 1"))
def q_indexed_bags(spark, sf_dir):
    """Documents as bags of dictionary positions."""
    toks = stages.document_tokens(spark, sf_dir)
    bags = topics.indexed_bags(toks, topics.dictionary(topics.vocabulary(toks)))
    pairs = F.zip_with("positions", "counts", lambda p, n: F.concat_ws(":", p, n))
    return bags.select("paper_id", F.array_join(pairs, " ").alias("bag"))


@register("topic_mixtures", S.with_base(
    f"SELECT paper_id, {LDA_K} AS n_topics, true AS is_mixture FROM dtok WHERE len(tokens) > 0"))
def q_topic_mixtures(spark, sf_dir):
    """A model fitted on four fifths of the documents gives every document with a token a mixture of its topics."""
    toks = stages.document_tokens(spark, sf_dir)
    corpus = topics.Corpus(toks)
    fitted = topics.fit_lda(corpus, LDA_K, SWEEP_PASSES, LDA_SEED, vectors=corpus.vectors.where("paper_id % 5 <> 0"))
    mixed = topics.topic_mixtures(fitted, corpus.vectors)
    whole = (F.abs(F.aggregate("mixture", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-6) & F.forall("mixture", lambda x: x >= 0)
    return mixed.select("paper_id", F.size("mixture").alias("n_topics"), whole.alias("is_mixture"))


@register("lda_invariants", (
    f"SELECT CAST(i AS INTEGER) AS topic_id, 10 AS n_terms, true AS ranks_complete, true AS weights_fall, "
    f"true AS weights_sum_to_one FROM generate_series(0, {LDA_K - 1}) AS t(i)"))
def q_lda_invariants(spark, sf_dir):
    """What holds for any fitted model: per topic, ten ranked terms with falling
    weights, and weights over the whole vocabulary that sum to 1."""
    corpus = topics.Corpus(stages.document_tokens(spark, sf_dir))
    try:
        model = topics.fit_lda(corpus, LDA_K, FINAL_PASSES, LDA_SEED)
        every = stage_table(topics.ranked_weights(model, corpus), "ranked-weights")
    finally:
        corpus.release()
    # a weight meets the one before it by a join: a topic has as many rows as the vocabulary has terms
    before = every.select("topic_id", (F.col("rank") + 1).alias("rank"), F.col("weight").alias("before"))
    rows = every.join(before, ["topic_id", "rank"], "left").withColumn(
        "falls", F.coalesce(F.col("weight") <= F.col("before"), F.lit(True)))
    top = F.col("rank") < 10
    return rows.groupBy("topic_id").agg(
        F.count_if(top).cast("int").alias("n_terms"),
        (F.sum(F.when(top, F.col("rank"))) == 45).alias("ranks_complete"), F.bool_and("falls").alias("weights_fall"),
        (F.abs(F.sum("weight") - 1) < 1e-6).alias("weights_sum_to_one"))


@register("select_k_invariants", (
    f"SELECT CAST(unnest([{', '.join(map(str, K_SWEEP))}]) AS INTEGER) AS k, true AS scored, 1 AS n_selected, "
    f"true AS first_maximum"))
def q_select_k_invariants(spark, sf_dir):
    """Every k scored, exactly one selected, and that the first of the best."""
    table, _ = topics.sweep_k(stages.document_tokens(spark, sf_dir), K_SWEEP, SWEEP_PASSES, LDA_SEED)
    every = Window.partitionBy(F.lit(1))  # one row per k
    best = F.max("coherence").over(every)
    first = F.min(F.when(F.col("coherence") == F.col("best"), F.col("k"))).over(every)
    return (table.withColumn("best", best).withColumn("first", first)
            .select("k", F.col("coherence").isNotNull().alias("scored"),
                    F.count_if("selected").over(every).cast("int").alias("n_selected"),
                    (F.col("selected") == (F.col("k") == F.col("first"))).alias("first_maximum")))


@register("lda_topics", None)
def q_lda_topics(spark, sf_dir):
    return topics.lda_topics(stages.document_tokens(spark, sf_dir), LDA_K, 10, FINAL_PASSES, LDA_SEED)


@register("select_k", None)
def q_select_k(spark, sf_dir):
    table, _ = topics.sweep_k(stages.document_tokens(spark, sf_dir), K_SWEEP, SWEEP_PASSES, LDA_SEED)
    return table


_LANG_SQL = (
    "WITH norm AS (SELECT doc_id, lang, concat(' ', regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS t "
    "FROM documents), "
    "grams AS (SELECT doc_id, lang, substr(t, i, 3) AS g FROM (SELECT doc_id, lang, t, "
    "unnest(generate_series(1, length(t) - 2)) AS i FROM norm)), "
    "model AS (SELECT lang, g, count(*) AS c FROM grams WHERE lang IS NOT NULL AND doc_id % 5 <> 0 GROUP BY 1, 2), "
    "v AS (SELECT count(DISTINCT g) AS v FROM model), "
    "tot AS (SELECT lang, sum(c) AS c FROM model GROUP BY 1), "
    "part AS (SELECT d.doc_id, m.lang, sum(ln(m.c + 1)) AS s FROM grams d JOIN model m ON d.g = m.g GROUP BY 1, 2), "
    "tcount AS (SELECT n.doc_id, count(g.g) AS tn FROM norm n LEFT JOIN grams g ON g.doc_id = n.doc_id GROUP BY 1), "
    "scores AS (SELECT t.doc_id, tot.lang, coalesce(p.s, 0) - t.tn * ln(tot.c + (SELECT v FROM v)) AS score "
    "FROM tcount t JOIN tot ON true LEFT JOIN part p ON p.doc_id = t.doc_id AND p.lang = tot.lang), "
    "found AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM part) THEN lang END AS detected_lang "
    "FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang ASC) AS rn FROM scores) WHERE rn = 1) ")


@register("detect_language", _LANG_SQL + "SELECT doc_id, detected_lang FROM found")
def q_detect_language(spark, sf_dir):
    """All documents scored; learned from those with ``doc_id % 5 <> 0``."""
    docs = fixtures.documents(spark, sf_dir).select("doc_id", "text")
    return lang.detect_language(docs, stages.language_profile(spark, sf_dir), "text", "doc_id")


@register("language_accuracy", _LANG_SQL + (
    "SELECT d.lang, count(*) AS n_docs, count(*) FILTER (WHERE d.lang = f.detected_lang) AS n_right "
    "FROM documents d JOIN found f USING (doc_id) WHERE d.doc_id % 5 = 0 AND d.lang IS NOT NULL GROUP BY 1"))
def q_language_accuracy(spark, sf_dir):
    """Per language, held-out documents and how many were identified rightly."""
    docs = fixtures.documents(spark, sf_dir).filter("doc_id % 5 = 0 AND lang IS NOT NULL")
    found = lang.detect_language(docs.select("doc_id", "text"), stages.language_profile(spark, sf_dir), "text", "doc_id")
    return docs.select("doc_id", "lang").join(found, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("lang") == F.col("detected_lang")).alias("n_right"))
