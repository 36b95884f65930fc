"""Window counts, coherence, LDA invariants and language identification (M3–M8)."""

import itertools
import math
import random

import numpy as np

from litspark.operators import coherence, lang, topics

WIN = 110


def brute_counts(docs, words, window=WIN):
    single, pair, total = {}, {}, 0
    for toks in docs:
        if not toks:
            continue
        n = max(1, len(toks) - window + 1)
        total += n
        for s in range(n):
            present = sorted(set(toks[s:s + window]) & set(words))
            for w in present:
                single[w] = single.get(w, 0) + 1
            for a, b in itertools.combinations(present, 2):
                pair[(a, b)] = pair.get((a, b), 0) + 1
    return single, pair, total


def spark_counts(spark, docs, words, block=16):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "paper_id int, tokens array<string>")
    rows = coherence.window_cooccurrence(df, words, WIN, block=block).collect()
    single = {r[0]: r[2] for r in rows if r[0] == r[1]}
    pair = {(r[0], r[1]): r[2] for r in rows if r[0] != r[1]}
    total = rows[0][3] if rows else 0
    return single, pair, total


def test_window_counts_by_hand(spark):
    docs = [[], ["x", "y", "x"], ["x"] + ["z"] * 110 + ["y"]]     # lengths 0, 3, 112
    single, pair, total = spark_counts(spark, docs, ["x", "y"])
    assert total == 0 + 1 + 3
    assert single == {"x": 1 + 1, "y": 1 + 1}                    # doc 3: x only in window 0, y only in window 2
    assert pair == {("x", "y"): 1}


def test_window_counts_match_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    docs = [[rng.choice(vocab) for _ in range(rng.choice([0, 5, 60, 109, 110, 111, 300, 700]))] for _ in range(25)]
    words = vocab[:7]
    assert spark_counts(spark, docs, words, block=16) == brute_counts(docs, words)
    assert spark_counts(spark, docs, words, block=2048) == brute_counts(docs, words)


def cv_reference(topic, single, pair, total, eps=1e-12):
    def c2(a, b):
        return single.get(a, 0) if a == b else pair.get(tuple(sorted((a, b))), 0)

    def npmi(a, b):
        pab = c2(a, b) / total
        return math.log((pab + eps) / ((single[a] / total) * (single[b] / total))) / -math.log(pab + eps)

    m = np.array([[npmi(a, b) for b in topic] for a in topic])
    v = m.sum(axis=0)
    return float(np.mean([row @ v / (np.linalg.norm(row) * np.linalg.norm(v)) for row in m]))


def test_coherence_matches_formula_and_planted_beats_shuffled(spark):
    rng = random.Random(3)
    a_words, b_words = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(6)]
    docs = [[rng.choice(a_words if i % 2 else b_words) for _ in range(rng.randint(20, 200))] for i in range(40)]
    planted = a_words[:4]
    mixed = [a_words[0], b_words[0], a_words[1], b_words[1]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "paper_id int, tokens array<string>")
    counts = coherence.window_cooccurrence(df, planted + mixed)
    tw = spark.createDataFrame([(0, r, w) for r, w in enumerate(planted)] + [(1, r, w) for r, w in enumerate(mixed)],
                               "topic_id int, rank int, term string")
    got = {r[0]: r[1] for r in coherence.coherence_cv(tw, counts).collect()}
    single, pair, total = brute_counts(docs, planted + mixed)
    assert abs(got[0] - cv_reference(planted, single, pair, total)) < 1e-9
    assert abs(got[1] - cv_reference(mixed, single, pair, total)) < 1e-9
    assert got[0] > got[1]


def planted_corpus(spark, n=60):
    rng = random.Random(11)
    a, b = [f"alpha{i}" for i in range(8)], [f"beta{i}" for i in range(8)]
    rows = [(i, [rng.choice(a if i % 2 else b) for _ in range(40)]) for i in range(n)]
    rows.append((n, []))  # empty documents are left out of training
    return spark.createDataFrame(rows, "paper_id int, tokens array<string>")


def test_lda_invariants(spark):
    toks = planted_corpus(spark)
    corpus = topics.Corpus(toks)
    try:
        model = topics.fit_lda(corpus, 2, passes=10, seed=42)
        full = topics.topic_terms(model, corpus, len(corpus.vocabulary))
        sums = [r[1] for r in full.groupBy("topic_id").agg({"weight": "sum"}).collect()]
        assert all(abs(s - 1.0) < 1e-6 for s in sums)
        top = topics.topic_terms(model, corpus, 5).collect()
        groups = {t: {r["term"][:4] for r in top if r["topic_id"] == t} for t in (0, 1)}
        assert sorted(len(g) for g in groups.values()) == [1, 1] and groups[0] != groups[1]
        again = topics.topic_terms(topics.fit_lda(corpus, 2, passes=10, seed=42), corpus, 5).collect()
        assert [(r[0], r[2]) for r in again] == [(r[0], r[2]) for r in top]
    finally:
        corpus.release()


def test_sweep_selects_first_maximum(spark):
    table, tps = topics.sweep_k(planted_corpus(spark), [2, 3], passes=5, topn=5)
    rows = {r["k"]: r for r in table.collect()}
    assert sum(r["selected"] for r in rows.values()) == 1
    best = max(rows.values(), key=lambda r: (r["coherence"], -r["k"]))
    assert best["selected"]
    assert tps.filter("k = 3").select("topic_id").distinct().count() == 3


def test_language_detection(spark):
    train = [("en", "the cat and the dog sat on the mat with the other animals"),
             ("fr", "le chat et le chien sont sur le tapis avec les autres animaux"),
             ("de", "die katze und der hund sitzen auf der matte mit den anderen tieren")]
    df = spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate(train)], "doc_id int, lang string, text string")
    prof = lang.train_profile(df)
    probe = spark.createDataFrame([(10, "the dog and the cat"), (11, "le chien et le chat"),
                                   (12, "der hund und die katze"), (13, "")], "doc_id int, text string")
    got = {r[0]: r[1] for r in lang.detect_language(probe, prof).collect()}
    assert got[10] == "en" and got[11] == "fr" and got[12] == "de"
    assert got[13] is None   # no trigram seen in training: not identified


def test_bounded_vocabulary_matches_sql_operator(spark):
    from litspark import fixtures
    from litspark.operators import corpus
    docs = fixtures.documents(spark, "/root/testdata/sf0.001").withColumnRenamed("doc_id", "paper_id")
    v1 = corpus.processed_text(corpus.tokenize_v1(docs, "text"))
    expected = {r[0] for r in corpus.vocab_df_bounds(v1, "processed", "paper_id").collect()}
    toks = v1.select("paper_id", corpus.vectorizer_tokens("processed").alias("tokens"))
    c = topics.Corpus(toks, min_df=2.0, max_df=0.95)
    try:
        assert set(c.vocabulary) == expected
        words = topics.lda_topics(toks, 5, n=3, passes=2, seed=42, min_df=2.0, max_df=0.95)
        assert words.select("topic_id").distinct().count() == 5
    finally:
        c.release()


def test_language_detection_join_path_matches_broadcast(spark, monkeypatch):
    # Above the broadcast bound the profile is joined, not broadcast: same answers.
    from litspark import fixtures
    docs = fixtures.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang")
    prof = lang.train_profile(docs)
    hinted = lang.detect_language(docs, prof)
    assert "strategy=broadcast" in hinted._jdf.queryExecution().optimizedPlan().toString()
    small = sorted(map(tuple, hinted.collect()))
    monkeypatch.setattr(lang, "MAX_BROADCAST_CELLS", len(prof.langs) + 1)  # one trigram at most
    joined = lang.detect_language(docs, prof)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, joined.collect())) == small


def test_seeded_fit_does_not_depend_on_input_partitions(spark):
    # every term has the same frequency: only the tie-break by term orders the vocabulary
    rng = random.Random(5)
    docs = []
    for i in range(60):
        words = [f"{'ab'[i % 2]}{j}" for j in range(10)] * 3
        rng.shuffle(words)
        docs.append((i, words))
    base = spark.createDataFrame(docs, "paper_id int, tokens array<string>")
    got = []
    for n in (1, 3, 7):
        c = topics.Corpus(base.repartition(n), tokens_per_partition=500)
        try:
            assert c.partitions == 4
            terms = topics.topic_terms(topics.fit_lda(c, 2, passes=3, seed=42), c, 8).orderBy("topic_id", "rank").collect()
            got.append([(r["topic_id"], r["term"], round(r["weight"], 9)) for r in terms])
        finally:
            c.release()
    assert got[0] == got[1] == got[2]


def test_vocabulary_has_every_term(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a", "c"]), (3, [])], "paper_id int, tokens array<string>")
    assert {(r["term"], r["tf"]) for r in topics.vocabulary(df).collect()} == {("a", 2), ("b", 2), ("c", 1)}
    assert {r["term"] for r in topics.vocabulary(df, min_df=2).collect()} == {"a"}
    assert {r["term"] for r in topics.vocabulary(df, max_df=0.5).collect()} == {"b", "c"}
    c = topics.Corpus(df)
    assert c.vocabulary == ["a", "b", "c"]
    c.release()


def test_unseen_topic_word_counts_as_zero(spark):
    docs = spark.createDataFrame([(i, ["a", "b", "x"]) for i in range(3)] + [(9, ["x"])], "paper_id int, tokens array<string>")
    tw = spark.createDataFrame([(0, 0, "a"), (0, 1, "zz"), (1, 0, "a"), (1, 1, "b")], "topic_id int, rank int, term string")
    counts = coherence.window_cooccurrence(docs, tw.select("term"), WIN, pairs=coherence.topic_pairs(tw))
    got = {r[0]: r[1] for r in coherence.coherence_cv(tw, counts).collect()}
    assert abs(got[0] - 0.5) < 1e-9 and abs(got[1] - 1.0) < 1e-9   # zz: the zero vector, similarity 0


def test_only_asked_pairs_are_counted(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c"])], "paper_id int, tokens array<string>")
    pairs = spark.createDataFrame([("a", "c")], "word_a string, word_b string")
    rows = coherence.window_cooccurrence(docs, ["a", "b", "c"], WIN, pairs=pairs).collect()
    assert {(r[0], r[1]) for r in rows} == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "c")}


def test_unidentified_text_is_not_english(spark):
    from litspark.operators import corpus
    df = spark.createDataFrame([(1, "en", "the cat sat"), (2, "fr", "le chat assis")], "doc_id int, lang string, text string")
    prof = lang.train_profile(df)
    probe = spark.createDataFrame([(1, ""), (2, None), (3, "12"), (4, "the cat")], "paper_id int, text string")
    got = lang.with_language(probe, prof, "text")
    assert {r["paper_id"]: r["lang"] for r in got.collect()} == {1: None, 2: None, 3: None, 4: "en"}
    tokens = {r["paper_id"]: r["tokens"] for r in corpus.english_tokens(got, "text").collect()}
    assert tokens == {1: [], 2: [], 3: [], 4: ["cat"]}
    empty = lang.train_profile(df.limit(0))
    assert {r[1] for r in lang.detect_language(probe, empty, "text", "paper_id").collect()} == {None}
